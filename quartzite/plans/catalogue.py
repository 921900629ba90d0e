"""All queries of the library; the first is the flagship, so its module comes first."""

from quartzite.plans import queries  # noqa: F401, I001
from quartzite.plans import analysis, relational  # noqa: F401
from quartzite.plans.registry import ORACLES, QUERIES  # noqa: F401
