"""A table's way from raw rows to what clusters are made of, in the order that settings name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators import draws, impute, outliers, prepare
from quartzite.operators import relational as rel


def prepare_data(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    labels: Sequence | None = None,
    sampling: dict | None = None,
    filters: Sequence[str] = (),
    outlier: dict | None = None,
    divisor: str | None = None,
    invert: bool = False,
    logs: bool = False,
    derived: dict[str, str] | None = None,
    fill: str | None = "mean",
    key: str | None = None,
    by: str | None = None,
    normalise: str | None = None,
) -> DataFrame:
    """Rows of the given labels; then, where asked, a sample, filters, without outliers, ratios, logarithms, without columns
    that hold nothing, derived columns, filled cells, and features on one scale (``standard`` or ``minmax``).

    Other columns pass through."""
    own = rel.isin(df, label, labels) if label and labels is not None else df
    own = draws.sample(own, **sampling) if sampling else own
    own = prepare.keep(own, filters)
    own = outliers.drop_outliers(own, features, **outlier) if outlier else own
    own = rel.ratios(own, [c for c in features if c != divisor], divisor, invert) if divisor else own
    own = prepare.logarithm(own, features) if logs else own
    held = own.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in features)).first()
    left = [c for c in features if held[c] or not held["_rows"]]
    own = own.drop(*(c for c in features if c not in left))
    own = prepare.derive(own, derived or {})
    left += list(derived or {})
    if fill == "pmm":
        own = impute.impute(own, key, left, "pmm", by)
    elif fill:
        own = prepare.fill(own, left, fill)
    scale = {None: lambda d, c: d, "standard": prepare.standardise, "minmax": prepare.min_max}
    return scale[normalise](own, left)
