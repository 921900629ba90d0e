"""Quality rules by weak supervision.

Each rule votes good (2), bad (0) or abstains (1) on a text.  Expectation-maximisation over the counts of vote
patterns estimates every rule's accuracy on either class, and a text is kept if its posterior probability of being
good reaches one half.  Nothing but pattern counts leaves the executors: with R rules there are at
most 3**R.

Base measures, on words ``[^\\x20\\x09-\\x0D]+`` of the whole text: ``word_chars`` (code points in words),
``n_symbols`` (characters of ``[#*$%&|<>]``), ``n_dup_lines`` (lines between ``\\n`` with a word, equal to an earlier
line), ``n_repeat_words`` (words in 3-word windows found twice or more).  ``base_failed`` is true under 50 words, or
with over half the words in repeated windows; such a text is never kept.

Null and empty texts have no words, so they fail the base.  Repeated rows get equal answers, one per row; the id is
carried, null or not, and further columns are not read.  An empty table gives an empty result.  The probability
depends on all rows of the table, since the accuracies do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import cut, read_table

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
GOOD, NONE, BAD = 2, 1, 0
#: Rules: name, then measures with the least value from which the rule votes bad, then measures with the greatest
#: value up to which, all together, it votes good; else it abstains.  Rules that tell the same fault are one rule,
#: since the model takes the errors of different rules as independent.
RULES = (
    ("symbols", {"symbol_share": 0.1}, {}),
    ("repeats", {"repeat_share": 0.3, "few_words": 0.9}, {}),
    ("shouting", {"upper_share": 0.4, "bang_share": 0.1}, {}),
    ("same lines", {"dup_line_share": 0.5}, {}),
    ("word length", {"mean_length": 14.0}, {}),
    ("plain prose", {}, {"symbol_share": 0.02, "repeat_share": 0.1, "upper_share": 0.2, "bang_share": 0.01, "dup_line_share": 0.2, "mean_length": 10.0}),
    ("varied words", {}, {"few_words": 0.6, "symbol_share": 0.05, "upper_share": 0.3}),
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then n_lines, distinct words, upper, lower, bangs."""
    if not text:
        return (0,) * 10
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    return (n, chars, symbols, dup, repeat_words(own, len(ids)), lines, len(ids), *letters(raw), raw.count(b"!!"))


def repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_distinct + ids[1:]
    if n_distinct > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def letters(raw: bytes) -> tuple[int, int]:
    code = np.frombuffer(raw, np.uint8)
    by = np.bincount(code, minlength=256)
    return int(by[65:91].sum()), int(by[97:123].sum())


def votes(m: np.ndarray) -> np.ndarray:
    """Pattern of each row of measures: the rules' votes as digits to base 3, the first rule lowest."""
    n = np.maximum(m[:, 0], 1)
    shares = {
        "symbol_share": m[:, 2] / n,
        "repeat_share": m[:, 4] / n,
        "upper_share": m[:, 7] / np.maximum(m[:, 7] + m[:, 8], 1),
        "bang_share": m[:, 9] / n,
        "mean_length": m[:, 1] / n,
        "dup_line_share": m[:, 3] / np.maximum(m[:, 5], 1),
        "few_words": 1 - m[:, 6] / n,
    }
    out = np.zeros(len(m), np.int32)
    for k, (_, bad, good) in enumerate(RULES):
        vote = np.full(len(m), NONE)
        if good:
            vote[np.all([shares[name] <= most for name, most in good.items()], axis=0) & (m[:, 0] > 0)] = GOOD
        for name, least in bad.items():
            vote[shares[name] >= least] = BAD
        out += (vote * 3**k).astype(np.int32)
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures and the vote pattern of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            m = np.array([measure(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, 10)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[:, k]) for k in range(5)), pa.array(votes(m))], names=["doc_id", *MEASURES, "pattern"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES) + ", pattern int"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, vote probabilities [class, rule, vote] and the share of good texts.

    Starts from: texts with more bad votes than good are probably bad.  A rule's accuracy on a class is the
    probability that it votes for it; pseudo-counts of a tenth keep votes possible that a class has not cast.
    """
    digits = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
    post = np.where((digits == BAD).sum(axis=1) > (digits == GOOD).sum(axis=1), 0.1, 0.9)
    onehot = (digits[:, :, None] == np.arange(3)).astype(float)
    prior, table = 0.5, np.full((2, len(RULES), 3), 1 / 3)
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * counts
        prior = (share[1].sum() + 1) / (share.sum() + 2)
        table = np.einsum("cp,prv->crv", share, onehot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log([1 - prior, prior])[:, None] + np.einsum("crv,prv->cp", np.log(table), onehot)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-9:
            break
    return post, table, float(prior)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, kept and quality_probability of every row."""
    spark = docs.sparkSession
    found = cut(measures(docs, id_col, text_col), "measures")
    rows = sorted(tuple(r) for r in found.groupBy("pattern").count().collect())  # 3**7 rows at most
    patterns, counts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    post, _, _ = estimate(patterns, counts)
    learned = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post, strict=True)], "pattern int, quality_probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return (
        found.join(F.broadcast(learned), "pattern")
        .withColumn("base_failed", failed)
        .select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
