"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled texts.  A text's feature is the size it
compresses to with the bad dictionary less that with the good one, over its length in bytes; a logistic curve,
fitted on labelled texts that the dictionaries have not seen, turns it into a probability that the label is 1.

Training sample: of each label at most ``MAX_ROWS`` rows, the first by a hash of the id among those with texts of 1 to
``MAX_TRAIN_BYTES`` bytes.  Those are the bounds on what reaches the driver.  A dictionary of ``DICTIONARY_BYTES`` is
trained on a label's sample; where that has under 64 texts, too few to train on, the last DICTIONARY_BYTES of the
sample's texts serve as they are.  Rows whose ``crc32`` of the id as text
leaves 1 on division by 3 are held out and never learned from.  An id with differing labels counts as its mean
label, halves up; labels that are null are ignored.  Scoring reads every whole text and nothing else of a row.

Null and empty texts have feature 0.  Repeated rows get equal scores; a null id is not held out.  Without two
classes to learn from, every score is the labelled share of label 1 (0.5 without labels).  An empty table gives an
empty result.  Further columns are carried by ``score`` and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.llm.common import free, read_table

MAX_ROWS = 3000
MAX_TRAIN_BYTES = 32768
DICTIONARY_BYTES = 65536
LEVEL = 3
FOLDS = 3
HELD_OUT = 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scorer(self):
        if not self.good:
            flat = 1 / (1 + np.exp(-self.offset))
            return lambda text: flat
        sizes = _sizes(self.good, self.bad)
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.slope * sizes(text.encode() if text else b"") + self.offset, -500, 500))))


def _compressor(dictionary: bytes):
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False).compress


def _sizes(good: bytes, bad: bytes):
    by_good, by_bad = _compressor(good), _compressor(bad)
    return lambda raw: (len(by_bad(raw)) - len(by_good(raw))) / max(len(raw), 1)


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> list[tuple[int, str, int]]:
    """The bounded training sample: id, text, label, in a fixed order.

    Ids, lengths and hashes alone are joined with the labels and ordered; the texts of the chosen rows follow."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    own = own.where(F.crc32(F.col("_id").cast("string")) % FOLDS != HELD_OUT)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.octet_length("_text").between(1, MAX_TRAIN_BYTES)).withColumn("_th", F.xxhash64("_text"))
    known = texts.select("_id", "_th").join(own, "_id").distinct()
    first = lambda label: known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id", "_th").limit(MAX_ROWS)
    chosen = first(0).unionByName(first(1))  # 2 * MAX_ROWS rows of three numbers
    got = texts.join(F.broadcast(chosen), ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("_id", "_text", "_label").collect()
    return sorted(map(tuple, got))


def train(rows: list[tuple[int, str, int]]) -> Model:
    """Dictionaries from four fifths of the rows, the curve from the rest."""
    by: dict[int, list[bytes]] = {0: [], 1: []}
    rest: list[tuple[bytes, int]] = []
    for k, text, label in rows:
        raw = text.encode()
        if _mix(k) % 5 == 0:
            rest.append((raw, label))
        else:
            by[label].append(raw)
    share = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    flat = Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    if not all(by.values()):
        return flat
    good, bad = _dictionary(by[1]), _dictionary(by[0])
    sizes = _sizes(good, bad)
    pairs = rest if len({y for _, y in rest}) == 2 else [(x, y) for y in (0, 1) for x in by[y]]
    x, y = np.array([sizes(raw) for raw, _ in pairs]), np.array([y for _, y in pairs], float)
    slope, offset = _logistic(x, y)
    return Model(good, bad, slope, offset)


def _mix(k: int) -> int:
    return (k * 0x9E3779B97F4A7C15 % 2**64) >> 40


def _dictionary(samples: list[bytes]) -> bytes:
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too little text for a trained one
            pass
    return b"\n".join(samples)[-DICTIONARY_BYTES:]  # content alone serves as a dictionary too


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method on the centred and scaled feature, with a light ridge."""
    centre, scale = x.mean(), x.std() or 1.0
    design = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    return train(sample(docs, labels, **columns))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "_score") -> DataFrame:
    """``docs`` with a score for every row, the last column: ``out_col``, with more underscores where the table has such
    a column.  The model is under 200 KB and travels with the tasks."""
    at = docs.columns.index(text_col)
    (out_col,) = free(docs.columns, out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            got = pa.array([of(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
