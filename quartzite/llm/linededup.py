"""Line dedup by winnowing.

A text's sequence is its lines (between ``\\n``) that are not blank, without white space at either end.  Of every
``WINDOW`` lines in a row the least line hash, the last of equals, is selected as a fingerprint.  Equal runs of
``WINDOW`` lines or more select equal fingerprints, so joining positions on fingerprints and extending the matches
both ways finds every such run.  Lines in a run of ``WINDOW`` lines that also occurs earlier go; earlier means a
smaller id, with equal ids a smaller text hash, within a text an earlier line.  Runs are judged on the input, not on
what is left.  Blank lines stay where they are, but for those between two lines that both go.

Runs of fewer lines go by the same rule if they hold ``LONG`` words or more.  Each is keyed by its own lines, and the
earliest of each key is found by an aggregate.  Shorter runs of fewer than ``WINDOW`` lines stay.

Each fingerprint is joined with its earliest position alone, not with all others.  The windows that this leaves open
(they match another earlier position, or none) are keyed by their own lines, and the earliest of each key is found by
an aggregate.  So rows grow with the input, whatever the number of copies.

Null and empty texts give an empty result row; null ids come first.  Rows that repeat both id and text are one
document: none is the earlier, and each gets the same answer.  An empty table gives an empty result.  Further columns are carried by ``remove_runs`` and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.llm.common import cut, free, id_order, read_table

WINDOW = 3
LONG = 50
#: Keys that over one in so many rows have are joined by broadcast; they are fewer than this.
COMMON = 1000


def line_hashes(text: str | None) -> tuple[np.ndarray, list[int]]:
    """Hashes of the lines that are not blank, and their places among all lines."""
    if not text:
        return np.zeros(0, np.uint64), []
    digest, hashes, places = xxhash.xxh3_64_intdigest, [], []
    for k, line in enumerate(text.encode().split(b"\n")):
        line = line.strip()
        if line:
            hashes.append(digest(line))
            places.append(k)
    return np.array(hashes, np.uint64), places


def select(hashes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(position, first start, last start) of each selected hash and the windows that select it."""
    n = len(hashes) - window + 1
    if n <= 0:
        return []
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.arange(n) + window - 1 - np.argmin(views[:, ::-1], axis=1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[a]), int(a), int(b) - 1) for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [n])), strict=True)]


def _fingerprints(docs: DataFrame, window: int) -> DataFrame:
    span = 2 * window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids, ths, hs, ps, firsts, lasts, around = [], [], [], [], [], [], []
            for key, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes, _ = line_hashes(x.as_py())
                if len(hashes) < window:
                    continue
                padded = np.concatenate((np.zeros(window - 1, np.uint64), hashes, np.zeros(window - 1, np.uint64)))
                for p, a, b in select(hashes, window):
                    ids.append(key)
                    ths.append(th)
                    hs.append(hashes[p])
                    ps.append(p)
                    firsts.append(a)
                    lasts.append(b)
                    around.append(padded[p : p + span].astype("<u8").tobytes())
            cols = (pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(np.array(hs, np.uint64).view(np.int64)), *(pa.array(v, pa.int32()) for v in (ps, firsts, lasts)), pa.array(around, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(cols), names=["k", "th", "h", "p", "a", "b", "around"])

    return docs.select("k", "th", "text").mapInArrow(run, "k long, th long, h long, p int, a int, b int, around binary")


def _extend(joined: DataFrame, window: int) -> DataFrame:
    """For each window of a fingerprint: whether it matches the earliest position's lines, and its key if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own, first = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), "<u8").reshape(n, -1) for c in (5, 6))
            p, a, b = (batch.column(c).to_numpy() for c in (2, 3, 4))
            alone = batch.column(7).to_numpy(zero_copy_only=False).astype(bool)
            same = own == first
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)  # lines that match before and after the fingerprint
            for step, total in ((-1, left), (1, right)):
                going = np.ones(n, bool)
                for d in range(1, window):
                    going &= same[:, window - 1 + step * d]
                    total += going
            rows, starts, keys = [], [], []
            for o in range(window):  # the window starts o lines before the fingerprint
                s = p - o
                mine = np.flatnonzero((s >= a) & (s <= b))
                dup = (left[mine] >= o) & (right[mine] >= window - 1 - o) & ~alone[mine]
                for i, d in zip(mine.tolist(), dup.tolist(), strict=True):
                    rows.append(i)
                    starts.append(s[i])
                    keys.append(None if d else xxhash.xxh3_128_digest(own[i, window - 1 - o : 2 * window - 1 - o].tobytes()))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(keys, pa.binary())], names=["k", "th", "s", "key"])

    cols = ["k", "th", "p", "a", "b", "around", "first_around", "alone"]
    return joined.select(*cols).mapInArrow(run, "k long, th long, s int, key binary")


def _met(rows: DataFrame, key: str, first: DataFrame, key2: str) -> DataFrame:
    """``rows`` with their key's row of ``first``, in which ``n`` tells how many of ``rows`` have the key; others go.

    Keys that over one in COMMON of the rows have are fewer than COMMON, so their rows of ``first`` travel to the tasks;
    all others are shuffled, and none of those fills a task."""
    held, same = cut(first, "first"), F.col(key) == F.col(key2)
    limit = rows.count() // COMMON  # of a written table: from its footers
    common = F.broadcast(held.where(F.col("n") > limit))
    return rows.join(common, same).unionByName(rows.join(common.select(key2), same, "left_anti").join(held.where(F.col("n") <= limit), same))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(k, th, s)``: starts of the windows of lines that occur earlier, of ``docs (k, th, text)``."""
    spots = cut(_fingerprints(docs, window).distinct(), "fingerprints")
    place = F.struct("k", "th", "p")
    first = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.min_by("around", place).alias("first_around")).where("n > 1").select(F.col("h").alias("h2"), "n", "at", "first_around")
    joined = _met(spots, "h", first, "h2").withColumn("alone", F.struct("k", "th", "p") == F.col("at"))
    seen = cut(_extend(joined, window), "windows")
    low = seen.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "th", "s")).alias("at")).where("n > 1").select(F.col("key").alias("key2"), "n", "at")
    later = _met(seen, "key", low, "key2").where(F.struct("k", "th", "s") > F.col("at"))
    return seen.where("key is null").select("k", "th", "s").unionByName(later.select("k", "th", "s"))


def repeated_long(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """``(k, th, s, size)``: starts and lengths of the runs of under ``window`` lines that hold ``long`` words and occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids, ths, starts, sizes, keys = [], [], [], [], []
            for key, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes, words = line_hashes(x.as_py())[0], [len(w) for line in x.as_py().encode().split(b"\n") if (w := line.split())]
                total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
                for n in range(1, window):
                    for s in np.flatnonzero(total[n:] - total[:-n] >= long).tolist():
                        ids.append(key)
                        ths.append(th)
                        starts.append(s)
                        sizes.append(n)
                        keys.append(xxhash.xxh3_128_digest(hashes[s : s + n].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], names=["k", "th", "s", "size", "key"])

    seen = cut(docs.select("k", "th", "text").mapInArrow(run, "k long, th long, s int, size int, key binary"), "long")
    place = F.struct("k", "th", "s")
    low = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.max(place).alias("last")).where("at < last").select(F.col("key").alias("key2"), "n", "at")
    return _met(seen, "key", low, "key2").where(place > F.col("at")).select("k", "th", "s", "size")


def strip(text: str | None, starts: list[int] | None, window: int = WINDOW) -> tuple[str, int, int, int]:
    """What is left of the text, its number of lines with a word, of lines removed and of runs removed."""
    if not text:
        return "", 0, 0, 0
    lines = text.split("\n")
    _, places = line_hashes(text)
    if not starts:
        return text, len(places), 0, 0
    gone = np.zeros(len(places) + 1, bool)
    for s in starts:
        gone[s : s + window] = True
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    drop = {places[i] for i in np.flatnonzero(gone).tolist()}
    for i in np.flatnonzero(gone[:-1] & gone[1:]).tolist():  # blank lines within a run
        drop.update(range(places[i], places[i + 1]))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(places), int(gone.sum()), runs


def names(columns: Iterable[str]) -> list[str]:
    """What ``remove_runs`` calls what it adds: ``_kept``, ``_lines``, ``_removed`` and ``_runs``, with more underscores where a table has such columns."""
    return free(columns, "_kept", "_lines", "_removed", "_runs")


def remove_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, columns: list[str] | None = None, long: int = LONG) -> DataFrame:
    """``docs`` (or ``columns`` of it) and after them the kept text, the lines, the lines removed and the runs removed, named by ``names``."""
    columns = columns or docs.columns
    key, th = id_order(F.col(id_col).cast("long")), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    own = docs.select(key.alias("k"), th.alias("th"), F.col(text_col).alias("text")).where("text is not null")
    found = repeated_windows(own, window).withColumn("size", F.lit(window)).unionByName(repeated_long(own, window, long))
    k, t, k2, t2, at_ = free(columns, "_key", "_hash", "_key2", "_hash2", "_starts")
    starts = found.groupBy(F.col("k").alias(k2), F.col("th").alias(t2)).agg(F.collect_set(F.struct("s", "size")).alias(at_))
    base = docs.select(*(F.col(f"`{c}`") for c in columns), key.alias(k), th.alias(t))
    joined = base.join(starts, (F.col(k) == F.col(k2)) & (F.col(t) == F.col(t2)), "left").select(*(F.col(f"`{c}`") for c in columns), F.col(at_))
    at, added = columns.index(text_col), names(columns)
    fields = [f for c in columns for f in docs.schema.fields if f.name == c]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType() if i == 0 else T.LongType()) for i, c in enumerate(added))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            got = [strip(x.as_py(), [r["s"] + d for r in s.as_py() or [] for d in range(r["size"])], 1) for x, s in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)]
            new = [pa.array([g[k] for g in got], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *added])

    return joined.mapInArrow(run, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_runs(read_table(spark, sf_dir, "documents"), columns=["doc_id", "text"])
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_runs"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))
