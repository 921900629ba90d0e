"""SimHash near-duplicates by multi-index hashing.

Fingerprints: bit k of a text is 1 if it is set in over half of the XXH64 values (UTF-8, seed 42) of its word
shingles, repeats counted.  Texts with fewer words than a shingle have one shingle, the whole sequence; texts
without words (null, empty, white space) have fingerprint zero and link like any other.

Links: two fingerprints link at ``radius`` or fewer differing bits.  The 64 bits fall into three segments.  With
radius 4 one of the first two segments differs in at most one bit, or the third is equal, so a ball of radius 1
around the first two and of radius 0 around the third finds every link; complete distances are verified.

Only distinct fingerprints are compared, and of a bucket's links only a spanning forest leaves its task, so a
group of n copies or near copies yields at most n - 1 rows per bucket.  The number of buckets follows the number of
fingerprints.  A segment value that more than ``HEAVY`` fingerprints have is dealt further by five bands of the whole
fingerprint, one of which two linked ones share, so no value gathers in one task.  Ties and repeated rows share their
fingerprint and so their component; rows with a null id take part, and a component's id ignores null ids unless
all are null.  An empty table gives an empty result.  Further columns of the input are not read, but carried by
``keep_one``, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import connected_components, cut, free, id_order, local_components, read_table, shuffle_partitions, spread

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Widths of the segments, low bits first.
SEGMENTS = (21, 21, 22)
#: Candidate pairs that a task holds at once.
PAIRS = 1 << 21
#: From this many pairs on, a bucket is split again by five bands, one of which two linked fingerprints share.
DENSE = 1 << 24
#: Fingerprints that a segment value may gather, and probes that a bucket has on average.
HEAVY, PER_BUCKET = 20_000, 200_000
_BANDS = (13, 13, 13, 13, 12)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _text_hash(text_col: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, th, fp long)`` of every row; th is the text's hash, fp the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _probes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (segment and value), fingerprints and kinds (0: the table's row, 1: a probe with one bit cleared).

    Of two segment values that differ in one bit, one has that bit: clearing it gives the other, so set bits alone
    enumerate the ball from one side or the other.
    """
    keys, owners, kinds, shift = [], [], [], 0
    for s, width in enumerate(SEGMENTS):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(s << 32)
        keys.append(value | tag)
        owners.append(fp)
        kinds.append(np.zeros(len(fp), np.uint8))
        if s < 2:
            for bit in range(width):
                has = (value >> np.uint64(bit)) & np.uint64(1) == 1
                keys.append((value[has] ^ np.uint64(1 << bit)) | tag)
                owners.append(fp[has])
                kinds.append(np.ones(int(has.sum()), np.uint8))
        shift += width
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)


def _pairs(key: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) within runs of equal ``key`` where i is the table's row, in blocks; sorted by key, kind."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.repeat(np.concatenate((new[1:], [len(key)])), np.diff(np.concatenate((new, [len(key)]))))
    rest = np.where(kind == 0, end - np.arange(len(key)) - 1, 0)
    todo = np.flatnonzero(rest)
    done = np.concatenate(([0], np.cumsum(rest[todo])))
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        n = rest[todo[at:to]]
        i = np.repeat(todo[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(done[at:to] - done[at], n)
        yield i, j
        at = to


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _join(key: np.ndarray, fp: np.ndarray, kind: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (fingerprint, smallest one joined with it) of the verified links of one task's buckets."""
    order = np.lexsort((kind, key))
    key, fp, kind = key[order], fp[order], kind[order]
    nodes, of = np.unique(fp, return_inverse=True)
    labels = np.arange(len(nodes))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((new, [len(key)])))
    table = np.add.reduceat((kind == 0).astype(np.int64), new)
    dense = table * size > DENSE
    big = np.repeat(dense, size)
    light = np.flatnonzero(~big)
    if len(light):
        for i, j in _pairs(key[light], kind[light]):
            i, j = light[i], light[j]
            hit = _near(fp[i], fp[j], radius)
            labels = local_components(of[i[hit]], of[j[hit]], len(nodes), labels)
    for at, n in zip(new[dense].tolist(), size[dense].tolist(), strict=True):
        own, shift = np.unique(fp[at : at + n]), 0  # linking more of a bucket than its probes ask for is no error
        for width in _BANDS:
            band = (own >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            by = np.argsort(band, kind="stable")
            where = np.searchsorted(nodes, own[by])
            for i, j in _pairs(band[by], np.zeros(n if len(own) == n else len(own), np.uint8)):
                open_ = labels[where[i]] != labels[where[j]]
                i, j = i[open_], j[open_]
                hit = _near(own[by][i], own[by][j], radius)
                labels = local_components(where[i[hit]], where[j[hit]], len(nodes), labels)
            shift += width
    joined = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[joined], nodes[labels[joined]]


def heavy_keys(fps: DataFrame, most: int) -> np.ndarray:
    """Keys of the segment values that more than ``most`` fingerprints have; at most 3 / ``most`` of the fingerprints' number."""
    shift, keys = 0, []
    for s, width in enumerate(SEGMENTS):
        keys.append(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1) + F.lit(s << 32))
        shift += width
    rows = fps.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], np.uint64))


def _banded(key: np.ndarray, owner: np.ndarray, kind: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probes of heavy keys take five keys instead, of the old one and a band of the fingerprint each."""
    big = np.isin(key, heavy)
    if not big.any():
        return key, owner, kind
    out, shift = [(key[~big], owner[~big], kind[~big])], 0
    for band, width in enumerate(_BANDS):
        value = (owner[big] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        mixed = (key[big] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band << 16) + value) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed | np.uint64(1 << 63), owner[big], kind[big]))
        shift += width
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def links(fps: DataFrame, radius: int = RADIUS, most: int = HEAVY) -> DataFrame:
    """``(a long, b long)``: edges that connect distinct fingerprints ``fp`` wherever links within ``radius`` do."""
    if radius > 4:
        raise ValueError("three segments with balls of radius 1, 1 and 0 guarantee a radius of 4 at most")
    heavy = heavy_keys(fps, most)
    n = max(shuffle_partitions(fps.sparkSession) * 4, fps.count() * 24 // PER_BUCKET)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32768):
                fp = batch.column(0).slice(at, 32768).to_numpy(zero_copy_only=False).view(np.uint64)
                key, owner, kind = _banded(*_probes(fp), heavy)
                bucket = spread(key, n)
                order = np.lexsort((key, bucket))
                key, owner, kind, bucket = key[order], owner[order], kind[order], bucket[order]
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                to = np.concatenate((first[1:], [len(bucket)]))
                pay = [key[a:b].astype("<u8").tobytes() + owner[a:b].astype("<u8").tobytes() + kind[a:b].tobytes() for a, b in zip(first.tolist(), to.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(pay, pa.binary())], names=["bucket", "pay"])

    def join(table: pa.Table) -> pa.Table:
        keys, fps_, kinds = [], [], []
        for x in table.column("pay"):
            raw = x.as_buffer()
            m = raw.size // 17
            keys.append(np.frombuffer(raw, "<u8", m))
            fps_.append(np.frombuffer(raw, "<u8", m, m * 8))
            kinds.append(np.frombuffer(raw, np.uint8, m, m * 16))
        a, b = _join(np.concatenate(keys), np.concatenate(fps_), np.concatenate(kinds), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = fps.select("fp").mapInArrow(probe, "bucket int, pay binary")
    if n > 4 * shuffle_partitions(fps.sparkSession):  # more buckets than the session's partitions can hold
        dealt = dealt.repartition(n // 4, "bucket")
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long")


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, low, root)``: each fingerprint of ``marked``, its smallest id and the smallest fingerprint of its component."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"), "fingerprints")
    found = groups(marked, radius)
    low = found.groupBy("root").agg(F.min("low").alias("component_id"))
    named = found.select("fp", "root").join(low, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (null ids last), then the smallest text hash."""
    marked = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one"))
    keep = groups(marked).join(least, "fp").groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.none").alias("_n"), id_order("one.doc_id").alias("_k"), F.col("one.th").alias("_t"))
    none, key, hash_ = free([*docs.columns, "_n", "_k", "_t"], "_none", "_key", "_hash")
    n, k, t = free(docs.columns, "_n", "_k", "_t")
    keep = keep.toDF(n, k, t)
    keyed = docs.withColumns({none: F.col(id_col).cast("long").isNull(), key: id_order(F.col(id_col).cast("long")), hash_: _text_hash(text_col)})
    own = keyed.join(keep, (F.col(none) == F.col(n)) & (F.col(key) == F.col(k)) & (F.col(hash_) == F.col(t)), "left_semi")
    return own.dropDuplicates([none, key, hash_]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


