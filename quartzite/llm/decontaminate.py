"""Benchmark decontamination by SimHash windows.

Words are white-space tokens, lower-cased, without leading or trailing characters other than letters and digits;
what is left empty is no word.  For a benchmark item of n words, every window of n words of a text (the whole text
if it is shorter) is compared by weighted Jaccard similarity of 5-word shingles, the weight of a shingle being how
often it occurs; items under five words are one shingle.  A text is contaminated by an item if a window reaches
``SIMILARITY``.

Search: each window of an item's size gets a 64-bit SimHash of its words, and a multi-index over the items of that size
finds all within ``RADIUS`` bits: eight blocks of eight bits, each with a table from a block's value to the items whose
block lies in the ball around it (radius 2 in the first five, 1 in the last three).  The tables' lists are merged and
complete distances checked; exact similarity then decides.  Windows that cannot reach the similarity with any item of
their size, as they hold too few of the benchmark's shingles (whichever items'), are passed over before that.

Items are taken in blocks of ``ITEMS`` items and ``BYTES`` bytes of text at most, which bounds what the driver holds and
what travels with a task; every block is held against all texts.

Null and empty texts, and items without words, match nothing.  Repeated items count once; equal texts under
different item ids each match.  Repeated rows of a text give repeated rows of the result.  Of equally similar
windows the first is reported.  Empty tables give an empty result.  Ids may be null; further columns are not read, but
carried by ``clean``, and may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import read_table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
ITEMS, BYTES = 10_000, 16 << 20
BLOCKS, WIDTH = 8, 8
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CACHE = 1 << 19
#: Windows looked up at once, and bytes of texts cut into words at once.
STARTS, RUN = 4096, 4 << 20


def word(token: str) -> str:
    return _EDGE.sub("", token.lower())


def words(text: str | None) -> list[str]:
    return [w for w in map(word, re.split(r"[\x20\x09-\x0D]+", text or "")) if w]


def _feature(ids: np.ndarray) -> np.ndarray:
    """64 mixed bits of each word id."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_simhash(ids: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each window of n words: a running sum of signs over the 64 bits."""
    bits = np.unpackbits(_feature(ids).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits(total[n:] - total[:-n] > 0, axis=1, bitorder="little").view("<u8").ravel()


def _shingles(ids: np.ndarray) -> np.ndarray:
    """One code per run of SHINGLE ids, or for the whole sequence if it is shorter."""
    k = min(SHINGLE, len(ids))
    code, x = np.zeros(len(ids) - k + 1, np.uint64), _feature(ids)
    for j in range(k):
        code = code * np.uint64(0x9FB21C651E98DF25) + x[j : j + len(code)]
    return code


class Index:
    """Benchmark items by size, with the blocks' tables and the shingles that lead to them."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids: dict[str, int] = {}
        self.items = []
        for key, text in items:
            own = words(text)
            if own:
                self.items.append((key, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own], np.int64)))
        counts = [Counter(_shingles(ids).tolist()) for _, ids in self.items]
        self.codes = np.array(sorted({c for own in counts for c in own}), np.uint64)
        place = {c: k for k, c in enumerate(self.codes.tolist())}
        self.counts = [{place[c]: n for c, n in own.items()} for own in counts]
        self.totals = [sum(own.values()) for own in counts]
        self.words = pa.array(list(self.ids), pa.string())
        self.features = _feature(np.arange(len(self.ids) + 1))
        self.short = any(len(ids) < SHINGLE for _, ids in self.items)
        self.fp = np.array([window_simhash(ids, len(ids))[0] for _, ids in self.items], np.uint64)
        self.sizes, self.size_of = np.unique([len(ids) for _, ids in self.items], return_inverse=True)
        self.tables = self._tables()

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block: where the items of each size and value begin, and the items in order of the size and the values
        whose ball holds them."""
        out, extra = [], RADIUS - BLOCKS * (RADIUS // BLOCKS)
        for b in range(BLOCKS):
            own = (self.fp >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)
            flips = [sum(1 << x for x in flip) for r in range(RADIUS // BLOCKS + (b <= extra)) for flip in combinations(range(WIDTH), r)]
            values = ((own[:, None] ^ np.array(flips, np.uint64)).astype(np.int64) + (self.size_of[:, None] << WIDTH)).ravel()
            order = np.argsort(values, kind="stable")
            out.append((np.searchsorted(values[order], np.arange((len(self.sizes) << WIDTH) + 1)), np.repeat(np.arange(len(self.fp)), len(flips))[order]))
        return out

    def candidates(self, size: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of a window's size, given by its place, within RADIUS bits of its fingerprint."""
        found = []
        for b, (begin, items) in enumerate(self.tables):
            value = ((fp >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) + (size << WIDTH)
            many = begin[value + 1] - begin[value]
            w = np.repeat(np.arange(len(fp)), many)
            item = items[np.arange(len(w)) + np.repeat(begin[value] - (np.cumsum(many) - many), many)]
            near = np.bitwise_count(fp[w] ^ self.fp[item]) <= RADIUS
            found.append(w[near] * len(self.fp) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(self.fp), both % len(self.fp)

    def similarity(self, item: int, spots: np.ndarray) -> float:
        """With a window, given by the places of its shingles in ``codes``, -1 for others."""
        a, b = self.counts[item], Counter(spots.tolist())
        both = sum(min(n, a[c]) for c, n in b.items() if c in a)
        return both / (self.totals[item] + len(spots) - both)

    def spots(self, ids: np.ndarray, k: int, ends: np.ndarray | None = None) -> np.ndarray:
        """Of each word the place in ``codes`` of the k words that begin there, or -1; ``ends`` are those of the words'
        texts."""
        out = np.full(max(0, len(ids) - k + 1), -1, np.int64)
        total = np.cumsum(np.concatenate(([0], ids > 0)))
        at = np.flatnonzero(total[k:] - total[:-k] == k) if len(out) else np.zeros(0, np.int64)
        if ends is not None:
            at = at[at + k <= ends[np.searchsorted(ends, at, "right")]]
        code = np.zeros(len(at), np.uint64)
        for j in range(k):
            code = code * np.uint64(0x9FB21C651E98DF25) + self.features[ids[at + j]]
        spot = np.searchsorted(self.codes, code)
        found = spot < len(self.codes)
        found[found] = self.codes[spot[found]] == code[found]
        out[at[found]] = spot[found]
        return out


class Words:
    """Words of a run of texts.  ``ids``: positive for words of the benchmark, negative for others (-1 - the token's place);
    those of no word are left out.  ``at``: which token of its text each is.  ``begin``: where the texts begin in both."""

    def __init__(self, index: Index, texts: pa.Array, cache: dict[str, int]):
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        begin, tokens = split.offsets.to_numpy().astype(np.int64), split.values
        begin, tokens = begin - begin[0], tokens.slice(begin[0], begin[-1] - begin[0])
        coded = tokens.dictionary_encode()
        self.tokens = coded.dictionary
        kind = self._kinds(index, cache)
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        some = pc.binary_length(self.tokens).to_numpy(zero_copy_only=False) > 0
        raw = np.concatenate(([0], np.cumsum(some[place])))
        ids = np.where(kind[place] < 0, -1 - place, kind[place])
        held = np.flatnonzero(ids)
        self.ids, self.begin = ids[held], np.searchsorted(held, begin)
        self.at = raw[held] - np.repeat(raw[begin[:-1]], np.diff(self.begin))
        self.hashes = np.zeros(len(kind), np.int64)

    def _kinds(self, index: Index, cache: dict[str, int]) -> np.ndarray:
        """Of each token the id of its word, -1 if the benchmark does not have it, 0 for no word."""
        plain = pc.ascii_is_alnum(self.tokens)
        own = pc.ascii_lower(self.tokens.filter(plain))
        out = np.empty(len(self.tokens), np.int64)
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        out[plain] = pc.add(pc.index_in(own, value_set=index.words.cast(own.type)), 1).fill_null(-1).to_numpy(zero_copy_only=False)
        others = self.tokens.filter(pa.array(~plain)).to_pylist()
        if len(cache) >= _CACHE:
            cache.clear()
        for t in others:
            if t not in cache:
                w = word(t)
                cache[t] = index.ids.get(w, -1) if w else 0
        out[~plain] = [cache[t] for t in others]
        return out

    def hashed(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` with a negative hash for each word that the benchmark does not have."""
        out, other = ids.copy(), np.flatnonzero(ids < 0)
        place = -1 - ids[other]
        new = np.unique(place[self.hashes[place] == 0])
        self.hashes[new] = [-1 - (xxhash.xxh64_intdigest(word(t)) >> 2) for t in self.tokens.take(pa.array(new)).to_pylist()]
        out[other] = self.hashes[place]
        return out


def _matches(index: Index, words: Words, row: int, spots: dict[int, np.ndarray]) -> list[tuple[int, float, int]]:
    """``matches`` of one text; ``spots`` by the length of a shingle."""
    low, high = words.begin[row : row + 2].tolist()
    raw, n_words = words.ids[low:high], high - low
    held = np.zeros(n_words + 1, np.int64)  # benchmark shingles that begin before a word
    for own in spots.values():
        held[1 : len(own) + 1] += own >= 0
    held = np.cumsum(held)
    windows = []  # (place of the size, first words)
    for k, n in enumerate(index.sizes.tolist()):
        size = min(n, n_words)
        # Of an item's a shingles and the window's b, both >= s (a + b) / (1 + s) must agree.
        need = SIMILARITY / (1 + SIMILARITY) * (max(1, n - SHINGLE + 1) + max(1, size - SHINGLE + 1)) - 1e-9
        if held[-1] >= need:
            at = np.flatnonzero(held[size:] - held[: n_words - size + 1] >= need)
            if len(at):
                windows.append((k, size, at))
    if not windows:
        return []
    cover = np.zeros(n_words + 1, np.int64)
    for _, size, at in windows:
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    ids = raw.copy()
    ids[used] = words.hashed(raw[used])
    best: dict[int, tuple[float, int]] = {}
    batch: list[tuple[int, int, np.ndarray]] = []

    def look() -> None:
        fp = np.concatenate([window_simhash(ids[run[0] : run[-1] + size], size)[run - run[0]] for _, size, at in batch for run in np.split(at, np.flatnonzero(np.diff(at) > size) + 1)])
        place = np.repeat([k for k, _, _ in batch], [len(at) for _, _, at in batch])
        first = np.concatenate([at for _, _, at in batch])
        for w, item in zip(*(x.tolist() for x in index.candidates(place, fp)), strict=True):
            start, size = int(first[w]), min(int(index.sizes[place[w]]), n_words)
            k = min(SHINGLE, size)
            got = index.similarity(item, spots[k][start : start + size - k + 1])
            if got >= SIMILARITY and got > best.get(item, (0.0, 0))[0]:
                best[item] = (got, int(words.at[low + start]))
        batch.clear()

    for k, size, at in windows:
        for begin in range(0, len(at), STARTS):
            batch.append((k, size, at[begin : begin + STARTS]))
            if sum(len(x) for _, _, x in batch) >= STARTS:
                look()
    if batch:
        look()
    return sorted((item, *b) for item, b in best.items())


def matches(index: Index, texts: pa.Array, cache: dict[str, int]) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
    """(row, its matches) of rows that have some; a match: (item, best similarity, first token of the best window).

    Texts are cut into words some ``RUN`` bytes at a time."""
    if not index.items:
        return
    run = np.concatenate(([0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[:-1]))) // RUN if len(texts) else np.zeros(0, np.int64)
    bounds = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(texts)]
    for first, last in zip(bounds, bounds[1:]):
        words = Words(index, texts.slice(first, last - first), cache)
        lengths = np.diff(words.begin)
        whole = index.spots(words.ids, SHINGLE, words.begin[1:])
        whole = np.concatenate((whole, np.full(len(words.ids) - len(whole), -1, np.int64)))
        many = np.concatenate(([0], np.cumsum(whole >= 0)))
        some = many[words.begin[1:]] > many[words.begin[:-1]]
        for row in np.flatnonzero((some | index.short | (lengths < SHINGLE)) & (lengths > 0)).tolist():
            low, high = words.begin[row : row + 2].tolist()
            ids, longest = words.ids[low:high], min(SHINGLE, high - low)
            spots = {SHINGLE: whole[low : high - SHINGLE + 1]} if longest == SHINGLE else {}
            for k in range(1, SHINGLE) if index.short else {longest} - {SHINGLE}:
                if k <= longest:
                    spots[k] = index.spots(ids, k)
            if got := _matches(index, words, row, spots):
                yield first + row, got


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-size // BYTES))
    for k in range(parts):
        part = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # about ITEMS rows, BYTES bytes


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, word_start)``: the items that each row's text holds."""
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterable[pa.RecordBatch]:
            index = Index(items)
            cache: dict[str, int] = {}
            for batch in batches:
                rows = [(batch.column(0)[row].as_py(), index.items[item][0], s, at) for row, got in matches(index, batch.column(1), cache) for item, s, at in got]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "word_start"])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, item_id long, similarity double, word_start long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterable[pa.RecordBatch]:
            index = Index(items)
            cache: dict[str, int] = {}
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in matches(index, batch.column(at), cache)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
