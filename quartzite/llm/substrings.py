"""Exact-substring dedup by prefix-free parsing.

A byte goes if some ``LENGTH``-byte string covers it that also starts earlier: in a document with a smaller id, or
earlier in the same one.  Strings never cross documents and are judged on the input.

Parsing: a rolling hash runs over every ``GRAM`` bytes; of the grams in a string of LENGTH bytes the one with the
least hash, the last of equals, is its trigger.  Strings in a row with one trigger form a phrase: from the first one's
start to the last one's end, so phrases overlap by LENGTH - 1 bytes and each string of LENGTH bytes lies in exactly
one phrase, chosen by its own bytes alone.  Equal strings hence have equal triggers at equal places.

Dictionary: equal phrases (two 64-bit hashes) are one entry, placed at its earliest occurrence; all others go whole.
A trigger with a single phrase has no string that another phrase has too.  Where a trigger has several phrases, short
hashes of the bytes next to it bound how far two of them can agree; those parts of the phrases are the dictionary
whose suffixes are compared.

Suffix arrays: phrases are dealt by trigger, so equal strings meet.  Each bucket concatenates its phrases and orders
their suffixes of LENGTH bytes by prefix doubling: ranks of 8 bytes, then of 16, 32 and 64, then of LENGTH.  The parse,
the phrases' occurrences in corpus order, orders suffixes of equal rank; both together are the corpus order of equal
strings, of which all but the first go.  As phrases overlap, no string runs over the end of one and the parse's order
beyond that is not needed.

Parts of the parse are combined before they move: of a phrase that a task meets often, only the earliest travels, so the
rows of a hot phrase are bounded by the number of tasks' blocks.  A trigger that meets over ``HOT`` phrases within a
block is dealt by phrase, with a marker for the others; its strings, and those of a trigger with over ``MANY`` phrases
in all, are dealt one by one and ordered by 128-bit fingerprints instead of by their bytes, so no trigger gathers in
one task either.  The number of buckets follows the size of the input.

Null texts count as empty.  Null ids count as the smallest.  Rows that share an id compare by their starts alone:
of equal starts neither is earlier, so repeated rows get equal answers.  An empty table gives an empty result.
Further columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import cut, id_order, input_bytes, read_table, shuffle_partitions, spread, squeezed, unsqueezed

LENGTH = 100
GRAM = 32
HOT, MANY = 256, 1024
#: Bytes parsed at once, and bytes of a longer document that one piece holds.
BLOCK, PIECE = 1 << 18, 1 << 20
#: Triggers, or suffixes, that a task combines before it passes them on.
COMBINE = 1 << 20
#: Bytes of dictionary whose suffixes are ordered at once, and that a task gathers before it passes them on.
ORDERED, GATHERED = 1 << 20, 1 << 23
#: Bytes of input for each bucket, and buckets of a partition.
BUCKET, BUCKETS = 2 << 20, 4
_REACH = LENGTH - GRAM + 1
#: Bytes next to a trigger that short hashes cover.
LEVELS = (16, 32, 48)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MARK, _FLAG = 255, 128


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def _rolling(raw: np.ndarray) -> list[np.ndarray]:
    """Hashes of every 16, 32 and 64 bytes, by doubling."""
    h, base, out = _TABLE[raw], _BASE, []
    for width in (1, 2, 4, 8, 16, 32):
        h = h[:-width] * base + h[width:]
        base = np.uint64(int(base) * int(base) % 2**64)
        out = [*out[-2:], h]
    return out


def _least(rank: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        rank = np.minimum(rank[:-have], rank[have:])
        have *= 2
    return np.minimum(rank[: len(rank) - (width - have)], rank[width - have :]) if have < width else rank


def parse(raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each phrase's trigger hash, phrase hash, first start, number of further starts, distance from the first start to
    the trigger, and short hashes of 16, 32 and 48 bytes before and after the trigger (0 where the phrase has fewer).

    Bytes of equal owner belong together."""
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros((0, 6), np.uint8))
    if len(raw) < LENGTH:
        return empty
    h16, h32, h64 = _rolling(raw)
    rank = _mix(h32) & ~np.uint64(0xFFFFFF) | (np.uint64(0xFFFFFF) - np.arange(len(h32), dtype=np.uint64))
    trigger = np.uint64(0xFFFFFF) - (_least(rank, _REACH) & np.uint64(0xFFFFFF))
    start = np.flatnonzero(owner[: len(trigger)] == owner[LENGTH - 1 :])
    if not len(start):
        return empty
    trigger = trigger[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1))))
    a, b, t = start[new], start[np.concatenate((new[1:], [len(start)])) - 1], trigger[new]
    end = b + LENGTH - 64
    ph = _mix(h64[a] * _MIX[0] + h64[np.minimum(a + 52, end)] * _MIX[3] + h64[end] * _MIX[4] + ((b - a) * 1024 + (t - a)).astype(np.uint64) * _MIX[1])
    before, after, sides = t - a, b + LENGTH - t - GRAM, []
    for room, first, second, at in (
        (before, h16, None, t - 16), (before, h32, None, t - 32), (before, h32, h16, t - 48),
        (after, h16, None, t + GRAM), (after, h32, None, t + GRAM), (after, h32, h16, t + GRAM),
    ):
        x = first[np.clip(at, 0, len(first) - 1)]
        if second is not None:
            x = x + second[np.clip(at + 32, 0, len(second) - 1)] * _MIX[4]
        sides.append(np.where(room >= LEVELS[len(sides) % 3], (_mix(x) >> np.uint64(56)) | np.uint64(1), np.uint64(0)).astype(np.uint8))
    return _mix(h32[t] + _MIX[3]), ph, a, (b - a).astype(np.uint8), before.astype(np.uint8), np.stack(sides, axis=1)


def suffix_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of the LENGTH bytes from each place, as two columns."""
    h64 = _rolling(raw)[2]
    return np.stack([_mix(h64[at] * _MIX[0] + h64[at + LENGTH - 64]), _mix(h64[at] + h64[at + LENGTH - 64] * _MIX[4])], axis=1)


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def suffix_ranks(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes from each place among all of them in lexicographic order; equal strings have equal ranks.

    By prefix doubling over all places of ``raw``.  The suffix array is the places in order of their ranks."""
    rank = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | raw[k : len(raw) - 7 + k]
    rank, width = _dense(rank), 8
    while width * 2 <= LENGTH:
        rank, width = _dense(rank[:-width] * np.uint64(len(raw)) + rank[width:]), width * 2
    return _dense(rank[at] * np.uint64(len(raw)) + rank[at + LENGTH - width])


class _Blocks:
    """Gathers documents and hands out blocks of bytes with the piece that each byte belongs to."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.pieces: list[tuple[int, int]] = []
        self.size = 0

    def add(self, doc: int, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        data = np.frombuffer(raw, np.uint8)
        for base in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
            part = data[base : base + PIECE + LENGTH - 1]
            self.parts.append(part)
            self.pieces.append((doc, base))
            self.size += len(part)
            if self.size >= BLOCK:
                yield from self.take()

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, piece of each byte, document of each piece, and what to add to places for those in the document."""
        if self.parts:
            sizes = np.array([len(p) for p in self.parts])
            began = np.cumsum(sizes) - sizes
            docs, bases = (np.array(x, np.int64) for x in zip(*self.pieces, strict=True))
            raw, owner = np.concatenate(self.parts), np.repeat(np.arange(len(sizes)), sizes)
            self.clear()
            yield raw, owner, docs, bases - began


def _intervals(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each document the union of its spans [a, b), as a flat array of starts and ends."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        if len(part):
            yield int(doc[part[0]]), merge(a[part], b[part])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of spans sorted by start; spans that touch become one."""
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
    return np.stack([a[new], reach[np.concatenate((new[1:], [len(a)])) - 1]], axis=1).ravel()


_OUT = "bucket int, kind int, k long, th long, pay binary"
_NAMES = ["bucket", "kind", "k", "th", "pay"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_NAMES)


def _earliest(keys: list[np.ndarray], k: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, id and start; the number of each row's class in that order; which rows are not the earliest."""
    order = np.lexsort((a, k, *reversed(keys)))
    new = np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    k, a = k[order], a[order]
    return order, group, (k != k[first]) | (a != a[first])


class _Docs:
    """Ids of the documents that a combined part refers to by number."""

    def __init__(self):
        self.k: list[int] = []
        self.th: list[int] = []

    def add(self, k: int, th: int) -> int:
        self.k.append(k)
        self.th.append(th)
        return len(self.k) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.k, np.int64), np.array(self.th, np.int64)


def _pack(types: tuple[str, ...], *cols: np.ndarray) -> bytes:
    return np.uint32(len(cols[0])).tobytes() + b"".join(np.ascontiguousarray(c.astype(np.dtype(t).base)).tobytes() for c, t in zip(cols, types, strict=True))


def _unpack(raw, types: tuple[str, ...], at: int = 0) -> tuple[list[np.ndarray], int]:
    n, out = int(np.frombuffer(raw, "<u4", 1, at)[0]), []
    at += 4
    for t in types:
        kind = np.dtype(t)
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out, at


def _pack_rows(types: tuple[str, ...], doc: np.ndarray, k: np.ndarray, th: np.ndarray, *cols: np.ndarray) -> bytes:
    """A table of the documents that the rows are from, then the rows with the documents' numbers in it."""
    docs, number = np.unique(doc, return_inverse=True)
    return _pack(_DOC, k[docs], th[docs]) + _pack(("<u4", *types), number, *cols)


def _unpack_rows(pays: pa.ChunkedArray, types: tuple[str, ...]) -> list[np.ndarray]:
    """Ids, text hashes and columns of all payloads' rows."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (*_DOC, *types)]
    for x in pays:
        raw = x.as_buffer()
        (k, th), at = _unpack(raw, _DOC)
        (number, *cols), _ = _unpack(raw, ("<u4", *types), at)
        for part, c in zip(parts, (k[number], th[number], *cols), strict=True):
            part.append(c)
    return [np.concatenate(p) for p in parts]


_DOC = ("<i8", "<i8")
_TRIGGER = ("<u8", "<u8", "<u4", "u1", "u1", "(6,)u1")
_SUFFIX = ("<u8", "<u8", "<u4")
_PHRASE = ("<u4", "u1", "u1")
_PART = ("<u8", "<u4", "u1")
_ALONE = 255


def _spans_out(doc: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, th: np.ndarray, n: int) -> Iterator[tuple]:
    to = spread(k.view(np.uint64), n)
    for d, flat in _intervals(doc, a, b):
        yield int(to[d]), 1, int(k[d]), int(th[d]), flat.astype("<u4").tobytes()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _combine_triggers(kh, ph, doc, a, more, before, sides, docs: _Docs, n: int) -> pa.RecordBatch:
    k, th = docs.arrays()
    order, _, later = _earliest([kh, ph], k[doc], a)
    kh, ph, doc, a, more, before, sides = (x[order] for x in (kh, ph, doc, a, more, before, sides))
    rows = list(_spans_out(doc[later], a[later], a[later] + more[later] + LENGTH, k, th, n))
    kh, ph, doc, a, more, before, sides = (x[~later] for x in (kh, ph, doc, a, more, before, sides))
    runs = np.flatnonzero(np.concatenate(([True], kh[1:] != kh[:-1])))
    size = np.diff(np.concatenate((runs, [len(kh)])))
    hot = np.repeat(size > HOT, size)
    bucket = spread(np.where(hot, kh ^ ph, kh), n)
    more = np.where(hot, more | _FLAG, more)
    marks = runs[size > HOT]
    own = np.concatenate((np.arange(len(kh)), marks))
    more = np.concatenate((more, np.full(len(marks), _MARK)))
    bucket = np.concatenate((bucket, spread(kh[marks], n)))
    for to, at in _by_bucket(bucket):
        x = own[at]
        rows.append((to, 0, 0, 0, _pack_rows(_TRIGGER, doc[x], k, th, kh[x], ph[x], a[x], more[at], before[x], sides[x])))
    return _rows(rows)


def _find_triggers(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        blocks, docs, found, size = _Blocks(), _Docs(), [], 0

        def parsed(block) -> int:
            raw, owner, doc, shift = block
            kh, ph, a, more, before, sides = parse(raw, owner)
            piece = owner[a]
            found.append((kh, ph, doc[piece], a + shift[piece], more.astype(np.int64), before, sides))
            return len(kh)

        for batch in batches:
            for k, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = x.as_buffer()
                if raw is None or raw.size < LENGTH:
                    continue
                for block in blocks.add(docs.add(k, th), raw):
                    size += parsed(block)
                if size >= COMBINE and not blocks.parts:
                    yield _combine_triggers(*(np.concatenate(c) for c in zip(*found, strict=True)), docs, n)
                    docs, found, size = _Docs(), [], 0
        for block in blocks.take():
            parsed(block)
        if found:
            yield _combine_triggers(*(np.concatenate(c) for c in zip(*found, strict=True)), docs, n)

    return run


def _emit(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _shared(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether another row of the same run has the value; 0 is no value."""
    order = np.lexsort((value, run))
    r, v = run[order], value[order]
    same = np.concatenate(([False], (r[1:] == r[:-1]) & (v[1:] == v[:-1]) & (v[1:] > 0), [False]))
    out = np.zeros(len(run), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _reach(run: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most bytes that each phrase can have in common, before and after the trigger, with another of its run."""
    out = []
    for side in (0, 3):
        most = np.full(len(run), LEVELS[0] - 1)
        for j, upto in enumerate((*(x - 1 for x in LEVELS[1:]), LENGTH - GRAM)):
            most = np.where((most >= LEVELS[j] - 1) & _shared(run, sides[:, side + j]), upto, most)
        out.append(most)
    return out[0], out[1]


def _settle_triggers(table: pa.Table) -> pa.Table:
    """Kind 1: spans that go.  Kind 2: parts of dictionary phrases that others with their trigger may share, and where the
    trigger lies in them."""
    kind = table.column("kind").to_numpy()
    rows = [(0, 1, *r) for r in zip(*(table.filter(pa.array(kind == 1)).column(c).to_pylist() for c in ("k", "th", "pay")), strict=True)]
    k, th, kh, ph, a, more, before, sides = _unpack_rows(table.filter(pa.array(kind == 0)).column("pay"), _TRIGGER)
    if len(kh):
        a = a.astype(np.int64)
        order, group, later = _earliest([kh, ph], k, a)
        kh, ph, k, th, a, more, before, sides = (x[order] for x in (kh, ph, k, th, a, more, before, sides))
        mark, flag = more == _MARK, more >= _FLAG
        run = np.cumsum(np.concatenate(([True], kh[1:] != kh[:-1]))) - 1
        phrases = np.bincount(run, np.concatenate(([True], group[1:] != group[:-1])))
        marked = np.bincount(run, mark) > 0
        length = (more & (_FLAG - 1)).astype(np.int64)
        gone = np.flatnonzero(later & ~mark)
        every = flag | marked[run]  # phrases of a trigger that was dealt by phrase: all their strings
        ask = np.flatnonzero(((phrases[run] > 1) | every) & ~mark & ~later)
        left, right = _reach(run[ask], sides[ask])
        left, right = (np.where(every[ask], LENGTH - GRAM, x) for x in (left, right))
        t = a[ask] + before[ask]
        low, high = np.maximum(a[ask], t - left), np.minimum(a[ask] + length[ask], t - (LENGTH - GRAM - right))
        some = low <= high
        trigger = np.where(every[ask] | (phrases[run[ask]] > MANY), _ALONE, t - low)
        asked = (ask[some], low[some], high[some] - low[some], trigger[some])
        for kind_, (own, at, size, place) in ((1, (gone, a[gone], length[gone], length[gone])), (2, asked)):
            by = np.lexsort((at, th[own], k[own]))
            own, at, size, place = own[by], at[by], size[by], place[by]
            for part in np.split(np.arange(len(own)), np.flatnonzero((np.diff(k[own]) != 0) | (np.diff(th[own]) != 0)) + 1):
                if len(part):
                    pay = merge(at[part], at[part] + size[part] + LENGTH).astype("<u4").tobytes() if kind_ == 1 else _pack(_PHRASE, at[part], size[part], place[part])
                    rows.append((0, kind_, int(k[own[part[0]]]), int(th[own[part[0]]]), pay))
    return _emit(rows)


def _combine_suffixes(key, doc, s, docs: _Docs, n: int) -> pa.RecordBatch:
    k, th = docs.arrays()
    order, _, later = _earliest([key[:, 0], key[:, 1]], k[doc], s)
    key, doc, s = key[order], doc[order], s[order]
    rows = list(_spans_out(doc[later], s[later], s[later] + LENGTH, k, th, n))
    key, doc, s = key[~later], doc[~later], s[~later]
    for to, own in _by_bucket(spread(key[:, 0], n)):
        rows.append((to, 0, 0, 0, _pack_rows(_SUFFIX, doc[own], k, th, key[own, 0], key[own, 1], s[own])))
    return _rows(rows)


def _deal_phrases(parts: list[tuple[int, int, int, int, bytes]], docs: _Docs, n: int) -> pa.RecordBatch:
    """Phrases (trigger's hash, document, start, further strings, bytes) by bucket."""
    k, th = docs.arrays()
    key, doc, at, size = (np.array([p[i] for p in parts], t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64)))
    rows = []
    for to, own in _by_bucket(spread(key, n)):
        rows.append((to, 2, 0, 0, _pack_rows(_PART, doc[own], k, th, key[own], at[own], size[own]) + b"".join([parts[i][4] for i in own.tolist()])))
    return _rows(rows)


def _find_phrases(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        docs, found, size, parts, gathered = _Docs(), [], 0, [], 0
        tool = zstandard.ZstdDecompressor()

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                yield _combine_suffixes(*(np.concatenate(c) for c in zip(*found, strict=True)), docs, n)
            if parts:
                yield _deal_phrases(parts, docs, n)

        for batch in batches:
            for k, th, x, pays in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                text = unsqueezed(x, tool)
                raw = np.frombuffer(text, np.uint8)
                a, more, place = (np.concatenate(c) for c in zip(*(_unpack(p.as_buffer(), _PHRASE)[0] for p in pays.values), strict=True))
                doc, alone = docs.add(k, th), place == _ALONE
                for at, m, t in zip(a[~alone].tolist(), more[~alone].tolist(), place[~alone].tolist(), strict=True):
                    parts.append((xxhash.xxh3_64_intdigest(text[at + t : at + t + GRAM]), doc, at, m, text[at : at + m + LENGTH]))
                    gathered += m + LENGTH
                span = more[alone].astype(np.int64) + 1
                starts = np.unique(np.repeat(a[alone].astype(np.int64), span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span))
                for run_ in np.split(starts, np.flatnonzero(np.diff(starts) > LENGTH) + 1) if len(starts) else ():
                    for at in range(0, len(run_), PIECE):
                        part = run_[at : at + PIECE]
                        found.append((suffix_keys(raw[part[0] : part[-1] + LENGTH], part - part[0]), np.full(len(part), doc), part))
                        size += len(part)
                if size >= COMBINE or gathered >= GATHERED:
                    yield from out()
                    docs, found, size, parts, gathered = _Docs(), [], 0, [], 0
        yield from out()

    return run


def _ordered(pays: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, text hashes, starts) of the strings of a bucket's phrases that occur earlier, by suffix arrays.

    Phrases are taken in order of their trigger, as many at once as ORDERED bytes hold."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    blobs = []
    for x in pays:
        raw = x.as_buffer()
        (k, th), at = _unpack(raw, _DOC)
        (number, key, start, size), at = _unpack(raw, ("<u4", *_PART), at)
        length = size.astype(np.int64) + LENGTH
        for part, c in zip(parts, (k[number], th[number], key, start.astype(np.int64), length, np.cumsum(length) - length + sum(map(len, blobs))), strict=True):
            part.append(c)
        blobs.append(np.frombuffer(raw, np.uint8, int(length.sum()), at))
    if not blobs:
        return
    k, th, key, start, length, at = (np.concatenate(p) for p in parts)
    dictionary = np.concatenate(blobs)
    order = np.argsort(key, kind="stable")
    k, th, key, start, length, at = (x[order] for x in (k, th, key, start, length, at))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of its trigger
    chunk = (np.cumsum(length) - length)[first] // ORDERED
    for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(chunk)) + 1):
        if len(own) < 2:
            continue
        size = length[own]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text = dictionary[np.repeat(at[own], size) + inner]
        places = np.flatnonzero(inner <= np.repeat(size, size) - LENGTH)
        of = np.repeat(own, size)[places]
        rank, s = suffix_ranks(text, places), start[of] + inner[places]
        order, _, later = _earliest([rank], k[of], s)
        gone = order[later]
        yield k[of[gone]], th[of[gone]], s[gone]


def _settle_phrases(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    rows = [(0, 1, *r) for r in zip(*(table.filter(pa.array(kind == 1)).column(c).to_pylist() for c in ("k", "th", "pay")), strict=True)]
    found = list(_ordered(table.filter(pa.array(kind == 2)).column("pay")))
    k, th, hi, lo, s = _unpack_rows(table.filter(pa.array(kind == 0)).column("pay"), _SUFFIX)
    if len(hi):
        s = s.astype(np.int64)
        order, _, later = _earliest([hi, lo], k, s)
        found.append(tuple(x[order][later] for x in (k, th, s)))
    if found:
        k, th, s = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((s, th, k))
        for part in np.split(by, np.flatnonzero((np.diff(k[by]) != 0) | (np.diff(th[by]) != 0)) + 1):
            if len(part):
                rows.append((0, 1, int(k[part[0]]), int(th[part[0]]), merge(s[part], s[part] + LENGTH).astype("<u4").tobytes()))
    return _emit(rows)


def spans(docs: DataFrame) -> DataFrame:
    """``(k, th, pays)``: for each document of ``docs (k, th, text binary)`` arrays of starts and ends that go."""
    parts = max(shuffle_partitions(docs.sparkSession), input_bytes(docs, "text") // (BUCKET * BUCKETS))
    n = parts * BUCKETS
    by_bucket = lambda df: df.repartition(parts, "bucket").groupBy("bucket")
    first = cut(by_bucket(docs.mapInArrow(_find_triggers(n), _OUT)).applyInArrow(_settle_triggers, _OUT).where("kind > 0"), "phrases")
    ask = first.where("kind = 2").groupBy(F.col("k").alias("k2"), F.col("th").alias("th2")).agg(F.collect_list("pay").alias("pays"))
    held = squeezed(docs.select("k", "th", "text"), "text").join(ask, (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2"))).select("k", "th", "text", "pays")
    second = by_bucket(held.mapInArrow(_find_phrases(n), _OUT)).applyInArrow(_settle_phrases, _OUT)
    return first.where("kind = 1").select("k", "th", "pay").unionByName(second.select("k", "th", "pay")).groupBy("k", "th").agg(F.collect_list("pay").alias("pays"))


def keep(raw: bytes, pays: list[bytes] | None) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went and in how many runs."""
    if not pays:
        return raw, 0, 0
    flat = np.concatenate([np.frombuffer(p, "<u4") for p in pays]).astype(np.int64).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    out = merge(flat[:, 0], flat[:, 1]).reshape(-1, 2)
    edges = np.concatenate(([0], out.ravel(), [len(raw)]))
    left = b"".join(raw[a:b] for a, b in edges.reshape(-1, 2).tolist())
    return left, int((out[:, 1] - out[:, 0]).sum()), len(out)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    own = own.select("doc_id", id_order("doc_id").alias("k"), F.xxhash64("text").alias("th"), "text")
    gone = spans(own.select("k", "th", "text")).select(F.col("k").alias("k2"), F.col("th").alias("th2"), "pays")
    joined = squeezed(own, "text").join(gone, (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2")), "left").select("doc_id", "text", "pays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            got = [(raw := unsqueezed(x, tool), keep(raw, p.as_py())) for x, p in zip(batch.column(1), batch.column(2), strict=True)]
            cols = [pa.array([len(r) for r, _ in got], pa.int64()), pa.array([g[1] for _, g in got], pa.int64()), pa.array([g[2] for _, g in got], pa.int64()), pa.array([g[0] for _, g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
