"""SentencePiece encoding and decoding by a relational lattice.

A text is one dummy space and the text (the library writes spaces as U+2581, here they stay spaces).  Words are cut
where no piece of the vocabulary goes on: before spaces, and between punctuation and other characters as far as the
vocabulary allows.  So they are encoded on their own, and each distinct word of the corpus once.  Substrings of two
characters up to the longest piece are exploded and equi-joined to the piece table (fixed in size, so broadcast), the
edges are grouped by word, and a higher-order ``aggregate`` folds them.

The explode is bounded: from a start, substrings have the lengths of the pieces with the same three characters, which a
second, equally small table tells, or two characters; no piece is missed.

The fold follows the vocabulary's kind.  ``unigram``: Viterbi, the path with the greatest sum of scores, over the
edges in order of their ends.  ``bpe``: as the merge rule has it, the best-scored edge (the leftmost of equals) that
joins two neighbouring parts is applied until none is left; the sum of scores is not what such a vocabulary was made
for, so Viterbi would give other pieces than its library does.  The parts of a word are the bits of a number; words of
over ``BITS`` characters fold the same edges in an Arrow function with a heap.  Characters without a piece become
their UTF-8 bytes' pieces, or the unknown piece where the vocabulary has none.

Texts are cut into words once, by array operations, a block at a time; a written table holds each block's distinct
words and the words of its texts as numbers of those.  Blocks get their words' pieces back in two ways: the most
frequent words, at most ``HOT_WORDS`` of them whatever the corpus, travel with the tasks; every other (block, word) pair
is joined with the word table, and its pieces come back under the word's number.

Decoding joins the pieces, bytes included, turns U+2581 into spaces and takes the dummy space off.  It gives the text
back but for U+2581 in the text itself, which becomes a space, and unknown pieces.  Null and empty texts have no
pieces.  Rows that repeat id and text are encoded alike; null ids are carried.  Further columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import heapq
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import cut, cut_buckets, default_tokenizer, drop_cut, in_bucket, read_table, shuffle_partitions

SPACE = "▁"
HOT_WORDS = 200_000
#: Characters of a block of texts (one text may have more), those hashed at once, and places with numbers of their own.
CHARS, SEGMENT, PLACES = 1 << 22, 1 << 19, 1 << 12
BITS = 60
#: Lowest bit of an edge's rank; below it, in words of up to BITS characters, start, EARLY, end and start again (six bits
#: each), in longer ones start, then the length in so many bits.
RANK_AT, START_AT, EARLY, LENGTH_BITS = 43, 13, 1 << 12, 8
MODEL = "piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces (with spaces for U+2581), their ids and scores; ``raw`` has the ids of the 256 bytes, or is empty."""

    pieces: tuple[tuple[str, int, float], ...]
    raw: tuple[int, ...] = ()
    unknown: int = 0
    kind: str = "bpe"
    ids: dict[str, int] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        self.ids.update({p: k for p, k, _ in self.pieces})
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece goes on into the next word, so words cannot be encoded on their own")

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def kinds(self) -> tuple[str, str]:
        """Marks, and white space that pieces hold alone.  Words are spaces and then marks, or spaces and then other
        characters, or spaces before something else, or one character of the second kind.

        Characters that are next to each other in a piece (a space before one aside) belong together, and so do those
        that further characters tie to each other.  Marks are those that are so tied to punctuation and to no letter;
        no piece goes on from a mark to another character, or back."""
        tied: dict[str, set[str]] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                if x != " ":
                    tied.setdefault(x, set()).add(y)
                    tied.setdefault(y, set()).add(x)

        def reach(start: Iterable[str]) -> set[str]:
            seen, todo = set(), list(start)
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += tied.get(x, ())
            return seen

        marks = reach(set(string.punctuation) - reach(string.ascii_letters + string.digits))
        alone = "".join(c for c in "\n\t\r" if c not in tied and c not in marks)
        return "".join(sorted(marks)), alone

    def part(self, text: str) -> list[int]:
        got = self.ids.get(text)
        if got is not None:
            return [got]
        return [x for c in text for x in ([self.ids[c]] if c in self.ids else [self.raw[b] for b in c.encode()] if self.raw else [self.unknown])]

    def word_ids(self, word: str, bits: int | None, bounds: list[int] | None) -> list[int]:
        if bits:
            bounds = [k for k in range(len(word) + 1) if bits >> k & 1]
        if not bounds:
            return [x for c in word for x in self.part(c)]
        return [x for a, b in zip(bounds, bounds[1:], strict=False) for x in self.part(word[a:b])]

    @cached_property
    def width(self) -> str:
        """Type of packed ids: two bytes if all ids fit."""
        return "<u2" if max([*self.ids.values(), *self.raw, self.unknown]) < 1 << 16 else "<u4"

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def table(self) -> list[bytes]:
        """The bytes of every id."""
        out = [b""] * (max([*self.ids.values(), *self.raw, self.unknown]) + 1)
        for p, k in self.ids.items():
            out[k] = p.encode()
        for b, k in enumerate(self.raw):
            out[k] = bytes([b])
        return out


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def model_kind(raw: bytes) -> str:
    """``unigram`` or ``bpe``, from a model file's trainer settings (field 2; model type is field 3, unigram unless said)."""
    own = [v for k, trainer in _fields(raw) if k == 2 for f, v in _fields(trainer) if f == 3]
    kind = {1: "unigram", 2: "bpe"}.get(own[-1] if own else 1)
    if kind is None:
        raise ValueError("the model is neither a unigram nor a bpe one")
    return kind


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_tokenizer(MODEL))
    every = range(sp.get_piece_size())
    plain = tuple((sp.id_to_piece(k).replace(SPACE, " "), k, float(sp.get_score(k))) for k in every if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)))
    raw = tuple(k for k in every if sp.is_byte(k))
    return Vocabulary(plain, raw if len(raw) == 256 else (), sp.unk_id(), model_kind(sp.serialized_model_proto()))


class Cutter:
    """Cuts texts into words, a block of texts at a time, with array operations.

    A word's 64-bit hash is a sum of its characters' numbers, each times a number of its place; a second such sum tells
    if two words of a block share the first.  Only a block's distinct words become strings."""

    def __init__(self, vocabulary: Vocabulary):
        marks, alone = vocabulary.kinds()
        self.kind = np.zeros(0x110000, np.uint8)  # 0 others, 1 marks, 2 spaces, 3 alone
        for k, chars in ((1, marks), (2, " "), (3, alone)):
            self.kind[[ord(c) for c in chars]] = k
        random = np.random.Generator(np.random.PCG64(20240301))
        self.of_char = random.integers(0, 2**64, 0x110000, np.uint64)
        self.of_place = random.integers(0, 2**64, (2, PLACES), np.uint64) | np.uint64(1)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
        """Of each block: its first text's place, the number of each word, where each text's words begin and end, the
        distinct words.  A text begins with the dummy space; null and empty texts have no words."""
        own = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ").to_pylist()
        at, size = 0, 0
        for k, text in enumerate(own):
            size += len(text) + 1
            if size >= CHARS or k + 1 == len(own):
                yield at, *self.block(own[at : k + 1])
                at, size = k + 1, 0

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        sizes = np.array([len(t) + (len(t) > 0) for t in texts], np.int64)
        whole = "".join([" " + t for t in texts if t])
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kind[chars]
        before = np.concatenate(([3], kind[:-1]))
        begins = (kind == 3) | ((kind == 2) & (before != 2)) | ((kind < 2) & ((before == 3) | ((before < 2) & (kind != before))))
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        stops = np.concatenate((starts[1:], [len(chars)]))
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        low = 0
        while low < len(starts):  # as many words at once as SEGMENT characters hold
            high = max(low + 1, int(np.searchsorted(stops, starts[low] + SEGMENT, "right")))
            a, b = int(starts[low]), int(stops[high - 1])
            place = np.arange(a, b) - np.repeat(starts[low:high], stops[low:high] - starts[low:high])
            place %= PLACES
            code = self.of_char[chars[a:b]]
            one[low:high] = np.add.reduceat(code * self.of_place[0][place], starts[low:high] - a)
            two[low:high] = np.add.reduceat(code * self.of_place[1][place], starts[low:high] - a)
            low = high
        long = stops - starts > PLACES  # places repeat in these
        for i in np.flatnonzero(long).tolist():
            raw = whole[starts[i] : stops[i]].encode()
            one[i], two[i] = xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, 1)
        coded = pa.array(one).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(coded.dictionary), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        a, b = starts[first].tolist(), stops[first].tolist()
        words = [whole[x:y] for x, y in zip(a, b, strict=True)]
        if (two != two[first][at]).any():  # two words with one hash
            number: dict[str, int] = {}
            at = np.array([number.setdefault(whole[x:y], len(number)) for x, y in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
            words = list(number)
        return at, ends, words


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, which compress better than the numbers."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def blocks(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(block, ids, ends, at, words, n)`` of ``docs (doc_id, text)``, a row for each block of texts.

    ``words`` are its distinct words and ``n`` how often each occurs; ``at`` holds the number of each word of the texts,
    ``ends`` where each text's words begin and end.  ``block`` begins with the task's number, so it names the block within
    one written table alone; a task's blocks share a bucket."""
    n_buckets = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cut_up, squeeze, part = Cutter(vocabulary), zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId()
        keys = in_bucket(part % n_buckets, n_buckets, part << 32)
        for batch in batches:
            for low, at, ends, words in cut_up(batch.column(1)):
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                n = np.bincount(at, minlength=len(words)).astype(np.int64)
                order = np.argsort(-n, kind="stable")  # low numbers for frequent words, which compress better
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                at, n, words = place[at], n[order], [words[i] for i in order.tolist()]
                cols = [pa.array([next(keys)], pa.int64()), one(pa.concat_arrays([batch.column(0).slice(low, len(ends) - 1)])), one(pa.array(ends, pa.int64())), pa.array([squeeze(_planes(at))], pa.binary()), one(pa.array(words, pa.string())), one(pa.array(n))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "ends", "at", "words", "n"])
        _release()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, ids array<long>, ends array<long>, at binary, words array<string>, n array<long>")


def count_words(blocks: DataFrame) -> DataFrame:
    """``(word, n)``: words of two characters or more, summed on the tasks before they move."""
    each = blocks.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    return each.where(F.length("word") > 1).groupBy("word").agg(F.sum("n").alias("n"))


def _prefix(word: str, s: str) -> Column:
    """Three characters from a place as one number."""
    return F.expr(f"shiftleft(cast(ascii(substring({word}, {s} + 1, 1)) as bigint), 42) + shiftleft(cast(ascii(substring({word}, {s} + 2, 1)) as bigint), 21) + ascii(substring({word}, {s} + 3, 1))")


def edges(words: DataFrame, pieces: DataFrame, edge: str) -> DataFrame:
    """``(word, n, edges)``: ``edge``, an expression of the piece's columns and ``s``, of each piece within each word.

    The explodes and the broadcast joins leave rows where their word is, so grouping needs no further shuffle.  Both
    tables are no larger than the vocabulary; single numbers as keys are found faster than strings."""
    far = pieces.where(F.length("piece") > 2).groupBy(_prefix("piece", "0").alias("p")).agg(F.collect_set(F.length("piece")).alias("far"))
    at = words.withColumn("size", F.length("word")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("size") - 2)))
    reach = at.join(F.broadcast(far.withColumn("far", F.concat(F.array(F.lit(2)), "far"))), _prefix("word", "s") == F.col("p"), "left")
    lengths = reach.select("word", "n", "size", "s", F.explode(F.coalesce("far", F.array(F.lit(2)))).alias("l")).where(F.col("l") <= F.col("size") - F.col("s"))
    part = lengths.select("word", "n", "s", "l", F.substring("word", F.col("s") + 1, F.col("l")).alias("part"))
    same = F.startswith("part", "piece") & F.startswith("piece", "part")
    found = part.join(F.broadcast(pieces.withColumn("key", F.xxhash64("piece"))), (F.xxhash64("part") == F.col("key")) & same)
    return found.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.expr(edge)).alias("edges"))


def ranks(vocabulary: Vocabulary) -> list[tuple[str, int, int]]:
    """Pieces of two characters or more, their ranks by score, and EARLY or 0.

    A piece is early if one of two pieces (or characters) that make it up is not ranked before it, so that a merge may
    open another of a better rank."""
    own = {p: s for p, _, s in vocabulary.pieces if len(p) > 1}
    rank = {s: k for k, s in enumerate(sorted(set(own.values()), reverse=True))}
    if vocabulary.longest >= 1 << LENGTH_BITS or len(rank) >= 1 << 63 - RANK_AT:
        raise ValueError("the vocabulary's pieces are too long or too many")

    def early(p: str) -> bool:
        halves = ((p[:k], p[k:]) for k in range(1, len(p)))
        return any(all(len(x) == 1 or x in own for x in xy) and any(len(x) > 1 and own[x] <= own[p] for x in xy) for xy in halves)

    return [(p, rank[s], EARLY * early(p)) for p, s in own.items()]


def _edge() -> str:
    """An edge as a number that sorts by rank, then start."""
    long, s = f"{{}} | shiftleft(cast(s as bigint), {LENGTH_BITS}) | l", "cast(s as bigint)"
    short = f"{{}} | shiftleft({s}, {START_AT}) | early | shiftleft({s} + l, 6) | s"
    rank = f"shiftleft(rank, {RANK_AT})"
    return f"if(length(word) <= {BITS}, {short.format(rank)}, {long.format(rank)})"


#: Set where a fold is not to be trusted; lies above the bits of the bounds.
_BAD = 1 << 62


def _bpe() -> tuple[str, str, str]:
    """Expressions of the edges in order of rank, then start, of the early ones among them, and of the parts' bounds as bits,
    by one pass over the edges.

    An edge joins two parts if both its ends and just one bit between them are set.  _BAD is set if a merge opened an edge
    of a better rank, which only an early one can be: such words take a heap instead."""
    low, high = "shiftleft(1L, cast({e} & 63L as int))", "shiftleft(1L, cast(shiftright({e}, 6) & 63L as int))"
    hit = f"bit_count({{b}} & ({high} - {low})) = 2 and ({{b}} & {low}) <> 0L and ({{b}} & {high}) <> 0L"
    after = f"(b & ~({high} - 2L * {low}))".format(e="e")
    opened = f"exists(early, x -> x < e and {hit.format(b=after, e='x')})"
    fold = "aggregate(ordered, shiftleft(1L, length(word) + 1) - 1L, (b, e) -> if({hit}, {after}{more}, b))"
    plain, careful = (fold.format(hit=hit.format(b="b", e="e"), after=after, more=more) for more in ("", f" | if({opened}, {_BAD}L, 0L)"))
    # Two uses of the early edges, so that the optimiser does not put their filter into the fold.
    return "sort_array(edges)", f"filter(ordered, e -> (e & {EARLY}L) <> 0L)", f"if(size(early) = 0, {plain}, {careful})"


def _viterbi(single: float) -> str:
    """Best score and last part of every prefix, extended by one character at a time.

    ``edges`` has pieces of two characters or more as (-score, start, length); a character alone is an edge too.  Scores
    are added as 32-bit numbers, and of equal paths the one whose last part starts first is taken, as the library does.
    ``from`` holds starts with their sign turned, so that the greatest of equals is the first."""
    one = f"named_struct('v', element_at(acc, -1).v + coalesce(get(singles, k - 1), cast({single} as float)), 'from', 1 - k)"
    more = "transform(filter(edges, e -> e.s + e.l = k), e -> named_struct('v', get(acc, e.s).v - e.p, 'from', -e.s))"
    best = f"array_max(concat(array({one}), {more}))"
    back = "aggregate(sequence(1, length(word)), array(length(word)), (b, k) -> if(element_at(b, -1) = 0, b, concat(b, array(-get(acc, element_at(b, -1)).from))), b -> reverse(b))"
    return f"aggregate(sequence(1, length(word)), array(named_struct('v', cast(0 as float), 'from', 0)), (acc, k) -> concat(acc, array({best})), acc -> {back})"


def merge_heap(word: str, found: list[tuple[float, int, int]]) -> list[int]:
    """Bounds of the parts after all merges; for words of any length."""
    n = len(word)
    score = {(s, s + l): p for p, s, l in found}
    ends, starts, heap = list(range(1, n + 1)), list(range(n)), []  # the end of the part at a start; the start at an end

    def offer(a: int, c: int) -> None:
        if (a, c) in score:
            heapq.heappush(heap, (score[a, c], a, c, ends[a]))

    for a in range(n - 1):
        offer(a, a + 2)
    live = [True] * n
    while heap:
        _, a, c, b = heapq.heappop(heap)
        if not live[a] or ends[a] != b or b >= n or not live[b] or ends[b] != c:
            continue
        live[b] = False
        ends[a], starts[c - 1] = c, a
        if a:
            offer(starts[a - 1], c)
        if c < n:
            offer(a, ends[c])
    return [*(a for a in range(n) if live[a]), n]


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(word, n, ids)`` of every word that holds a piece of two characters or more.

    ids are packed; a zero byte more, so an odd length, tells that they do not decode to the word (unknown pieces)."""
    spark = words.sparkSession
    if vocabulary.kind == "bpe":
        pieces = spark.createDataFrame(ranks(vocabulary), "piece string, rank long, early int")
        grouped = edges(words, pieces, _edge())
        ordered, early, fold = _bpe()
        short = F.length("word") <= BITS
        passed = grouped.withColumn("ordered", F.when(short, F.expr(ordered))).withColumn("early", F.expr(early)).withColumn("fold", F.expr(fold))
        bits = F.when(F.col("fold") < _BAD, F.col("fold"))
        folded = passed.select("word", "n", bits.alias("bits"), F.when(bits.isNull(), F.col("edges")).alias("edges"))
    else:
        pieces = spark.createDataFrame([(p, s) for p, _, s in vocabulary.pieces if len(p) > 1], "piece string, score float")
        grouped = edges(words, pieces, "named_struct('p', -score, 's', s, 'l', l)")
        least = min((s for _, _, s in vocabulary.pieces), default=0.0) - 10.0
        singles = {p: s for p, _, s in vocabulary.pieces if len(p) == 1}

        def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                got = pa.array([[singles.get(c, least) for c in w] for w in batch.column(0).to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "singles"])

        scored = grouped.mapInArrow(score, "word string, n long, edges array<struct<p:float,s:int,l:int>>, singles array<float>")
        folded = scored.select("word", "n", F.lit(None).cast("long").alias("bits"), F.expr(_viterbi(least)).cast("array<long>").alias("edges"))
    return _packed(folded, vocabulary)


def _packed(folded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``folded`` has bounds as bits, or null and the edges to merge; for ``unigram`` the bounds stand for the edges."""

    def bounds_of(word: str, edges: list[int]) -> list[int]:
        if vocabulary.kind != "bpe":
            return edges
        if len(word) <= BITS:
            return merge_heap(word, [(e >> RANK_AT, e & 63, (e >> 6 & 63) - (e & 63)) for e in edges])
        below = (1 << RANK_AT - LENGTH_BITS) - 1
        return merge_heap(word, [(e >> RANK_AT, e >> LENGTH_BITS & below, e & (1 << LENGTH_BITS) - 1) for e in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        decodes, width, known = vocabulary.table(), vocabulary.width, vocabulary.ids.get
        item = np.dtype(width).itemsize
        for batch in batches:
            words, bits = batch.column(0).to_pylist(), batch.column(2).fill_null(0).to_numpy()
            row, at = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            same = row[1:] == row[:-1]
            own = row[1:][same]
            part = [known(words[r][a:b], -1) for r, a, b in zip(own.tolist(), at[:-1][same].tolist(), at[1:][same].tolist(), strict=True)]
            part = np.array(part, np.int64)
            stops = np.cumsum(np.bincount(own, minlength=len(words))) * item
            raw = part.astype(width).tobytes()
            ids = [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            for r in np.union1d(np.flatnonzero(bits == 0), own[part < 0]).tolist():  # merged by the heap, or parts that are no pieces
                w = words[r]
                got = vocabulary.word_ids(w, int(bits[r]), None if bits[r] else bounds_of(w, batch.column(3)[r].as_py()))
                ids[r] = vocabulary.pack(got) + b"\0" * (decode(got, decodes) != w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return folded.mapInArrow(run, "word string, n long, ids binary")


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the words: all that occur at least so often, by eighths of a power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    tally = sorted(map(tuple, table.groupBy(step.alias("step")).count().collect()), reverse=True)  # 512 rows at most
    total, least = 0, None
    for at, n in tally:
        if total + n > most:
            break
        total, least = total + n, at
    return table.where(step >= least) if least is not None else table.limit(0)


_HOT: dict[str, dict[str, bytes]] = {}


def _hot_ids(key: str, parts: list[bytes]) -> dict[str, bytes]:
    """The frequent words' ids, unpacked for a task, which drops them at its end: idle workers must not hold them."""
    if key not in _HOT:
        _HOT.clear()
        own: dict[str, bytes] = {}
        for part in parts:
            table = pa.ipc.open_stream(part).read_all()
            own.update(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        _HOT[key] = own
    return _HOT[key]


def _release() -> None:
    """At a task's end: an idle worker must not hold the frequent words, nor what Arrow and the allocator keep for later."""
    _HOT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves, or not at all
        ctypes.CDLL(None).malloc_trim(0)


def _pack_hot(table: DataFrame) -> list[bytes]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part"])

    return [bytes(r[0]) for r in table.select("word", "ids").mapInArrow(run, "part binary").collect()]


def _tokens(at: np.ndarray, ids: list[bytes], width: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words by their numbers, as 32-bit numbers, and where each word's ids end, 0 first."""
    every = np.frombuffer(b"".join(ids), width).astype("<u4")
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(width).itemsize
    began, ends, out = np.cumsum(sizes) - sizes, np.zeros(len(at) + 1, np.int64), []
    np.cumsum(sizes[at], out=ends[1:])
    for low in range(0, len(at), SEGMENT):  # as many words at once
        mine = at[low : low + SEGMENT]
        first, size = ends[low : low + len(mine)], sizes[mine]
        out.append(every[np.arange(first[0], first[-1] + size[-1]) + np.repeat(began[mine] - first, size)])
    return np.concatenate(out) if out else every[:0], ends


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, hot_words: int = HOT_WORDS) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, round_trip)`` of every row, and ``ids array<int>`` on request.

    ids_sha256 is the hash of the ids as little-endian 32-bit numbers.  round_trip tells that decoding them gives the
    text, U+2581 taken for a space: pieces decode one by one, so it holds if every word's ids give the word and the
    words give the text."""
    spark = docs.sparkSession
    own = cut_buckets(blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), vocabulary), "blocks", "block")
    table = cut_buckets(encode_words(count_words(own), vocabulary), "words", "word")
    # Words that do not decode to themselves (unknown pieces) stay with the others, where that is told.
    frequent = _frequent(table, hot_words).where("length(ids) % 2 = 0")
    sent = spark.sparkContext.broadcast(_pack_hot(frequent))
    key = f"{spark.sparkContext.applicationId}-{hashlib.md5(b''.join(sent.value)).hexdigest()}"
    rest = own.select("block", F.posexplode("words").alias("spot", "word")).where(F.length("word") > 1).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    # A table of its own, so that the shuffles of the words and the word table are gone when the pieces move to their blocks.
    found = cut(rest.join(table.select("word", F.col("ids").alias("pack")), "word").select("block", "spot", "pack").sortWithinPartitions("block", "spot"), "pairs")
    drop_cut(table)
    named = found.groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("spot", "pack")).alias("rare"))
    joined = own.select("block", "ids", "ends", "at", F.array_join("words", SPACE).alias("words")).join(named, F.col("block") == F.col("b"), "left").drop("block", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hot, tool, decodes, width = _hot_ids(key, sent.value), zstandard.ZstdDecompressor(), vocabulary.table(), vocabulary.width
        for batch in batches:
            for docs, ends, at, words, rare in zip(*batch.columns, strict=True):
                ends, at = ends.values.to_numpy(), _numbers(tool.decompress(at.as_buffer()))
                words = words.as_py().split(SPACE) if len(at) else []
                ids = list(map(hot.get, words))
                if rare.is_valid:
                    for u, got in zip(*(x.to_pylist() for x in rare.values.flatten()), strict=True):
                        ids[u] = got
                bad = np.zeros(len(words), bool)
                for u, got in enumerate(ids):
                    if got is None:  # no piece of two characters lies in it
                        plain = vocabulary.word_ids(words[u], None, None)
                        got = ids[u] = vocabulary.pack(plain) + b"\0" * (decode(plain, decodes) != words[u])
                    if len(got) % 2:
                        ids[u], bad[u] = got[:-1], True
                tokens, stops = _tokens(at, ids, width)
                stops, raw = stops[ends], memoryview(tokens.tobytes())
                sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                broken = np.concatenate(([0], np.cumsum(bad[at])))[ends]
                cols = [docs.values, pa.array(np.diff(stops)), pa.array(sha, pa.string()), pa.array(broken[1:] == broken[:-1])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(tokens.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "round_trip", *["ids"] * with_ids])
        del hot
        _release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return joined.mapInArrow(run, schema)


def decode(ids: Iterable[int], table: list[bytes]) -> str:
    """The text of ids, dummy space included; ``table`` is the vocabulary's."""
    return b"".join([table[k] for k in ids]).decode("utf-8", "replace")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), load())
