"""Main text of HTML pages.

A page is cut into tags, comments and text.  Markup, comments, scripts and styles go, and so does everything inside
menus, footers, sidebars, forms, page headers, and elements whose class, id or role says that they hold reader comments,
adverts, navigation and the like.  If the page has ``article`` or ``main`` elements, its text is within them.

Structure leaves blocks open: all of a page without ``article`` and ``main``, and within those elements the parts whose
names only hint (``related-work`` may be a section of the article or a list of links).  The host's suffix array decides
those.  The token streams of all blocks of all the host's pages are taken together, whether open or not; suffixes start
where a block starts and at the least token hash of every ``WINDOW`` tokens of a block, so equal stretches of text start equal
suffixes; each reaches to the next start, over ``RUN`` tokens at least (or that far back).  They are dealt by the hash
of host and tokens and sorted in their buckets, where equal ones are neighbours: strings on two or more distinct pages.

Articles repeat too: in mirrors, near copies and quotations.  So the rest of an ``article`` is guarded: strings in it
bear witness, but it is not cut.  And only pages that are otherwise different, of whose tokens at least half lie in no
repeated string, bear witness that a string is boilerplate; pages of equal text are one witness.  Of a hinted part, two
witnesses suffice.  On a page without ``article``, in the first and last ``EDGE`` blocks two suffice, in others ``MANY``;
blocks of ``LONG`` tokens or more, wherever they stand, take ``VERY_MANY``, and the host's first witness keeps its copy.
Tokens that such strings cover go, unique runs stay.  Hashes of strings are dealt out and aggregates count the witnesses,
so a host with most of the pages loads no task more than others.

White space within a block becomes one space, character references are decoded, blocks are joined in page order by
one line end.  Null and empty pages have an empty text.  Repeated rows each get their answer; pages that share an id
count as one page for what is repeated.  Null ids count as one page.  Null urls are a host of their own.  An empty table
gives an empty result.  Further columns are not read and may have any names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import common
from quartzite.llm.common import cut, input_bytes, read_table, shuffle_partitions, spread
from quartzite.llm.substrings import _by_bucket, _least, _mix, _pack, _unpack

RUN, WINDOW = 8, 32
EDGE, MANY = 2, 3
LONG, VERY_MANY = 40, 10
#: What structure says of a block: it stays, its names hint that it may go, or nothing.
GUARDED, HINTED, OPEN = 0, 1, 2
#: Bytes of text whose suffixes are found at once, and suffixes that a task gathers before it passes them on.
BLOCK, GATHERED = 1 << 21, 1 << 19
_HOST = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
_RAW = "script|style|noscript|template|svg|math|iframe|object|select|textarea|button|canvas|audio|video|title"
_PART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
#: Elements that hold no main text, elements that begin and end a block, names of parts to leave out, names
#: that only hint at it within an article, and words that such names are joined with.
_DROP = frozenset("head nav footer aside form menu dialog".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr masthead modal nav navbar navigation newsletter outbrain pagination paywall popup share sharing sidebar sponsor sponsored subscribe subscription taboola".split())
_HINTS = frozenset("banner header menu notice notification promo promotion related skip social toolbar widget".split())
_JOINED = frozenset("area bar block body bottom box buttons content container form global inner item items left link links list main outer page panel policy reader right section site slot text thread top unit user widget wrap wrapper".split())
_COMMENT = frozenset("comment comments commentlist disqus".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Elements that the next such element ends where the page leaves out the end tag.
_IMPLIED = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


def _standing(tag: str, attr: str, within: bool) -> int | None:
    """GUARDED for an element that says nothing, HINTED for one that may go, None for one that goes.

    ``within``: inside an article.  A name goes by all its words, so that ``comment-list`` does and ``social-history`` does
    not; elsewhere than in an article, hints go as well."""
    if tag in _DROP or tag == "header" and not within:
        return None
    out = GUARDED
    if not attr or tag in ("html", "body"):
        return out
    for m in _ATTR.finditer(attr):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return None
        for word in value.split() if name in ("class", "id") else ():
            parts = [x for x in re.split(r"[-_]+", word) if x]
            named, hinted = _NAMES.intersection(parts), _HINTS.intersection(parts)
            if tag in ("article", "main"):  # only comments are marked up so
                named, hinted = _COMMENT.intersection(parts), set()
            rest = [x for x in parts if x not in _NAMES and x not in _HINTS and x not in _JOINED and not x.isdigit()]
            if not rest and (named or hinted and not within):
                return None
            if named or hinted:
                out = HINTED
    return out


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text that structure does not rule out, and what it says of each."""
    inside: list[tuple[str, int]] = []
    others: list[tuple[str, int]] = []
    now: list[str] = []
    main = 0
    found = False
    skip = ""  # the element whose content is left out
    left = False  # whether that is an article itself
    hint = ""  # the element whose name hints that it may be
    depth = hinted = 0

    def close() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            now.clear()
            if text:
                (inside if main else others).append((text, HINTED if hint else GUARDED))

    for m in _PART.finditer(page or ""):
        if (text := m["text"]) is not None:
            if not skip:
                now.append(text)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if skip:
            if m["end"]:
                if tag == skip:
                    depth -= 1
                elif skip in _IMPLIED and tag in _BLOCK:
                    depth = 0
                if depth:
                    continue
                skip = ""
                if tag not in ("article", "main") or left:
                    continue
            elif tag in _IMPLIED.get(skip, ()):
                skip, depth = "", 0
            else:
                depth += tag == skip and tag not in _VOID
                continue
        if m["end"]:
            if tag in _BLOCK:
                close()
                if tag in ("article", "main"):
                    main = max(main - 1, 0)
            if tag == hint:
                hinted -= 1
                if not hinted:
                    hint = ""
            continue
        if tag in _BLOCK:
            close()
        elif tag == "br":
            now.append(" ")
        if tag == hint:
            hinted += 1
        if tag in _VOID:
            continue
        standing = _standing(tag, m["attr"], main > 0)
        if standing is None:
            skip, depth, left = tag, 1, tag in ("article", "main")
        elif tag in ("article", "main"):
            main += 1
            found = True
        elif standing == HINTED and main and not hint and tag in _BLOCK:
            hint, hinted = tag, 1
    close()
    return inside if found else [(t, OPEN) for t, _ in others]


_PARSED = "page_id long, url string, k long, h long, parts array<string>, says array<int>"


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, k, h, parts, says)`` of every page; k and h, hashes of url and text, name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            got = [blocks(x.as_py()) for x in batch.column(2)]
            keys = [common.NULL_ID if k is None else k for k in batch.column(0).to_pylist()]
            hashes = [xxhash.xxh3_64_intdigest((u or "") + "\n" + "\n".join(t for t, _ in g)) - 2**63 for u, g in zip(batch.column(1).to_pylist(), got, strict=True)]
            cols = [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array([[t for t, _ in g] for g in got], pa.list_(pa.string())), pa.array([[x for _, x in g] for g in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["page_id", "url", "k", "h", "parts", "says"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, _PARSED)


_RANDOM = np.random.Generator(np.random.PCG64(20240311))
_BYTE, _PLACE = _RANDOM.integers(0, 2**64, 256, np.uint64), _RANDOM.integers(0, 2**64, 1 << 12, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP up to n, and of its inverse."""
    if n not in _POWERS:
        _POWERS.clear()
        size = 1 << n.bit_length()
        _POWERS[n] = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64)))) for x in (_STEP, _BACK))
    return _POWERS[n]


def token_hashes(parts: list[str]) -> np.ndarray:
    """A hash of each token, a sum over its bytes' numbers times their places'; blocks hold single spaces alone."""
    raw = np.frombuffer(" ".join(parts).encode(), np.uint8)
    stops = np.concatenate((np.flatnonzero(raw == 32), [len(raw)]))
    starts = np.concatenate(([0], stops[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(raw)]))))
    code = _BYTE[raw] * _PLACE[place & 4095]
    code[stops[:-1]] = 0
    h = np.add.reduceat(code, starts)
    return h ^ (h >> np.uint64(29))


def stretches(h: np.ndarray, begins: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, weight) of the sampled strings of one page's token hashes, blocks beginning at ``begins``.

    weight is how many of the page's tokens count as repeated if the string is."""
    n, marks = len(h), [begins]
    if n >= window:
        rank = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64) % np.uint64(1 << 24))
        block = np.searchsorted(begins, np.arange(n), "right")
        inside = block[: n - window + 1] == block[window - 1 :]  # what lies around a block has no say in its starts
        marks.append((np.uint64(0xFFFFFF) - (_least(rank, window)[inside] & np.uint64(0xFFFFFF))).astype(np.int64))
    a = np.unique(np.concatenate(marks))
    b = np.concatenate((a[1:], [n]))
    far, size = b - a >= run, b - a
    ahead, back = ~far & (a + run <= n), ~far & (b >= run)
    start = np.concatenate((a[far], a[ahead], b[back] - run))
    stop = np.concatenate((b[far], a[ahead] + run, b[back]))
    return start, stop, np.concatenate((size[far], (size[ahead] + 1) // 2, size[back] // 2))


_OUT = "bucket int, kind int, key long, k long, h long, c long, at int, size int, says int, pay binary"
_PAGE = ("<i8", "<i8", "<i8", "<u4")
_ROW = ("<u4", "<u8", "<u4", "u1", "u1", "u1")


def _find(n: int, run: int, window: int):
    """Payloads of sampled strings by bucket: pages (k, h, hash of the text, tokens), then strings (page, hash, start,
    tokens, weight, what structure says)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pages: list[tuple[int, int, int, int]] = []
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                number, key, at, length, weight, says = (np.concatenate(c) for c in zip(*found, strict=True))
                k, h, c, tokens = (np.array(x, np.int64) for x in zip(*pages, strict=True))
                buckets, pays = [], []
                for to, own in _by_bucket(spread(key, n)):
                    held, local = np.unique(number[own], return_inverse=True)
                    buckets.append(to)
                    pays.append(zstandard.compress(_pack(_PAGE, k[held], h[held], c[held], tokens[held]) + _pack(_ROW, local, key[own], at[own], length[own], weight[own], says[own])))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(pays, pa.binary())], names=["bucket", "pay"])

        for batch in batches:
            for url, k, h, parts, says in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True):
                if not parts:
                    continue
                counts = np.array([p.count(" ") + 1 for p in parts], np.int64)
                hashes = token_hashes(parts)
                start, stop, weight = stretches(hashes, np.cumsum(counts) - counts, run, window)
                up, down = _powers(len(hashes))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])))
                host = xxhash.xxh3_64_intdigest(m[1].lower() if (m := _HOST.match(url or "")) else "")
                key = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(host))
                state = np.repeat(np.array(says), counts)
                found.append((np.full(len(key), len(pages)), key, start, stop - start, weight, np.maximum(state[start], state[stop - 1])))
                pages.append((k, h, xxhash.xxh3_64_intdigest("\n".join(parts)) - 2**63, len(hashes)))
                size += len(key)
                if size >= GATHERED:
                    yield from out()
                    pages, found, size = [], [], 0
        yield from out()

    return rows


def _meet(table: pa.Table) -> pa.Table:
    """Kind 0: how many tokens of a page lie in the bucket's repeated strings.  Kind 1: every place of a repeated string
    that some page leaves open."""
    parts: list[list[np.ndarray]] = [[] for _ in range(9)]
    for x in table.column("pay"):
        raw = zstandard.decompress(x.as_buffer())
        (k, h, c, tokens), at = _unpack(raw, _PAGE)
        (number, *cols), _ = _unpack(raw, _ROW, at)
        for part, col in zip(parts, (k[number], h[number], c[number], tokens[number], *cols), strict=True):
            part.append(col)
    k, h, c, tokens, key, at, size, weight, says = (np.concatenate(p) for p in parts)
    order = np.lexsort((c, key))  # the suffixes in order of their strings, equal ones side by side
    k, h, c, tokens, key, at, size, weight, says = (x[order] for x in (k, h, c, tokens, key, at, size, weight, says))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    run = np.cumsum(new) - 1
    distinct = np.bincount(run, new | np.concatenate(([True], c[1:] != c[:-1])))
    repeated = distinct[run] > 1
    page = np.flatnonzero(repeated)[np.lexsort((h[repeated], k[repeated]))]
    cols: list[list] = [[] for _ in range(9)]
    for own in np.split(page, np.flatnonzero((np.diff(k[page]) != 0) | (np.diff(h[page]) != 0)) + 1):
        if len(own):
            for col, v in zip(cols, (0, 0, int(k[own[0]]), int(h[own[0]]), 0, int(weight[own].sum()), int(tokens[own[0]]), 0, None), strict=True):
                col.append(v)
    some = np.flatnonzero(repeated & (np.bincount(run, says > 0) > 0)[run])
    for col, v in zip(cols, (np.ones(len(some), int), key[some].view(np.int64), k[some], h[some], c[some], at[some], size[some], says[some]), strict=False):
        col += v.tolist()
    cols[8] += [None] * len(some)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["kind", "key", "k", "h", "c", "at", "size", "says", "pay"]
    return pa.table({"bucket": pa.array([0] * len(cols[0]), pa.int32())} | {name: pa.array(v, t) for name, v, t in zip(names, cols, types, strict=True)})


def boilerplate(parsed: DataFrame, size: int, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """``(k, h, found)``: of each page with open blocks the places, tokens and witnesses of strings that may be
    boilerplate, and whether the page is the first witness.  ``size``, in bytes, sets the number of buckets."""
    parts = max(shuffle_partitions(parsed.sparkSession), size // (8 << 20))
    dealt = parsed.mapInArrow(_find(parts * 4, run, window), "bucket int, pay binary").repartition(parts, "bucket")
    met = cut(dealt.groupBy("bucket").applyInArrow(_meet, _OUT).drop("bucket", "pay"), "repeated")
    same = met.where("kind = 0").groupBy(F.col("k").alias("k2"), F.col("h").alias("h2")).agg((2 * F.sum("at") <= F.max("size")).alias("witness")).where("witness")
    places = met.where("kind = 1")
    told = places.join(same, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2"))).groupBy("key", "k").agg(F.min("c").alias("c"))
    many = told.groupBy(F.col("key").alias("key2")).agg(F.countDistinct("c").alias("n"), F.min("k").alias("low")).where("n > 1")
    hit = places.where("says > 0").join(many, F.col("key") == F.col("key2"))
    return hit.groupBy("k", "h").agg(F.collect_set(F.struct("at", "size", F.col("n").cast("int").alias("n"), (F.col("k") == F.col("low")).alias("first"))).alias("found"))


def _covered(n: int, places: list[tuple[int, int]]) -> np.ndarray:
    """Which of n tokens strings of these places and sizes cover."""
    gone = np.zeros(n + 1, np.int32)
    for k, size in places:
        gone[k] += 1
        gone[k + size] -= 1
    return np.cumsum(gone)[:n] > 0


def _uncovered(parts: list[str], says: list[int], found: list[tuple[int, int, int, bool]]) -> list[str]:
    """The blocks without boilerplate; ``found`` has place, tokens, witnesses and whether this page is the first of them."""
    if not found:
        return parts
    n = sum(p.count(" ") + 1 for p in parts)
    edge = _covered(n, [(k, s) for k, s, _, _ in found])
    inner = _covered(n, [(k, s) for k, s, w, _ in found if w >= MANY])
    long = _covered(n, [(k, s) for k, s, w, first in found if w >= VERY_MANY and not first])
    at, out = 0, []
    for i, (p, standing) in enumerate(zip(parts, says, strict=True)):
        tokens = p.split(" ")
        if standing == GUARDED:
            covered = np.zeros(n, bool)
        elif standing == HINTED:
            covered = edge
        else:
            covered = long if len(tokens) >= LONG else edge if i < EDGE or i >= len(parts) - EDGE else inner
        left = [t for k, t in enumerate(tokens, at) if not covered[k]]
        at += len(tokens)
        if left:
            out.append(" ".join(left))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, window: int = WINDOW) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.  Pages are parsed again rather than kept between the passes."""
    parsed = parse(pages, id_col, url_col, html_col)
    found = boilerplate(parsed, input_bytes(pages, html_col), run, window)
    open_ = F.exists("says", lambda x: x > 0)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            got = [_uncovered(p, s, [(x["at"], x["size"], x["n"], x["first"]) for x in found or []]) for p, s, found in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.string()))], names=["page_id", "url", "parts"])

    named = found.toDF("k3", "h3", "found")
    joined = parsed.where(open_).join(named, (F.col("k") == F.col("k3")) & (F.col("h") == F.col("h3")), "left").select("page_id", "url", "parts", "says", "found")
    whole = parsed.where(~open_).select("page_id", "url", "parts").unionByName(joined.mapInArrow(strip, "page_id long, url string, parts array<string>"))
    text = F.array_join("parts", "\n")
    return whole.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
