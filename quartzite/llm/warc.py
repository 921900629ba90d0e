"""WARC archives: writing, reading back, and a merged capture index.

Writing: one record per row.  Of rows with equal payloads (SHA-1 of the whole payload; null counts as empty) the one
with the largest id is a response, the others revisit it; with a least size for that, smaller payloads are all
responses.  Archives are Spark text files whose lines end in CR LF CR LF, which is what ends a WARC record, so any
store that Spark writes to will do; they are gzipped as whole files.

Reading: archives are read as binary files and cut by Content-Length; each payload is hashed again and held against
its record's digest.  A file yields one capture run, sorted by URL key, time and id.

Merging: rows of all runs are dealt by range of that order, and each range merges its pieces of the runs with a loser
tree: every inner node keeps the loser of its match, so the next capture costs one match per level.  Ranges by
number and places within them give the global order; captures of one URL may span ranges, so a URL with a third of
all captures is no task's burden, and the number of ranges follows that of the captures.

Rows that repeat an id and a payload are each a record and none revisits the other; null ids count as the smallest
and their records refer to none.  Null urls have an empty key.  An empty table gives an
empty index.  Further columns of the input are not read and may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import cut, fresh_path, id_order, read_table, shuffle_partitions

END = "\r\n\r\n"
#: Records of an archive, and bytes of payloads that it holds on average, at most.
RECORDS_PER_FILE, BYTES_PER_FILE = 4000, 64 << 20
#: Captures of a range of the merged order, on average.
RANGE = 100_000
#: Payloads under so many bytes are never revisits.
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of forty hex digits: five digits are twenty bits, four letters."""
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time_col: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(value)``: the text of each WARC record, without the CR LF CR LF that ends it."""
    time = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(31_536_000)))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20"), F.lit("")).alias("url"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    own = own.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    slim = own.select("id", "digest", "bytes").distinct()
    best = slim.groupBy("digest").agg(F.max("id").alias("best")).withColumnRenamed("digest", "digest2")
    refers = F.when((F.col("bytes") >= least_bytes) & F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best")), F.col("best"))
    info = slim.join(best, F.col("digest") == F.col("digest2")).select(F.col("id").alias("id3"), F.col("digest").alias("digest3"), refers.alias("refers"))
    full = own.join(info, F.col("id").eqNullSafe(F.col("id3")) & (F.col("digest") == F.col("digest3")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("refers").isNull(), F.concat(http, "body")).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Date", F.col("time")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(F.col("refers").isNull(), F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _record_id(F.col("refers"))), line("WARC-Profile", F.lit(PROFILE)), line("X-Refers-To-Page", F.col("refers").cast("string")))),
        line("X-Page", F.coalesce(F.col("id").cast("string"), F.lit("null"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return full.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int | None = None, **columns) -> None:
    """Writes the records of all rows.  An archive holds as many as BYTES_PER_FILE of payloads have on average."""
    if records_per_file is None:
        n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(columns.get("body_col", "html"))), F.lit(0))).first()
        records_per_file = max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE * n // max(size, 1)))
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Archive(io.RawIOBase):
    """The bytes of an archive, unzipped as they are read; gzip members may follow each other."""

    def __init__(self, content: bytes):
        self.content, self.at, self.left = memoryview(content), 0, b""
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left and self.at < len(self.content):
            part = self.content[self.at : self.at + (1 << 18)]
            self.at += len(part)
            if not self.zip:
                self.left = bytes(part)
                break
            self.left = self.zip.decompress(part)
            if self.zip.eof:
                self.at -= len(self.zip.unused_data)
                self.zip = zlib.decompressobj(31)
        n = min(len(into), len(self.left))
        into[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _headers(stream) -> dict[str, str] | None:
    first = stream.readline()
    if not first:
        return None
    out = {"": first.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def parse(content: bytes) -> Iterator[tuple]:
    """(page, url, time, payload bytes, digest, type, refers to) of each record."""
    stream = io.BufferedReader(_Archive(content), 1 << 18)
    while (head := _headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {head['']!r}")
        block = io.BytesIO(stream.read(int(head["content-length"])))
        if stream.read(4) != END.encode():
            raise ValueError("a WARC record does not end where its length says")
        http = _headers(block)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            body = block.read()
            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                raise ValueError("a payload differs from its digest")
        number = lambda x: None if x in (None, "null") else int(x)
        yield number(head["x-page"]), head["warc-target-uri"], head["warc-date"], int(http["content-length"]), digest, head["warc-type"], number(head.get("x-refers-to-page"))


def url_key(url: str) -> str:
    """Host labels backwards, then path and query, lower-cased: ``org,example)/path``."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = re.sub(r":(80|443)$", "", m[1].lower()).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


_RUN = "run string, seq long, url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive under ``path``, sorted within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        schema = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(url_key(url), time, page, n, digest, kind, refers) for page, url, time, n, digest, kind, refers in parse(content.as_py())]
                rows.sort(key=_order)
                cols = list(zip(*((name, k, *r) for k, r in enumerate(rows)), strict=True)) if rows else [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content").mapInArrow(run, _RUN)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges sorted iterators.  Node 0 holds the winner, every other inner node the loser of its match."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.nodes = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.nodes[at] < 0:
                self.nodes[at] = i
                return
            if self._less(self.nodes[at], i):
                self.nodes[at], i = i, self.nodes[at]
            at //= 2
        self.nodes[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.nodes[0]]) is not None:
            yield head[2]
            i = self.nodes[0]
            self.heads[i] = self._next(i)
            self._play(i)


def merged(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order: by ``range_no``, then by ``range_pos``.

    A range has ``RANGE`` captures on average, whatever their number; equal keys may be in two ranges, in order of run and
    place.  Its pieces of the runs are held by columns, and the merge hands out a batch at a time."""
    n = ranges or max(shuffle_partitions(runs.sparkSession), runs.count() // RANGE)
    dealt = runs.repartitionByRange(n, F.col("url_key"), F.col("capture_time"), id_order("page_id"), "run", "seq").withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("run", "ascending"), ("seq", "ascending")]).combine_chunks()
        bounds = [0, *(k for k, (a, b) in enumerate(pairwise(table.column("run").to_pylist()), 1) if a != b), table.num_rows]

        def rows(a: int, b: int) -> Iterator[tuple[int, str, str, int | None]]:
            """(place, key) of a run's captures, a few at a time."""
            for low in range(a, b, 1024):
                part = table.slice(low, min(1024, b - low))
                yield from zip(range(low, b), *(part.column(c).to_pylist() for c in ("url_key", "capture_time", "page_id")), strict=False)

        order = (row[0] for row in LoserTree([rows(a, b) for a, b in pairwise(bounds)], lambda r: _order(r[1:])))
        at = 0
        while places := list(islice(order, 1 << 14)):
            part = table.drop_columns(["run", "seq"]).take(pa.array(places)).append_column("range_pos", pa.array(range(at, at + len(places)), pa.int64()))
            yield from part.combine_chunks().to_batches()
            at += len(places)

    schema = ", ".join(_RUN.split(", ")[2:]) + ", range_no int, range_pos long"
    return dealt.mapInArrow(run, schema)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The merged capture index of the archives under ``path``."""
    return merged(cut(capture_runs(spark, path), "runs"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(read_table(spark, sf_dir, "pages"), path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "range_no", "range_pos")
