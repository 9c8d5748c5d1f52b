"""Operator 8: WARC archives, and an index merged from their sorted capture runs.

Records are built by Spark expressions and written by Spark's own writer, so archives go wherever Spark can write. Each
record is a gzip member of its own, so a record is read by seeking to its offset; a file ends with the record that takes
it over FILE_BYTES. Reading gives one capture run for each file. The runs are sorted by URL key and time, dealt to ranges
of the key, and each range merges its parts of all runs with a loser tree over cursors; ranges follow one another, so the
whole is in global order.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import look_up, prepare, table, written
from barloom.session import new_path

#: Payloads from this size on are stored once; compressed bytes after which a file ends.
LEAST_BYTES, FILE_BYTES = 1000, 32 << 20
#: Captures in a range of the index, about, and in what a cursor reads at a time.
RANGE_ROWS, CURSOR_ROWS = 200_000, 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
FIRST_DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write a WARC/1.1 record for each row of pages to files below the folder ``path``.

    Of records with equal payloads of at least LEAST_BYTES bytes, the one with the largest id is a response and the others
    are revisits of it; all else is a response. A null payload is empty. A null url has no target header. The date of a
    capture is FIRST_DATE plus as many seconds as its id says. Rows without an id have the record id of "null": they never
    are what a revisit refers to while a row with an id has the payload. Repeated rows give repeated records.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))}
    )
    # Only payloads that come up twice or more: the table has a row for each group of copies.
    first = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.max("id").alias("rep"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("rep").isNotNull())
    first = written(first.withColumnRenamed("digest", "copied"), "copies")
    # Short payloads have no key, so empty pages meet nobody.
    rows = look_up(rows, F.when(F.col("bytes") >= LEAST_BYTES, F.col("digest")), first, "copied", "n", F.col("id"))
    revisit = F.col("rep").isNotNull() & ~F.col("id").eqNullSafe(F.col("rep"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    second = F.unix_seconds(F.lit(FIRST_DATE).cast("timestamp")) + F.coalesce(F.col("id"), F.lit(0))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit(EOL))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("rep"))))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
    )
    records = rows.select(F.concat(head, block, F.lit(EOL * 2)).cast("binary").alias("value"))
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held = 0
        for b in batches:
            parts, members = [], []
            for record in b.column(0):
                # The writer ends each value with the line end that is set, which is one zero byte here. A member ends
                # with its size, so with a zero byte if that is under 16 MB; else an empty member follows that does.
                data = gzip.compress(record.as_buffer(), 6, mtime=0)
                data = data[:-1] if not data[-1] else data + gzip.compress(b"", mtime=0)[:-1]
                parts.append(part)
                members.append(data)
                held += len(data) + 1
                if held >= file_bytes:
                    part, held = part + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(members, pa.binary())], names=["part", "value"])

    members = records.mapInArrow(run, "part int, value binary").select("part", F.col("value").cast("string").alias("value"))
    members.write.partitionBy("part").option("lineSep", "\0").option("compression", "none").text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, opened one after the other; empty ones count to what is before them."""
    view, at, now = memoryview(data), 0, None
    while at < len(view):
        opened, parts, end = zlib.decompressobj(31), [], at
        while not opened.eof and end < len(view):
            parts.append(opened.decompress(view[end : end + 65536]))
            end += len(view[end : end + 65536])
        if not opened.eof:
            raise ValueError(f"the member at {at} has no end")
        end -= len(opened.unused_data)
        content = b"".join(parts)
        if content or now is None:
            if now is not None:
                yield now
            now = at, end - at, content
        else:
            now = now[0], end - now[0], now[2]
        at = end
    if now is not None:
        yield now


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(EOL)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it should")
        yield at, stop + 4 - at, headers, data[start:stop]
        at = stop + 4


CAPTURE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("run", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below ``path``; offset and length are those of its gzip member in the file.

    A file is one binary value of at most 2 GB; its records are opened one at a time. The payload's size and digest are those of the payload read, and for revisits, which have none, those in its headers. With
    payloads, a binary column ``payload`` holds it, null for revisits.
    """
    prepare(spark)
    fields = CAPTURE.fields + ([T.StructField("payload", T.BinaryType())] if payloads else [])

    def number(uri: str | None) -> int | None:
        text = (uri or "").strip("<>").removeprefix(RECORD_ID)
        return int(text) if text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.name for f in fields])

        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())] for f in fields]
        for b in batches:
            for name, content in ((x.as_py(), y.as_buffer()) for x, y in zip(b.column(0), b.column(1))):
                rows = []
                for at, size, (_, _, h, block) in ((at, size, x) for at, size, record in members(content) for x in parse_warc(record)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    revisit = h["warc-type"] == "revisit"
                    if revisit:
                        http = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
                        n, digest = int(http[b"content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    else:
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if h["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{name}: the payload at {at} isn't what its digest says")
                    row = (number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-date"], n, digest, h["warc-type"], number(h.get("warc-refers-to")) if revisit else None, name, at, size)
                    rows.append(row + ((None if revisit else payload,) if payloads else ()))
                    if len(rows) == (10 if payloads else 1000):
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, T.StructType(fields))


def url_key(url):
    """Sort key of a URL: host labels from the last to the first, then path and query; scheme, port and fragment don't count."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rest = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


class LoserTree:
    """Merges sorted runs, which are iterators: each inner node keeps the loser of its match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.n = max(1, len(runs))
        self.loser = [-1] * self.n
        for k in range(len(runs)):
            self._replay(k)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an empty place wins while the tree fills, a finished run loses."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return x < y or (x == y and a < b)

    def _replay(self, k: int) -> None:
        winner, node = k, (k + self.n) // 2
        while node:
            if self._before(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            k = self.loser[0]
            if self.head[k] is None:
                return
            yield self.head[k]
            self.head[k] = next(self.runs[k], None)
            self._replay(k)


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures (page_id, url, date, run and more) with url_key and history_rank, the place in the order by URL key, date and id.

    Null ids come first; records that are equal in all three are in order of their run and offset. A range holds about
    range_rows captures as Arrow columns, also of a URL that many have, as ranges are cut by all of the order; keys are
    Python values only where a cursor is.
    """
    spark = captures.sparkSession
    prepare(spark)
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    # Range bounds come from Spark's sample; each range then holds a sorted part of every run.
    order = ["url_key", "date", "page_id", "run", "offset"]
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order[:3], "offset").withColumn("part", F.spark_partition_id())
    names = dealt.columns
    at = {c: names.index(c) for c in (*order, "part")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.select([at[c] for c in order])
        runs = keys.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]

        def cursor(a: int, e: int) -> Iterator[tuple]:
            for x in range(a, e, CURSOR_ROWS):
                part = keys.slice(x, min(CURSOR_ROWS, e - x))
                for place, (key, date, page, name, offset) in enumerate(zip(*(c.to_pylist() for c in part.columns)), x):
                    yield key, date, page is not None, page or 0, name, offset, place

        merged = np.fromiter(map(itemgetter(-1), LoserTree([cursor(a, e) for a, e in zip(cuts, cuts[1:])])), np.int64, len(runs))
        for x in range(0, len(merged), 10_000):
            rows = merged[x : x + 10_000]
            out = whole.take(pa.array(rows)).append_column("pos", pa.array(np.arange(x, x + len(rows))))
            yield from out.combine_chunks().to_batches()

    merged = written(dealt.mapInArrow(run, T.StructType(dealt.schema.fields + [T.StructField("pos", T.LongType())])), "captures")
    # One number for each range: how many captures the ranges before it hold.
    starts, before = [], 0
    for r in sorted(merged.groupBy("part").count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["count"]
    offset = spark.createDataFrame(starts, "part int, first long") if starts else spark.createDataFrame([], "part int, first long")
    return merged.join(F.broadcast(offset), "part").withColumn("history_rank", F.col("first") + F.col("pos") + 1).drop("part", "pos", "first")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "barloom/warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = written(read_warc(spark, path), "runs")
    return merge_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_rank")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS rep FROM p
), k AS (
  SELECT *, array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '.')), ',') || ')'
    || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS url_key FROM r
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN rep IS NOT NULL AND rep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN rep IS NOT NULL AND rep <> page_id THEN rep END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, page_id) AS history_rank
FROM k
"""
