"""WARC archives as a table of chunks.

A payload never has to fit into memory as one record: the writer cuts it into rows
of (record id, chunk number), and each row becomes a WARC segment of its own - the
first a `response`, the others `continuation` records, as WARC 1.1 lays down. The
reader gets the archive in pieces, and carries an incremental SHA-256 from chunk to
chunk, so it holds one chunk at a time.

Files are written and read by Spark's text source, with the blank line that ends a
WARC record as separator, so they may lie in any store that Spark reaches. They are
compressed as a whole, and then are read in order by one task each. A file is never cut
by a number of rows: all segments of a record lie in one file, one after another.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.session import cut_lineage, new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 64 << 10
LEAST_REVISIT_BYTES = 100
# Fixed values of the format.
CRLF = "\r\n"
BLANK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record_id string, chunk int, type string, target_uri string, refers_to string, digest string, data binary"
RECORDS = (
    "record_id string, type string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, stated_digest string, chunks int"
)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, data, bytes, digest of every page; a null html is an empty payload."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", data.alias("data")).select(
        "*", F.length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("digest")
    )


def revisits(found: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page with a smaller id has.

    Only ids and digests are moved. A payload that a third of the pages share is one
    row after the map-side minimum; the join back to it may be split, as only its
    left side is large.
    """
    keys = cut_lineage(found.where(F.col("bytes") >= least).select("page_id", "digest"))
    firsts = (
        keys.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
        .where("_n > 1 and refers_to is not null")
        .select("digest", "refers_to")
    )
    return keys.join(firsts, "digest").where("page_id <> refers_to").distinct()


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """One row per chunk of each record: page_id, url, bytes, digest, refers_to, chunk, chunks, data.

    A revisit has a single chunk without data. Chunks of a record follow each other.
    A page without id is never the one that others refer to, and never a revisit.
    """
    found = payloads(pages)
    again = revisits(found, least).select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"
    )
    joined = found.join(again, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    size = F.when(F.col("refers_to").isNotNull(), 1).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    )
    part = F.substring(F.col("data"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return (
        joined.withColumn("chunks", size)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("data", F.when(F.col("refers_to").isNull(), part).otherwise(F.lit(b"")))
        .drop("_page", "_digest")
    )


def _record_id(page: Column, chunk: Column) -> Column:
    name = F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")))
    return F.concat(name, F.when(chunk > 0, F.concat(F.lit("#"), chunk.cast("string"))).otherwise(""), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def record_text(date: str) -> Column:
    """The WARC record of a chunk row, without the blank line that ends it."""
    first, revisit = F.col("chunk") == 0, F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BLANK),
    )
    block = F.concat(F.when(first, http).otherwise("").cast("binary"), F.col("data"))
    cut, last = F.col("chunks") > 1, F.col("chunk") == F.col("chunks") - 1
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    fields = [
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("chunk"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.when(first, uri)),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("_block", 256))),
        _field("WARC-Profile", F.when(first & revisit, F.lit(REVISIT_PROFILE))),
        _field("WARC-Refers-To", F.when(first, _record_id(F.col("refers_to"), F.lit(0)))),
        _field("WARC-Segment-Number", F.when(cut, (F.col("chunk") + 1).cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, _record_id(F.col("page_id"), F.lit(0)))),
        _field("WARC-Segment-Total-Length", F.when(cut & last, (F.col("bytes") + F.length(http)).cast("string"))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
    ]
    # The id of a null page is "null"; refers_to of a response must stay away.
    fields[7] = F.when(revisit, fields[7])
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(f, F.lit("")) for f in fields])
    length = F.concat(F.lit("Content-Length: "), F.length("_block").cast("string"), F.lit(BLANK))
    return block, F.concat(F.concat(head, length).cast("binary"), F.col("_block"))


def write_archives(
    pages: DataFrame,
    path: str,
    chunk_bytes: int = CHUNK_BYTES,
    least: int = LEAST_REVISIT_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write page_id, url, html as gzipped WARC files; the pages have no date of their own."""
    block, text = record_text(date)
    rows = chunk_table(pages, chunk_bytes, least).withColumn("_block", block).select(text.cast("string").alias("value"))
    # 0 is no limit, whatever the session says: a limit would cut records between their segments.
    rows.write.option("maxRecordsPerFile", 0).text(path, compression="gzip", lineSep=BLANK)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between blank lines, in file order. A compressed file is never split."""
    return (
        spark.read.text(path, lineSep=BLANK)
        .withColumn("file", F.col("_metadata.file_path"))
        .select("file", F.col("value").cast("binary").alias("piece"))
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CHUNKS from gzipped archives: what was stored of each payload, chunk by chunk."""
    return _pieces(spark, path).mapInArrow(_to_chunks, CHUNKS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORDS, one for each response or revisit.

    Length and digest are those of the full payload: for a response taken from what was
    read, for a revisit as its headers state them.
    """
    return _pieces(spark, path).mapInArrow(_to_records, RECORDS)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back, and return a row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, chunks, intact.
    Null html counts as empty; repeated rows of a page are records of their own; a page
    without id stays a response; other columns are ignored; no pages give no rows.
    `intact` says whether the digest of what was read is the one stated at writing.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    page = r"^<urn:page:(-?\d+)>$"
    return read_archives(spark, path).select(
        F.regexp_extract("record_id", page, 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", page, 1).try_cast("long").alias("refers_to"),
        "target_uri",
        "chunks",
        (F.col("stated_digest") == F.concat(F.lit("sha256:"), F.col("payload_digest"))).alias("intact"),
    )


class _Parser:
    """Records of one archive from its bytes, given bit by bit; holds one header or piece at most.

    Yields (headers, chunk number, data) for each piece of payload, and data None at a record's end.
    """

    def __init__(self):
        self.head, self.headers, self.left, self.skip, self.http, self.chunk = b"", None, 0, 0, False, 0

    def feed(self, data):
        at = 0
        while at < len(data):
            if self.skip:
                step = min(self.skip, len(data) - at)
                self.skip, at = self.skip - step, at + step
            elif self.headers is None:
                at = yield from self._header(data, at)
            else:
                step = min(self.left, len(data) - at)
                yield from self._body(data[at : at + step])
                self.left, at = self.left - step, at + step
                if not self.left:
                    yield from self._end()

    def _header(self, data, at):
        # Line ends before a record are none of it, such as what follows the last one of a file.
        while not self.head and at < len(data) and data[at] in b"\r\n":
            at += 1
        before = len(self.head)
        self.head += data[at:]
        end = self.head.find(b"\r\n\r\n", max(0, before - 3))
        if end < 0:
            return len(data)
        lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left, self.chunk, self.head = int(self.headers["content-length"]), 0, b""
        self.http = self.headers.get("content-type", "").startswith("application/http")
        if not self.left:
            yield from self._end()
        return at + end + 4 - before

    def _body(self, data):
        if self.http:
            before = len(self.head)
            self.head += data
            end = self.head.find(b"\r\n\r\n", max(0, before - 3))
            if end < 0:
                return
            for line in self.head[:end].decode("latin-1").split("\r\n"):
                name, _, value = line.partition(":")
                if name.lower() == "content-length":
                    self.headers["payload-length"] = value.strip()
            data, self.head, self.http = self.head[end + 4 :], b"", False
        if data:
            yield self.headers, self.chunk, data
            self.chunk += 1

    def _end(self):
        yield self.headers, self.chunk, None
        self.headers, self.skip, self.head = None, 4, b""


def _parsed(batches):
    """(headers, chunk number, data) over all files of a task, one after another.

    A continuation must follow its own record in the same file; any other is an error.
    """
    parser, last, record = None, None, None
    for batch in batches:
        for file, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if file != last:
                parser, last, record = _Parser(), file, None
            for headers, chunk, data in parser.feed(piece.as_py() + b"\r\n\r\n"):
                if headers.get("warc-type") != "continuation":
                    record = headers.get("warc-record-id")
                elif record is None or headers.get("warc-segment-origin-id") != record:
                    raise ValueError(f"{file}: {headers.get('warc-record-id')} does not follow its record")
                yield headers, chunk, data


def _tables(rows, names, types, size=2000, most=16 << 20):
    """Arrow batches of so many rows or bytes."""
    import pyarrow as pa

    def batch(held):
        arrays = [pa.array(c, t) for c, t in zip(zip(*held), types)]
        return pa.RecordBatch.from_arrays(arrays, names)

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= size or weight >= most:
            yield batch(held)
            held, weight = [], 0
    if held:
        yield batch(held)


def _origin(headers):
    return headers.get("warc-segment-origin-id") or headers.get("warc-record-id")


def _to_chunks(batches):
    import pyarrow as pa

    def rows():
        record, number = None, 0
        for headers, _, data in _parsed(batches):
            if _origin(headers) != record or (headers.get("warc-type") != "continuation" and data is None):
                record, number = _origin(headers), 0 if data is not None else number
            if data is None:
                continue
            kind, uri = headers.get("warc-type"), headers.get("warc-target-uri")
            refers, digest = headers.get("warc-refers-to"), headers.get("warc-payload-digest")
            yield record, number, kind, uri, refers, digest, data
            number += 1

    text = pa.string()
    names = ["record_id", "chunk", "type", "target_uri", "refers_to", "digest", "data"]
    yield from _tables(rows(), names, [text, pa.int32(), text, text, text, text, pa.binary()])


def _to_records(batches):
    import hashlib

    import pyarrow as pa

    def finished(headers, size, digest, chunks):
        stated = headers.get("warc-payload-digest")
        kind = headers.get("warc-type")
        if kind == "revisit":
            size, digest = int(headers.get("payload-length", 0)), (stated or "").removeprefix("sha256:")
        else:
            digest = digest.hexdigest()
        uri, refers = headers.get("warc-target-uri"), headers.get("warc-refers-to")
        return headers.get("warc-record-id"), kind, uri, refers, size, digest, stated, chunks

    def rows():
        first, size, digest, chunks = None, 0, None, 0
        for headers, _, data in _parsed(batches):
            if headers is not first and headers.get("warc-type") != "continuation":
                if first is not None:
                    yield finished(first, size, digest, chunks)
                first, size, digest, chunks = headers, 0, hashlib.sha256(), 0
            if data is not None:
                digest.update(data)
                size += len(data)
                chunks += 1
        if first is not None:
            yield finished(first, size, digest, chunks)

    text = pa.string()
    names = [
        "record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "chunks",
    ]
    types = [text, text, text, text, pa.int64(), text, text, pa.int32()]
    yield from _tables(rows(), names, types)
