"""WARC archives: writing, and normalising monolithic gzip files to one member per record.

Writing: Spark's text writer makes one gzip stream per partition, so an archive has no points of entry.
The normaliser inflates each such file once, in order, rewrites every record as a gzip member of its
own and writes a sidecar index (<archive>.idx: offset, length, record type and id, one line per
record); the same rows come back as a table.  A reader then fetches single records by offset.

Revisits: of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest
page id holds the payload, the others name it.  Only payload digests and ids are shuffled for that;
the few that repeat are joined back, by broadcast where Spark finds them small enough, else by a
join that splits hot digests.

Archives are read as streams and normalised ones are written from the tasks through pyarrow.fs (file, s3, s3a, gs, abfss,
hdfs), under a temporary name that is renamed when complete; contents follow from the input alone, so a task that is run again replaces
its file by an equal one.

Edge cases: a null html is an empty payload; a null url has no WARC-Target-URI, line breaks in one are
percent-encoded; a null page id comes before all ids; equal rows with equal ids are all responses;
concatenated gzip streams are read through; a truncated or malformed record raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, key_or, new_path

MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the WARC standard
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NO_ID = -(1 << 63)


def _record_id(page: Column, digest: Column) -> Column:
    m = F.md5(F.concat_ws("/", F.lit("page"), page.cast("string"), digest).cast("binary"))
    parts = [F.substring(m, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_types(pages: DataFrame) -> DataFrame:
    """(page, url, payload, digest, size, first): first is the id of the record that holds an equal payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(key_or(F.col("page_id")).alias("page"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload"))
    groups = p.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(F.min("page").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1").select("d", "first"), "equal-payloads")
    return p.join(groups, F.col("digest") == F.col("d"), "left").drop("d")


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: each page's WARC record, without its last line feed."""
    p = with_types(pages)
    revisit = F.coalesce(F.col("first") != F.col("page"), F.lit(False))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    length = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("size") + len(HTTP_HEAD))
    page = F.when(F.col("page") != _NO_ID, F.col("page"))
    first = F.when(F.col("first") != _NO_ID, F.col("first"))
    return p.select(
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _record_id(page, F.col("digest"))), optional("WARC-Target-URI", url),
            F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", _record_id(first, F.col("digest"))))).otherwise(""),
            F.when(revisit, optional("X-Refers-To-Page", first.cast("string"))).otherwise(""),
            optional("X-Page", page.cast("string")), line("X-Payload-Length", F.col("size").cast("string")),
            F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", length.cast("string")),
            F.lit("\r\n" + HTTP_HEAD), F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r"),
        ).alias("value")
    )


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Archives of one gzip stream each, a file per partition."""
    records(pages).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Members:
    """The records of a gzip file (anything with ``read``), inflated once and in order; holds a record, not the file."""

    STEP = 1 << 16

    def __init__(self, file):
        self.file, self.rest, self.buf, self.z = file, b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        while data := self.rest or self.file.read(self.STEP):
            if self.z.eof:  # another gzip stream follows
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data)
            self.rest = self.z.unused_data
            if got:
                self.buf += got
                return True
        return False

    def _find(self, mark: bytes) -> int:
        begin = 0
        while (i := self.buf.find(mark, begin)) < 0:
            begin = max(0, len(self.buf) - len(mark) + 1)
            if not self._more():
                return -1
        return i

    def __iter__(self) -> Iterator[bytes]:
        while self.buf or self._more():
            end = self._find(b"\r\n\r\n")
            if end < 0 or not self.buf.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", bytes(self.buf[:end]))
            if not m:
                raise ValueError("a record without Content-Length")
            size = end + 4 + int(m[1]) + 4
            while len(self.buf) < size and self._more():
                pass
            if len(self.buf) < size or self.buf[size - 4 : size] != b"\r\n\r\n":
                raise ValueError("a record is truncated or longer than it says")
            yield bytes(self.buf[:size])
            del self.buf[:size]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, content) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())])
INDEX_DDL = "archive string, offset bigint, length bigint, record_type string, record_id string"


def _store(uri: str):
    """The file system of a URI, and the path in it; Spark's names of stores are taken as well."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^(file:)?/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri)


def _normalise(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for b in batches:
            for path in b.column(0).to_pylist():
                name = re.sub(r"(\.txt)?(\.gz)?$", "", path.rpartition("/")[2]) + ".warc.gz"
                temporary, rows, at = f"{root}/_{uuid.uuid4().hex}", [], 0
                source, place = _store(path)
                with source.open_input_stream(place, compression=None) as archive, store.open_output_stream(temporary, compression=None) as f:
                    for record in _Members(archive):
                        member, headers = _member(record), parse(record)[0]
                        f.write(member)
                        rows.append({"archive": f"{out}/{name}", "offset": at, "length": len(member), "record_type": headers["warc-type"], "record_id": headers["warc-record-id"]})
                        at += len(member)
                with store.open_output_stream(f"{temporary}.idx") as f:
                    f.write("".join(f"{r['offset']}\t{r['length']}\t{r['record_type']}\t{r['record_id']}\n" for r in rows).encode())
                store.move(temporary, f"{root}/{name}")
                store.move(f"{temporary}.idx", f"{root}/{name}.idx")
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return run


def normalise(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rewrites the archives under ``path`` to the folder ``out``; the index of all records."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop.Path(out))
    files = spark.read.format("binaryFile").load(path).select("path")  # the archives themselves are read as streams
    index = cut(files.mapInArrow(_normalise(out), INDEX_DDL), "warc-index")
    for left in store.globStatus(hadoop.Path(f"{out}/_*")) or []:  # of tasks that died
        store.delete(left.getPath(), False)
    return index


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, f = None, None
    number = lambda x: int(x) if x is not None else None
    for b in batches:
        rows = []
        for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if archive != name:
                if f:
                    f.close()
                store, path = _store(archive)
                name, f = archive, store.open_input_file(path)
            headers, content = parse(zlib.decompress(f.read_at(length, offset), 31))
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            payload = content.partition(b"\r\n\r\n")[2]
            if headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{archive} at {offset}: the payload's digest is wrong")
            size = int(headers["x-payload-length"]) if headers["warc-type"] == "revisit" else len(payload)
            rows.append(dict(zip(_READ.names, (number(headers.get("x-page")), size, digest, headers["warc-type"], number(headers.get("x-refers-to-page")), archive, offset, length), strict=True)))
        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
    if f:
        f.close()


def read(index: DataFrame) -> DataFrame:
    """Each indexed record, fetched by its offset and tested against its digest."""
    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
    return index.select("archive", "offset", "length").mapInArrow(_read, ddl)


def op1(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    raw, out = new_path(spark, "warc"), new_path(spark, "warc-members")
    write_monolithic(pages, raw)
    return confirmed(read(normalise(spark, raw, out))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def confirmed(found: DataFrame) -> DataFrame:
    """Records that were read; a revisit whose response isn't there with its digest and size raises an error."""
    found = cut(found, "warc-read")
    responses = found.where("record_type = 'response'").select(key_or(F.col("page_id")).alias("__page"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).distinct()
    revisits = found.where("record_type = 'revisit'")
    # by digest first, so that a popular response is split among tasks if need be
    j = revisits.join(responses, (F.col("payload_digest") == F.col("__digest")) & (key_or(F.col("refers_to")) == F.col("__page")), "left")
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no such response:"), "archive", F.lit("at"), "offset")).cast("bigint")
    j = j.withColumn("payload_bytes", F.when(F.col("payload_bytes") == F.col("__bytes"), F.col("payload_bytes")).otherwise(wrong))
    return found.where("record_type <> 'revisit'").unionByName(j.select(*found.columns))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
