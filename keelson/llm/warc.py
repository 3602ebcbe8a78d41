"""WARC archives: a writer in plain Spark SQL and a Python data source.

Writing: a record is a string (headers, blank line, block), and WARC ends
every record with two line breaks, which is what Spark's text writer puts
after a row; so archives are written by the JVM to any store that Spark
writes. Payloads that repeat become ``revisit`` records that name the first
one's record; their block has no payload.

Reading: ``read_warc``, or ``spark.read.format("warc").load(path)`` with a path
that names its scheme. Every file is a partition
(files are bounded by the writer); predicates on the headers are pushed down
and tested on the parsed headers; the block of a record that fails them, or
whose payload isn't wanted (option ``payload`` = ``false``), is skipped by its
length without being decoded. Files ending in .gz are read as gzip members.
The path is qualified by the driver, as Spark's readers do it, and the tasks
open the files through pyarrow; a store that pyarrow lacks is refused.

Broken archives stop the read and name the file: a line that begins no record
where one should, headers without an end, a Content-Length that is missing or
no number, a record that ends before its length (skipped or not). A block of
HTTP type without an empty line has no HTTP header, so all of it is payload.

Defined results: a null payload is empty; a null url has no target header, and
line breaks in it are percent-encoded; a null page id counts as the largest
(and is written as ``none``), and among equal payloads all rows with the
smallest id are responses; empty tables make no records.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, IsNull, Not, StringStartsWith)

from keelson.sources.stores import open_store, qualify

from .common import cut, ensure_checkpoint_dir, prepare, read, settings

LEAST_BYTES = 100         # smaller payloads are never revisits
FILE_RECORDS = 20_000     # records of an archive file at most
END = "\r\n"
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "

#: Column -> header.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"


# --- writing --------------------------------------------------------------------------------

def records(pages: DataFrame, key: str, url: str, payload: str, date: str) -> DataFrame:
    """One column, value: the record of every row, without its two last line breaks."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    # the digests that repeat are written first: Spark then knows their size,
    # and where it is small, payloads needn't be shuffled to meet them
    same = cut(rows.select("id", "digest", "size").filter(F.col("size") >= LEAST_BYTES)
               .groupBy(F.unhex("digest").alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
               .select("d", "first"))
    rows = rows.join(same, F.unhex("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")

    def record_id(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    return rows.select(F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(again, record_id(F.col("first")))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive files of at most ``FILE_RECORDS`` records under ``path``."""
    (records(pages, key, url, payload, date).write.option("lineSep", END + END)
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


# --- reading --------------------------------------------------------------------------------

class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    """Parses headers first; looks at a block only if the headers pass."""

    def __init__(self, options: dict[str, str], schema) -> None:
        self.options, self.columns = dict(options), [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []
        self.payload = self.options.get("payload", "true").lower() != "false" and "payload" in self.columns

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            negative = isinstance(f, Not)
            inner = f.child if negative else f
            column = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(inner, (EqualTo, EqualNullSafe)) and inner.value is not None:
                self.tests.append((column, "not in" if negative else "in", [inner.value]))
            elif isinstance(inner, In) and None not in inner.value:
                self.tests.append((column, "not in" if negative else "in", list(inner.value)))
            elif isinstance(inner, StringStartsWith) and not negative:
                self.tests.append((column, "starts", inner.value))
            elif isinstance(inner, (IsNull, IsNotNull)):
                self.tests.append((column, "null" if isinstance(inner, IsNull) != negative else "not null", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        uri = self.options["path"]
        store, root = open_store(uri)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        prefix = uri[: uri.rindex(root)]  # scheme, and what of the authority isn't part of pyarrow's paths
        return [WarcFile(prefix + f.path) for f in sorted(files, key=lambda f: -f.size)]  # the largest first

    def passes(self, head: dict[str, str]) -> bool:
        for column, what, want in self.tests:
            got = head.get(HEADERS[column].lower())
            if what == "null" or what == "not null":
                ok = (got is None) == (what == "null")
            else:  # a comparison with null is never true
                ok = got is not None and (got.startswith(want) if what == "starts" else (got in want) == (what == "in"))
            if not ok:
                return False
        return True

    def read(self, partition: WarcFile | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no files, so no partitions
            return
        types = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in self.columns])
        rows: dict[str, list] = {c: [] for c in self.columns}
        held = 0
        for head, payload in self.scan(partition.path):
            for c in self.columns:
                rows[c].append(payload if c == "payload" else head.get(HEADERS[c].lower()))
            held += 500 + len(payload or b"")
            if held > 4_000_000:
                yield pa.RecordBatch.from_pydict(rows, types)
                rows, held = {c: [] for c in self.columns}, 0
        if held:
            yield pa.RecordBatch.from_pydict(rows, types)

    def scan(self, path: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers and payload of the records that pass."""
        store, inner = open_store(path)
        with store.open_input_file(inner) as raw:
            if path.endswith(".gz"):
                with gzip.open(raw) as f:
                    yield from self.parse(_Buffered(f), path)
            else:
                yield from self.parse(_Buffered(raw, raw.size()), path)

    def parse(self, f, path: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue  # the line breaks between records
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one should begin: {line[:60]!r}")
            head: dict[str, str] = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            name = head.get("warc-record-id")
            if not line:
                raise ValueError(f"{path}: cut off in the headers of {name}")
            length = head.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                raise ValueError(f"{path}: {name} has no Content-Length: {length!r}")
            size, wanted = int(length), self.passes(head)
            block = f.read(size) if wanted and self.payload else None
            if (f.skip(size) if block is None else len(block)) < size:
                raise ValueError(f"{path}: cut off in {name}")
            if block is not None and "http" in head.get("content-type", ""):
                http, end, body = block.partition(b"\r\n\r\n")
                block = body if end else http
            if wanted:
                yield head, block


class _Buffered:
    """Lines, blocks and skips of a file, read in large pieces. With the file's
    size known, a skip moves on without reading; else (gzip) it reads."""

    def __init__(self, raw, size: int | None = None, piece: int = 1 << 20):
        self.raw, self.size, self.piece, self.data, self.at = raw, size, piece, b"", 0

    def _more(self) -> bool:
        got = self.raw.read(self.piece)
        self.data, self.at = self.data[self.at:] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.data) - 1
                break
        line = self.data[self.at:end + 1]
        self.at = end + 1
        return line

    def read(self, size: int) -> bytes:
        have = self.data[self.at:self.at + size]
        self.at += len(have)
        return have if len(have) == size else have + self.raw.read(size - len(have))

    def skip(self, size: int) -> int:
        """Leaves out ``size`` bytes; how many of them there were."""
        have = min(size, len(self.data) - self.at)
        self.at += have
        if have == size:
            return size
        self.data, self.at = b"", 0
        if self.size is not None:
            at = self.raw.tell()
            end = min(self.size, at + size - have)
            self.raw.seek(end)
            return have + end - at
        while have < size and (got := len(self.raw.read(min(self.piece, size - have)))):
            have += got
        return have


class WarcDataSource(DataSource):
    """``format("warc")``; options: path, payload (false: payloads are null and never read)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, where=None, payload: bool = True) -> DataFrame:
    """The records under ``path`` that meet ``where`` (a condition on header
    columns is pushed down). Spark 4.1 keeps the predicates that a query pushes
    into a loaded source for the queries after it, so call this anew for
    another condition and don't filter one result in two ways."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    found = spark.read.format("warc").option("payload", json.dumps(payload)).load(qualify(spark, path))
    return found if where is None else found.filter(where)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as archives and read back. Responses are read with
    their payloads, whose size and digest are taken anew; revisits by headers."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        write_warc(pages, path)

    def number(c: str):
        return F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    found = read_warc(spark, path, F.col("record_type") == "response").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, F.col("record_type") == "revisit", payload=False).select(
        number("record_id").alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return found.union(again)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_BYTES} GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
