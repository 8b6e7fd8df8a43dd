"""WARC archives: a writer for pages, and a Python data source that reads them.

Writing goes through Spark's text writer, whose line separator is the two line ends that close a WARC record; so it
works on every file system that Spark knows and a lost task is simply written again. Of records with equal payloads of
at least `min_revisit_bytes`, the one with the largest id is the response and the others are revisits without a body;
which ones these are is settled by payload digest and length before the records are made, so no payload is shuffled
unless the list of repeated digests outgrows a broadcast.

Reading: files are dealt into partitions of about `partition_bytes`. Headers are parsed first; record-type and header
predicates (equality or IN on record_type, record_id, target_uri, payload_digest, refers_to) are pushed into the
scan, and the body of a record that is filtered out, or of any record with payload=false, is skipped by a seek and
never decoded. Files that end in .gz are read as a stream.

Defined cases: a null payload counts as empty; a null address leaves out WARC-Target-URI and reads as null; line ends in
an address are percent-encoded. Ids must not be null. Rows that repeat an id are written each; if they hold the
largest id of their payload, all are responses. Empty tables write no record and read as an empty table.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vectrill.llm import _common as common

_CRLF = "\r\n"
_PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_length", T.LongType()),
    T.StructField("refers_to", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
])
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
    ("payload_length", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


# --- writing --------------------------------------------------------------------------------


def write_pages(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_a_file: int = 100_000,
) -> None:
    """Writes one record for each row to files under path."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "length": F.octet_length("body").cast("long")})
    long = rows.where(F.col("length") >= min_revisit_bytes).groupBy("digest", "length").agg(F.max("order").alias("response"), F.count("*").alias("n"))
    # Written first, so that its size is known when the join is planned: broadcast if small, else a shuffled join.
    repeated = common.materialize(long.where("n > 1").select("digest", "length", "response"), "payloads")
    rows = rows.join(repeated, ["digest", "length"], "left")
    revisit = F.col("response").isNotNull() & (F.col("order") != F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("length"), F.lit(_CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), F.col("id"), F.lit(f">{_CRLF}WARC-Date: {date}{_CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), address, F.lit(_CRLF)), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _CRLF + "WARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(">" + _CRLF))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), F.octet_length(block), F.lit(_CRLF * 2),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_a_file).text(path)


# --- reading --------------------------------------------------------------------------------


@dataclass
class FileGroup(InputPartition):
    """Some whole files."""

    files: tuple[str, ...]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Input:
    """Buffered reads and cheap skips over a seekable file or a stream."""

    def __init__(self, path: str, chunk: int = 1 << 20) -> None:
        system, name = _file_system(path)
        self.seekable = not path.endswith(".gz")
        self.file = system.open_input_file(name)
        if not self.seekable:
            self.file = gzip.GzipFile(fileobj=self.file)
        self.held, self.at, self.chunk = b"", 0, chunk

    def _more(self, n: int) -> bool:
        got = self.file.read(max(n, self.chunk))
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark, which is passed over; all the rest if the mark is missing."""
        start = self.at
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more(0):
                out, self.at = self.held[self.at :], len(self.held)
                return out
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more(n - len(self.held) + self.at):
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        if len(out) < n:
            raise ValueError("a WARC record is cut short")
        return out

    def skip(self, n: int) -> None:
        beyond = n - (len(self.held) - self.at)
        if beyond <= 0 or not self.seekable:
            self.take(n)
        else:
            self.file.seek(self.file.tell() + beyond)
            self.held, self.at = b"", 0


def _headers(block: bytes) -> list[tuple[str, str]]:
    lines = block.decode("utf-8", "replace").split(_CRLF)
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]


def read_records(path: str, predicates: dict[str, frozenset], with_payload: bool) -> Iterator[dict]:
    """The records of a file that pass the predicates (field: allowed values)."""
    source = _Input(path)
    while True:
        block = source.until(b"\r\n\r\n").lstrip(b"\r\n")
        if not block:
            if source.at >= len(source.held) and not source._more(0):
                return
            continue
        if not block.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start in {path}")
        head = _headers(block)
        low = {k.lower(): v for k, v in head}
        size = int(low["content-length"])
        digest = low.get("warc-payload-digest", "")
        row = {
            "record_id": low.get("warc-record-id", "").strip("<>") or None, "record_type": low.get("warc-type"), "target_uri": low.get("warc-target-uri"),
            "date": low.get("warc-date"), "payload_digest": digest.rpartition(":")[2] or None, "refers_to": low.get("warc-refers-to", "").strip("<>") or None,
            "headers": head, "payload": None, "payload_length": size,
        }
        if any(row[k] not in v for k, v in predicates.items()):
            source.skip(size)
            continue
        if low.get("content-type", "").startswith("application/http") and size:
            http = source.until(b"\r\n\r\n")
            size -= len(http) + 4
            row["payload_length"] = int(next((v for k, v in _headers(http) if k.lower() == "content-length"), size))
        if with_payload and row["record_type"] != "revisit":
            row["payload"] = source.take(size)
        else:
            source.skip(size)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("the warc format needs a path")
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.predicates: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in _PUSHED:
                yield f
                continue
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
            self.predicates[name] = self.predicates[name] & values if name in self.predicates else values

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, name = _file_system(self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else "file://"
        info = system.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        groups, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if held and size + x.size > self.partition_bytes:
                groups.append(FileGroup(tuple(held)))
                held, size = [], 0
            held.append(prefix + x.path)
            size += x.size
        return [*groups, FileGroup(tuple(held))]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path in partition.files:
            for row in read_records(path, self.predicates, self.with_payload):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", partition_bytes).load(path)
