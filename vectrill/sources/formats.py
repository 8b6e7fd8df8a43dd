"""Record formats: binary and JSON serializers, memory-mapped files, collection files, remote embeddings."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_TYPE = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("ts_ns", T.LongType())])

# The header of a memory-mapped file.
MMAP_MAGIC, MMAP_HEADER = 0x4D4D4150, 4096


def encode_record(id_: str, vector: list[float], ts_ns: int) -> bytes:
    """Length and bytes of the id, length and 32-bit floats of the vector, nanoseconds; all little-endian."""
    raw = id_.encode()
    return struct.pack("<I", len(raw)) + raw + struct.pack(f"<I{len(vector)}f", len(vector), *vector) + struct.pack("<q", ts_ns)


def decode_record(data: bytes, at: int = 0) -> tuple[str, list[float], int, int]:
    """(id, vector, nanoseconds, where the record ends)."""
    (n,) = struct.unpack_from("<I", data, at)
    id_ = data[at + 4 : at + 4 + n].decode()
    at += 4 + n
    (m,) = struct.unpack_from("<I", data, at)
    vector = list(struct.unpack_from(f"<{m}f", data, at + 4))
    at += 4 + 4 * m
    return id_, vector, struct.unpack_from("<q", data, at)[0], at + 8


@F.pandas_udf(T.BinaryType())
def to_binary(id_: pd.Series, vector: pd.Series, ts_ns: pd.Series) -> pd.Series:
    return pd.Series([encode_record(str(i), list(v), int(t)) for i, v, t in zip(id_, vector, ts_ns, strict=True)])


@F.pandas_udf(RECORD_TYPE)
def from_binary(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_record(bytes(x))[:3] for x in data], columns=["id", "vector", "ts_ns"])


@F.pandas_udf(T.LongType())
def record_checksum(id_: pd.Series, vector: pd.Series) -> pd.Series:
    """CRC-32 of the id's length, the id and the floats."""
    out = []
    for i, v in zip(id_, vector, strict=True):
        raw = str(i).encode()
        out.append(zlib.crc32(struct.pack("<I", len(raw)) + raw + struct.pack(f"<{len(v)}f", *v)))
    return pd.Series(out)


def payload_checksum(payload: Column) -> Column:
    return F.crc32(payload.cast("binary"))


def verify_checksum(df: DataFrame, checksum_col: str, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return df.withColumn("intact", record_checksum(F.col(id_col).cast("string"), F.col(vector_col)) == F.col(checksum_col))


def to_json_record(df: DataFrame) -> DataFrame:
    """Each row as JSON, typed fields and payload included."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json_record(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    return df.select(F.from_json("value", schema).alias("r")).select("r.*")


# --- memory-mapped files --------------------------------------------------------------------


def write_mmap(path: str, records: list[tuple[str, list[float], int]]) -> None:
    """A file of one process: header (magic, count, where data begins), then records."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IQQ", MMAP_MAGIC, len(records), MMAP_HEADER).ljust(MMAP_HEADER, b"\0"))
        for r in records:
            f.write(encode_record(*r))


def read_mmap(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, ts_ns) of all such files under path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                magic, count, at = struct.unpack_from("<IQQ", content)
                if magic != MMAP_MAGIC:
                    raise ValueError("not a memory-mapped collection")
                rows = []
                for _ in range(count):
                    id_, vector, ts, at = decode_record(content, at)
                    rows.append((id_, vector, ts))
                yield pd.DataFrame(rows, columns=["id", "vector", "ts_ns"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD_TYPE)


# --- collection files of the command line ---------------------------------------------------


def read_collection_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of {"config": ..., "vectors": [{"id", "vector"}]}, of a list of such objects, or of a single one."""
    item = "struct<id: string, vector: array<float>>"
    raw = spark.read.schema(f"config string, vectors array<{item}>, id string, vector array<float>").option("multiLine", True).json(path)
    each = F.when(F.col("vectors").isNotNull(), F.col("vectors")).otherwise(F.array(F.struct("id", "vector")))
    return raw.select(F.explode(each).alias("x")).select("x.id", "x.vector")


def write_collection_file(df: DataFrame, path: str, config: dict) -> None:
    """One JSON object with the rows (id, vector); for collections that one file can hold."""
    options = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    one = df.agg(F.collect_list(F.struct("id", "vector")).alias("vectors")).select(options.alias("config"), "vectors")
    one.coalesce(1).write.mode("overwrite").json(path)


# --- embeddings from elsewhere --------------------------------------------------------------


def embed(df: DataFrame, client: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "vector", batch: int = 64) -> DataFrame:
    """Adds client(texts), called for `batch` texts at a time in every task. The client is any function that pickles."""
    keep = df.drop(out)
    schema = T.StructType([*keep.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in client(texts[i : i + batch])]
            yield frame.assign(**{out: vectors})

    return keep.mapInPandas(run, schema)


class HttpEmbedding:
    """A client of an embeddings service: POST {url}/embeddings with a key; answers are put in order by their index."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 30.0) -> None:
        if not key:
            raise ValueError("an API key is needed")
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = Request(f"{self.url}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return [x["embedding"] for x in sorted(json.load(answer)["data"], key=lambda x: x["index"])]
