"""Collections kept as versioned Parquet: reads, upserts, deletes, snapshots, change log, backups."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The outer schema of a collection; payloads are columns of their own or one VARIANT.
RECORD = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampType()),
])


# --- relational forms -----------------------------------------------------------------------


def point_get(df: DataFrame, key, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == F.lit(key))


def batch_get(df: DataFrame, ids: DataFrame, id_col: str = "id", order_col: str = "ord", placeholders: bool = True) -> DataFrame:
    """Rows in the order asked for, (ord, id) in ids; what is missing is a row of nulls, or left out without placeholders."""
    return ids.select(order_col, id_col).join(df, id_col, "left" if placeholders else "inner").orderBy(order_col)


def exists(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    known = df.select(id_col, F.lit(True).alias("found")).distinct()
    return ids.join(known, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def upsert(df: DataFrame, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The last write of each id, by seq; rows of df count as older than all changes."""
    both = df.withColumn(seq_col, F.lit(-1).cast("bigint")).unionByName(changes.withColumn(seq_col, F.col(seq_col).cast("bigint")))
    newest = both.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(seq_col))))
    return newest.where("_n = 1").drop("_n", seq_col)


def delete(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")


def replay(log: DataFrame, id_col: str = "id", seq_col: str = "seq", op_col: str = "op") -> DataFrame:
    """What a change log (insert, delete, checkpoint in order of seq) leaves: the last insert of each id that no later delete takes away.
    What precedes the last checkpoint is no longer replayed."""
    start = log.agg(F.max(F.when(F.col(op_col) == "checkpoint", F.col(seq_col))).alias("_from"))
    live = log.crossJoin(F.broadcast(start)).where(F.col("_from").isNull() | (F.col(seq_col) > F.col("_from"))).where(F.col(op_col) != "checkpoint").drop("_from")  # one row
    last = live.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(seq_col))))
    return last.where((F.col("_n") == 1) & (F.col(op_col) != "delete")).drop("_n")


def retention(backups: DataFrame, now, keep: int = 10, days: int = 7, ts_col: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest `keep` backups that are at most `days` old; among equally old ones those that come last by `ties`."""
    recent = backups.where(F.col(ts_col) > F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
    return recent.orderBy(F.desc(ts_col), *(F.desc(c) for c in ties)).limit(keep)


# --- validation -----------------------------------------------------------------------------


def valid_vector(id_: Column, v: Column) -> Column:
    """Has an id and no NaN; an empty vector is allowed."""
    return F.coalesce(id_.isNotNull() & (F.length(id_.cast("string")) > 0) & v.isNotNull() & ~F.exists(v, lambda x: F.isnan(x)), F.lit(False))


def valid_id(id_: Column) -> Column:
    """1 to 1024 printable ASCII characters."""
    return F.coalesce(id_.rlike("^[ -~]{1,1024}$"), F.lit(False))


def valid_dimension(v: Column, size: int) -> Column:
    return F.coalesce(F.size(v) == size, F.lit(False))


def valid_batch(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row: valid if there are rows and all vectors have one length."""
    return df.agg((F.count("*") > 0).alias("_some"), F.count_distinct(F.size(vector_col)).alias("_sizes")).select((F.col("_some") & (F.col("_sizes") <= 1)).alias("valid"))


def check_search_options(k: int, ef: int = 100) -> None:
    if not 0 < k <= 10_000 or not 0 < ef <= 100_000:
        raise ValueError("k must be from 1 to 10000 and ef from 1 to 100000")


def check_config(dimension: int, m: int = 16, ef_construction: int = 200) -> None:
    if not 0 < dimension <= 10_000 or not 0 < m <= 128 or not 0 < ef_construction <= 1000:
        raise ValueError("dimension must be at most 10000, m at most 128, ef_construction at most 1000")


def insert_validated(df: DataFrame, size: int, id_col: str = "id", vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, one row of counts: success, failed)."""
    ok = valid_vector(F.col(id_col), F.col(vector_col)) & valid_dimension(F.col(vector_col), size)
    counts = df.agg(F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("success"), F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("failed"))
    return df.where(ok), counts


# --- versions on disk -----------------------------------------------------------------------


class VersionedStore:
    """A table in versions: each write is a new folder, and a pointer file names the current one.

    Readers of an older version are not disturbed; a write that fails leaves the pointer as it was.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id") -> None:
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def put(self, changes: DataFrame, seq_col: str = "seq") -> int:
        if seq_col not in changes.columns:
            changes = changes.withColumn(seq_col, F.monotonically_increasing_id())
        return self.write(upsert(self.read(), changes, self.id_col, seq_col) if self.versions() else upsert(changes.drop(seq_col).limit(0), changes, self.id_col, seq_col))

    def delete(self, ids: DataFrame) -> int:
        return self.write(delete(self.read(), ids, self.id_col))

    def count(self) -> int:
        return self.read().count() if self.versions() else 0

    def drop_version(self, version: int) -> None:
        fs, target = self._fs(f"{self.path}/v{version}")
        fs.delete(target, True)


class BackupManager:
    """Snapshots of a DataFrame as folders with a line of facts beside them; old ones go by count and age."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 10, days: int = 7) -> None:
        self.spark, self.path, self.keep, self.days = spark, path.rstrip("/"), keep, days

    def create(self, df: DataFrame, description: str = "", now: dt.datetime | None = None) -> str:
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        name = f"backup_{now:%Y%m%d_%H%M%S}"
        df.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        facts = {"name": name, "ts": now.isoformat(sep=" "), "vector_count": self.spark.read.parquet(f"{self.path}/data/{name}").count(), "description": description}
        self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/facts/{name}")
        self.prune(now)
        return name

    def list(self) -> DataFrame:
        fields = "name string, ts timestamp, vector_count bigint, description string"
        store = VersionedStore(self.spark, self.path)
        fs, root = store._fs(f"{self.path}/facts")
        if not fs.exists(root) or not fs.listStatus(root):
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).json(f"{self.path}/facts/*").orderBy(F.desc("ts"))

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def delete(self, name: str) -> None:
        store = VersionedStore(self.spark, self.path)
        for part in ("data", "facts"):
            fs, target = store._fs(f"{self.path}/{part}/{name}")
            fs.delete(target, True)

    def prune(self, now: dt.datetime) -> None:
        known = {r["name"] for r in self.list().collect()}
        kept = {r["name"] for r in retention(self.list(), now, self.keep, self.days).collect()}
        for name in known - kept:
            self.delete(name)
