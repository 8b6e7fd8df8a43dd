"""Vector compression: scalar, binary and product quantizers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.operators import kmeans, knn


def scalar_train(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row (lows, highs): every dimension's least and greatest value."""
    ranges = df.select(F.posexplode(F.col(vector_col)).alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ordered = ranges.agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("r"))
    return ordered.select(F.col("r.low").alias("lows"), F.col("r.high").alias("highs"))


def scalar_encode(v: Column, lows: Column, highs: Column, bits: int = 8) -> Column:
    """Codes 0..2**bits-1 by place within each dimension's range; the middle (0 for 32 bits) where the range is empty; null for another length."""
    levels = float(2**bits - 1)
    middle = 0 if bits == 32 else 2 ** (bits - 1)

    def code(x: Column, r: Column) -> Column:
        low, high = r["lows"].cast("double"), r["highs"].cast("double")
        value = F.floor((x.cast("double") - low) / F.nullif(high - low, F.lit(0.0)) * levels)
        return F.when(high > low, F.greatest(F.lit(0), F.least(F.lit(int(levels)).cast("bigint"), value))).otherwise(F.lit(middle)).cast("bigint")

    return F.when(F.size(v) == F.size(lows), F.zip_with(v, F.arrays_zip(lows.alias("lows"), highs.alias("highs")), code))


def scalar_decode(codes: Column, lows: Column, highs: Column, bits: int = 8) -> Column:
    levels = float(2**bits - 1)
    return F.zip_with(codes, F.arrays_zip(lows.alias("lows"), highs.alias("highs")), lambda c, r: r["lows"].cast("double") + c / levels * (r["highs"].cast("double") - r["lows"].cast("double")))


def upper_medians(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row (medians): sorted[n div 2] of every dimension, by its rank, so no dimension is gathered."""
    from pyspark.sql import Window

    long = df.select(F.posexplode(F.col(vector_col)).alias("at", "x"))
    counts = long.groupBy("at", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("at").orderBy("x")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("at")))
    middle = ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("at").agg(F.min("x").alias("median"))
    return middle.agg(F.array_sort(F.collect_list(F.struct("at", F.col("median").cast("double").alias("m")))).alias("r")).select(F.col("r.m").alias("medians"))


def binary_threshold(medians: Column) -> Column:
    """One threshold for all dimensions: each median in turn is averaged with what came before."""
    return F.aggregate(F.slice(medians, 2, F.greatest(F.size(medians) - 1, F.lit(0))), F.get(medians, F.lit(0)), lambda acc, m: (acc + m) / 2)


def binary_encode(v: Column, threshold: Column) -> Column:
    """Bits (above the threshold), eight to a small integer, the first one highest."""
    padded = F.concat(F.transform(v, lambda x: F.when(x.cast("double") > threshold, 1).otherwise(0)), F.array_repeat(F.lit(0), F.pmod(-F.size(v), F.lit(8)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + 7) / 8).cast("int") - 1), lambda i: F.aggregate(F.slice(padded, i * 8 + 1, 8), F.lit(0), lambda acc, b: acc * 2 + b).cast("smallint"))


def binary_decode(codes: Column, size: int) -> Column:
    """1 and -1."""
    return F.slice(F.flatten(F.transform(codes, lambda c: F.array(*[F.when(F.shiftright(c.cast("int"), 7 - i).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) for i in range(8)]))), 1, size)


class ProductQuantizer:
    """m sub-vectors of a vector, each coded as the nearest of k centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids  # [m, k, sub-dimension]

    @classmethod
    def train(cls, df: DataFrame, m: int = 8, k: int = 16, iterations: int = 20, id_col: str = "id", vector_col: str = "vector") -> ProductQuantizer:
        first = kmeans.first_rows(df, k, id_col, vector_col)
        if first.shape[1] % m:
            raise ValueError(f"{first.shape[1]} dimensions do not make {m} equal parts")
        size, books = first.shape[1] // m, []
        for part in range(m):
            sub = df.select(id_col, F.slice(F.col(vector_col), part * size + 1, size).alias("sub"))
            books.append(kmeans.fit(sub, k, iterations, "l2", id_col, "sub", empty="zero"))
        return cls(np.array(books))

    def encode(self, df: DataFrame, vector_col: str = "vector", out: str = "codes") -> DataFrame:
        books = df.sparkSession.sparkContext.broadcast(self.centroids)
        keep = df.drop(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, c = knn._matrix(batch.column(vector_col)), books.value
                codes = np.stack([kmeans.nearest(p, c[i]) for i, p in enumerate(np.split(x, len(c), axis=1))], axis=1) if len(x) else np.zeros((0, len(c)), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16()))], [*batch.schema.names, out])

        return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField(out, T.ArrayType(T.ShortType()))]))

    def decode(self, codes: Column) -> Column:
        books = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in book]) for book in self.centroids])
        return F.flatten(F.zip_with(codes, books, lambda code, book: F.get(book, code.cast("int"))))
