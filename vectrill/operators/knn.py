"""Nearest neighbours: exact search, batches of queries, filters, thresholds, recall.

Distances are rounded to `digits` before ranking, so that ties are ties on every machine, and ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import vector
from vectrill.functions.filters import compile_filter

DIGITS = 6


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    min_score: float | None = 0.0
    max_distance: float = 0.0
    with_vector: bool = False
    with_payload: bool = True
    filter: dict[str, Any] | None = None
    filter_mode: str = "post"


def search(
    df: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", digits: int = DIGITS
) -> DataFrame:
    """The k nearest rows of one query with distance and score; a bounded top-k in every task, one merge."""
    given = F.array(*[F.lit(float(x)) for x in query])
    near = df.withColumn("distance", F.round(vector.distance(metric, F.col(vector_col), given), digits))
    return near.orderBy("distance", id_col).limit(k if k > 0 else 10).withColumn("score", F.round(1 - F.col("distance"), digits))


def search_with(df: DataFrame, query: list[float], options: SearchOptions, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Search, thresholds, payload filter and projection. Filters apply to the top k ("post", so that fewer may be left) or before ("pre")."""
    if options.filter_mode not in ("pre", "post"):
        raise ValueError(f"unknown filter mode {options.filter_mode!r}")
    rows = df.where(compile_filter(options.filter, df)) if options.filter_mode == "pre" else df
    hits = search(rows, query, options.top_k, metric, id_col, vector_col)
    if options.min_score is not None:
        hits = hits.where(F.col("score") >= options.min_score)
    if options.max_distance > 0:
        hits = hits.where(F.col("distance") <= options.max_distance)
    if options.filter_mode == "post":
        hits = hits.where(compile_filter(options.filter, df))
    payload = [c for c in df.columns if c not in (id_col, vector_col)] if options.with_payload else []
    return hits.select(id_col, "score", "distance", *([vector_col] if options.with_vector else []), *payload)


def search_over_fetch(df: DataFrame, query: list[float], k: int, predicate: Column, **options) -> DataFrame:
    """Takes 2k, keeps what the predicate holds for, and returns k of them."""
    return search(df, query, 2 * k, **options).where(predicate).orderBy("distance", options.get("id_col", "id")).limit(k)


# --- many queries ---------------------------------------------------------------------------


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    product = q @ x.T
    if metric in ("cosine", ""):
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product
    return -product if metric == "ip" else 1 - product


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def knn_join(
    df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector",
    query_id_col: str = "query_id", query_vector_col: str = "vector", exclude_self: bool = False, block: int = 2048, digits: int = DIGITS,
) -> DataFrame:
    """(query_id, rank, id, distance, score) of each query's k nearest rows.

    The queries are a stated set, taken `block` at a time: each block is broadcast (block vectors at most), every task
    multiplies it with its batches of rows and keeps k candidates a query, and only these are shuffled to be ranked.
    """
    if metric not in vector.METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(vector.METRICS)}")
    spark = df.sparkSession
    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    asked = queries.where(F.col(query_vector_col).isNotNull()).select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).cast("array<float>").alias("vector"))
    id_type, query_type = df.schema[id_col].dataType, queries.schema[query_id_col].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])
    arrow = pa.schema([(f.name, T_ARROW[type(f.dataType)]) for f in schema.fields])

    def blocks() -> Iterator[tuple[list, np.ndarray]]:
        ids, vectors = [], []
        for row in asked.toLocalIterator(prefetchPartitions=True):
            ids.append(row[0])
            vectors.append(row[1])
            if len(ids) == block:
                yield ids, np.array(vectors, np.float64)
                ids, vectors = [], []
        if ids:
            yield ids, np.array(vectors, np.float64)

    def near(ids: list, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            keys = np.empty(0, object)
            best = np.empty((len(own), 0))
            names = np.empty((len(own), 0), object)
            for batch in batches:
                x, keys = _matrix(batch.column("vector")), np.array(batch.column("id").to_pylist(), object)
                if not len(keys):
                    continue
                d = np.round(_distances(metric, q, x), digits) + 0.0
                names = np.concatenate([names, np.broadcast_to(keys, d.shape)], axis=1)
                best = np.concatenate([best, d], axis=1)
                if exclude_self:
                    best = np.where(names == np.array(own, object)[:, None], np.inf, best)
                order = np.argsort(names, axis=1, kind="stable")
                best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
                order = np.argsort(best, axis=1, kind="stable")[:, :k]
                best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
            row, column = np.nonzero(np.isfinite(best))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in row], arrow.field(0).type), pa.array(names[row, column].tolist(), arrow.field(1).type), pa.array(best[row, column])], schema=arrow)

        return rows.mapInArrow(run, schema)

    found = None
    for ids, q in blocks():
        part = near(ids, q)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", F.round(1 - F.col("distance"), digits).alias("score"))


T_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64()}


def knn_graph(df: DataFrame, edges: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Each row's nearest other rows: (src, dst, rank, distance)."""
    pairs = knn_join(df, df, edges, metric, id_col, vector_col, id_col, vector_col, exclude_self=True)
    return pairs.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "rank", "distance")


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact k nearest that were found."""
    hits = exact.where(F.col("rank") <= k).select("query_id", "id").join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def merge_ranked(first: DataFrame, second: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Two lists of hits as one: each id once, with its smallest distance, the k nearest."""
    merged = first.select(id_col, "distance").unionByName(second.select(id_col, "distance"))
    return merged.groupBy(id_col).agg(F.min("distance").alias("distance")).orderBy("distance", id_col).limit(k)
