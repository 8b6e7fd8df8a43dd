"""The user's entry point: a collection of records, and its builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.functions import text as text_functions
from vectrill.functions.filters import compile_filter
from vectrill.operators import indexes, knn, lexical
from vectrill.sources import store as stores


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int = 384
    metric: str = "cosine"
    index: str = "flat"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    clusters: int = 100
    nprobe: int = 10
    graph_parts: int = 8
    lexical_kind: str = "bm25"
    lexical_config: lexical.LexicalConfig = field(default_factory=lexical.LexicalConfig)
    text_field: str = "content"
    path: str | None = None
    embedding: Callable[[Column], Column] | None = None
    id_col: str = "id"
    vector_col: str = "vector"


class Collection:
    """Records (id, vector and payload columns) with search by vector or text, inserts, deletes and snapshots.

    Everything returns a lazy DataFrame; a change makes the collection hold another DataFrame, and save() writes a version.
    """

    def __init__(self, spark: SparkSession, config: CollectionConfig = CollectionConfig(), rows: DataFrame | None = None) -> None:
        if config.index not in ("flat", "ivf", "hnsw", ""):
            raise ValueError(f"unknown index {config.index!r}")
        stores.check_config(config.dimension, config.m, config.ef_construction)
        self.spark, self.config = spark, config
        self.store = stores.VersionedStore(spark, config.path, config.id_col) if config.path else None
        if rows is None and self.store and self.store.versions():
            rows = self.store.read()
        self.rows, self.dirty, self._index, self._model, self._closed = rows, False, None, None, False

    # changes

    def _open(self) -> DataFrame:
        if self._closed:
            raise RuntimeError("the collection is closed")
        if self.rows is None:
            raise ValueError("the collection is empty")
        return self.rows

    def insert(self, rows: DataFrame) -> Collection:
        """Upserts; rows without a vector are embedded from the text field first."""
        if self._closed:
            raise RuntimeError("the collection is closed")
        c = self.config
        if self.config.embedding is not None and c.text_field in rows.columns:
            made = self.config.embedding(F.col(c.text_field)).cast("array<float>")
            rows = rows.withColumn(c.vector_col, F.when(F.size(F.coalesce(F.col(c.vector_col), F.array().cast("array<float>"))) > 0, F.col(c.vector_col)).otherwise(made) if c.vector_col in rows.columns else made)
        changes = rows.withColumn("seq", F.monotonically_increasing_id())
        base = self.rows if self.rows is not None else rows.limit(0)
        self.rows, self.dirty, self._index = stores.upsert(base, changes, c.id_col), True, None
        return self

    def insert_with_text(self, id_: Any, text: str, **payload: Any) -> Collection:
        row = {self.config.id_col: id_, self.config.text_field: text} | payload
        return self.insert(self.spark.createDataFrame([row]))

    def delete(self, *ids: Any) -> Collection:
        wanted = self.spark.createDataFrame([(x,) for x in ids], [self.config.id_col])
        self.rows, self.dirty, self._index = stores.delete(self._open(), wanted, self.config.id_col), True, None
        return self

    deletes = delete

    # look-ups

    def get(self, id_: Any) -> DataFrame:
        return stores.point_get(self._open(), id_, self.config.id_col)

    def batch_get(self, ids: list[Any]) -> DataFrame:
        wanted = self.spark.createDataFrame(list(enumerate(ids)), ["ord", self.config.id_col])
        return stores.batch_get(self._open(), wanted, self.config.id_col)

    def count(self) -> int:
        return 0 if self.rows is None else self._open().count()

    # search by vector

    def build_index(self) -> Collection:
        c = self.config
        if c.index == "ivf":
            self._index = indexes.ivf_build(self._open(), c.clusters, metric=c.metric, id_col=c.id_col, vector_col=c.vector_col)
        elif c.index == "hnsw":
            self._index = indexes.graph_build(self._open(), c.graph_parts, c.m, c.ef_construction, c.metric, c.id_col, c.vector_col)
        return self

    def search(self, query: list[float], k: int = 10, **options: Any) -> DataFrame:
        return self.search_with_options(query, knn.SearchOptions(top_k=k if k > 0 else 10, **options))

    def search_with_filter(self, query: list[float], k: int, filter_: dict[str, Any]) -> DataFrame:
        return self.search(query, k, filter=filter_)

    def search_with_options(self, query: list[float], options: knn.SearchOptions) -> DataFrame:
        c, rows = self.config, self._open()
        if c.index in ("ivf", "hnsw") and options.filter_mode == "post":
            if self._index is None:
                self.build_index()
            if c.index == "ivf":
                near = indexes.ivf_search(self._index, query, options.top_k, c.nprobe, c.id_col, c.vector_col).select(c.id_col)
            else:
                near = indexes.graph_search(self._index, query, options.top_k, c.ef_search, c.metric).select(F.col("id").alias(c.id_col))
            rows = rows.join(F.broadcast(near), c.id_col)  # top_k rows
        return knn.search_with(rows, query, options, c.metric, c.id_col, c.vector_col)

    def batch_search(self, queries: DataFrame, k: int = 10, query_id_col: str = "query_id", query_vector_col: str = "vector") -> DataFrame:
        c = self.config
        return knn.knn_join(self._open(), queries, k, c.metric, c.id_col, c.vector_col, query_id_col, query_vector_col)

    # search by text

    def fit_text(self) -> Collection:
        c = self.config
        self._model = lexical.fit(self._open(), c.lexical_kind, c.lexical_config, c.id_col, c.text_field)
        return self

    def search_by_text(self, text: str, k: int = 10, filter_: dict[str, Any] | None = None) -> DataFrame:
        """By the embedding function if there is one, else by the lexical model, which is fitted at the first call."""
        c = self.config
        if c.embedding is not None:
            query = self.spark.range(1).select(c.embedding(F.lit(text)).alias("v")).first()["v"]
            return self.search(query, k, filter=filter_)
        if self._model is None:
            self.fit_text()
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        hits = lexical.text_search(self._model, self._open(), asked, k, id_col=c.id_col, text_col=c.text_field)
        found = F.broadcast(hits.select(F.col("doc_id").alias(c.id_col), "rank", "score"))  # k rows
        rows = self._open().join(found, c.id_col)
        return rows.where(compile_filter(filter_, self._open())).orderBy("rank")

    # storage

    def save(self) -> int:
        if self.store is None:
            raise ValueError("the collection has no path")
        version = self.store.write(self._open())
        self.rows, self.dirty = self.store.read(version), False
        return version

    def close(self) -> None:
        if not self._closed and self.dirty and self.store is not None:
            self.save()
        self._closed = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Builder:
    """Collection settings one by one; build() makes the collection."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.config = spark, CollectionConfig()

    def _set(self, **changes: Any) -> Builder:
        self.config = replace(self.config, **changes)
        return self

    def with_dimension(self, dimension: int) -> Builder:
        return self._set(dimension=dimension)

    def with_path(self, path: str) -> Builder:
        return self._set(path=path)

    def with_index(self, index: str, **params: Any) -> Builder:
        return self._set(index=index, **params)

    def with_metric(self, metric: str) -> Builder:
        return self._set(metric=metric)

    def with_embedding(self, function: Callable[[Column], Column]) -> Builder:
        return self._set(embedding=function)

    def with_mock_embedding(self) -> Builder:
        return self._set(embedding=lambda t: text_functions.mock_embedding(t, self.config.dimension))

    def with_lexical(self, kind: str, config: lexical.LexicalConfig = lexical.LexicalConfig()) -> Builder:
        return self._set(lexical_kind=kind, lexical_config=config)

    def with_text_field(self, name: str) -> Builder:
        return self._set(text_field=name)

    def with_columns(self, id_col: str, vector_col: str) -> Builder:
        return self._set(id_col=id_col, vector_col=vector_col)

    def build(self, rows: DataFrame | None = None) -> Collection:
        return Collection(self.spark, self.config, rows)
