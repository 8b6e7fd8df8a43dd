"""Lexical models (TF-IDF, BM25, BM25L, BM25+, BM25F): fit is an aggregation, transform a join; weights stay in long form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrill.functions import text as text_functions


@dataclass(frozen=True)
class LexicalConfig:
    max_vocab: int = 10_000
    min_doc_freq: int = 1
    max_doc_freq: float = 1.0
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0
    normalize: bool = True
    tokenizer: Callable[[Column], Column] = text_functions.tokens
    field_weights: dict[str, float] = field(default_factory=lambda: {"title": 2.0, "content": 1.0})

    def checked(self) -> LexicalConfig:
        """Values out of range replaced by the defaults."""
        d = LexicalConfig()
        return LexicalConfig(
            self.max_vocab if self.max_vocab > 0 else d.max_vocab, max(1, self.min_doc_freq), self.max_doc_freq if 0 < self.max_doc_freq <= 1 else d.max_doc_freq,
            self.k1 if self.k1 > 0 else d.k1, self.b if 0 <= self.b <= 1 else d.b, self.delta, self.normalize, self.tokenizer, self.field_weights or d.field_weights,
        )


@dataclass(frozen=True)
class LexicalModel:
    """vocab: (term, term_id, df, cf, idf); one row of corpus facts."""

    kind: str
    config: LexicalConfig
    vocab: DataFrame
    n_docs: int
    avg_length: float
    version: int = 1

    @property
    def dimension(self) -> int:
        return self.vocab.count()


def term_counts(docs: DataFrame, config: LexicalConfig = LexicalConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, n, length): occurrences of each term in each document, and the document's tokens in all."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), config.tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.max("length").alias("length"))


def select_vocabulary(stats: DataFrame, n_docs: int, config: LexicalConfig) -> DataFrame:
    """(term, cf, df) → with term_id: by falling corpus frequency, then term, at most max_vocab."""
    fit = stats.where((F.col("df") >= config.min_doc_freq) & (F.col("df") / F.lit(max(n_docs, 1)) <= config.max_doc_freq))
    top = fit.orderBy(F.desc("cf"), "term").limit(config.max_vocab)
    return top.withColumn("term_id", (F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1).cast("bigint"))


def _idf(kind: str, n_docs: int, delta: float) -> Column:
    n, df = F.lit(float(n_docs)), F.col("df")
    if kind == "tfidf":
        return F.log((n + 1) / (df + 1)) + 1
    if kind == "bm25l":
        return F.log(n / df + 1)
    value = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return value + delta if kind == "bm25plus" else value


KINDS = ("tfidf", "bm25", "bm25l", "bm25plus", "bm25f", "sparse")


def fit(docs: DataFrame, kind: str = "bm25", config: LexicalConfig = LexicalConfig(), id_col: str = "doc_id", text_col: str = "text") -> LexicalModel:
    if kind not in KINDS:
        raise ValueError(f"unknown model {kind!r}; one of {KINDS}")
    config = config.checked()
    lengths = docs.select(F.size(config.tokenizer(F.coalesce(F.col(text_col), F.lit("")))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    counts = term_counts(docs, config, id_col, text_col).groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    vocab = select_vocabulary(counts, lengths["n"], config).withColumn("idf", _idf(kind, lengths["n"], config.delta))
    return LexicalModel(kind, config, vocab, lengths["n"], lengths["avg"] or 0.0)


def _weight(model: LexicalModel) -> Column:
    c, dl, k1, b = F.col("n").cast("double"), F.col("length"), model.config.k1, model.config.b
    avg = F.lit(model.avg_length or 1.0)
    if model.kind == "bm25l":
        return F.col("idf") * c * (k1 + 1) / (c + k1 * (dl / (dl + avg)))
    part = c * (k1 + 1) / (c + k1 * (1 - b + b * dl / avg))
    value = F.col("idf") * part
    return F.greatest(value, F.lit(0.0)) if model.kind == "bm25plus" else value


def transform(model: LexicalModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.0) -> DataFrame:
    """(doc_id, term, term_id, weight) of all terms in the vocabulary; with a threshold (sparse model) weights below it are left out.

    The vocabulary has at most max_vocab rows, so it is broadcast.
    """
    counts = term_counts(docs, model.config, id_col, text_col).join(F.broadcast(model.vocab.select("term", "term_id", "idf")), "term")
    if model.kind == "tfidf":
        most = F.greatest(F.max("n").over(Window.partitionBy("doc_id")), F.lit(1))
        weights = counts.withColumn("weight", (0.5 + 0.5 * F.col("n") / most) * F.col("idf"))
        if model.config.normalize:
            length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
            weights = weights.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(F.col("weight")))
    else:
        weights = counts.withColumn("weight", _weight(model))
    weights = weights.select("doc_id", "term", "term_id", "weight")
    return weights.where(F.col("weight") >= threshold) if model.kind == "sparse" or threshold else weights


def fit_transform(docs: DataFrame, kind: str = "bm25", config: LexicalConfig = LexicalConfig(), **columns) -> tuple[LexicalModel, DataFrame]:
    model = fit(docs, kind, config, **columns)
    return model, transform(model, docs, **columns)


def to_sparse(weights: DataFrame) -> DataFrame:
    """(doc_id, indices, values) with rising indices."""
    entries = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    return weights.groupBy("doc_id").agg(entries.alias("e")).select("doc_id", F.col("e.term_id").alias("indices"), F.col("e.weight").alias("values"))


def to_dense(weights: DataFrame, model: LexicalModel, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, vector) for every document, zeros without a term; for small vocabularies."""
    from vectrill.functions.vector import sparse_to_dense

    rows = docs.select(F.col(id_col).alias("doc_id")).join(to_sparse(weights), "doc_id", "left")
    empty = F.array().cast("array<bigint>")
    return rows.select("doc_id", sparse_to_dense(F.coalesce("indices", empty), F.coalesce("values", empty.cast("array<double>")), max(1, model.dimension)).alias("vector"))


# --- several fields -------------------------------------------------------------------------


def fields_long(docs: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, text) of documents with one column a field."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("doc_id", "x.field", F.coalesce("x.text", F.lit("")).alias("text"))


def bm25f_weights(long: DataFrame, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    """(doc_id, term, weight) from (doc_id, field, text): each occurrence adds weight * idf * (k1 + 1) / (1 + k1 * norm of its
    field), summed over fields; a term's document frequency counts fields, and a field's mean length is over all documents."""
    config = config.checked()
    tokens = long.select("doc_id", "field", config.tokenizer("text" if isinstance(config.tokenizer, str) else F.col("text")).alias("tokens"))
    n_docs = long.select("doc_id").distinct().count()
    means = tokens.groupBy("field").agg((F.sum(F.size("tokens")) / F.lit(max(n_docs, 1))).alias("mean"))
    counts = tokens.select("doc_id", "field", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("doc_id", "field", "term").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    stats = counts.groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    vocab = select_vocabulary(stats, n_docs, config).withColumn("idf", _idf("bm25", n_docs, 0.0)).select("term", "idf")
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in config.field_weights.items() if w], F.lit(1.0))
    norm = 1 - config.b + config.b * F.col("length") / F.col("mean")
    scored = counts.join(F.broadcast(vocab), "term").join(F.broadcast(means), "field")  # at most max_vocab terms; a row for each field
    return scored.groupBy("doc_id", "term").agg(F.sum(weight * F.col("idf") * F.col("n") * (config.k1 + 1) / (1 + config.k1 * norm)).alias("weight"))


# --- incremental ----------------------------------------------------------------------------


def add_documents(state: DataFrame, docs: DataFrame, config: LexicalConfig = LexicalConfig(), **columns) -> DataFrame:
    """The state (doc_id, term, n, length) with more documents; refit() makes the model of it."""
    return state.unionByName(term_counts(docs, config, **columns))


def remove_documents(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def refit(state: DataFrame, kind: str = "bm25", config: LexicalConfig = LexicalConfig(), version: int = 1) -> LexicalModel:
    """The model of a state; documents without a token are not part of it."""
    config = config.checked()
    facts = state.groupBy("doc_id").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    vocab = select_vocabulary(state.groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df")), facts["n"], config)
    return LexicalModel(kind, config, vocab.withColumn("idf", _idf(kind, facts["n"], config.delta)), facts["n"], facts["avg"] or 0.0, version)


# --- search ---------------------------------------------------------------------------------


def text_search(
    model: LexicalModel, docs: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0, max_results: int | None = 100,
    id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "query_id", query_text_col: str = "text", digits: int = 6,
    doc_weights: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, score) by cosine (1e-8 added below the line) of query and document weights.

    Documents without a common term score 0 and are returned if k asks for that many; they are only listed up to k a query.
    doc_weights: weights made before with the same model.
    """
    k = min(k, max_results) if max_results else k
    asked = transform(model, queries, query_id_col, query_text_col).withColumnRenamed("doc_id", "query_id")
    weights = doc_weights if doc_weights is not None else transform(model, docs, id_col, text_col)
    # Norms by window, so that each side is tokenized once.
    asked = asked.select("query_id", "term_id", F.col("weight").alias("q"), F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id")).alias("qq"))
    weights = weights.select("doc_id", "term_id", F.col("weight").alias("d"), F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")).alias("dd"))
    dots = asked.join(weights, "term_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), F.max("qq").alias("qq"), F.max("dd").alias("dd"))
    scored = dots.select("query_id", "doc_id", F.round(F.col("dot") / (F.sqrt(F.col("qq") * F.col("dd")) + 1e-8), digits).alias("score"))
    everyone = queries.select(F.col(query_id_col).alias("query_id")).distinct()
    if min_score <= 0:  # the k lowest ids are enough to fill up lists with zeros, as at most k of them can be listed already
        fill = docs.select(F.col(id_col).alias("doc_id")).orderBy("doc_id").limit(2 * k)
        zeros = everyone.crossJoin(F.broadcast(fill)).withColumn("score", F.lit(0.0))  # 2k rows a query
        scored = scored.unionByName(zeros.join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
    ranked = scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
