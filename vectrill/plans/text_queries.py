"""Queries over the documents table: tokens, vocabularies, lexical weights and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions import text as text_functions
from vectrill.functions import vector
from vectrill.operators import lexical
from vectrill.plans.registry import query, table

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text_functions.ENGLISH_STOP_WORDS)


def _tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: strlen(w) > 2 AND w NOT IN ({_STOP}))"


def _model(idf: str, least: int = 1, most: float = 1.0, size: int = 10_000, docs: str = "SELECT doc_id, text FROM documents", empties: bool = True) -> str:
    """CTEs: tf (doc_id, term, n, length), facts (n_docs, avgdl), vocab (term, cf, df, term_id, idf)."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS t FROM ({docs})),
tf AS (SELECT doc_id, term, count(*) AS n, any_value(length) AS length FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
facts AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks {'' if empties else 'WHERE len(t) > 0'}),
st AS (SELECT term, sum(n)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, cf, df, row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id, {idf} AS idf FROM st, facts
WHERE df >= {least} AND df / n_docs <= {most} QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= {size})"""


_BM25 = "ln((n_docs - df + 0.5) / (df + 0.5) + 1)"
_BM25_WEIGHT = "idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * length / avgdl))"


def _weights(idf: str, weight: str, **options) -> str:
    return f"WITH {_model(idf, **options)} SELECT doc_id, term, round({weight}, 6) AS weight FROM tf JOIN vocab USING (term), facts"


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_default(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(text_functions.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {_model(_BM25, size=10_000_000)} SELECT term, cf, df FROM vocab")
def token_stats(spark, sf_dir):
    counts = lexical.term_counts(_documents(spark, sf_dir))
    return counts.groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


@query(f"WITH w AS (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word IN ({_STOP}) GROUP BY word")
def stopword_filter(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return words.where(F.col("word").isin(list(text_functions.ENGLISH_STOP_WORDS))).groupBy("word").agg(F.count("*").alias("n"))


_BY_LANG = {"en": ("the", "of", "and"), "fr": ("le", "la", "de"), "de": ("der", "die", "und"), "es": ("el", "la", "que")}


@query(f"""WITH s(lang, word) AS (VALUES {', '.join(f"('{k}', '{w}')" for k, ws in _BY_LANG.items() for w in ws)}),
w AS (SELECT lang, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents)
SELECT lang, count(*) AS kept FROM w ANTI JOIN s USING (lang, word) WHERE lang IS NOT NULL GROUP BY lang""")
def stopword_by_lang(spark, sf_dir):
    stops = spark.createDataFrame([(k, w) for k, ws in _BY_LANG.items() for w in ws], "lang string, word string")
    words = _documents(spark, sf_dir).select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return text_functions.without_stop_words(words.where("lang is not null"), stops).groupBy("lang").agg(F.count("*").alias("kept"))


@query(f"WITH {_model(_BM25, size=500)} SELECT term, cf, df, term_id, round(idf, 6) AS idf FROM vocab")
def vocab_select_capped(spark, sf_dir):
    model = lexical.fit(_documents(spark, sf_dir), "bm25", lexical.LexicalConfig(max_vocab=500))
    return model.vocab.select("term", "cf", "df", "term_id", F.round("idf", 6).alias("idf"))


@query(f"WITH {_model(_BM25, least=3, most=0.3)} SELECT term, cf, df, term_id, round(idf, 6) AS idf FROM vocab")
def vocab_df_filters(spark, sf_dir):
    model = lexical.fit(_documents(spark, sf_dir), "bm25", lexical.LexicalConfig(min_doc_freq=3, max_doc_freq=0.3))
    return model.vocab.select("term", "cf", "df", "term_id", F.round("idf", 6).alias("idf"))


def _weighted(spark, sf_dir, kind: str, **options) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = lexical.fit(docs, kind, lexical.LexicalConfig(**options))
    return lexical.transform(model, docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


_TFIDF = "ln((n_docs + 1) / (df + 1)) + 1"


@query(f"""WITH {_model(_TFIDF)}, w AS (SELECT doc_id, term, (0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id)) * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "tfidf")


@query(f"WITH {_model(_TFIDF)} SELECT doc_id, term, round((0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id)) * idf, 6) AS weight FROM tf JOIN vocab USING (term)")
def tfidf_unnormalized(spark, sf_dir):
    return _weighted(spark, sf_dir, "tfidf", normalize=False)


@query(_weights(_BM25, _BM25_WEIGHT))
def bm25_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "bm25")


@query(_weights("ln(n_docs / df + 1)", "idf * n * 2.5 / (n + 1.5 * (length / (length + avgdl)))"))
def bm25l_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "bm25l")


@query(_weights(_BM25 + " + 1.0", f"greatest({_BM25_WEIGHT}, 0)"))
def bm25plus_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "bm25plus")


@query(_weights(_BM25, _BM25_WEIGHT) + f" WHERE {_BM25_WEIGHT} >= 3.0")
def bm25_sparse_threshold(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return lexical.transform(lexical.fit(docs, "sparse"), docs, threshold=3.0).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_model(_BM25)}, w AS (SELECT doc_id, term_id, {_BM25_WEIGHT} AS w FROM tf JOIN vocab USING (term), facts)
SELECT a.doc_id, round(sum(a.w * b.w), 6) AS dot FROM w AS a JOIN w AS b USING (term_id) WHERE b.doc_id = 0 GROUP BY a.doc_id""")
def sparse_dot(spark, sf_dir):
    """Of every document with the first one, as sparse vectors."""
    docs = _documents(spark, sf_dir)
    sparse = lexical.to_sparse(lexical.transform(lexical.fit(docs), docs))
    first = sparse.where("doc_id = 0").select(F.col("indices").alias("i0"), F.col("values").alias("v0"))
    pairs = sparse.crossJoin(F.broadcast(first))  # one row
    dot = vector.sparse_dot(F.col("indices"), F.col("values"), F.col("i0"), F.col("v0"))
    some = F.size(F.array_intersect("indices", "i0")) > 0
    return pairs.where(some).select("doc_id", F.round(dot, 6).alias("dot"))


_FIELDS = f"""f AS (SELECT doc_id, 'title' AS field, 2.0::DOUBLE AS boost, split_part(text, chr(10), 1) AS body FROM documents UNION ALL
SELECT doc_id, 'content', 1.0::DOUBLE, substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents),
toks AS (SELECT doc_id, field, boost, {_tokens('body')} AS t FROM f),
facts AS (SELECT count(DISTINCT doc_id) AS n_docs FROM f),
means AS (SELECT field, sum(len(t)) / any_value(n_docs) AS mean FROM toks, facts GROUP BY field),
tf AS (SELECT doc_id, field, term, any_value(boost) AS boost, count(*) AS n, any_value(length) AS length FROM (SELECT doc_id, field, boost, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY doc_id, field, term),
st AS (SELECT term, sum(n) AS cf, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, {_BM25} AS idf FROM st, facts WHERE df >= 1 AND df / n_docs <= 1.0 QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= 10000)"""


@query(f"WITH {_FIELDS} SELECT doc_id, term, round(sum(boost * idf * n * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS weight FROM tf JOIN vocab USING (term) JOIN means USING (field) GROUP BY doc_id, term")
def bm25f_weights(spark, sf_dir):
    """The first line is the title, the rest the content."""
    docs = _documents(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    docs = docs.select("doc_id", "title", F.expr("substring(text, length(title) + 2)").alias("content"))
    weights = lexical.bm25f_weights(lexical.fields_long(docs, ["title", "content"]))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_SEARCH = f"""{_model(_BM25)}, w AS (SELECT doc_id, term_id, {_BM25_WEIGHT} AS w FROM tf JOIN vocab USING (term), facts),
qt AS (SELECT item_id, {_tokens('text')} AS t FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS n, any_value(length) AS length FROM (SELECT item_id, len(t) AS length, unnest(t) AS term FROM qt) GROUP BY item_id, term),
qw AS (SELECT item_id, term_id, {_BM25_WEIGHT} AS w FROM qf JOIN vocab USING (term), facts),
qn AS (SELECT item_id, sum(w * w) AS qq FROM qw GROUP BY item_id), dn AS (SELECT doc_id, sum(w * w) AS dd FROM w GROUP BY doc_id),
dots AS (SELECT item_id, doc_id, sum(qw.w * w.w) AS dot FROM qw JOIN w USING (term_id) GROUP BY item_id, doc_id),
scores AS (SELECT item_id AS query_id, b.doc_id, round(coalesce(dot / (sqrt(qq * dd) + 1e-8), 0), 6) + 0.0 AS score
FROM (SELECT item_id, doc_id FROM benchmark, documents) AS b LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN qn USING (item_id) LEFT JOIN dn ON dn.doc_id = b.doc_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores)"""


def _search(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lexical.text_search(lexical.fit(docs), docs, table(spark, sf_dir, "benchmark"), 10, query_id_col="item_id")


@query(f"WITH {_SEARCH} SELECT * FROM ranked WHERE rank <= 10")
def bm25_batch_topk(spark, sf_dir):
    return _search(spark, sf_dir)


@query(f"WITH {_SEARCH} SELECT query_id, doc_id, score FROM ranked WHERE rank = 1")
def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir).where("rank = 1").select("query_id", "doc_id", "score")


@query(f"WITH {_SEARCH} SELECT query_id, rank, doc_id, score, lang FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 AND lang = 'en' AND n_chars >= 500")
def text_search_filtered(spark, sf_dir):
    """The payload filter applies to the ten best."""
    from vectrill.functions.filters import compile_filter

    docs = _documents(spark, sf_dir)
    payload = docs.select("doc_id", "lang", "n_chars")
    hits = _search(spark, sf_dir).join(payload, "doc_id")
    return hits.where(compile_filter({"lang": "en", "n_chars": {"$gte": 500}}, payload)).select("query_id", "rank", "doc_id", "score", "lang")


@query(f"WITH {_model(_BM25, empties=False)} SELECT term, cf, df, term_id, round(idf, 6) AS idf FROM vocab")
def bm25_incremental_add(spark, sf_dir):
    """English documents first, the others added to the state."""
    docs = _documents(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    state = lexical.add_documents(lexical.term_counts(docs.where(english)), docs.where(~english))
    return lexical.refit(state).vocab.select("term", "cf", "df", "term_id", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_model(_BM25, docs="SELECT doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'fr'", empties=False)}
SELECT term, cf, df, term_id, round(idf, 6) AS idf FROM vocab""")
def bm25_incremental_remove(spark, sf_dir):
    """All documents, then the French ones are removed from the state."""
    docs = _documents(spark, sf_dir)
    state = lexical.remove_documents(lexical.term_counts(docs), docs.where("lang = 'fr'").select("doc_id"))
    return lexical.refit(state).vocab.select("term", "cf", "df", "term_id", F.round("idf", 6).alias("idf"))
