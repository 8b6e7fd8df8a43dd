import pytest
from pyspark.sql import functions as F

from vectrill.operators import lexical

CORPUS = [(0, "alpha beta beta gamma"), (1, "alpha delta"), (2, "gamma gamma epsilon beta zeta")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def weights(df):
    return {(r.doc_id, r.term): round(r.weight, 6) for r in df.collect()}


@pytest.mark.parametrize(
    ("kind", "expected"),
    [
        ("bm25", {(0, "beta"): 0.652371, (0, "gamma"): 0.451532, (1, "delta"): 1.233042, (2, "epsilon"): 0.842900}),
        ("bm25l", {(0, "beta"): 1.646460, (1, "delta"): 2.266058, (2, "gamma"): 1.598897}),
        ("bm25plus", {(0, "beta"): 2.040384, (0, "gamma"): 1.412231}),
        ("tfidf", {(0, "beta"): 0.685994, (1, "alpha"): 0.605349, (2, "gamma"): 0.533949}),
    ],
)
def test_weights(docs, kind, expected):
    got = weights(lexical.fit_transform(docs, kind)[1])
    assert {k: got[k] for k in expected} == expected


def test_vocabulary(docs):
    vocab = lexical.fit(docs).vocab.orderBy("term_id")
    assert [r.term for r in vocab.collect()] == ["beta", "gamma", "alpha", "delta", "epsilon", "zeta"]
    assert lexical.fit(docs, config=lexical.LexicalConfig(max_vocab=2)).dimension == 2
    assert lexical.fit(docs, config=lexical.LexicalConfig(min_doc_freq=2)).dimension == 3


def test_search(docs, spark):
    asked = spark.createDataFrame([(9, "beta gamma")], "query_id long, text string")
    got = lexical.text_search(lexical.fit(docs), docs, asked, 3).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(0, 0.855071), (2, 0.509528), (1, 0.0)]


def test_bm25f(spark):
    rows = [(0, "alpha beta", "beta gamma gamma"), (1, "delta", "alpha epsilon beta")]
    long = lexical.fields_long(spark.createDataFrame(rows, "doc_id long, title string, content string"), ["title", "content"])
    got = weights(lexical.bm25f_weights(long))
    assert got == {(0, "alpha"): 0.317081, (0, "gamma"): 1.386294, (1, "delta"): 1.630935, (1, "alpha"): 0.182322, (1, "epsilon"): 0.693147}


def test_incremental(docs):
    state = lexical.add_documents(lexical.term_counts(docs.where("doc_id < 2")), docs.where("doc_id = 2"))
    assert {tuple(r) for r in lexical.refit(state).vocab.collect()} == {tuple(r) for r in lexical.fit(docs).vocab.select(*lexical.refit(state).vocab.columns).collect()}
    assert lexical.refit(lexical.remove_documents(state, docs.where("doc_id = 2"))).n_docs == 2


def test_empty_document(spark):
    docs = spark.createDataFrame([(0, "alpha"), (1, None), (2, "")], "doc_id long, text string")
    model, got = lexical.fit_transform(docs)
    assert model.n_docs == 3 and [r.doc_id for r in got.collect()] == [0]
    dense = {r.doc_id: r.vector for r in lexical.to_dense(got, model, docs).collect()}
    assert dense[1] == [0.0] and dense[0][0] > 0


def test_threshold(docs):
    model = lexical.fit(docs, "sparse")
    assert lexical.transform(model, docs, threshold=0.8).where(F.col("weight") < 0.8).count() == 0
