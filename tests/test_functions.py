import datetime as dt

import pytest
from pyspark.sql import functions as F

from vectrill.functions import text, vector
from vectrill.functions.filters import compile_filter


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def v(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_metrics(spark):
    a, b = v(1, 2, 3), v(4, -5, 6)
    got = spark.range(1).select(vector.dot(a, b), vector.inner_product(a, b), vector.l2(a, b), vector.cosine(a, b), vector.cosine_similarity(a, b)).first()
    assert got[:3] == (12.0, -12.0, 67.0)
    assert got[3] == pytest.approx(0.634513, abs=1e-6) and got[4] == pytest.approx(1 - 0.634513, abs=1e-6)


def test_zero_norm_and_lengths(spark):
    zero, one, short = v(0, 0), v(1, 0), v(1)
    got = spark.range(1).select(vector.cosine(zero, one), vector.cosine(zero, one, 0.0), vector.l2(one, short), vector.dot(one, short), vector.add(one, short), vector.normalize(zero)).first()
    assert tuple(got) == (1.0, 0.0, 0.0, 0.0, None, [0.0, 0.0])


def test_sparse(spark):
    i, x, j, y = F.array(F.lit(0), F.lit(1), F.lit(5)), v(1, 2, 3), F.array(F.lit(0), F.lit(5), F.lit(7)), v(2, 4, 6)
    assert value(spark, vector.sparse_dot(i, x, j, y)) == 14.0
    assert value(spark, vector.sparse_to_dense(F.array(F.lit(2), F.lit(9)), v(5, 6), 3)) == [0.0, 0.0, 5.0]


def test_bits(spark):
    code = lambda *xs: F.array(*[F.lit(x).cast("smallint") for x in xs])
    got = spark.range(1).select(vector.hamming(code(0xAA), code(0x0F)), vector.binary_cosine(code(0xAA), code(0x0F)), vector.hamming(code(1), code(1, 2)), vector.popcount(code(255, 1))).first()
    assert tuple(got) == (4, 0.5, -1, 9)


def test_unknown_metric():
    with pytest.raises(ValueError):
        vector.distance("nearness", None, None)


def test_parse_literal(spark):
    assert value(spark, vector.parse_literal(F.lit("[1, 2.5,x]"))) == [1.0, 2.5, 0.0]
    assert value(spark, vector.parse_literal(F.lit("[]"))) == []


def test_tokenizers(spark):
    assert value(spark, text.tokens(F.lit("The quick-brown FOX, it's äb a1 x"))) == ["quick", "brown", "fox", "äb"]
    assert value(spark, text.tokens(F.lit("你好 world"))) == ["你", "好"]
    assert value(spark, text.tokens(F.lit(""))) == []


def test_mock_embedding(spark):
    a, b = spark.range(1).select(text.mock_embedding(F.lit("x"), 8), text.mock_embedding(F.lit("x"), 8)).first()
    assert a == b and sum(x * x for x in a) == pytest.approx(1)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "user", 5, 1.5, True, dt.datetime(2024, 1, 1)), (2, "assistant", 7, None, False, dt.datetime(2024, 1, 2)), (3, None, None, 2.0, None, None)]
    return spark.createDataFrame(rows, "id int, role string, n int, x double, ok boolean, ts timestamp")


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({}, [1, 2, 3]), ({"role": "user"}, [1]), ({"role": {"$ne": "user"}}, [2]), ({"n": {"$gt": 5}}, [2]), ({"n": {"$gte": 5, "$lt": 7}}, [1]),
        ({"n": "5"}, [1]), ({"ok": "true"}, [1]), ({"role": {"$gt": "a"}}, []), ({"n": {"$in": [5, 9]}}, [1]), ({"n": {"$nin": [5]}}, [2]), ({"n": {"$in": 5}}, []),
        ({"n": {"$nin": 5}}, [1, 2]), ({"$or": []}, []), ({"$and": []}, [1, 2, 3]), ({"$or": [{"n": 5}, {"x": 2}], "role": "user"}, [1, 3]),
        ({"$and": [{"n": 7}, {"ok": False}]}, [2]), ({"absent": 1}, []), ({"n": {"$odd": 1}}, [1, 2]), ({"ts": {"$gt": dt.datetime(2024, 1, 1, 12)}}, [2]),
    ],
)
def test_filters(people, wanted, ids):
    assert [r.id for r in people.where(compile_filter(wanted, people)).orderBy("id").collect()] == ids


def test_strict_filters(people):
    both = {"$or": [{"n": 5}, {"x": 2}], "role": "user"}
    assert [r.id for r in people.where(compile_filter(both, people, strict=True)).collect()] == [1]
    with pytest.raises(ValueError):
        compile_filter({"n": {"$odd": 1}}, people, strict=True)


def test_long_integers_are_exact(spark):
    rows = spark.createDataFrame([(1 << 53,), ((1 << 53) + 1,), (3,), (None,)], "n long")
    ids = lambda wanted: sorted(r.n for r in rows.where(compile_filter(wanted, rows)).collect())
    assert ids({"n": (1 << 53) + 1}) == [(1 << 53) + 1] and ids({"n": {"$gt": 1 << 53}}) == [(1 << 53) + 1] and ids({"n": {"$in": [3.0, 3.5]}}) == [3]
    assert ids({"n": {"$gt": 2.5, "$lt": 3.5}}) == [3] and ids({"n": {"$gte": 3.5}}) == [1 << 53, (1 << 53) + 1] and ids({"n": {"$lt": 1 << 70}}) == [3, 1 << 53, (1 << 53) + 1]
    assert ids({"n": {"$ne": 1 << 70}}) == [3, 1 << 53, (1 << 53) + 1] and ids({"n": {"$gt": float("inf")}}) == [] and ids({"n": {"$lte": 2.5}}) == []


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 1.5D AS x", "cast(id AS string) AS s", "timestamp_seconds(id) AS t").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    tests = {"GreaterThanOrEqual(id,2)": {"id": {"$gte": 2}}, "LessThan(x,9.0)": {"x": {"$lt": 9}}, "EqualTo(s,4)": {"s": "4"}, "GreaterThanOrEqual(t,": {"t": {"$gt": dt.datetime(1970, 1, 1)}}}
    for pushed, wanted in tests.items():
        assert pushed in rows.where(compile_filter(wanted, rows))._jdf.queryExecution().executedPlan().toString()
