import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vectrill.collection import Builder
from vectrill.operators import knn
from vectrill.sources import formats, store


@pytest.fixture
def basis(spark):
    return spark.createDataFrame([(i, [float(i == j) for j in range(4)], "A" if i % 2 else "B") for i in range(4)], "id long, vector array<float>, category string")


def test_versions(spark, basis, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "t"))
    assert s.versions() == [] and s.count() == 0
    with pytest.raises(FileNotFoundError):
        s.read()
    s.put(basis)
    s.put(basis.where("id = 0").withColumn("category", F.lit("Z")))
    s.delete(basis.where("id = 3"))
    assert s.versions() == [1, 2, 3] and s.count() == 3 and s.read(1).count() == 4
    assert s.read().where("id = 0").first().category == "Z"


def test_batch_get(spark, basis):
    asked = spark.createDataFrame([(0, 2), (1, 9), (2, 0)], "ord long, id long")
    assert [r.category for r in store.batch_get(basis, asked).collect()] == ["B", None, "B"]
    assert store.batch_get(basis, asked, placeholders=False).count() == 2


def test_replay(spark):
    log = spark.createDataFrame([(1, "a", "insert", 1), (2, "a", "delete", None), (3, "a", "insert", 2), (4, "b", "insert", 3), (5, "b", "delete", None)], "seq long, id string, op string, v int")
    assert [(r.id, r.v) for r in store.replay(log).collect()] == [("a", 2)]
    marked = log.union(spark.createDataFrame([(3, None, "checkpoint", None)], log.schema))
    assert store.replay(marked).count() == 0


def test_validation(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("", [1.0, 2.0]), ("b", [float("nan"), 1.0]), ("c", [1.0]), (None, [1.0, 2.0]), ("d", None)], "id string, vector array<float>")
    good, counts = store.insert_validated(df, 2)
    assert [r.id for r in good.collect()] == ["a"] and tuple(counts.first()) == (1, 5)
    assert not store.valid_batch(df).first()[0]
    with pytest.raises(ValueError):
        store.check_search_options(0)


def test_backups(spark, basis, tmp_path):
    manager = store.BackupManager(spark, str(tmp_path / "b"), keep=2)
    start = dt.datetime(2024, 1, 1)
    names = [manager.create(basis, f"n{i}", start + dt.timedelta(hours=i)) for i in range(3)]
    assert [r["name"] for r in manager.list().collect()] == names[:0:-1]
    assert manager.restore(names[2]).count() == 4 and manager.list().first().vector_count == 4


def test_formats(spark, basis, tmp_path):
    data = basis.select(formats.to_binary(F.col("id").cast("string"), "vector", F.lit(7)).alias("d"))
    back = data.select(formats.from_binary("d").alias("r")).select("r.*").orderBy("id").collect()
    assert [(r.id, r.vector, r.ts_ns) for r in back][1] == ("1", [0.0, 1.0, 0.0, 0.0], 7)
    formats.write_mmap(str(tmp_path / "m.bin"), [("x", [1.0, 2.0], 3), ("yy", [], 4)])
    assert [tuple(r) for r in formats.read_mmap(spark, str(tmp_path / "m.bin")).collect()] == [("x", [1.0, 2.0], 3), ("yy", [], 4)]
    (tmp_path / "c.json").write_text(json.dumps({"config": {"dimension": 2}, "vectors": [{"id": 1, "vector": [1, 2]}]}))
    assert [tuple(r) for r in formats.read_collection_file(spark, str(tmp_path / "c.json")).collect()] == [("1", [1.0, 2.0])]
    (tmp_path / "l.json").write_text(json.dumps([{"id": "a", "vector": [1]}, {"id": "b", "vector": []}]))
    assert formats.read_collection_file(spark, str(tmp_path / "l.json")).count() == 2
    assert basis.select("id", F.lit("t").alias("text")).transform(formats.embed, client=lambda ts: [[1.0] for _ in ts]).first().vector == [1.0]


def test_collection(spark, basis, tmp_path):
    with Builder(spark).with_dimension(4).with_path(str(tmp_path / "c")).build(basis) as c:
        assert c.search([1.0, 0, 0, 0], 2).first().id == 0
        assert [r.id for r in c.search_with_filter([1.0, 0, 0, 0], 4, {"category": "A"}).collect()] == [1, 3]
        c.delete(1)
        assert c.count() == 3 and c.dirty
        c.insert(spark.createDataFrame([(2, [0.0, 0.0, 0.0, 9.0], "Q")], basis.schema))
        assert c.get(2).first().category == "Q"
        c.save()
        assert not c.dirty
    assert Builder(spark).with_dimension(4).with_path(str(tmp_path / "c")).build().count() == 3
    with pytest.raises(RuntimeError):
        c.search([1.0, 0, 0, 0])


@pytest.mark.parametrize("index", ["ivf", "hnsw"])
def test_collection_indexes(spark, basis, index):
    c = Builder(spark).with_dimension(4).with_index(index, clusters=2, nprobe=2, graph_parts=1).with_metric("l2").build(basis)
    assert c.search([1.0, 0, 0, 0], 4, min_score=None).first().id == 0


def test_text_collection(spark):
    rows = spark.createDataFrame([("a", "alpha beta", "x"), ("b", "gamma delta", "y")], "id string, content string, kind string")
    c = Builder(spark).build(rows)
    assert [r.id for r in c.search_by_text("gamma", 1).collect()] == ["b"]
    assert c.search_by_text("gamma", 1, {"kind": "x"}).count() == 0
    mock = Builder(spark).with_dimension(8).with_mock_embedding().build()
    mock.insert_with_text("a", "hello").insert_with_text("b", "world")
    assert mock.search_by_text("world", 1).first().id == "b"


def test_options(basis):
    hits = knn.search_with(basis, [1.0, 0, 0, 0], knn.SearchOptions(4, with_vector=True, max_distance=0.5))
    assert hits.count() == 1 and set(hits.columns) == {"id", "score", "distance", "vector", "category"}
