import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill import catalog
from vectrill.operators import indexes, kmeans, knn, quantize


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(16)]) for i in range(400)], "id long, vector array<float>").cache()


def exact(cloud, q, k=10):
    return [r.id for r in knn.search(cloud, q, k).collect()]


def asked(cloud):
    return cloud.where("id = 5").first()["vector"]


def test_kmeans(spark):
    rows = [(i, list(map(float, x))) for i, x in enumerate([(0, 0), (10, 10), (1, 0), (9, 10), (0, 1), (10, 9)])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    centroids = kmeans.fit(df, 2)
    assert np.allclose(centroids, [[1 / 3, 1 / 3], [29 / 3, 29 / 3]])
    assert [r.cluster for r in kmeans.assign(df, centroids).orderBy("id").collect()] == [0, 1, 0, 1, 0, 1]
    with pytest.raises(ValueError):
        kmeans.fit(df, 9)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip", "normalized_ip"])
def test_join_matches_search(cloud, metric):
    got = knn.knn_join(cloud, cloud.where("id in (5, 6)"), 5, metric, query_id_col="id").where("query_id = 5").orderBy("rank").collect()
    assert [r.id for r in got] == [r.id for r in knn.search(cloud, asked(cloud), 5, metric).collect()]


def test_join_of_nothing(cloud):
    assert knn.knn_join(cloud, cloud.where("id < 0"), 5, query_id_col="id").count() == 0
    assert knn.knn_join(cloud.where("id < 0"), cloud.where("id = 1"), 5, query_id_col="id").count() == 0


def test_graph_recall(cloud):
    graph = indexes.graph_build(cloud, 2, 8, 64).cache()
    found = [r.id for r in indexes.graph_search(graph, asked(cloud), 10, 100).collect()]
    assert len(set(found) & set(exact(cloud, asked(cloud)))) >= 9
    gone = cloud.where("id = 5").select("id")
    assert 5 not in [r.id for r in indexes.graph_search(graph, asked(cloud), 10, 100, deleted=gone).collect()]


def test_ivf(cloud, tmp_path):
    index = indexes.ivf_build(cloud, 8, 5)
    everything = [r.id for r in indexes.ivf_search(index, asked(cloud), 10, 8).collect()]
    assert everything == [r.id for r in knn.search(cloud, asked(cloud), 10, "l2").collect()]
    index.save(str(tmp_path / "ivf"))
    loaded = indexes.IvfIndex.load(cloud.sparkSession, str(tmp_path / "ivf"))
    assert [r.id for r in indexes.ivf_search(loaded, asked(cloud), 10, 8).collect()] == everything
    assert indexes.ivf_search(index.delete(cloud.where("id = 5")), asked(cloud), 1, 8).first().id != 5


def test_forest_recall(cloud):
    paths = indexes.forest_paths(cloud, 12, 6)
    found = [r.id for r in indexes.forest_search(paths, asked(cloud), 10, trees=12, depth=6, flips=2).collect()]
    assert len(set(found) & set(exact(cloud, asked(cloud)))) >= 9


def test_joins_match_searches(cloud):
    queries = cloud.where("id in (5, 6)").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index, graph, paths = indexes.ivf_build(cloud, 8, 5), indexes.graph_build(cloud, 2, 8, 64).cache(), indexes.forest_paths(cloud, 12, 6)
    for join, one in (
        (indexes.ivf_join(index, queries, 10, 3), indexes.ivf_search(index, asked(cloud), 10, 3)),
        (indexes.graph_join(graph, queries, 10, 100), indexes.graph_search(graph, asked(cloud), 10, 100)),
        (indexes.forest_join(paths, queries, 10, trees=12, depth=6), indexes.forest_search(paths, asked(cloud), 10, trees=12, depth=6)),
    ):
        assert [r.id for r in join.where("query_id = 5").orderBy("rank").collect()] == [r.id for r in one.collect()]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_indexes(spark, sf):
    got = catalog.queries()["index_recall_at_k"](spark, f"/root/testdata/{sf}").groupBy("index").agg(F.avg("recall").alias("r"), F.count("*").alias("n")).collect()
    print("RECALL", sf, [tuple(r) for r in got])
    assert len(got) == 3 and all(r.r >= 0.9 and r.n == (20 if sf == "sf0.1" else 5) for r in got)


def test_tiers(cloud):
    hot = cloud.where("id < 100")
    assert [r.id for r in indexes.tiered_search(hot, cloud, asked(cloud), 10).collect()] == exact(cloud, asked(cloud))


def test_scalar_quantizer(spark):
    df = spark.createDataFrame([([0.0, 10.0, 5.0],), ([1.0, 20.0, 5.0],), ([0.25, 12.5, 5.0],), ([0.5, 15.0, 5.0],)], "vector array<float>")
    both = df.crossJoin(quantize.scalar_train(df))
    codes = lambda bits: [r[0] for r in both.select(quantize.scalar_encode(F.col("vector"), F.col("lows"), F.col("highs"), bits)).collect()]
    assert codes(8) == [[0, 0, 128], [255, 255, 128], [63, 63, 128], [127, 127, 128]]
    assert codes(16) == [[0, 0, 32768], [65535, 65535, 32768], [16383, 16383, 32768], [32767, 32767, 32768]]
    medians = quantize.upper_medians(df)
    assert medians.first()["medians"] == [0.5, 15.0, 5.0]
    assert medians.select(quantize.binary_threshold(F.col("medians"))).first()[0] == 6.375
    coded = df.crossJoin(medians).select(quantize.binary_encode(F.col("vector"), quantize.binary_threshold(F.col("medians"))).alias("c"))
    assert [r.c for r in coded.collect()] == [[64]] * 4
    assert coded.select(quantize.binary_decode(F.col("c"), 3)).first()[0] == [-1.0, 1.0, -1.0]


def test_product_quantizer(cloud):
    pq = quantize.ProductQuantizer.train(cloud, 4, 8, 3)
    coded = pq.encode(cloud)
    x, codes = np.array(asked(cloud), np.float32).astype(float), coded.where("id = 5").first()["codes"]
    for part, code in enumerate(codes):
        assert code == ((pq.centroids[part] - x[part * 4 : part * 4 + 4]) ** 2).sum(1).argmin()
    assert len(coded.where("id = 5").select(pq.decode(F.col("codes"))).first()[0]) == 16
    with pytest.raises(ValueError):
        quantize.ProductQuantizer.train(cloud, 5, 8)
