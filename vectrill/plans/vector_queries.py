"""Queries over the embeddings table: distances, search, indexes, quantizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.functions import vector
from vectrill.operators import indexes, kmeans, knn, quantize
from vectrill.plans.registry import query, table
from vectrill.sources.scratch import scratch

K = 10


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, so that metrics rank differently."""
    return _embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)))


def _asked(df: DataFrame, key: int = 0) -> list[float]:
    return list(df.where(F.col("vec_id") == key).select("embedding").first()[0])


def _sql_dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _sql_cosine(a: str, b: str) -> str:
    return f"(1 - {_sql_dot(a, b)} / (sqrt({_sql_dot(a, a)}) * sqrt({_sql_dot(b, b)})))"


def _sql_l2(a: str, b: str) -> str:
    return f"({_sql_dot(a, a)} + {_sql_dot(b, b)} - 2 * {_sql_dot(a, b)})"


_RAW = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_SCALED = "v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS e FROM embeddings)"


def _sql_top(distance: str, source: str = _SCALED, where: str = "", limit: int = K, extra: str = "") -> str:
    return f"""WITH {source}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
d AS (SELECT vec_id, label, round({distance}, 6) + 0.0 AS distance FROM v, q {where}),
h AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT {limit})
SELECT vec_id, distance, round(1 - distance, 6) AS score{extra} FROM h"""


def _top(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    df = _scaled(spark, sf_dir)
    return knn.search(df, _asked(df), K, metric, "vec_id", "embedding").select("vec_id", "distance", "score")


@query(_sql_top(_sql_cosine("e", "qe")))
def knn_cosine_topk(spark, sf_dir):
    return _top(spark, sf_dir, "cosine")


@query(_sql_top("list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def knn_l2_topk(spark, sf_dir):
    return _top(spark, sf_dir, "l2")


@query(_sql_top("-" + _sql_dot("e", "qe")))
def knn_ip_topk(spark, sf_dir):
    return _top(spark, sf_dir, "ip")


@query(_sql_top("1 - " + _sql_dot("e", "qe"), _RAW))
def knn_normalized_ip_topk(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search(df, _asked(df), K, "normalized_ip", "vec_id", "embedding").select("vec_id", "distance", "score")


@query(_sql_top(_sql_cosine("e", "qe"), _RAW) + " WHERE round(1 - distance, 6) >= 0.3")
def knn_min_score(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search_with(df, _asked(df), knn.SearchOptions(K, min_score=0.3, with_payload=False), "cosine", "vec_id", "embedding")


@query(_sql_top(_sql_cosine("e", "qe"), _RAW) + " WHERE round(1 - distance, 6) >= 0 AND distance <= 0.65")
def knn_max_distance(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search_with(df, _asked(df), knn.SearchOptions(K, max_distance=0.65, with_payload=False), "cosine", "vec_id", "embedding")


@query(_sql_top(_sql_cosine("e", "qe"), _RAW, limit=50, extra=", label") + " WHERE round(1 - distance, 6) >= 0 AND label IN (1, 2, 3)")
def knn_post_filter_label(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search_with(df, _asked(df), knn.SearchOptions(50, filter={"label": {"$in": [1, 2, 3]}}), "cosine", "vec_id", "embedding")


@query(_sql_top(_sql_cosine("e", "qe"), _RAW, "WHERE label IN (1, 2, 3)", extra=", label"))
def knn_pre_filter_label(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search_with(df, _asked(df), knn.SearchOptions(K, min_score=None, filter={"label": {"$in": [1, 2, 3]}}, filter_mode="pre"), "cosine", "vec_id", "embedding")


@query(f"SELECT * FROM ({_sql_top(_sql_cosine('e', 'qe'), _RAW, limit=2 * K, extra=', label')}) WHERE label % 2 = 0 ORDER BY distance, vec_id LIMIT {K}")
def knn_overfetch_filter(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return knn.search_over_fetch(df, _asked(df), K, F.col("label") % 2 == 0, id_col="vec_id", vector_col="embedding").select("vec_id", "distance", "score", "label")


def _sql_join(k: int, itself: bool, asked: str = "vec_id % 100 = 0") -> str:
    return f"""WITH {_RAW}, d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_sql_cosine('v.e', 'q.e')}, 6) + 0.0 AS distance
FROM v, v AS q WHERE {f'q.{asked}' if asked else 'true'} {'' if itself else 'AND q.vec_id <> v.vec_id'}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, rank, id, distance, round(1 - distance, 6) AS score FROM r WHERE rank <= {k}"""


@query(_sql_join(K, True))
def knn_join_batch(spark, sf_dir):
    """Queries: every hundredth vector, against all."""
    df = _embeddings(spark, sf_dir)
    return knn.knn_join(df, df.where("vec_id % 100 = 0"), K, "cosine", "vec_id", "embedding", "vec_id", "embedding")


@query(f"SELECT query_id AS src, id AS dst, rank, distance FROM ({_sql_join(5, False, '')})")
def knn_graph_self(spark, sf_dir):
    return knn.knn_graph(_embeddings(spark, sf_dir), 5, "cosine", "vec_id", "embedding")


@query(f"SELECT query_id, 1.0::DOUBLE AS recall FROM ({_sql_join(K, True)}) GROUP BY query_id")
def recall_at_k(spark, sf_dir):
    """Of the batch join against the same search by column functions."""
    df = _embeddings(spark, sf_dir)
    asked = df.where("vec_id % 100 = 0")
    found = knn.knn_join(df, asked, K, "cosine", "vec_id", "embedding", "vec_id", "embedding")
    return knn.recall_at_k(found, knn.knn_join(df, asked, K, "normalized_ip", "vec_id", "embedding", "vec_id", "embedding"), K)


def _text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.format_number(x, 6)), ";")


@query(f"""WITH {_SCALED}, n AS (SELECT *, e[1] AS a, e[2] AS b FROM v)
SELECT vec_id, round(a + b, 6) AS added, round(a - b, 6) AS subtracted, round(a * b, 6) AS multiplied, round(a * 2.5, 6) AS scaled,
round(list_sum(list_transform(e, lambda x: x + x)), 6) AS twice, len(e)::BIGINT AS size FROM n""")
def vec_add_sub_mul_scale(spark, sf_dir):
    df = _scaled(spark, sf_dir).select("vec_id", "embedding", F.slice("embedding", 1, 1).alias("a"), F.slice("embedding", 2, 1).alias("b"))
    first = lambda v: F.round(F.get(v, F.lit(0)), 6)
    a, b, whole = F.col("a"), F.col("b"), F.col("embedding")
    return df.select(
        "vec_id", first(vector.add(a, b)).alias("added"), first(vector.subtract(a, b)).alias("subtracted"), first(vector.multiply(a, b)).alias("multiplied"),
        first(vector.scale(a, 2.5)).alias("scaled"), F.round(F.aggregate(vector.add(whole, whole), F.lit(0.0), lambda x, y: x + y), 6).alias("twice"), F.size(whole).cast("bigint").alias("size"),
    )


@query(f"WITH {_SCALED} SELECT vec_id, round(sqrt({_sql_dot('e', 'e')}), 6) AS norm FROM v")
def vec_norm(spark, sf_dir):
    return _scaled(spark, sf_dir).select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {_SCALED} SELECT vec_id, round(e[1] / sqrt({_sql_dot('e', 'e')}), 6) + 0.0 AS first, round(e[64] / sqrt({_sql_dot('e', 'e')}), 6) + 0.0 AS last FROM v")
def vec_normalize(spark, sf_dir):
    unit = vector.normalize(F.col("embedding"))
    return _scaled(spark, sf_dir).select("vec_id", (F.round(F.get(unit, F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get(unit, F.lit(63)), 6) + 0.0).alias("last"))


@query("SELECT label, (i - 1)::BIGINT AS at, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def centroid_by_label(spark, sf_dir):
    long = _embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("at", "x"))
    return long.groupBy("label", F.col("at").cast("bigint").alias("at")).agg((F.round(F.avg(F.col("x").cast("double")), 6) + 0.0).alias("mean"))


@query(f"WITH {_RAW}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0) SELECT vec_id, round({_sql_dot('e', 'qe')}, 6) + 0.0 AS dot FROM v, q")
def batch_dot(spark, sf_dir):
    """One arithmetic expression over the fixed dimension, in whole-stage code."""
    df = _embeddings(spark, sf_dir)
    return df.select("vec_id", (F.round(vector.unrolled_dot(F.col("embedding"), _asked(df)), 6) + 0.0).alias("dot"))


# --- quantizers -----------------------------------------------------------------------------

_RANGES = """r AS (SELECT list(low ORDER BY i) AS lows, list(high ORDER BY i) AS highs FROM (
SELECT i, min(embedding[i])::DOUBLE AS low, max(embedding[i])::DOUBLE AS high FROM embeddings, range(1, 65) t(i) GROUP BY i))"""


def _sql_codes(levels: int) -> str:
    return f"list_transform(range(1, 65), lambda i: greatest(0, least({levels}, floor((embedding[i]::DOUBLE - lows[i]) / (highs[i] - lows[i]) * {levels}.0)))::BIGINT)"


def _ranged(spark, sf_dir) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    return df.crossJoin(F.broadcast(quantize.scalar_train(df, "embedding")))  # one row


def _scalar(spark, sf_dir, bits: int) -> DataFrame:
    codes = quantize.scalar_encode(F.col("embedding"), F.col("lows"), F.col("highs"), bits)
    return _ranged(spark, sf_dir).select("vec_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


@query(f"WITH {_RANGES} SELECT vec_id, array_to_string({_sql_codes(255)}, ',') AS codes FROM embeddings, r")
def sq8_encode(spark, sf_dir):
    return _scalar(spark, sf_dir, 8)


@query(f"WITH {_RANGES} SELECT vec_id, array_to_string({_sql_codes(65535)}, ',') AS codes FROM embeddings, r")
def sq16_encode(spark, sf_dir):
    return _scalar(spark, sf_dir, 16)


@query(f"""WITH {_RANGES}, c AS (SELECT vec_id, embedding, lows, highs, {_sql_codes(255)} AS codes FROM embeddings, r)
SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(lows[i] + codes[i] / 255.0::DOUBLE * (highs[i] - lows[i]) - embedding[i]::DOUBLE))), 6) AS worst FROM c""")
def sq8_roundtrip_error(spark, sf_dir):
    codes = quantize.scalar_encode(F.col("embedding"), F.col("lows"), F.col("highs"), 8)
    back = quantize.scalar_decode(F.col("codes"), F.col("lows"), F.col("highs"), 8)
    error = F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double"))))
    return _ranged(spark, sf_dir).withColumn("codes", codes).select("vec_id", F.round(error, 6).alias("worst"))


_MEDIANS = """m AS (SELECT list_reduce(list(x ORDER BY i), lambda a, b: (a + b) / 2) AS t FROM (
SELECT i, list_sort(list(embedding[i]))[count(*) // 2 + 1]::DOUBLE AS x FROM embeddings, range(1, 65) t(i) GROUP BY i))"""
_BITS = """c AS (SELECT vec_id, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(0, 8), lambda j:
CASE WHEN embedding[i * 8 + j + 1]::DOUBLE > t THEN (128 >> j::INT) ELSE 0 END))::BIGINT) AS code FROM embeddings, m)"""


@query(f"WITH {_MEDIANS} SELECT round(t, 6) AS threshold FROM m")
def binary_threshold(spark, sf_dir):
    return quantize.upper_medians(_embeddings(spark, sf_dir), "embedding").select(F.round(quantize.binary_threshold(F.col("medians")), 6).alias("threshold"))


def _binary(spark, sf_dir) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    limit = quantize.upper_medians(df, "embedding").select(quantize.binary_threshold(F.col("medians")).alias("threshold"))
    return df.crossJoin(F.broadcast(limit)).select("vec_id", quantize.binary_encode(F.col("embedding"), F.col("threshold")).alias("code"))  # one row


@query(f"WITH {_MEDIANS}, {_BITS} SELECT vec_id, array_to_string(code, ',') AS code FROM c")
def binary_encode(spark, sf_dir):
    return _binary(spark, sf_dir).select("vec_id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def _codes_and_query(spark, sf_dir):
    codes = _binary(spark, sf_dir)
    asked = codes.where("vec_id = 0").first()["code"]
    return codes, F.array(*[F.lit(int(x)).cast("smallint") for x in asked])


@query(f"""WITH {_MEDIANS}, {_BITS}, q AS (SELECT code AS qc FROM c WHERE vec_id = 0)
SELECT vec_id, list_sum(list_transform(list_zip(code, qc), lambda z: bit_count(xor(z[1], z[2]))))::BIGINT AS distance FROM c, q ORDER BY distance, vec_id LIMIT {K}""")
def hamming_topk(spark, sf_dir):
    codes, asked = _codes_and_query(spark, sf_dir)
    return codes.select("vec_id", vector.hamming(F.col("code"), asked).alias("distance")).orderBy("distance", "vec_id").limit(K)


@query(f"""WITH {_MEDIANS}, {_BITS}, q AS (SELECT code AS qc FROM c WHERE vec_id = 0),
n AS (SELECT vec_id, list_sum(list_transform(list_zip(code, qc), lambda z: bit_count(z[1] & z[2]))) AS common,
list_sum(list_transform(code, lambda x: bit_count(x))) AS a, list_sum(list_transform(qc, lambda x: bit_count(x))) AS b FROM c, q)
SELECT vec_id, round(common / (sqrt(a) * sqrt(b)), 6) AS similarity FROM n ORDER BY similarity DESC, vec_id LIMIT {K}""")
def binary_cosine_topk(spark, sf_dir):
    codes, asked = _codes_and_query(spark, sf_dir)
    return codes.select("vec_id", F.round(vector.binary_cosine(F.col("code"), asked), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(K)


# --- indexes --------------------------------------------------------------------------------

_CLUSTERS = 5
#: Of the measured inverted lists.
_RECALL_LISTS, _RECALL_PROBES = 10, 8
_ONE_STEP = f"""{_RAW}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, e AS ce FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= {_CLUSTERS}),
a0 AS (SELECT vec_id, e, c FROM v, c0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({_sql_l2('e', 'ce')}, 12), c) = 1),
c1 AS (SELECT c, list(m ORDER BY i) AS ce FROM (SELECT c, i, round(avg(e[i]), 9) AS m FROM a0, range(1, 65) t(i) GROUP BY c, i) GROUP BY c),
a1 AS (SELECT vec_id, label, e, c AS cluster FROM v, c1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({_sql_l2('e', 'ce')}, 12), c) = 1)"""


@query(f"WITH {_ONE_STEP} SELECT vec_id, cluster FROM a1")
def kmeans_assign_1iter(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return kmeans.assign(df, kmeans.fit(df, _CLUSTERS, 1, "l2", "vec_id", "embedding"), "embedding").select("vec_id", "cluster")


@query(f"""WITH {_ONE_STEP}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
p AS (SELECT c FROM c1, q ORDER BY round({_sql_l2('qe', 'ce')}, 12), c LIMIT 2),
h AS (SELECT vec_id, round({_sql_l2('e', 'qe')}, 6) + 0.0 AS distance FROM a1, q WHERE cluster IN (SELECT c FROM p) ORDER BY distance, vec_id LIMIT {K})
SELECT vec_id, distance, round(1 - distance, 6) AS score FROM h""")
def ivf_probe_topk(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    index = indexes.ivf_build(df, _CLUSTERS, 1, "l2", "vec_id", "embedding")
    return indexes.ivf_search(index, _asked(df), K, 2, "vec_id", "embedding").select("vec_id", "distance", "score")


@query()
def kmeans_converged(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return kmeans.assign(df, kmeans.fit(df, 10, 20, "l2", "vec_id", "embedding"), "embedding").select("vec_id", "cluster")


@query()
def pq_encode(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return quantize.ProductQuantizer.train(df, 8, 16, 5, "vec_id", "embedding").encode(df, "embedding").select("vec_id", "codes")


@query()
def hnsw_graph_search(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    graph = indexes.graph_build(df, 4, 8, 64, "cosine", "vec_id", "embedding")
    return indexes.graph_search(graph, _asked(df), K, 100)


@query()
def rp_forest_search(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return indexes.forest_search(indexes.forest_paths(df, vector_col="embedding"), _asked(df), K, id_col="vec_id", vector_col="embedding").select("vec_id", "distance", "score")


@query()
def index_recall_at_k(spark, sf_dir):
    """Of the inverted lists, the graph and the forest against the exact join, for every id divisible by 100."""
    df = _embeddings(spark, sf_dir)
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = knn.knn_join(df, asked, K, "cosine", "vec_id", "embedding", "query_id", "query")
    found = {
        "ivf": indexes.ivf_join(indexes.ivf_build(df, _RECALL_LISTS, 10, "cosine", "vec_id", "embedding"), asked, K, _RECALL_PROBES, "vec_id", "embedding"),
        "graph": indexes.graph_join(indexes.graph_build(df, 4, 8, 64, "cosine", "vec_id", "embedding"), asked, K, 100),
        "forest": indexes.forest_join(indexes.forest_paths(df, vector_col="embedding"), asked, K, id_col="vec_id", vector_col="embedding"),
    }
    parts = [knn.recall_at_k(hits, exact, K).withColumn("index", F.lit(name)) for name, hits in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT vec_id, distance, score, vec_id // 100 AS page_id FROM ({_sql_top(_sql_cosine('e', 'qe'), _RAW)})")
def paged_topk(spark, sf_dir):
    """From pages on disk, read back."""
    df = _embeddings(spark, sf_dir)
    path = scratch(spark, "pages")
    indexes.save_pages(indexes.with_page(df, 100, "vec_id"), path)
    pages = spark.read.schema("vec_id bigint, embedding array<float>, label int, page_id bigint").parquet(path)
    return knn.search(pages, _asked(df), K, "cosine", "vec_id", "embedding").select("vec_id", "distance", "score", "page_id")


@query(f"SELECT vec_id, distance FROM ({_sql_top(_sql_cosine('e', 'qe'), _RAW)})")
def tiered_merge_topk(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    hot = df.where("label < 3")
    return indexes.tiered_search(hot, df, _asked(df), K, "cosine", "vec_id", "embedding")


@query("SELECT count(*) AS vector_count, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, 0::BIGINT AS empty, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings")
def collection_stats(spark, sf_dir):
    from vectrill import metrics

    return metrics.collection_stats(_embeddings(spark, sf_dir), "embedding")
