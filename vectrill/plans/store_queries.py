"""Queries for storage, filters, validation, logs, streams and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill import metrics
from vectrill.functions.filters import compile_filter
from vectrill.operators import indexes
from vectrill.plans.registry import query, table
from vectrill.sources import formats, store
from vectrill.sources.scratch import scratch
from vectrill.streaming import ingest

# --- look-ups and changes -------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS price FROM orders WHERE o_orderkey = 7")
def point_get(spark, sf_dir):
    return store.point_get(table(spark, sf_dir, "orders"), 7, "o_orderkey").select("o_orderkey", "o_custkey", F.round("o_totalprice", 6).alias("price"))


_ASKED = [(i, k) for i, k in enumerate([5, 3, 999_999_999, 1, 3])]


@query(f"WITH a(ord, vec_id) AS (VALUES {', '.join(f'({i}::BIGINT, {k}::BIGINT)' for i, k in _ASKED)}) SELECT ord, vec_id, label FROM a LEFT JOIN embeddings USING (vec_id)")
def batch_get_ordered(spark, sf_dir):
    asked = spark.createDataFrame(_ASKED, "ord long, vec_id long")
    return store.batch_get(table(spark, sf_dir, "embeddings").select("vec_id", "label"), asked, "vec_id")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def exists_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.exists(orders, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""SELECT id, value FROM (SELECT c_custkey AS id, round(c_acctbal, 6) AS value, -1 AS seq FROM customer UNION ALL
SELECT o_custkey, round(o_totalprice, 6), o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""")
def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 6).alias("value"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.round("o_totalprice", 6).alias("value"), F.col("o_orderkey").alias("seq"))
    return store.upsert(base, changes)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT count(*) AS n FROM embeddings")
def count_live(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, label FROM embeddings")
def snapshot_roundtrip(spark, sf_dir):
    """Written as a version, read back through the pointer."""
    saved = store.VersionedStore(spark, scratch(spark, "store"))
    saved.write(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"))
    return saved.read()


@query("SELECT vec_id, label, len(embedding)::BIGINT AS size, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings")
def binary_record_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    data = df.select("label", formats.to_binary(F.col("vec_id").cast("string"), "embedding", F.lit(0).cast("bigint")).alias("data"))
    back = data.select("label", formats.from_binary("data").alias("r"))
    return back.select(F.col("r.id").cast("bigint").alias("vec_id"), "label", F.size("r.vector").cast("bigint").alias("size"), (F.round(F.get("r.vector", F.lit(0)).cast("double"), 6) + 0.0).alias("first"))


# --- filters --------------------------------------------------------------------------------


def _filtered(df: DataFrame, filter_: dict, *columns: str) -> DataFrame:
    return df.where(compile_filter(filter_, df)).select(*columns)


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn <> 0")
def filter_eq_ne(spark, sf_dir):
    return _filtered(table(spark, sf_dir, "conversations"), {"role": "user", "turn": {"$ne": 0}}, "conv_id", "turn")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 500 AND n_chars <= 2000 AND false IS NOT TRUE")
def filter_range(spark, sf_dir):
    return _filtered(table(spark, sf_dir, "documents"), {"n_chars": {"$gt": 500, "$lte": 2000}}, "doc_id", "n_chars")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src0', 'src1')")
def filter_in_nin(spark, sf_dir):
    return _filtered(table(spark, sf_dir, "documents"), {"lang": {"$in": ["en", "de"]}, "source": {"$nin": ["src0", "src1"]}}, "doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' OR n_chars < 100")
def filter_or(spark, sf_dir):
    """Keys beside $or are ignored."""
    return _filtered(table(spark, sf_dir, "documents"), {"$or": [{"lang": "fr"}, {"n_chars": {"$lt": 100}}], "source": "src0"}, "doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_and(spark, sf_dir):
    return _filtered(table(spark, sf_dir, "orders"), {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gte": 100000}}]}, "o_orderkey")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1")
def filter_missing_field(spark, sf_dir):
    """A missing label fails even $ne."""
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _filtered(df, {"toxic": {"$ne": 1}}, "doc_id")


@query("SELECT event_id FROM events WHERE epoch(date_trunc('second', ts))::BIGINT >= epoch(TIMESTAMP '2024-01-01 12:00:00')::BIGINT AND epoch(date_trunc('second', ts))::BIGINT < epoch(TIMESTAMP '2024-01-10 00:00:00')::BIGINT")
def filter_time_range(spark, sf_dir):
    return _filtered(table(spark, sf_dir, "events"), {"ts": {"$gte": dt.datetime(2024, 1, 1, 12), "$lt": dt.datetime(2024, 1, 10)}}, "event_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn::VARCHAR = '1'")
def filter_type_coercion(spark, sf_dir):
    """A number equals the text that it prints as; texts have no order."""
    df = table(spark, sf_dir, "conversations")
    return _filtered(df, {"$or": [{"turn": "1"}, {"role": {"$gt": "a"}}]}, "conv_id", "turn")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE (props::JSON->>'k')::BIGINT >= 50")
def filter_json_payload(spark, sf_dir):
    """An open payload as VARIANT."""
    df = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    return _filtered(df, {"k": {"$gte": 50}}, "event_id", "k")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents AS d JOIN labels USING (doc_id) WHERE quality = 1")
def payload_projection_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return _filtered(rows, {"quality": 1}, "doc_id", "lang", "quality", "toxic")


@query("""WITH b AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 11 = 0 THEN 'é' || vec_id ELSE vec_id::VARCHAR END AS key,
  CASE WHEN vec_id % 5 = 0 THEN list_append(embedding[1:63]::DOUBLE[], 'nan'::DOUBLE) WHEN vec_id % 3 = 0 THEN embedding[1:63]::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings)
SELECT vec_id, length(key) > 0 AND len(list_filter(v, lambda x: isnan(x))) = 0 AS valid, len(v) = 64 AS fits, length(key) BETWEEN 1 AND 1024 AND regexp_full_match(key, '[ -~]*') AS id_ok FROM b""")
def validate_batch(spark, sf_dir):
    """Rows among which some have no id, an id beyond ASCII, a NaN or too few elements."""
    own, short = F.col("embedding").cast("array<double>"), F.slice("embedding", 1, 63).cast("array<double>")
    key = F.when(F.col("vec_id") % 7 == 0, "").when(F.col("vec_id") % 11 == 0, F.concat(F.lit("é"), F.col("vec_id").cast("string"))).otherwise(F.col("vec_id").cast("string"))
    v = F.when(F.col("vec_id") % 5 == 0, F.array_append(short, F.lit(float("nan")))).when(F.col("vec_id") % 3 == 0, short).otherwise(own)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", key.alias("key"), v.alias("v"))
    return rows.select("vec_id", store.valid_vector(F.col("key"), F.col("v")).alias("valid"), store.valid_dimension(F.col("v"), 64).alias("fits"), store.valid_id(F.col("key")).alias("id_ok"))


@query()
def checksum_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("crc", formats.record_checksum(F.col("vec_id").cast("string"), "embedding"))
    checked = formats.verify_checksum(rows, "crc", "vec_id", "embedding")
    return checked.select("vec_id", "crc", "intact", formats.payload_checksum(F.col("label").cast("string")).alias("payload_crc"))


# --- logs, backups, tiers -------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), F.round("value", 6).alias("value"))


_LAST = """SELECT user_id AS id, {columns} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"""


@query(_LAST.format(columns="event_id AS seq, 'insert' AS op, round(value, 6) AS value"))
def wal_replay(spark, sf_dir):
    return store.replay(_log(spark, sf_dir))


@query("""WITH b AS (SELECT event_id, ts FROM events WHERE event_type = 'signup'), t AS (SELECT max(ts) AS now FROM events)
SELECT event_id, ts FROM b, t WHERE ts > now - INTERVAL 7 DAYS ORDER BY ts DESC, event_id DESC LIMIT 10""")
def backup_retention(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return store.retention(events.where("event_type = 'signup'").select("event_id", "ts"), now, ties=("event_id",))


@query("""WITH t AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY user_id)
SELECT user_id, accesses, last_access FROM c, t WHERE accesses >= 3 AND epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', last_access))::BIGINT <= 86400 ORDER BY accesses DESC, last_access DESC, user_id LIMIT 100""")
def tiered_hot_set(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    return indexes.hot_set(events, events.agg(F.max("ts")).first()[0], 3, 86_400, 100, "user_id")


@query("SELECT round(list_reduce(list_prepend(0.0::DOUBLE, list((event_type = 'view')::INT::DOUBLE ORDER BY ts, event_id)), lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS hit_rate FROM events")
def hit_rate_ema(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("ts", "event_id", (F.col("event_type") == "view").cast("double").alias("hit"))
    return indexes.hit_rate_average(hits, "ts", "event_id").select(F.round("hit_rate", 6).alias("hit_rate"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(count(value) / sum(value), 6) AS throughput FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.latency_stats(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("p99", F.round("p99", 6))


# --- streams --------------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as streams list folders and not single files


@query(_LAST.format(columns="round(value, 6) AS value"))
def stream_upsert(spark, sf_dir):
    """All that the source holds, applied as a stream; the table read afterwards."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    changes = _event_stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), F.round("value", 6).alias("value"))
    saved = store.VersionedStore(spark, scratch(spark, "stream"))
    ingest.upsert_stream(changes, saved, scratch(spark, "log")).awaitTermination()
    return saved.read()


@query("SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY ALL")
def stream_access_counts(spark, sf_dir):
    """Hourly counts of a stream, written by its last batch."""
    path = scratch(spark, "counts")
    events = _event_stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    counts = ingest.access_counts(events, id_col="user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "last_access")})
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    writer.option("checkpointLocation", scratch(spark, "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
