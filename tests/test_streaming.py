import datetime as dt
import time

from pyspark.sql import functions as F

from vectrill.sources.store import VersionedStore
from vectrill.streaming import ingest


def test_upsert_stream(spark, tmp_path):
    schema = "id long, seq long, op string, v int"
    source, store = tmp_path / "in", VersionedStore(spark, str(tmp_path / "t"))
    run = lambda: ingest.upsert_stream(spark.readStream.schema(schema).json(str(source)), store, str(tmp_path / "log")).awaitTermination()
    spark.createDataFrame([(1, 1, "insert", 10), (2, 2, "insert", 20), (1, 3, "insert", 11)], schema).write.mode("append").json(str(source))
    run()
    spark.createDataFrame([(2, 4, "delete", None), (3, 5, "insert", 30)], schema).write.mode("append").json(str(source))
    run()
    assert sorted((r.id, r.v) for r in store.read().collect()) == [(1, 11), (3, 30)]
    run()
    assert len(store.versions()) == 2


def test_promote(spark, tmp_path):
    schema = "id long"
    spark.createDataFrame([(1,), (1,), (1,), (2,)], schema).write.json(str(tmp_path / "in"))
    out = ingest.promote(spark.readStream.schema(schema).json(str(tmp_path / "in")), 3)
    out.writeStream.format("memory").queryName("promoted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    started, deadline = spark.streams.active[0], time.time() + 60  # with timeouts there is always another batch to run, so it is stopped
    while not spark.table("promoted").count() and time.time() < deadline:
        time.sleep(1)
    started.stop()
    assert [(r.id, r.event) for r in spark.table("promoted").collect()] == [(1, "promote")]


def test_term_statistics(spark):
    docs = spark.createDataFrame([("alpha alpha beta",), ("beta",)], "text string")
    assert {(r.term, r.cf, r.df) for r in ingest.term_statistics(docs).collect()} == {("alpha", 2, 1), ("beta", 2, 2)}


def test_access_counts(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5)), (1, dt.datetime(2024, 1, 1, 0, 50)), (1, dt.datetime(2024, 1, 1, 1, 5))], "id long, ts timestamp")
    assert sorted(r.accesses for r in ingest.access_counts(events).select(F.col("accesses")).collect()) == [1, 2]
