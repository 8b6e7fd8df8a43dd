"""Streams into collections: upserts, access counts, lexical statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectrill.operators import lexical
from vectrill.sources.store import VersionedStore, delete


def upsert_stream(changes: DataFrame, store: VersionedStore, checkpoint: str, seq_col: str = "seq", op_col: str = "op", interval: str | None = None) -> StreamingQuery:
    """Applies a stream of changes (op insert or delete, in order of seq) to the store, a version a batch; the checkpoint is the log.

    A batch that is replayed after a failure gives the same table. Without an interval all that is there is taken and the query ends.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        last = batch.groupBy(store.id_col).agg(F.max_by(F.struct(*batch.columns), seq_col).alias("r")).select("r.*").persist()
        put = last.where(F.col(op_col) != "delete").drop(op_col)
        if store.versions():
            kept = delete(store.read(), last, store.id_col)
            store.write(kept.unionByName(put.drop(seq_col)))
        else:
            store.write(put.drop(seq_col))
        last.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def access_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """(window_start, id, accesses, last_access) of a stream or table; rows later than `late` are left out of streams."""
    marked = events.withWatermark(ts_col, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts_col, window), id_col).agg(F.count("*").alias("accesses"), F.max(ts_col).alias("last_access")).select(F.col("window.start").alias("window_start"), id_col, "accesses", "last_access")


def promote(events: DataFrame, threshold: int = 3, ttl_ms: int = 3_600_000, id_col: str = "id") -> DataFrame:
    """(id, accesses, event): `promote` when an id has been read often enough, `evict` when it has not been read for the time given."""
    key = events.schema[id_col].dataType.simpleString()

    def track(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (count,) = state.get
            state.remove()
            if count >= threshold:
                yield pd.DataFrame({id_col: [keys[0]], "accesses": [count], "event": ["evict"]})
            return
        before = state.get[0] if state.exists else 0
        count = before + sum(len(f) for f in frames)
        state.update((count,))
        state.setTimeoutDuration(ttl_ms)
        if before < threshold <= count:
            yield pd.DataFrame({id_col: [keys[0]], "accesses": [count], "event": ["promote"]})

    return events.groupBy(id_col).applyInPandasWithState(track, f"{id_col} {key}, accesses bigint, event string", "n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def term_statistics(documents: DataFrame, config: lexical.LexicalConfig = lexical.LexicalConfig(), text_col: str = "text") -> DataFrame:
    """(term, cf, df) of a stream of documents, each document once; write it in update or complete mode."""
    words = documents.select(config.tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    distinct = words.select("tokens", F.explode(F.array_distinct("tokens")).alias("term"))
    counted = distinct.select("term", F.size(F.filter("tokens", lambda w: w == F.col("term"))).alias("n"))
    return counted.groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


def when_ready(batch_function: Callable[[DataFrame], None], ready: Callable[[DataFrame], bool]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs the function for batches that are ready (training at a size, backups by time)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if ready(batch):
            batch_function(batch)

    return run
