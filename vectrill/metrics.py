"""Statistics of collections and of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def collection_stats(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row: vectors, their smallest and largest dimension, empty ones, mean norm."""
    from vectrill.functions.vector import norm

    size = F.size(vector_col)
    return df.agg(
        F.count("*").alias("vector_count"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"),
        F.coalesce(F.sum((size <= 0).cast("bigint")), F.lit(0)).alias("empty"), F.round(F.avg(norm(F.col(vector_col))), 6).alias("mean_norm"),
    )


def latency_stats(df: DataFrame, latency_col: str = "latency", by: list[str] | None = None) -> DataFrame:
    """Operations, mean, 99th percentile (exact, the value at that rank), maximum, and operations a unit of time."""
    x = F.col(latency_col)
    return df.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.round(F.avg(x), 6).alias("avg"), F.percentile(x, 0.99).alias("p99"), F.max(x).alias("max"), F.round(F.count(x) / F.sum(x), 6).alias("throughput")
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with row counts that are known once it has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def prometheus_text(values: dict[str, float], prefix: str = "vectrill") -> str:
    """Counters and gauges in the text exposition format."""
    return "".join(f"{prefix}_{name} {value}\n" for name, value in sorted(values.items()))
