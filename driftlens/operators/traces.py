"""Span metrics, service graphs and tail sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the duration histogram, in milliseconds.
BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def sanitize_name(name: Column) -> Column:
    """Ids in span names as placeholders: UUIDs, long hexadecimal strings, numbers between slashes."""
    out = F.regexp_replace(name, r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "{id}")
    return F.regexp_replace(F.regexp_replace(out, r"\b[0-9a-fA-F]{16,}\b", "{id}"), r"/[0-9]+", "/{id}")


def span_metrics(spans: DataFrame, dims: tuple[str, ...] = ("service_name", "span_name", "span_kind", "status_code")) -> DataFrame:
    """calls, duration_sum and cumulative buckets ``le_*`` by dimension; all partial aggregates in one shuffle."""
    counts = [F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in BOUNDS]
    return spans.groupBy(*dims).agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("duration_sum"), *counts)


def service_graph(spans: DataFrame) -> DataFrame:
    """Requests, failures and mean latency by (client, server), from spans joined with their parents."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service_name").alias("client"))
    both = spans.select("trace_id", "parent_id", F.col("service_name").alias("server"), "duration_ms", "status_code").join(parent, ["trace_id", "parent_id"])
    return both.where("client <> server").groupBy("client", "server").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") == "ERROR").alias("failed"), F.avg("duration_ms").alias("latency"))


def tail_sample(spans: DataFrame, percent: int, bucket: Column, slow_ms: float = 1000, probe: Column | None = None) -> DataFrame:
    """Spans of the traces to keep: no probes; those with an error, slow ones, forced ones, and a share of the rest."""
    drop = F.lit(False) if probe is None else probe
    judged = spans.groupBy("trace_id").agg(
        F.bool_or(F.col("status_code") == "ERROR").alias("bad"), (F.max("duration_ms") > slow_ms).alias("slow"),
        F.bool_or(F.coalesce(F.col("forced"), F.lit(False))).alias("forced") if "forced" in spans.columns else F.lit(False).alias("forced"),
        F.bool_and(drop).alias("probe"),
    )
    keep = judged.where(~F.col("probe") & (F.col("bad") | F.col("slow") | F.col("forced") | (bucket < percent)))
    return spans.join(keep.select("trace_id"), "trace_id", "left_semi")
