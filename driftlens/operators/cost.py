"""Graduated prices and what a month costs by three ways of charging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Tiers = list[tuple[float, float]]


def banded(quantity: Column, tiers: Tiers, free: float = 0.0) -> Column:
    """Each band of (upper bound, rate) is charged for what falls into it, less the free amount at the first rate."""
    q, lo, total = quantity.cast("double"), 0.0, F.lit(0.0)
    for hi, rate in tiers:
        total += F.greatest(F.least(q, F.lit(float(hi))) - lo, F.lit(0.0)) * rate
        lo = float(hi)
    return total - F.least(q, F.lit(float(free))) * tiers[0][1]


def graduated(quantities: DataFrame, tiers: Tiers, free: float = 0.0, quantity: str = "quantity") -> DataFrame:
    """Adds ``cost``; tiers are configuration, so they become one expression."""
    return quantities.withColumn("cost", banded(F.col(quantity), tiers, free))


def by_stage(gb: Column, series: Column, stages: list[Tiers], series_tiers: Tiers, free: float = 0.0, per_minute: float = 1.0, fee: float = 0.0) -> Column:
    """``struct<logs, metrics, total>``: each stage charges the volume, series are charged by samples a minute."""
    logs = sum((banded(gb, t, free) for t in stages), F.lit(0.0))
    metrics = banded(series * per_minute, series_tiers)
    return F.struct(logs.alias("logs"), metrics.alias("metrics"), (logs + metrics + fee).alias("total"))


def by_event(gb: Column, series: Column, gb_rate: float, million_events: float, event_bytes: float, series_rate: float, hosts: int, host_rate: float, free_series: int = 0) -> Column:
    """``struct<ingest, index, metrics, hosts, total>``: volume, events, hosts, and the series beyond those of the hosts."""
    parts = {"ingest": gb * gb_rate, "index": gb * 1e9 / event_bytes / 1e6 * million_events}
    parts |= {"metrics": F.greatest(series - hosts * free_series, F.lit(0)) * series_rate, "hosts": F.lit(float(hosts * host_rate))}
    return F.struct(*(c.alias(k) for k, c in parts.items()), sum(parts.values(), F.lit(0.0)).alias("total"))


def by_volume(gb: Column, series: Column, log_tiers: tuple[Tiers, Tiers], metric_tiers: tuple[Tiers, Tiers], meter: float, sample_bytes: float, samples_a_month: float) -> Column:
    """``struct<ingest, retained, metrics, total>``: logs and samples by metered volume, at ingest and while kept."""
    logs, metrics = gb * meter, series * samples_a_month * sample_bytes / 1e9 * meter
    parts = {"ingest": banded(logs, log_tiers[0]), "retained": banded(logs, log_tiers[1]), "metrics": banded(metrics, metric_tiers[0]) + banded(metrics, metric_tiers[1])}
    return F.struct(*(c.alias(k) for k, c in parts.items()), sum(parts.values(), F.lit(0.0)).alias("total"))
