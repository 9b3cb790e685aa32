"""Regular series from samples and counts: buckets, gap fill, caps, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(ts: Column, step: int) -> Column:
    """Bucket number of a timestamp (as UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (step * 1_000_000)).cast("long")


def clean_samples(samples: DataFrame, now: Column, value: str = "value", ts: str = "ts", max_future: int = 300) -> DataFrame:
    """Finite samples that are not more than ``max_future`` seconds ahead."""
    v = F.col(value)
    return samples.where(~F.isnan(v) & (F.abs(v) < float("inf")) & (F.col(ts) <= now + F.make_dt_interval(secs=F.lit(max_future))))


def drop_labels(labels: Column, ignored: tuple[str, ...] = ("prometheus", "prometheus_replica")) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*ignored))


def bucketize(samples: DataFrame, keys: tuple[str, ...], step: int, agg: str, ts: str = "ts", value: str | None = None, storage: str = "double") -> DataFrame:
    """(keys, bucket, value): mean, sum or count of each bucket; a partial aggregation before the one shuffle."""
    how = {"mean": lambda: F.avg(value), "sum": lambda: F.sum(value), "count": lambda: F.count(F.lit(1))}[agg]()
    kind = "float" if storage == "float32" else "double"
    return samples.groupBy(*keys, bucket(F.col(ts), step).alias("bucket")).agg(how.cast(kind).alias("value"))


def gap_fill(series: DataFrame, keys: tuple[str, ...], agg: str, open_bucket: int | None = None) -> DataFrame:
    """Every bucket from a series' first to the last closed one; gaps are 0 for sums and counts, null for means.

    The open bucket is the latest of all series unless given; it and later ones are left out.
    """
    spans = series.groupBy(*keys).agg(F.min("bucket").alias("lo"))
    if open_bucket is None:
        head = F.broadcast(series.agg(F.max("bucket").alias("open")))  # one row
        spans = spans.join(head)
    else:
        spans = spans.withColumn("open", F.lit(open_bucket).cast("long"))
    grid = spans.where("lo < open").select(*keys, F.explode(F.sequence("lo", F.col("open") - 1)).alias("bucket"))
    out = grid.join(series, [*keys, "bucket"], "left")
    return out if agg == "mean" else out.withColumn("value", F.coalesce("value", F.lit(0.0)))


def first_seen_cap(rows: DataFrame, key: str, order: str, cap: int, other: str) -> DataFrame:
    """Keys beyond the ``cap`` first seen share ``other``; the ranking is over keys, not rows."""
    seen = rows.groupBy(key).agg(F.min(order).alias("__first"))
    top = seen.orderBy("__first", key).limit(cap).select(F.col(key).alias("__kept"))
    return rows.join(top, rows[key] == F.col("__kept"), "left").withColumn(key, F.when(F.col("__kept").isNotNull(), F.col(key)).otherwise(F.lit(other))).drop("__kept")


def volume_and_template_counts(counts: DataFrame) -> DataFrame:
    """Template series and volume series from the same counts, by grouping sets."""
    out = counts.groupingSets([["service", "template_id", "bucket"], ["service", "level", "bucket"]], "service", "template_id", "level", "bucket").agg(F.sum("n").alias("value"), F.grouping_id().alias("gid"))
    return out.withColumn("name", F.when(F.col("gid").bitwiseAND(4) > 0, "volume").otherwise("template")).drop("gid")


def cumulative(deltas: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Running sums of deltas."""
    return deltas.withColumn("cumulative", F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def dominant_level(counts: DataFrame, keys: tuple[str, ...], level: str = "level", n: str = "n") -> DataFrame:
    """The level with most lines of each key; ties to the smaller name."""
    summed = counts.groupBy(*keys, level).agg(F.sum(n).alias("__n"))
    return summed.groupBy(*keys).agg(F.min_by(level, F.struct(-F.col("__n"), F.col(level))).alias("dominant"), F.sum("__n").alias("lines"))


def late_mean(samples: DataFrame, keys: tuple[str, ...], step: int, arrival: str, window: int = 8) -> DataFrame:
    """Bucket means when samples come late: those up to ``window`` buckets behind the head of their arrival count,
    older ones only where the bucket would be empty."""
    w = W.partitionBy(*keys).orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    b = samples.withColumn("bucket", bucket(F.col("ts"), step))
    b = b.withColumn("head", F.max("bucket").over(w)).withColumn("late", F.col("head") - F.col("bucket") > window)
    first = F.min_by("value", arrival)
    out = b.groupBy(*keys, "bucket").agg(F.avg(F.when(~F.col("late"), F.col("value"))).alias("m"), first.alias("f"))
    return out.select(*keys, "bucket", F.coalesce("m", "f").alias("value"))
