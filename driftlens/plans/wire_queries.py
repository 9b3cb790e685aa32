"""Queries over samples that travel in wire formats: what comes out of a round trip is compared with the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.sources import wire


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(labels, ts in ms, value, is_stale) of every event; those of a thirteenth of the users are stale markers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = F.create_map(F.lit("__name__"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 5).cast("string"))
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(labels.alias("labels"), F.floor(ts / 1000).cast("long").alias("ts"), "value", (F.col("user_id") % 13 == 0).alias("is_stale"))


def remote_write(spark, sf_dir):
    """Per series the samples, stale markers, first and last time and sum that come out of encoded bodies."""
    got = wire.decode_writes(wire.encode_writes(samples(spark, sf_dir)))
    sums = got.groupBy(F.col("labels")["__name__"].alias("name"), F.col("labels")["shard"].alias("shard"))
    return sums.agg(
        F.count_if("is_stale").alias("stale"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("error").alias("errors"),
        F.sum(F.when(~F.col("is_stale"), F.round("value", 2).cast("decimal(20,2)"))).cast("double").alias("total"),
    )


def range_answers(spark, sf_dir):
    """Daily totals through the JSON of range queries: one answer for each event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) * 86400).cast("long")
    daily = e.groupBy("event_type", day.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    pair = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit(',"'), F.col("n").cast("string"), F.lit('"]'))
    values = daily.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("values"))
    body = F.concat(F.lit('{"status":"success","data":{"result":[{"metric":{"prometheus":"a","type":"'), "event_type", F.lit('"},"values":['), "values", F.lit(',[1,"NaN"]]}]}}'))
    got = wire.range_samples(values.select(body.alias("body")))
    return got.select(F.col("labels")["type"].alias("type"), F.size("labels").alias("n_labels"), "ts", "value")


def openmetrics_history(spark, sf_dir):
    """Lines of a history: hourly numbers of events by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600).cast("long")
    counts = e.groupBy("event_type", hour.alias("ts")).agg(F.count(F.lit(1)).alias("value"))
    rows = counts.select(F.lit("events").alias("metric"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("by"), F.lit('a "b"')).alias("labels"), "ts", "value")
    return wire.openmetrics(rows).select("part", "line")


QUERIES = {f.__name__: f for f in (remote_write, range_answers, openmetrics_history)}

ORACLE = {
    "remote_write": """select event_type as name, (user_id % 5)::varchar as shard, count(*) filter (user_id % 13 = 0) as stale, count(*) as n,
min(epoch_us(ts) // 1000) as first, max(epoch_us(ts) // 1000) as last, 0::bigint as errors, sum(round(value, 2)::decimal(20,2)) filter (user_id % 13 <> 0)::double as total from events group by 1, 2""",
    "range_answers": "select event_type as type, 1::int as n_labels, epoch_us(ts) // 86400000000 * 86400 as ts, count(*)::double as value from events group by 1, 3",
    "openmetrics_history": """select 0::int as part, '# TYPE events gauge' as line union all
select 1, 'events{by="a \\"b\\"",type="' || event_type || '"} ' || count(*) || ' ' || (epoch_us(ts) // 3600000000 * 3600) from events group by event_type, epoch_us(ts) // 3600000000""",
}
