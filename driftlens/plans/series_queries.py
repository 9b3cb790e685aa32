"""Series, scores, range functions and rules over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import detect, lifecycle, promql, rules, series

HOUR = 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, bucket, value): counts by event type and hour, gaps filled, the open hour left out."""
    counts = series.bucketize(events(spark, sf_dir).select(F.col("event_type").alias("key"), "ts"), ("key",), HOUR, "count")
    return series.gap_fill(counts, ("key",), "sum")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts, value) with ts in seconds at the hours of ``hourly``."""
    return hourly(spark, sf_dir).select("key", (F.col("bucket") * HOUR).alias("ts"), "value")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


PARAMS = detect.Params(season=24, seasons=3, lookback=24, abs_floor=1.0, rel_floor=0.1, poisson=True)


def scores(spark, sf_dir):
    return detect.score(hourly(spark, sf_dir), ("key",), PARAMS)


def bucket_mean(spark, sf_dir):
    return r6(series.bucketize(events(spark, sf_dir), ("event_type",), HOUR, "mean", value="value"), "value")


def bucket_count(spark, sf_dir):
    return series.bucketize(events(spark, sf_dir), ("event_type",), HOUR, "count")


def gap_fill_sum(spark, sf_dir):
    return hourly(spark, sf_dir)


def gap_fill_mean(spark, sf_dir):
    means = series.bucketize(events(spark, sf_dir).select(F.col("event_type").alias("key"), "ts", "value"), ("key",), HOUR, "mean", value="value")
    return r6(series.gap_fill(means, ("key",), "mean"), "value")


def seasonal_score(spark, sf_dir):
    out = r6(scores(spark, sf_dir), "expected", "scale", "score", "lower", "upper")
    return out.select("key", "bucket", "observed", "expected", "scale", "score", "lower", "upper", "is_seasonal")


def scale_cached(spark, sf_dir):
    return detect.score_in_python(hourly(spark, sf_dir), ("key",), PARAMS, scale_every=4)


def anomaly_rate(spark, sf_dir):
    return r6(rules.anomaly_rate(scores(spark, sf_dir), ("key",), 2.0), "share")


def top_scores(spark, sf_dir):
    rows = r6(scores(spark, sf_dir), "score").select("key", "bucket", "score")
    return promql.topk(rows, 2, ("bucket",), F.abs("score"), "key")


def flagged(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("anomalous", detect.anomalous(threshold=1.5, min_volume=1.0))


def firing_islands(spark, sf_dir):
    return r6(lifecycle.firing_islands(flagged(spark, sf_dir), ("key",)), "peak")


def debounce_events(spark, sf_dir):
    return r6(lifecycle.debounce_events(flagged(spark, sf_dir), ("key",)), "score")


def absent_series(spark, sf_dir):
    users = series.bucketize(events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "value"), ("key",), 86400, "sum", value="value")
    return lifecycle.absent_series(users, ("key",), 3)


def cumulative_counts(spark, sf_dir):
    return series.cumulative(hourly(spark, sf_dir), ("key",), "bucket", "value")


def counter_increase(spark, sf_dir):
    # a counter that starts again every two days
    x = points(spark, sf_dir).withColumn("span", F.floor(F.col("ts") / 172800))
    counter = series.cumulative(x, ("key", "span"), "ts", "value").select("key", "ts", F.col("cumulative").alias("value"))
    raw = promql.increase(counter, ("key",), 6 * HOUR)
    return raw.where("increase is not null").select("key", "ts", F.col("increase"))


def counter_rate(spark, sf_dir):
    x = series.cumulative(points(spark, sf_dir), ("key",), "ts", "value").select("key", "ts", F.col("cumulative").alias("value"))
    return r6(promql.rate(x, ("key",), 6 * HOUR).where("rate is not null").select("key", "ts", "rate"), "rate")


def over_time(spark, sf_dir):
    x = points(spark, sf_dir)
    for how in ("avg", "stddev", "quantile", "max", "count"):
        x = promql.over_time(x, ("key",), 6 * HOUR, how, q=0.9)
    return r6(x, "avg_over_time", "stddev_over_time", "quantile_over_time")


def adaptive_band(spark, sf_dir):
    return r6(promql.adaptive_band(points(spark, sf_dir), ("key",)), "upper", "lower")


def robust_band(spark, sf_dir):
    return r6(promql.robust_band(points(spark, sf_dir), ("key",)), "upper", "lower")


def z_week(spark, sf_dir):
    return r6(promql.z_score(points(spark, sf_dir), ("key",)), "z")


def weekly_prediction(spark, sf_dir):
    return r6(promql.predicted(points(spark, sf_dir), ("key",)).where("prediction is not null"), "prediction")


def spike(spark, sf_dir):
    return rules.spike(points(spark, sf_dir), ("key",), 6 * HOUR, height=1.5, least_now=5, least_before=2, n="value").select("key", "ts", "cur", "ref")


def flatline(spark, sf_dir):
    return rules.flatline(points(spark, sf_dir), ("key",), 6 * HOUR, least=8, n="value").select("key", "ts", "cur")


def percentage_match(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("user_id") % 10).alias("service"), series.bucket(F.col("ts"), 86400).alias("day"), "event_type")
    return r6(rules.percentage_match(rows, ("service", "day"), F.col("event_type") == "error", 10.0, 5), "share")


def new_terms(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", series.bucket(F.col("ts"), 1).alias("ts"))
    return rules.new_terms(rows, ("user_id", "event_type"), 1705968000, 2 * 86400)


def burn_rate(spark, sf_dir):
    minutes = events(spark, sf_dir).groupBy(F.lit("all").alias("key"), (series.bucket(F.col("ts"), 300) * 300).alias("ts")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    return r6(rules.burn_rate(minutes, ("key",), 0.97), "r5m", "r30m", "r1h", "r6h")


def held_for(spark, sf_dir):
    x = points(spark, sf_dir).withColumn("condition", F.col("value") >= 2)
    return promql.held_for(x, ("key",), 2 * HOUR, HOUR).select("key", "ts", "value")


def vector_matching(spark, sf_dir):
    x = points(spark, sf_dir)
    high, low = x.where("value >= 4"), x.where("value <= 1")
    busy = promql.aggregate(x, ("ts",), "sum").where("value >= 15")
    both = promql.vector_and(high, busy, ("ts",)).withColumn("op", F.lit("and"))
    less = promql.vector_unless(high, busy, ("ts",)).withColumn("op", F.lit("unless"))
    either = promql.vector_or(busy.select(F.lit("all").alias("key"), "ts", "value"), low, ("ts",)).withColumn("op", F.lit("or"))
    share = promql.binary(x, promql.aggregate(x, ("ts",), "sum"), ("ts",), lambda a, b: F.round(a / F.nullif(b, F.lit(0.0)), 6)).select(F.lit("share").alias("key"), "ts", "value").withColumn("op", F.lit("/"))
    return both.unionByName(less).unionByName(either).unionByName(share)


def absent_over_time(spark, sf_dir):
    """Within the data, and behind it."""
    p = points(spark, sf_dir)
    inside = promql.absent_over_time(p, 1705968000, 7200).withColumn("at", F.lit("inside"))
    return inside.unionByName(promql.absent_over_time(p, 1735689600, 600).withColumn("at", F.lit("behind")))


def throttled(spark, sf_dir):
    x = points(spark, sf_dir).where("value >= 2").select("key", "ts", "value")
    return lifecycle.throttle(x, ("key",), "ts", 6 * HOUR)


QUERIES = {f.__name__: f for f in (
    bucket_mean, bucket_count, gap_fill_sum, gap_fill_mean, seasonal_score, scale_cached, anomaly_rate, top_scores, firing_islands, debounce_events, absent_series,
    cumulative_counts, counter_increase, counter_rate, over_time, adaptive_band, robust_band, z_week, weekly_prediction, spike, flatline, percentage_match, new_terms,
    burn_rate, held_for, vector_matching, absent_over_time, throttled,
)}

_C = """c as (select event_type as key, epoch_us(ts) // 3600000000 as b, count(*)::double as n from events group by 1, 2),
g as (select key, unnest(range(min(b), (select max(b) from c))) as b from c group by key),
v as (select g.key, g.b as bucket, coalesce(c.n, 0)::double as value from g left join c on g.key = c.key and g.b = c.b)"""
_P = _C + ", p as (select key, bucket * 3600 as ts, value from v)"
_S = _C + """,
h as (select key, bucket + 24 * s as bucket, value from v, (values (1), (2), (3)) t(s)),
m as (select key, bucket, median(value) as e from h group by 1, 2),
x as (select v.*, m.e, v.value - m.e as r from v left join m using (key, bucket)),
w as (select *, mad(r) over f as rm, count(r) over f as rn, mad(value) over f as vm, count(value) over f as vn, median(value) over f as ce from x
  window f as (partition by key order by bucket range between 24 preceding and 1 preceding)),
y as (select key, bucket, value as observed, coalesce(e, case when vn >= 3 then ce end) as expected, 1.4826::double * (case when e is not null then rm else vm end) as mad, case when e is not null then rn else vn end as n, e is not null as is_seasonal from w),
z as (select *, greatest(mad, 1.0::double, 0.1::double * abs(expected), sqrt(greatest(expected, 1.0::double))) as scale from y where expected is not null and n >= 10),
scores as (select key, bucket, observed, expected, scale, (observed - expected) / scale as score, is_seasonal from z)"""  # fmt: skip
_FLAG = _S + ", flagged as (select *, greatest(observed, expected) >= 1 and abs(score) >= 1.5 as anomalous from scores)"
_BACK = lambda fn, back: f"{fn} over (partition by key order by ts range between {back + 1800 - 1} preceding and {back - 1800} preceding)"

ORACLE = {
    "bucket_mean": "select event_type, epoch_us(ts) // 3600000000 as bucket, round(avg(value), 6) as value from events group by 1, 2",
    "bucket_count": "select event_type, epoch_us(ts) // 3600000000 as bucket, count(*)::double as value from events group by 1, 2",
    "gap_fill_sum": f"with {_C} select key, bucket, value from v",
    "gap_fill_mean": f"with {_C}, a as (select event_type as key, epoch_us(ts) // 3600000000 as bucket, round(avg(value), 6) as value from events group by 1, 2) select v.key, v.bucket, a.value from v left join a using (key, bucket)",
    "seasonal_score": f"with {_S} select key, bucket, observed, round(expected, 6) as expected, round(scale, 6) as scale, round(score, 6) as score, round(expected - 4 * scale, 6) as lower, round(expected + 4 * scale, 6) as upper, is_seasonal from scores",
    "anomaly_rate": f"with {_S} select key, round(avg((abs(score) >= 2)::int::double), 6) as share from scores group by 1",
    "top_scores": f"with {_S}, q as (select key, bucket, round(score, 6) as score from scores), r as (select *, row_number() over (partition by bucket order by abs(score) desc, key) as rn from q) select key, bucket, score from r where rn <= 2",
    "firing_islands": f"with {_FLAG}, i as (select *, bucket - row_number() over (partition by key order by bucket) as g from flagged where anomalous) select key, min(bucket) as start, min(bucket) + 1 as fired_at, max(bucket) as last, round(max(abs(score)), 6) as peak from i group by key, g having count(*) >= 2",
    "absent_series": """with d as (select distinct user_id as key, epoch_us(ts) // 86400000000 as b from events),
days as (select distinct b from d), n as (select key, b, coalesce(lead(b) over (partition by key order by b), (select max(b) + 1 from days)) as nx from d),
gap as (select n.key, n.b as present, days.b, row_number() over (partition by n.key, n.b order by days.b) as rn from n join days on days.b > n.b and days.b < n.nx)
select key, min(b) as since, min(case when rn = 3 then b end) as fired_at from gap group by key, present having max(rn) >= 3""",
    "cumulative_counts": f"with {_C} select key, bucket, value, sum(value) over (partition by key order by bucket) as cumulative from v",
    "counter_increase": f"""with {_P}, k as (select key, ts, sum(value) over (partition by key, ts // 172800 order by ts) as value from p),
d as (select *, case when lag(value) over o is null then 0 when value < lag(value) over o then value else value - lag(value) over o end as d from k window o as (partition by key order by ts)),
i as (select key, ts, count(*) over w as n, sum(d) over w - first(d) over w as increase from d window w as (partition by key order by ts range between 21599 preceding and current row))
select key, ts, increase from i where n >= 2""",
    "counter_rate": f"""with {_P}, k as (select key, ts, sum(value) over (partition by key order by ts) as value from p),
i as (select key, ts, count(*) over w as n, value - first(value) over w as d, ts - first(ts) over w as span, first(ts) over w - (ts - 21600) as before, first(value) over w as v0 from k window w as (partition by key order by ts range between 21599 preceding and current row)),
e as (select *, case when before >= span / (n - 1) * 1.1::double then span / (n - 1) / 2 else before end as s1, case when d > 0 then span * v0 / d end as zero from i where n >= 2),
f as (select *, case when zero < s1 then zero else s1 end as s from e)
select key, ts, round(d * (span + s) / span / 21600, 6) as rate from f""",
    "over_time": f"with {_P} select key, ts, value, round(avg(value) over w, 6) as avg_over_time, round(stddev_pop(value) over w, 6) as stddev_over_time, round(quantile_cont(value, 0.9) over w, 6) as quantile_over_time, max(value) over w as max_over_time, count(value) over w as count_over_time from p window w as (partition by key order by ts range between 21599 preceding and current row)",
    "adaptive_band": f"""with {_P}, a as (select *, avg(value) over h as av, stddev_pop(value) over h as sd from p window h as (partition by key order by ts range between 3599 preceding and current row)),
b as (select *, case when sd > 0.5 * av then sd end as sd2 from a),
c2 as (select *, avg(av) over s as sa, avg(sd2) over s as ss, {_BACK("avg(value)", 86400)} as a1, {_BACK("stddev_pop(value)", 86400)} as s1, {_BACK("avg(value)", 604800)} as a7, {_BACK("stddev_pop(value)", 604800)} as s7 from b window s as (partition by key order by ts range between 93599 preceding and current row))
select key, ts, value, round(greatest(av * 1.5::double, sa + 2 * ss, a1 + 2 * s1, a7 + 2 * s7), 6) as upper, round(greatest(least(av * 0.5::double, sa - 2 * ss, a1 - 2 * s1, a7 - 2 * s7), 0.0::double), 6) as lower from c2""",
    "robust_band": f"""with {_P}, a as (select *, median(value) over d as m from p window d as (partition by key order by ts range between 86399 preceding and current row)),
b as (select *, abs(value - m) as dv from a),
c2 as (select *, median(dv) over d as md, {_BACK("median(value)", 86400)} as m1, {_BACK("median(dv)", 86400)} as d1, {_BACK("median(value)", 604800)} as m7, {_BACK("median(dv)", 604800)} as d7 from b window d as (partition by key order by ts range between 86399 preceding and current row))
select key, ts, value, round(greatest(m + 2 * md, m * 1.5::double, m1 + 2 * d1, m7 + 2 * d7), 6) as upper, round(greatest(least(m - 2 * md, m * 0.5::double, m1 - 2 * d1, m7 - 2 * d7), 0.0::double), 6) as lower from c2""",
    "z_week": f"with {_P}, a as (select *, avg(value) over w as m, stddev_pop(value) over w as s from p window w as (partition by key order by ts range between 604799 preceding and current row)) select key, ts, value, round((value - m) / nullif(s, 0), 6) as z from a",
    "weekly_prediction": f"""with {_P}, a as (select *, avg(value) over w0 as n0, avg(value) over w1 as n1, avg(value) over w2 as n2, avg(value) over w3 as n3 from p window w0 as (partition by key order by ts range between 604799 preceding and current row),
w1 as (partition by key order by ts range between 1209599 preceding and 604800 preceding), w2 as (partition by key order by ts range between 1814399 preceding and 1209600 preceding), w3 as (partition by key order by ts range between 2419199 preceding and 1814400 preceding)),
t as (select a.key, a.ts, a.value, b.value + a.n0 - case k when 1 then a.n1 when 2 then a.n2 else a.n3 end as x from a, (values (1), (2), (3)) q(k) join p b on b.key = a.key and b.ts = a.ts - k * 604800)
select key, ts, value, round(median(x), 6) as prediction from t where x is not null group by all""",
    "spike": f"with {_P}, a as (select key, ts, sum(value) over w1 as cur, coalesce(sum(value) over w2, 0) as ref from p window w1 as (partition by key order by ts range between 21599 preceding and current row), w2 as (partition by key order by ts range between 43199 preceding and 21600 preceding)) select key, ts, cur, ref from a where cur >= 5 and ref >= 2 and cur >= 1.5 * ref",
    "flatline": f"with {_P}, a as (select key, ts, sum(value) over (partition by key order by ts range between 21599 preceding and current row) as cur, min(ts) over (partition by key) as f from p) select key, ts, cur from a where cur < 8 and ts - f >= 21600",
    "percentage_match": "select user_id % 10 as service, epoch_us(ts) // 86400000000 as day, count(*) filter (event_type = 'error') as hits, count(*) as total, round(100.0::double * count(*) filter (event_type = 'error') / count(*), 6) as share from events group by 1, 2 having count(*) >= 5 and 100.0 * count(*) filter (event_type = 'error') / count(*) > 10",
    "new_terms": "with e as (select user_id, event_type, epoch_us(ts) // 1000000 as ts from events) select user_id, event_type, min(ts) as first from e where ts >= 1705968000 and not exists (select 1 from e o where o.user_id = e.user_id and o.event_type = e.event_type and o.ts < 1705968000 and o.ts >= 1705968000 - 172800) group by 1, 2",
    "burn_rate": """with m as (select 'all' as key, epoch_us(ts) // 300000000 * 300 as ts, count(*) filter (event_type = 'error') as errors, count(*) as total from events group by 2)
select key, ts, errors, total, round(r5m, 6) as r5m, round(r30m, 6) as r30m, round(r1h, 6) as r1h, round(r6h, 6) as r6h, r1h > 14.4::double * (1 - 0.97::double) and r5m > 14.4::double * (1 - 0.97::double) as fast, r6h > 6 * (1 - 0.97::double) and r30m > 6 * (1 - 0.97::double) as slow
from (select *, """ + ", ".join(f"(sum(errors) over {n})::double / nullif(sum(total) over {n}, 0) as {c}" for n, c in (("w1", "r5m"), ("w2", "r30m"), ("w3", "r1h"), ("w4", "r6h"))) + """ from m
window """ + ", ".join(f"{n} as (partition by key order by ts range between {s - 1} preceding and current row)" for n, s in (("w1", 300), ("w2", 1800), ("w3", 3600), ("w4", 21600))) + ")",  # fmt: skip
    "held_for": f"with {_P}, h as (select *, ts // 3600 - row_number() over (partition by key order by ts) as g from p where value >= 2), s as (select *, min(ts) over (partition by key, g) as s0 from h) select key, ts, value from s where ts - s0 >= 7200",
    "vector_matching": f"""with {_P}, t as (select ts, sum(value) as value from p group by ts), busy as (select * from t where value >= 15), high as (select * from p where value >= 4), low as (select * from p where value <= 1)
select key, ts, value, 'and' as op from high where ts in (select ts from busy) union all select key, ts, value, 'unless' from high where ts not in (select ts from busy)
union all select 'all', ts, value, 'or' from busy union all select key, ts, value, 'or' from low where ts not in (select ts from busy)
union all select 'share', p.ts, round(p.value / nullif(t.value, 0), 6), '/' from p join t using (ts)""",
    "absent_over_time": f"with {_P}, a as (select * from (values (1705968000, 7200, 'inside'), (1735689600, 600, 'behind')) t(at_s, w, nm)) select 1.0::double as value, nm as \"at\" from a where not exists (select 1 from p where ts > at_s - w and ts <= at_s)",
}
