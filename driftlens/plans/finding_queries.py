"""The chain from series to findings, its read side and composed rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import findings, rules, series
from driftlens.plans import log_queries, series_queries
from driftlens.plans.series_queries import HOUR, events, hourly, r6

OPEN, AS_OF = 474_000, 1_706_400_000


def due_buckets(spark, sf_dir):
    """The buckets that one evaluation judges, where every other series was judged before."""
    scored = hourly(spark, sf_dir).select("key", "bucket", "value")
    last = scored.where(F.col("key") < "m").groupBy("key").agg(F.lit(OPEN - 2).cast("long").alias("last"))
    return findings.due(scored, last, ("key",), OPEN)


def directed_anomalies(spark, sf_dir):
    """Scores judged by each series' own side and least volume."""
    x = series_queries.scores(spark, sf_dir).withColumn("direction", findings.direction(F.concat(F.col("key"), F.lit("s")), F.lit("info")))
    x = x.withColumn("min_volume", F.when(F.col("key") == "view", 3.0).otherwise(0.0))
    return r6(x.where(findings.is_anomalous(1.5)).select("key", "bucket", "score"), "score")


def finding_lifetimes(spark, sf_dir):
    found = findings.lifetimes(series_queries.debounce_events(spark, sf_dir), ("key",))
    return found.select("key", "state", "starts_at", "updated_at", "ends_at")


def findings_listed(spark, sf_dir):
    """The read side: firing ones and the newest five resolved ones."""
    rows = findings.lifetimes(series_queries.debounce_events(spark, sf_dir), ("key",))
    rows = rows.withColumn("id", F.concat_ws("@", "key", "starts_at"))
    return findings.list_findings(rows, resolved=5).select("id", "state", "starts_at", "ends_at")


def absent_lifetimes(spark, sf_dir):
    """Users whose daily sums went missing, expected at their last value."""
    users = series.bucketize(events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "value"), ("key",), 86400, "sum", value="value")
    scores = users.select("key", "bucket", F.round(F.col("value"), 2).alias("expected"))
    return findings.absent_findings(users, scores, ("key",), 3, ttl=5, floor=10.0)


def templates_listed(spark, sf_dir):
    out = findings.list_templates(log_queries.template_counts(spark, sf_dir), log_queries.SIGNATURES)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("levels")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("service", "template", "lines", "level", "inferred_level", counts.alias("levels"), F.array_join("signatures", ",").alias("signatures"))


def pushed_ids(spark, sf_dir):
    """Pushed counts with the ids of known templates; those of errors are not known yet."""
    counts = log_queries.template_counts(spark, sf_dir).groupBy("service", "template").agg(F.sum("n").alias("n"))
    known = counts.where(~F.startswith("template", F.lit("error"))).select("service", "template", F.length("template").alias("template_id"))
    return findings.global_ids(counts, known).fillna(-1, ["template_id"])


def merged_pushes(spark, sf_dir):
    counts = log_queries.template_counts(spark, sf_dir).select("service", "template", "level", F.floor(F.col("ts") / 86400).alias("bucket"), "n")
    return findings.merged_pushes(counts.where("bucket % 2 = 0"), counts)


def retained_users(spark, sf_dir):
    """Counts of users with data in the last week, and of one that is kept whatever its age."""
    daily = series.bucketize(events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts"), ("key",), 86400, "count")
    keep = daily.where("key = 3").select("key").distinct()
    kept = findings.retained(daily, ("key",), AS_OF // 86400, 1, keep=keep)
    return kept.groupBy("key").agg(F.sum("value").alias("n"))


def line_counts(spark, sf_dir):
    rows = log_queries.event_lines(spark, sf_dir).select(F.when(F.col("service") != "svc3", F.col("service")).alias("service"), F.when(F.col("line_no") % 5 > 0, F.col("line_no") % 5).alias("template_id"))
    return findings.line_counts(rows)


def reconstructed(spark, sf_dir):
    """Observed values from score and band."""
    x = series_queries.scores(spark, sf_dir)
    return x.select("key", "bucket", F.round(findings.observed_again(F.col("expected"), F.col("score"), F.col("upper"), 4.0), 6).alias("observed"))


def annotated_times(spark, sf_dir):
    return r6(findings.annotations(series_queries.scores(spark, sf_dir), 2.0), "score")


def event_labels(spark, sf_dir):
    labels = findings.with_labels(F.create_map(F.lit("type"), F.col("event_type"), F.lit("tier"), F.lit("9")), {"tier": "1", "team": "ops"})
    rows = events(spark, sf_dir).select(labels.alias("labels"))
    one = findings.label_values(rows, "type").withColumn("name", F.lit("type"))
    return one.unionByName(findings.label_values(rows, "tier").withColumn("name", F.lit("tier")))


def evaluated_on_grid(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_type").alias("key"), series.bucket(F.col("ts"), 1).alias("ts"), F.col("event_id").alias("value"))
    return findings.evaluation_grid(e, ("key",), 1_704_067_200, AS_OF, 6 * HOUR, 2 * HOUR)


def _created(spark, sf_dir):
    """A counter of new templates for each instance and service: one an event."""
    e = events(spark, sf_dir).select((F.col("user_id") % 2).alias("instance"), F.col("event_type").alias("service"), series.bucket(F.col("ts"), 1).alias("ts"))
    each = e.groupBy("instance", "service", "ts").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return series.cumulative(each.withColumn("job", F.lit("j")), ("instance", "service"), "ts", "n").select("job", "instance", "service", "ts", F.col("cumulative").alias("value"))


def template_burst(spark, sf_dir):
    started = spark.createDataFrame([("j", 0, AS_OF - 86400), ("j", 1, AS_OF - 600)], "job string, instance long, started long")
    return r6(rules.new_templates_burst(_created(spark, sf_dir), started, AS_OF, above=1.0, window=86400), "value")


def score_held_high(spark, sf_dir):
    x = series_queries.scores(spark, sf_dir).select("key", (F.col("bucket") * HOUR).alias("ts"), "score")
    return r6(rules.score_high(x, ("key",), HOUR, above=1.0, seconds=2 * HOUR).select("key", "ts", "score"), "score")


def stale_jobs(spark, sf_dir):
    """At three times: fresh, old, and without any sample."""
    p = series_queries.points(spark, sf_dir).select("ts", (F.col("ts") - F.when(F.col("ts") < 1_705_000_000, 0).otherwise(9000)).alias("value"))
    out = None
    for at in (1_704_900_000, 1_706_000_400, 1_735_689_600):
        one = rules.job_stale(p, at, 2 * HOUR).select(F.lit(at).cast("long").alias("at"), F.coalesce(F.col("age"), F.lit(-1)).cast("long").alias("age"))
        out = one if out is None else out.unionByName(one)
    return out


def _template_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    name = F.when(F.col("user_id") % 4 == 0, "other").otherwise(F.col("event_type"))
    return e.groupBy((F.col("user_id") % 3).cast("string").alias("service"), name.alias("template_id"), (series.bucket(F.col("ts"), HOUR) * HOUR).alias("ts")).agg(F.count(F.lit(1)).alias("n"))


def cap_reached(spark, sf_dir):
    return r6(rules.cap_reached(_template_lines(spark, sf_dir), HOUR, 0.2, 6 * HOUR, 3 * HOUR), "share")


def dense_templates(spark, sf_dir):
    return r6(rules.dense_templates(_template_lines(spark, sf_dir), AS_OF, 4 / 86400, 12 * HOUR, 86400), "rate")


def leading_levels(spark, sf_dir):
    """Levels at the beginning of plain lines."""
    e = log_queries.event_lines(spark, sf_dir)
    n = F.col("line_no") % 5
    start = F.when(n == 0, "2024-01-02T03:04:05Z [WARN] ").when(n == 1, "ERROR: ").when(n == 2, "Info ").when(n == 3, "warnings ").otherwise("x ERROR ")
    return e.select("line_no", text.leading_level(F.concat(start, F.col("message"))).alias("level"))


QUERIES = {f.__name__: f for f in (
    due_buckets, directed_anomalies, finding_lifetimes, findings_listed, absent_lifetimes, templates_listed, pushed_ids, merged_pushes, retained_users, line_counts,
    reconstructed, annotated_times, event_labels, evaluated_on_grid, template_burst, score_held_high, stale_jobs, cap_reached, dense_templates, leading_levels,
)}

_FLAG, _S, _P, _T, _L = series_queries._FLAG, series_queries._S, series_queries._P, log_queries._T, log_queries._L
#: The debounce as a recursion over each series' rows, one after the other.
_EVENTS = "recursive " + _FLAG + """,
r as (select *, row_number() over (partition by key order by bucket) as n from flagged),
st as (
  select key, n, bucket, score, case when anomalous then 1 else 0 end as pending, case when anomalous then 0 else 1 end as normal, false as firing, null::varchar as event from r where n = 1
  union all
  select r.key, r.n, r.bucket, r.score, case when r.anomalous then st.pending + 1 else 0 end, case when r.anomalous then 0 else st.normal + 1 end,
    case when r.anomalous then st.firing or st.pending + 1 >= 2 else st.firing and st.normal + 1 < 2 end,
    case when r.anomalous and st.firing then 'update' when r.anomalous and st.pending + 1 >= 2 then 'fire' when not r.anomalous and st.firing and st.normal + 1 >= 2 then 'resolve' end
  from st join r on r.key = st.key and r.n = st.n + 1),
ev as (select key, bucket, event, score from st where event is not null)"""
_LIFE = _EVENTS + """,
nb as (select *, count(*) filter (event = 'fire') over (partition by key order by bucket) as f from ev),
life as (select key, min(bucket) as starts_at, max(bucket) as updated_at, max(bucket) filter (event = 'resolve') as ends_at from nb where f > 0 group by key, f),
lf as (select *, case when ends_at is null then 'firing' else 'resolved' end as state from life)"""
_DAY = "d as (select user_id as key, epoch_us(ts) // 86400000000 as bucket, round(sum(value), 2) as value, count(*) as n from events group by 1, 2)"

ORACLE = {
    "due_buckets": f"with {_P} select key, bucket, value from v where bucket < {OPEN} and bucket >= case when key < 'm' then {OPEN - 1} else {OPEN - 3} end",
    "directed_anomalies": f"with {_S} select key, bucket, round(score, 6) as score from scores where case when key = 'error' then score >= 1.5 else abs(score) >= 1.5 end and (key <> 'view' or greatest(observed, expected) >= 3)",
    "finding_lifetimes": f"with {_LIFE} select key, state, starts_at, updated_at, ends_at from lf",
    "findings_listed": f"with {_LIFE}, i as (select key || '@' || starts_at as id, * from lf), old as (select * from i where state = 'resolved' order by ends_at desc, id limit 5) "
    "select id, state, starts_at, ends_at from (select * from i where state = 'firing' union all select * from old)",
    "absent_lifetimes": f"""with {_DAY}, seen as (select distinct bucket from d), nx as (select key, bucket, value, lead(bucket) over (partition by key order by bucket) as nxt, (select max(bucket) + 1 from d) as fin from d),
m as (select nx.key, nx.bucket as prior, nx.value, nx.nxt, seen.bucket as b, row_number() over (partition by nx.key, nx.bucket order by seen.bucket) as rn from nx join seen on seen.bucket > nx.bucket and seen.bucket < coalesce(nx.nxt, nx.fin)),
f as (select key, prior, any_value(value) as expected, any_value(nxt) as nxt, min(b) as since, min(b) filter (rn = 3) as fired_at from m group by 1, 2)
select key, since, fired_at, case when nxt is null then since + 5 else least(nxt, since + 5) end as ends_at, expected from f where fired_at is not null and expected > 10""",
    "templates_listed": f"""with {_T}, c as (select service, template, level, count(*) as n from t group by all),
r as (select *, row_number() over (partition by service, template order by n desc, level) as k, sum(n) over (partition by service, template) as lines, string_agg(level || ':' || n, ',' order by level) over (partition by service, template rows between unbounded preceding and unbounded following) as levels from c)
select service, template, lines::bigint as lines, level, '' as inferred_level, levels, case when regexp_matches(template, '^error user') then 'failing' when regexp_matches(template, 'purchase .* took') then 'buying' else '' end as signatures from r where k = 1""",
    "pushed_ids": f"with {_T}, c as (select service, template, count(*) as n from t group by all) select service, template, n, case when starts_with(template, 'error') then -1 else length(template) end::int as template_id from c",
    "merged_pushes": f"with {_T} select service, template, level, ts // 86400 as bucket, sum(case when ts // 86400 % 2 = 0 then 2 else 1 end)::bigint as n from t group by all",
    "retained_users": f"with {_DAY} select key, sum(n)::double as n from d group by 1 having max(bucket) > {AS_OF // 86400 - 1} or key = 3",
    "line_counts": f"with {_L}, x as (select case when service = 'svc3' then 'unknown' else service end as service, case when line_no % 5 > 0 then (line_no % 5)::varchar else 'other' end as template_id from l), c as (select service, template_id, count(*) as lines from x group by all) select *, sum(lines) over (partition by service)::bigint as of_service from c",
    "reconstructed": f"with {_S} select key, bucket, round(observed, 6) as observed from scores",
    "annotated_times": f"with {_S} select bucket, round(max(abs(score)), 6) as score from scores group by 1 having max(abs(score)) >= 2",
    "event_labels": "select distinct event_type as value, 'type' as name from events union all select '1', 'tier'",
    "evaluated_on_grid": f"with e as (select event_type as key, epoch_us(ts) // 1000000 as ts, event_id as value from events), g as (select unnest(range(1704067200, {AS_OF} + 1, 21600)) as t) select key, t as \"at\", arg_max(value, ts) as value from g join e on e.ts > t - 7200 and e.ts <= t group by 1, 2",
    "score_held_high": f"with {_S}, hh as (select key, bucket, score, bucket - row_number() over (partition by key order by bucket) as g from scores where abs(score) > 1), i as (select *, min(bucket) over (partition by key, g) as s from hh) select key, bucket * 3600 as ts, round(score, 6) as score from i where bucket - s >= 2",
    "stale_jobs": f"with {_P}, a as (select unnest([1704900000, 1706000400, 1735689600]) as t), j as (select t, max(ts - case when ts < 1705000000 then 0 else 9000 end) as last from a left join p on ts > t - 7200 and ts <= t group by 1) select t::bigint as \"at\", coalesce(t - last, -1)::bigint as age from j where last is null or t - last > 7200",
    "cap_reached": """with n as (select epoch_us(ts) // 3600000000 as b, count(*) filter (user_id % 4 = 0) as o, count(*) as n from events group by 1),
s as (select b, sum(o) over w / sum(n) over w as share from n window w as (order by b range between 5 preceding and current row)),
h as (select *, b - row_number() over (order by b) as g from s where share > 0.2), i as (select *, min(b) over (partition by g) as f from h)
select b * 3600 as ts, round(share, 6) as share from i where b - f >= 3""",
    "dense_templates": f"with n as (select (user_id % 3)::varchar as service, event_type as template_id, epoch_us(ts) // 3600000000 * 3600 as ts from events where user_id % 4 <> 0), r as (select service, template_id, count(*) filter (ts > {AS_OF - 43200}) as a, count(*) as b from n where ts > {AS_OF - 86400} and ts <= {AS_OF} group by 1, 2) select service, template_id, round(a / 43200, 6) as rate from r where b >= 4 and a > 0",
    "leading_levels": "select event_id as line_no, ['warn', 'error', 'info', '', ''][event_id % 5 + 1] as level from events",
}
series_queries.ORACLE["debounce_events"] = f"with {_EVENTS} select key, bucket, event, round(score, 6) as score from ev"
series_queries.ORACLE["throttled"] = f"""with recursive {_P}, x as (select key, ts, value from p where value >= 2),
k as (select key, min(ts) as ts from x group by 1 union all select k.key, min(x.ts) from k join x on x.key = k.key and x.ts >= k.ts + 21600 group by k.key, k.ts)
select key, ts, value from x where (key, ts) in (select key, ts from k)"""
