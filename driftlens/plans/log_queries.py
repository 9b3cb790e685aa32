"""Log, trace, alert and price queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import alerts, cost, lifecycle, mining, series, traces
from driftlens.sources import logs


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, level, message, ts, line_no): a log line of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    message = F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("ms from 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(' said "'), F.col("props"), F.lit('"'))
    return e.select(F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"), F.when(F.col("event_type") == "error", "ERR").otherwise("Notice").alias("level"), message.alias("message"), series.bucket(F.col("ts"), 1).alias("ts"), F.col("event_id").alias("line_no"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("service"), "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "message"))
    return d.withColumn("line_no", F.col("doc_id") * 1_000_000 + F.col("at"))


def template_rollup(spark, sf_dir):
    x = event_lines(spark, sf_dir).select((F.floor(F.col("ts") / 60) * 60).alias("minute"), "service", text.template_key(F.col("message")).alias("template_id"), text.template_text(F.col("message")).alias("template"), text.normalize_level(F.col("level")).alias("level"))
    return x.groupBy("minute", "service", "template_id", "template", "level").agg(F.count(F.lit(1)).alias("n"))


def template_counts(spark, sf_dir) -> DataFrame:
    x = event_lines(spark, sf_dir).select("service", text.template_text(F.col("message")).alias("template"), text.normalize_level(F.col("level")).alias("level"), (F.floor(F.col("ts") / 60) * 60).alias("ts"))
    return x.groupBy("service", "template", "level", "ts").agg(F.count(F.lit(1)).alias("n"))


def grouping_sets_volume(spark, sf_dir):
    x = template_counts(spark, sf_dir).select("service", F.md5("template").alias("template_id"), "level", F.floor(F.col("ts") / 3600).alias("bucket"), "n")
    return series.volume_and_template_counts(x)


def dominant_level(spark, sf_dir):
    return series.dominant_level(template_counts(spark, sf_dir), ("service",))


def new_templates(spark, sf_dir):
    x = event_lines(spark, sf_dir).select("service", F.concat_ws(" ", F.split("message", " ")[0], F.col("line_no") % 400).alias("template"), "ts", F.lit(1).cast("long").alias("n"))
    return lifecycle.new_templates(x, warmup=86400, window=5 * 86400, least=2)


SIGNATURES = lifecycle.parse_signatures("# watched lines\nfailing: ^error user\nbuying: purchase .* took\n")


def signature_findings(spark, sf_dir):
    return lifecycle.signature_findings(template_counts(spark, sf_dir), SIGNATURES)


def masked_lines(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_no", text.mask_line(F.col("message")).alias("masked"))


#: Beginnings of lines, by the line's number.
LEVEL_STARTS = ["[WARNING] ", "x level=error y ", 'level="debug" ', "a=b=error ", "level='error' ", "one two three four five six error ", "[err] ", "  (Fatal): ", "x=INFORMATION ", "t=1 503 "]
SEVERITY_STARTS = ["panic: ", "no error ", "KeyError: ", "read: connection reset by ", "GET /api/panic ", "fatal=1 ", "non-fatal ", "Out-of-Memory ", "ERROR ", "connection <*> refused ", "handleError called ", "java.io.IOException: Too many open files ", "oom_score_adj=3 ", "Error rate ", "WARNING: ", "xERROR ", "a/b broken pipe ", "broken <NUM> pipe "]


def _started(spark, sf_dir, starts):
    at = F.element_at(F.lit(starts), (F.col("line_no") % len(starts) + 1).cast("int"))
    return event_lines(spark, sf_dir).select("line_no", F.concat(at, F.col("message")).alias("message"))


def detected_levels(spark, sf_dir):
    return _started(spark, sf_dir, LEVEL_STARTS).select("line_no", text.detect_level(F.col("message")).alias("level"))


def inferred_levels(spark, sf_dir):
    return _started(spark, sf_dir, SEVERITY_STARTS).select("line_no", text.infer_level(F.col("message")).alias("level"))


def mined_templates(spark, sf_dir):
    return mining.mine_templates(event_lines(spark, sf_dir))


def mined_two_phase(spark, sf_dir):
    return mining.mine_two_phase(event_lines(spark, sf_dir))


def capped_services(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    rows = series.first_seen_cap(e.withColumn("service", F.col("user_id").cast("string")), "service", "event_id", 20, "_other")
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"))


def container_lines(spark, sf_dir):
    """Lines wrapped in an envelope in chunks, unwrapped and joined again."""
    x = event_lines(spark, sf_dir).select("service", "line_no", "message")
    ts = F.lit("2024-01-01T00:00:00Z stdout ")
    chunk = lambda flag, part: F.concat(ts, F.lit(flag + " "), part)
    raw = x.select("service", F.explode(F.array(F.struct((F.col("line_no") * 2).alias("line_no"), chunk("P", F.substring("message", 1, 10)).alias("raw")), F.struct((F.col("line_no") * 2 + 1).alias("line_no"), chunk("F", F.substring(F.col("message"), F.lit(11), F.length("message"))).alias("raw")))).alias("l"))
    lines = raw.select(F.col("service").alias("path"), "l.line_no", logs.unwrap(F.col("l.raw")).alias("u")).select("path", "line_no", "u.text", "u.stderr", "u.partial")
    return logs.join_partials(lines).select("path", (F.col("line_no") / 2).cast("long").alias("line_no"), "text")


def json_fields(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit('{"message":"'), F.col("event_type"), F.lit('","service.name":"s'), (F.col("user_id") % 5).cast("string"), F.lit('","log":{"level":"'), F.when(F.col("event_type") == "error", "fatal").otherwise("info"), F.lit('"}}'))
    got = logs.extract(e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(line).alias("text")))
    return got.select("event_id", "message", "service", text.normalize_level(F.coalesce("level", F.lit(""))).alias("level"))


def score_lines(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    labels = F.create_map(F.lit("__name__"), F.lit("requests"), F.lit("anomaly_type"), F.lit("x"), F.lit("service"), F.concat(F.col("event_type"), F.lit('"q\\')))
    return logs.exposition(e.select(F.lit("anomaly_score").alias("metric"), logs.export_labels(labels).alias("labels"), "value"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each order: its root span, and a span for each of its lines."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("trace_id"), F.lit(0).alias("span_id"), F.lit(None).cast("int").alias("parent_id"), F.lit("front").alias("service_name"), F.concat(F.lit("/order/"), F.col("o_orderkey").cast("string")).alias("span_name"), F.lit("SERVER").alias("span_kind"), F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("OK").alias("status_code"), (F.col("o_orderkey") % 1500).cast("double").alias("duration_ms"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("int").alias("span_id"), F.lit(0).alias("parent_id"), F.concat(F.lit("store"), (F.col("l_suppkey") % 5).cast("string")).alias("service_name"), F.lit("/item").alias("span_name"), F.lit("CLIENT").alias("span_kind"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status_code"), (F.col("l_partkey") % 900).cast("double").alias("duration_ms"))
    return o.unionByName(line)


def trace_red(spark, sf_dir):
    x = spans(spark, sf_dir).withColumn("span_name", traces.sanitize_name(F.col("span_name")))
    return traces.span_metrics(x)


def service_graph(spark, sf_dir):
    return traces.service_graph(spans(spark, sf_dir)).withColumn("latency", F.round("latency", 6))


def tail_sampling(spark, sf_dir):
    kept = traces.tail_sample(spans(spark, sf_dir), 2, F.col("trace_id") % 100, slow_ms=1400, probe=F.col("trace_id") % 10 == 3)
    return kept.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.sum("trace_id").alias("total"))


def latency_quantile(spark, sf_dir):
    from driftlens.operators.promql import histogram_quantile

    m = traces.span_metrics(spans(spark, sf_dir), ("service_name",))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{b}").alias("count")) for b in traces.BOUNDS), F.struct(F.lit(float("inf")).alias("le"), F.col("calls").alias("count")))
    rows = m.select("service_name", F.explode(pairs).alias("p")).select("service_name", "p.*")
    return histogram_quantile(0.95, rows, ("service_name",)).withColumn("quantile", F.round("quantile", 6))


def graduated_cost(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("quantity"))
    return cost.graduated(c, [(1000, 0.5), (5000, 0.3), (1e12, 0.1)], free=100).withColumn("cost", F.round("cost", 6))


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    labels = F.create_map(F.lit("service"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("severity"), F.when(F.col("c_acctbal") < 0, "critical").when(F.col("c_acctbal") < 5000, "warning").otherwise("info"), F.lit("tier"), F.when(F.col("c_custkey") % 3 == 0, "slo").otherwise("anomaly"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), labels.alias("labels"))


def alert_routing(spark, sf_dir):
    routes = [alerts.Route("page", (("severity", "=", "critical"), ("tier", "=~", "slo|burn")), go_on=True), alerts.Route("ticket", (("severity", "=~", "critical|warning"),)), alerts.Route("log", (("tier", "!=", "slo"),))]
    routed = alerts.route(alert_rows(spark, sf_dir), routes, "default")
    return alerts.group_alerts(routed, ("service",)).select("receiver", "service", "alerts", F.size("ids").cast("long").alias("shown"))


def alert_inhibition(spark, sf_dir):
    left = alerts.inhibit(alert_rows(spark, sf_dir), [("severity", "=", "critical"), ("tier", "=", "slo")], [("severity", "=~", "warning|info")], ("service",))
    return left.select("id", F.element_at("labels", "service").alias("service"), F.element_at("labels", "severity").alias("severity"))


def agent_registry(spark, sf_dir):
    e = event_lines(spark, sf_dir).select(F.concat(F.lit("agent"), (F.col("line_no") % 4).cast("string")).alias("agent"), "ts", "service", F.lit(1).cast("long").alias("lines"), (F.col("line_no") % 11 == 0).alias("rejected"))
    return alerts.agents(e, 1706572800, ttl=30 * 86400, active=30 * 86400).withColumn("services", F.array_join("services", ","))


QUERIES = {f.__name__: f for f in (
    template_rollup, grouping_sets_volume, dominant_level, new_templates, signature_findings, masked_lines, detected_levels, inferred_levels, mined_templates, mined_two_phase,
    capped_services, container_lines, json_fields, score_lines, trace_red, service_graph, tail_sampling, latency_quantile, graduated_cost, alert_routing, alert_inhibition, agent_registry,
)}


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


#: The stateless masks as literal text, apart from the code under test.
_MASKS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
'\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?', '<TS>', 'g'),
'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<UUID>', 'g'),
'\b\d{1,3}(\.\d{1,3}){3}\b', '<IP>', 'g'),
'\b(0x[0-9a-fA-F]+|[0-9a-fA-F]{12,})\b', '<HEX>', 'g'),
'\b[-+]?\d+(\.\d+)?(ns|us|ms|s|KB|MB|GB|B|%)?\b', '<NUM>', 'g'),
'"[^"]{0,200}"', '<STR>', 'g')"""


_L = """l as (select 'svc' || (user_id % 7) as service, case when event_type = 'error' then 'error' else 'info' end as level,
event_type || ' user ' || user_id || ' took ' || value::decimal(18,2) || 'ms from 10.0.0.' || (user_id % 256) || ' said "' || props || '"' as message, epoch_us(ts) // 1000000 as ts, event_id as line_no, event_type from events)"""
_T = _L + f", t as (select service, {_MASKS} as template, level, ts // 60 * 60 as ts from l)"
_SP = """s as (select o_orderkey as trace_id, 0 as span_id, null::int as parent_id, 'front' as service_name, '/order/{id}' as span_name, 'SERVER' as span_kind, case when o_orderstatus = 'F' then 'ERROR' else 'OK' end as status_code, (o_orderkey % 1500)::double as duration_ms from orders
union all select l_orderkey, l_linenumber::int, 0, 'store' || (l_suppkey % 5), '/item', 'CLIENT', case when l_returnflag = 'R' then 'ERROR' else 'OK' end, (l_partkey % 900)::double from lineitem)"""
_LE = ", ".join(f"count(*) filter (duration_ms <= {b}) as le_{b}" for b in traces.BOUNDS)
_A = "a as (select c_custkey::varchar as id, 'n' || c_nationkey as service, case when c_acctbal < 0 then 'critical' when c_acctbal < 5000 then 'warning' else 'info' end as severity, case when c_custkey % 3 = 0 then 'slo' else 'anomaly' end as tier from customer)"

ORACLE = {
    "template_rollup": f"with {_T} select ts as minute, service, md5(template) as template_id, template, level, count(*) as n from t group by all",
    "grouping_sets_volume": f"with {_T} select service, md5(template) as template_id, null as level, ts // 3600 as bucket, count(*) as value, 'template' as name from t group by all union all select service, null, level, ts // 3600, count(*), 'volume' from t group by all",
    "dominant_level": f"with {_T}, c as (select service, level, count(*) as n from t group by all), r as (select *, row_number() over (partition by service order by n desc, level) as rn, sum(n) over (partition by service) as lines from c) select service, level as dominant, lines::bigint as lines from r where rn = 1",
    "new_templates": f"with {_L}, e as (select service, event_type || ' ' || (line_no % 400) as template, ts from l), f as (select service, template, min(ts) as first_ts from e group by all having min(ts) - (select min(ts) from e) >= 86400) select service, template, first_ts, count(*) as lines from e join f using (service, template) where ts <= first_ts + 432000 group by all having count(*) >= 2",
    "signature_findings": f"with {_T}, c as (select service, template, count(*) as n from t group by all), m as (select *, 'failing' as signature from c where regexp_matches(template, '^error user') union all select *, 'buying' from c where regexp_matches(template, 'purchase .* took')), r as (select *, row_number() over (partition by service, signature order by n desc, template) as rn, sum(n) over (partition by service, signature) as lines from m) select service, signature, template, lines::bigint as lines from r where rn = 1",
    "masked_lines": f"with {_L} select line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '10\\.0\\.0\\.\\d+', '<IP>'), ' user \\d+ ', ' user <NUM> '), 'took \\d+\\.\\d\\dms', 'took <NUM>'), '([^A-Za-z0-9])\\d+}}', '\\1<NUM>}}') as masked from l",
    "detected_levels": f"""with {_L}, m as (select line_no, {_sql_list(LEVEL_STARTS)}[line_no % 10 + 1] || message as m from l),
w as (select line_no, unnest(list_transform(list_slice(list_filter(string_split(m, ' '), lambda t: t <> ''), 1, 6), lambda t: trim(t, '[]():,'))) as t, generate_subscripts(list_slice(list_filter(string_split(m, ' '), lambda t: t <> ''), 1, 6), 1) as i from m),
v as (select line_no, i, lower(case when strpos(t, '=') > 0 then trim(substr(t, strpos(t, '=') + 1), '"') else t end) as v from w),
c as (select line_no, i, case when length(v) between 4 and 13 then case when v in ('error', 'fatal', 'critical', 'crit', 'panic', 'alert', 'emerg', 'emergency', 'severe') then 'error' when v in ('warn', 'warning') then 'warn'
when v in ('info', 'notice', 'information', 'informational') then 'info' when v in ('debug', 'trace', 'fine', 'finer', 'finest') then 'debug' end end as l from v)
select line_no, coalesce(arg_min(l, i) filter (l is not null), '') as level from c group by 1""",
    "inferred_levels": f"""with {_L}, m as (select line_no, regexp_replace(regexp_replace({_sql_list(SEVERITY_STARTS)}[line_no % 18 + 1] || message, '[^ ]*/[^ ]*', ' # ', 'g'), '<[A-Z*]+>', ' # ', 'g') as p from l),
k as (select line_no, p, regexp_replace(regexp_replace(p, '(?i)non-[a-z0-9_]+', ' ', 'g'), '[A-Za-z0-9_]+=', ' ', 'g') as w from m)
select line_no, case when regexp_matches(w, '(^|[^A-Za-z0-9_])((?i:panic|panicked|fatal|segfault|sigsegv|sigabrt|sigbus|deadlock|oom|oomkilled|crashloopbackoff|traceback|outofmemoryerror|stackoverflowerror|memoryerror|recursionerror)|ERROR|CRITICAL|CRIT|SEVERE|EMERG)($|[^A-Za-z0-9_])')
or regexp_matches(p, '(?i)\\b(out[^a-z0-9_#]+of[^a-z0-9_#]+memory|segmentation[^a-z0-9_#]+fault|core[^a-z0-9_#]+dumped|nil[^a-z0-9_#]+pointer[^a-z0-9_#]+dereference|uncaught[^a-z0-9_#]+exception|unhandled[^a-z0-9_#]+exception|exception[^a-z0-9_#]+in[^a-z0-9_#]+thread|no[^a-z0-9_#]+space[^a-z0-9_#]+left[^a-z0-9_#]+on[^a-z0-9_#]+device|too[^a-z0-9_#]+many[^a-z0-9_#]+open[^a-z0-9_#]+files)\\b') then 'error'
when regexp_matches(w, '(^|[^A-Za-z0-9_])((?i:econnrefused|econnreset)|WARN|WARNING|[A-Z][A-Za-z0-9_]*(Exception|Error))($|[^A-Za-z0-9_])') or regexp_matches(p, '(?i)\\b(connection[^a-z0-9_#]+refused|connection[^a-z0-9_#]+reset|broken[^a-z0-9_#]+pipe)\\b') then 'warn' else '' end as level from k""",
    "capped_services": "with f as (select user_id, min(event_id) as m from events group by 1 order by 2, user_id::varchar limit 20) select coalesce(f.user_id::varchar, '_other') as service, count(*) as n from events e left join f using (user_id) group by 1",
    "container_lines": f"with {_L} select service as path, line_no, message as text from l",
    "json_fields": "select event_id, event_type as message, case when event_id % 4 = 0 then 'unknown' else 's' || (user_id % 5) end as service, case when event_id % 4 = 0 then '' when event_type = 'error' then 'error' else 'info' end as level from events",
    "score_lines": "select 'anomaly_score{metric=\"requests\",service=\"' || event_type || '\\\"q\\\\\"} ' || count(*) as line from events group by event_type",
    "trace_red": f"with {_SP} select service_name, span_name, span_kind, status_code, count(*) as calls, sum(duration_ms) as duration_sum, {_LE} from s group by 1, 2, 3, 4",
    "service_graph": f"with {_SP} select p.service_name as client, c.service_name as server, count(*) as requests, count(*) filter (c.status_code = 'ERROR') as failed, round(avg(c.duration_ms), 6) as latency from s c join s p on c.trace_id = p.trace_id and c.parent_id = p.span_id where p.service_name <> c.service_name group by 1, 2",
    "tail_sampling": f"with {_SP}, k as (select trace_id from s group by 1 having trace_id % 10 <> 3 and (bool_or(status_code = 'ERROR') or max(duration_ms) > 1400 or trace_id % 100 < 2)) select service_name, count(*) as n, sum(trace_id)::bigint as total from s where trace_id in (select trace_id from k) group by 1",
    "latency_quantile": f"with {_SP}, m as (select service_name, count(*) as calls, {_LE} from s group by 1), b as (" + " union all ".join(f"select service_name, {b}::double as le, le_{b} as c, calls from m" for b in traces.BOUNDS) + " union all select service_name, 'inf'::double, calls, calls from m), w as (select *, lag(le, 1, 0.0) over o as lo, lag(c, 1, 0) over o as c0 from b window o as (partition by service_name order by le)), f as (select *, row_number() over (partition by service_name order by le) as rn from w where c >= 0.95 * calls) select service_name, round(case when isinf(le) then lo else lo + (le - lo) * (0.95::double * calls - c0) / (c - c0) end, 6) as quantile from f where rn = 1",
    "graduated_cost": "with q as (select c_custkey, greatest(c_acctbal::double, 0.0) as quantity from customer) select c_custkey, quantity, round(least(quantity, 1000) * 0.5::double + greatest(least(quantity, 5000) - 1000, 0) * 0.3::double + greatest(quantity - 5000, 0) * 0.1::double - least(quantity, 100) * 0.5::double, 6) as cost from q",
    "alert_routing": f"with {_A}, r as (select *, 'page' as receiver from a where severity = 'critical' and tier = 'slo' union all select *, 'ticket' from a where severity in ('critical', 'warning') union all select *, 'log' from a where severity = 'info' and tier <> 'slo' union all select *, 'default' from a where severity = 'info' and tier = 'slo') select receiver, service, count(*) as alerts, least(count(*), 20) as shown from r group by 1, 2",
    "alert_inhibition": f"with {_A} select id, service, severity from a where severity = 'critical' or service not in (select service from a where severity = 'critical' and tier = 'slo')",
    "agent_registry": f"with {_L} select 'agent' || (line_no % 4) as agent, max(ts) as last_push, count(*) as pushes, count(*) as lines, count(*) filter (line_no % 11 = 0) as rejected, string_agg(distinct service, ',' order by service) as services from l where ts >= 1706572800 - 2592000 group by 1",
}
