"""Mining that goes on from a snapshot, synthetic metrics and cost scenarios over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.operators import cost, mining
from driftlens.plans.log_queries import event_lines
from driftlens.plans.series_queries import events
from driftlens.sources import synthetic

SNAPSHOT = "service string, template_id long, template string, size long, used long"


def _lines(spark, sf_dir):
    """Event lines whose second word is one of many, so that templates grow and are let go."""
    e = event_lines(spark, sf_dir)
    word = F.concat(F.lit("kind"), F.translate((F.col("line_no") % 97).cast("string"), "0123456789", "abcdefghij"))
    return e.withColumn("message", F.when(F.col("line_no") % 3 == 0, F.concat_ws(" ", F.col("level"), word, F.col("message"))).otherwise(F.col("message")))


def continued_templates(spark, sf_dir):
    """The snapshot after two batches of lines, the services beyond five in one."""
    lines = _lines(spark, sf_dir)
    first = mining.continue_mining(spark.createDataFrame([], SNAPSHOT), lines.where("line_no % 2 = 0"), clusters=50)
    folded = mining.fold_services(first, 5)
    own = folded.select("service").distinct()
    late = lines.where("line_no % 2 = 1").join(own.withColumn("known", F.lit(True)), "service", "left")
    return mining.continue_mining(folded, late.withColumn("service", F.when(F.col("known"), F.col("service")).otherwise("_other")), clusters=50)


def annotated_counts(spark, sf_dir):
    """Lines of each template, ``other`` before three templates of a service were made."""
    lines = _lines(spark, sf_dir)
    assigned = mining.assign_templates(spark.createDataFrame([], SNAPSHOT), lines)
    return mining.annotate(assigned, lines, warm_up=3).groupBy("service", "template_id").agg(F.count(F.lit(1)).alias("n"))


def novel_templates(spark, sf_dir):
    """Templates that no line of the first half had."""
    lines = _lines(spark, sf_dir)
    middle = lines.agg(F.floor((F.min("line_no") + F.max("line_no")) / 2).alias("middle"))
    assigned = mining.assign_templates(spark.createDataFrame([], SNAPSHOT), lines, similarity=0.9)
    return mining.novel_templates(assigned, 0).crossJoin(F.broadcast(middle)).where("first >= middle").drop("middle")


def synthetic_values(spark, sf_dir):
    """The modelled metrics at the time of each event, with a spike from the middle of January on."""
    e = events(spark, sf_dir).select("event_id", F.element_at(F.lit(list(synthetic.TEMPLATES)), (F.col("user_id") % 5 + 1).cast("int")).alias("service"), F.unix_timestamp("ts").alias("ts"))
    each = e.select("*", F.explode(F.lit(list(synthetic.METRICS))).alias("type"))
    out = synthetic.metric_values(each, ("checkout", 1_705_276_800, "spike"))
    return out.select("event_id", "service", "type", "ts", F.round("value", 6).alias("value"))


STAGES = [[(1000, 0.05), (1e12, 0.04)], [(1000, 0.4), (1e12, 0.35)]]
SERIES = [(10_000, 0.0065), (1e12, 0.005)]


def scenario_costs(spark, sf_dir):
    """Three ways of charging for the volume and series of each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("gb"), (F.col("c_custkey") * 7 % 20_000).cast("double").alias("series"))
    gb, n = F.col("gb"), F.col("series")
    x = c.select(
        "c_custkey", cost.by_stage(gb, n, STAGES, SERIES, 50, 2.0, 19.0).alias("s"), cost.by_event(gb, n, 0.1, 1.7, 500, 0.05, 10, 15.0, 100).alias("e"),
        cost.by_volume(gb, n, (STAGES[0], STAGES[1]), (STAGES[0], STAGES[1]), 1.5, 1.3, 43_200.0).alias("v"),
    )
    return x.select("c_custkey", *(F.round(F.col(k), 8).alias(k.replace(".", "_")) for k in ("s.logs", "s.metrics", "s.total", "e.index", "e.metrics", "e.total", "v.retained", "v.metrics", "v.total")))


QUERIES = {f.__name__: f for f in (continued_templates, annotated_counts, novel_templates, synthetic_values, scenario_costs)}


def _fnv(text: str) -> str:
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::uhugeint)"
    return f"list_reduce(list_prepend(14695981039346656037::uhugeint, {byte}), lambda h, c: xor(h, c) * 1099511628211::uhugeint % 18446744073709551616::uhugeint)"


def _step(x: str, shift: int, factor: int) -> str:
    return f"(xor({x}, {x} // {2**shift}::uhugeint) * {factor}::uhugeint % 18446744073709551616::uhugeint)"


def _two(q: str, stage: int, free: int = 0) -> str:
    low, high = STAGES[stage][0][1], STAGES[stage][1][1]
    return f"(least({q}, 1000) * {low}::double + greatest({q} - 1000, 0) * {high}::double - least({q}, {free}) * {low}::double)"


_SER = "(least(2 * n, 10000) * 0.0065::double + greatest(2 * n - 10000, 0) * 0.005::double)"
_MGB = "(n * 43200 * 1.3::double / 1e9 * 1.5::double)"
ORACLE = {
    "synthetic_values": f"""with e as (select event_id, ['auth', 'checkout', 'gateway', 'search', 'worker'][user_id % 5 + 1] as service, epoch_us(ts) // 1000000 as ts from events),
k as (select s as service, t as type, {_fnv('s')} as h, {_fnv("(s || m)")} as hm from (select unnest(['auth', 'checkout', 'gateway', 'search', 'worker']) as s), (values ('requests', 'anomaly:svc:requests:rate1m'), ('errors', 'anomaly:svc:errors:ratio1m')) as m(t, m)),
a as (select e.*, type, h, (xor(hm, (ts // 60)::uhugeint) + 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as x0 from e join k using (service)),
b as (select *, {_step('x0', 30, 13787848793156543929)} as x1 from a), c as (select *, {_step('x1', 27, 10723151780598845931)} as x2 from b),
u as (select *, (xor(x2, x2 // 2147483648::uhugeint) // 2048::uhugeint)::double / 9007199254740992 as noise from c)
select event_id, service, type, ts, round(case when type = 'errors' then 0.002::double + 0.002::double * noise else
(50 + (h % 350::uhugeint)::double) * (1 + 0.5::double * sin(2 * pi() * (ts % 86400) / 86400 + (h % 24::uhugeint)::double / 24 * 2 * pi() / 6)) * case when (ts // 86400 + 3) % 7 >= 5 then 0.7::double else 1 end * (1 + 0.06::double * (noise - 0.5::double))
* case when service = 'checkout' and ts >= 1705276800 then 3 else 1 end end, 6) as value from u""",
    "scenario_costs": f"""with c as (select c_custkey, greatest(c_acctbal::double, 0.0) as gb, (c_custkey * 7 % 20000)::double as n from customer),
p as (select *, {_two('gb', 0, 50)} + {_two('gb', 1, 50)} as logs, {_SER} as ser, gb * 1e9 / 500 / 1e6 * 1.7::double as idx, greatest(n - 1000, 0) * 0.05::double as over, {_two('(gb * 1.5::double)', 0)} as ing, {_two('(gb * 1.5::double)', 1)} as kept, {_two(_MGB, 0)} + {_two(_MGB, 1)} as met from c)
select c_custkey, round(logs, 8) as s_logs, round(ser, 8) as s_metrics, round(logs + ser + 19, 8) as s_total, round(idx, 8) as e_index, round(over, 8) as e_metrics, round(gb * 0.1::double + idx + over + 150, 8) as e_total,
round(kept, 8) as v_retained, round(met, 8) as v_metrics, round(ing + kept + met, 8) as v_total from p""",
}
