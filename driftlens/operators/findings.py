"""From series to findings: which series and buckets are judged, how, what fires, and how findings and templates are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import detect, lifecycle, series

#: Kinds of metrics of which only a rise is a finding, and levels of log volumes likewise.
UP_ONLY, UP_LEVELS = ("errors", "latency"), ("error", "warn")


def direction(metric_type: Column, volume_level: Column) -> Column:
    """``up`` for errors, latency and volumes of errors and warnings; null: both sides count."""
    return F.when(metric_type.isin(*UP_ONLY) | volume_level.isin(*UP_LEVELS), "up")


def abs_floor(metric_type: Column, floors: dict[str, float], default: float = 1e-9) -> Column:
    """The least scale by the metric's type."""
    if not floors:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for k, v in sorted(floors.items()) for x in (k, v)))
    return F.coalesce(F.try_element_at(table, metric_type), F.lit(default))


def unite(metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Metric and log series as one table with a column ``is_log``; columns that one side lacks are null."""
    return metrics.withColumn("is_log", F.lit(False)).unionByName(logs.withColumn("is_log", F.lit(True)), allowMissingColumns=True)


def open_bucket(samples: DataFrame, step: int, grace: int = 0, ts: str = "ts_s") -> DataFrame:
    """One row: the first bucket that the data, less a grace, has not closed."""
    return samples.agg(F.floor((F.max(ts) - grace) / step).cast("long").alias("open"))


def due(scored: DataFrame, last_eval: DataFrame, keys: tuple[str, ...], open_at: int, catch_up: int = 3) -> DataFrame:
    """Rows of the buckets that one evaluation judges: closed, later than the last one judged, the newest ``catch_up``
    only; older ones are skipped for good. A series that was never judged has no row in ``last_eval`` (keys, last)."""
    seen = scored.join(last_eval.select(*keys, F.col("last").alias("__last")), list(keys), "left")
    low = F.greatest(F.coalesce(F.col("__last") + 1, F.lit(0)), F.lit(open_at - catch_up))
    return seen.where((F.col("bucket") < open_at) & (F.col("bucket") >= low)).drop("__last")


def is_anomalous(threshold: float = 4.0) -> Column:
    """As ``detect.anomalous`` with columns ``direction`` and ``min_volume`` of each series."""
    s = F.col("score")
    side = F.when(F.col("direction") == "up", s >= threshold).when(F.col("direction") == "down", s <= -threshold).otherwise(F.abs(s) >= threshold)
    return side & ((F.col("min_volume") <= 0) | (F.greatest("observed", "expected") >= F.col("min_volume")))


def evaluate(points: DataFrame, keys: tuple[str, ...], config: DataFrame, p: detect.Params, need: int = 2) -> DataFrame:
    """Events (keys, bucket, event, score) of series (keys, bucket, value).

    Gaps are filled, buckets scored, and each series judged by its row of ``config`` (keys, direction, min_volume);
    a bucket that can't be scored is a gap. The configuration has one row a series and is joined on its keys.
    """
    filled = series.gap_fill(points, keys, "mean")
    scored = detect.score(filled, keys, p)
    judged = scored.join(config, list(keys), "left").withColumn("min_volume", F.coalesce("min_volume", F.lit(0.0)))
    judged = judged.withColumn("anomalous", is_anomalous(p.threshold)).select(*keys, "bucket", "score", "anomalous")
    grid = filled.select(*keys, "bucket").join(judged, [*keys, "bucket"], "left")
    return lifecycle.debounce_events(grid, keys, need)


def lifetimes(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, state, starts_at, updated_at, ends_at, score) of each finding: a fire, its updates and what resolves it."""
    order = W.partitionBy(*keys).orderBy("bucket")
    numbered = events.withColumn("n", F.sum((F.col("event") == "fire").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = F.max(F.when(F.col("event") == "resolve", F.col("bucket")))
    found = numbered.where("n > 0").groupBy(*keys, "n").agg(
        F.min("bucket").alias("starts_at"), F.max("bucket").alias("updated_at"), ends.alias("ends_at"),
        F.max_by("score", F.when(F.col("event") != "resolve", F.col("bucket"))).alias("score"),
    )
    return found.withColumn("state", F.when(F.col("ends_at").isNull(), "firing").otherwise("resolved")).drop("n")


def absent_findings(points: DataFrame, scores: DataFrame, keys: tuple[str, ...], need: int = 3, ttl: int | None = None, floor: float = 0.0) -> DataFrame:
    """(keys, since, fired_at, ends_at, expected) of series that went missing while others came.

    Only series whose last expected value before the gap is above ``floor`` count. A finding ends when data returns or
    ``ttl`` buckets after it went missing; then it is quiet until data returns.
    """
    gaps = lifecycle.absent_series(points, keys, need)
    have = points.where("value is not null").select(*keys, F.col("bucket").alias("__b"))
    back = gaps.join(have, list(keys)).where(F.col("__b") > F.col("fired_at")).groupBy(*keys, "since").agg(F.min("__b").alias("returned"))
    known = scores.select(*keys, F.col("bucket").alias("__b"), F.col("expected").alias("__e"))
    last = gaps.join(known, list(keys)).where(F.col("__b") < F.col("since")).groupBy(*keys, "since").agg(F.max_by("__e", "__b").alias("expected"))
    found = gaps.join(last, [*keys, "since"]).where(F.col("expected") > floor).join(back, [*keys, "since"], "left")
    stop = F.col("since") + ttl if ttl else F.lit(None).cast("long")
    return found.select(*keys, "since", "fired_at", F.least("returned", stop).alias("ends_at"), "expected")


def list_findings(findings: DataFrame, finding_id: str | None = None, state: str | None = None, resolved: int = 500) -> DataFrame:
    """Findings from the latest start on; of the resolved ones the newest ``resolved``, none for the state ``firing``."""
    firing = findings.where(F.col("state") == "firing")
    out = firing
    if state != "firing":
        out = firing.unionByName(findings.where(F.col("state") == "resolved").orderBy(F.desc("ends_at"), "id").limit(resolved))
    if finding_id is not None:
        out = out.where(F.col("id") == finding_id)
    return out.orderBy(F.desc("starts_at"), "id")


def list_templates(counts: DataFrame, signatures: list[tuple[str, str]] = (), service: str | None = None) -> DataFrame:
    """(service, template, lines, level, inferred_level, levels, signatures) of (service, template, level, n).

    ``level`` has most lines, ``levels`` is the histogram, ``signatures`` the names that match; by service, then from
    most lines down.
    """
    rows = counts if service is None else counts.where(F.col("service") == service)
    each = rows.groupBy("service", "template", "level").agg(F.sum("n").alias("n"))
    out = each.groupBy("service", "template").agg(
        F.sum("n").alias("lines"), F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("level"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels"),
    )
    names = F.array(*(F.when(F.rlike(F.col("template"), F.lit(p)), F.lit(n)) for n, p in signatures)) if signatures else F.expr("cast(array() as array<string>)")
    out = out.withColumn("signatures", F.filter(names, lambda s: s.isNotNull())).withColumn("inferred_level", text.infer_level(F.col("template")))
    return out.orderBy("service", F.desc("lines"), "template")


def with_template(findings: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ("service", "template_id")) -> DataFrame:
    """Findings with the template's text, level and inferred level; all stay, whether or not the template is known."""
    return findings.join(templates.select(*keys, "template", "level", "inferred_level"), list(keys), "left")


def global_ids(pushed: DataFrame, known: DataFrame) -> DataFrame:
    """Pushed rows with the id of the known template of the same service and text, null where there is none yet."""
    return pushed.join(known.select("service", "template", "template_id"), ["service", "template"], "left")


def merged_pushes(failed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts of pushes that failed, added to those that came since."""
    both = failed.unionByName(fresh)
    return both.groupBy("service", "template", "level", "bucket").agg(F.sum("n").alias("n"))


def retained(rows: DataFrame, keys: tuple[str, ...], now: int, ttl: int, at: str = "bucket", keep: DataFrame | None = None) -> DataFrame:
    """Rows of the keys that have data within the last ``ttl``, and of those in ``keep``, as firing ones are."""
    last = rows.groupBy(*keys).agg(F.max(at).alias("__at")).where(F.col("__at") > now - ttl).select(*keys)
    alive = last if keep is None else last.unionByName(keep.select(*keys)).distinct()
    return rows.join(alive, list(keys), "left_semi")


def capped_series(rows: DataFrame, group: tuple[str, ...], order: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each query."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(order))).where(F.col("__r") <= most).drop("__r")


def line_counts(lines: DataFrame, service: str = "service", template: str = "template_id") -> DataFrame:
    """(service, template_id, lines, of_service): lines without a service are ``unknown``, without a template ``other``."""
    named = lines.select(F.coalesce(F.col(service), F.lit("unknown")).alias("service"), F.coalesce(F.col(template).cast("string"), F.lit("other")).alias("template_id"))
    each = named.groupBy("service", "template_id").agg(F.count(F.lit(1)).alias("lines"))
    return each.withColumn("of_service", F.sum("lines").over(W.partitionBy("service")))


def observed_again(expected: Column, score: Column, upper: Column, threshold: float) -> Column:
    """The value that a score came from, given the upper bound of its band."""
    return expected + score * (upper - expected) / threshold


def with_labels(labels: Column, more: dict[str, str]) -> Column:
    """A label map with a rule's own labels; these win."""
    own = F.create_map(*(F.lit(x) for k, v in sorted(more.items()) for x in (k, v)))
    return F.map_concat(F.map_filter(labels, lambda k, _: ~k.isin(*more)), own)


def label_values(rows: DataFrame, name: str, labels: str = "labels") -> DataFrame:
    """The values that a label has, in order."""
    value = F.try_element_at(F.col(labels), F.lit(name))
    return rows.select(value.alias("value")).where("value is not null").distinct().orderBy("value")


def annotations(scores: DataFrame, threshold: float, at: str = "bucket") -> DataFrame:
    """(at, score) of the times at which some series is beyond the threshold."""
    return scores.groupBy(at).agg(F.max(F.abs("score")).alias("score")).where(F.col("score") >= threshold)


def split_key(key: Column) -> Column:
    """``struct<service, template_id>`` of a joined key; the template may hold commas."""
    return F.struct(F.substring_index(key, ",", 1).alias("service"), F.regexp_extract(key, "^[^,]*,(?s)(.*)$", 1).alias("template_id"))


def evaluation_grid(samples: DataFrame, keys: tuple[str, ...], start: int, end: int, interval: int, lookback: int = 300, ts: str = "ts", value: str = "value") -> DataFrame:
    """(keys, at, value): at each evaluation the newest sample of the look-back before it; a sample goes straight to the
    evaluations that see it, so there is no range join. Of samples of one time the smallest value counts, and a null only
    where there is no other; samples without a time are seen by none."""
    first = F.greatest(F.ceil((F.col(ts) - start) / interval), F.lit(0)) * interval + start
    last = F.least(F.lit(end), F.floor((F.col(ts) + lookback - 1 - start) / interval) * interval + start)
    seen = samples.where(F.col(ts).isNotNull()).withColumn("__f", first.cast("long")).withColumn("__l", last.cast("long")).where("__f <= __l")
    each = seen.withColumn("at", F.explode(F.sequence("__f", "__l", F.lit(interval).cast("long"))))
    newest = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(ts)).alias("age"), F.col(value).alias("value"))))
    return each.groupBy(*keys, "at").agg(newest["value"].alias(value))


def routed(spans: DataFrame, partitions: int) -> DataFrame:
    """All spans of a trace in one partition."""
    return spans.repartition(partitions, "trace_id")
