"""Findings: debounce, absent series, new templates, signatures, throttling, and how they look when they fire."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Debounce:
    """State of one series: fires after ``need`` anomalous buckets in a row, resolves after two normal or three
    missing ones. A gap ends a run of anomalous buckets but not a run of normal ones."""

    def __init__(self, need: int = 2, normal_need: int = 2, missing_need: int = 3, state: tuple = (0, 0, 0, False)):
        self.need, self.normal_need, self.missing_need = need, normal_need, missing_need
        self.pending, self.normal, self.missing, self.firing = state

    @property
    def state(self) -> tuple:
        return self.pending, self.normal, self.missing, self.firing

    def step(self, anomalous: bool | None) -> str | None:
        """fire, update, resolve or nothing, for a bucket that is anomalous, normal or (None) not scored."""
        if anomalous is None:
            self.missing += 1
            self.pending = 0
            if self.firing and self.missing >= self.missing_need:
                self.pending = self.normal = 0
                self.firing = False
                return "resolve"
            return None
        self.missing = 0
        if anomalous:
            self.pending += 1
            self.normal = 0
            if self.firing:
                return "update"
            if self.pending >= self.need:
                self.firing = True
                return "fire"
            return None
        self.normal += 1
        self.pending = 0
        if self.firing and self.normal >= self.normal_need:
            self.firing = False
            return "resolve"
        return None


def debounce_events(scored: DataFrame, keys: tuple[str, ...], need: int = 2) -> DataFrame:
    """(keys, bucket, event, score) from rows (keys, bucket, score, anomalous); a null ``anomalous`` is a gap.

    A series' buckets are one group: their number is bounded by the retention, not by the rows of the corpus.
    """
    fields = {f.name: f.dataType.simpleString() for f in scored.schema.fields}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("bucket"), Debounce(need), []
        for b, s, a in zip(group["bucket"], group["score"], group["anomalous"], strict=True):
            event = state.step(None if a is None or pd.isna(a) else bool(a))
            if event:
                out.append((*(group[k].iloc[0] for k in keys), int(b), event, s))
        return pd.DataFrame(out, columns=[*keys, "bucket", "event", "score"])

    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "bucket long, event string, score double"])
    return scored.select(*keys, "bucket", "score", "anomalous").groupBy(*keys).applyInPandas(run, schema)


def firing_islands(scored: DataFrame, keys: tuple[str, ...], need: int = 2) -> DataFrame:
    """(keys, start, fired_at, last, peak) of runs of at least ``need`` anomalous buckets: gaps and islands in SQL."""
    w = W.partitionBy(*keys).orderBy("bucket")
    hit = scored.where("anomalous").withColumn("g", F.col("bucket") - F.row_number().over(w))
    runs = hit.groupBy(*keys, "g").agg(F.min("bucket").alias("start"), F.max("bucket").alias("last"), F.max(F.abs("score")).alias("peak"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= need).select(*keys, "start", (F.col("start") + need - 1).alias("fired_at"), "last", "peak")


def throttle(events: DataFrame, keys: tuple[str, ...], ts: str, seconds: int) -> DataFrame:
    """Events at least ``seconds`` after the last one that was let through, per key."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, last, keep = group.sort_values(ts), None, []
        for t in group[ts]:
            ok = last is None or t - last >= seconds
            last = t if ok else last
            keep.append(ok)
        return group[keep]

    return events.groupBy(*keys).applyInPandas(run, fields)


def absent_series(series: DataFrame, keys: tuple[str, ...], need: int = 3) -> DataFrame:
    """(keys, since, fired_at) of gaps of at least ``need`` buckets in which some other series had data."""
    seen = series.where("value is not null").select("bucket").distinct()
    have = series.where("value is not null").select(*keys, "bucket").distinct()
    order = W.partitionBy(*keys).orderBy("bucket")
    spans = have.withColumn("next", F.lead("bucket").over(order))
    last = F.broadcast(seen.agg((F.max("bucket") + 1).alias("end")))  # one row
    gaps = spans.join(last).withColumn("until", F.coalesce("next", "end")).where("until - bucket > 1")
    missing = gaps.select(*keys, F.col("bucket").alias("present"), F.explode(F.sequence(F.col("bucket") + 1, F.col("until") - 1)).alias("bucket"))
    counted = missing.join(seen, "bucket", "left_semi")
    rank = F.row_number().over(W.partitionBy(*keys, "present").orderBy("bucket"))
    ranked = counted.withColumn("rn", rank)
    return ranked.groupBy(*keys, "present").agg(F.min("bucket").alias("since"), F.min(F.when(F.col("rn") == need, F.col("bucket"))).alias("fired_at")).where("fired_at is not null").drop("present")


def new_templates(counts: DataFrame, keys: tuple[str, ...] = ("service", "template"), warmup: int = 3600, window: int = 900, least: int = 5) -> DataFrame:
    """(keys, first_ts, lines) of templates first seen after the warm-up with ``least`` lines within the window."""
    start = F.broadcast(counts.agg(F.min("ts").alias("log_start")))  # one row
    first = counts.groupBy(*keys).agg(F.min("ts").alias("first_ts")).join(start).where(F.col("first_ts") - F.col("log_start") >= warmup)
    within = counts.join(first, list(keys)).where(F.col("ts") <= F.col("first_ts") + window)
    return within.groupBy(*keys).agg(F.min("first_ts").alias("first_ts"), F.sum("n").alias("lines")).where(F.col("lines") >= least)


def parse_signatures(text: str) -> list[tuple[str, str]]:
    """(name, pattern) of lines ``name: pattern``; errors carry the line's number."""
    out: list[tuple[str, str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, colon, pattern = (x.strip() for x in line.partition(":"))
        if not colon or not pattern:
            raise ValueError(f"line {number}: expected name: pattern")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise ValueError(f"line {number}: bad name {name!r}")
        if name in dict(out):
            raise ValueError(f"line {number}: duplicate name {name!r}")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"line {number}: {e}") from e
        out.append((name, pattern))
    return out


def signature_matches(templates: DataFrame, signatures: list[tuple[str, str]], template: str = "template") -> DataFrame:
    """One row per template and matching signature; the patterns are configuration, so they become one expression."""
    hits = F.array(*(F.when(F.rlike(F.col(template), F.lit(p)), F.lit(n)) for n, p in signatures))
    return templates.withColumn("signature", F.explode(F.filter(hits, lambda s: s.isNotNull())))


def signature_findings(counts: DataFrame, signatures: list[tuple[str, str]]) -> DataFrame:
    """Per service and signature the matching template with most lines (ties to the smaller text) and all lines."""
    matched = signature_matches(counts.groupBy("service", "template").agg(F.sum("n").alias("lines")), signatures)
    return matched.groupBy("service", "signature").agg(F.min_by("template", F.struct(-F.col("lines"), F.col("template"))).alias("template"), F.sum("lines").alias("lines"))


def findings(events: DataFrame, kind: str, name: str = "SeriesAnomaly") -> DataFrame:
    """Finding rows (id, kind, state, labels, annotations, bucket, score) of events (service, level, event, …)."""
    direction = F.when(F.col("score") >= 0, "up").otherwise("down")
    level = F.coalesce(F.col("level"), F.lit(""))
    sev = F.when(level.isin("error", "warn") & (direction == "up"), "warning").otherwise("info")
    labels = F.create_map(F.lit("alertname"), F.lit(name), F.lit("service"), F.col("service"), F.lit("severity"), sev, F.lit("direction"), direction, F.lit("level"), level)
    text = F.format_string("%s is %s: score %s", F.col("service"), direction, F.round("score", 3).cast("string"))
    return events.select(
        F.md5(F.concat_ws("|", F.lit(kind), "service", level)).alias("id"), F.lit(kind).alias("kind"),
        F.when(F.col("event") == "resolve", "resolved").otherwise("firing").alias("state"), labels.alias("labels"),
        F.create_map(F.lit("summary"), text).alias("annotations"), "bucket", "score",
    )


def current_state(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last event of each key: what is firing and what has been resolved."""
    return events.groupBy(*keys).agg(F.max_by("event", "bucket").alias("event"), F.max("bucket").alias("bucket"), F.min(F.when(F.col("event") == "fire", F.col("bucket"))).alias("first_fire"))
