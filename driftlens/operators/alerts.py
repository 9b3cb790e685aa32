"""Alert payloads, routing, grouping and inhibition; and the read side of findings and agents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.promql import matches


@dataclass(frozen=True)
class Route:
    """A receiver for alerts that meet all matchers; the first that fits wins unless it says to go on."""

    receiver: str
    matchers: tuple[tuple[str, str, str], ...] = ()
    go_on: bool = False


def route(alerts: DataFrame, routes: list[Route], default: str, labels: str = "labels") -> DataFrame:
    """One row per alert and receiver."""
    hits, taken = [], F.lit(False)
    for r in routes:
        fits = matches(F.col(labels), list(r.matchers)) & ~taken
        hits.append(F.when(fits, F.lit(r.receiver)))
        if not r.go_on:
            taken = taken | fits
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return alerts.withColumn("receiver", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))))


def inhibit(alerts: DataFrame, source: list[tuple[str, str, str]], target: list[tuple[str, str, str]], equal: tuple[str, ...], labels: str = "labels") -> DataFrame:
    """Without target alerts whose ``equal`` labels a firing source alert shares; a source doesn't inhibit itself."""
    key = F.concat_ws("\x00", *(F.coalesce(F.try_element_at(F.col(labels), F.lit(e)), F.lit("")) for e in equal))
    marked = alerts.withColumn("__key", key)
    sources = marked.where(matches(F.col(labels), source)).select("__key").distinct().withColumn("__hit", F.lit(True))
    joined = marked.join(sources, "__key", "left")
    inhibited = matches(F.col(labels), target) & F.coalesce("__hit", F.lit(False)) & ~matches(F.col(labels), source)
    return joined.where(~inhibited).drop("__key", "__hit")


def group_alerts(alerts: DataFrame, by: tuple[str, ...], most: int = 20, labels: str = "labels") -> DataFrame:
    """Notifications by receiver and labels: the number of alerts and the first ``most`` ids."""
    cols = [F.coalesce(F.try_element_at(F.col(labels), F.lit(b)), F.lit("")).alias(b) for b in by]
    return alerts.select("receiver", *cols, "id").groupBy("receiver", *by).agg(F.count(F.lit(1)).alias("alerts"), F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"))


def alert_payload(findings: DataFrame, now: int, evaluate_every: int = 30) -> DataFrame:
    """Rows as an alert manager takes them: firing ones end after four evaluations or two minutes unless sent again."""
    ends = F.when(F.col("state") == "firing", F.lit(now + max(4 * evaluate_every, 120))).otherwise(F.col("ends_at"))
    return findings.select("labels", "annotations", F.col("starts_at").alias("startsAt"), ends.alias("endsAt"))


def agents(pushes: DataFrame, now: int, ttl: int = 86400, active: int = 3600) -> DataFrame:
    """Registry of agents by their pushes: last push, pushes, lines, rejected, services of the last hour."""
    rows = pushes.where(F.col("ts") >= now - ttl)
    return rows.groupBy("agent").agg(
        F.max("ts").alias("last_push"), F.count(F.lit(1)).alias("pushes"), F.sum("lines").alias("lines"), F.count_if(F.col("rejected")).alias("rejected"),
        F.array_sort(F.collect_set(F.when(F.col("ts") >= now - active, F.col("service")))).alias("services"),
    )


def active_by_kind(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """Firing findings of each kind, zeros included."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(k,) for k in kinds], "kind string")
    n = findings.where(F.col("state") == "firing").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("active"))
