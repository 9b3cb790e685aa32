"""Synthetic logs and metrics, the same rows at every partitioning: all draws are hashes of a row's number."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Services and their messages.
TEMPLATES = {
    "auth": [
        "User {uid} logged in from {ip}",
        "Token refreshed for session {uuid}",
        "Login failed for user {uid} from {ip}: bad password",
        "GET /oauth/authorize 302 {ms}ms",
        "JWKS cache refreshed keys={n}",
    ],
    "checkout": [
        "Order {oid} created for user {uid} total={amount} currency=EUR",
        "Payment authorized order={oid} provider=stripe latency_ms={ms}",
        "GET /api/v1/cart/{uid} 200 {ms}ms",
        "POST /api/v1/checkout 201 {ms}ms",
        "Retrying payment call attempt={n} order={oid}",
        "Inventory reserved sku={sku} qty={n} warehouse=wh-{n}",
    ],
    "gateway": [
        '{ip} - - "GET /api/v1/products/{n} HTTP/1.1" 200 {bytes} {ms}ms',
        '{ip} - - "POST /api/v1/orders HTTP/1.1" 201 {bytes} {ms}ms',
        '{ip} - - "GET /healthz HTTP/1.1" 200 2 0ms',
        "Upstream checkout responded 503 retry={n}",
        "Rate limit applied client={ip} limit=100/s",
    ],
    "search": [
        "Query executed q_hash={hex} hits={n} took={ms}ms",
        "Cache miss key=search:{hex}",
        "Cache hit key=search:{hex}",
        "Shard {n} responded in {ms}ms",
        "Slow query detected took={ms}ms threshold=500ms",
    ],
    "worker": [
        "Job {uuid} started type=email",
        "Job {uuid} finished in {ms}ms",
        "Consumed {n} messages from topic orders partition={n}",
        "Committed offset {n} for partition {n}",
    ],
}
# The service and message of the injected burst, and the time of the first line.
BURST = ("checkout", "ERROR db pool exhausted: timeout acquiring connection after {ms}ms (active={n} idle=0)")
START = 1_789_344_000
# Names of the metrics by type.
METRICS = {"requests": "anomaly:svc:requests:rate1m", "errors": "anomaly:svc:errors:ratio1m"}


def _draw(row: Column, below: int, *salt: int) -> Column:
    return F.pmod(F.xxhash64(row, *map(F.lit, salt)), F.lit(below))


def _value(kind: str, row: Column, *salt: int) -> Column:
    """The text of a placeholder."""
    number = lambda low, below, k=0: (_draw(row, below, *salt, k) + low).cast("string")
    digest = F.md5(F.concat_ws(",", row.cast("string"), *(F.lit(str(s)) for s in salt)))
    return {
        "oid": number(1_000_000, 9_000_000), "uid": number(1, 1_000_000), "ms": number(1, 2000), "n": number(0, 65), "bytes": number(100, 49_900),
        "sku": F.concat(F.lit("SKU-"), number(1000, 9000)), "amount": ((_draw(row, 49_900, *salt) + 100) / 100).cast("decimal(5,2)").cast("string"),
        "ip": F.concat_ws(".", F.lit("10"), number(0, 256), number(0, 256, 1), number(1, 254, 2)), "hex": F.substring(digest, 1, 16),
        "uuid": F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
    }[kind]


def _message(template: str, row: Column, seed: int) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(_value(p, row, seed, at) if at % 2 else F.lit(p) for at, p in enumerate(parts)))


def _level(template: str) -> str:
    if template.startswith("ERROR") or "failed" in template:
        return "error"
    return "warn" if template.startswith(("Retrying", "Slow")) or "503" in template else "info"


def log_lines(spark: SparkSession, lines: int, burst: float = 0.05, share: float = 0.3, seed: int = 1, drop: tuple[str, float] | None = None) -> DataFrame:
    """(line_no, ts, service, level, message): a line a millisecond, services and their messages equally often.

    In the last ``burst`` of the lines a ``share`` of them is an error of one service; ``drop`` (service, fraction) says
    after which fraction a service falls silent, whose lines then go to the next one.
    """
    row, names = F.col("id"), list(TEMPLATES)
    tail = (row >= int(lines * (1 - burst))) & (_draw(row, 1000, seed, -1) < int(1000 * share))
    service = _draw(row, len(names), seed, -2)
    if drop:
        gone, rest = names.index(drop[0]), len(names) - 1
        away = (gone + 1 + _draw(row, rest, seed, -3)) % (rest + 1)
        service = F.when((service == gone) & (row >= int(lines * drop[1])), away).otherwise(service)
    out = F.when(tail, F.struct(F.lit(BURST[0]).alias("service"), F.lit(_level(BURST[1])).alias("level"), _message(BURST[1], row, seed).alias("message")))
    for s, (name, templates) in enumerate(TEMPLATES.items()):
        for t, template in enumerate(templates):
            line = F.struct(F.lit(name).alias("service"), F.lit(_level(template)).alias("level"), _message(template, row, seed).alias("message"))
            out = out.when((F.col("s") == s) & (_draw(row, len(templates), seed, -4) == t), line)
    each = spark.range(lines).withColumn("s", service).select("id", out.alias("l"))
    return each.select(row.alias("line_no"), F.timestamp_millis(F.lit(START * 1000) + row).alias("ts"), "l.service", "l.level", "l.message")


def written(lines: DataFrame, app: str = "json", container: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(service, line_no, keep, text): lines as an application writes them (json or text), and as a container runtime wraps
    them (cri or docker; null: not)."""
    utc = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    at, stream = F.concat(utc, F.lit("Z")), F.when(F.col("level") == "error", "stderr").otherwise("stdout")
    if app == "json":
        event = F.struct(at.alias("@timestamp"), F.struct(F.col("service").alias("name")).alias("service"), F.struct("level").alias("log"), "message")
        text = F.to_json(event)
    else:
        text = F.concat_ws(" ", at, F.upper("level"), "message")
    if container == "cri":
        text = F.concat_ws(" ", F.concat(utc, F.lit("000000Z")), stream, F.lit("F"), text)
    elif container == "docker":
        text = F.to_json(F.struct(F.concat(text, F.lit("\n")).alias("log"), stream.alias("stream"), at.alias("time")))
    return lines.select("service", "line_no", *keep, text.alias("text"))


# The constants of FNV-1a and splitmix64, 64 bits.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def fnv(text: str) -> int:
    h = FNV_START
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME % 2**64
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers, mixed; products wrap."""
    x = x + np.uint64(MIX[0])
    for shift, factor in ((30, MIX[1]), (27, MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _shape(service: pd.Series, metric: pd.Series, minute: pd.Series) -> pd.DataFrame:
    """What the hashes of a service and a metric give; Python, as their products wrap at 64 bits."""
    own = service.map({s: fnv(s) for s in service.unique()}).to_numpy(np.uint64)
    both = service + metric
    key = both.map({s: fnv(s) for s in both.unique()}).to_numpy(np.uint64)
    noise = (mixed(key ^ minute.to_numpy(np.int64).view(np.uint64)) >> np.uint64(11)) / 2.0**53
    return pd.DataFrame({"base": (own % np.uint64(350)).astype(np.int64), "hour": (own % np.uint64(24)).astype(np.int64), "noise": noise})


def metric_values(rows: DataFrame, injected: tuple[str, int, str] | None = None) -> DataFrame:
    """Adds ``value`` to rows of (service, type, ts in seconds): requests follow the day, with calmer weekends and a noise of
    6 %, errors are a small ratio. ``injected`` is (service, from when on, spike, drop or errors)."""
    names = F.create_map(*(F.lit(x) for pair in METRICS.items() for x in pair))
    shape = F.pandas_udf(_shape, "base long, hour long, noise double")
    shaped = rows.withColumn("__s", shape(F.col("service"), names[F.col("type")], F.floor(F.col("ts") / 60)))
    angle = 2 * math.pi * F.pmod("ts", F.lit(86400)) / 86400 + F.col("__s.hour") / 24 * 2 * math.pi / 6
    weekday = F.pmod(F.floor(F.col("ts") / 86400) + 3, F.lit(7))
    requests = (50 + F.col("__s.base")) * (1 + 0.5 * F.sin(angle)) * F.when(weekday >= 5, 0.7).otherwise(1.0) * (1 + 0.06 * (F.col("__s.noise") - 0.5))
    errors = 0.002 + 0.002 * F.col("__s.noise")
    if injected:
        service, at, kind = injected
        hit = (F.col("service") == service) & (F.col("ts") >= at)
        requests = F.when(hit, requests * {"spike": 3.0, "drop": 0.2}.get(kind, 1.0)).otherwise(requests)
        errors = F.when(hit & F.lit(kind == "errors"), 0.08).otherwise(errors)
    return shaped.withColumn("value", F.when(F.col("type") == "requests", requests).when(F.col("type") == "errors", errors).otherwise(0.0)).drop("__s")


def metric_samples(spark: SparkSession, start: int, end: int, step: int, injected: tuple[str, int, str] | None = None) -> DataFrame:
    """(service, type, ts, value) of all services and metrics from ``start``, cut to the step, up to ``end``."""
    grid = spark.range(start // step * step, end, step).select(F.col("id").alias("ts"))
    each = grid.select(F.explode(F.lit(list(TEMPLATES))).alias("service"), "ts").select("service", F.explode(F.lit(list(METRICS))).alias("type"), "ts")
    return metric_values(each, injected)
