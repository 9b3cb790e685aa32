"""Log sources: container envelopes, joined chunks, fields of JSON lines, agent pushes, and the sinks' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CRI = r"^[0-9]\S* (stdout|stderr) ([PF])\S*(?: (.*))?$"
PUSH = "agent string, step long, items array<struct<service: string, template: string, level: string, counts: array<array<bigint>>>>"


def unwrap(line: Column, kind: str = "auto") -> Column:
    """``struct<text, stderr, partial>`` of a line in a CRI or Docker envelope; other lines pass through."""
    cri = F.struct(F.coalesce(F.regexp_extract(line, _CRI, 3), F.lit("")).alias("text"), (F.regexp_extract(line, _CRI, 1) == "stderr").alias("stderr"), (F.regexp_extract(line, _CRI, 2) == "P").alias("partial"))
    log, stream = F.get_json_object(line, "$.log"), F.get_json_object(line, "$.stream")
    docker = F.struct(F.regexp_replace(log, r"\r?\n$", "").alias("text"), (stream == "stderr").alias("stderr"), (~F.endswith(log, F.lit("\n"))).alias("partial"))
    plain = F.struct(line.alias("text"), F.lit(False).alias("stderr"), F.lit(False).alias("partial"))
    as_cri = F.when(F.rlike(line, F.lit(_CRI)), cri).otherwise(plain)
    as_docker = F.when(log.isNotNull() & stream.isin("stdout", "stderr"), docker).otherwise(plain)
    if kind == "cri":
        return as_cri
    if kind == "docker":
        return as_docker
    return F.when(F.startswith(line, F.lit("{")), as_docker).otherwise(as_cri)


def join_partials(lines: DataFrame, keys: tuple[str, ...] = ("path", "stderr"), order: str = "line_no") -> DataFrame:
    """Join split lines per file and stream: a line ends with the first chunk that is not partial."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    numbered = lines.withColumn("__g", F.coalesce(F.sum(F.when(F.col("partial"), 0).otherwise(1)).over(before), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("text").alias("text"))))
    return numbered.groupBy(*keys, "__g").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).drop("__g")


_ENTRIES = "map<string,string>"


def field(line: Column, path: str) -> Column:
    """A field of a JSON object by its dotted path, flat, nested or both; of several the last in the text.

    Other values than strings come as JSON text, so a JSON null is ``null``; a missing field is null.
    """

    def found(text: Column, parts: list[str]) -> Column:
        """An array of the values, in order."""
        entries = F.coalesce(F.map_entries(F.from_json(text, _ENTRIES)), F.expr("cast(array() as array<struct<key: string, value: string>>)"))

        def values(e: Column) -> Column:
            out = F.when(e["key"] == ".".join(parts), F.array(F.coalesce(e["value"], F.lit("null"))))
            for k in range(1, len(parts)):
                head = ".".join(parts[:k])
                out = out.when((e["key"] == head) & F.startswith(F.ltrim(e["value"]), F.lit("{")), found(e["value"], parts[k:]))
            return out.otherwise(F.expr("cast(array() as array<string>)"))

        return F.flatten(F.transform(entries, values))

    return F.try_element_at(found(line, path.split(".")), F.lit(-1))


def extract(lines: DataFrame, text: str = "text", default_service: str = "unknown") -> DataFrame:
    """Adds message, service and level (as logged); a JSON line without message has an empty one, a plain line itself."""
    line = F.col(text)
    is_json = F.startswith(F.ltrim(line), F.lit("{")) & F.from_json(line, _ENTRIES).isNotNull()
    return lines.withColumns({
        "message": F.when(is_json, F.coalesce(field(line, "message"), F.lit(""))).otherwise(line),
        "service": F.coalesce(F.when(is_json, field(line, "service.name")), F.lit(default_service)),
        "level": F.when(is_json, field(line, "log.level")),
    })


def service_of_path(path: Column, pattern: str, default: str = "unknown") -> Column:
    """The service from a file's path by the first group of a pattern."""
    got = F.regexp_extract(path, pattern, 1)
    return F.when(got != "", got).otherwise(F.lit(default))


def pushed_counts(pushes: DataFrame, server_step: int, now: int, max_future: int = 300) -> DataFrame:
    """(agent, service, template, level, ts, n) of agent pushes; steps must divide the server's, future and empty go."""
    ok = pushes.where((F.col("step") >= 0) & ((F.col("step") == 0) | (F.lit(server_step) % F.when(F.col("step") > 0, F.col("step")) == 0)))
    items = ok.select("agent", F.explode("items").alias("i")).where(F.coalesce(F.col("i.template"), F.lit("")) != "")
    each = items.select("agent", "i.service", "i.template", "i.level", F.explode("i.counts").alias("c"))
    out = each.select("agent", "service", "template", "level", F.col("c")[0].alias("ts"), F.col("c")[1].alias("n"))
    return out.where((F.col("n") > 0) & (F.col("ts") <= now + max_future))


def push_items(counts: DataFrame) -> DataFrame:
    """Counts (service, template, level, bucket, n) as push items with sorted bucket counts."""
    summed = counts.groupBy("service", "template", "level", "bucket").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.array(F.col("bucket").cast("long"), F.col("n").cast("long"))))
    return summed.groupBy("service", "template", "level").agg(pairs.alias("counts"))


def exposition(samples: DataFrame, metric: str = "metric", labels: str = "labels", value: str = "value") -> DataFrame:
    """Text lines ``name{k="v"} value``; backslash, quote and line feed are escaped, bad label names dropped."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    good = F.map_filter(F.col(labels), lambda k, _: F.rlike(k, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")) & ~F.startswith(k, F.lit("__")))
    pairs = F.transform(F.array_sort(F.map_entries(good)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    v = F.col(value)
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    number = F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, v.cast("decimal(18,0)").cast("string")).otherwise(F.regexp_replace(F.lower(v.cast("string")), r"\.0e|e(?=\d)", "e+"))
    return samples.select(F.concat(F.col(metric), F.lit("{"), F.array_join(pairs, ","), F.lit("} "), number).alias("line"))


def export_labels(labels: Column) -> Column:
    """``__name__`` becomes ``metric``; a former ``metric`` and ``anomaly_*`` labels go."""
    kept = F.map_filter(labels, lambda k, _: (k != "metric") & ~F.startswith(k, F.lit("anomaly_")))
    return F.transform_keys(kept, lambda k, _: F.when(k == "__name__", F.lit("metric")).otherwise(k))
