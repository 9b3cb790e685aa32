"""Structured Streaming forms: counts with a watermark, sampled traces, and stateful debounce that still takes late rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlens.functions.text import mask_line, template_key, template_text
from driftlens.operators.lifecycle import Debounce
from driftlens.operators.mining import Miner


def template_rollup(lines: DataFrame, minutes: int = 1, delay: str = "60 seconds") -> DataFrame:
    """Counts per minute, service, template and level of a stream of (ts, service, level, message)."""
    keyed = lines.select("ts", "service", "level", template_key(F.col("message")).alias("template_id"), template_text(F.col("message")).alias("template"))
    return keyed.withWatermark("ts", delay).groupBy(F.window("ts", f"{minutes} minutes").alias("minute"), "service", "template_id", "template", "level").agg(F.count(F.lit(1)).alias("n"))


class DebounceProcessor(StatefulProcessor):
    """Keeps a series' debounce state between micro-batches; a bucket is judged once, late ones are not judged again."""

    def __init__(self, need: int = 2):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("debounce", "pending int, normal int, missing int, firing boolean, last long")

    def handleInputRows(self, key, rows, timerValues):
        got = self.state.get() if self.state.exists() else (0, 0, 0, False, -1)
        machine, last, out = Debounce(self.need, state=tuple(got[:4])), got[4], []
        frames = [f for f in rows]
        for row in pd.concat(frames).sort_values("bucket").itertuples() if frames else []:
            if row.bucket <= last:
                continue
            last = int(row.bucket)
            event = machine.step(None if pd.isna(row.anomalous) else bool(row.anomalous))
            if event:
                out.append((key[0], last, event, float(row.score)))
        self.state.update((*machine.state, last))
        yield pd.DataFrame(out, columns=["key", "bucket", "event", "score"])

    def close(self) -> None:
        pass


def debounce_stream(scored: DataFrame, need: int = 2) -> DataFrame:
    """Events of a stream of (key, bucket, score, anomalous); needs the RocksDB state store."""
    return scored.groupBy("key").transformWithStateInPandas(
        statefulProcessor=DebounceProcessor(need), outputStructType="key string, bucket long, event string, score double", outputMode="Append", timeMode="None"
    )


class MinerProcessor(StatefulProcessor):
    """Keeps a service's templates between micro-batches, least recently used first, and returns those that changed."""

    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id long, template string, size long")
        self.made = handle.getValueState("made", "next long")

    def handleInputRows(self, key, rows, timerValues):
        miner = Miner(**self.options)
        for k, template, size in self.held.get():
            miner.restore(int(k), template.split(" ") if template else [], int(size))
        miner.next = int(self.made.get()[0]) if self.made.exists() else 1
        touched = set()
        for frame in rows:
            counts = frame.groupby("masked", sort=False).size()
            touched.update(miner.add(text.split(" ") if text else [], int(n)) for text, n in counts.items())
        held = [(k, template, n) for k, template, n, _ in miner.snapshot()]
        self.held.put(held)
        self.made.update((miner.next,))
        yield pd.DataFrame([(key[0], *row) for row in held if row[0] in touched], columns=["service", "template_id", "template", "size"])

    def close(self) -> None:
        pass


def mine_stream(lines: DataFrame, **options) -> DataFrame:
    """Templates of a stream of (service, message) as they come and grow; needs the RocksDB state store.

    A row tells a template's text and size after a micro-batch; the newest row of an id holds.
    """
    masked = lines.select(F.coalesce("service", F.lit("unknown")).alias("service"), F.coalesce(mask_line(F.col("message")), F.lit("")).alias("masked"))
    return masked.groupBy("service").transformWithStateInPandas(
        statefulProcessor=MinerProcessor(options), outputStructType="service string, template_id long, template string, size long", outputMode="Update", timeMode="None"
    )


def tail_sample_stream(spans: DataFrame, percent: int, bucket: Column, slow_ms: float = 1000, probe: Column | None = None, wait: str = "15 seconds", delay: str = "15 seconds", ts: str = "ts") -> DataFrame:
    """Spans of the traces to keep of a stream with a ``trace_id``: as ``operators.traces.tail_sample`` judges them.

    A trace is judged once no span has come for ``wait`` in event time and the watermark of ``delay`` has passed; spans
    behind the watermark are a trace of their own or dropped. ``bucket`` (0 to 99) is computed from ``trace_id`` alone.
    """
    drop = F.lit(False) if probe is None else probe
    forced = F.coalesce(F.col("forced"), F.lit(False)) if "forced" in spans.columns else F.lit(False)
    whole = F.struct(*(F.col(c) for c in spans.columns))
    judged = spans.select(ts, "trace_id", whole.alias("span"), ((F.col("status_code") == "ERROR") | (F.col("duration_ms") > slow_ms) | forced).alias("hit"), drop.alias("probe"))
    closed = judged.withWatermark(ts, delay).groupBy(F.session_window(ts, wait), "trace_id").agg(F.collect_list("span").alias("spans"), F.bool_or("hit").alias("hit"), F.bool_and("probe").alias("probe"))
    kept = closed.where(~F.col("probe") & (F.coalesce(F.col("hit"), F.lit(False)) | (bucket < percent)))
    return kept.select(F.explode("spans").alias("span")).select("span.*")


def tail_files(spark, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of the files in a folder as they arrive, with their file; the checkpoint remembers what was read."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
