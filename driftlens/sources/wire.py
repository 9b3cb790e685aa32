"""Samples in the remote-write wire format and in range-query answers, decoded to and encoded from long tables.

A remote-write body is one Snappy block around a protobuf message ``WriteRequest``: field 1 is a series, in which
field 1 is a label (1 name, 2 value) and field 2 a sample (1 double value, 2 varint of milliseconds).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.series import drop_labels

# Fixed value: the bits of the NaN that marks a series as gone.
STALE = 0x7FF0000000000002
#: Largest body and largest decoded message.
MOST_BODY, MOST_DECODED = 32 << 20, 256 << 20

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
SAMPLES = "labels map<string,string>, ts long, value double, is_stale boolean"


class WireError(ValueError):
    """A body that is not a WriteRequest."""


def varint(data: memoryview | bytes, at: int) -> tuple[int, int]:
    """(value, place behind it) of a varint of at most 64 bits."""
    value = 0
    for k, byte in enumerate(data[at : at + 10]):
        value |= (byte & 127) << 7 * k
        if byte < 128:
            if value >> 64:
                raise WireError("varint of more than 64 bits")
            return value, at + k + 1
    raise WireError("truncated varint")


def fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(number, wire type, value) of a message's fields; fixed-width values come as their bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == VARINT:
            value, at = varint(data, at)
            yield number, kind, value
            continue
        if kind == BYTES:
            width, at = varint(data, at)
        elif kind in (FIXED64, FIXED32):
            width = 8 if kind == FIXED64 else 4
        else:
            raise WireError(f"unknown wire type {kind}")
        if width > end - at:
            raise WireError("truncated field")
        yield number, kind, data[at : at + width]
        at += width


def _label(data: memoryview) -> tuple[str, str]:
    got = {number: value for number, kind, value in fields(data) if kind == BYTES}
    return tuple(bytes(got.get(k, b"")).decode("utf-8", "replace") for k in (1, 2))


def _sample(data: memoryview) -> tuple[int, float, bool]:
    got = {(number, kind): value for number, kind, value in fields(data)}
    bits = bytes(got.get((1, FIXED64), bytes(8)))
    ts = got.get((2, VARINT), 0)
    return ts - (1 << 64) if ts >> 63 else ts, struct.unpack("<d", bits)[0], int.from_bytes(bits, "little") == STALE


def decode(body: bytes | None, most: int = MOST_DECODED) -> list[tuple[dict[str, str], int, float, bool]]:
    """The samples (labels, ts in ms, value, is_stale) of a body; of a label that is given twice the last counts.

    Exemplars, histograms and metadata are skipped. The size that the block claims is checked before memory is taken.
    """
    if not body or len(body) > MOST_BODY:
        raise WireError("empty body" if not body else "body too large")
    size, _ = varint(body, 0)
    if size > most:
        raise WireError(f"decoded size {size} exceeds {most}")
    try:
        message = memoryview(pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True)) if size else memoryview(b"")
    except (OSError, pa.ArrowException) as error:
        raise WireError(f"snappy: {error}") from None
    out = []
    for number, kind, series in fields(message):
        if (number, kind) != (1, BYTES):
            continue
        parts = [(n, value) for n, k, value in fields(series) if k == BYTES]
        labels = dict(sorted(_label(value) for n, value in parts if n == 1)) if parts else {}
        out += [(labels, *_sample(value)) for n, value in parts if n == 2]
    return out


def decode_writes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(labels, ts, value, is_stale, error) of a column of remote-write bodies; a body is taken whole or not at all.

    A null, empty, too large or broken body gives one row that holds nothing but its ``error``; a body without samples
    gives none.
    """
    schema = pa.schema([("labels", pa.map_(pa.string(), pa.string())), ("ts", pa.int64()), ("value", pa.float64()), ("is_stale", pa.bool_()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scalar in batch.column(0):
                try:
                    rows = [(list(labels.items()), *rest, None) for labels, *rest in decode(scalar.as_py())]
                except WireError as error:
                    rows = [(None, None, None, None, str(error))]
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return bodies.select(F.col(body).cast("binary").alias("body")).mapInArrow(work, f"{SAMPLES}, error string")


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _bytes(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | BYTES) + _varint(len(value)) + value


def encode(series: Iterable[tuple[dict[str, str], list[tuple[int, float, bool]]]]) -> bytes:
    """A body of series (labels, samples of (ts in ms, value, is_stale)); labels are written by name."""
    message = bytearray()
    for labels, samples in series:
        each = [_bytes(1, _bytes(1, name.encode()) + _bytes(2, value.encode())) for name, value in sorted(labels.items())]
        for ts, value, stale in samples:
            bits = STALE.to_bytes(8, "little") if stale else struct.pack("<d", value)
            each.append(_bytes(2, _varint(1 << 3 | FIXED64) + bits + _varint(2 << 3 | VARINT) + _varint(ts % (1 << 64))))
        message += _bytes(1, b"".join(each))
    return pa.compress(bytes(message), codec="snappy", asbytes=True)


def encode_writes(samples: DataFrame, most: int = 5_000) -> DataFrame:
    """Bodies of at most ``most`` samples each from (labels, ts in ms, value[, is_stale]).

    Every task encodes its own rows as they come, so there is no shuffle, and a series may be in several bodies; repartition
    by series before to have fewer. Null labels are an empty set; rows without ts or value (unless stale) are left out.
    """
    stale = F.coalesce(F.col("is_stale"), F.lit(False)) if "is_stale" in samples.columns else F.lit(False)
    rows = samples.select(F.map_entries("labels").alias("labels"), F.col("ts").cast("long"), F.col("value").cast("double"), stale.alias("is_stale"))
    rows = rows.where("ts is not null and (value is not null or is_stale)")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                series: dict[tuple, list] = {}
                for labels, *sample in zip(*(c.to_pylist() for c in batch.slice(at, most).columns), strict=True):
                    named = tuple((e["key"], e["value"] or "") for e in labels or ())
                    series.setdefault(named, []).append(tuple(sample))
                yield pa.RecordBatch.from_arrays([pa.array([encode((dict(k), v) for k, v in series.items())], pa.binary())], names=["body"])

    return rows.mapInArrow(work, "body binary")


ANSWER = "status string, error string, data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"


def range_samples(answers: DataFrame, body: str = "body", ignored: tuple[str, ...] = ("prometheus", "prometheus_replica")) -> DataFrame:
    """(labels, ts in seconds, value) of the JSON answers of range queries, without NaN, infinities and unreadable numbers.

    Answers whose status isn't ``success`` give nothing, nor do texts that are no JSON: ``failed_answers`` has them.
    """
    ok = answers.select(F.from_json(F.col(body), ANSWER).alias("a")).where("a.status = 'success'")
    each = ok.select(F.explode("a.data.result").alias("r")).select(drop_labels(F.col("r.metric"), ignored).alias("labels"), F.explode("r.values").alias("p"))
    read = each.select("labels", F.floor(F.col("p")[0].try_cast("double")).cast("long").alias("ts"), F.col("p")[1].try_cast("double").alias("value"))
    return read.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def failed_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Adds the error to the answers that did not succeed; ``decode`` where there is no status."""
    read = F.from_json(F.col(body), ANSWER)
    kept = answers.withColumn("error", F.when(read["status"].isNull(), F.lit("decode")).when(read["status"] != "success", F.coalesce(read["error"], F.lit(""))))
    return kept.where(F.col("error").isNotNull())


def day_ranges(start: int, end: int, step: int) -> list[tuple[int, int]]:
    """(from, to) of one query for each day, in seconds; both ends belong to a range."""
    return [(at, min(at + 86400 - step, end)) for at in range(start, end, 86400)]


def openmetrics(samples: DataFrame, metric: str = "metric", labels: str = "labels", value: str = "value", ts: str = "ts") -> DataFrame:
    """(metric, part, ts, line): a gauge's history with one TYPE line for each metric; sort by the first three to write.

    Labels are in order of name. A complete file ends with a line ``# EOF``, which its writer adds.
    """
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    line = F.concat(F.col(metric), F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col(value).cast("string"), F.lit(" "), F.col(ts).cast("string"))
    types = samples.select(F.col(metric).alias("metric")).distinct()
    types = types.select("metric", F.lit(0).alias("part"), F.lit(None).cast("long").alias("ts"), F.concat(F.lit("# TYPE "), "metric", F.lit(" gauge")).alias("line"))
    return types.unionByName(samples.select(F.col(metric).alias("metric"), F.lit(1).alias("part"), F.col(ts).cast("long").alias("ts"), line.alias("line")))


# Seconds of a unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str) -> int:
    """Seconds of a duration such as ``5m`` or ``1w``."""
    got = re.fullmatch(r"([0-9]+)([smhdw])", text.strip())
    if not got:
        raise ValueError(f"not a duration: {text!r}")
    return int(got[1]) * UNITS[got[2]]


def is_undefined(value: Column, is_stale: Column) -> Column:
    """Whether a series still sends, though nothing that can be scored: NaN or infinite, but not the stale marker."""
    return (F.isnan(value) | (F.abs(value) == float("inf"))) & ~F.coalesce(is_stale, F.lit(False))
