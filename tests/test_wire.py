"""Wire formats: hand-made bodies, round trips, broken input; sampled traces of a stream."""

import datetime as dt
import json
import math
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.sources import wire
from driftlens.streaming import jobs

#: One series a="b" with the sample 1.5 at 300 ms, written by hand.
MESSAGE = b"\x0a\x16" + b"\x0a\x06\x0a\x01a\x12\x01b" + b"\x12\x0c\x09" + struct.pack("<d", 1.5) + b"\x10\xac\x02"


def packed(message: bytes) -> bytes:
    return pa.compress(message, codec="snappy", asbytes=True)


def test_hand_made_body():
    assert wire.decode(packed(MESSAGE)) == [({"a": "b"}, 300, 1.5, False)]
    metadata = b"\x1a\x03abc" + b"\x28\x05" + b"\x35\x00\x00\x00\x00" + b"\x39" + bytes(8)
    assert wire.decode(packed(metadata + MESSAGE + metadata)) == wire.decode(packed(MESSAGE))
    assert wire.decode(packed(b"")) == []


def test_broken_bodies():
    for k in range(1, len(MESSAGE)):
        with pytest.raises(wire.WireError):
            wire.decode(packed(MESSAGE[:k]))
    for body in (None, b"", b"\xff", b"\x05abc", b"\xff\xff\xff\xff\x7f" + bytes(9), packed(b"\x0b\x00"), packed(b"\xff" * 11)):
        with pytest.raises(wire.WireError):
            wire.decode(body)
    with pytest.raises(wire.WireError, match="exceeds"):
        wire.decode(packed(bytes(100)), most=99)


labels = st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=8), st.text(st.characters(exclude_categories=["Cs"]), max_size=8), max_size=4)
sample = st.tuples(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.just(False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(labels, st.lists(sample, max_size=5)), max_size=5))
def test_round_trip(series):
    assert wire.decode(wire.encode(series)) == [(names, *one) for names, many in series for one in many]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_decode_or_fail(data):
    for body in (data, packed(data)):
        try:
            wire.decode(body)
        except wire.WireError:
            pass


def test_writes_in_spark(spark):
    rows = [({"__name__": "up", "job": "x"}, 1000 + k, float(k), k == 3) for k in range(7)] + [({"__name__": "nan"}, 5, math.nan, False), (None, 6, 1.0, None), ({"a": None}, 7, 2.0, False), ({"a": "b"}, None, 2.0, False)]
    table = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double, is_stale boolean").coalesce(1)
    bodies = wire.encode_writes(table, most=4)
    assert bodies.count() == 3
    got = wire.decode_writes(bodies.unionByName(spark.createDataFrame([(None,), (b"\x05abc",)], "body binary"))).collect()
    assert sum(r.error is not None for r in got) == 2
    good = {(tuple(sorted(r.labels.items())), r.ts): (r.value, r.is_stale) for r in got if r.error is None}
    assert len(good) == 10 and good[(("__name__", "up"), ("job", "x")), 1003][1] and good[(), 6] == (1.0, False) and good[(("a", ""),), 7][0] == 2.0
    assert not good[(("__name__", "nan"),), 5][1]
    marked = spark.createDataFrame([(math.nan, False), (math.nan, True), (1.0, False), (math.inf, None)], "value double, is_stale boolean")
    assert [r[0] for r in marked.select(wire.is_undefined(F.col("value"), F.col("is_stale"))).collect()] == [True, False, False, True]
    assert wire.decode_writes(bodies.limit(0)).count() == 0


def test_range_answers(spark):
    good = {"status": "success", "data": {"result": [{"metric": {"__name__": "up", "prometheus": "p"}, "values": [[10.7, "1.5"], [20, "NaN"], [30, "+Inf"], [40, "x"], [50, "2e3"]]}, {"metric": {}, "values": []}]}}
    answers = spark.createDataFrame([(json.dumps(good),), ('{"status":"error","error":"too long"}',), ("oops",), (None,)], "body string")
    assert [(r.labels, r.ts, r.value) for r in wire.range_samples(answers).orderBy("ts").collect()] == [({"__name__": "up"}, 10, 1.5), ({"__name__": "up"}, 50, 2000.0)]
    assert [(r.body, r.error) for r in wire.failed_answers(answers).where("body is not null").orderBy("body").collect()] == [("oops", "decode"), ('{"status":"error","error":"too long"}', "too long")]


def test_ranges_and_durations():
    assert wire.day_ranges(0, 200_000, 300) == [(0, 86_100), (86_400, 172_500), (172_800, 200_000)]
    assert [wire.seconds(x) for x in ("30s", "5m", "2h", "1d", "1w")] == [30, 300, 7200, 86400, 604800]
    for bad in ("", "5", "m", "5y", "-5m", "1.5h"):
        with pytest.raises(ValueError):
            wire.seconds(bad)


def test_sampled_traces_of_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "trace_id string, ts timestamp, status_code string, duration_ms double, name string"
    rows = [("bad", at(0), "OK", 1.0, "a"), ("bad", at(5), "ERROR", 1.0, "b"), ("slow", at(1), "OK", 5000.0, "a"), ("fine", at(2), "OK", 1.0, "a"), ("probe", at(3), "ERROR", 1.0, "/health")]
    for k, part in enumerate((rows, [("end", at(1000), "OK", 1.0, "z")], [("end2", at(2000), "OK", 1.0, "z")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = jobs.tail_sample_stream(stream, 0, F.lit(50), probe=F.col("name") == "/health")
    query = kept.writeStream.format("memory").queryName("sampled_traces").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.trace_id, r.name) for r in spark.table("sampled_traces").collect()) == [("bad", "a"), ("bad", "b"), ("slow", "a")]
