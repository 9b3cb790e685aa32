"""Operators against golden numbers, tables of cases and plain Python."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import alerts, cost, detect, findings, lifecycle, mining, promql, rules, series, traces
from driftlens.sources import logs


def noise(t: int) -> float:
    x = (t + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return ((x ^ x >> 31) >> 11) / 2**53


END = 1789000000 // 300 * 300


def golden(seconds: int, extra: float = 0.0):
    ts = range(END - seconds, END + 1, 300)
    v = [100 + 60 * math.sin(2 * math.pi * (t % 86400) / 86400) + (noise(t) - 0.5) * 10 for t in ts]
    v[-1] += extra
    return np.array([t // 300 for t in ts]), np.array(v)


@pytest.mark.parametrize(
    ("seconds", "extra", "expected", "score"),
    [(14 * 86400, 0, 105.3332183795194, 0.9951410131008771), (14 * 86400, 120, 105.3332183795194, 23.779976005540902), (12 * 3600, 0, 89.72403310813698, 0.9531572702400453)],
)
def test_golden_scores(spark, seconds, extra, expected, score):
    b, v = golden(seconds, extra)
    p = detect.Params(season=288, seasons=3, lookback=24)
    got = detect.score_series(b, v, p)[-1]
    scale = max(got[4], p.abs_floor, p.rel_floor * abs(got[3]))
    assert got[3] == pytest.approx(expected, abs=1e-9)
    assert (got[1] - got[3]) / scale == pytest.approx(score, abs=1e-9)
    df = spark.createDataFrame([("a", int(x), float(y)) for x, y in zip(b, v)], "key string, bucket long, value double")
    last = detect.score(df, ("key",), p).where(F.col("bucket") == int(b[-1])).first()
    assert last.expected == pytest.approx(expected, abs=1e-9) and last.score == pytest.approx(score, abs=1e-9)


def test_flat_and_zero_series():
    b, p = np.arange(401), detect.Params(season=100, seasons=2, lookback=10)
    got = detect.score_series(b, np.full(401, 7.0), p)[-1]
    assert got[3] == 7 and got[4] == 0 and max(got[4], 0.05 * 7) == pytest.approx(0.35)


def test_window_and_python_forms_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(b), float(rng.poisson(6)) if rng.random() > 0.1 else None) for k in "ab" for b in range(120)]
    df = spark.createDataFrame(rows, "key string, bucket long, value double")
    p = detect.Params(season=24, seasons=3, lookback=12, poisson=True)
    one = {(r.key, r.bucket): (round(r.score, 9), r.is_seasonal) for r in detect.score(df, ("key",), p).collect()}
    two = {(r.key, r.bucket): (round(r.score, 9), r.is_seasonal) for r in detect.score_in_python(df, ("key",), p).collect()}
    assert one == two and len(one) > 150


# Tokens and what masks make of them.
MASKED = {
    "took=1606ms": "took=<NUM>", "latency_ms=123": "latency_ms=<NUM>", "total=12.50": "total=<NUM>", "wh-12": "wh-<NUM>", "SKU-4821": "SKU-<NUM>",
    "/api/v1/cart/123": "/api/v1/cart/<NUM>", 'HTTP/1.1"': 'HTTP/<NUM>"', "10.1.22.254": "<IP>", "client=10.0.0.1:8080": "client=<IP>:<NUM>",
    "6ba7b810-9dad-11d1-80b4-00c04fd430c8": "<UUID>", "session=6ba7b810-9dad-11d1-80b4-00c04fd430c8,": "session=<UUID>,", "q_hash=00ff00ff00ff00ff": "q_hash=<HEX>",
    "0x1f": "<HEX>", "50%": "<NUM>", "12%abc": "<NUM>%abc", "5MB": "<NUM>", "user42": "user42", "(active=12": "(active=<NUM>", "idle=0)": "idle=<NUM>)",
    "mail=john.doe+x@example.co.uk;": "mail=<EMAIL>;", "@home": "@home", "plain": "plain",
    "a@x.org,b@y.org": "<EMAIL>,b@y.org", "0.5.1234.10.1.2.3": "<NUM>.<NUM>.<NUM>.<NUM>", "1.5abc": "1.5abc", "12abc": "12abc", "a@b.c.": "a@b.c.", "a@b@x.org-": "a@<EMAIL>-",
    "deadbeefcafe deadbeefcafe:1 12": "deadbeefcafe <HEX>:<NUM> <NUM>", "x@y.org/deadbeefcafe": "<EMAIL>/<HEX>", "user42 10.1.2.3:80 é7 7é": "user42 <IP>:<NUM> é<NUM> <NUM>é",
}


def test_masks(spark):
    rows = spark.createDataFrame(list(MASKED.items()), "a string, b string").select("a", "b", text.mask_line(F.col("a")).alias("m")).collect()
    assert {r.a: r.m for r in rows} == MASKED
    got = spark.createDataFrame([("  GET /x  200\t12ms ",)], "a string").select(text.tokenize(F.col("a")).alias("t")).first().t
    assert got == ["GET", "/x", "<NUM>", "<NUM>"]


def scanned(token):
    """One token masked character by character, by the definition."""
    alnum = lambda c: c.isascii() and c.isalnum()
    units = ("ns", "us", "ms", "s", "KB", "MB", "GB", "B", "%")
    end = lambda k: k >= len(token) or not alnum(token[k])
    run = lambda k, ok: next((j for j in range(k, len(token)) if not ok(token[j])), len(token)) - k
    hexa, digit = lambda c: c in "0123456789abcdefABCDEF", lambda c: c in "0123456789"

    def match(k):
        m = re.match(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", token[k:])
        if m and end(k + 36):
            return 36, "<UUID>"
        p = k
        for g in range(4):
            n = min(3, run(p, digit))
            if not n or g < 3 and token[p + n : p + n + 1] != ".":
                break
            p += n + (g < 3)
        else:
            if end(p):
                return p - k, "<IP>"
        if token[k : k + 2].lower() == "0x" and (n := run(k + 2, hexa)) and end(k + 2 + n):
            return n + 2, "<HEX>"
        if (n := run(k, hexa)) >= 12 and end(k + n):
            return n, "<HEX>"
        p = k + run(k, digit)
        if p == k:
            return 0, ""
        if token[p : p + 1] == "." and run(p + 1, digit):
            p += 1 + run(p + 1, digit)
        for u in units:
            if token.startswith(u, p) and end(p + len(u)):
                return p + len(u) - k, "<NUM>"
        return (p - k, "<NUM>") if end(p) else (0, "")

    out, k = "", 0
    while k < len(token):
        n, mask = match(k) if alnum(token[k]) else (1, token[k])
        if not n:
            n = run(k, alnum)
            mask = token[k : k + n]
        out, k = out + mask, k + n
    return out


def test_masks_against_a_plain_scanner(spark):
    rng = random.Random(3)
    parts = ["1", "12", "256", "0x", "ff", "deadbeef", "-", ".", ".", "%", "ms", "s", "KB", "z", "_", "/", "=", ":", "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "00ff00ff00ff", "10.0.0.1", "é", "\x01", "\x05", "\ufdd4"]
    tokens = sorted({"".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3000)})
    rows = spark.createDataFrame([(t,) for t in tokens], "a string").select("a", text.mask_line(F.col("a")).alias("m")).collect()
    digits = lambda t: any(c in "0123456789" for c in t)
    assert {r.a: r.m for r in rows} == {t: scanned(t) if digits(t) else t for t in tokens}


def test_line_and_signed_masks(spark):
    cases = {"12abc 3rd": "12abc 3rd", "x=-5 y": "x=-<NUM> y", "50% of": "<NUM>% of", "took 12.5ms": "took <NUM>", '2024-01-02T03:04:05.6Z "a b"': "<TS> <STR>", '"' + "x" * 201 + '"': '"' + "x" * 201 + '"', "0xff 1.2.3.4": "<HEX> <IP>"}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", text.template_text(F.col("a")).alias("m")).collect()
    assert {r.a: r.m for r in rows} == cases
    signed = {"x=-5 y": "x=<NUM> y", "took +12.5ms a7": "took +<NUM> a7", "1-2": "<NUM><NUM>"}
    rows = spark.createDataFrame([(k,) for k in signed], "a string").select("a", text.signed_mask(F.col("a")).alias("m")).collect()
    for r in rows:
        want = r.a
        for p, m in text.SIGNED_MASKS:
            want = re.sub(p, m, want)
        assert r.m == want and (r.a not in ("x=-5 y",) or r.m == signed[r.a])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ_-./", min_size=1, max_size=8), max_size=6))
def test_lines_without_digits_stay(spark, words):
    got = spark.createDataFrame([(" ".join(words),)], "a string").select(text.tokenize(F.col("a")).alias("t")).first().t
    assert got == words


# Messages and the level that their first words name.
DETECTED = {
    "ERROR db pool exhausted": "error", "[WARN] slow": "warn", "level=info msg=x": "info", 'level="debug" x': "debug", "User 1 logged in": "", "Upstream returned 503 ERROR": "error",
    "[ERROR] disk": "error", "ts=1 err x": "", "a b c d e f error": "", "a=b=error": "", "level='error'": "",
}
# Templates and the level that their words tell.
INFERRED = {
    "error": ["panic: runtime error: invalid memory address or nil pointer dereference", "thread <*> panicked at src/main.rs:<NUM>:<NUM>:", "fatal error: all goroutines are asleep - deadlock!", "Exception in thread <*> java.lang.OutOfMemoryError: Java heap space", "worker <NUM> exited: java.lang.StackOverflowError", "Out of memory: Killed process <NUM> (java)", "out-of-memory while compacting", "container app reason=OOMKilled exit=<NUM>", "Traceback (most recent call last):", "worker <NUM> got SIGSEGV", "Segmentation fault (core dumped)", "ERROR: deadlock detected", "<NUM>-<NUM>-<NUM> <NUM>:<NUM>:<NUM> [main] [pool-<NUM>] com.acme.Billing ERROR charge failed", "write /data/<*>: no space left on device", "MemoryError", "Unhandled exception, shutting down", "java.io.IOException: Too many open files"],
    "warn": ["java.lang.NullPointerException: null", "KeyError: <*>", "Caused by: java.io.IOException: stream closed", "dial tcp <IP>:<NUM>: connect: connection refused", "read: Connection reset by peer", "Error: connect ECONNREFUSED <IP>:<NUM>", "WARNING: An illegal reflective access operation has occurred"],
    "": ["Payment authorized order=<NUM> provider=stripe latency_ms=<NUM>", "batch done errors=<NUM> retries=<NUM>", "no error", "stats error_count=<NUM> panic_count=<NUM>", "Error rate <NUM>% over the last minute", "health fatal=<NUM> warn=<NUM>", "non-fatal error while flushing, retrying", '<IP> - - "GET /api/v1/panic HTTP/1.1" <NUM> <NUM>', "Registered ErrorHandler and ExceptionMapper", "handleError called for <*>", "connection <*> refused", "Mirror sync done in <NUM>", "<*> <*> <NUM>", "oom_score_adj=<NUM> set for <*>", ""],
}


def test_levels(spark):
    df = spark.createDataFrame([(k,) for k in DETECTED], "m string").select("m", text.detect_level(F.col("m")).alias("l"))
    assert {r.m: r.l for r in df.collect()} == DETECTED
    names = {"FATAL": "error", "W": "warn", "notice": "info", "averyverylongword": "", "emergency": "error", "EMERGENCY": "error", "information": "info", "Informational": "info", "warning": "warn", "not-a-level-at-all": ""}
    df = spark.createDataFrame([(k,) for k in names], "l string").select("l", text.normalize_level(F.col("l")).alias("n"))
    assert {r.l: r.n for r in df.collect()} == names
    leading = {"2024-01-02T03:04:05Z [WARN] x": "warn", "ERROR: y": "error", "Info z": "info", "errors z": "", "x ERROR": "", "2024-01-02 03:04:05,123 Debug z": "debug"}
    df = spark.createDataFrame([(k,) for k in leading], "l string").select("l", text.leading_level(F.col("l")).alias("n"))
    assert {r.l: r.n for r in df.collect()} == leading


def test_inferred_levels(spark):
    rows = [(t, level) for level, ts in INFERRED.items() for t in ts]
    df = spark.createDataFrame(rows, "t string, want string").select("t", "want", text.infer_level(F.col("t")).alias("got"))
    assert [(r.t, r.got, r.want) for r in df.where("got <> want").collect()] == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_text_of_findings(spark):
    numbers = {0.0: "0", 1.0: "1", 12.34567: "12.346", 1234.5678: "1234.57", 123456.7: "123457", 1234567.0: "1.23457e+06", -0.5: "-0.5", 100000.0: "100000", 0.0004: "0"}
    df = spark.createDataFrame([(k,) for k in numbers], "x double").select("x", text.short_number(F.col("x")).alias("s"))
    assert {r.x: r.s for r in df.collect()} == numbers
    row = spark.createDataFrame([({"__name__": "m", "b": 'x"y', "a": "1"}, " svc ", "é" * 80)], "l map<string,string>, s string, w string")
    got = row.select(text.readable_id(F.col("l")).alias("i"), text.series_key(F.col("l")).alias("k"), text.clean_service(F.col("s")).alias("s"), text.clean_service(F.col("w")).alias("w"), text.clean_service(F.lit(" ")).alias("e"), text.service_or_container(F.lit(None).cast("string"), F.col("s")).alias("c")).first()
    assert got.i == 'm{a="1",b="x\\"y"}' and got.s == "svc" and got.w == "é" * 64 and got.e == "unknown" and got.c == " svc " and '"a"' in got.k
    sev = spark.createDataFrame([("error", "", "up"), ("info", "", "down"), ("unknown", "error", "up"), ("debug", "error", "up"), ("warn", "", "down")], "l string, g string, d string")
    got = sev.select(text.severity(F.col("l"), F.col("d")).alias("a"), text.template_severity(F.col("l"), F.col("g"), F.col("d")).alias("b"), text.volume_severity(F.col("l"), F.col("d")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("warning",) * 3, ("info", "info", "warning"), ("info", "warning", "info"), ("info", "info", "info"), ("info", "info", "info")]


# JSON lines with (message, service, level).
JSON_LINES = {
    '{"@timestamp":"2026-09-14T00:00:00Z","service":{"name":"checkout"},"message":"Order 1 created","log":{"level":"INFO"}}': ("Order 1 created", "checkout", "INFO"),
    '{"service.name":"auth","log.level":"error","message":"a \\"quoted\\" é \\/ word","x":[1,{"y":"}"}],"n":-1.5e3}': ('a "quoted" é / word', "auth", "error"),
    ' { "message" : "spaced" , "service" : { "other" : {"deep":[1,2]}, "name" : "gw" } } ': ("spaced", "gw", None),
    '{"message":42,"service":{"name":null}}': ("42", "null", None),
    '{"message":"a","message":"b","service.name":"x","service":{"name":"y"}}': ("b", "y", None),
    '{"service":{"name":"y"},"service.name":"x","message":null}': ("null", "x", None),
    "not json": ("not json", "unknown", None), '{"message":"unterminated': ('{"message":"unterminated', "unknown", None), "[1,2]": ("[1,2]", "unknown", None), "": ("", "unknown", None),
}


def test_json_lines(spark):
    got = logs.extract(spark.createDataFrame([(k,) for k in JSON_LINES], "text string")).collect()
    assert {r.text: (r.message, r.service, r.level) for r in got} == JSON_LINES


def test_a_nodes_children():
    def children(limit, lines, depth=4):
        m = mining.Miner(children=limit, depth=depth)
        for line in lines:
            m.add(line.split())
        return set(m.root[2]) - {""}

    assert children(3, ["1 x", "a y", "b z"]) == {"<*>", "a", "b"} and children(3, ["a y", "b z", "c x", "d w"]) == {"a", "b", "<*>"}
    m = mining.Miner(depth=5, children=4)
    for k in range(10):
        m.add(["op", chr(97 + k), "done"])
    assert len(m.clusters) <= 10 and len(m.root[3]["op"]) <= 4
    one = mining.Miner(depth=6)
    one.add(["a"])
    assert one.root[1] == {"": [1]}  # a prefix is shorter than the line


def test_envelopes(spark):
    cases = [
        ("2024-01-01T00:00:00Z stdout F hello", ("hello", False, False)),
        ("2024-01-01T00:00:00Z stderr P part", ("part", True, True)),
        ("2024-01-01T00:00:00Z stdout F", ("", False, False)),
        ("stdout F x", ("stdout F x", False, False)),
        ('{"log":"abc\\n","stream":"stderr"}', ("abc", True, False)),
        ('{"log":"abc","stream":"stdout"}', ("abc", False, True)),
        ('{"log":"abc","stream":"other"}', ('{"log":"abc","stream":"other"}', False, False)),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "l string").select(logs.unwrap(F.col("l")).alias("u")).collect()
    assert [tuple(r.u) for r in rows] == [w for _, w in cases]


def test_fields_and_pushes(spark):
    df = spark.createDataFrame([('{"service.name":"a","message":"m","log":{"level":"warn"}}',), ('{"x":1}',), ("plain",)], "text string")
    assert [(r.message, r.service, r.level) for r in logs.extract(df).collect()] == [("m", "a", "warn"), ("", "unknown", None), ("plain", "unknown", None)]
    raw = spark.createDataFrame([('{"agent":"a","step":60,"items":[{"service":"s","template":"t <NUM>","counts":[[60,2],[120,0],[99999,1]]},{"service":"s","template":"","counts":[[60,1]]}]}',), ('{"agent":"b","step":120,"items":[]}',)], "v string")
    pushes = raw.select(F.from_json("v", logs.PUSH).alias("p")).select("p.*")
    assert [(r.ts, r.n) for r in logs.pushed_counts(pushes, 60, 1000).collect()] == [(60, 2)]
    back = logs.push_items(spark.createDataFrame([("s", "t", "", 120, 1), ("s", "t", "", 60, 2), ("s", "t", "", 60, 3)], "service string, template string, level string, bucket long, n long")).first()
    assert back.counts == [[60, 5], [120, 1]]


def test_debounce():
    m = lifecycle.Debounce(2)
    assert [m.step(x) for x in (True, None, True, True, True, False, None, False)] == [None, None, None, "fire", "update", None, None, "resolve"]
    m = lifecycle.Debounce(1)
    assert [m.step(x) for x in (True, None, None, None)] == ["fire", None, None, "resolve"]


def test_throttle_and_signatures(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 10, 25, 30, 50)], "key string, ts long")
    assert sorted(r.ts for r in lifecycle.throttle(df, ("key",), "ts", 25).collect()) == [0, 25, 50]
    with pytest.raises(ValueError, match="line 2: duplicate"):
        lifecycle.parse_signatures("a: x\na: y")


def test_miner_groups_and_merges():
    m = mining.Miner()
    a = m.add("order <NUM> placed by alice".split())
    assert m.add("order <NUM> placed by bob".split()) == a and m.clusters[a][0] == "order <NUM> placed by <*>".split()
    assert m.add("order <NUM> placed".split()) != a and m.add([]) == m.add([])
    small = mining.Miner(clusters=3)
    ids = [small.add([w, w]) for w in ("a", "b", "c", "d", "e")]
    assert len(small.clusters) == 3 and small.add(["a", "a"]) == 6 and ids == [1, 2, 3, 4, 5]


def test_two_phase_mining_counts_all_lines(spark):
    df = spark.createDataFrame([("s", f"user {k % 9} logged in from 10.0.0.{k}", k) for k in range(60)], "service string, message string, line_no long")
    assert mining.mine_templates(df).agg(F.sum("size")).first()[0] == 60
    assert mining.mine_two_phase(df, salts=3).agg(F.sum("size")).first()[0] == 60


def test_rate_is_extrapolated(spark):
    df = spark.createDataFrame([("t", 60 * k, 80.0 * k) for k in range(61)], "key string, ts long, value double")
    got = {r.ts: r.rate for r in promql.rate(df, ("key",), 300).collect()}
    assert got[3600] == pytest.approx(1.3333, abs=1e-4)
    plain = {r.ts: r.rate for r in promql.rate(df, ("key",), 300, extrapolate=False).collect()}
    assert plain[3600] == pytest.approx(1.0667, abs=1e-4)


def test_burn_rate_goldens(spark):
    df = spark.createDataFrame([("checkout", 60 * k, 3, 100) for k in range(121)], "key string, ts long, errors long, total long")
    last = rules.burn_rate(df, ("key",)).orderBy(F.desc("ts")).first()
    assert last.r5m == pytest.approx(0.03) and last.fast and last.slow
    quiet = spark.createDataFrame([("search", 60 * k, 1, 2000) for k in range(121)], "key string, ts long, errors long, total long")
    assert not rules.burn_rate(quiet, ("key",)).where("fast or slow").count()


def test_routes_inhibition_cost_and_sampling(spark):
    a = spark.createDataFrame([("1", {"service": "x", "severity": "critical"}), ("2", {"service": "x", "severity": "info"}), ("3", {"service": "y", "severity": "info"})], "id string, labels map<string,string>")
    got = alerts.route(a, [alerts.Route("p", (("severity", "=", "critical"),), True), alerts.Route("t", (("severity", "=~", "crit.*"),))], "d")
    assert sorted((r.id, r.receiver) for r in got.collect()) == [("1", "p"), ("1", "t"), ("2", "d"), ("3", "d")]
    left = alerts.inhibit(a, [("severity", "=", "critical")], [("severity", "=", "info")], ("service",))
    assert sorted(r.id for r in left.collect()) == ["1", "3"]
    q = spark.createDataFrame([(1500.0,)], "quantity double")
    assert cost.graduated(q, [(1000, 0.5), (5000, 0.3)], 100).first().cost == pytest.approx(500 + 150 - 50)
    s = spark.createDataFrame([(1, "ERROR", 1.0), (2, "OK", 5.0), (3, "OK", 5000.0)], "trace_id long, status_code string, duration_ms double")
    assert sorted(r.trace_id for r in traces.tail_sample(s, 0, F.lit(1)).collect()) == [1, 3]


def test_late_means(spark):
    df = spark.createDataFrame([("a", 1, 0, 10.0), ("a", 2, 0, 20.0), ("a", 3, 300 * 20, 1.0), ("a", 4, 0, 99.0), ("a", 5, 300, 7.0)], "key string, at long, s long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    assert {r.bucket: r.value for r in series.late_mean(df, ("key",), 300, "at").collect()} == {0: 15.0, 20: 1.0, 1: 7.0}


def test_streams(spark, tmp_path):
    from driftlens.streaming import jobs

    rows = [("a", b, 5.0, b in (3, 4, 5)) for b in range(8)]
    spark.createDataFrame(rows, "key string, bucket long, score double, anomalous boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, bucket long, score double, anomalous boolean").parquet(str(tmp_path / "in"))
    query = jobs.debounce_stream(src).writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.bucket, r.event) for r in spark.table("events").orderBy("bucket").collect()] == [(4, "fire"), (5, "update"), (7, "resolve")]


def test_sql_functions(spark):
    from driftlens.functions import sql

    assert "mask_line" in sql.register(spark)
    spark.createDataFrame([("[ERROR] a@x.org took 12ms 'x\\d' from 10.0.0.1",), ("panic: y",), (None,)], "m string").createOrReplaceTempView("lines")
    got = spark.sql("select m, mask_line(m) as k, infer_level(m) as i, detect_level(m) as d, template_text(m) as t from lines")
    want = spark.table("lines").select("m", text.mask_line(F.col("m")).alias("k"), text.infer_level(F.col("m")).alias("i"), text.detect_level(F.col("m")).alias("d"), text.template_text(F.col("m")).alias("t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_evaluation_from_series_to_findings(spark):
    """Three services, one of which is three times as busy in the last hours; a drop of errors is no finding."""
    rows = []
    for k, name in enumerate(("auth", "checkout", "search")):
        for b in range(24 * 8):
            v = 100 * (k + 1) * (1 + 0.5 * math.sin(2 * math.pi * b / 24)) * (1 + 0.02 * math.sin(b / 7))
            rows.append((name, "requests", b, v * 3 if name == "checkout" and b >= 24 * 8 - 4 else v))
            rows.append((name, "errors", b, 0.0 if b >= 24 * 8 - 4 else 50.0 + b % 3))
    df = spark.createDataFrame(rows, "service string, type string, bucket long, value double")
    config = df.select("service", "type").distinct().withColumn("direction", findings.direction(F.col("type"), F.lit(None).cast("string"))).withColumn("min_volume", F.lit(0.0))
    events = findings.evaluate(df, ("service", "type"), config, detect.Params(season=24, seasons=3, lookback=24))
    got = findings.lifetimes(events, ("service", "type")).collect()
    assert [(r.service, r.type, r.state, r.starts_at) for r in got] == [("checkout", "requests", "firing", 24 * 8 - 3)]


def test_absent_findings(spark):
    """A gap of the whole feed neither counts nor breaks a run; idle series don't fire; what returns or expires ends."""
    rows = [(k, b, v) for k, v, last in (("auth", 50.0, 60), ("checkout", 100.0, 30), ("idle", 0.0, 30)) for b in range(60) if b < last and not 32 <= b < 40]
    df = spark.createDataFrame(rows, "key string, bucket long, value double")
    scores = df.select("key", "bucket", F.col("value").alias("expected"))
    got = [(r.key, r.since, r.fired_at, r.ends_at) for r in findings.absent_findings(df, scores, ("key",), 3, ttl=20).collect()]
    assert got == [("checkout", 30, 40, 50)]
    back = df.unionByName(spark.createDataFrame([("checkout", 45, 99.0)], df.schema))
    got = sorted((r.key, r.since, r.ends_at) for r in findings.absent_findings(back, back.select("key", "bucket", F.col("value").alias("expected")), ("key",), 3, ttl=20).collect())
    assert got == [("checkout", 30, 45), ("checkout", 46, 66)]


def test_small_parts_of_findings(spark):
    one = spark.createDataFrame([("s,t,u", {"a": "1", "tier": "9"}, 3)], "k string, labels map<string,string>, n int")
    got = one.select(findings.split_key(F.col("k")).alias("p"), findings.with_labels(F.col("labels"), {"tier": "1"}).alias("l"), findings.abs_floor(F.lit("errors"), {"errors": 0.5}).alias("f"), findings.abs_floor(F.lit("x"), {}).alias("g")).first()
    assert tuple(got.p) == ("s", "t,u") and got.l == {"a": "1", "tier": "1"} and (got.f, got.g) == (0.5, 1e-9)
    found = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.1)], "service string, template_id int, score double")
    templates = spark.createDataFrame([("s", 1, "t <*>", "info", "")], "service string, template_id int, template string, level string, inferred_level string")
    assert {r.template_id: r.template for r in findings.with_template(found, templates).collect()} == {1: "t <*>", 2: None}
    assert [r.score for r in findings.capped_series(found, ("service",), F.col("score"), 1).collect()] == [0.1]
    both = findings.unite(found.select("service", "score"), found.select("service", "template_id")).collect()
    assert len(both) == 4 and sum(r.is_log for r in both) == 2
    spans = findings.routed(spark.range(100).select((F.col("id") % 7).alias("trace_id")), 4).withColumn("p", F.spark_partition_id())
    assert spans.groupBy("trace_id").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    samples = spark.createDataFrame([(100,), (205,)], "ts_s long")
    assert findings.open_bucket(samples, 10, grace=6).first().open == 19
    lines = spark.createDataFrame([("s", f"distinct{chr(97 + k)} message kind", k) for k in range(5)], "service string, message string, line_no long")
    assert tuple(mining.churn(lines, clusters=3).first()) == ("s", 3, 5, 2)
    listed = findings.list_findings(spark.createDataFrame([("a", "firing", 1, None), ("b", "resolved", 5, 9), ("c", "resolved", 2, 3)], "id string, state string, starts_at long, ends_at long"), resolved=1)
    assert [r.id for r in listed.collect()] == ["b", "a"]


def test_functions_of_the_read_side(spark):
    """Parts that no query reaches."""
    labels = spark.createDataFrame([({"a": "x-1"},), ({"a": "y"},)], "l map<string,string>").select(promql.label_replace(F.col("l"), "b", "a", "x-(.*)").alias("l"))
    assert [r.l for r in labels.collect()] == [{"a": "x-1", "b": "1"}, {"a": "y"}]
    terms = spark.createDataFrame([(c,) for c in "aabbbc"], "k string")
    assert [(r.k, r.n) for r in rules.top_terms(terms, "k", 2).collect()] == [("b", 3), ("a", 2)]
    now = F.timestamp_seconds(F.lit(1000))
    samples = spark.createDataFrame([(1.0, 900), (float("nan"), 900), (float("inf"), 900), (2.0, 1301), (3.0, 1300)], "value double, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.value for r in series.clean_samples(samples, now).collect()) == [1.0, 3.0]
    path = spark.createDataFrame([("/var/log/pods/shop_x/app.log",), ("other",)], "p string").select(logs.service_of_path(F.col("p"), "/pods/([^_]+)_").alias("s"))
    assert [r.s for r in path.collect()] == ["shop", "unknown"]
    events = spark.createDataFrame([("svc", "error", "fire", 3, 5.0), ("svc", "error", "resolve", 7, 0.5)], "service string, level string, event string, bucket long, score double")
    found = {r.bucket: (r.state, r.labels["severity"], r.labels["direction"]) for r in lifecycle.findings(events, "volume").collect()}
    assert found == {3: ("firing", "warning", "up"), 7: ("resolved", "warning", "up")}
    state = lifecycle.current_state(events, ("service",)).first()
    assert (state.event, state.bucket, state.first_fire) == ("resolve", 7, 3)
