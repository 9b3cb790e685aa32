"""Mining from snapshots and of streams, generators and cost scenarios against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import cost, mining
from driftlens.sources import logs, synthetic

SNAPSHOT = "service string, template_id long, template string, size long, used long"


def random_lines(seed, n=300):
    rng = random.Random(seed)
    words = ["start", "stop", "user", "disk", "full", "of", "by", "x", "y", "z"]
    return [(rng.choice("ab"), " ".join(rng.choices(words, k=rng.randint(0, 4))), k) for k in range(n)]


def plain(lines, options, miners=None):
    """Line by line, without counting: the miner of each service and the id of each line."""
    miners, ids = miners or {}, []
    for service, message, _ in lines:
        miner = miners.setdefault(service, mining.Miner(**options))
        ids.append(miner.add(message.split()))
    return miners, ids


@pytest.mark.parametrize("options", [{}, {"similarity": 0.8}])
def test_a_snapshot_goes_on_where_it_stopped(spark, options):
    """Two batches give the texts and sizes of the same distinct lines mined at once; nothing is lost or renumbered."""
    rows = random_lines(4)
    df = spark.createDataFrame(rows, "service string, message string, line_no long")
    one = mining.continue_mining(spark.createDataFrame([], SNAPSHOT), df.where("line_no < 150"), **options)
    two = mining.continue_mining(one, df.where("line_no >= 150"), **options)
    miners = {}
    for part in (rows[:150], rows[150:]):
        counts = {}
        for service, message, _ in part:
            counts[service, message] = counts.get((service, message), 0) + 1
        for (service, message), n in counts.items():
            miners.setdefault(service, mining.Miner(**options)).add(message.split(), n)
    want = {(s, k, t, n) for s, m in miners.items() for k, t, n, _ in m.snapshot()}
    assert {tuple(r)[:4] for r in two.collect()} == want and sum(n for *_, n in want) == 300
    old = {(r.service, r.template_id) for r in one.collect()}
    assert old <= {(s, k) for s, k, *_ in want}
    quiet = mining.continue_mining(two, df.where("false"), **options)
    assert sorted(map(tuple, quiet.collect())) == sorted(map(tuple, two.collect()))


def test_least_used_templates_go_first_after_a_restart(spark):
    known = spark.createDataFrame([("s", 7, "a a", 5, 2), ("s", 3, "b b", 9, 0), ("s", 5, "c c", 1, 1)], SNAPSHOT)
    lines = spark.createDataFrame([("s", "b b", 0), ("s", "d d", 1)], "service string, message string, line_no long")
    got = mining.continue_mining(known, lines, clusters=3).collect()
    assert {(r.template_id, r.template, r.size) for r in got} == {(7, "a a", 5), (3, "b b", 10), (8, "d d", 1)}
    assert [r.template_id for r in sorted(got, key=lambda r: r.used)] == [7, 3, 8]
    m = mining.Miner()
    m.restore(4, ["a"], 1)
    assert m.hit(4, 2) and m.clusters[4][1] == 3 and not m.hit(9) and m.add(["b"]) == 5


def test_services_beyond_the_cap_share_one_miner(spark):
    """Ids of folded services collide: theirs are given anew or merged, sizes stay whole."""
    known = spark.createDataFrame([("a", 1, "x <*>", 2, 0), ("b", 1, "y one", 3, 0), ("c", 1, "y one", 4, 0), ("c", 2, "w", 5, 1), ("_other", 1, "q q", 6, 0)], SNAPSHOT)
    folded = mining.fold_services(known, 1)
    got = mining.continue_mining(folded, spark.createDataFrame([], "service string, message string, line_no long")).collect()
    by = {(r.service, r.template): (r.template_id, r.size) for r in got}
    assert by["a", "x <*>"] == (1, 2) and by["_other", "y one"][1] == 7 and by["_other", "w"][1] == 5 and by["_other", "q q"][1] == 6
    assert len({k for (s, _), (k, _) in by.items() if s == "_other"}) == 3


def test_lines_are_other_until_the_warm_up_ends(spark):
    rows = [(s, m, k) for s, m, k in random_lines(9) if m]
    df = spark.createDataFrame(rows, "service string, message string, line_no long")
    options = {"similarity": 1.0}
    assigned = mining.assign_templates(spark.createDataFrame([], SNAPSHOT), df, **options)
    got = {r.line_no: r.template_id for r in mining.annotate(assigned, df, warm_up=8).collect()}
    miners, want = {}, {}
    for service, message, k in rows:
        miner = miners.setdefault(service, mining.Miner(**options))
        found = miner.add(message.split())
        want[k] = str(found) if miner.next - 1 >= 8 else "other"
    assert got == want and "other" in got.values()
    _, ids = plain(rows, options)
    first = {}
    for (service, _, k), found in zip(rows, ids, strict=True):
        first.setdefault((service, found), k)
    novel = {(r.service, r.template_id): r.first for r in mining.novel_templates(assigned, 40).collect()}
    assert novel == {k: v for k, v in first.items() if v >= 40} and novel


def test_a_stream_of_lines_is_mined(spark, tmp_path):
    from driftlens.streaming import jobs

    for part in range(3):
        rows = [("s", f"order {k} placed by {name}") for k, name in enumerate(("ann", "bob")[: part + 1])] + [("t", "ready"), (None, None)]
        spark.createDataFrame(rows, "service string, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("service string, message string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = jobs.mine_stream(src).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect()))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = {(s, k): (t, n) for _, s, k, t, n in sorted(seen)}
    assert last == {("s", 1): ("order <NUM> placed by <*>", 5), ("t", 1): ("ready", 3), ("unknown", 1): ("", 3)}


def test_generated_lines(spark):
    df = synthetic.log_lines(spark, 20_000, drop=("search", 0.5))
    got = {(r.service, r.template): (r.n, r.levels) for r in df.groupBy("service", text.mask_line(F.col("message")).alias("template")).agg(F.count("*").alias("n"), F.collect_set("level").alias("levels")).collect()}
    assert len(got) == 26 and sum(n for n, _ in got.values()) == 20_000
    burst = [(n, v) for (s, t), (n, v) in got.items() if t.startswith("ERROR db pool")]
    assert len(burst) == 1 and 240 < burst[0][0] < 360 and burst[0][1] == ["error"]
    assert df.where("service = 'search' and line_no >= 10000").count() == 0 and df.where("service = 'search'").count() > 1700
    other = synthetic.log_lines(spark, 20_000, drop=("search", 0.5)).repartition(7)
    assert other.exceptAll(df).count() == 0
    assert synthetic.log_lines(spark, 0).count() == 0


@pytest.mark.parametrize("app", ["json", "text"])
@pytest.mark.parametrize("container", [None, "cri", "docker"])
def test_written_lines_are_read_back(spark, app, container):
    df = synthetic.log_lines(spark, 500)
    raw = synthetic.written(df, app, container)
    if container:
        raw = raw.select("line_no", logs.unwrap(F.col("text")).alias("u")).select("line_no", F.col("u.text").alias("text"), "u.partial")
        assert raw.where("partial").count() == 0
    want = {r.line_no: (r.service, r.level, r.message) for r in df.collect()}
    if app == "json":
        assert {r.line_no: (r.service, r.level, r.message) for r in logs.extract(raw).collect()} == want
    else:
        got = {r.line_no: r.text.split(" ", 2) for r in raw.collect()}
        assert {k: (lv.lower(), m) for k, (_, lv, m) in got.items()} == {k: v[1:] for k, v in want.items()} and got[1][0] == "2026-09-14T00:00:00.001Z"


def test_generated_metrics(spark):
    def noise(key, minute):
        x = (synthetic.fnv(key) ^ minute) + synthetic.MIX[0] & 2**64 - 1
        x = (x ^ x >> 30) * synthetic.MIX[1] % 2**64
        x = (x ^ x >> 27) * synthetic.MIX[2] % 2**64
        return ((x ^ x >> 31) >> 11) / 2**53

    start = 1_789_344_000
    got = synthetic.metric_samples(spark, start + 7, start + 3 * 86400, 3600, ("auth", start + 86400, "drop")).collect()
    assert len(got) == 72 * 10
    for r in got:
        if r.type == "errors":
            want = 0.002 + 0.002 * noise(r.service + synthetic.METRICS["errors"], r.ts // 60)
        else:
            h = synthetic.fnv(r.service)
            want = (50 + h % 350) * (1 + 0.5 * math.sin(2 * math.pi * (r.ts % 86400) / 86400 + h % 24 / 24 * 2 * math.pi / 6)) * (1 + 0.06 * (noise(r.service + synthetic.METRICS["requests"], r.ts // 60) - 0.5))
            want *= 0.2 if r.service == "auth" and r.ts >= start + 86400 else 1
        assert r.value == pytest.approx(want, rel=1e-9)


def test_ways_of_charging(spark):
    row = spark.createDataFrame([(1500.0, 3000.0)], "gb double, n double")
    gb, n = F.col("gb"), F.col("n")
    tiers = [(1000, 0.5), (5000, 0.3)]
    got = row.select(cost.by_stage(gb, n, [tiers, tiers], [(1e9, 0.01)], 100, 2.0, 19.0).alias("s"), cost.by_event(gb, n, 0.1, 1.7, 500, 0.05, 10, 15.0, 100).alias("e"), cost.by_volume(gb, n, (tiers, tiers), (tiers, tiers), 2.0, 1.0, 1e6).alias("v")).first()
    assert got.s.logs == pytest.approx(1200) and got.s.metrics == pytest.approx(60) and got.s.total == pytest.approx(1279)
    assert got.e["index"] == pytest.approx(5100) and got.e.metrics == pytest.approx(100) and got.e.total == pytest.approx(150 + 5100 + 100 + 150)
    assert got.v.ingest == pytest.approx(1100) and got.v.retained == pytest.approx(1100) and got.v.metrics == pytest.approx(6)
