"""Every registered query of the library's own operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from driftlens.operators import findings, series
from driftlens.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got.columns) and len(got) > 0


TIES = [(9, 0.3, "'view'"), (10, 0.2, "'view'"), (11, 0.1, "'view'"), (12, 5, "'view'"), (31, 2, "'click'"), (32, 2, "'click'")]
#: Rows without an id, a type or a time.
NULLS = [("null", 1, "'click'"), (31, 2, "'click'"), ("null", 8, "'error'"), (20, 3, "null"), (40, "null", "'signup'")]


@pytest.mark.parametrize("events", [TIES, NULLS], ids=["ties", "nulls"])
def test_evaluated_on_grid(spark, tmp_path, events):
    """Against the SQL on events (id, seconds before an evaluation, type); the operator in any order of rows."""
    con, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    made = ", ".join(f"({i}::bigint, timestamp '2024-01-01 06:00:00' - interval 1 second * {s}, {k}::varchar)" for i, s, k in events)
    con.execute(f"copy (select * from (values {made}) as e(event_id, ts, event_type)) to '{path}'")
    con.execute(f"create view events as select * from '{path}'")
    want = sorted(map(repr, con.sql(ORACLES["evaluated_on_grid"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.queries()["evaluated_on_grid"](spark, str(tmp_path)).collect()) == want
    e = spark.read.parquet(path).select("event_type", series.bucket(F.col("ts"), 1).alias("ts"), "event_id")
    for samples in (e.orderBy("event_id").coalesce(1), e.orderBy(F.desc("event_id")).coalesce(1), e.repartition(7)):
        got = findings.evaluation_grid(samples, ("event_type",), 1_704_067_200, 1_704_110_400, 21_600, 7200, value="event_id")
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
