import glob
import os

import duckdb
import pytest

from meshq import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.execute(f"select {quoted} from ({queries.SQL[name]})").fetchall()
    key = lambda r: repr(tuple(r))
    got = sorted(map(key, df.select(*[f"`{c}`" for c in cols]).collect()))
    assert got == sorted(map(key, want)) and got


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_slots_of_events_that_changed(spark, tmp_path):
    """The same folder with other events: the index of those before isn't used again."""
    for copies in (1, 3):
        rows = f"select event_id + i * 1000000 as event_id, ts, user_id, event_type, value, props from '{DIR}/events.parquet', range({copies}) r(i)"
        duckdb.sql(f"copy ({rows}) to '{tmp_path}/events.parquet'")
        got = queries.QUERIES["sensor_slots"](spark, str(tmp_path))
        want = duckdb.sql(f"with events as (from '{tmp_path}/events.parquet') select {', '.join(got.columns)} from ({queries.SQL['sensor_slots']})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
