"""Sessions of a stream against their SQL: many rows for a small driver, folders of parts, odd times."""

import collections
import datetime
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT
from graphloom.plans import registry
from graphloom.streaming import watch
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SMALL_DRIVER = """
import sys
from pyspark.sql import SparkSession
from graphloom.plans import registry
home = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "1m").config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", home + "/shared")
    .config("spark.sql.warehouse.dir", home + "/warehouse").getOrCreate())
print("rows", registry.QUERIES["t5_stream_sessions"](spark, home).count())
"""


def at(minutes, micros=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes, microseconds=micros)


def test_more_sessions_than_the_driver_takes(tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 60000) DAY AS ts, i AS user_id, 'a' AS event_type, 1.0::DOUBLE AS value, '' AS props
        FROM range(60001) AS r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    run = subprocess.run([sys.executable, "-c", SMALL_DRIVER, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "rows 60000" in run.stdout, run.stderr[-2000:]


@pytest.mark.parametrize(
    "times",
    [
        [(at(0), 1), (at(30), 1), (at(60, -1), 1), (at(500), 2)],  # a pause as long as the gap, one shorter
        [(at(0, 100), 1), (at(0, 901), 3), (at(40, 900), 2)],  # closed or open within a millisecond
        [(datetime.datetime(1960, 1, 1), 1), (datetime.datetime(1960, 1, 1, 0, 20), 1), (at(0), None), (None, 1), (at(500), 2)],
        [],
    ],
)
def test_stream_sessions_of_a_folder(spark, tmp_path, times):
    rows = [(i, t, u, "a", 1.0, None) for i, (t, u) in enumerate(times)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = collections.Counter(con.execute(registry.ORACLES["t5_stream_sessions"]).fetchall())
    assert collections.Counter(map(tuple, registry.QUERIES["t5_stream_sessions"](spark, str(tmp_path)).collect())) == want
    assert bool(want) == bool(times)


def test_drain_modes(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(6).select((F.col("id") % 2).alias("k")).coalesce(1).write.parquet(str(source))
    for mode, want in (("complete", [(0, 6), (1, 6)]), ("update", [(0, 3), (0, 6), (1, 3), (1, 6)])):
        got = []
        for part in range(2):
            if not got:
                (tmp_path / mode).mkdir()
            for f in source.glob("part-*"):
                (tmp_path / mode / f"{part}{f.name[4:]}").write_bytes(f.read_bytes())
            stream = spark.readStream.schema("k long").parquet(str(tmp_path / mode)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
            got = sorted(map(tuple, watch.drain(stream, f"t_{mode}", str(tmp_path / f"cp_{mode}"), mode).collect()))
        assert got == want


@pytest.mark.parametrize("named", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_state_of_a_drained_stream(spark, tmp_path, named):
    key = next(iter(watch.STATE))
    spark.range(9).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if named:
        spark.conf.set(key, named)
    try:
        assert watch.drain(stream, f"state_{bool(named)}", str(tmp_path / "cp"), "complete").count() == 9
        assert spark.conf.get(key, None) == named
    finally:
        spark.conf.unset(key)
    assert (named or watch.STATE[key]) in (tmp_path / "cp/offsets/0").read_text()
    assert all(spark.conf.get(k, None) is None for k in watch.STATE)
