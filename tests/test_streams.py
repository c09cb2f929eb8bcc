import datetime as dt
import random
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curbline.streaming import repeats, streams, upsert


def test_sessions_and_resume(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 5, 11, 4000)] + [("b", t0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "v string, ts timestamp").coalesce(1).write.parquet(src)
    stream = streams.file_stream(spark, src, "v string, ts timestamp")
    streams.drain(streams.gap_sessions(stream, "v", "ts", "5 seconds", "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.v, r.first_ts): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", t0): 2, ("a", t0 + dt.timedelta(seconds=11)): 1, ("b", t0): 1}


def test_repeats_keep_state_between_runs(spark, tmp_path):
    """Rows of one group shuffled over files and small Arrow batches; what waits for the watermark comes with later runs."""
    t0, schema = dt.datetime(2024, 1, 1), "v string, n long, ts timestamp, x double"
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i, t0 + dt.timedelta(seconds=i // 2), rng.random()) for i in range(240)]
    src, out, cp = (str(tmp_path / k) for k in ("in", "out", "cp"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    repeats.use_rocksdb(spark)
    try:
        for part in (rows[:130], rows[130:]):
            shuffled = rng.sample(part, len(part))
            spark.createDataFrame(shuffled, schema).coalesce(1).write.mode("append").parquet(src)
            streams.drain(repeats.suppress_repeats(streams.file_stream(spark, src, schema), "v", "ts", "x", 0.4, "n", "10 seconds"), out, cp)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want, last = [], {}
    for v, n, ts, x in rows:
        if abs(x - last.get(v, 9.0)) >= 0.4:
            last[v] = x
            want += [n] if ts < rows[-1][2] - dt.timedelta(seconds=10) else []
    assert sorted(r.n for r in spark.read.schema(schema).parquet(out).collect()) == want and len(want) > 40


REPEATS = "v string, n long, ts timestamp, x double"


@contextmanager
def _repeats(spark, path, late, zone="UTC"):
    """A function that adds rows to a stream, drains it in small Arrow batches and gives the n of all rows kept so far."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.sql.session.timeZone": zone, "spark.sql.streaming.stateStore.providerClass": None}
    kept = {k: spark.conf.get(k) for k in new}

    def drain(rows):
        spark.createDataFrame(rows, "v string, n long, s long, x double").selectExpr("v", "n", "timestamp_seconds(s) AS ts", "x").coalesce(1).write.mode("append").parquet(f"{path}/in")
        streams.drain(repeats.suppress_repeats(streams.file_stream(spark, f"{path}/in", REPEATS), "v", "ts", "x", 0.4, "n", late), f"{path}/out", f"{path}/cp")
        return sorted(r.n for r in spark.read.schema(REPEATS).parquet(f"{path}/out").collect())

    repeats.use_rocksdb(spark)
    for k, v in new.items():
        if v:
            spark.conf.set(k, v)
    try:
        yield drain
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_repeats_wait_in_blocks(spark, tmp_path):
    """State holds a value for many rows, though Arrow batches are of 50; all come out of it, but those that come after their group has been walked past them."""
    rng = random.Random(7)
    rows = [("ab"[i % 3 // 2], i, i, rng.random()) for i in range(3000)]
    with _repeats(spark, tmp_path, "1 day") as drain:
        assert drain(rng.sample(rows, 3000)) == []
        assert 2 <= spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/cp").count() < 60
        want, last = [], {}
        for v, n, _, x in rows:
            if abs(x - last.get(v, 9.0)) >= 0.4:
                last[v] = x
                want.append(n)
        assert drain([("a", 5000, 200_000, 5.0)]) == want and len(want) > 900
        assert drain([("a", 6000, 100, 9.0), ("b", 6001, 200_001, 9.0), ("a", 6002, 400_000, 1.0)]) == [*want, 5000, 6001]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_repeats_follow_instants_in_every_zone(spark, tmp_path, zone):
    with _repeats(spark, tmp_path, "10 seconds", zone) as drain:
        assert drain([("a", i, 1_700_000_000 + i, float(i)) for i in range(100)]) == list(range(89))


def test_repeats_are_packed_by_group():
    t = pa.table({"v": ["b", None, "a", None, "b"], "ts": pa.array([5, 4, 3, 2, 1], pa.timestamp("us", "UTC")), "x": [0.0, 1.0, 2.0, 3.0, 4.0]})
    got = repeats._packed(t, "v", "ts", "x")
    assert sorted(zip(got["key"].to_pylist(), got["first"].to_pylist()), key=str) == sorted([("b", 1), (None, 2), ("a", 3)], key=str)
    assert sorted(repeats._rows(got["block"].to_pylist(), t.schema)["x"].to_pylist()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    for bad in ([0.0, None, 2.0, 3.0, 4.0], [0.0, float("nan"), 2.0, 3.0, 4.0]):
        with pytest.raises(ValueError):
            repeats._packed(t.set_column(2, "x", pa.array(bad, pa.float64())), "v", "ts", "x")


def test_keyed_table(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL("k string, n int, x string"), "k", 3)
    assert table.read().count() == 0
    batches = [[("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], [], [("b", 0, "late"), ("c", 5, "c"), (None, 1, "n")], [("a", 2, "same order, newer")]]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, table.schema)
        assert table.merge(df, number, "n") and not table.merge(df, number, "n")
    want = [("a", 2, "same order, newer"), ("b", 1, "y"), ("c", 5, "c"), (None, 1, "n")]
    assert sorted((tuple(r) for r in table.read().collect()), key=str) == sorted(want, key=str)
    # a batch that failed before its manifest has changed nothing, and may be run again
    table._commit, commit = (lambda *a: None), table._commit
    table.merge(spark.createDataFrame([("a", 9, "lost")], table.schema), 4, "n")
    assert {r.k: r.n for r in table.read().collect()}["a"] == 2
    table._commit = commit
    assert table.merge(spark.createDataFrame([("a", 9, "kept")], table.schema), 4, "n")
    assert {r.k: r.x for r in table.read().collect()}["a"] == "kept"


def test_windows_and_new_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", t0 + dt.timedelta(minutes=m)) for m in (0, 10, 70, 600)], "k string, ts timestamp").coalesce(1).write.parquet(src)
    streams.drain(streams.windowed_counts(streams.file_stream(spark, src, "k string, ts timestamp"), "ts", ("k",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    seen = []
    streams.drain_each(streams.file_stream(spark, src, "k string, ts timestamp"), lambda df, i: seen.append(streams.new_only(df, df.where("false"), "k").count()), str(tmp_path / "cp2"))
    assert seen == [1]
    assert streams.first_of_each(streams.file_stream(spark, src, "k string, ts timestamp"), ["k"], "ts").isStreaming and F is not None
