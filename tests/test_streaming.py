"""Runs as a stream: the batch operator's rows, from windows that arrive over many batches, out of order, with a restart."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import trajectory
from lumenframe.streaming import runs

KIND = "video string, class string, start_sec double, score double, ts timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "video string, class string, start_sec double, score double, at double")
    df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))).drop("at").coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, folder, out, ck, **options):
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = runs.stream_runs(source, 0.5, **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def found(spark, out):
    return sorted((r["video"], r["class"], r["start_sec"], r["end_sec"], r["peak"], round(r["mean"], 9), r["n_windows"]) for r in spark.read.schema(runs.OUT).parquet(str(out)).collect())


def test_windows_across_batches_out_of_order_and_a_restart(rocks, tmp_path):
    rng = random.Random(6)
    rows = [(v, c, float(t), round(rng.random(), 3) if rng.random() < 0.9 else None, float(t)) for v in "ab" for c in "xy" for t in range(60)]
    arrival = sorted(rows, key=lambda r: r[4] + rng.random() * 18)  # up to 18 seconds out of order
    end = [("end", "x", 0.0, 0.0, 1000.0)]
    parts = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    for part in parts[:3]:
        put(rocks, tmp_path / "in", part)
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="20 seconds")
    before = found(rocks, tmp_path / "out")
    for part in [*parts[3:], end]:
        put(rocks, tmp_path / "in", part)
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="20 seconds")
    df = rocks.createDataFrame([r[:4] for r in rows], "video string, class string, start_sec double, score double")
    batch = trajectory.runs(df, F.col("score") >= 0.5)
    want = sorted((r["video"], r["class"], r["start_sec"], r["end_sec"], r["peak"], round(r["mean"], 9), r["n_windows"]) for r in batch.collect())
    assert found(rocks, tmp_path / "out") == want and set(before) < set(want)


def test_a_run_closes_when_nothing_comes_and_late_windows_are_dropped(rocks, tmp_path):
    put(rocks, tmp_path / "in", [("v", "c", float(t), s, float(t)) for t, s in enumerate([0.1, 0.9, 0.8, 0.1, 0.7])])
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="0 seconds", timeout_ms=5000)
    assert [r[2:4] for r in found(rocks, tmp_path / "out")] == [(1.0, 4.0)]
    put(rocks, tmp_path / "in", [("w", "c", 0.0, 0.0, 100.0)])
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="0 seconds", timeout_ms=5000)
    put(rocks, tmp_path / "in", [("v", "c", 5.0, 0.9, 5.0), ("v", "c", 200.0, 0.9, 200.0), ("v", "c", 201.0, 0.1, 201.0)])
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="0 seconds", timeout_ms=5000)
    assert [(r[2], r[3], r[6]) for r in found(rocks, tmp_path / "out")] == [(1.0, 4.0, 2), (4.0, 6.0, 1), (200.0, 202.0, 1)]


def test_short_runs_are_left_out_and_the_state_store_is_asked_for(rocks, tmp_path):
    put(rocks, tmp_path / "in", [("v", "c", float(t), s, float(t)) for t, s in enumerate([0.9, 0.1, 0.9, 0.9, 0.1, 0.1])])
    drain(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "ck", lateness="0 seconds", min_run=2)
    assert [(r[2], r[6]) for r in found(rocks, tmp_path / "out")] == [(2.0, 2)]
    rocks.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError):
        runs.stream_runs(rocks.readStream.schema(KIND).parquet(str(tmp_path / "in")), 0.5)
