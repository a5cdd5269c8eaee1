"""Long series in blocks and running sums in ranges: the same rows as plain loops, and no task with more than its part."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import curves, ranges, retrieval, sampling, series, staging, trajectory, tuning


def plain_runs(rows, threshold):
    out = []
    for key in sorted({r[:2] for r in rows}):
        run = []
        for _, _, start, score in [*sorted(r for r in rows if r[:2] == key), (*key, None, None)]:
            if score is not None and score >= threshold:
                run.append((start, score))
            elif run:
                out.append((*key, run[0][0], run[-1][0] + 2.0, max(s for _, s in run), sum(s for _, s in run) / len(run), len(run)))
                run = []
    return out


def irregular(seed, n=400):
    """Two videos with gaps far longer than a block, blocks of one row, and long flagged stretches."""
    rng, rows = random.Random(seed), []
    for video in ("a", "b"):
        at, high = 0.0, False
        for _ in range(n):
            at += rng.choice([1, 1, 1, 2, 50])
            high = high if rng.random() < 0.9 else not high
            rows.append((video, "c", at, round((0.5 if high else 0.0) + rng.random() / 2, 3)))
    return rows


@pytest.mark.parametrize("span", [1, 3, 8, 40, 10_000])
def test_blocks_of_any_length_give_the_same_runs_and_medians(spark, monkeypatch, span):
    monkeypatch.setattr(series, "SPAN", span)
    rows = irregular(span)
    df = spark.createDataFrame(rows, "video string, class string, start_sec double, score double").repartition(5)
    found = trajectory.runs(df, F.col("score") >= 0.5).collect()
    got = sorted((r["video"], r["class"], r["start_sec"], r["end_sec"], r["peak"], round(r["mean"], 9), r["n_windows"]) for r in found)
    assert got == [(*r[:5], round(r[5], 9), r[6]) for r in plain_runs(rows, 0.5)]
    for window in (3, 4, 9):
        half, want = window // 2, {}
        for video in "ab":
            part = sorted(r for r in rows if r[0] == video)
            for i, r in enumerate(part):
                want[video, r[2]] = round(statistics.median(x[3] for x in part[max(0, i - half) : i + half + 1]), 9)
        assert {(r["video"], r["start_sec"]): r["score"] for r in trajectory.smooth(df, window).collect()} == want


def test_null_scores_end_runs_and_no_rows_give_none(spark, monkeypatch):
    monkeypatch.setattr(series, "SPAN", 2)
    df = spark.createDataFrame([("a", "c", float(i), None if i in (3, 4) else 1.0) for i in range(9)], "video string, class string, start_sec double, score double")
    assert sorted((r["start_sec"], r["n_windows"]) for r in trajectory.runs(df, F.col("score") >= 0.5).collect()) == [(0.0, 3), (5.0, 4)]
    assert trajectory.runs(df.limit(0), F.col("score") >= 0.5).collect() == [] == trajectory.smooth(df.limit(0), 3).collect()
    whole = trajectory.runs(df.where("score > 0"), F.col("score") >= 0.5).collect()
    assert [(r["start_sec"], r["end_sec"], r["n_windows"]) for r in whole] == [(0.0, 10.0, 7)]


def test_one_long_series_is_no_task_of_its_own(spark, monkeypatch):
    """300,000 windows of one video and class, runs over many blocks: every window function sees a block at most."""
    monkeypatch.setattr(series, "SPAN", 1000)
    n = 300_000
    df = spark.range(n).select(F.lit("v").alias("video"), F.lit("c").alias("class"), F.col("id").cast("double").alias("start_sec"), F.when(F.col("id") % 7001 < 7000, 0.75).otherwise(0.25).alias("score"))
    found = sorted((r["start_sec"], r["n_windows"]) for r in trajectory.runs(df, F.col("score") >= 0.5).collect())
    assert found == [(float(i), min(7000, n - i)) for i in range(0, n, 7001)]
    halo = series.with_halo(df, ["video", "class"], 4)
    sizes = halo.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.count_if("_own").alias("own")).agg(F.max("n"), F.max("own"), F.sum("own"), F.count("*")).first()
    assert tuple(sizes) == (1008, 1000, n, 300)
    smoothed = trajectory.smooth(df, 9)
    assert smoothed.count() == n and smoothed.where("score <> 0.75").count() == 0


def test_one_score_for_all_is_dealt_over_many_ranges(spark):
    """A class whose scores all tie, beside one of crowded scores: no range holds more than a few times its share."""
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("class"), F.col("id").alias("item"), F.when(F.col("id") % 4 == 0, F.rand(1) * 1e-9).otherwise(0.5).alias("score"), F.lit(1).alias("one"))
    df = staging.stage(df.repartition(8), "test")
    cut = ranges.dealt(df, [F.col("class"), F.desc("score"), F.col("item")], "test", 16)
    sizes = [r["n"] for r in cut.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * n / 16
    got = ranges.running_sums(df, ["class"], {"rank": "one"}, ties=("item",), wholes={"all": "rank"}, ranges=16)
    want = df.selectExpr("class", "item", "row_number() OVER (PARTITION BY class ORDER BY score DESC, item) AS r", "count(*) OVER (PARTITION BY class) AS n")
    assert got.join(want, ["class", "item"]).where("rank <> r OR all <> n").count() == 0 and got.count() == n


def test_rankings_and_curves_of_ties(spark):
    rows = [("x" if i % 3 else "y", "x", i, 0.5 if i % 2 else 0.25) for i in range(60)] + [("y", "y", i, 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "label string, class string, item long, score double")
    got = {r["class"]: r for r in retrieval.class_ranking(df).collect()}
    order = sorted((r for r in rows if r[1] == "x"), key=lambda r: (-r[3], r[2]))
    hits = [i + 1 for i, r in enumerate(order) if r[0] == "x"]
    assert got["x"]["first_rank"] == hits[0] and abs(got["x"]["ap"] - sum((k + 1) / h for k, h in enumerate(hits)) / len(hits)) < 1e-12
    scored = df.select("class", "score", (F.col("class") == F.col("label")).cast("int").alias("y"))
    curve = {(r["class"], r["threshold"]): (r["tp"], r["n"], r["npos"]) for r in curves.pr_curve(scored).collect()}
    assert curve == {("x", 0.5): (20, 30, 40), ("x", 0.25): (40, 60, 40), ("y", 0.5): (5, 5, 5)}


@pytest.mark.parametrize("spread", [1, 1 << 40])
def test_numbers_of_sparse_ids(spark, spread):
    ids = random.Random(3).sample(range(10_000), 3000)
    df = spark.createDataFrame([(i * spread,) for i in ids], "item long").repartition(7)
    assert {r["item"]: r["idx"] for r in sampling.numbered(df, "item").collect()} == {i * spread: k for k, i in enumerate(sorted(ids))}
    assert sampling.numbered(df.limit(0), "item").collect() == []


def test_staged_tables_can_be_cleaned(spark):
    df = staging.stage(spark.range(5), "gone")
    assert df.count() == 5
    staging.clean(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(staging.folder(spark)).count()


def test_tables_of_several_videos_are_put_together(spark):
    from lumenframe.operators.validate import ValidationError

    a = spark.createDataFrame([("v", 0.0, 0.1, 0.2, 9.0), ("v", 1.0, None, 0.4, 9.0)], "video string, start_sec double, x double, y double, other double")
    b = spark.createDataFrame([(5.0, "w", 0.0)], "y double, video string, start_sec double").withColumn("x", F.lit(1.5))
    got = sorted(map(tuple, trajectory.concatenated([a, b], ["x", "y"]).collect()), key=repr)
    assert got == sorted([("v", "x", 0.0, 0.1), ("v", "x", 1.0, None), ("v", "y", 0.0, 0.2), ("v", "y", 1.0, 0.4), ("w", "x", 0.0, 1.5), ("w", "y", 0.0, 5.0)], key=repr)
    for parts in ([a, b.drop("x")], [a, a], []):
        with pytest.raises(ValidationError):
            trajectory.concatenated(parts, ["x", "y"])


def test_the_review_queue_has_ranks(spark):
    rows = [(v, "c", float(t), p, 1) for v, p in (("a", 0.3), ("b", 0.5), ("d", 0.5)) for t in range(3)]
    df = spark.createDataFrame(rows, "video string, class string, start_sec double, score double, unknown int")
    assert [(r["video"], r["rank"]) for r in trajectory.review_queue(df, "n").collect()] == [("b", 1), ("d", 2), ("a", 3)]


def plain_tally(start, score, truth, thresholds, windows, min_consecs, iou, chunk):
    """tp, fp, fn of one series, by loops over all combinations."""
    out = []
    for window in windows:
        half = window // 2 if window > 1 else 0
        cut = [score[max(0, i - half) : i + half + 1] for i in range(len(score))]
        smooth = [round(statistics.median(c), 9) for c in cut] if half else score
        for threshold in thresholds:
            for shortest in min_consecs:
                found, run = [], []
                for s, x in [*zip(start, smooth, strict=True), (None, None)]:
                    if s is not None and x >= threshold:
                        run.append((s, x))
                    elif run:
                        found.append((-max(x for _, x in run), run[0][0], run[-1][0] + chunk, len(run)))
                        run = []
                free, hits = list(truth), 0
                kept = sorted(r for r in found if r[3] >= shortest)
                for _, s, e, _ in kept:
                    shares = [(max(0.0, min(e, b) - max(s, a)) / (max(e, b) - min(s, a)), i) for i, (a, b) in enumerate(free)]
                    if shares and max(shares)[0] >= iou:
                        free.pop(max(shares)[1])
                        hits += 1
                out.append((hits, len(kept) - hits, len(truth) - hits))
    return out


def tuning_case(rng, n, length):
    """Series with ties and gaps, nested and overlapping true events, some without any; three groups."""
    rows = []
    for _ in range(n):
        start = [float(x) for x in sorted(rng.sample(range(2 * length), rng.randint(0, length)))]
        truth = [(float(a), float(a + rng.randint(1, 6))) for a in (rng.randint(0, 2 * length) for _ in range(rng.randint(0, length // 2)))]
        rows.append((start, [round(rng.choice([0.0, rng.random()]), rng.choice([1, 2])) for _ in start], truth, rng.randint(0, 2)))
    return rows


def tallied(rows, *grid):
    flat = lambda lists: np.array([x for a in lists for x in a], float)
    ends = lambda lists: np.cumsum([0, *map(len, lists)])
    start, score, truth, group = zip(*rows, strict=True)
    t = flat([e for g in truth for e in g]).reshape(-1, 2)
    return tuning.tally(flat(start), flat(score), ends(start), t[:, 0], t[:, 1], ends(truth), np.array(group), 3, *grid)


@pytest.mark.parametrize("cells,rounds", [(1 << 20, 8), (16, 8), (1 << 20, 0), (50, 1)])
def test_series_tuned_side_by_side_count_as_one_by_one(monkeypatch, cells, rounds):
    monkeypatch.setattr(tuning, "CELLS", cells)
    monkeypatch.setattr(tuning, "ROUNDS", rounds)
    for seed, iou in ((1, 0.3), (2, 0.05), (3, 0.8)):
        rows = tuning_case(random.Random(seed), 25, 24)
        grid = [0.5, 0.1, 0.15, 0.5, 0.9], [1, 4, 3, 9], [2, 1, 3], iou, 2.0
        want = np.zeros((3, 60, 3), int)
        for start, score, truth, group in rows:
            want[group] += plain_tally(start, score, truth, *grid)
        assert (tallied(rows, *grid).reshape(3, 60, 3) == want).all()


def test_the_whole_grid_takes_a_millisecond_a_series():
    """492 combinations of 2,000 months of days; one by one, with a loop for each run and event, a series took some 6 ms."""
    rng = random.Random(5)
    rows = [([float(d) for d in range(30)], [round(rng.choice([0.0, rng.expovariate(3)]), 4) for _ in range(30)], [(float(a), a + 2.0) for a in range(0, 30, 4)], 0) for _ in range(2000)]
    began = time.process_time()
    tallied(rows, [i / 100 for i in range(10, 51)], [1, 3, 5, 9], [1, 2, 3], 0.3, 2.0)
    assert time.process_time() - began < 2
