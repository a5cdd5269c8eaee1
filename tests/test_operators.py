"""Hand-computed cases of the operators' fine points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import grids, names, vectors
from lumenframe.operators import classify, curves, encoder, heads, intervals, matching, reports, retrieval, sampling, trajectory, tuning, validate
from lumenframe.sources import readers, writers


def series(spark, values, video="v", cls="c"):
    return spark.createDataFrame([(video, cls, float(i), float(x)) for i, x in enumerate(values)], "video string, class string, start_sec double, score double")


def by_start(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("start_sec").collect()]


def test_moving_median(spark):
    s = series(spark, [0.1, 0.9, 0.2, 0.8])
    assert by_start(trajectory.smooth(s, 3), "score") == [(0.5,), (0.2,), (0.8,), (0.5,)]
    assert by_start(trajectory.smooth(s, 1), "score") == by_start(s, "score")


def test_rounding_is_that_of_sql(spark):
    """A mean of four windows that ends in 5 at the seventh digit: its product with 10^6 lies below the half."""
    import duckdb

    t = spark.createDataFrame([("c", 0.3, 1, 1)], "class string, threshold double, window int, min_consec int")
    found = trajectory.events(series(spark, [0.0, 0.67555, 0.5023, 0.4592, 0.4587]), t).first()
    assert (found["mean"], found["peak"], found["n_windows"]) == (0.523937, 0.67555, 4)
    values = [0.5239375, 0.8989874999999998, 2.5e-7, 1.5, -1.5, -0.5239375, 0.0, 1e300, float("inf"), *(i / 80000 + j for i in range(400) for j in (0, 3, -7))]
    for digits in (0, 4, 6):
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?)", [x, digits]).fetchone()[0] for x in values]
        assert [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(vectors.half_up("x", digits)).collect()] == want
    assert math.isnan(spark.range(1).select(vectors.half_up(F.lit(math.nan), 6)).first()[0])


@pytest.mark.parametrize("k,want", [(1, [(0.0, 2.0, 0.5, 0.5, 1), (2.0, 5.0, 0.8, 0.65, 2)]), (2, [(2.0, 5.0, 0.8, 0.65, 2)])])
def test_runs_after_smoothing(spark, k, want):
    t = spark.createDataFrame([("c", 0.5, 3, k)], "class string, threshold double, window int, min_consec int")
    assert by_start(trajectory.events(series(spark, [0.1, 0.9, 0.2, 0.8]), t), "start_sec", "end_sec", "peak", "mean", "n_windows") == want


def test_isolated_ignores_window_and_length(spark):
    t = spark.createDataFrame([("c", 0.5, 3, 2)], "class string, threshold double, window int, min_consec int")
    assert by_start(trajectory.events(series(spark, [0.1, 0.9, 0.2, 0.8]), t, "isolated"), "start_sec", "n_windows") == [(1.0, 1), (3.0, 1)]


def test_a_missing_window_does_not_break_a_run(spark):
    s = series(spark, [0.9, 0.9, 0.9]).where("start_sec <> 1")
    assert by_start(trajectory.runs(s, F.col("score") >= 0.5), "start_sec", "end_sec", "n_windows") == [(0.0, 4.0, 2)]


def match(spark, pred, truth, iou=0.3):
    p = spark.createDataFrame([("v", "c", float(a), float(b), float(k)) for a, b, k in pred], "video string, class string, start_sec double, end_sec double, peak double")
    t = spark.createDataFrame([("v", "c", float(a), float(b), i) for i, (a, b) in enumerate(truth)], "video string, class string, start_sec double, end_sec double, pos int")
    return [(r["tp"], r["fp"], r["fn"]) for r in matching.match_events(p, t, iou).collect()]


def test_greedy_matching(spark):
    assert match(spark, [(3, 8, 0.4), (10, 15, 0.5), (20, 22, 0.3)], [(3, 7), (10, 15)]) == [(2, 1, 0)]
    assert match(spark, [(0, 4, 1)], [(0, 2), (2, 4)]) == [(1, 0, 1)]
    assert match(spark, [], [(0, 2), (2, 4)]) == [(0, 0, 2)]
    assert match(spark, [(0, 2, 1), (2, 4, 1)], []) == [(0, 2, 0)]
    assert match(spark, [], []) == []


def brute_match(pred, truth, thr):
    free, tp = dict(enumerate(truth)), 0
    for s, e, _ in sorted(pred, key=lambda p: (-p[2], p[0], p[1])):
        best, at = thr, None
        for j, (a, b) in free.items():
            hull = max(e, b) - min(s, a)
            iou = max(0.0, min(e, b) - max(s, a)) / hull if hull > 0 else 0.0
            if iou >= best:
                best, at = iou, j
        if at is not None:
            tp += 1
            del free[at]
    return tp, len(pred) - tp, len(free)


def test_greedy_matching_against_brute_force(spark):
    rng = random.Random(5)
    pred, truth, want = [], [], {}
    for v in range(120):
        p = [(a := rng.randint(0, 12), a + rng.randint(1, 5), rng.randint(1, 3) / 4) for _ in range(rng.randint(0, 5))]
        t = [(a := rng.randint(0, 12), a + rng.randint(1, 5)) for _ in range(rng.randint(0, 5))]
        if p or t:
            want[str(v)] = brute_match(p, t, 0.3)
        pred += [(str(v), "c", float(a), float(b), k) for a, b, k in p]
        truth += [(str(v), "c", float(a), float(b), i) for i, (a, b) in enumerate(t)]
    p = spark.createDataFrame(pred, "video string, class string, start_sec double, end_sec double, peak double")
    t = spark.createDataFrame(truth, "video string, class string, start_sec double, end_sec double, pos int")
    assert {r["video"]: (r["tp"], r["fp"], r["fn"]) for r in matching.match_events(p, t).collect()} == want


def test_event_scores(spark):
    m = spark.createDataFrame([("a", 2, 1, 0), ("b", 0, 0, 0)], "class string, tp long, fp long, fn long")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in matching.event_scores(m).collect()}
    assert got == {"a": (0.6667, 1.0, 0.8), "b": (0.0, 0.0, 0.0), "micro": (0.6667, 1.0, 0.8)}


def test_overlap_labels_and_uncovered_events(spark):
    w = spark.createDataFrame([("v", 0.0), ("v", 2.0), ("v", 8.0)], "video string, start_sec double")
    e = spark.createDataFrame([("v", "x", 1.5, 2.5), ("v", "y", 4.0, 4.4)], "video string, class string, start_sec double, end_sec double")
    assert by_start(intervals.overlap_labels(w, e), "labels") == [(["x"],), (["x"],), (["no_violation"],)]
    assert [r["class"] for r in intervals.uncovered_events(w, e).collect()] == ["y"]


def test_grids(spark):
    def of(column):
        return spark.range(1).select(column.alias("g")).first()["g"]

    assert of(grids.sliding_starts(F.lit(5.0), 2.0, 1.0)) == [0.0, 1.0, 2.0, 3.0]
    assert of(grids.sliding_starts(F.lit(1.5), 2.0, 1.0)) == [0.0]
    assert of(grids.tumbling_starts(F.lit(5.0), 2.0)) == [0.0, 2.0]
    assert of(grids.tumbling_starts(F.lit(1.5), 2.0)) == []
    assert of(grids.frame_indices(F.lit(0.0), F.lit(10.0), 8)) == [0, 1, 3, 4, 6, 7, 9, 10]
    assert of(grids.frame_indices(F.lit(0.0), F.lit(10.0), 8, truncate=True)) == [0, 1, 2, 4, 5, 7, 8, 10]
    assert grids.parse_grid("0.10:0.50:0.01")[-1] == 0.5 and len(grids.parse_grid("0.10:0.50:0.01")) == 41
    assert grids.parse_list("1,3,5,9") == [1, 3, 5, 9] and grids.parse_pairs("a=b,c=d") == {"a": "b", "c": "d"}


def test_val_count(spark):
    got = spark.createDataFrame([(605, 0.2), (5, 0.5), (7, 0.5), (2, 0.2), (0, 0.2)], "n long, f double")
    assert [r[0] for r in got.select(F.when(F.col("f") == 0.5, sampling.val_count(F.col("n"), 0.5)).otherwise(sampling.val_count(F.col("n"), 0.2))).collect()] == [121, 2, 4, 1, 0]


def test_names(spark):
    r = spark.range(1).select(names.path_id(F.lit("positive/eat/a.mp4")), names.numbered_id(F.lit("run"), F.lit(7)), names.chunk_id(F.lit("lesson"), F.lit(1.5)), names.stem(F.lit("d/a.b.mp4")), names.clamp(F.lit(99))).first()
    assert tuple(r) == ("positive__eat__a", "run_0007", "lesson_0001500", "a.b", 24)


def test_average_precision_and_band(spark):
    s = spark.createDataFrame([("c", 0.9, 1), ("c", 0.8, 0), ("c", 0.8, 1), ("c", 0.3, 0)], "class string, score double, y int")
    assert curves.average_precision(curves.pr_curve(s)).first()["ap"] == 0.8333
    none = spark.createDataFrame([("c", 0.9, 0)], "class string, score double, y int")
    assert tuple(curves.average_precision(curves.pr_curve(none)).first()) == ("c", 0, None)
    b = spark.createDataFrame([("c", 0.9, 1), ("c", 0.6, 0), ("c", 0.5, 1), ("c", 0.2, 0)], "class string, score double, y int")
    band = curves.unknown_band(curves.pr_curve(b))
    assert tuple(band.first())[:3] == ("c", 0.5, 0.9)
    flagged = trajectory.unknown_flags(b.withColumn("video", F.lit("v")), band)
    assert sorted(r["score"] for r in flagged.where("unknown = 1").collect()) == [0.5, 0.6]


def test_ranked_average_precision_keeps_ties_apart(spark):
    s = spark.createDataFrame([(1, 7, 7, 0.9), (2, 7, 7, 0.8), (3, 8, 7, 0.8), (4, 8, 7, 0.3)], "item int, label int, class int, score double")
    assert retrieval.class_ranking(s).first()["ap"] == 1.0


def test_argmax_takes_the_first_of_equal_scores(spark):
    items = spark.createDataFrame([(1, 0, [1.0, 0.0])], "item int, label int, embedding array<double>")
    prompts = spark.createDataFrame([(0, [0.1, 1.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0])], "class int, embedding array<double>")
    assert classify.zero_shot(items, prompts).first()["pred"] == 1


CONFUSION = [[9, 0, 0, 0, 0, 1, 0], [1, 9, 0, 0, 0, 0, 0], [0, 1, 8, 0, 0, 0, 1], [0, 0, 1, 120, 0, 0, 0], [0, 0, 0, 0, 10, 0, 0], [0, 0, 0, 0, 0, 10, 0], [0, 0, 0, 5, 0, 0, 5]]


def test_published_confusion_matrix(spark):
    cells = spark.createDataFrame([(i, j, n) for i, row in enumerate(CONFUSION) for j, n in enumerate(row)], "label int, pred int, n long")
    r = classify.averages(cells, 9).first()
    assert math.isclose(r["accuracy"], 0.9447513812, abs_tol=1e-9)
    assert (round(r["macro_precision"], 9), round(r["macro_recall"], 9), round(r["macro_f1"], 9)) == (0.913044733, 0.870247934, 0.88501371)


def test_absent_class_is_listed_but_not_averaged(spark):
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 0), (1, 0, 0), (1, 1, 0)], "label int, pred int, n long")
    assert classify.averages(cells).first()["macro_f1"] == 1.0
    assert {r["class"]: r["f1"] for r in classify.per_class(cells).collect()} == {0: 1.0, 1: 0.0}


def test_negative_sampling(spark):
    def kept(pos, neg):
        rows = [(f"c{i}", "v", "train", i < pos) for i in range(pos + neg)]
        df = spark.createDataFrame(rows, "chunk_id string, video string, split string, pos boolean")
        return sampling.downsample_negatives(df, F.col("pos"), "video", "chunk_id").where("NOT pos").count()

    assert kept(0, 10) == 4 and kept(3, 10) == 10


def test_jitter(spark):
    chunks = spark.createDataFrame([("a", "v", "train", 0.0, ["x"]), ("b", "v", "train", 4.0, ["x"])], "chunk_id string, video string, split string, start_sec double, labels array<string>")
    events = spark.createDataFrame([("v", "x", 0.0, 6.0)], "video string, class string, start_sec double, end_sec double")
    durations = spark.createDataFrame([("v", 6.0)], "video string, duration double")
    assert by_start(intervals.jitter(chunks, events, durations), "start_sec") == [(0.5,), (3.5,)]


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    for g in range(3):
        rows = sampling.hash_rank(df, ["g"], "id", 9).where(F.col("g") == g).collect()
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and {r["n"] for r in rows} == {len(rows)}


def test_greedy_split_spreads_rare_classes(spark):
    videos = spark.createDataFrame([(i, ["rare", "all"] if i < 3 else ["all"]) for i in range(30)], "video int, classes array<string>")
    got = {r["video"]: r["split"] for r in sampling.greedy_split(videos, {"train": 0.72, "val": 0.08, "test": 0.2}).collect()}
    assert {got[i] for i in range(3)} == {"train", "val", "test"} and len(got) == 30


def test_tuner_takes_the_first_of_equal_settings(spark):
    truth = spark.createDataFrame([("v", "c", 1.0, 3.0, 1)], "video string, class string, start_sec double, end_sec double, pos int")
    best = tuning.tune(series(spark, [0.0, 0.9, 0.0, 0.0]), truth, [0.2, 0.5], [1, 3], [1, 2]).first()
    assert (best["threshold"], best["window"], best["min_consec"], best["val_f1"]) == (0.2, 1, 1, 1.0)


def test_the_whole_grid_finds_what_the_small_one_cannot(spark, monkeypatch):
    from lumenframe.plans import catalog

    # An event of three windows at 0.44, a blip of two at 0.9 and noise of three at 0.41: only 0.42 to 0.44 with three in a row is right.
    scores = series(spark, [0.0, 0.44, 0.44, 0.44, 0.0, 0.0, 0.9, 0.9, 0.0, 0.0, 0.41, 0.41, 0.41, 0.0])
    truth = spark.createDataFrame([("v", "c", 1.0, 5.0, 1)], "video string, class string, start_sec double, end_sec double, pos int")
    monkeypatch.setattr(catalog.I, "days", lambda *_: None)
    monkeypatch.setattr(catalog.I, "trajectories", lambda *_: scores)
    monkeypatch.setattr(catalog, "_truth", lambda *_: truth)
    best = catalog.queries()["tune_thresholds_full"](spark, "").first()
    assert (best["threshold"], best["window"], best["min_consec"], best["val_f1"]) == (0.42, 1, 3, 1.0)
    assert catalog.queries()["tune_thresholds"](spark, "").first()["val_f1"] < 1.0
    assert (len(catalog.FULL_THR), catalog.FULL_WIN, catalog.FULL_K) == (41, [1, 3, 5, 9], [1, 2, 3])


def test_degenerate_heads(spark):
    rows = [(i, [float(i), 1.0], ["all"]) for i in range(6)]
    df = spark.createDataFrame(rows, "item int, embedding array<double>, labels array<string>")
    got = {r["class"]: (r["b"], r["t_lo"], r["t_hi"]) for r in heads.train_heads(df, df, ["all", "none"]).collect()}
    assert got == {"all": (10.0, 1.0, 1.0), "none": (-10.0, 1.0, 1.0)}


def test_head_is_at_the_optimum(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(1.0 if i % 3 == 0 else -0.3, 1.0), rng.gauss(0, 1)], ["p"] if i % 3 == 0 else ["n"]) for i in range(90)]
    df = spark.createDataFrame(rows, "item int, embedding array<double>, labels array<string>")
    h = heads.train_heads(df, df, ["p"], grid=(1.0,)).first()
    grad = [h["w"][0], h["w"][1], 0.0]
    for _, x, labels in rows:
        y = 1.0 if labels == ["p"] else 0.0
        s = 90 / (2 * (30 if y else 60))
        g = s * (1 / (1 + math.exp(-(h["w"][0] * x[0] + h["w"][1] * x[1] + h["b"]))) - y)
        grad = [grad[0] + g * x[0], grad[1] + g * x[1], grad[2] + g]
    assert max(map(abs, grad)) < 1e-3


def test_vectors(spark):
    r = spark.range(1).select(vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), vectors.sigmoid(F.lit(0.0)), vectors.temporal_iou(F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(4.0)), vectors.cosine(F.array(F.lit(2.0)), F.array(F.lit(5.0)))).first()
    assert list(r) == [11.0, [0.6, 0.8], 0.5, 0.0, 1.0]


def test_encoder_skips_bad_rows_or_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, text string")
    got = encoder.encode(df, "text", encoder.hash_encoder, "hash").collect()
    assert sorted(r["id"] for r in got) == [1, 3] and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in got)
    with pytest.raises(Exception, match="nothing to encode"):
        encoder.encode(df, "text", encoder.hash_encoder, "hash", strict=True).collect()


def test_validation(spark):
    a = spark.createDataFrame([("x",), ("y",)], "class string")
    with pytest.raises(validate.ValidationError):
        validate.require_empty(validate.missing(a, a.limit(1), ["class"]), "unknown")
    assert {(r["class"], r["side"]) for r in validate.differences(a, spark.createDataFrame([("y",), ("z",)], "class string"), "class").collect()} == {("x", "left"), ("z", "right")}


def test_reports(spark):
    flat = reports.flatten_json(F.lit('{"A": {"Top1": 0.5, "b": {"c": "x"}}, "d": 1}'))
    got = spark.range(1).select(reports.keys_like(flat, "top").alias("t"), flat.alias("f")).first()
    assert got["t"] == {"a.top1": 0.5} and got["f"] == {"a.top1": 0.5, "d": 1.0}  # numbers only
    m = spark.createDataFrame([(0.5, 0.25)], "accuracy double, map double")
    c = reports.compare(reports.long_metrics(m, "a"), reports.long_metrics(m.withColumn("map", F.lit(0.5)), "b"))
    assert {r["metric"]: (r["delta"], r["differs"]) for r in c.collect()} == {"accuracy": (0.0, 0), "map": (0.25, 1)}
    assert reports.markdown(c).splitlines()[2] == "| accuracy | 0.5000 | 0.5000 | +0.0000 |"


def test_files(spark, tmp_path):
    (tmp_path / "ann.csv").write_text("file,label,from,to\nd/lesson.mp4, smoking ,3,7\n")
    a = readers.annotations(spark, str(tmp_path / "ann.csv"), {"video": "file", "class": "label", "start": "from", "end": "to"})
    assert tuple(a.drop("pos").first()) == ("lesson", "smoking", 3.0, 7.0)
    with pytest.raises(validate.ValidationError):
        readers.annotations(spark, str(tmp_path / "ann.csv"), {"video": "file", "class": "label", "start": "from", "end": "to"}, spark.createDataFrame([("eating",)], "class string"))
    (tmp_path / "scores_v1.csv").write_text("start_sec,a,b\n0.0,0.1,0.2\n")
    assert sorted(map(tuple, readers.score_files(spark, str(tmp_path / "scores_*.csv")).collect())) == [("v1", "a", 0.0, 0.1), ("v1", "b", 0.0, 0.2)]
    for path in ("positive/eat/a.mp4", "positive/eat/b.MP4", "negative/c.avi", "negative/d.txt"):
        (tmp_path / "set" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / path).write_bytes(b"x")
    assert sorted((r["class"], r["relative"]) for r in readers.class_files(spark, str(tmp_path / "set")).collect())[0] == ("eat", "positive/eat/a.mp4")
    assert sorted(r["video"] for r in readers.videos(spark, str(tmp_path / "set")).collect()) == ["a", "b", "c"]
    (tmp_path / "p.json").write_text('{"eat": {"caption": "eats", "label": 0}}')
    assert readers.prompts(spark, str(tmp_path / "p.json")).first()["caption"] == "eats"
    (tmp_path / "v.txt").write_text("a\n\n b \n")
    assert sorted(r["video"] for r in readers.lines(spark, str(tmp_path / "v.txt")).collect()) == ["a", "b"]
    writers.wide_scores(series(spark, [0.25]), ["c"], str(tmp_path / "wide"))
    assert "0.000,0.250000" in "".join(f.read_text() for f in (tmp_path / "wide").rglob("*.csv"))
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 3)], "label int, pred int, n long")
    writers.confusion_csv(cells, [0, 1], str(tmp_path / "conf"))
    assert "true\\pred,0,1\n0,1,2\n1,0,3" in "".join(f.read_text() for f in (tmp_path / "conf").rglob("*.csv"))
    assert writers.render("x: __A__", {"A": "1"}) == "x: 1"
