"""Readers, writers, encoders, reports and the scale-safe rankings, against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import classify, curves, encoder, heads, ranges, reports, retrieval, sampling, tuning, validate
from lumenframe.plans import catalog, inputs
from lumenframe.sources import readers, writers
from tests.helpers import collected, oracle


def touch(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_class_folders(spark, tmp_path):
    for p in ("positive/smoking/a.mp4", "positive/smoking/b.mp4", "negative/c.mp4", "other/d.mp4"):
        touch(tmp_path / p)
    got = {(r["class"], r["relative"]) for r in readers.class_files(spark, str(tmp_path)).collect()}
    assert got == {("smoking", "positive/smoking/a.mp4"), ("smoking", "positive/smoking/b.mp4"), ("no_violation", "negative/c.mp4")}
    assert {(r["class"], r["n"]) for r in readers.class_dirs(spark, str(tmp_path / "positive")).collect()} == {("smoking", 2)}
    touch(tmp_path / "positive/x/smoking/e.mp4")
    with pytest.raises(validate.ValidationError):
        readers.class_dirs(spark, str(tmp_path / "positive"))


def test_videos_by_suffix(spark, tmp_path):
    for p in ("a.MP4", "sub/b.webm", "c.txt", "d"):
        touch(tmp_path / p)
    assert {(r["video"], r["length"]) for r in readers.videos(spark, str(tmp_path)).collect()} == {("a", 1), ("b", 1)}


def test_json_documents_and_defaults(spark, tmp_path):
    touch(tmp_path / "t.json", json.dumps({"click": {"threshold": 0.4, "window": 5, "min_consec": 3, "val_f1": 0.5, "val_tp": 1, "val_fp": 2, "val_fn": 3}}))
    tuned = readers.thresholds(spark, str(tmp_path / "t.json"))
    got = {r["class"]: (r["threshold"], r["window"], r["min_consec"]) for r in readers.with_defaults(inputs.taxonomy(spark), tuned).collect()}
    assert got["click"] == (0.4, 5, 3) and got["error"] == (0.5, 1, 1) and len(got) == 5
    touch(tmp_path / "p.json", json.dumps({"eating": {"caption": "someone eats", "label": 1}}))
    assert tuple(readers.prompts(spark, str(tmp_path / "p.json")).select("class", "caption", "label").first()) == ("eating", "someone eats", 1)
    touch(tmp_path / "rows.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert sorted(map(tuple, readers.json_table(spark, str(tmp_path / "rows.json"), "a int, b string").collect()), key=str) == [(1, "x"), (2, None)]


def test_array_archives(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.savez(tmp_path / "one.npz", embeddings=v, labels=np.arange(6), names=np.array([f"n{i}" for i in range(6)]), model=np.array("enc"))
    schema = "embeddings array<float>, labels long, names string, model string"
    for rows in (4096, 4):
        got = readers.array_files(spark, str(tmp_path), schema, rows).orderBy("labels").collect()
        assert [(r["embeddings"], r["labels"], r["names"], r["model"]) for r in got] == [(v[i].tolist(), i, f"n{i}", "enc") for i in range(6)]
    np.savez(tmp_path / "two.npz", embeddings=v, labels=np.arange(5), names=np.array(["a"]), model=np.array("e"))
    with pytest.raises(Exception, match="lengths"):
        readers.array_files(spark, str(tmp_path), schema).collect()


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b,c", 0.25)], "i int, s string, x double")
    writers.csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", "true").schema(df.schema).csv(str(tmp_path / "csv")).collect())) == [(1, "a", 0.5), (2, "b,c", 0.25)]
    writers.json_rows(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 2
    writers.parquet(df, str(tmp_path / "pq"), ["s"])
    writers.parquet(df.where("i = 1").withColumn("x", F.lit(9.0)), str(tmp_path / "pq"), ["s"])  # a rerun replaces its own part only
    assert sorted((r["i"], r["x"]) for r in spark.read.parquet(str(tmp_path / "pq")).collect()) == [(1, 9.0), (2, 0.25)]
    assert writers.render("a __X__ b __Y__ __X__", {"X": "1", "Y": "2"}) == "a 1 b 2 1"
    assert json.loads(writers.document(df.limit(1))) == {"i": 1, "s": "a", "x": 0.5}


def test_report_files(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 0), (1, 1, 2)], "label int, pred int, n long")
    writers.confusion_csv(cells, [0, 1], str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")) == "true\\pred,0,1\n0,3,1\n1,0,2\n"
    writers.per_class_csv(classify.per_class(cells), str(tmp_path / "p"))
    lines = "".join(p.read_text() for p in (tmp_path / "p").glob("*.csv")).splitlines()
    assert lines[0] == "class,precision,recall,f1,support,predicted" and lines[1] == "0,1.0000,0.7500,0.8571,4,3"


def test_probing_and_usable_media(spark):
    facts = {"a": {"codec": "h264", "pix_fmt": "yuv420p", "duration": "2.0"}, "b": {"codec": "vp9", "pix_fmt": "yuv420p", "duration": 3}, "c": {"codec": "h264", "pix_fmt": "yuv420p", "duration": 0.1}}
    files = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    probed = validate.probe_media(files, facts.__getitem__)
    rows = {r["path"]: r for r in probed.collect()}
    assert rows["a"]["duration"] == 2.0 and rows["d"]["error"] == "KeyError: 'd'" and rows["d"]["duration"] is None
    assert [r["path"] for r in validate.usable_media(probed).collect()] == ["a"]


def test_search_requests_and_payloads(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (7,), (99,)], "k int").select(reports.search_request(F.col("k"))).collect()] == [1, 7, 24]
    s = spark.createDataFrame([("v", "a", 1.0, 0.5), ("v", "a", 0.0, 0.25), ("v", "b", 0.0, 1.0), ("w", "a", 0.0, 0.0)], "video string, class string, start_sec double, score double")
    e = spark.createDataFrame([("v", "a", 0.0, 2.0, 0.5, 0.4, 2)], "video string, class string, start_sec double, end_sec double, peak double, mean double, n_windows long")
    got = {r["video"]: json.loads(r["payload"]) for r in reports.trajectory_payload(s, e).collect()}
    assert got["v"] == {"starts": [0.0, 1.0], "classes": {"a": [0.25, 0.5], "b": [1.0, None]}, "chunk_sec": 2.0, "events": {"a": [{"start_sec": 0.0, "end_sec": 2.0, "peak": 0.5, "mean": 0.4, "n_windows": 2}]}}
    assert got["w"]["events"] == {} and json.loads(reports.trajectory_payload(s).where("video = 'w'").first()["payload"])["starts"] == [0.0]


def test_numbers_of_nested_documents(spark):
    deep = {"x": 1}
    for _ in range(60):
        deep = {"K": deep}
    docs = [{"A": {"Top1": 0.5, "t": "text", "l": [1]}, "n": None, "b": True}, deep, 7, "plain", []]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, None)], "i int, t string")
    got = {r["i"]: r["f"] for r in df.select("i", reports.flatten_json(F.col("t")).alias("f")).collect()}
    assert got == {0: {"a.top1": 0.5, "b": 1.0}, 1: {"k." * 60 + "x": 1.0}, 2: {"": 7.0}, 3: {}, 4: {}, 9: None}


def test_index_and_search(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{i}", f"caption {i}", f"f{i}.mp4", f"text {i}") for i in range(30)], "item string, caption string, file string, content string")
    encoder.build_index(rows, "content", encoder.hash_encoder, "hash", str(tmp_path / "ix"))
    got = encoder.search_index(spark, str(tmp_path / "ix"), " text 7 ", encoder.hash_encoder, "hash", 40).orderBy("rank").collect()
    assert len(got) == 24 and tuple(got[0]) == (1, "i7", "f7.mp4", "caption 7", 1.0)
    want = encoder.hash_encoder(["text 7", *(f"text {i}" for i in range(30))]).astype(float)
    assert [r["item"] for r in got] == [f"i{i}" for i in np.argsort(-(want[1:] @ want[0]), kind="stable")[:24]]
    for bad in (lambda: encoder.search_index(spark, str(tmp_path / "ix"), "  ", encoder.hash_encoder, "hash"), lambda: encoder.search_index(spark, str(tmp_path / "ix"), "a", encoder.hash_encoder, "other")):
        with pytest.raises(validate.ValidationError):
            bad()


def test_windows_are_read_in_batches(spark):
    videos = spark.createDataFrame([("v", "p", 10.0, 45), ("bad", "q", 10.0, 45)], "video string, path string, fps double, length long")
    windows = spark.createDataFrame([(v, float(t)) for v in ("v", "bad") for t in range(5)], "video string, start_sec double")

    def frames(path, numbers):
        if path == "q":
            raise OSError("unreadable")
        assert 1 <= len(numbers) <= 2 and all(len(n) == 8 for n in numbers)
        return numbers

    got = encoder.encode_windows(videos, windows, frames, lambda clips: np.array([[c[0], c[-1]] for c in clips], float) + 1, "enc", batch=2).orderBy("start_sec").collect()
    want = [(10 * t, min(10 * (t + 2), 44)) for t in range(5)]
    assert [r["start_sec"] for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0] and {r["encoder"] for r in got} == {"enc"}
    for r, (a, b) in zip(got, want, strict=True):
        assert np.allclose(r["embedding"], np.array([a + 1, b + 1]) / math.hypot(a + 1, b + 1), atol=1e-6)
    with pytest.raises(Exception, match="unreadable"):
        encoder.encode_windows(videos, windows, frames, lambda c: np.ones((len(c), 2)), "e", strict=True).collect()


def test_weights_by_class_index(spark):
    w = spark.createDataFrame([(2, [1.0, 0.0], 0.5), (0, [-1.0, 0.0], 0.0)], "class int, w array<double>, b double")
    every = heads.by_class_index(w, 4, 2)
    assert sorted((r["class"], r["w"], r["b"]) for r in every.collect()) == [(0, [-1.0, 0.0], 0.0), (1, [0.0, 0.0], 0.0), (2, [1.0, 0.0], 0.5), (3, [0.0, 0.0], 0.0)]
    items = spark.createDataFrame([(1, 2, [1.0, 0.0]), (2, 0, [-2.0, 1.0]), (3, 1, [-0.5, 0.0])], "item long, label int, embedding array<double>")
    assert {r["item"]: r["pred"] for r in heads.probe_predictions(items, every).collect()} == {1: 2, 2: 0, 3: 0}


def test_the_probe_is_at_its_minimum(spark):
    """The gradient of the balanced, regularised loss vanishes at the fitted weights."""
    rng = np.random.default_rng(0)
    y = np.array([0] * 30 + [1] * 20 + [2] * 10)
    x = rng.standard_normal((60, 4)) + np.eye(4)[y] * 2
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "item long, label int, embedding array<double>")
    rows, c = heads.linear_probe(df, grid=(1.0,))
    got = {r["class"]: (r["w"], r["b"]) for r in rows.collect()}
    w, b = np.array([got[k][0] for k in range(3)]), np.array([got[k][1] for k in range(3)])
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    balance = 60 / (3 * np.bincount(y))[y]
    error = (p - np.eye(3)[y]) * balance[:, None]
    assert c == 1.0 and np.abs(w + c * error.T @ x).max() < 1e-2 and np.abs(error.sum(axis=0)).max() < 1e-2


def test_running_sums_equal_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([0.1, 0.10001, 0.2, -3.5, 1e300, -1e300, float("nan"), rng.random()]), rng.randint(0, 1)) for i in range(300)] + [("a", 300, None, 1)]
    df = spark.createDataFrame(rows, "g string, i long, score double, y int")
    got = {r["i"]: (r["n"], r["hits"]) for r in ranges.running_sums(df.withColumn("one", F.lit(1)), ["g"], {"n": "one", "hits": "y"}, ties=("i",)).collect()}
    rank = lambda s: (0,) if s is None else (2,) if math.isnan(s) else (1, s)
    for g in "ab":
        part = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        part.sort(key=lambda r: rank(r[2]), reverse=True)
        hits = 0
        for n, r in enumerate(part, 1):
            hits += r[3]
            assert got[r[1]] == (n, hits)


def test_curves_and_rankings_equal_plain_lists(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, round(rng.random(), 2), rng.randint(0, 1)) for i in range(200)]
    curve = {(r["class"], r["threshold"]): (r["tp"], r["n"], r["npos"]) for r in curves.pr_curve(spark.createDataFrame(rows, "class string, item long, score double, y int")).collect()}
    for c, t in curve:
        above = [y for k, _, s, y in rows if k == c and s >= t]
        assert curve[c, t] == (sum(above), len(above), sum(y for k, _, _, y in rows if k == c))
    scored = spark.createDataFrame([(c, i, s, c if y else "z") for c, i, s, y in rows], "class string, item long, score double, label string")
    for r in retrieval.class_ranking(scored).collect():
        ranked = sorted((x for x in rows if x[0] == r["class"]), key=lambda x: (-x[2], x[1]))
        places = [n for n, x in enumerate(ranked, 1) if x[3]]
        assert r["first_rank"] == places[0] and r["n_rel"] == len(places) and abs(r["ap"] - sum((m + 1) / n for m, n in enumerate(places)) / len(places)) < 1e-12


@pytest.mark.parametrize("n,seed", [(400, 1), (37, 2), (3, 3), (0, 4)])
def test_greedy_split_equals_one_video_after_the_other(spark, monkeypatch, n, seed):
    monkeypatch.setattr(sampling, "RANGE_VIDEOS", 16)
    rng = random.Random(seed)
    shares = {"train": 0.72, "val": 0.08, "test": 0.2}
    videos = [(i, rng.sample("abcdefg", rng.choice([0, 1, 1, 2, 3])) if i % 9 else ["h"]) for i in range(n)]
    got = {r["video"]: r["split"] for r in sampling.greedy_split(spark.createDataFrame(videos, "video long, classes array<string>"), shares).collect()}
    often = {c: sum(c in v for _, v in videos) for c in "abcdefgh"}
    order = sorted(videos, key=lambda v: (min((often[c] for c in v[1]), default=1 << 30), hashlib.md5(f"42:{v[0]}".encode()).hexdigest()))
    size, have = dict.fromkeys(shares, 0), {s: set() for s in shares}
    for video, classes in order:
        best = max(shares, key=lambda s: (len(set(classes) - have[s]), shares[s] * n - size[s]))
        size[best] += 1
        have[best] |= set(classes)
        assert got[video] == best
    assert len(got) == n


def test_skipping_equals_one_by_one():
    for sizes in ({"a": 0, "b": 0, "c": 0}, {"a": 5, "b": 0, "c": 2}):
        for n in (0, 1, 2, 7, 50, 99, 130):
            slow, fast = (sampling.SplitState({"a": 72.0, "b": 8.0, "c": 20.0}, sizes) for _ in range(2))
            for _ in range(n):
                slow.choose([])
            fast.skip(n)
            assert slow.sizes == fast.sizes


def test_training_set_keeps_repeats(spark):
    cols = "chunk_id string, video long, split string, start_sec double, end_sec double, labels array<string>"
    chunks = spark.createDataFrame([(f"c{i}", 1, "train" if i < 12 else "val", float(i), i + 2.0, ["x"] if i in (0, 13) else ["no_violation"]) for i in range(14)], cols)
    moved = spark.createDataFrame([("j", 1, "train", 0.5, 2.5, ["x"], 1)] * 2, cols + ", jitter int")
    got = sampling.training_set(chunks, ~F.array_contains("labels", "no_violation"), moved, "video", "chunk_id").collect()
    assert sorted(r["origin"] for r in got) == ["jitter"] * 2 + ["negative"] * 4 + ["positive"]
    assert {r["split"] for r in sampling.joined_splits(chunks, ("val", "test"), "held").collect()} == {"held"}


def test_captions_and_positives(spark):
    items = spark.createDataFrame([(1, 0), (2, 5)], "item long, label int")
    assert {r["item"]: r["caption"] for r in classify.with_captions(items, spark.createDataFrame([(0, "zero")], "label int, caption string")).collect()} == {1: "zero", 2: None}
    labelled = spark.createDataFrame([("train", ["a", "a"]), ("train", ["a", "b"]), ("val", ["b"])], "split string, labels array<string>")
    got = heads.positives(labelled, spark.createDataFrame([("a",), ("b",), ("c",)], "class string"), 2)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 0, 0), ("b", 1, 1, 1), ("c", 0, 0, 1)]


def test_the_whole_grid_equals_sql(spark):
    sql = catalog.select(f"SELECT class, {catalog.FULL_THR[::8]}[ti + 1]::DOUBLE AS threshold, {catalog.FULL_WIN}[wi + 1] AS \"window\", {catalog.FULL_K}[ki + 1] AS min_consec, f1 AS val_f1, CAST(tp AS BIGINT) AS val_tp, CAST(fp AS BIGINT) AS val_fp, CAST(fn AS BIGINT) AS val_fn FROM be WHERE r = 1", catalog._tune_sql(catalog.FULL_THR[::8], catalog.FULL_WIN, catalog.FULL_K))
    sf = "/root/testdata/sf0.001"
    got = tuning.tune(inputs.trajectories(spark, sf).where(F.col("class") != inputs.NEGATIVE), catalog._truth(spark, sf), catalog.FULL_THR[::8], catalog.FULL_WIN, catalog.FULL_K, chunk=2.0)
    assert collected(got) == oracle(sf, sql)
