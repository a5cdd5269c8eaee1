"""Array archives in ranges of rows and files that appear whole or not at all."""

import io
import zipfile

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lumenframe.sources import archives, readers


def save(path, compressed=False, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    (np.savez_compressed if compressed else np.savez)(path, **arrays)


KIND = "id string, embedding array<float>, label long, encoder string"


@pytest.mark.parametrize("compressed", [False, True])
def test_one_archive_is_read_by_many_tasks(spark, tmp_path, compressed):
    n = 1000
    rng = np.random.default_rng(0)
    e = rng.normal(size=(n, 5)).astype(np.float32)
    save(tmp_path / "a/x.npz", compressed, id=np.array([f"i{i}" for i in range(n)]), embedding=e, label=np.arange(n), encoder=np.array("enc"))
    got = archives.read_arrays(spark, str(tmp_path / "a"), KIND, rows=64)
    assert got.select(F.spark_partition_id()).distinct().count() == -(-n // 64)
    rows = got.orderBy("label").collect()
    assert [(r["id"], r["label"], r["encoder"]) for r in rows] == [(f"i{i}", i, "enc") for i in range(n)]
    assert np.array_equal(np.array([r["embedding"] for r in rows], np.float32), e)
    old = readers.array_files(spark, str(tmp_path / "a"), KIND)
    assert sorted(map(repr, old.drop("path").collect())) == sorted(map(repr, got.drop("path").collect()))


def test_only_named_arrays_are_opened(spark, tmp_path):
    save(tmp_path / "x.npz", label=np.arange(9), heavy=np.zeros((9, 4)))
    data = (tmp_path / "x.npz").read_bytes()
    at = data.index(b"heavy.npy") + len(b"heavy.npy")
    (tmp_path / "x.npz").write_bytes(data[:at] + b"\xff" * 60 + data[at + 60 :])  # the other array is damaged
    assert sorted(r["label"] for r in archives.read_arrays(spark, str(tmp_path / "x.npz"), "label long", 4).collect()) == list(range(9))
    with pytest.raises(Exception):  # noqa: B017
        archives.read_arrays(spark, str(tmp_path / "x.npz"), "heavy array<double>").collect()


def test_errors_as_before(spark, tmp_path):
    save(tmp_path / "long/x.npz", a=np.arange(3), b=np.arange(4))
    save(tmp_path / "object/x.npz", a=np.array([{}, {}], dtype=object))
    save(tmp_path / "columns/x.npz", a=np.asfortranarray(np.zeros((3, 2))))
    save(tmp_path / "none/x.npz", b=np.arange(4))
    for name, what in (("long", "lengths"), ("object", "pickled"), ("columns", "row order"), ("none", "no array"), ("missing", "no such")):
        kind = "a array<double>" if name == "columns" else "a long, b long" if name == "long" else "a long"
        with pytest.raises(Exception, match=what):
            archives.read_arrays(spark, str(tmp_path / name), kind).collect()
    save(tmp_path / "empty/x.npz", a=np.arange(0))
    assert archives.read_arrays(spark, str(tmp_path / "empty"), "a long").collect() == []


def test_round_trip_of_archives(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS n").select(F.format_string("i%d", "n").alias("id"), F.array(*[(F.col("n") * k).cast("float") for k in range(4)]).alias("embedding"), F.col("n").alias("label")).repartition(3)
    archives.write_arrays(df, str(tmp_path / "out"), rows=100)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "_SUCCESS" in files and all(f.endswith(".npz") or f == "_SUCCESS" for f in files) and len(files) >= 6
    with zipfile.ZipFile(next((tmp_path / "out").glob("*.npz"))) as z:
        assert np.load(io.BytesIO(z.read("embedding.npy"))).dtype == np.float32
    back = archives.read_arrays(spark, str(tmp_path / "out"), "id string, embedding array<float>, label long", rows=30)
    assert sorted(map(tuple, back.drop("path").collect())) == sorted(map(tuple, df.collect()))
    archives.write_arrays(df.limit(7), str(tmp_path / "out"))
    assert back.sparkSession.read.format("lumenframe_arrays").schema("path string, label long").load(str(tmp_path / "out")).count() == 507
    archives.write_arrays(df.limit(7), str(tmp_path / "out"), "overwrite")
    assert archives.read_arrays(spark, str(tmp_path / "out"), "label long").count() == 7
    for bad in (df.withColumn("label", F.when(F.col("label") > 3, F.col("label"))), df.withColumn("embedding", F.slice("embedding", 1, F.least(F.lit(4), F.col("label").cast("int") + 1)))):
        with pytest.raises(Exception):  # noqa: B017
            archives.write_arrays(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").rglob("*.npz*"))


def test_a_job_that_dies_midway_leaves_no_file(spark, tmp_path):
    def die(batches):
        for b in batches:
            yield b.slice(0, 5)
            if TaskContext.get().partitionId() == 2:
                raise RuntimeError("killed midway")
            yield b.slice(5)

    df = spark.range(400).selectExpr("id AS label").repartition(4).mapInArrow(die, "label long")
    with pytest.raises(Exception, match="killed midway"):
        archives.write_arrays(df, str(tmp_path / "out"), rows=2)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    lines = df.selectExpr("concat('f', label % 7, '.txt') AS name", "string(label) AS line")
    with pytest.raises(Exception, match="killed midway"):
        archives.write_lines(lines, str(tmp_path / "text"), ["line"])
    assert not (tmp_path / "text").exists() or not [p for p in (tmp_path / "text").rglob("*") if p.is_file()]


def test_files_of_scores_and_splits(spark, tmp_path):
    scores = spark.createDataFrame([("v1", c, float(t), t / 8 + (c == "b")) for c in "ab" for t in range(12)] + [("v2", "a", 0.0, 0.5)], "video string, class string, start_sec double, score double").repartition(5)
    archives.write_scores(scores, ["a", "b"], str(tmp_path / "s"))
    text = (tmp_path / "s/scores_v1.csv").read_text().splitlines()
    assert text[0] == "start_sec,a,b" and text[2] == "1.000,0.125000,1.125000" and len(text) == 13
    assert (tmp_path / "s/scores_v2.csv").read_text() == "start_sec,a,b\n0.000,0.500000,\n"
    back = readers.score_files(spark, str(tmp_path / "s")).where("score IS NOT NULL")
    assert back.count() == 25
    with pytest.raises(Exception, match="exists"):
        archives.write_scores(scores, ["a", "b"], str(tmp_path / "s"))
    items = spark.createDataFrame([("train", "b"), ("train", "a"), ("val", "c"), ("train", "a")], "split string, video string").repartition(4)
    archives.write_splits(items, str(tmp_path / "l"))
    assert {p.name: p.read_text() for p in (tmp_path / "l").glob("*.txt")} == {"train.txt": "a\nb\n", "val.txt": "c\n"}
