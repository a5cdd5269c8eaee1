"""Many prompts in passes and the exact index, against plain products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import blocked, classify, index
from tests.helpers import collected


def vectors(rng, n, dim, coarse=False):
    return [[float(rng.choice([-1, 0, 1, 2])) if coarse else rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def plain(items, prompts, k):
    """Sums in order of the components, as the operators make them."""
    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    out = []
    for i, x in items:
        best = sorted((-dot(x, p), c) for c, p in prompts)[:k]
        out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k,passes,coarse,kind", [(1, 1, False, "int"), (4, 7, True, "int"), (4, 3, True, "string"), (50, 2, False, "bigint")])
def test_top_prompts_equal_all_pairs(spark, k, passes, coarse, kind):
    rng = random.Random(k)
    items = list(enumerate(vectors(rng, 60, 9, coarse)))
    prompts = [(f"p{i:03}" if kind == "string" else i, v) for i, v in enumerate(vectors(rng, 35, 9, coarse))]
    a = spark.createDataFrame([(i, v, "x") for i, v in items] + [(900, None, "x"), (901, [1.0] * 8 + [None], "x")], "item int, embedding array<double>, other string").repartition(3)
    b = spark.createDataFrame([*prompts, (None, [1.0] * 9), (prompts[0][0], None)], f"class {kind}, embedding array<double>")
    got = blocked.top_prompts(a, b, k, 35 * 9 * 8 // passes)
    assert got.columns == ["item", "other", "rank", "class", "score"]
    assert sorted((r["item"], r["rank"], r["class"], r["score"]) for r in got.collect()) == plain(items, prompts, k)
    assert blocked.top_prompts(a, b.limit(0), k).collect() == [] == blocked.top_prompts(a.limit(0), b, k).collect()
    every = blocked.all_scores(a, b, 35 * 9 * 8 // passes)
    assert sorted((r["item"], r["class"], r["score"]) for r in every.collect()) == sorted((i, c, s) for i, _, c, s in plain(items, prompts, 35))


def test_beyond_the_broadcast_no_pairs_are_joined(spark, monkeypatch):
    rng = random.Random(8)
    items = spark.createDataFrame(list(enumerate(vectors(rng, 40, 6))), "item int, embedding array<double>")
    prompts = spark.createDataFrame(list(enumerate(vectors(rng, 30, 6))), "class int, embedding array<double>")
    few, long = collected(classify.zero_shot(items, prompts)), collected(classify.scores(items, prompts))
    for rows, size in ((29, 1 << 20), (10_000, 1000)):
        monkeypatch.setattr(classify, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(classify, "BROADCAST_BYTES", size)
        assert classify.few_rows(prompts) is None
        for got, want in ((classify.zero_shot(items, prompts), few), (classify.scores(items, prompts), long)):
            assert collected(got) == want
            assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(got._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())


@pytest.mark.parametrize("cells", [None, 40])
def test_an_index_search_equals_a_full_scan_and_skips_balls(spark, tmp_path, cells):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 5
    items = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(600)]
    items += [(600 + i, items[3][1]) for i in range(20)]  # repeated vectors: ties
    df = spark.createDataFrame([*items, (990, None)], "item long, embedding array<double>").withColumn("caption", F.lit("c")).repartition(4)
    index.build(df, str(tmp_path / "i"), balls=16, sample=200)
    queries = [(f"q{i}", v) for i, v in items[::29]]
    asked = spark.createDataFrame([*queries, ("none", None)], "query string, embedding array<double>")
    found, counts = index.search_many(spark, str(tmp_path / "i"), asked, 7, cells)
    assert sorted((r["query"], r["rank"], r["item"], r["score"]) for r in found.collect()) == plain(queries, items, 7)
    n = len({p.name for p in (tmp_path / "i/rows").glob("ball=*")})
    assert counts["read"] + counts["skipped"] == len(queries) * n and counts["skipped"] > counts["read"]
    few, counts = index.search_many(spark, str(tmp_path / "i"), asked.where("query = 'q0'"), 5)
    assert few.count() == 5 and counts["balls_read"] < n / 2


def test_an_index_of_few_or_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item long, embedding array<float>")
    index.build(df, str(tmp_path / "a"))
    asked = df.withColumnRenamed("item", "query")
    found, _ = index.search_many(spark, str(tmp_path / "a"), asked, 5)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]
    index.build(df.limit(0), str(tmp_path / "b"))
    assert index.search_many(spark, str(tmp_path / "b"), asked, 5)[0].collect() == []
    assert index.search_many(spark, str(tmp_path / "a"), asked.limit(0), 5)[0].collect() == []


def test_many_texts_are_searched_as_one_by_one(spark, tmp_path):
    from lumenframe.operators import encoder
    from lumenframe.operators.validate import ValidationError

    rows = spark.createDataFrame([(f"i{i}", f"caption {i}", f"f{i}.mp4", f"text {i}") for i in range(60)], "item string, caption string, file string, content string")
    encoder.build_index(rows, "content", encoder.hash_encoder, "hash", str(tmp_path / "plain"))
    encoder.build_ball_index(rows, "content", encoder.hash_encoder, "hash", str(tmp_path / "balls"), 8)
    asked = spark.createDataFrame([("a", " text 7 "), ("b", "text 50"), ("c", "of no row")], "query string, text string")
    got = encoder.search_texts(spark, str(tmp_path / "balls"), asked, encoder.hash_encoder, "hash", 40)
    assert got.columns == ["query", "rank", "item", "file", "caption", "score"] and got.count() == 72
    for query, text in asked.collect():
        one = encoder.search_index(spark, str(tmp_path / "plain"), text, encoder.hash_encoder, "hash", 40)
        assert sorted(map(tuple, one.collect())) == sorted(tuple(r)[1:] for r in got.where(F.col("query") == query).collect())
    for texts, name in ((spark.createDataFrame([("a", "  ")], "query string, text string"), "hash"), (asked, "other")):
        with pytest.raises(ValidationError):
            encoder.search_texts(spark, str(tmp_path / "balls"), texts, encoder.hash_encoder, name)
