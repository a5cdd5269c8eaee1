"""Greedy matching against a plain loop, with islands, ties, long events and long lists; numbers of documents in the JVM."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import matching, reports


def plain(pred, truth, iou):
    out = {}
    for key in {r[:2] for r in pred} | {r[:2] for r in truth}:
        p = sorted((r for r in pred if r[:2] == key), key=lambda r: (-r[4], r[2], r[3]))
        free = sorted((r for r in truth if r[:2] == key), key=lambda r: r[4])
        n, hits = len(free), 0
        for x in p:
            best, at = iou, None
            for g in free:
                both = max(0.0, min(x[3], g[3]) - max(x[2], g[2]))
                score = both / (max(x[3], g[3]) - min(x[2], g[2]))
                if score >= best:
                    best, at = score, g
            if at:
                free.remove(at)
                hits += 1
        out[key] = (hits, len(p) - hits, n - hits)
    return out


def random_events(rng, n, long=0.1):
    def one(i):
        s = rng.randrange(0, 4 * n) / 2
        return ("v" if i % 3 else "w", "c" if i % 2 else "d", s, s + rng.choice([1, 1.5, 2, 4]) * (20 if rng.random() < long else 1))

    return [(*one(i), rng.choice([0.5, 0.7, rng.random()])) for i in range(n)], [(*one(i), i) for i in range(n)]


def match(spark, pred, truth, iou):
    p = spark.createDataFrame(pred, "video string, class string, start_sec double, end_sec double, peak double").repartition(3)
    t = spark.createDataFrame(truth, "video string, class string, start_sec double, end_sec double, pos long").repartition(3)
    return {(r["video"], r["class"]): (r["tp"], r["fp"], r["fn"]) for r in matching.match_events(p, t, iou).collect()}


@pytest.mark.parametrize("fold", [0, 6, 4096])
@pytest.mark.parametrize("iou,long", [(0.3, 0.1), (0.05, 0.5), (0.9, 0.0)])
def test_islands_choose_as_whole_lists(spark, monkeypatch, fold, iou, long):
    monkeypatch.setattr(matching, "FOLD_PAIRS", fold)
    pred, truth = random_events(random.Random(int(iou * 100)), 120, long)
    truth += [("only", "c", 0.0, 1.0, 1)]
    pred += [("lone", "c", 0.0, 1.0, 0.5), ("tie", "c", 0.0, 2.0, 0.5)]
    truth += [("tie", "c", 0.0, 1.0, 5), ("tie", "c", 1.0, 2.0, 9)]
    assert match(spark, pred, truth, iou) == plain(pred, truth, iou)


def test_no_events_and_no_overlap_allowed(spark):
    assert match(spark, [], [], 0.3) == {}
    with pytest.raises(ValueError):
        match(spark, [], [], 0.0)


def test_ten_thousand_events_of_one_video(spark):
    """One prediction covers the whole video and so joins all events; time still grows with the events, not their square."""
    def events(n):
        pred = [("v", "c", i * 3.0, i * 3.0 + 2, 0.5 + i % 7 / 20) for i in range(n)] + [("v", "c", 0.0, 3.0 * n, 0.1)]
        return pred, [("v", "c", i * 3.0 + 0.5, i * 3.0 + 2.5, i) for i in range(n)]

    assert match(spark, *events(10_000), 0.3) == {("v", "c"): (10_000, 1, 0)}
    took = []
    for n in (10_000, 40_000):
        pred, truth = (np.array([r[2:4] for r in x]) for x in events(n))
        began = time.process_time()
        assert matching.choose(pred, truth, 0.3) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_numbers_are_read_without_a_python_worker(spark):
    docs = [{"b": {"A": 1, "a": 2, "x.": 3}, "A": {"y": 1e-7}, "a.y": 5, "t": "7", "l": [{"k": 1}], "e": {}, "f": False}, {"big": 123456789012345678901234567890}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("",)], "t string")
    out = df.select(reports.flatten_json(F.col("t")).alias("f"))
    assert [r["f"] for r in out.collect()] == [{"b.a": 2.0, "b.x": 3.0, "a.y": 1e-7, "f": 0.0}, {"big": 1.2345678901234568e29}, None]
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


def test_a_document_is_parsed_once(spark):
    from lumenframe.plans import catalog

    plan = catalog.queries()["flatten_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.lower().count("parsejson("), plan.count("aggregate(")) == (1, 1)


def test_numbers_of_a_document_with_keys_that_meet(spark):
    """Dotted keys meet those of nested objects, in the same level and across levels; no row for documents without numbers."""
    doc = json.dumps({f"k{i}": {"a": i, "A": -i} for i in range(150)} | {f"K{i}.a": 0 for i in range(150)} | {"n": None, "s": "5"})
    df = spark.createDataFrame([(0, doc), (1, '{"t": [1]}'), (2, None)], "i int, t string")
    got = df.select("i", F.explode_outer(reports.flatten_json(F.col("t")))).where("key IS NOT NULL").collect()
    assert {(r["i"], r["key"]): r["value"] for r in got} == {(0, f"k{i}.a"): float(i) for i in range(150)} and len(got) == 150
