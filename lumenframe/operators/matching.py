"""Predicted against annotated events: greedy temporal-IoU matching and the scores that follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import prf, temporal_iou

BY = ["video", "class"]
#: Pairs of a prediction and an event up to which an island is one fold.
FOLD_PAIRS = 4096


def choose(p: np.ndarray, t: np.ndarray, iou: float) -> int:
    """How many of the predictions (start, end), in the order of their choice, get an event of ``t`` (start, end), in order of pos.

    An event of IoU ``iou`` or more is at most 1 / iou times as long as the prediction, so it begins no earlier than
    that before its start, and before its end.
    """
    order = np.argsort(t[:, 0], kind="stable")
    starts, free, hits = t[order, 0], np.ones(len(t), bool), 0
    for s, e in p:
        low, high = np.searchsorted(starts, s - abs(e - s) * (1 / iou) * (1 + 1e-9) - 1e-9), np.searchsorted(starts, e)
        at = order[low:high]
        at = at[free[at]]
        if len(at):
            both = np.maximum(0.0, np.minimum(e, t[at, 1]) - np.maximum(s, t[at, 0]))
            score = both / (np.maximum(e, t[at, 1]) - np.minimum(s, t[at, 0]))
            fit = np.flatnonzero(score >= iou)
            if len(fit):
                best = at[fit[score[fit] == score[fit].max()]].max()
                free[best] = False
                hits += 1
    return hits


def _matched(keys: list[str], iou: float) -> Callable:
    """Islands (keys, p, t) to their numbers: those matched are taken off the predictions and events that ``match_events`` has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda x: np.array([(y["s"], y["e"]) for y in x.as_py()], np.float64).reshape(-1, 2)
        for b in batches:
            hits = np.array([choose(pairs(p), pairs(t), iou) for p, t in zip(b["p"], b["t"], strict=True)], np.int64)
            zero = pa.array(np.zeros(len(hits), np.int64))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), zero, zero, pa.array(-hits)], [*keys, "n_p", "n_t", "left"])

    return run


def match_events(pred: DataFrame, truth: DataFrame, iou: float = 0.3, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of each video and class that has predicted or true events.

    Predictions (start_sec, end_sec, peak) choose in order of peak, then time; each takes the free true event
    (start_sec, end_sec, pos) with the highest IoU of ``iou`` or more, the last in order of pos if several have it.
    Only events that overlap can match, for ``iou`` is above 0. So the events of a video and class fall into islands
    with nothing between them, and one fold over the lists of an island, in order of peak, chooses as one over the
    whole lists would; the work follows the overlaps, not the product of the lists.
    """
    if iou <= 0:
        raise ValueError("iou must be above 0")
    keys = keys or BY
    pos = dict(truth.dtypes)["pos"]
    double = lambda c: F.col(c).cast("double")
    p = pred.select(*keys, double("start_sec").alias("s"), double("end_sec").alias("e"), (-F.col("peak")).alias("o"), F.lit(None).cast(pos).alias("pos"), F.lit(True).alias("guess"))
    t = truth.select(*keys, double("start_sec").alias("s"), double("end_sec").alias("e"), F.lit(None).cast(dict(p.dtypes)["o"]).alias("o"), "pos", F.lit(False).alias("guess"))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = p.unionByName(t).withColumn("_new", F.when(F.col("s") < reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    guess, real = F.when(F.col("guess"), F.struct("o", "s", "e")), F.when(~F.col("guess"), F.struct("pos", "s", "e"))
    both = placed.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(guess)).alias("p"), F.array_sort(F.collect_list(real)).alias("t"))

    def step(free, x):  # noqa: ANN001, ANN202
        start = F.struct(F.lit(iou).alias("iou"), F.lit(None).cast(dict(truth.dtypes)["pos"]).alias("pos"))
        best = F.aggregate(free, start, lambda a, g: F.when(temporal_iou(x["s"], x["e"], g["s"], g["e"]) >= a["iou"], F.struct(temporal_iou(x["s"], x["e"], g["s"], g["e"]).alias("iou"), g["pos"].alias("pos"))).otherwise(a))
        return F.element_at(F.transform(F.array(best["pos"]), lambda taken: F.filter(free, lambda g: taken.isNull() | (g["pos"] != taken))), 1)

    free = F.aggregate(F.col("p"), F.col("t"), step)
    some, many = (F.size("p") > 0) & (F.size("t") > 0), F.size("p").cast("long") * F.size("t") > FOLD_PAIRS
    counted = both.select(*keys, F.size("p").cast("long").alias("n_p"), F.size("t").cast("long").alias("n_t"), F.when(some & ~many, F.size(free)).otherwise(F.size("t")).cast("long").alias("left"))
    large = both.where(many).select(*keys, F.transform("p", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("p"), F.transform("t", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("t"))
    kinds = ", ".join(f"`{k}` {dict(large.dtypes)[k]}" for k in keys)
    more = large.mapInArrow(_matched(keys, iou), f"{kinds}, n_p long, n_t long, left long")
    done = counted.unionByName(more)
    return done.groupBy(*keys).agg(F.sum(F.col("n_t") - F.col("left")).alias("tp"), F.sum(F.col("n_p") - F.col("n_t") + F.col("left")).alias("fp"), F.sum("left").alias("fn"))


def event_scores(matches: DataFrame) -> DataFrame:
    """Sums and precision, recall, F1 of each class, and of all together as class ``micro``."""
    sums = matches.rollup("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(F.coalesce("class", F.lit("micro")).alias("class"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
