"""Linear heads over embeddings: a multinomial probe, one binary head a class, and scoring with fixed heads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot, sigmoid
from lumenframe.operators import fits
from lumenframe.operators.blocked import matrix
from lumenframe.operators.classify import small, zero_shot
from lumenframe.operators.curves import pr_curve
from lumenframe.operators.sampling import hash_rank
from lumenframe.operators.staging import stage


def _balanced(counts: np.ndarray) -> np.ndarray:
    """The weight of each class's rows: rows / (classes * rows of the class), 0 for a class without rows."""
    return np.divide(counts.sum(), len(counts) * counts, out=np.zeros(len(counts)), where=counts > 0)


def macro_f1(cells: np.ndarray) -> float:
    """Mean F1 of the classes that are true or predicted somewhere, from counts [label, pred], rounded as reports are."""
    tp, both = np.diag(cells), cells.sum(axis=0) + cells.sum(axis=1)
    return round(float((2 * tp[both > 0] / both[both > 0]).mean()), 6) if (both > 0).any() else 0.0


def _held_counts(shared) -> Callable:
    """For each model the rows of the fold that it didn't see, by label and predicted class, ties to the first class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        cells = [np.zeros((m.outputs, m.outputs), np.int64) for m in models]
        for b in batches:
            x, y, fold = matrix(b["embedding"]), matrix(b["y"]).astype(np.int64)[:, 0], b["fold"].to_numpy()
            for m, c in zip(models, cells, strict=True):
                rows = np.flatnonzero(fold == m.without)
                np.add.at(c, (y[rows], (x[rows] @ m.x[:, :-1].T + m.x[:, -1]).argmax(axis=1)), 1)
        for i, c in enumerate(cells):
            label, pred = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), i)), pa.array(label), pa.array(pred), pa.array(c[label, pred])], ["model", "label", "pred", "n"])

    return run


def linear_probe(train: DataFrame, grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0), folds: int = 5, seed: int = 0) -> tuple[DataFrame, float]:
    """A multinomial logistic probe with balanced classes: (class, w, b) rows and the C of best macro F1.

    ``train`` is item, label (ints), embedding. Folds are stratified by hash order, no more than the smallest
    class has rows, two at least; of equal C the first wins. One class or none gives no rows and the first C.
    All folds of all C are fitted together, and so are the models of all C to all rows, of which the best one stays.
    """
    spark, kind = train.sparkSession, dict(train.dtypes)["label"]
    stats = train.groupBy("label").count().collect()  # a row for each class
    labels = sorted(r["label"] for r in stats)
    if len(labels) < 2:
        return spark.createDataFrame([], f"class {kind}, w array<double>, b double"), grid[0]
    number = {c: i for i, c in enumerate(labels)}
    index = F.element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), F.col("label"))
    k = max(2, min(folds, min(r["count"] for r in stats)))
    dealt = hash_rank(train, ["label"], "item", seed)
    rows = stage(dealt.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.array(index.cast("int")).alias("y"), ((F.col("rank") - 1) % k).cast("int").alias("fold")), "probe-rows")
    dim = rows.select(F.max(F.size("embedding"))).first()[0]
    counts = np.zeros((k, len(labels)))
    for r in rows.groupBy("fold", F.col("y")[0].alias("y")).count().collect():  # a row for each class and fold
        counts[r["fold"], r["y"]] = r["count"]
    whole = [fits.Model(len(labels), c, _balanced(counts.sum(axis=0))) for c in grid]
    tried = [fits.Model(len(labels), c, _balanced(counts.sum(axis=0) - counts[f]), without=f) for c in grid for f in range(k)] if len(grid) > 1 else []
    fits.fit(rows, whole + tried, dim)
    best = 0
    if tried:
        cells = np.zeros((len(tried), len(labels), len(labels)), np.int64)
        shared = spark.sparkContext.broadcast(tried)
        seen = rows.mapInArrow(_held_counts(shared), "model long, label long, pred long, n long").groupBy("model", "label", "pred").agg(F.sum("n").alias("n"))
        for r in seen.collect():  # models times classes squared
            cells[r["model"], r["label"], r["pred"]] = r["n"]
        score = [sum(macro_f1(cells[i * k + f]) for f in range(k)) / k for i in range(len(grid))]
        for i in range(1, len(grid)):
            best = i if score[i] > score[best] + 1e-12 else best
    w = whole[best].x
    return spark.createDataFrame([(labels[i], w[i, :-1].tolist(), float(w[i, -1])) for i in range(len(labels))], f"class {kind}, w array<double>, b double"), grid[best]


def train_heads(train: DataFrame, val: DataFrame, classes: list, grid: tuple[float, ...] = (0.01, 0.1, 1.0), recall_floor: float = 0.95, precision_floor: float = 0.9, encoder: str = "unknown") -> DataFrame:
    """One balanced binary head for each class: class, w, b, t_lo, t_hi, c_reg, encoder.

    ``train`` and ``val`` are item, embedding and labels (array of classes). C is chosen by average precision on
    ``val``, the largest of equal ones; without positives there, it is the smallest. A class without positives in
    ``train`` gets b = -10, one without negatives b = 10, both with t_lo = t_hi = 1. All classes and all C are fitted
    together and scored on ``val`` in one pass.
    """
    spark, kind = train.sparkSession, "string" if classes and isinstance(classes[0], str) else "int"
    schema = f"class {kind}, w array<double>, b double, t_lo double, t_hi double, c_reg double, encoder string"
    marks = F.array(*(F.array_contains("labels", c).cast("int") for c in classes)).cast("array<int>")
    rows = stage(train.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.transform(marks, lambda x: F.coalesce(x, F.lit(0))).alias("y"), F.lit(0).alias("fold")), "head-rows")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), *(F.sum(F.col("y")[i]).alias(f"p{i}") for i in range(len(classes)))).first()
    n, dim = sums["n"], sums["dim"] or 0
    hits = [sums[f"p{i}"] or 0 for i in range(len(classes))]
    models = [fits.Model(1, c, _balanced(np.array([n - hits[i], hits[i]])), target=i) for i in range(len(classes)) if 0 < hits[i] < n for c in sorted(grid)]
    fits.fit(rows, models, dim)
    found: dict[int, list] = {}
    if models:
        heads = spark.createDataFrame([(i, m.x[0, :-1].tolist(), float(m.x[0, -1]), m.target) for i, m in enumerate(models)], "class int, w array<double>, b double, target int")
        held = val.select("item", "embedding", F.transform(marks, lambda x: F.coalesce(x, F.lit(0))).alias("y"))
        curve = stage(pr_curve(apply_heads(held, heads).join(small(heads.select("class", "target")), "class").select("class", "score", F.get("y", F.col("target")).alias("y"))), "head-curves")
        ap = F.when(F.max("npos") > 0, F.round(F.sum(F.try_divide("hits", "npos") * F.col("precision")), 12))
        lo = F.coalesce(F.max(F.when(F.col("recall") >= recall_floor, F.col("threshold"))), F.lit(0.0))
        hi = F.coalesce(F.min(F.when(F.col("precision") >= precision_floor, F.col("threshold"))), F.lit(1.0))
        told = {r["class"]: r for r in curve.groupBy("class").agg(ap.alias("ap"), lo.alias("lo"), hi.alias("hi")).collect()}  # a row for each model
        for i, m in enumerate(models):
            r = told.get(i)
            score = r["ap"] if r else None
            best = found.get(m.target)
            if best is None or score is not None and score >= (best[0] or 0.0):
                found[m.target] = [score, m, r["lo"] if r else 0.0, r["hi"] if r else 1.0]
    out = []
    for i, cls in enumerate(classes):
        if i in found:
            _, m, lo, hi = found[i]
            out.append((cls, m.x[0, :-1].tolist(), float(m.x[0, -1]), float(lo), float(hi), float(m.c), encoder))
        else:
            out.append((cls, [0.0] * dim, 10.0 if hits[i] and hits[i] == n else -10.0, 1.0, 1.0, float(grid[0]), encoder))
    return spark.createDataFrame(out, schema)


def apply_heads(windows: DataFrame, heads: DataFrame) -> DataFrame:
    """Probability of every head for every row: the rows' columns but the vector, class, score."""
    h = small(heads.select("class", "w", "b"))
    return windows.join(h).select(*(c for c in windows.columns if c != "embedding"), "class", sigmoid(dot(F.col("embedding"), F.col("w")) + F.col("b")).alias("score"))


def by_class_index(weights: DataFrame, classes: int, dim: int) -> DataFrame:
    """A probe's rows (class, a whole number from 0; w, b) for every one of ``classes``: those it never saw have zeros, hence logit 0."""
    every = weights.sparkSession.range(classes).select(F.col("id").cast(dict(weights.dtypes)["class"]).alias("class"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return every.join(small(weights.select("class", "w", "b")), "class", "left").select("class", F.coalesce("w", zero).alias("w"), F.coalesce("b", F.lit(0.0)).alias("b"))


def probe_predictions(items: DataFrame, weights: DataFrame) -> DataFrame:
    """``items`` (item, label, embedding, ...) with pred, the class of the largest logit, ties to the smallest class."""
    biased = weights.select("class", F.concat("w", F.array("b")).alias("embedding"))
    return zero_shot(items.withColumn("embedding", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(1.0)))), biased).drop("score")


def positives(items: DataFrame, classes: DataFrame, least: int = 10) -> DataFrame:
    """Rows with each class among their labels, by split, zeros included: class, train_pos, val_pos and warn.

    ``items`` has split and labels (array); ``warn`` is 1 if fewer than ``least`` train rows have the class, too few for a head.
    """
    one = items.select("split", F.explode(F.array_distinct("labels")).alias("class"))
    n = one.groupBy("class").agg(*(F.count_if(F.col("split") == s).alias(f"{s}_pos") for s in ("train", "val")))
    out = classes.select("class").distinct().join(n, "class", "left")
    train = F.coalesce("train_pos", F.lit(0))
    return out.select("class", train.alias("train_pos"), F.coalesce("val_pos", F.lit(0)).alias("val_pos"), (train < least).cast("int").alias("warn"))
