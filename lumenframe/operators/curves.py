"""Precision-recall curves over scored windows (class, score, y), average precision and the unknown band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.vectors import half_up
from lumenframe.operators.classify import small
from lumenframe.operators.ranges import running_sums


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score of each class, ties taken together: class, threshold, tp, n, npos, precision, recall.

    Rows with equal scores are merged before the shuffle, and summed up by ranges of scores. Classes without a positive have null recall. The point
    (recall 0, precision 1) is not a threshold and is left out.
    """
    g = scored.groupBy("class", F.col("score").alias("threshold")).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("rows"))
    c = running_sums(g, ["class"], {"tp": "hits", "n": "rows"}, "threshold", wholes={"npos": "tp"}).select("class", "threshold", "hits", "tp", "n", "npos")
    return c.withColumn("precision", F.col("tp") / F.col("n")).withColumn("recall", F.when(F.col("npos") > 0, F.col("tp") / F.col("npos")))


def average_precision(curve: DataFrame, digits: int = 4) -> DataFrame:
    """Step-wise average precision of each class (null without positives): class, support, ap."""
    ap = F.sum(F.try_divide(F.col("hits"), F.col("npos")) * F.col("precision"))
    return curve.groupBy("class").agg(F.max("npos").alias("support"), F.when(F.max("npos") > 0, half_up(ap, digits)).alias("ap"))


def precision_at_recall(curve: DataFrame, floor: float = 0.9, digits: int = 4) -> DataFrame:
    """The best precision at a recall of ``floor`` or more, 0 if there is none; null without positives."""
    best = F.coalesce(F.max(F.when(F.col("recall") >= floor, F.col("precision"))), F.lit(0.0))
    return curve.groupBy("class").agg(F.when(F.max("npos") > 0, half_up(best, digits)).alias("precision_at_recall"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """Mean of the rounded average precisions of classes with support; null if there are none."""
    return ap.agg(half_up(F.avg("ap"), 4).alias("map"))


def unknown_band(curve: DataFrame, recall_floor: float = 0.95, precision_floor: float = 0.9) -> DataFrame:
    """t_lo, the highest threshold with enough recall (else 0), and t_hi, the lowest with enough precision (else 1).

    ``crossed`` is 1 if the band is empty.
    """
    lo = F.coalesce(F.max(F.when(F.col("recall") >= recall_floor, F.col("threshold"))), F.lit(0.0))
    hi = F.coalesce(F.min(F.when(F.col("precision") >= precision_floor, F.col("threshold"))), F.lit(1.0))
    return curve.groupBy("class").agg(lo.alias("t_lo"), hi.alias("t_hi")).withColumn("crossed", (F.col("t_lo") >= F.col("t_hi")).cast("int"))


def cooccurrence(matrix: DataFrame, thresholds: DataFrame, default: float = 0.25) -> DataFrame:
    """For true class i and class j: windows with label i whose score of j reaches j's threshold: i, j, n; zeros included.

    ``matrix`` has video, start_sec, class, score, y. Windows are gathered into arrays of their few classes first.
    """
    t = small(thresholds.select("class", "threshold"))
    marked = matrix.join(t, "class", "left").select("video", "start_sec", "class", "y", (F.col("score") >= F.coalesce("threshold", F.lit(default))).cast("long").alias("p"))
    cell = marked.groupBy("video", "start_sec").agg(F.collect_list(F.struct("class", "y", "p")).alias("c"))
    pairs = cell.select(F.explode("c").alias("i"), "c").select("i", F.explode("c").alias("j"))
    return pairs.groupBy(F.col("i.class").alias("i"), F.col("j.class").alias("j")).agg(F.sum(F.col("i.y") * F.col("j.p")).cast("long").alias("n"))
