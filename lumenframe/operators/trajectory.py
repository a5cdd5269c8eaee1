"""Score trajectories (video, class, start_sec, score): smoothing, thresholds, runs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import half_up
from lumenframe.operators.classify import small
from lumenframe.operators.ranges import numbers
from lumenframe.operators.series import merged_runs, with_halo
from lumenframe.operators.validate import ValidationError, require_empty

BY = ["video", "class"]
#: Smoothed scores are rounded to so many digits, so that a threshold doesn't split what two ways of halving give.
DIGITS = 9


def smooth(scores: DataFrame, window: int) -> DataFrame:
    """Scores replaced by the median of the 2 * (window // 2) + 1 rows about each; frames shrink at the ends.

    A window of 1 or less leaves scores as they are; the median of an even number of rows is the middle two's mean.
    A long series is smoothed in blocks.
    """
    if window <= 1:
        return scores
    half = window // 2
    w = Window.partitionBy(*BY, "_block").orderBy("start_sec").rowsBetween(-half, half)
    smoothed = with_halo(scores, BY, half).withColumn("score", F.percentile("score", 0.5).over(w)).withColumn("score", half_up("score", DIGITS))
    return smoothed.where("_own").select(scores.columns)


def runs(flagged: DataFrame, flag: Column, keys: list[str] | None = None, min_run: int = 1, chunk: float = 2.0, value: str = "score") -> DataFrame:
    """Maximal runs of flagged rows, adjacent by position: keys, start_sec, end_sec, peak, mean, n_windows.

    A run ends ``chunk`` seconds after its last window's start; runs of fewer than ``min_run`` windows are left out.
    """
    found = merged_runs(flagged, flag, keys or BY, value).select(*(keys or BY), F.col("start").alias("start_sec"), (F.col("last") + F.lit(chunk)).alias("end_sec"), "peak", "mean", "n_windows")
    return found.where(F.col("n_windows") >= min_run if isinstance(min_run, int) else min_run)


def events(scores: DataFrame, thresholds: DataFrame, mode: str = "glue", chunk: float = 2.0, digits: int = 6) -> DataFrame:
    """Events of each video and class by its own (class, threshold, window, min_consec).

    ``glue`` smooths with the class's window and asks for min_consec windows; ``isolated`` takes raw scores and
    single windows. Classes without thresholds have no events. Each distinct window is smoothed once.
    """
    t = small(thresholds.select("class", "threshold", "window", "min_consec"))  # a row for each class
    joined = scores.join(t, "class")
    if mode == "glue":
        sizes = [r[0] for r in thresholds.select("window").where("window > 1").distinct().collect()]  # a few window sizes
        w = Window.partitionBy(*BY, "_block").orderBy("start_sec")
        score = F.col("score")
        for size in sizes:
            score = F.when(F.col("window") == size, F.percentile("score", 0.5).over(w.rowsBetween(-(size // 2), size // 2))).otherwise(score)
        if sizes:
            cut = F.when(F.col("window") > 1, half_up("score", DIGITS)).otherwise(F.col("score"))
            joined = with_halo(joined, BY, max(sizes) // 2).withColumn("score", score).where("_own").withColumn("score", cut).drop("_own", "_block")
    keys = [*BY, "min_consec"]
    found = runs(joined, F.col("score") >= F.col("threshold"), keys, 1, chunk)
    found = found.where(F.col("n_windows") >= F.col("min_consec")) if mode == "glue" else found
    return found.select(*BY, "start_sec", "end_sec", half_up("peak", digits).alias("peak"), half_up("mean", digits).alias("mean"), "n_windows")


def flags(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """1 where a score reaches its class's threshold, inclusive, else 0: video, class, start_sec, flag."""
    t = small(thresholds.select("class", "threshold"))
    return scores.join(t, "class").select(*BY, "start_sec", (F.col("score") >= F.col("threshold")).cast("int").alias("flag"))


def wide(long: DataFrame, classes: list[str], value: str) -> DataFrame:
    """A column for each class, in the given order; missing cells are null."""
    return long.groupBy("video", "start_sec").pivot("class", classes).agg(F.first(value))


def unknown_flags(probs: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with ``unknown``: t_lo <= p < t_hi, and ``decision``: positive, negative or unknown."""
    joined = probs.join(small(heads.select("class", "t_lo", "t_hi")), "class")
    band = (F.col("score") >= F.col("t_lo")) & (F.col("score") < F.col("t_hi"))
    decision = F.when(F.col("score") >= F.col("t_hi"), "positive").when(band, "unknown").otherwise("negative")
    return joined.withColumn("unknown", band.cast("int")).withColumn("decision", decision).drop("t_lo", "t_hi")


def unknown_rate(flagged: DataFrame, warn: float = 0.2) -> DataFrame:
    """Share of unknown windows of each class, rounded, and whether it is above ``warn``."""
    rate = F.avg(F.col("unknown").cast("double"))
    return flagged.groupBy("class").agg(half_up(rate, 4).alias("unknown_rate"), (rate > warn).cast("int").alias("warn"))


def review_queue(flagged: DataFrame, negative: str, min_run: int = 2, chunk: float = 2.0) -> DataFrame:
    """Runs of unknown windows of violations, for review, with their rank: highest peak_p first, ties in order of video, class and time."""
    found = runs(flagged.where(F.col("class") != negative), F.col("unknown") == 1, None, min_run, chunk)
    queue = found.select(*BY, "start_sec", "end_sec", half_up("peak", 6).alias("peak_p"))
    return numbers(queue, [F.desc("peak_p"), *BY, "start_sec"], "rank").withColumn("rank", F.col("rank") + 1).orderBy("rank")


def concatenated(parts: list[DataFrame], classes: list[str]) -> DataFrame:
    """The wide score tables (video, start_sec, a column for each class) of several sources as one long table: video, class, start_sec, score.

    Columns are taken by name, in any order; a part without one of the classes is an error, and so is a video that two
    parts have. Columns of other classes are left out, null scores stay null. No parts are an error.
    """
    if not parts:
        raise ValidationError("no tables to concatenate")
    for i, part in enumerate(parts):
        if lacking := [c for c in classes if c not in part.columns]:
            raise ValidationError(f"table {i} has no column {lacking[0]}")
    seen = None
    for i, part in enumerate(parts):
        one = part.select("video").distinct().withColumn("_part", F.lit(i))
        seen = one if seen is None else seen.unionByName(one)
    require_empty(seen.groupBy("video").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("video"), "videos in several tables")
    out = None
    for part in parts:
        long = part.select("video", F.col("start_sec").cast("double").alias("start_sec"), *(F.col(f"`{c}`").cast("double").alias(c) for c in classes)).unpivot(["video", "start_sec"], classes, "class", "score")
        out = long if out is None else out.unionByName(long)
    return out.select(*BY, "start_sec", "score")
