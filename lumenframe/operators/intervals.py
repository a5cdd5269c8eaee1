"""Windows against annotated intervals: overlap labels, label matrices, uncovered events, jittered copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.names import chunk_id
from lumenframe.functions.vectors import overlap

NEGATIVE = "no_violation"


def _cells(events: DataFrame, chunk: float) -> DataFrame:
    """Each event with the numbers of the chunk-wide cells that it touches, one more on either side."""
    cell = lambda x: F.floor(x / F.lit(chunk))
    return events.withColumn("_cell", F.explode(F.sequence(cell(F.col("start_sec")) - 1, cell(F.col("end_sec")))))


def overlap_pairs(windows: DataFrame, events: DataFrame, chunk: float, min_overlap: float, keys: list[str]) -> DataFrame:
    """Windows (keys, start_sec) and events that share ``min_overlap`` seconds or more: window columns, event class.

    An equi-join on keys and time cell keeps a long video's windows from meeting all of its events.
    """
    left = windows.withColumn("_cell", F.floor(F.col("start_sec") / F.lit(chunk)))
    right = _cells(events, chunk).select(*keys, "_cell", F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"), *([] if "class" in keys else ["class"]))
    joined = left.join(right, [*keys, "_cell"])
    return joined.where(overlap(F.col("start_sec"), F.col("start_sec") + F.lit(chunk), F.col("_s"), F.col("_e")) >= F.lit(min_overlap)).drop("_cell", "_s", "_e")


def overlap_labels(windows: DataFrame, events: DataFrame, chunk: float = 2.0, min_overlap: float = 0.5, negative: str = NEGATIVE) -> DataFrame:
    """Windows (video, start_sec, ...) with ``labels``: the sorted classes of overlapping events, else the negative class."""
    found = overlap_pairs(windows.select("video", "start_sec").distinct(), events, chunk, min_overlap, ["video"])
    sets = found.groupBy("video", "start_sec").agg(F.array_sort(F.collect_set("class")).alias("labels"))
    return windows.join(sets, ["video", "start_sec"], "left").withColumn("labels", F.coalesce("labels", F.array(F.lit(negative))))


def label_matrix(grid: DataFrame, events: DataFrame, chunk: float = 2.0, min_overlap: float = 0.5) -> DataFrame:
    """A dense grid (video, class, start_sec, ...) with y: 1 where an event of the class overlaps the window, else 0."""
    hit = overlap_pairs(grid.select("video", "class", "start_sec"), events, chunk, min_overlap, ["video", "class"]).distinct().withColumn("_y", F.lit(1))
    return grid.join(hit, ["video", "class", "start_sec"], "left").withColumn("y", F.coalesce("_y", F.lit(0))).drop("_y")


def complement_label(matrix: DataFrame, negative: str = NEGATIVE) -> DataFrame:
    """Each window's label of the negative class: 1 if no other class has one (video, start_sec, class, y)."""
    return matrix.where(F.col("class") != negative).groupBy("video", "start_sec").agg((1 - F.max("y")).alias("y")).select("video", "start_sec", F.lit(negative).alias("class"), "y")


def uncovered_events(windows: DataFrame, events: DataFrame, chunk: float = 2.0, min_overlap: float = 0.5) -> DataFrame:
    """Events that no window of their video overlaps enough."""
    keyed = events.select("video", "class", "start_sec", "end_sec")
    right = windows.select("video", F.col("start_sec").alias("_w")).withColumn("_cell", F.floor(F.col("_w") / F.lit(chunk)))
    joined = _cells(keyed, chunk).join(right, ["video", "_cell"])
    covered = joined.where(overlap(F.col("_w"), F.col("_w") + F.lit(chunk), F.col("start_sec"), F.col("end_sec")) >= F.lit(min_overlap)).select("video", "class", "start_sec", "end_sec").distinct()
    return keyed.join(covered, ["video", "class", "start_sec", "end_sec"], "left_anti")


def jitter(chunks: DataFrame, events: DataFrame, durations: DataFrame, amount: float = 0.5, chunk: float = 2.0, min_overlap: float = 0.5, negative: str = NEGATIVE, distinct: bool = False) -> DataFrame:
    """Copies of positive training windows moved by plus and minus ``amount``, labelled anew.

    Copies outside the video or no longer positive are left out. Neighbours may give the same copy; ``distinct``
    drops such repeats. Columns: chunk_id, video, split, start_sec, end_sec, labels, jitter.
    """
    positive = chunks.where((F.col("split") == "train") & ~F.array_contains("labels", negative))
    moved = positive.select("video", "split", F.explode(F.array(F.lit(-amount), F.lit(amount))).alias("d"), "start_sec").select("video", "split", (F.col("start_sec") + F.col("d")).alias("start_sec"))
    inside = moved.join(durations, "video").where((F.col("start_sec") >= 0) & (F.col("start_sec") + F.lit(chunk) <= F.col("duration"))).drop("duration")
    labelled = overlap_labels(inside, events, chunk, min_overlap, negative).where(~F.array_contains("labels", negative))
    out = labelled.select(chunk_id(F.col("video"), F.col("start_sec")).alias("chunk_id"), "video", "split", "start_sec", (F.col("start_sec") + F.lit(chunk)).alias("end_sec"), "labels", F.lit(1).alias("jitter"))
    return out.dropDuplicates(["chunk_id"]) if distinct else out


def from_durations(clips: DataFrame) -> DataFrame:
    """Intervals of clips put one after the other: video, class, start_sec (rounded down), end_sec (rounded up).

    ``clips`` has video, pos (order in the video), class (null: filler without an annotation) and duration.
    """
    w = Window.partitionBy("video").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = clips.withColumn("_end", F.sum("duration").over(w))
    return placed.where(F.col("class").isNotNull()).select("video", "class", F.floor(F.col("_end") - F.col("duration")).cast("double").alias("start_sec"), F.ceil("_end").cast("double").alias("end_sec"))


def explode_labels(chunks: DataFrame) -> DataFrame:
    """One row for each chunk and label, keyed ``chunk#class``."""
    return chunks.withColumn("label", F.explode("labels")).select(F.concat_ws("#", "chunk_id", "label").alias("key"), "chunk_id", "label")
