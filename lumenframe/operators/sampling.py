"""Deterministic shuffles, splits and samples in the order of an md5 of seed and id."""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.ranges import numbers

#: First hexadecimal digits of the hash that deal a class over tasks: 16 to that power buckets.
DIGITS = 2


def hash_key(seed: int, *ids: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids)))


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed: int = 0) -> DataFrame:
    """``df`` with ``rank`` (from 1) and ``n`` in its group of ``keys``, in hash order of the id, ties by id.

    The hash's beginning deals each group into buckets. Bucket counts, a few hundred rows a group, give each
    bucket's first rank, so no task sees a whole group.
    """
    hashed = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_b")
    before = counts.select(*keys, "_b", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", id_col))
    ranked = hashed.withColumn("_r", inner).join(before, [*keys, "_b"])
    return ranked.withColumn("rank", (F.col("_r") + F.col("_before")).cast("long")).drop("_h", "_b", "_r", "_before")


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with idx from 0 in order of the id, by ranges of ids that follow the data."""
    return numbers(df, [id_col])


def val_count(n: Column, fraction: float) -> Column:
    """n * fraction rounded half to even, 1 at least, 0 for an empty class."""
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("long"))).otherwise(F.lit(0)).cast("long")


def fraction_split(df: DataFrame, cls: str, id_col: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Each class's first ``val_count`` rows in hash order are ``val``, the others ``train``."""
    ranked = hash_rank(df, [cls], id_col, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= val_count(F.col("n"), fraction), "val").otherwise("train")).drop("rank", "n")


def count_split(df: DataFrame, cls: str, id_col: str, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """Each class's rows in hash order, dealt to the splits by number; rows beyond the last number go.

    ``position`` numbers a class's rows from 1.
    """
    ranked = hash_rank(df, [cls], id_col, seed).where(F.col("rank") <= sum(counts.values()))
    split, top = F.lit(None).cast("string"), 0
    for name, n in counts.items():
        split = F.when((F.col("rank") > top) & (F.col("rank") <= top + n), F.lit(name)).otherwise(split)
        top += n
    return ranked.withColumn("split", split).withColumnRenamed("rank", "position").drop("n")


def split_stats(df: DataFrame, cls: str) -> DataFrame:
    """Rows of each class: total, train, val."""
    part = lambda s: F.count_if(F.col("split") == s).alias(s)
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("total"), part("train"), part("val"))


def downsample_negatives(chunks: DataFrame, positive: Column, group: str, id_col: str, ratio: float = 4.0, seed: int = 42, split: str | None = "train") -> DataFrame:
    """All positive rows and, of each group's others, the first min(negatives, floor(ratio * max(positives, 1))).

    Only rows of ``split`` are thinned out, all rows if it is None.
    """
    flagged = chunks.withColumn("_pos", positive.cast("int"))
    thin = F.lit(True) if split is None else F.coalesce(F.col("split") == split, F.lit(False))
    neg = flagged.where(thin & (F.col("_pos") == 0))
    rest = flagged.where(~thin | (F.col("_pos") == 1)).drop("_pos")
    allowed = flagged.where(thin).groupBy(group).agg(F.floor(F.lit(ratio) * F.greatest(F.sum("_pos"), F.lit(1))).alias("_keep"))
    kept = hash_rank(neg, [group], id_col, seed).join(allowed, group).where(F.col("rank") <= F.col("_keep")).drop("_pos", "_keep", "rank", "n")
    return rest.unionByName(kept.select(rest.columns))


#: Videos that one task assigns.
RANGE_VIDEOS = 1 << 16


class SplitState:
    """How many videos each split has, and which classes; ``choose`` assigns the next video."""

    def __init__(self, targets: dict[str, float], sizes: dict[str, int] | None = None) -> None:
        self.targets, self.names = targets, list(targets)
        self.sizes = dict(sizes or dict.fromkeys(targets, 0))
        self.classes: dict[str, set] = {n: set() for n in targets}

    def room(self, name: str) -> float:
        return self.targets[name] - self.sizes[name]

    def choose(self, classes: list) -> str:
        """The split that lacks most of the classes, then the one with most room; the first of equal ones."""
        lacking = {n: len(set(classes) - self.classes[n]) for n in self.names}
        best = max(self.names, key=lambda n: (lacking[n], self.room(n)))
        self.sizes[best] += 1
        self.classes[best].update(classes)
        return best

    def skip(self, n: int) -> None:
        """``n`` videos of which no split lacks a class go where there is most room: most of them in one step.

        Every split is filled down to a common level of room that no split meets exactly; the few left go one by one.
        """
        rooms = {s: self.room(s) for s in self.names}
        parts = sorted({r % 1 for r in rooms.values()})
        gaps = [((b - a), (a + b) / 2 % 1) for a, b in zip(parts, [*parts[1:], parts[0] + 1], strict=True)]
        offset = max(gaps)[1]
        used = lambda level: {s: max(0, math.floor(r - offset - level)) for s, r in rooms.items()}
        low, high = math.floor(min(rooms.values())) - n - 2, math.ceil(max(rooms.values())) + 1
        while low + 1 < high:  # the lowest level that takes no more than n
            mid = (low + high) // 2
            low, high = (low, mid) if sum(used(mid).values()) <= n else (mid, high)
        taken = used(high)
        for s, k in taken.items():
            self.sizes[s] += k
        for _ in range(n - sum(taken.values())):
            self.sizes[max(self.names, key=self.room)] += 1


def greedy_split(videos: DataFrame, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Assigns each (video, classes) to a split, rarest class first, in hash order among equally rare: video, split.

    Every video goes to the split that lacks most of its classes, then to the one furthest below its target; ties
    go to the split named first. A choice depends on all choices before it, but only few are more than a count: each
    video of which a split lacks a class adds a class to a split, so of any class only the first (classes * splits)
    videos can. Those, a number that follows the classes alone, are chosen first; what lies between them fills the
    splits evenly, so the state at any place follows, and ranges of videos are assigned side by side.
    """
    exploded = videos.select("video", F.explode("classes").alias("c"))
    counts = exploded.groupBy("c").agg(F.count(F.lit(1)).alias("k"))  # a row for each class
    rarity = exploded.join(counts, "c").groupBy("video").agg(F.min("k").alias("rare"))
    rare = videos.join(rarity, "video", "left").withColumn("rare", F.coalesce("rare", F.lit(1 << 30)))
    sizes = rare.groupBy("rare").agg(F.count(F.lit(1)).alias("k"))
    below = sizes.select("rare", (F.sum("k").over(Window.orderBy("rare")) - F.col("k")).alias("below"))  # a row for each count of a class
    ordered = hash_rank(rare, ["rare"], "video", seed).join(below, "rare").select("video", "classes", (F.col("below") + F.col("rank") - 1).alias("place"))
    names, total = list(fractions), videos.count()
    first = counts.count() * len(names)
    early = Window.partitionBy("c").orderBy("place")
    able = ordered.select("place", "classes", F.explode("classes").alias("c")).withColumn("_r", F.row_number().over(early)).where(F.col("_r") <= first)
    special = sorted(((r["place"], r["classes"]) for r in able.select("place", "classes").distinct().collect()), key=lambda x: x[0])  # at most classes squared times splits
    targets = {n: fractions[n] * total for n in names}
    state, place, chosen, marks = SplitState(targets), 0, {}, [(0, dict.fromkeys(names, 0))]
    for at, classes in special:
        state.skip(at - place)
        chosen[at] = state.choose(classes)
        place = at + 1
        marks.append((place, dict(state.sizes)))

    def assign(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("place").to_pylist(), table.column("video").to_pylist(), strict=True))
        begin = rows[0][0]
        mark = marks[bisect.bisect_right(marks, begin, key=lambda m: m[0]) - 1]
        now, out = SplitState(targets, mark[1]), []
        now.skip(begin - mark[0])
        for at, _ in rows:
            if at in chosen:
                now.sizes[chosen[at]] += 1
                out.append(chosen[at])
            else:
                out.append(now.choose([]))
        return pa.table({"video": pa.array([v for _, v in rows], table.schema.field("video").type), "split": pa.array(out, pa.string())})

    ranges = ordered.select("video", "place", F.floor(F.col("place") / RANGE_VIDEOS).alias("range"))
    return ranges.groupBy("range").applyInArrow(assign, f"video {dict(videos.dtypes)['video']}, split string")


def training_set(chunks: DataFrame, positive: Column, jittered: DataFrame, group: str, id_col: str, ratio: float = 4.0, seed: int = 42) -> DataFrame:
    """Training rows: positives, their jittered copies and sampled negatives, repeats kept, with ``origin`` saying which.

    ``chunks`` and ``jittered`` (of the train split) have the same columns but jitter, which is 0 for chunks.
    """
    train = chunks.where(F.col("split") == "train").withColumn("jitter", F.lit(0))
    kept = downsample_negatives(train, positive, group, id_col, ratio, seed).withColumn("origin", F.when(positive, "positive").otherwise("negative"))
    return kept.unionByName(jittered.withColumn("origin", F.lit("jitter")).select(kept.columns))


def joined_splits(df: DataFrame, splits: tuple[str, ...], name: str) -> DataFrame:
    """The rows of several splits as one split, such as val and test as held out; rows of others go."""
    return df.where(F.col("split").isin(*splits)).withColumn("split", F.lit(name))
