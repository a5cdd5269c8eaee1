"""Ranked retrieval: top-k search, per-item ranks, recall at k, mean average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot, half_up
from lumenframe.operators.ranges import running_sums


def search(index: DataFrame, query: DataFrame, k: int = 5, id_col: str = "item") -> DataFrame:
    """The ``k`` rows of ``index`` most similar to the one vector of ``query`` (embedding): rank and score first.

    k is clamped to 1..24; ties go to the smaller id. Each task keeps its own best k, as in a top-k sort.
    """
    k = max(1, min(24, k))
    q = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))  # one row
    best = index.join(q).withColumn("score", dot(F.col("embedding"), F.col("_q"))).drop("_q", "embedding").orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # k rows


def ranked(scores: DataFrame, by: str, order: str) -> DataFrame:
    """Scores with ``rank`` from 1 in each group of ``by``, best first, ties to the smaller ``order``."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order)))


def retrieval_log(scores: DataFrame, top: int = 10) -> DataFrame:
    """Each item's ``top`` best classes, all if there are fewer: item, label, rank, class, score, hit."""
    return ranked(scores, "item", "class").where(F.col("rank") <= top).select("item", "label", "rank", "class", half_up("score", 6).alias("score"), (F.col("class") == F.col("label")).cast("int").alias("hit"))


def item_recall(scores: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of items whose own class is among the k best: n and r_at_k, one row."""
    mine = ranked(scores, "item", "class").where(F.col("class") == F.col("label"))
    return mine.agg(F.count(F.lit(1)).alias("n"), *(half_up(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"r_at_{k}") for k in ks))


def class_ranking(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Each class's ranking of all items: class, n_rel, first_rank, ap and hit_at_k; classes without items are left out.

    Average precision is by rank, without grouping ties, over all relevant items. An item's rank is the number of
    items above it, and precision at a relevant item takes only its rank and its number among relevant ones; both
    are sums by ranges of scores.
    """
    marked = scores.select("class", "item", "score", F.lit(1).alias("_one"), (F.col("class") == F.col("label")).cast("int").alias("_rel"))
    r = running_sums(marked, ["class"], {"rank": "_one", "m": "_rel"}, ties=("item",)).where("_rel = 1")
    return r.groupBy("class").agg(F.count(F.lit(1)).alias("n_rel"), F.min("rank").alias("first_rank"), F.avg(F.col("m") / F.col("rank")).alias("ap"), *((F.min("rank") <= k).cast("int").alias(f"hit_at_{k}") for k in ks))


def class_recall(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of classes with a relevant item among the k best, mean average precision and median first rank, one row."""
    c = class_ranking(scores, ks)
    return c.agg(*(half_up(F.avg(f"hit_at_{k}"), 6).alias(f"r_at_{k}") for k in ks), half_up(F.avg("ap"), 6).alias("map"), F.percentile("first_rank", 0.5).alias("median_first_rank"))
