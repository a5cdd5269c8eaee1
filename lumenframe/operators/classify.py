"""Zero-shot classification against prompt vectors, and its reports.

``items``: item, label, embedding; ``prompts``: class, embedding (few rows: one for each class).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot, half_up, l2_normalize

#: Rows and bytes of a side up to which it is fetched once and broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16 << 20


def class_prototypes(items: DataFrame) -> DataFrame:
    """Unit mean vector of each label's items: class, embedding. Sums are partial before the shuffle."""
    mean = items.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return mean.groupBy(F.col("label").alias("class")).agg(vector.alias("v")).select("class", l2_normalize(F.col("v")).alias("embedding"))


def few_rows(df: DataFrame, limit: int | None = None) -> pa.Table | None:
    """``df`` as an Arrow table if it has ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` at most, else None.

    Rows are counted by bytes before any comes to the driver, so that long vectors are not fetched only to be too many.
    """
    most, text = limit or BROADCAST_ROWS, lambda c, t: F.size(c) * 8 if t.startswith("array") else F.length(F.col(c).cast("string"))
    size = sum((F.coalesce(text(c, t).cast("long"), F.lit(0)) + 8 for c, t in df.dtypes), F.lit(0))
    rows = df.limit(most + 1).withColumn("_size", F.sum(size).over(Window.partitionBy())).where(F.col("_size") <= BROADCAST_BYTES)
    found = rows.drop("_size").toArrow()
    if 0 < found.num_rows <= most:
        return found
    return None if found.num_rows or df.limit(1).count() else found


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` computed once and marked for broadcast if it is small in rows and bytes (``few_rows``); else as it was."""
    rows = few_rows(df, limit)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows is not None else df


def scores(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every item's dot product with every prompt: the items' columns but the vector, class, score."""
    p = prompts.select(F.col("class"), F.col("embedding").alias("_p"))
    few = few_rows(p)
    if few is None:
        from lumenframe.operators.blocked import all_scores

        return all_scores(items, prompts)
    p = F.broadcast(items.sparkSession.createDataFrame(few, p.schema))
    return items.join(p).select(*(c for c in items.columns if c != "embedding"), "class", dot(F.col("embedding"), F.col("_p")).alias("score"))


def zero_shot(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """Items with pred and score: the class of the most similar prompt, ties to the smallest class; no prompt: no rows.

    Up to ``BROADCAST_BYTES`` of prompts are one array that meets each item in its row, without a shuffle; more go in
    blocks (``top_prompts``), where all vectors have one length.
    """
    keys = [c for c in items.columns if c != "embedding"]
    few = few_rows(prompts.select("class", F.col("embedding").alias("v")))
    if few is not None:
        spark, kind = items.sparkSession, dict(prompts.dtypes)
        few = spark.createDataFrame(few, f"class {kind['class']}, v {kind['embedding']}")
        one = F.broadcast(few.agg(F.array_sort(F.collect_list(F.struct("class", "v"))).alias("_p")))  # one row of bounded size
        scored = F.transform("_p", lambda p: F.struct(p["class"].alias("class"), dot(F.col("embedding"), p["v"]).alias("score")))
        first = F.lit(None).cast(f"struct<class: {kind['class']}, score: double>")
        best = F.reduce(scored, first, lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
        return items.join(one).select(*keys, best.alias("_b")).where("_b IS NOT NULL").select(*keys, F.col("_b.class").alias("pred"), F.col("_b.score").alias("score"))
    from lumenframe.operators.blocked import top_prompts

    return top_prompts(items, prompts).select(*keys, F.col("class").alias("pred"), "score")


def with_captions(items: DataFrame, captions: DataFrame, key: str = "label", caption: str = "caption") -> DataFrame:
    """``items`` with the caption of their ``key``, null where ``captions`` (key, caption) has none; one row a key, as ``ambiguous`` checks."""
    return items.join(small(captions.select(key, caption)), key, "left")


def accuracy(pred: DataFrame) -> DataFrame:
    """n and accuracy; null without rows."""
    return pred.agg(F.count(F.lit(1)).alias("n"), half_up(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


def confusion(pred: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts for every pair of classes, zeros included: label, pred, n. ``classes`` (class) is the list of classes."""
    spine = classes.select(F.col("class").alias("label")).join(small(classes.select(F.col("class").alias("pred"))))
    counts = pred.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("c"))
    return spine.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def confusion_wide(cells: DataFrame, classes: list) -> DataFrame:
    """The confusion matrix with a column for each predicted class."""
    return cells.groupBy("label").pivot("pred", classes).agg(F.first("n"))


def per_class(cells: DataFrame, digits: int | None = 4) -> DataFrame:
    """Precision, recall, F1 (0 where undefined), support and predicted of each class from confusion counts."""
    both = cells.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")))).alias("x"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("hit"))
    sums = both.groupBy("x.class").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))
    cut = (lambda x: half_up(x, digits)) if digits is not None else (lambda x: x)
    return sums.select("class", cut(p).alias("precision"), cut(r).alias("recall"), cut(f1).alias("f1"), "support", "predicted")


def averages(cells: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy, macro averages over classes that are true or predicted somewhere, and averages weighted by support."""
    c = per_class(cells, None).withColumn("tp", F.col("recall") * F.col("support"))
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    macro = lambda m: half_up(F.avg(F.when(seen, F.col(m))), digits).alias(f"macro_{m}")
    weighted = lambda m: half_up(F.sum(F.col(m) * F.col("support")) / F.sum("support"), digits).alias(f"weighted_{m}")
    return c.agg(half_up(F.sum("tp") / F.sum("support"), digits).alias("accuracy"), *(f(m) for f in (macro, weighted) for m in ("precision", "recall", "f1")))

