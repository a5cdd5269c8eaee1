"""Long series in blocks of time: rows of a block with the rows around it, and runs merged over the blocks' borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a series that one task takes at a time: with windows every second so many rows a block at most.
SPAN = 1 << 14


def block_of(order: Column, span: float | None = None) -> Column:
    return F.floor(order / F.lit(float(span or SPAN)))


def with_halo(df: DataFrame, keys: list[str], half: int, order: str = "start_sec", span: float | None = None) -> DataFrame:
    """``df`` with ``_block``, and ``_own``: false for copies of the ``half`` rows before and after each block's own.

    Neighbours are rows by position, however far away: each block holds a row at least, so that they lie in the
    ``half`` blocks beside it. Only those edges are put in order by series; no task gets more than a block of rows.
    """
    cols = [c for c in df.columns if c not in keys and c != order]
    cut = df.withColumn("_block", block_of(F.col(order), span)).select(*keys, order, *cols, "_block").repartition(*keys, "_block")
    edge = cut.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("r"))
    last = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - half + 1), half)
    edge = edge.select(*keys, "_block", F.slice("r", 1, half).alias("first"), last(F.col("r")).alias("last"))
    w = Window.partitionBy(*keys).orderBy("_block")
    around = F.concat(last(F.flatten(F.collect_list("last").over(w.rowsBetween(-half, -1)))), F.slice(F.flatten(F.collect_list("first").over(w.rowsBetween(1, half))), 1, half))
    halo = edge.select(*keys, "_block", around.alias("x")).select(*keys, "_block", F.inline("x")).withColumn("_own", F.lit(False))
    return cut.withColumn("_own", F.lit(True)).unionByName(halo.select(*keys, order, *cols, "_block", "_own"))


def merged_runs(flagged: DataFrame, flag: Column, keys: list[str], value: str, order: str = "start_sec", span: float | None = None) -> DataFrame:
    """Maximal runs of flagged rows, adjacent by position: keys, start, last, peak, mean, n_windows.

    A block's runs are pieces; those inside of it are whole. Pieces at its borders, three a block at most with the
    unflagged rows that end a run, are put in order by series: a piece that ends its block and one that begins the
    next are one run. Sums, counts and maxima of pieces are merged, so no task gets more than a block of rows.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    cut = flagged.withColumn("_block", block_of(F.col(order), span)).withColumn("_hit", F.coalesce(flag, F.lit(False))).select(*keys, order, F.col(value).alias("_value"), "_block", "_hit")
    cut = cut.withColumn("_place", F.row_number().over(w)).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_block")))
    cut = cut.withColumn("_run", F.when(F.col("_hit"), F.col("_place") - F.sum(F.col("_hit").cast("int")).over(w)))
    cells = cut.groupBy(*keys, "_block", "_run").agg(
        F.min(order).alias("start"), F.max(order).alias("last"), F.max("_value").alias("peak"), F.sum("_value").alias("total"), F.count(F.lit(1)).alias("n"),
        (F.min("_place") == 1).alias("opens"), (F.max("_place") == F.max("_size")).alias("closes"),
    )
    cells = cells.where("_run IS NOT NULL OR opens OR closes").withColumn("_slot", F.when(F.col("opens") | F.col("closes"), F.lit(None)).otherwise(F.col("_block")))
    inner = Window.partitionBy(*keys, "_slot").orderBy("_block", "start")
    goes_on = F.col("_slot").isNull() & F.col("opens") & F.col("_run").isNotNull() & F.lag(F.col("closes") & F.col("_run").isNotNull()).over(inner)
    chained = cells.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(inner)).where("_run IS NOT NULL")
    merged = chained.groupBy(*keys, "_slot", "_chain").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.max("peak").alias("peak"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n_windows"))
    return merged.drop("_slot", "_chain")
