"""Running sums and numbers in an order, by ranges that follow the data, so that no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.staging import stage


def dealt(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` as a staged table with ``_p``: ranges of about equal numbers of rows in the given order, numbered in it.

    Spark samples the order's quantiles. Rows that tie in all of ``order`` share a range, so it should end in what tells
    rows apart; then one score that all rows have is dealt out like any other.
    """
    cut = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return stage(cut.withColumn("_p", F.spark_partition_id()), name)


def running_sums(df: DataFrame, by: list[str], sums: dict[str, str], score: str = "score", ties: tuple[str, ...] = (), wholes: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with, for each (name, column) of ``sums``, the column's sum over the rows of its group that are not below it.

    Highest scores come first, NaN before all and null last, equal ones in order of ``ties``. ``wholes`` (name, name of
    a sum) adds sums over the whole group. Rows are dealt to ranges of (group, score, ties), each range's sums, a row
    for each range and group in it, give its start, and rows are then summed inside their range.
    """
    cut = dealt(df, [*map(F.col, by), F.desc(score), *map(F.col, ties)], "running-sums", ranges)
    totals = cut.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    above, all_of = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    whole = {n: F.sum(f"_t_{of}").over(all_of).alias(f"_w_{n}") for n, of in (wholes or {}).items()}
    before = totals.select(*by, "_p", *(F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_t_{n}") for n in sums), *whole.values())
    inner = Window.partitionBy(*by, "_p").orderBy(F.desc(score), *ties).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.select("*", *(F.sum(c).over(inner).alias(f"_i_{n}") for n, c in sums.items()))
    joined = inside.join(before, [*by, "_p"])
    return joined.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums), *(F.col(f"_w_{n}").alias(n) for n in whole))


def numbers(df: DataFrame, order: list[str | Column], name: str = "idx", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``, 0, 1, ... in ``order``: ranges are counted, a row for each, then numbered inside."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = dealt(df, order, "numbers", ranges)
    counts = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # a row for each range
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return cut.withColumn("_r", inner).join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_p", "_r", "_before")
