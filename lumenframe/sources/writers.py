"""Writers: results as CSV, JSON, text and Parquet in the forms that readers expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites the partitions that ``df`` has rows of, so that a rerun replaces its own output only."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.json(path)


def wide_scores(scores: DataFrame, classes: list[str], path: str) -> None:
    """start_sec with three and scores with six decimals, a column for each class, a folder for each video."""
    table = scores.groupBy("video", "start_sec").pivot("class", classes).agg(F.first("score"))
    text = table.select("video", F.format_string("%.3f", "start_sec").alias("start_sec"), *(F.format_string("%.6f", c).alias(c) for c in classes))
    text.repartition("video").sortWithinPartitions("video", F.col("start_sec").cast("double")).write.option("header", "true").partitionBy("video").csv(path)


def confusion_csv(cells: DataFrame, classes: list, path: str) -> None:
    """The confusion matrix under the header ``true\\pred``."""
    table = cells.groupBy("label").pivot("pred", classes).agg(F.first("n")).orderBy("label")
    table.withColumnRenamed("label", "true\\pred").coalesce(1).write.option("header", "true").csv(path)  # a row for each class


def per_class_csv(report: DataFrame, path: str) -> None:
    cut = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes]
    report.select(*cut).orderBy("class").coalesce(1).write.option("header", "true").csv(path)  # a row for each class


def split_lists(items: DataFrame, path: str) -> None:
    """Each split's distinct videos, sorted, one a line."""
    items.select("split", F.col("video").alias("value")).distinct().repartition("split").sortWithinPartitions("value").write.partitionBy("split").text(path)


def document(df: DataFrame) -> str:
    """A one-row table as a JSON object."""
    return df.toJSON().first()


def render(template: str, values: dict[str, str]) -> str:
    """A template with each ``__NAME__`` replaced."""
    for k, v in values.items():
        template = template.replace(f"__{k}__", v)
    return template
