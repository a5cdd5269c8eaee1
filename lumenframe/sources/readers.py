"""Readers: files as typed DataFrames, never with inferred types."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.functions.names import stem
from lumenframe.operators.validate import missing, require_empty
from lumenframe.sources import schemas

#: File name endings of videos.
VIDEO_SUFFIXES = ("mp4", "avi", "mkv", "mov", "webm")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``, their contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def class_files(spark: SparkSession, root: str, negative: str = "no_violation") -> DataFrame:
    """Files of ``positive/<class>/`` and ``negative/``: path, class, relative."""
    relative = F.regexp_extract("path", r"/((?:positive/[^/]+|negative)/[^/]+)$", 1)
    cls = F.when(F.col("relative").startswith("negative/"), F.lit(negative)).otherwise(F.regexp_extract("relative", r"^positive/([^/]+)/", 1))
    return _files(spark, root).withColumn("relative", relative).where(F.col("relative") != "").select("path", cls.alias("class"), "relative")


def class_dirs(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold files, by name: class, dir, n; two folders of one name are an error."""
    folders = _files(spark, root).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    named = folders.withColumn("class", F.regexp_extract("dir", r"([^/]+)$", 1))
    require_empty(named.groupBy("class").count().where("count > 1"), "folders of the same name")
    return named.select("class", "dir", "n")


def videos(spark: SparkSession, root: str) -> DataFrame:
    """Video files by suffix, in any case: video (stem), path, length."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return _files(spark, root).where(suffix.isin(*VIDEO_SUFFIXES)).select(stem(F.col("path")).alias("video"), "path", "length")


def annotations(spark: SparkSession, path: str, columns: dict[str, str] | None = None, taxonomy: DataFrame | None = None) -> DataFrame:
    """Intervals from CSV with a header: video (stem), class (trimmed), start_sec, end_sec, pos (order of rows).

    ``columns`` maps video, class, start and end to the file's names. With a ``taxonomy`` (class), an unknown
    class is an error.
    """
    names = {"video": "video", "class": "class", "start": "start_sec", "end": "end_sec"} | (columns or {})
    raw = spark.read.option("header", "true").csv(path)
    out = raw.select(stem(F.trim(F.col(names["video"]))).alias("video"), F.trim(F.col(names["class"])).alias("class"), F.trim(F.col(names["start"])).cast("double").alias("start_sec"), F.trim(F.col(names["end"])).cast("double").alias("end_sec"), F.monotonically_increasing_id().alias("pos"))
    if taxonomy is not None:
        require_empty(missing(out, taxonomy, ["class"]), "classes that the taxonomy doesn't know")
    return out


def score_files(spark: SparkSession, path: str, prefix: str = "scores_") -> DataFrame:
    """Wide score files ``scores_<video>.csv`` (start_sec and a column for each class) as a long table."""
    raw = spark.read.option("header", "true").csv(path)
    classes = [c for c in raw.columns if c != "start_sec"]
    typed = raw.select(F.regexp_replace(stem(F.col("_metadata.file_name")), f"^{prefix}", "").alias("video"), F.col("start_sec").cast("double"), *(F.col(c).cast("double") for c in classes))
    return typed.unpivot(["video", "start_sec"], classes, "class", "score").select("video", "class", "start_sec", "score")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of row objects."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object keyed by class or video, as rows: key and the value's fields."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, schemas.PROMPTS).select(F.col("key").alias("class"), "value.*")


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, schemas.THRESHOLDS).select(F.col("key").alias("class"), "value.*")


def with_defaults(taxonomy: DataFrame, tuned: DataFrame) -> DataFrame:
    """The taxonomy's threshold, window and min_consec, replaced by tuned ones where there are any: class and the three."""
    names = ("threshold", "window", "min_consec")
    t = tuned.select("class", *(F.col(n).alias(f"_{n}") for n in names))
    return taxonomy.join(t, "class", "left").select("class", *(F.coalesce(f"_{n}", n).alias(n) for n in names))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines: video."""
    return spark.read.text(path).select(F.trim("value").alias("video")).where(F.length("video") > 0)


def array_files(spark: SparkSession, path: str, schema: str, rows: int = 4096) -> DataFrame:
    """Array archives (.npz) as a table of the arrays that ``schema`` names, and path.

    Arrays run along their first dimension, one row for each place; a matrix gives array columns. An array without
    dimensions, such as a model's name, is repeated in every row. Arrays of unequal length, missing ones and pickled
    objects are errors. Each archive is read by one task, ``rows`` rows at a time leave it.
    """
    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in kinds]
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    arrays = [archive[f.name] for f in kinds]
                lengths = {len(a) for a in arrays if a.ndim}
                if len(lengths) > 1:
                    raise ValueError(f"{name}: arrays of lengths {sorted(lengths)}")
                n = lengths.pop() if lengths else 1
                for low in range(0, n, rows):
                    high = min(low + rows, n)
                    cells = [pa.array((a[low:high] if a.ndim else np.repeat(a, high - low)).tolist(), t) for a, t in zip(arrays, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (high - low)), *cells], ["path", *(f.name for f in kinds)])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), *kinds]))
