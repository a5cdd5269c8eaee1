"""Where an external encoder plugs in: batches of rows go in, vectors come out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.grids import frame_indices
from lumenframe.functions.vectors import half_up
from lumenframe.operators import index
from lumenframe.operators.retrieval import search
from lumenframe.operators.staging import stage
from lumenframe.operators.validate import ValidationError, require_empty


def hash_encoder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in encoder for tests: unit vectors that depend on the text alone."""
    out = np.empty((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little"))
        v = rng.standard_normal(dim)
        out[i] = v / max(np.linalg.norm(v), 1e-12)
    return out


def encode(df: DataFrame, content: str, encoder: Callable[[list], np.ndarray], name: str, batch: int = 8, strict: bool = False) -> DataFrame:
    """``df`` with embedding (unit float vectors) and encoder (its name); ``encoder`` maps a list to (n, dim).

    A batch that the encoder can't take is tried row by row; a row that it can't take is left out, or, if
    ``strict``, fails the job. Null contents count as such rows.
    """

    def attempt(values: list) -> list:
        if all(v is not None for v in values):
            try:
                return [np.asarray(x, np.float32) for x in encoder(values)]
            except Exception:
                if strict:
                    raise
        elif strict:
            raise ValueError("nothing to encode in a row")
        return [None] if len(values) == 1 else [x for v in values for x in attempt([v])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), batch):
                part = b.slice(low, batch)
                got = [None if x is None else (x / max(float(np.linalg.norm(x)), 1e-12)).tolist() for x in attempt(part.column(part.schema.get_field_index(content)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, embedding array<float>").where(F.col("embedding").isNotNull()).withColumn("encoder", F.lit(name))


def encode_windows(videos: DataFrame, windows: DataFrame, frames: Callable[[str, list[list[int]]], list], encoder: Callable[[list], np.ndarray], name: str, chunk: float = 2.0, n_frames: int = 8, batch: int = 8, strict: bool = False) -> DataFrame:
    """Embeddings of windows of videos: video, start_sec, embedding, encoder.

    ``videos`` has video, path, fps and length (frames), ``windows`` video and start_sec. Each window gets ``n_frames``
    evenly spaced frame numbers from its first to its last frame, clipped to the video. ``frames(path, numbers)``
    reads the clips of up to ``batch`` windows of one video in one go, and ``encoder`` takes such a batch. Windows
    that can't be read or encoded are left out, or, if ``strict``, fail the job.
    """
    first = F.floor(F.col("start_sec") * F.col("fps"))
    last = F.greatest(first, F.least(F.floor((F.col("start_sec") + F.lit(chunk)) * F.col("fps")), F.col("length") - 1))
    placed = windows.join(videos, "video").select("video", "path", "start_sec", frame_indices(first, last, n_frames).alias("frames"))
    numbered = placed.withColumn("_g", F.floor((F.row_number().over(Window.partitionBy("video").orderBy("start_sec")) - 1) / F.lit(batch)))
    batches = numbered.groupBy("video", "path", "_g").agg(F.array_sort(F.collect_list(F.struct("start_sec", "frames"))).alias("w")).drop("_g")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for video, path, group in zip(b["video"].to_pylist(), b["path"].to_pylist(), b["w"].to_pylist(), strict=True):
                try:
                    got = np.asarray(encoder(frames(path, [w["frames"] for w in group])), np.float32)
                except Exception:
                    if strict:
                        raise
                    continue
                unit = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(group), kind), pa.array([w["start_sec"] for w in group], pa.float64()), pa.array(unit.tolist(), pa.list_(pa.float32()))], ["video", "start_sec", "embedding"])

    name_kind = dict(videos.dtypes)["video"]
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name_kind]
    return batches.select("video", "path", "w").mapInArrow(run, f"video {name_kind}, start_sec double, embedding array<float>").withColumn("encoder", F.lit(name))


def build_index(rows: DataFrame, content: str, encoder: Callable[[list], np.ndarray], name: str, path: str, strict: bool = False) -> None:
    """Encodes ``rows`` (item, caption, file, content) and writes the index, item, caption, file, embedding and encoder, as Parquet."""
    encode(rows, content, encoder, name, strict=strict).select("item", "caption", "file", "embedding", "encoder").write.mode("overwrite").parquet(path)


def search_index(spark: SparkSession, path: str, query: str, encoder: Callable[[list], np.ndarray], name: str, k: int = 5) -> DataFrame:
    """The ``k`` (1 to 24) best rows of an index for a text: rank, item, file, caption, score. An empty query, or another encoder's index, is an error."""
    if not query.strip():
        raise ValidationError("empty query")
    held = spark.read.schema("item string, caption string, file string, embedding array<float>, encoder string").parquet(path)
    require_empty(held.where(F.col("encoder") != name).select("encoder").distinct(), f"the index isn't of the encoder {name}")
    vector = np.asarray(encoder([query.strip()])[0], np.float64)
    asked = spark.createDataFrame([((vector / max(float(np.linalg.norm(vector)), 1e-12)).tolist(),)], "embedding array<double>")
    return search(held, asked, k).select("rank", "item", "file", "caption", half_up("score", 6).alias("score"))


def build_ball_index(rows: DataFrame, content: str, encoder: Callable[[list], np.ndarray], name: str, path: str, balls: int = index.BALLS, strict: bool = False) -> None:
    """``build_index`` as an index in balls, for many queries at a time. Rows are encoded once, into a staged table."""
    encoded = encode(rows, content, encoder, name, strict=strict).select("item", "caption", "file", "embedding", "encoder")
    index.build(stage(encoded, "encoded"), path, balls)


def search_texts(spark: SparkSession, path: str, texts: DataFrame, encoder: Callable[[list], np.ndarray], name: str, k: int = 5) -> DataFrame:
    """The ``k`` (1 to 24) best rows of a ball index for each (query, text): query, rank, item, file, caption, score.

    Exact, and only balls whose bound reaches a query's k-th score are read. Blank texts, a text that can't be encoded
    and another encoder's index are errors.
    """
    require_empty(texts.where(F.coalesce(F.trim("text"), F.lit("")) == "").select("query"), "empty queries")
    rows = spark.read.parquet(f"{path}/rows")
    require_empty(rows.where(F.col("encoder") != name).select("encoder").distinct(), f"the index isn't of the encoder {name}")
    asked = encode(texts.select("query", F.trim("text").alias("text")), "text", encoder, name, strict=True)
    found, _ = index.search_many(spark, path, asked.select("query", "embedding"), max(1, min(24, k)))
    named = rows.select("item", "file", "caption").dropDuplicates(["item"])
    return found.join(named, "item").select("query", "rank", "item", "file", "caption", half_up("score", 6).alias("score"))
