"""Checks before and between stages, as tables of what is wrong; ``require_empty`` turns them into errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    pass


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` hasn't got."""
    return left.select(keys).distinct().join(right.select(keys).distinct(), keys, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    return missing(left, right, [key]).withColumn("side", F.lit("left")).unionByName(missing(right, left, [key]).withColumn("side", F.lit("right")))


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value: key, n."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") > 1)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def counts_hold(df: DataFrame, cls: str, wanted: dict[str, int]) -> DataFrame:
    """Whether every class has exactly the wanted number of rows in each split: one row, ok."""
    per = df.groupBy(cls).agg(*(F.count_if(F.col("split") == s).alias(s) for s in wanted))
    return per.agg(F.coalesce(F.every(F.lit(True) if not wanted else _all([F.col(s) == n for s, n in wanted.items()])), F.lit(False)).alias("ok"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def same_encoder(*tables: DataFrame) -> DataFrame:
    """Encoders over all tables: n_encoders and ok, which is 1 if all rows come from one encoder."""
    encoders = tables[0].select("encoder")
    for t in tables[1:]:
        encoders = encoders.unionByName(t.select("encoder"))
    n = F.count_distinct("encoder")
    return encoders.agg(n.alias("n_encoders"), (n == 1).cast("int").alias("ok"))


def probe_media(files: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """``files`` (path) probed: path, codec, pix_fmt, duration, error.

    ``probe`` takes a path and returns codec, pix_fmt and duration, as a media tool reports them; it runs where the
    file can be read. A file that it fails on has nulls and the error's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b["path"].to_pylist():
                try:
                    found = probe(path)
                    out.append((path, found.get("codec"), found.get("pix_fmt"), float(found["duration"]), None))
                except Exception as e:
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "codec", "pix_fmt", "duration", "error"])

    return files.select("path").mapInArrow(run, "path string, codec string, pix_fmt string, duration double, error string")


def usable_media(probes: DataFrame, min_sec: float = 0.2, codec: str = "h264", pixels: str = "yuv420p") -> DataFrame:
    """Probed files (path, codec, pix_fmt, duration) that are longer than ``min_sec`` and of the wanted format."""
    return probes.where((F.col("duration") > min_sec) & (F.col("codec") == codec) & (F.col("pix_fmt") == pixels))


def require_empty(wrong: DataFrame, what: str, shown: int = 5) -> None:
    """Fails with up to ``shown`` of the offending rows."""
    rows = wrong.limit(shown).collect()
    if rows:
        raise ValidationError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
