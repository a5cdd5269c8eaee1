"""Where the queries' tables and the public tokenizers' files are."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder LUMENFRAME_TOKENIZERS names, else where the package keeps it."""
    if where := os.environ.get("LUMENFRAME_TOKENIZERS"):
        return os.path.join(where, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
