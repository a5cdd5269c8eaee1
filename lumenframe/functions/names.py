"""Identifiers made from paths, classes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_id(relative: Column) -> Column:
    """A relative path as an id: slashes doubled into underscores, the last four characters (the suffix) cut off."""
    flat = F.replace(relative, F.lit("/"), F.lit("__"))
    return F.substring(flat, F.lit(1), F.greatest(F.length(flat) - 4, F.lit(0)))


def numbered_id(cls: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", cls, number)


def chunk_id(stem: Column, start_sec: Column) -> Column:
    """The source's name and the start in milliseconds, rounded half to even, seven digits."""
    return F.format_string("%s_%07d", stem.cast("string"), F.bround(start_sec * 1000).cast("long"))


def stem(name: Column) -> Column:
    """A file name without its folders and without what follows its last dot; a leading dot stays."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def label_key(chunk: Column, cls: Column) -> Column:
    return F.concat_ws("#", chunk, cls)


def clamp(k: Column, low: int = 1, high: int = 24) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), k))
