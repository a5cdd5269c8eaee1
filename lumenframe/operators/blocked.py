"""Products of many vectors with many prompts, a block of prompts at a time, with the best of each row carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.ranges import numbers
from lumenframe.operators.staging import stage

#: Bytes of prompts in one pass, which every worker holds, and numbers of a product that a task holds at once.
PASS_BYTES, PRODUCT_CELLS = 64 << 20, 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths without nulls as a matrix of doubles."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]]
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ordered_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first component to the last, as a fold over an array does."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def best_prompts(x: np.ndarray, p: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, prompt, score): for each row of ``x`` the prompts that may be among its ``k`` best, scored in order.

    A matrix product finds those within rounding of the k-th best and of ``floor``; only these are scored again.
    """
    rough = x @ p.T
    slack = 8 * (x.shape[1] + 8) * 2.0**-52 * np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((p * p).sum(axis=1))[None]
    low = rough - slack
    bar = np.maximum(floor, np.partition(low, len(p) - k, axis=1)[:, len(p) - k] if len(p) > k else -np.inf)
    row, prompt = np.nonzero(rough + slack >= bar[:, None])
    return row, prompt, ordered_dot(x[row], p[prompt])


def _merge(shared, k: int, kind: pa.DataType) -> Callable:
    """Rows with their best so far (_ids, _best, best first) to the same after one more pass of prompts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = shared.value
        step = max(1, PRODUCT_CELLS // max(len(p), 1))
        for b in batches:
            x = matrix(b["embedding"])
            names, scores = b["_ids"].to_pylist(), b["_best"].to_pylist()
            for low in range(0, len(x), step):
                part = slice(low, low + step)
                floor = np.array([s[-1] if len(s) == k else -np.inf for s in scores[part]])
                row, prompt, score = best_prompts(x[part], p, k, floor)
                for i in np.unique(row).tolist():
                    at, mine = low + i, slice(*np.searchsorted(row, [i, i + 1]))
                    found = zip((-score[mine]).tolist(), [ids[j] for j in prompt[mine].tolist()], strict=True)
                    every = sorted([*((-s, c) for c, s in zip(names[at], scores[at], strict=True)), *found])[:k]
                    names[at], scores[at] = [c for _, c in every], [-s for s, _ in every]
            told = {"_ids": pa.array(names, pa.list_(kind)), "_best": pa.array(scores, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([told[n] if n in told else b[n] for n in b.schema.names], b.schema.names)

    return run


def _passes(prompts: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray, bool]]:
    """(classes, matrix, whether it is the last) of about ``most`` bytes of prompts at a time, in order of the class."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & F.col("class").isNotNull()
    known = numbers(prompts.where(whole).select("class", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), ["class"], "_i")
    n, dim = known.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    each = max(1, most // (8 * max(dim or 1, 1)))
    for low in range(0, n or 0, each):
        part = known.where((F.col("_i") >= low) & (F.col("_i") < low + each)).select("class", "embedding").orderBy("class").toArrow().combine_chunks()
        yield part["class"].to_pylist(), matrix(part["embedding"].combine_chunks()), low + each >= n


def _arrow_kind(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[kind]


def all_scores(items: DataFrame, prompts: DataFrame, pass_bytes: int | None = None) -> DataFrame:
    """Every item's dot product with every prompt, a pass of prompts at a time: the items' columns but the vector, class, score.

    Rows without a whole vector have null scores. There are as many rows as pairs; ``top_prompts`` makes only the best.
    """
    keep, kind = [c for c in items.columns if c != "embedding"], dict(prompts.dtypes)["class"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in items.dtypes if c != "embedding"), f"class {kind}", "score double"])
    rows = items.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    out, arrow = None, _arrow_kind(kind)

    def pairs(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, p = shared.value
            for b in batches:
                for i, x in enumerate(matrix(b["embedding"])):
                    score = ordered_dot(np.broadcast_to(x, p.shape), p)
                    own = b.slice(i, 1).select(keep)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(len(p), np.int64))) for c in own.columns), pa.array(ids, arrow), pa.array(score)], [*keep, "class", "score"])

        return run

    for ids, p, _ in _passes(prompts, pass_bytes or PASS_BYTES):
        found = rows.mapInArrow(pairs(items.sparkSession.sparkContext.broadcast((ids, p))), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else items.sparkSession.createDataFrame([], schema)


def top_prompts(items: DataFrame, prompts: DataFrame, k: int = 1, pass_bytes: int | None = None) -> DataFrame:
    """The ``k`` best prompts of every item: the items' columns but the vector, rank, class and score.

    ``items`` has embedding, ``prompts`` class and embedding, all of one length; rows with a null vector or component
    and null classes take no part. Any number of prompts: they are numbered and go in passes of about ``pass_bytes``
    bytes, each a broadcast of its own; the items are read where they lie and carry their best so far from pass to
    pass, so that nothing is shuffled and no pair of item and prompt becomes a row. Scores are sums in order of the
    components, ties go to the smaller class.
    """
    kind = dict(prompts.dtypes)["class"]
    keep = [c for c in items.columns if c != "embedding"]
    rows = items.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    rows = rows.withColumns({"_ids": F.array().cast(f"array<{kind}>"), "_best": F.array().cast("array<double>")})
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    for ids, p, last in _passes(prompts, pass_bytes or PASS_BYTES):
        rows = rows.mapInArrow(_merge(items.sparkSession.sparkContext.broadcast((ids, p)), k, _arrow_kind(kind)), schema)
        rows = rows if last else stage(rows, "prompts-best")
    ranked = F.posexplode(F.arrays_zip(F.col("_ids").alias("class"), F.col("_best").alias("score"))).alias("rank", "x")
    return rows.select(*keep, ranked).select(*keep, (F.col("rank") + 1).alias("rank"), F.col("x.class").alias("class"), F.col("x.score").alias("score"))
