"""Exact top-k inner-product search by branch and bound over vertical (dimension-major) blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import map_arrow, spans, stage

#: Dimensions whose products are accumulated between two rounds of pruning.
DIM_BLOCK = 16
#: Components of the vectors that a task compares at once, and of the queries that every task holds (64-bit integers).
BLOCK_CELLS, QUERY_CELLS = 1 << 20, 1 << 22
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as array<long>; null where the vector or a component is null or not finite.

    Components beyond 64 bits become the nearest 64-bit integer.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = lambda x: F.when(x >= 2.0**63, F.lit(_MOST)).when(x <= -(2.0**63), F.lit(_LEAST)).otherwise(F.floor(x))
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: edge(x.cast("double") * scale)))


def exact_scores(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; ``most`` bounds their size. Those beyond 64 bits become the nearest 64-bit integer."""
    if most < 2.0**62:
        return vectors @ query
    return np.array([min(max(sum(a * b for a, b in zip(v, query.tolist(), strict=True)), _LEAST), _MOST) for v in vectors.tolist()], np.int64)


def best_of_block(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``k`` best vectors of the block: (query row, vector row, score), exact, ties to smaller ids.

    ``queries`` (m, d), ``vectors`` (n, d) hold 64-bit integers; a vector whose id is the query's ``own`` is left out,
    and so may be vectors with scores below the query's ``floor``. Scores grow one block of dimensions at a time; what
    the rest can still add lies within plus or minus the product of the rests' norms, and a candidate whose upper bound
    is below the k-th lower bound goes. Sums that doubles can't hold exactly get the rounding error as slack and are
    computed once more in integers for the candidates that are left.
    """
    n, d = vectors.shape
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(vectors[order].T, dtype=np.float64)  # dimension-major
    q = queries.astype(np.float64)
    most = float(np.abs(q).max(initial=0) * np.abs(columns).max(initial=0) * max(d, 1))
    cuts = list(range(0, d, DIM_BLOCK))
    rest = lambda x, at: np.sqrt((x[at:] ** 2).sum(axis=0)) * (1 + 1e-9)
    mass = [(rest(columns, min(at + DIM_BLOCK, d)), rest(q.T, min(at + DIM_BLOCK, d))) for at in cuts]
    error = (4 * (d + 8) * 2.0**-52 if most >= 2.0**52 else 0.0) * rest(columns, 0), rest(q.T, 0)
    out_q, out_v, out_s = [], [], []
    step = max(1, (4 << 20) // max(n, 1))  # queries whose first products are made in one go: 32 MB
    for low in range(0, len(q), step):
        part = q[low : low + step]
        first = part[:, : DIM_BLOCK] @ columns[:DIM_BLOCK]
        for i, row in enumerate(part):
            at, score = np.arange(n), first[i]
            lo, hi = np.searchsorted(ids, own[low + i]), np.searchsorted(ids, own[low + i], "right")
            if hi > lo:
                at = np.delete(at, np.s_[lo:hi])
                score = score[at]
            least = -np.inf if floor is None else float(floor[low + i])
            off = error[0][at] * error[1][low + i]
            for c, cut in enumerate(cuts):
                if c:
                    end = min(cut + DIM_BLOCK, d)
                    score = score + row[cut:end] @ columns[cut:end, at]
                slack = off + mass[c][0][at] * mass[c][1][low + i]
                bar = max(least, np.partition(score - slack, len(at) - k)[len(at) - k]) if len(at) > k else least
                bar = min(bar, 2.0**63) if bar > -(2.0**63) else -np.inf  # scores beyond 64 bits tie
                stay = score + slack >= bar - abs(bar) * 2.0**-50
                at, score, off = at[stay], score[stay], off[stay]
            whole = score.astype(np.int64) if most < 2.0**52 else exact_scores(vectors[order[at]], queries[low + i], most)
            best = np.lexsort((ids[at], ~whole))[:k]  # ~x falls as x grows, without overflow
            out_q.append(np.full(len(best), low + i))
            out_v.append(order[at[best]])
            out_s.append(whole[best])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_v), cat(out_s)


class Best:
    """The ``k`` best vectors so far of each of a number of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def floor(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity where there are fewer."""
        out = np.full(len(self.ids), -np.inf)
        last = np.flatnonzero(np.bincount(self.row, minlength=len(self.ids)) == self.k)
        out[last] = self.score[np.searchsorted(self.row, last, "right") - 1]
        return out

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        row, at, score = best_of_block(self.queries, ids, vectors, self.ids, self.k, self.floor())
        row, vec, score = np.concatenate((self.row, row)), np.concatenate((self.vec, ids[at])), np.concatenate((self.score, score))
        order = np.lexsort((vec, ~score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[place < self.k]
        self.row, self.vec, self.score = row[order], vec[order], score[order]


def _by_dim(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, matrix) for each length of vector."""
    size = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
    starts, flat, names = np.asarray(vectors.offsets)[:-1].astype(np.int64), np.asarray(vectors.values), np.asarray(ids)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, names[rows], flat[spans(starts[rows], np.full(len(rows), dim))].reshape(len(rows), dim)


def _search(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, queries, k) for dim, (ids, queries) in shared.value.items()}
        held: list[pa.RecordBatch] = []
        cells = 0

        def flush() -> None:
            for dim, ids, vectors in _by_dim(*(pa.concat_arrays([b[c] for b in held]) for c in ("id", "vec"))):
                if dim in best:
                    for low in range(0, len(ids), max(1, BLOCK_CELLS // max(dim, 1))):
                        high = low + max(1, BLOCK_CELLS // max(dim, 1))
                        best[dim].add(ids[low:high], vectors[low:high])

        for b in batches:
            held.append(b)
            cells += len(b) + len(b["vec"].values)
            if cells >= BLOCK_CELLS:
                flush()
                held, cells = [], 0
        if held:
            flush()
        for x in best.values():
            for low in range(0, len(x.row), 1 << 16):
                cut = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.row[cut]]), pa.array(x.vec[cut]), pa.array(x.score[cut])], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """Each query's ``k`` largest integer inner products against all other rows: query_id, rank, vec_id, score.

    ``queries`` is a condition on ``df`` that picks the query rows. Queries go in blocks of about ``QUERY_CELLS``
    components, each a job of its own: every task holds one block of queries, reads its vectors where they lie and
    carries each query's k-th best score from one block of vectors to the next; only k rows for a query and task
    reach the final ranking. Ties go to the smaller id.

    Null or not finite vectors or components, and null ids, take no part. Vectors are compared with vectors of the
    same length only. A repeated id counts once for each row, but never against a query of the same id; repeated
    query rows of one id are one query (the first of its vectors in order). Fewer than k candidates: all of them.
    Components and scores are exact in 64 bits; beyond them they are the nearest 64-bit integer, and such scores tie.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vec_col), scale).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = stage(rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()), "topk-vectors")
    asked = stage(rows.where("asks").groupBy("id", F.size("vec").alias("dim")).agg(F.min("vec").alias("vec")), "topk-queries")
    blocks = max(1, -(-(asked.agg(F.sum(F.col("dim") + 1)).first()[0] or 0) // QUERY_CELLS))
    found = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "vec").toArrow()  # about QUERY_CELLS components
        held = {dim: (ids, matrix) for dim, ids, matrix in _by_dim(part["id"].combine_chunks(), part["vec"].combine_chunks())} if len(part) else {}
        best = map_arrow(rows.select("id", "vec"), _search(spark.sparkContext.broadcast(held), k), "query_id long, vec_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found.append(stage(ranked, "topk-found") if blocks > 1 else ranked)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
