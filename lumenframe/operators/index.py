"""An exact index of vectors in balls: a search reads only the balls whose bound reaches its k-th best score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.blocked import matrix, ordered_dot
from lumenframe.operators.sampling import hash_key
from lumenframe.operators.staging import stage

#: Balls of an index, rows that their centres are taken from, rounds that move them, and numbers of a block of queries.
BALLS, SAMPLE, ROUNDS, QUERY_CELLS = 64, 10_000, 8, 1 << 20


def centres_of(sample: np.ndarray, balls: int) -> np.ndarray:
    """Centres by Lloyd's rounds over a sample, begun at its first rows; an empty ball keeps its centre."""
    found = sample[:balls].copy()
    for _ in range(ROUNDS):
        near = ((found * found).sum(axis=1) - 2 * sample @ found.T).argmin(axis=1)
        for c in np.unique(near).tolist():
            found[c] = sample[near == c].mean(axis=0)
    return found


def _assign(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        size = (centres * centres).sum(axis=1)
        for b in batches:
            x = matrix(b["embedding"])
            ball = (size - 2 * x @ centres.T).argmin(axis=1) if len(x) else np.zeros(0, int)
            far = np.sqrt(((x - centres[ball]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball.astype(np.int32)), pa.array(far)], [*b.schema.names, "ball", "far"])

    return run


def build(items: DataFrame, path: str, balls: int = BALLS, sample: int = SAMPLE, seed: int = 0) -> None:
    """Writes ``items`` (item, embedding and others; vectors of one length) to ``path``: rows by ball, and the balls.

    Centres come from at most ``sample`` rows, the first in hash order; every row is then put into the ball of the
    nearest centre, and a ball's radius is that of its farthest row. Rows with a null vector or component are left out.
    """
    spark = items.sparkSession
    rows = items.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    first = matrix(rows.orderBy(hash_key(seed, "item"), "item").limit(sample).select(F.transform("embedding", lambda x: x.cast("double")).alias("e")).toArrow()["e"].combine_chunks())
    centres = centres_of(first, min(balls, len(first))) if len(first) else np.zeros((0, 0))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    placed = rows.mapInArrow(_assign(spark.sparkContext.broadcast(centres)), f"{kinds}, ball int, far double")
    placed.drop("far").write.partitionBy("ball").parquet(f"{path}/rows") if len(first) else placed.drop("far", "ball").write.parquet(f"{path}/rows")
    radii = placed.groupBy("ball").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "ball int, centre array<double>")
    table.join(radii, "ball").coalesce(1).write.parquet(f"{path}/balls")  # a row for each ball


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The highest score that a row of each ball can have: q.c + |q| * radius, with what rounding may add."""
    size = np.sqrt((queries * queries).sum(axis=1))[:, None]
    slack = 16 * (centres.shape[1] + 8) * 2.0**-52 * size * (np.sqrt((centres * centres).sum(axis=1)) + radii)[None]
    return queries @ centres.T + size * radii[None] * (1 + 1e-12) + slack


def _scan(shared, k: int) -> Callable:
    """Rows (item, ball, embedding) to the ``k`` best of each query among the balls that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asks, floor, kind = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        for b in batches:
            x, ball, ids = matrix(b["embedding"]), b["ball"].to_numpy(), b["item"].to_pylist()
            for one in np.unique(ball).tolist():
                at, wanted = np.flatnonzero(ball == one), np.flatnonzero(asks[:, one])
                if not len(wanted):
                    continue
                y = x[at]
                rough = queries[wanted] @ y.T
                slack = 8 * (y.shape[1] + 8) * 2.0**-52 * np.sqrt((queries[wanted] ** 2).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None]
                bar = floor[wanted]
                if len(at) > k:
                    bar = np.maximum(bar, np.partition(rough - slack, len(at) - k, axis=1)[:, len(at) - k])
                q, r = np.nonzero(rough + slack >= bar[:, None])
                score = ordered_dot(queries[wanted[q]], y[r])
                for i in np.unique(q).tolist():
                    mine = slice(*np.searchsorted(q, [i, i + 1]))
                    own = best[wanted[i]]
                    own += zip((-score[mine]).tolist(), [ids[at[j]] for j in r[mine].tolist()], strict=True)
                    own.sort()
                    del own[k:]
                    if len(own) == k:
                        floor[wanted[i]] = max(floor[wanted[i]], -own[-1][0])
        flat = [(i, c, -s) for i, own in enumerate(best) for s, c in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.float64())], ["q", "item", "score"])

    return run


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, query_cells: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(query, rank, item, score) of each query's ``k`` best rows, exact, and counts of (query, ball) pairs read and skipped.

    ``queries`` has query and embedding. By the triangle inequality no row of a ball scores above q.c + |q| * radius.
    Each query first reads the balls with the highest bounds that hold ``k`` rows together; its k-th score there says
    which other balls can still matter, and only those are read, as partitions of the files. Queries go in blocks of
    ``query_cells`` numbers. Ties go to the smaller item; queries of a null vector or component get no rows.
    """
    balls = spark.read.parquet(f"{path}/balls").orderBy("ball").toArrow()  # a row for each ball
    counts = {"read": 0, "skipped": 0, "balls_read": 0}
    rows = spark.read.parquet(f"{path}/rows")
    item_kind = dict(rows.dtypes)["item"]
    asked = stage(queries.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("query", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "queries")
    query_kind = dict(asked.dtypes)["query"]
    empty = spark.createDataFrame([], f"query {query_kind}, rank int, item {item_kind}, score double")
    cells = asked.agg(F.sum(F.size("embedding") + 1)).first()[0] or 0
    if not len(balls) or not cells:
        return empty, counts
    centres, radii, sizes = matrix(balls["centre"].combine_chunks()), balls["radius"].to_numpy(), balls["n"].to_numpy()
    place = {b: i for i, b in enumerate(balls["ball"].to_pylist())}
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[item_kind]
    blocks, out = max(1, -(-cells // (query_cells or QUERY_CELLS))), None

    def scan(vectors: np.ndarray, asks: np.ndarray, floor: np.ndarray) -> DataFrame:
        wanted = [b for b, i in place.items() if asks[:, i].any()]
        counts["read"] += int(asks.sum())
        counts["balls_read"] += len(wanted)
        by_ball = np.zeros((len(vectors), max(place) + 1), bool)
        by_ball[:, list(place)] = asks[:, list(place.values())]
        part = rows.where(F.col("ball").isin(wanted)).select("item", "ball", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        found = part.mapInArrow(_scan(spark.sparkContext.broadcast((vectors, by_ball, floor, arrow)), k), f"q int, item {item_kind}, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "item")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query").toArrow().combine_chunks()  # about query_cells numbers
        if not len(part):
            continue
        vectors = matrix(part["embedding"].combine_chunks())
        most = bounds(vectors, centres, radii)
        order = np.argsort(-most, axis=1, kind="stable")
        enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k  # the balls before hold fewer than k rows
        first = np.zeros_like(enough)
        np.put_along_axis(first, order, enough, axis=1)
        near = stage(scan(vectors, first, np.full(len(vectors), -np.inf)), "index-near")
        kth = near.where(F.col("rank") == k).select("q", "score").toArrow()  # a row for each query
        floor = np.full(len(vectors), -np.inf)
        floor[kth["q"].to_numpy()] = kth["score"].to_numpy()
        rest = (most >= floor[:, None]) & ~first
        counts["skipped"] += int((~first & ~rest).sum())
        every = near.drop("rank").unionByName(scan(vectors, rest, floor).drop("rank")) if rest.any() else near.drop("rank")
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(part)), pa.int32()), "query": part["query"]}))
        w = Window.partitionBy("q").orderBy(F.desc("score"), "item")
        best = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("query", F.col("rank").cast("int").alias("rank"), "item", "score")
        out = best if out is None else out.unionByName(best)
    return (out if out is not None else empty), counts
