"""What the training-data operators share: staged tables, splits, bounded samples and flat Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that Python workers get, and the bytes at which a batch ends (its last row may exceed them).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir; a folder of our own where that is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenframe-stage-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back; this cuts the lineage.

    The table outlives the loss of any executor, and a later job rereads it instead of computing it again.
    """
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: str | Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``; null keys count as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, so that a worker's memory doesn't follow the table."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", str(1 << 26)):  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with the row at which ``column`` (text or binary) reaches ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for b in batches:
        size = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        low = 0
        while low < len(b):
            so_far = weight + np.cumsum(size[low:])
            n = min(int(np.searchsorted(so_far, most)) + 1, len(so_far))
            held.append(b.slice(low, n))
            low, weight = low + n, int(so_far[n - 1])
            if weight >= most:
                yield _joined(held)
                held, weight = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def _bitmap(listed: DataFrame, key: str, most_bits: int) -> tuple[DataFrame, Column]:
    """A one-row table of a bitmap of hashed keys, and the condition that a key's bit is set in it.

    It has eight bits or more a key but ``most_bits`` (16 MB) at most; with more keys it says yes to more other rows.
    """
    bits = 1 << 16
    while bits < min(8 * listed.count(), most_bits):
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    one = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast({key} as long)), {bits}) % 64 as int))")
    words = listed.groupBy(F.floor(slot / 64).alias("i")).agg(F.bit_or(one).alias("w")).toArrow()  # bits / 64 rows at most
    dense = np.zeros(bits // 64, np.int64)
    dense[words["i"].to_numpy()] = words["w"].to_numpy()
    row = listed.sparkSession.createDataFrame(pa.table({"_bits": ragged(dense, np.array([len(dense)]))}))
    return row, F.get("_bits", F.floor(slot / 64).cast("int")).bitwiseAND(one) != 0


def only_listed(df: DataFrame, key: str, listed: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """``df`` without most rows whose ``key`` isn't in ``listed`` (key): what is left is a superset of the semi-join.

    The bitmap is broadcast as one row, so the join without a key makes no more rows than ``df`` has.
    """
    row, listed_too = _bitmap(listed, key, most_bits)
    return df.join(F.broadcast(row)).where(listed_too).drop("_bits")


def without_listed(df: DataFrame, key: str, listed: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """``df`` without the rows whose ``key``, never null, is in ``listed`` (key). Only rows that a bitmap can't clear are shuffled."""
    row, listed_too = _bitmap(listed, key, most_bits)
    marked = df.join(F.broadcast(row))
    return marked.where(~listed_too).drop("_bits").unionByName(marked.where(listed_too).drop("_bits").join(listed, key, "left_anti"))


def give_back() -> None:
    """Returns a worker's unused memory to the system: the same process serves other operators next, beside other workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25), (32, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


#: A key with more than this share of a table's rows, and more than so many rows, is looked up apart: at most 1 / HOT keys.
HOT, HOT_ROWS = 1e-3, 10_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a few keys may hold most rows of ``left``, a staged table; ``right`` has one row for each key.

    Rows of hot keys, at most 1 / HOT of them, meet a broadcast table; all others are joined as the planner likes. A
    table of no more than ``HOT_ROWS`` rows has no such key.
    """
    if left.limit(HOT_ROWS + 1).count() <= HOT_ROWS:
        return left.join(right, keys, how)
    counts = left.groupBy(keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > HOT_ROWS)
    if hot.limit(1).count() == 0:
        return left.join(right, keys, how)
    hot = F.broadcast(hot.where(F.col("_n") > F.lit(HOT * left.count())).select(keys))
    return left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how).unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): node, root = the component's smallest node.

    In a round every node takes its smallest neighbour for parent, parents are followed to their end by doubling, and
    edges are drawn anew between these ends, which leaves few; a round without edges is the last. Every step is a
    staged table, so a lost executor costs one step, and hubs of many edges or children are joined apart. Nothing but
    whether rows are left comes to the driver. No edges: no rows.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stage(edges.where("a <> b").select(*ordered("a", "b")).distinct(), f"{name}-edges")
    if left.limit(1).count() == 0:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = stage(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), f"{name}-nodes")
    for _ in range(max_rounds):
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        parent = stage(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), f"{name}-parents")
        while True:
            step = stage(join_hot(parent, parent.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"]).select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), f"{name}-steps")
            parent = step.select("node", "root")
            if step.where("moved").limit(1).count() == 0:
                break
        found = stage(join_hot(found, parent.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-nodes")
        half = join_hot(left, parent.select(F.col("node").alias("a"), F.col("root").alias("x")), ["a"]).select("b", "x").distinct()
        half = stage(half, f"{name}-half")
        drawn = join_hot(half, parent.select(F.col("node").alias("b"), F.col("root").alias("y")), ["b"]).where("x <> y")
        left = stage(drawn.select(*ordered("x", "y")).distinct(), f"{name}-edges")
        if left.limit(1).count() == 0:
            return found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
