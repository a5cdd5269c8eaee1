"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, map_arrow, ragged, stage, stage_dir
from lumenframe.llm.units import library_encoder

#: Ids that a block holds before the next one begins, at a document's end, and about the ids of one part (32 MB).
BLOCK_IDS, PART_IDS = 1 << 15, 1 << 24
#: Parts whose starts are added up together; of each such group one row goes to a single task.
GROUP_PARTS = 1024
#: Starts of so many parts at most are broadcast (some 32 MB); more are joined by shuffle.
BROADCAST_PARTS = 1_000_000
_BLOCKS = "part int, start long, n_ids long, doc_ids array<long>, sizes array<long>, control binary, data binary"

_SHAPES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two bits for each rank say how many bytes, 1 to 4, it takes; its low bytes follow each other in data."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``pack_ranks`` for ``n`` ranks; sizes come from a table of the 256 control bytes."""
    size = _SHAPES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    out = raw[at]
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        out[more] |= raw[at[more] + i] << np.uint32(8 * i)
    return out


def encode(df: DataFrame, path: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """Each document where it lies: id, h (a hash of its text), row (its place), n and its ids as two-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = library_encoder(path, spaced=True), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u2").tobytes()
        for b in by_bytes(batches, "t"):
            ids, sizes = encoder.encode_many(b["t"])
            raw, ends = ids.astype("<u2").tobytes(), 2 * np.cumsum(sizes)
            rows = [raw[e - 2 * s : e] + end for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["h"], pa.array(row + np.arange(len(b))), pa.array(sizes + 1), pa.array(rows, pa.binary())], ["id", "h", "row", "n", "ids"])
            row += len(b)

    read = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    return map_arrow(read, run, "id long, h long, row long, n long, ids binary")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1 << 16, np.int64)
    for b in batches:
        column = b["ids"]
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        count += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u2"), minlength=1 << 16)
    seen = np.flatnonzero(count)
    yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.int32()), "n": pa.array(count[seen], pa.int64())})


def write_tokens(df: DataFrame, where: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes token files below ``where``, documents in ascending id order.

    ``where/ranks`` holds the id of each rank, most frequent first over all documents; ``where/blocks`` holds blocks
    (part, start in the part, n_ids, doc_ids, sizes, control, data). Parts follow each other in order of their ids,
    blocks in order of start. Texts are encoded where they lie; only ids are dealt out by document id. Null texts are
    empty; null ids come first; repeated ids stand together in order of their text's hash, and may span parts.
    ``path`` names a tokenizers file with ids below 65,536, readable on every worker.
    """
    spark = df.sparkSession
    coded = stage(encode(df, path, end_id, id_col, text), "token-ids")
    counts = map_arrow(coded.select("ids"), _histogram, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    order = [r["token"] for r in counts.orderBy(F.desc("n"), "token").collect()]  # one row for each id of the vocabulary
    spark.createDataFrame([(i, t) for i, t in enumerate(order)], "rank int, token int").coalesce(1).write.parquet(f"{where}/ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    total = coded.agg(F.sum("n")).first()[0] or 0
    dealt = coded.repartitionByRange(max(4, -(-total // PART_IDS)), "id", "h", "row").sortWithinPartitions("id", "h", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        raw: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            control, data = pack_ranks(shared.value[np.frombuffer(b"".join(raw), "<u2")])
            cells = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, ["part", "start", "n_ids", "doc_ids", "sizes", "control", "data"])

        for b in batches:
            for doc, n, ids in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["ids"].to_pylist(), strict=True):
                docs.append(doc)
                sizes.append(n)
                raw.append(ids)
                size += n
                if size >= BLOCK_IDS:
                    yield block()
                    start, size, docs, sizes, raw = start + size, 0, [], [], []
        if docs:
            yield block()

    map_arrow(dealt.select("id", "n", "ids"), run, _BLOCKS).write.option("compression", "zstd").parquet(f"{where}/blocks")


def part_starts(blocks: DataFrame) -> DataFrame:
    """part and base, the number of ids in all parts before it. Sums go by groups of parts, so that no task sees every part."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP_PARTS))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = parts.groupBy("group").agg(F.sum("n").alias("all")).select("group", before(Window.orderBy("group"), "all").alias("above"))  # a row for each GROUP_PARTS parts
    inner = parts.withColumn("within", before(Window.partitionBy("group").orderBy("part"), "n"))
    return inner.join(groups, "group").select("part", (F.col("above") + F.col("within")).alias("base"))


def read_tokens(spark: SparkSession, where: str, ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids themselves.

    ids_crc32 is the unsigned crc32 of the ids as little-endian 32-bit integers. Without ``ids`` that column is left out.
    """
    token_of = np.array([r["token"] for r in spark.read.schema("rank int, token int").parquet(f"{where}/ranks").orderBy("rank").collect()], np.uint32)  # a row for each id of the vocabulary
    blocks = spark.read.schema(_BLOCKS).parquet(f"{where}/blocks")
    starts = stage(part_starts(blocks.select("part", "n_ids")), "token-starts")
    based = blocks.join(F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts, "part")
    shared = spark.sparkContext.broadcast(token_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for b in batches:
            for i in range(len(b)):
                base, start, docs, sizes, control, data = (b[c][i].as_py() for c in ("base", "start", "doc_ids", "sizes", "control", "data"))
                n = np.array(sizes, np.int64)
                flat = token[unpack_ranks(control, data, int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes, strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(base + start + ends - n, pa.int64()), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, ragged(flat.view(np.int32), n)] if ids else columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4])

    small = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return map_arrow(based, run, small + (", ids array<int>" if ids else ""))


def new_folder(spark: SparkSession) -> str:
    """A fresh place for token files in the shared folder."""
    return f"{stage_dir(spark)}/token-files-{uuid.uuid4().hex}"
