"""Hierarchical packing: documents are routed to context-size tiers, each tier is packed, shorter tiers fill long windows' gaps."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, map_arrow
from lumenframe.llm.units import library_encoder

#: Context sizes, longest first; all are powers of two.
TIERS = (2048, 1024, 512, 256)
#: Sequences of one step group hold so many ids together, or all that are left at a partition's end.
STEP_IDS = 8 * 2048
#: Ids of a partition that are packed together; what fills no window waits for the next lot.
LOT_IDS = 1 << 20


class Packer:
    """Packs pieces of documents into windows. ``add`` and ``close`` return sequences: lists of (doc, start, length).

    Every full longest window of a document is a sequence of its own. The rest belongs to the smallest tier that
    holds it. Rests of the longest tier open windows; the best-fitting rests of shorter tiers fill their gaps, and
    where none fits, the smallest rest is cut to the gap. Then the next tier's rests open windows of its size.
    A window that shorter rests can't fill waits in the pool for the next lot; in the end the rests are cut into
    windows of ever smaller powers of two. No sequence needs padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.pool: list[tuple[int, int, int]] = []  # (length, doc, start), sorted

    def add(self, docs: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        top, out = self.tiers[0], []
        for doc, n in docs:
            full = n // top * top
            out += [[(doc, s, top)] for s in range(0, full, top)]
            if n > full:
                self.pool.append((n - full, doc, full))
        self.pool.sort()
        for i, size in enumerate(self.tiers):
            low = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            while self.pool and low < self.pool[-1][0] <= size:
                window = self._window(size)
                if window is None:
                    break
                out.append(window)
        return out

    def _window(self, size: int) -> list[tuple[int, int, int]] | None:
        """A full window that the longest rest opens; None, with the pool as it was, if all rests together can't fill it."""
        taken = [self.pool.pop()]
        gap = size - taken[0][0]
        while gap and self.pool:
            at = bisect.bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                taken.append(self.pool.pop(at))
                gap -= taken[-1][0]
            else:
                n, doc, start = self.pool.pop(0)
                taken.append((gap, doc, start))
                bisect.insort(self.pool, (n - gap, doc, start + gap))
                gap = 0
        if gap:
            for x in taken:
                bisect.insort(self.pool, x)
            return None
        return [(doc, start, n) for n, doc, start in taken]

    def close(self) -> list[list[tuple[int, int, int]]]:
        """The waiting rests, in windows of the tiers' sizes and, at the end, of smaller powers of two."""
        out, left = [], sum(x[0] for x in self.pool)
        while left:
            size = min(self.tiers[0], 1 << left.bit_length() - 1)
            gap, window = size, []
            while gap:
                n, doc, start = self.pool.pop()
                use = min(n, gap)
                window.append((doc, start, use))
                if n > use:
                    self.pool.append((n - use, doc, start + use))
                gap -= use
            out.append(window)
            left -= size
        return out


def pack(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Packs every whole text's ids, with ``end_id`` after them, into sequences of at most ``tiers[0]`` ids.

    One row for each piece: id, start, length, ids_crc32 (unsigned, of little-endian 32-bit ids), doc_tokens,
    sequence_id, offset, sequence_length and step_group. Partitions are packed on their own, without a shuffle;
    sequence ids are the partition's number times 2**40 plus a count, and step groups likewise. A step group's
    sequences hold ``STEP_IDS`` ids together, longest first, but for a partition's last group.

    Null and empty texts are their end id. Documents of any length are cut as needed; repeated rows are packed
    each. An empty table has no pieces. ``path`` names a tokenizers file, readable on every worker, whose pieces
    drop white space, with ids below 65,536.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        encoder, packer = library_encoder(path, spaced=False), Packer(tiers)
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        left: dict[int, int] = {}
        waiting: list[list[tuple[int, int, int]]] = []
        made = [0, 0, 0]  # documents, sequences, step groups so far

        def rows(sequences: list[list[tuple[int, int, int]]], last: bool) -> Iterator[pa.RecordBatch]:
            waiting.extend(sequences)
            waiting.sort(key=lambda s: (-sum(p[2] for p in s), s[0]))
            groups, held = [], 0
            for i, s in enumerate(waiting):
                held += sum(p[2] for p in s)
                if held >= STEP_IDS or last and i + 1 == len(waiting):
                    groups.append(i + 1)
                    held = 0
            out: list[tuple] = []
            begin = 0
            for end in groups:
                for s in waiting[begin:end]:
                    offset, size = 0, sum(p[2] for p in s)
                    for doc, start, n in s:
                        x = ids[doc]
                        out.append((names[doc], start, n, zlib.crc32(x[start : start + n].astype("<u4").tobytes()), len(x), base + made[1], offset, size, base + made[2]))
                        offset += n
                        left[doc] -= n
                        if not left[doc]:
                            del ids[doc], names[doc], left[doc]
                    made[1] += 1
                made[2] += 1
                begin = end
            del waiting[:begin]
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"])

        lot: list[tuple[int, int]] = []
        held = 0
        kind = pa.int64()
        for b in by_bytes(batches, "t"):
            kind = b["id"].type
            flat, sizes = encoder.encode_many(b["t"])
            ends = np.cumsum(sizes)
            for key, e, s in zip(b["id"].to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                doc = made[0]
                made[0] += 1
                ids[doc], names[doc], left[doc] = np.append(flat[e - s : e], np.uint16(end_id)), key, s + 1
                lot.append((doc, s + 1))
                held += s + 1
                if held >= LOT_IDS:
                    yield from rows(packer.add(lot), last=False)
                    lot, held = [], 0
        yield from rows(packer.add(lot), last=False)
        yield from rows(packer.close(), last=True)

    schema = f"id {dict(df.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), run, schema).withColumnRenamed("id", id_col)
