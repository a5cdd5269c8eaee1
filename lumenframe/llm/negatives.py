"""Hard negatives: rows of other labels that score close below a positive, exact, by bounds in a rotated space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import map_arrow, ragged, stage
from lumenframe.llm.topk import _by_dim, exact_scores, quantized

#: Leading components summed up before the next look at the bounds.
STEP = 16
#: Components of the vectors that a task compares at once, of the anchors that it holds, and scores held at once.
BLOCK_CELLS, ANCHOR_CELLS, SCORE_CELLS = 1 << 20, 1 << 22, 1 << 22
#: Cells of all rotations together; vectors of further lengths keep their own axes, which are orthogonal, too.
ROTATION_CELLS = 1 << 22
_UNIT = 2.0**-52


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vector the sums of products of components, a row for each component."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, _, vectors in _by_dim(b["id"], b["vec"]):
            if 0 < dim * dim <= ROTATION_CELLS:
                x = vectors.astype(np.float64)
                sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), ragged(m.ravel(), np.full(dim, dim))], ["dim", "i", "row"])


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector in ``rows`` (id, vec) the principal axes of all its rows, largest first.

    The driver gets ``ROTATION_CELLS`` numbers at most: shorter vectors first, the others are not rotated.
    """
    lengths = [r[0] for r in rows.select(F.size("vec").alias("dim")).where(f"dim * dim <= {ROTATION_CELLS}").distinct().orderBy("dim").limit(int(ROTATION_CELLS**0.5)).collect()]
    taken = np.array(lengths)[np.cumsum(np.array(lengths, np.int64) ** 2) <= ROTATION_CELLS].tolist() if lengths else []
    if not taken:
        return {}
    parts = map_arrow(rows.where(F.size("vec").isin(taken)), _moments, "dim long, i long, row array<double>")
    cells = parts.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    dims, i, j, x = (cells[c].to_numpy() for c in ("dim", "i", "j", "x"))
    for dim in np.unique(dims).tolist():
        at = dims == dim
        m = np.zeros((dim, dim))
        m[i[at], j[at]] = x[at]
        if np.isfinite(m).all():
            out[dim] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


class Rotated:
    """Vectors in a rotated space: components, and the norms of what comes after every ``STEP`` of them."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None) -> None:
        x = vectors.astype(np.float64)
        self.whole, self.size = vectors, np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)
        self.x = x if axes is None else x @ axes
        self.cuts = list(range(0, x.shape[1], STEP)) or [0]
        self.rest = [np.sqrt((self.x[:, c + STEP :] ** 2).sum(axis=1)) * (1 + 1e-9) for c in self.cuts]
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0))


def rounding(dim: int, axes: np.ndarray | None) -> float:
    """What a computed product of rotated vectors can be off by, as a share of the product of their norms."""
    bent = 0.0 if axes is None else float(np.linalg.norm(axes @ axes.T - np.eye(dim)))
    return bent + 16 * (dim + 8) * _UNIT


def survivors(anchors: Rotated, rows: Rotated, share: float, low: np.ndarray, high: np.ndarray, open_pairs: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``open_pairs`` with low <= score <= high of the anchor, and their exact scores.

    Scores grow ``STEP`` leading components at a time; the rest lies within plus or minus the product of the norms of
    the remainders, and ``share`` of the product of the norms covers rounding. What can't reach the window goes.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, dim = len(rows.x), rows.x.shape[1]
    low, high = low.astype(np.float64), high.astype(np.float64)
    # a double next to a 64-bit bound may be off by 2**-53 of it; scores beyond 64 bits tie at its ends
    low = np.where(low <= -(2.0**63), -np.inf, low - np.abs(low) * 2 * _UNIT)
    high = np.where(high >= 2.0**63, np.inf, high + np.abs(high) * 2 * _UNIT)
    most = anchors.most * rows.most * max(dim, 1)
    for begin in range(0, len(anchors.x), max(1, SCORE_CELLS // max(n, 1))):
        end = min(len(anchors.x), begin + max(1, SCORE_CELLS // max(n, 1)))
        part = anchors.x[begin:end, :STEP] @ rows.x[:, :STEP].T
        wide = np.outer(anchors.rest[0][begin:end], rows.rest[0]) + share * np.outer(anchors.size[begin:end], rows.size)
        a, r = np.nonzero((part + wide >= low[begin:end, None]) & (part - wide <= high[begin:end, None]) & open_pairs(begin, end))
        score = part[a, r]
        a += begin
        for k, cut in list(enumerate(rows.cuts))[1:]:
            for at in range(0, len(a), SCORE_CELLS // STEP):
                s = slice(at, at + SCORE_CELLS // STEP)
                score[s] += np.einsum("ij,ij->i", anchors.x[a[s], cut : cut + STEP], rows.x[r[s], cut : cut + STEP])
            wide = anchors.rest[k][a] * rows.rest[k][r] + share * anchors.size[a] * rows.size[r]
            stay = (score + wide >= low[a]) & (score - wide <= high[a])
            a, r, score = a[stay], r[stay], score[stay]
        exact = np.zeros(len(a), np.int64)
        if most < 2.0**62:
            for at in range(0, len(a), SCORE_CELLS // max(dim, 1) or 1):
                s = slice(at, at + (SCORE_CELLS // max(dim, 1) or 1))
                exact[s] = np.einsum("ij,ij->i", anchors.whole[a[s]], rows.whole[r[s]])
        else:
            for one in np.unique(a).tolist():
                exact[a == one] = exact_scores(rows.whole[r[a == one]], anchors.whole[one], most)
        out.append((a, r, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def unrepeated(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """The rows without those that have ``keep`` rows of smaller ids with the same label and vector before them."""
    odd = np.random.default_rng(7).integers(0, 1 << 62, vectors.shape[1], dtype=np.int64) * 2 + 1
    code = vectors @ odd + labels * np.int64(0x9E3779B97F4A7C1)
    order = np.lexsort((ids, labels, code))
    same = np.zeros(len(order), bool)
    same[1:] = (labels[order[1:]] == labels[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
    at = np.flatnonzero(same)
    same[at] = (vectors[order[at]] == vectors[order[at - 1]]).all(axis=1) if len(at) else False
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - start < keep])


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, ~score, group))
    return order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < k]


class Near:
    """The ``k`` best rows so far of each of a number of searches; a search is an anchor's, below a score of its own.

    ``same``: whether rows of the anchor's label are searched, or of others. Every search has the window from ``low``
    to ``high``, which closes from below as its k-th best score rises.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, anchors: Rotated, share: float, axes: np.ndarray | None, k: int, same: bool, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.labels, self.anchors, self.share, self.axes, self.k, self.same = ids, labels, anchors, share, axes, k, same
        self.of, self.low, self.high = of, low, high  # searches in the order of their anchors
        self.group, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        if not len(self.of):
            return
        keep = unrepeated(ids, labels, vectors, self.k + 1)  # one of them may be the anchor
        ids, labels, rows = ids[keep], labels[keep], Rotated(vectors[keep], self.axes)
        floor = self.low.copy()
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.of)) == self.k)
        floor[full] = np.maximum(floor[full], self.score[np.searchsorted(self.group, full, "right") - 1])
        n = len(self.ids)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, self.of, floor)
        np.maximum.at(most, self.of, self.high)
        has = np.bincount(self.of, minlength=n) > 0
        open_pairs = lambda b, e: ((self.labels[b:e, None] == labels[None]) == self.same) & (self.ids[b:e, None] != ids[None]) & has[b:e, None]
        a, r, score = survivors(self.anchors, rows, self.share, least, most, open_pairs)
        first, last = np.searchsorted(self.of, np.arange(n)), np.searchsorted(self.of, np.arange(n), "right")
        group, vec, found = [self.group], [self.vec], [self.score]
        for i in range(int((last - first).max(initial=0))):  # the i-th search of every anchor
            at = np.flatnonzero(first[a] + i < last[a])
            g = first[a[at]] + i
            inside = (score[at] >= floor[g]) & (score[at] <= self.high[g])
            group.append(g[inside])
            vec.append(ids[r[at[inside]]])
            found.append(score[at[inside]])
        g, v, s = np.concatenate(group), np.concatenate(vec), np.concatenate(found)
        stay = best(g, s, v, self.k)
        self.group, self.vec, self.score = g[stay], v[stay], s[stay]


def _search(shared, k: int, same: bool) -> Callable:
    """Rows (id, label, vec) to the best of each search: anchor_id, high (the search's own score), vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {}
        for dim, (ids, labels, vectors, axes, of, low, high) in shared.value.items():
            near[dim] = Near(ids, labels, Rotated(vectors, axes), rounding(dim, axes), axes, k, same, of, low, high)
        held: list[pa.RecordBatch] = []
        cells = 0

        def flush() -> None:
            pairs = pa.concat_arrays([b["id"] for b in held]), pa.concat_arrays([b["label"] for b in held]), pa.concat_arrays([b["vec"] for b in held])
            places = pa.array(np.arange(len(pairs[0])))
            ids, labels = np.asarray(pairs[0]), np.asarray(pairs[1])
            for dim, at, vectors in _by_dim(places, pairs[2]):
                step = max(1, BLOCK_CELLS // max(dim, 1))
                for low in range(0, len(at) if dim in near else 0, step):
                    near[dim].add(ids[at[low : low + step]], labels[at[low : low + step]], vectors[low : low + step])

        for b in batches:
            held.append(b)
            cells += len(b) + len(b["vec"].values)
            if cells >= BLOCK_CELLS:
                flush()
                held, cells = [], 0
        if held:
            flush()
        for x in near.values():
            for low in range(0, len(x.group), 1 << 16):
                g = x.group[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.of[g]]), pa.array(x.high[g]), pa.array(x.vec[low : low + (1 << 16)]), pa.array(x.score[low : low + (1 << 16)])], ["anchor_id", "high", "vec_id", "score"])

    return run


def _ranked(rows: DataFrame, shared, k: int, same: bool, name: str) -> DataFrame:
    found = map_arrow(rows, _search(shared, k, same), "anchor_id long, high long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id")
    return stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


def mine(
    df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: negatives that score almost as high as a positive.

    ``anchors`` is a condition on ``df`` and ``label`` a column of it. An anchor's positives are its ``positives`` best
    other rows of its label; a positive's negatives the ``negatives`` best rows of other labels that score at most as
    high as the positive and at least four fifths of that. Ties go to the smaller id.

    Rows are turned to the principal axes of all rows. Anchors go in blocks of about ``ANCHOR_CELLS`` components, each
    two jobs over the rows where they lie: for the positives, whose scores then bound the windows of the negatives. Of
    every task only the best rows of a search go on, and of equal rows of a label only the first few can be among them,
    so neither a large label nor a vector that a third of all rows share makes a large group. Bounds come from doubles
    with their rounding error; results from 64-bit integers.

    Rows whose id, label, vector or any component is null, or that hold a component that isn't finite, take no part.
    Rows meet rows with vectors of the same length only. Anchors that repeat an id are one (the first label and vector
    in order) and never meet a row of that id; other rows count as often as they occur. Scores and components beyond
    64 bits are the nearest 64-bit integer, and such scores tie. A positive whose score is below 0 has no negatives.
    An empty table gives no rows. Columns other than those named are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantized(F.col(vec_col), scale).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = stage(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()), "negatives-rows")
    asked = stage(rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec"), "negatives-anchors")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("vec") + 1)).first()[0] or 0) // ANCHOR_CELLS))
    axes = rotations(rows.select("id", "vec"))
    rows, out = rows.select("id", "label", "vec"), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about ANCHOR_CELLS components
        held = {}
        if len(part):
            names, labels = part["id"].to_numpy(), part["label"].to_numpy()
            for dim, at, vectors in _by_dim(pa.array(np.arange(len(part))), part["vec"].combine_chunks()):
                order = np.argsort(names[at], kind="stable")
                at, widest = at[order], np.iinfo(np.int64)
                held[dim] = (names[at], labels[at], vectors[order], axes.get(dim), np.arange(len(at)), np.full(len(at), widest.min), np.full(len(at), widest.max))
        found = _ranked(rows, spark.sparkContext.broadcast(held), positives, True, "negatives-positives")
        bounds = found.where("score >= 0").select("anchor_id", F.col("score").alias("high")).distinct().orderBy("anchor_id", "high").toArrow()  # a few for each anchor
        who, high = bounds["anchor_id"].to_numpy(), bounds["high"].to_numpy()
        windows = {}
        for dim, (names, labels, vectors, turn, *_) in held.items():
            own = np.isin(who, names)
            of, top = np.searchsorted(names, who[own]), high[own]
            windows[dim] = (names, labels, vectors, turn, of, top - top // 5, top)  # 80 p <= 100 n: n >= p - floor(p / 5)
        negative = _ranked(rows, spark.sparkContext.broadcast(windows), negatives, False, "negatives-found")
        pairs = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        chosen = negative.select("anchor_id", F.col("high").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        both = pairs.join(chosen, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = both if out is None else out.unionByName(both)
    return out
