"""Threshold tuning: all combinations of window, threshold and shortest run, by event F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import prf
from lumenframe.operators.trajectory import DIGITS


#: Cells of a table of medians, and rows of series for which runs are looked up, that a worker holds at a time.
CELLS = 1 << 20
#: Rounds in which predictions of all series choose side by side; what is left then (long chains of rivals) is chosen one by one.
ROUNDS = 8


def median_smooth(score: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """The median of the 2 * (window // 2) + 1 values about each, of fewer at the ends of each series, rounded as ``smooth`` does.

    ``score`` holds all series one after the other, series i from ``ends[i]`` to ``ends[i + 1]``. NaN are left out.
    """
    half = window // 2
    if window <= 1 or not len(score):
        return score
    size, out = np.diff(ends), np.empty(len(score))
    low, high, step = np.repeat(ends[:-1], size), np.repeat(ends[1:], size), max(1, CELLS // (2 * half + 1))
    for at in range(0, len(score), step):
        here = np.arange(at, min(at + step, len(score)))
        near = here[:, None] + np.arange(-half, half + 1)
        inside = (near >= low[here, None]) & (near < high[here, None])
        values = np.sort(np.where(inside, score[np.where(inside, near, 0)], np.nan), axis=1)
        n = (~np.isnan(values)).sum(axis=1)
        middle = lambda i, v=values: np.take_along_axis(v, np.maximum(i, 0)[:, None], axis=1)[:, 0]
        out[here] = (middle((n - 1) // 2) + middle(n // 2)) / 2
    scaled = out * 10.0**DIGITS
    near = np.rint(scaled)
    whole = np.where(np.abs(scaled - near) == 0.5, scaled + np.sign(scaled) * 0.5, near) / 10.0**DIGITS
    return np.where(np.abs(scaled) < 2.0**52, whole, out)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of n[0] numbers, then the same of first[1], and so on."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def choices(run: np.ndarray, event: np.ndarray, n_runs: int, n_events: int) -> np.ndarray:
    """Which runs get an event. Pairs (run, event) come by run, a run's best last; runs choose in order, the best event still free.

    A run whose events no earlier run could take chooses at once, side by side with all such runs.
    """
    got = np.zeros(n_runs, bool)
    for _ in range(ROUNDS):
        if not len(run):
            return got
        first, ready, taken = np.empty(n_events, np.int64), np.ones(n_runs, bool), np.zeros(n_events, bool)
        first[event[::-1]] = run[::-1]
        ready[run[first[event] != run]] = False
        chosen = ready[run] & np.append(run[1:] != run[:-1], True)
        got[run[chosen]], taken[event[chosen]] = True, True
        left = ~ready[run] & ~taken[event]
        run, event = run[left], event[left]
    used, last = set(), -1
    best_first = np.lexsort((-np.arange(len(run)), run))
    for r, e in zip(run[best_first].tolist(), event[best_first].tolist(), strict=True):
        if r != last and e not in used:
            used.add(e)
            got[r], last = True, r
    return got


def rivals(owner: np.ndarray, begin: np.ndarray, end: np.ndarray, t_owner: np.ndarray, t_begin: np.ndarray, t_end: np.ndarray, iou: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a run and a true event of its series with an overlap of ``iou`` or more: by run, in order of overlap, then of events.

    Such an event begins before the run's end, and is at most 1 / iou times as long as the run. Starts of all series are put
    on one line, a stretch for each series, which may round: the search takes a little more, and the overlap decides.
    """
    if not len(begin) or not len(t_begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    long = np.abs(end - begin)
    reach = long * (1 / iou) * (1 + 1e-9) if iou > 0 else np.full(len(begin), np.inf)
    known = t_begin[~np.isnan(t_begin)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    stretch = (high - low) * 1.5 + 1.0
    slack = 8 * np.spacing(stretch * (max(owner.max(), t_owner.max()) + 2)) + 1e-9
    line = lambda who, x: who * stretch + (np.clip(x, low - stretch / 8, high + stretch / 8) - low)
    key = line(t_owner, np.nan_to_num(t_begin, nan=low))
    order = np.argsort(key, kind="stable")
    last = end if iou > 0 else np.full(len(end), np.inf)
    from_, to = np.searchsorted(key[order], line(owner, begin - reach) - slack), np.searchsorted(key[order], line(owner, last) + slack, "right")
    n = np.maximum(to - from_, 0)
    run, event = np.repeat(np.arange(len(begin)), n), order[spread(from_, n)]
    hull = np.maximum(end[run], t_end[event]) - np.minimum(begin[run], t_begin[event])
    both = np.maximum(0.0, np.minimum(end[run], t_end[event]) - np.maximum(begin[run], t_begin[event]))
    share = np.divide(both, hull, out=np.zeros(len(run)), where=hull > 0)
    fit = np.flatnonzero((share >= iou) & (owner[run] == t_owner[event]))
    fit = fit[np.lexsort((event[fit], share[fit], run[fit]))]
    return run[fit], event[fit]


def tally(start: np.ndarray, score: np.ndarray, ends: np.ndarray, t_begin: np.ndarray, t_end: np.ndarray, t_ends: np.ndarray, group: np.ndarray, n_groups: int, thresholds: list[float], windows: list[int], min_consecs: list[int], iou: float, chunk: float) -> np.ndarray:
    """tp, fp, fn of all series of each group for every combination: (groups, windows, thresholds, min_consecs, 3).

    Series and their true events (in order of pos) lie one after the other, series i from ``ends[i]`` and ``t_ends[i]`` on.
    Thresholds between two neighbouring scores of a series give the same runs: those of each series and score level are
    found once, for all series of a slice side by side, and count for all thresholds down to the next lower level.
    """
    order, n_t = np.argsort(thresholds, kind="stable"), len(thresholds)
    limits, size = np.asarray(thresholds, float)[order], np.diff(ends)
    t_owner, n_true = np.repeat(np.arange(len(size)), np.diff(t_ends)), np.bincount(group, np.diff(t_ends), n_groups).astype(np.int64)
    steps = np.zeros((2, len(windows), len(min_consecs), n_groups, n_t + 1), np.int64)
    for w, window in enumerate(windows):
        smooth = median_smooth(score, ends, window)
        level = np.where(np.isnan(smooth), 0, np.searchsorted(limits, smooth, "right"))
        seen = np.unique(np.repeat(np.arange(len(size)), size) * (n_t + 1) + level)
        owner, up = np.divmod(seen, n_t + 1)
        down = np.where(np.append(-1, owner[:-1]) == owner, np.append(0, up[:-1]), 0)
        owner, up, down = owner[up > 0], up[up > 0], down[up > 0]
        place = np.cumsum(size[owner])
        cuts = [0, *(np.flatnonzero(np.diff(place // CELLS)) + 1).tolist(), len(owner)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            o, u, d = owner[lo:hi], up[lo:hi], down[lo:hi]
            _levels(start, smooth, level, ends, size, o, u, d, t_begin, t_end, t_owner, group, min_consecs, iou, chunk, steps[:, w])
    hits, kept = np.cumsum(steps[..., :n_t], axis=-1)
    out = np.empty((n_groups, len(windows), n_t, len(min_consecs), 3), np.int64)
    for i, n in enumerate((hits, kept - hits, n_true[:, None] - hits)):
        out[..., i][:, :, order] = n.transpose(2, 0, 3, 1)
    return out


def _levels(start: np.ndarray, score: np.ndarray, level: np.ndarray, ends: np.ndarray, size: np.ndarray, owner: np.ndarray, up: np.ndarray, down: np.ndarray, t_begin: np.ndarray, t_end: np.ndarray, t_owner: np.ndarray, group: np.ndarray, min_consecs: list[int], iou: float, chunk: float, steps: np.ndarray) -> None:
    """Adds, for each pair of a series and a level, hits and runs to ``steps`` where its thresholds begin, and takes them off where they end."""
    if not len(owner):
        return
    n = size[owner]
    rows, pair = spread(ends[owner], n), np.repeat(np.arange(len(owner)), n)
    on = np.flatnonzero(level[rows] >= up[pair])
    new = np.append(True, (np.diff(on) > 1) | (np.diff(pair[on]) > 0))
    first = np.flatnonzero(new)
    length, peak = np.diff(np.append(first, len(on))), np.maximum.reduceat(score[rows[on]], first)
    begin, end, pair = start[rows[on[first]]], start[rows[on[first + length - 1]]] + chunk, pair[on[first]]
    chosen = np.lexsort((length, end, begin, -peak, pair))
    length, begin, end, pair = length[chosen], begin[chosen], end[chosen], pair[chosen]
    # Events of a series are free anew at each of its levels.
    run, event = rivals(owner[pair], begin, end, t_owner, t_begin, t_end, iou)
    _, event = np.unique(pair[run] * np.int64(max(len(t_begin), 1)) + event, return_inverse=True)
    for k, shortest in enumerate(min_consecs):
        kept, fit = length >= shortest, length[run] >= shortest
        got = choices(run[fit], event[fit], len(length), len(event))
        for i, flags in enumerate((got, kept)):
            each = np.bincount(pair[flags], minlength=len(owner))
            np.add.at(steps[i, k], (group[owner], down), each)
            np.subtract.at(steps[i, k], (group[owner], up), each)


def tune(scores: DataFrame, truth: DataFrame, thresholds: list[float], windows: list[int], min_consecs: list[int], iou: float = 0.3, chunk: float = 2.0) -> DataFrame:
    """The best (threshold, window, min_consec) of each class with its tp, fp, fn and F1 over all videos.

    F1 is compared after rounding to four digits; of equal ones the first in order of window, threshold and
    min_consec wins. One shuffle brings a video's trajectory and true events of a class together; all combinations
    are tried there, for all series of a batch side by side, and only their counts, summed up in each task, go on. Classes without any event get tp = fp = 0.
    """
    t = F.array_sort(F.collect_list(F.struct(F.col("start_sec").cast("double").alias("s"), F.col("score").cast("double").alias("x"))))
    g = F.array_sort(F.collect_list(F.struct("pos", F.col("start_sec").cast("double").alias("s"), F.col("end_sec").cast("double").alias("e"))))
    both = scores.groupBy("video", "class").agg(t.alias("t")).join(truth.groupBy("video", "class").agg(g.alias("g")), ["video", "class"], "left").select("class", "t", "g")
    shape = (len(windows), len(thresholds), len(min_consecs))

    def parts(lists: pa.Array, *names: str) -> list[np.ndarray]:
        """Ends of the lists of structs and their fields; a null list is an empty one."""
        flat = lists.flatten()
        return [np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), *(flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            classes = b["class"].dictionary_encode(null_encoding="encode")
            (ends, starts, values), (t_ends, t_begin, t_end) = parts(b["t"], "s", "x"), parts(b["g"], "s", "e")
            found = tally(starts, values, ends, t_begin, t_end, t_ends, classes.indices.to_numpy(), len(classes.dictionary), thresholds, windows, min_consecs, iou, chunk)
            for cls, n in zip(classes.dictionary.to_pylist(), found, strict=True):
                sums[cls] = sums[cls] + n if cls in sums else n
        at = np.indices(shape).reshape(3, -1)
        for cls, n in sums.items():
            flat = n.reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([cls] * len(flat), kind), *(pa.array(x.astype(np.int32)) for x in at), *(pa.array(flat[:, i]) for i in range(3))], ["class", "w_idx", "t_idx", "k_idx", "tp", "fp", "fn"])

    name = dict(scores.dtypes)["class"]
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[name]
    counts = both.mapInArrow(run, f"class {name}, w_idx int, t_idx int, k_idx int, tp long, fp long, fn long")
    full = counts.groupBy("class", "w_idx", "t_idx", "k_idx").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    scored = full.withColumn("f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("f1"), "w_idx", "t_idx", "k_idx"))).where("_r = 1")  # a row for each combination
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), F.col(i) + 1)
    return best.select("class", at(thresholds, "t_idx").alias("threshold"), at(windows, "w_idx").alias("window"), at(min_consecs, "k_idx").alias("min_consec"), F.col("f1").alias("val_f1"), F.col("tp").alias("val_tp"), F.col("fp").alias("val_fp"), F.col("fn").alias("val_fn"))
