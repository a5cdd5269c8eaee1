"""Runs over a threshold on unbounded trajectories: the batch operator's rows, though windows arrive late and mixed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "video string, class string, start_sec double, end_sec double, peak double, mean double, n_windows long"
#: The open run: first start, last start, peak, sum and number of windows, and the last window's event time.
RUN = "start double, last double, peak double, total double, n long, ts long"
#: State lives in RocksDB, which keeps the buffers of all keys outside of the executors' heaps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunProcessor(StatefulProcessor):
    """Holds windows back until the watermark has passed them, then takes them in order of their start."""

    def __init__(self, threshold: float, min_run: int, chunk: float, timeout_ms: int) -> None:
        self.threshold, self.min_run, self.chunk, self.timeout_ms = threshold, min_run, chunk, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "start double", "score double, ts long")
        self.run = handle.getValueState("run", RUN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        first = None
        for frame in rows:
            for start, score, ts in zip(frame["start_sec"].tolist(), frame["score"].tolist(), frame["at"].tolist(), strict=True):
                if self.buffer.containsKey((start,)):  # of windows of one start the best counts
                    was = self.buffer.getValue((start,))
                    score, ts = max(was[0], score), max(was[1], ts)
                self.buffer.updateValue((start,), (score, ts))
                first = ts if first is None else min(first, ts)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now, closed = timerValues.getCurrentWatermarkInMs(), []
        held = [(k[0], *v) for k, v in self.buffer.iterator()]
        ripe = sorted(x for x in held if x[2] <= now)
        run = self.run.get() if self.run.exists() else None
        was = run

        def close(r: tuple) -> None:
            if r[4] >= self.min_run:
                closed.append((key[0], key[1], r[0], r[1] + self.chunk, r[2], r[3] / r[4], r[4]))

        for start, score, ts in ripe:
            if score >= self.threshold:
                run = (run[0], start, max(run[2], score), run[3] + score, run[4] + 1, max(run[5], ts)) if run else (start, start, score, score, 1, ts)
            elif run:
                close(run)
                run = None
            self.buffer.removeKey((start,))
        if run and run[5] + self.timeout_ms <= now:
            close(run)
            run = None
        if run and run != was:
            self.run.update(tuple(run))
            self.handle.registerTimer(int(run[5] + self.timeout_ms))
        elif not run and was:
            self.run.clear()
        if len(ripe) < len(held):
            self.handle.registerTimer(min(x[2] for x in held if x[2] > now))
        if closed:
            yield pd.DataFrame(closed, columns=["video", "class", "start_sec", "end_sec", "peak", "mean", "n_windows"])

    def close(self) -> None:
        pass


def stream_runs(scores: DataFrame, threshold: float, min_run: int = 1, chunk: float = 2.0, lateness: str = "10 seconds", timeout_ms: int = 60_000) -> DataFrame:
    """Closed runs of a stream of (video, class, start_sec, score, ts): the batch ``runs``, as windows arrive.

    Windows may come in any order and any batch within ``lateness``: they wait in the state until the watermark has
    passed their ts, which must rise with start_sec in a video and class, and are then taken in order of start_sec.
    Later ones are dropped. A run closes at the first window below the threshold (a null score is below), or when the
    watermark is ``timeout_ms`` past its last window. The state of a key is its open run and the windows of the last
    ``lateness``; a restart from the checkpoint goes on where the query stopped. The session must keep state in
    RocksDB (``PROVIDER``).
    """
    spark = scores.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
    timed = scores.select(F.col("video").cast("string").alias("video"), "class", F.col("start_sec").cast("double").alias("start_sec"), score.alias("score"), F.unix_millis("ts").alias("at"), "ts").withWatermark("ts", lateness)
    return timed.groupBy("video", "class").transformWithStateInPandas(RunProcessor(threshold, min_run, chunk, timeout_ms), OUT, "Append", "EventTime")
