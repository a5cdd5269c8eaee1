"""Many regularised linear models fitted together: one pass over the rows gives every model's loss and gradient."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenframe.operators.blocked import matrix

#: Sums of a pass reach the driver as so many vectors; corrections kept; passes at most; largest gradient, as a share of the loss's scale.
SLOTS, MEMORY, PASSES, TOLERANCE = 16, 12, 400, 1e-8


@dataclass
class Model:
    """A model to fit: ``outputs`` linear outputs (1: logistic, more: softmax), C, and the weight of each class's rows.

    ``target`` is the column of ``y`` that a logistic model learns; rows of fold ``without`` are left out.
    """

    outputs: int
    c: float
    weights: np.ndarray
    target: int = 0
    without: int | None = None
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))


def losses(models: list[Model], params: list[np.ndarray], features: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """For each model its loss over the rows, before C, and the loss's gradient, as one vector: loss, (weights, bias) by output."""
    x = np.concatenate((features, np.ones((len(features), 1))), axis=1)
    w = np.concatenate([p.reshape(m.outputs, -1) for m, p in zip(models, params, strict=True)])
    z, at, out = x @ w.T, 0, []
    for m in models:
        part = z[:, at : at + m.outputs]
        at += m.outputs
        used = np.ones(len(x), bool) if m.without is None else fold != m.without
        if m.outputs == 1:
            t = y[:, m.target]
            weight = m.weights[t] * used
            signed = np.where(t == 1, 1.0, -1.0) * part[:, 0]
            loss = np.logaddexp(0, -signed)
            error = (-np.where(t == 1, 1.0, -1.0) / (1 + np.exp(np.clip(signed, -700, 700))))[:, None]
        else:
            t = y[:, 0]
            weight = m.weights[t] * used
            top = part.max(axis=1, keepdims=True)
            e = np.exp(part - top)
            total = e.sum(axis=1, keepdims=True)
            loss = np.log(total[:, 0]) + top[:, 0] - part[np.arange(len(t)), t]
            error = e / total
            error[np.arange(len(t)), t] -= 1
        out.append(np.concatenate(([weight @ loss], ((error * weight[:, None]).T @ x).ravel())))
    return out


def _partial(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, params = shared.value
        sums: list[np.ndarray] | None = None
        for b in batches:
            y = matrix(b["y"]).astype(np.int64)
            found = losses(models, params, matrix(b["embedding"]), y, b["fold"].to_numpy())
            sums = found if sums is None else [a + v for a, v in zip(sums, found, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([np.concatenate(sums)])], ["slot", "v"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum((matrix(c).sum(axis=0) for c in table["v"].chunks[1:]), matrix(table["v"].chunk(0)).sum(axis=0))
    return pa.table({"slot": table["slot"][:1], "v": pa.array([total])})


class Descent:
    """One model's L-BFGS: ``trial`` is where the next pass looks, ``told`` takes what it finds there."""

    def __init__(self, model: Model, dim: int) -> None:
        self.model, self.size = model, (model.outputs, dim + 1)
        self.x = self.trial = np.zeros(model.outputs * (dim + 1))
        self.f, self.g, self.step, self.direction = np.inf, None, 1.0, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done, self.scale = False, 1.0

    def told(self, sums: np.ndarray) -> None:
        w = self.trial.reshape(self.size).copy()
        w[:, -1] = 0  # the bias is free
        f, g = self.model.c * sums[0] + (w * w).sum() / 2, self.model.c * sums[1:] + w.ravel()
        if self.direction is None:
            self.scale = max(1.0, float(np.abs(g).max()))
        elif f > self.f + 1e-4 * self.step * (self.g @ self.direction) + 1e-13 * abs(self.f):
            self.step /= 2
            self.done = self.step < 1e-12
            self.trial = self.x + self.step * self.direction
            return
        if self.g is not None:
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-14 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.x, self.f, self.g = self.trial, f, g
        self.done = bool(np.abs(g).max() <= TOLERANCE * self.scale)
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q *= (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 1 / max(float(np.linalg.norm(g)), 1e-300)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        self.direction = -q
        self.step = 1.0
        self.trial = self.x + self.direction


def fit(rows: DataFrame, models: list[Model], dim: int) -> int:
    """Fits all ``models`` to ``rows`` (embedding, y array<int>, fold), sets their ``x`` and returns the number of passes.

    Each minimises |weights|^2 / 2 + C * the weighted sum of losses, biases free, by L-BFGS with steps that halve until
    they lower it. A pass is one job for all models that aren't done: tasks add up losses and gradients of their rows
    and the driver gets ``SLOTS`` vectors, whatever the number of rows. ``rows`` should be a staged table.
    """
    spark, every = rows.sparkSession, [Descent(m, dim) for m in models]
    passes = 0
    while (now := [d for d in every if not d.done]) and passes < PASSES:
        passes += 1
        shared = spark.sparkContext.broadcast(([d.model for d in now], [d.trial for d in now]))
        found = rows.mapInArrow(_partial(shared), "slot int, v array<double>").groupBy("slot").applyInArrow(_added, "slot int, v array<double>").orderBy("slot").toArrow()
        total = matrix(found["v"].combine_chunks()).sum(axis=0) if len(found) else np.zeros(sum(1 + d.x.size for d in now))
        at = 0
        for d in now:
            d.told(total[at : at + 1 + d.x.size])
            at += 1 + d.x.size
        shared.unpersist()
    for d in every:
        d.model.x = d.x.reshape(d.size)
    return passes
