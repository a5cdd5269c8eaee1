"""Number grids, window grids and frame samples as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_grid(start: float, stop: float, step: float, digits: int = 4) -> list[float]:
    """start, start + step, ... up to ``stop`` inclusive, each rounded; empty if stop lies below start."""
    n = int((stop - start) / step + 1e-9) if stop >= start - 1e-9 else -1
    return [round(start + i * step, digits) for i in range(n + 1)]


def parse_grid(text: str) -> list[float]:
    """``lo:hi:step`` as a grid."""
    low, high, step = map(float, text.split(":"))
    return float_grid(low, high, step)


def parse_list(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def parse_pairs(text: str) -> dict[str, str]:
    """``a=b,c=d`` as a dict."""
    return {k.strip(): v.strip() for k, v in (pair.split("=", 1) for pair in text.split(",") if pair.strip())}


def _steps(n: Column, step: float) -> Column:
    count = F.greatest(n, F.lit(0)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(i * F.lit(step), 3))).otherwise(F.array().cast("array<double>"))


def tumbling_starts(duration: Column, chunk: float) -> Column:
    """Starts of whole, adjacent windows; none if the duration is shorter than a window."""
    return _steps(F.floor((duration - F.lit(chunk)) / F.lit(chunk) + F.lit(1e-9)) + 1, chunk)


def sliding_starts(duration: Column, chunk: float, stride: float) -> Column:
    """Starts of windows every ``stride`` that end within the duration (to 1e-6); a short one has a window at 0."""
    starts = _steps(F.floor((duration - F.lit(chunk) + F.lit(1e-6)) / F.lit(stride)) + 1, stride)
    return F.when(F.size(starts) == 0, F.array(F.lit(0.0))).otherwise(starts)


def frame_indices(begin: Column, end: Column, n: int = 8, truncate: bool = False) -> Column:
    """``n`` evenly spaced whole positions from begin to end, rounded half to even, or cut off."""
    at = lambda i: begin + (end - begin) * i / F.lit(float(max(n - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(at(i)) if truncate else F.rint(at(i))).cast("int"))
