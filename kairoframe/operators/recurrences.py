"""Recurrences along one entity's ordered values.

Each is a step function with a few numbers of state: rows are dealt by entity, sorted, and stepped through in one pass
over Arrow batches (`grouped.scanned`), so the work is linear and no entity's series is held. The recurrence is written
as e * (1 - a) + x * a, the form that other engines reproduce bit by bit. A missing value makes all that follow missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame

from .grouped import scanned

Step = Callable[[float], float | None]


def ema(length: int) -> Step:
    """Exponential mean, seeded with the first value; a = 2 / (length + 1)."""
    a, last = 2.0 / (length + 1), None

    def step(x: float) -> float:
        nonlocal last
        last = x if last is None else last * (1 - a) + x * a
        return last

    return step


def rma(length: int) -> Step:
    """Wilder's mean: null before the seed, the plain mean of the first `length` values; then a = 1 / length."""
    a, total, seen, last = 1.0 / length, 0.0, 0, None

    def step(x: float) -> float | None:
        nonlocal total, seen, last
        if last is not None:
            last = last * (1 - a) + x * a
        else:
            total, seen = total + x, seen + 1
            last = total / float(length) if seen == length else None
        return last

    return step


def rsi(length: int) -> Step:
    """100 where the mean loss is 0 (a flat series too), 0 where the mean gain is 0; null until both are defined."""
    up, down, before = rma(length), rma(length), None

    def step(x: float) -> float | None:
        nonlocal before
        change, before = (None if before is None else x - before), x
        if change is None:
            return None
        if math.isnan(change):
            up(change), down(change)
            return change
        gain, loss = up(max(change, 0.0)), down(max(-change, 0.0))
        if gain is None or loss is None:
            return None
        return 100.0 if loss == 0 else 0.0 if gain == 0 else 100 - 100 / (1 + gain / loss)

    return step


def histogram(l1: int = 5, l2: int = 20, l3: int = 5) -> Step:
    """rsi(ema(l1) - ema(l2), l3) - 50."""
    fast, slow, strength = ema(l1), ema(l2), rsi(l3)

    def step(x: float) -> float | None:
        value = strength(fast(x) - slow(x))
        return None if value is None else value - 50

    return step


def along(rows: DataFrame, key: str, day: str, value: str, **made: Callable[[], Step]) -> DataFrame:
    """rows with a column of doubles for each recurrence over `value`, along each key in order of the day."""

    def start() -> Callable[[float], tuple]:
        steps = [f() for f in made.values()]
        return lambda x: tuple(s(x) for s in steps)

    return scanned(rows, key, day, [value], start, {name: "double" for name in made})
