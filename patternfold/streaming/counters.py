"""Mergeable and sliding statistics of one series, value by value: the state of keyed stream operators."""

from __future__ import annotations

import math
from collections import deque
from typing import Any


def usable(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


class RunningStats:
    """Count, missing values, mean and population variance; two of them merge into that of both."""

    def __init__(self) -> None:
        self.n = self.missing = 0
        self._mean = self._square = 0.0

    def update(self, x: Any) -> RunningStats:
        if not usable(x):
            self.missing += 1
            return self
        self.n += 1
        away = x - self._mean
        self._mean += away / self.n
        self._square += away * (x - self._mean)
        return self

    def merge(self, other: RunningStats) -> RunningStats:
        out = RunningStats()
        out.n, out.missing = self.n + other.n, self.missing + other.missing
        if out.n:
            gap = other._mean - self._mean
            out._mean = self._mean + gap * other.n / out.n
            out._square = self._square + other._square + gap * gap * self.n * other.n / out.n
        return out

    @property
    def mean(self) -> float | None:
        return self._mean if self.n else None

    @property
    def variance(self) -> float | None:
        return max(0.0, self._square / self.n) if self.n else None

    @property
    def stdev(self) -> float | None:
        return math.sqrt(self.variance) if self.n else None

    def __len__(self) -> int:
        return self.n


class SlidingStats:
    """The same of the last ``window`` slots; a missing value takes a slot, and all missing ones so far are counted."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("window must be positive")
        self.window, self.missing = window, 0
        self._slots: deque = deque(maxlen=window)

    def update(self, x: Any) -> SlidingStats:
        good = usable(x)
        self.missing += not good
        self._slots.append(float(x) if good else None)
        return self

    @property
    def values(self) -> list[float]:
        return [s for s in self._slots if s is not None]

    @property
    def n(self) -> int:
        return len(self.values)

    @property
    def mean(self) -> float | None:
        v = self.values
        return math.fsum(v) / len(v) if v else None

    @property
    def variance(self) -> float | None:
        v = self.values
        return None if not v else math.fsum((x - self.mean) ** 2 for x in v) / len(v)

    @property
    def stdev(self) -> float | None:
        return None if self.variance is None else math.sqrt(self.variance)

    def __len__(self) -> int:
        return len(self._slots)
