"""Small caches of the driver; data are kept with DataFrame.persist."""

from __future__ import annotations

import functools
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from contextlib import contextmanager
from typing import Any


class LruCache:
    """The ``size`` values used last."""

    def __init__(self, size: int = 128):
        if size < 1:
            raise ValueError("size must be positive")
        self.size, self.hits, self.misses = size, 0, 0
        self._kept: OrderedDict[Hashable, Any] = OrderedDict()

    def get(self, key: Hashable, default: Any = None) -> Any:
        if key not in self._kept:
            self.misses += 1
            return default
        self.hits += 1
        self._kept.move_to_end(key)
        return self._kept[key]

    def set(self, key: Hashable, value: Any) -> None:
        self._kept[key] = value
        self._kept.move_to_end(key)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)

    def stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "size": len(self._kept), "maxsize": self.size}

    def clear(self) -> None:
        self._kept.clear()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self._kept)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._kept


def memoize(size: int = 128) -> Callable:
    return functools.lru_cache(maxsize=size)


@contextmanager
def timed(into: dict, name: str):
    """Adds the seconds that a block takes to ``into[name]``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began
