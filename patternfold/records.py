"""Rows of the pattern table as Python objects, for callers that keep a few of them on the driver.

What a record holds, and in which order, is told by ``schema.PATTERN`` alone.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Row

from patternfold.schema import PATTERN

_TYPES: dict[str, str] = dict(re.findall(r"(\w+) (\w+(?:<[^ ]+>)?)", PATTERN))
_SHARES = ("confidence", "similarity", "novelty")
_GIVEN = {"type": "unknown", "series_id": "all", "state": "NEW", "id": "", "frequency": 0, "confidence": 0.0, "novelty": 0.0}


def clamp01(value, default: float = 0.0) -> float:
    """A share: within 0 and 1, or ``default`` for what is no number."""
    try:
        share = float(value)
    except (TypeError, ValueError):
        share = math.nan
    return default if math.isnan(share) else sorted((0.0, share, 1.0))[1]


def pattern_id(n: int) -> str:
    return "P-" + str(n).zfill(3)


def _empty(name: str):
    kind = _TYPES[name]
    return {} if kind.startswith("map") else [] if kind.startswith("array") else _GIVEN.get(name)


class Pattern:
    """A row of the pattern table. What isn't given or null has the value of an empty row, shares are kept within 0 and
    1, counts from below 0; keys that the table doesn't have are ignored by ``from_dict``."""

    def __init__(self, **given):
        unknown = given.keys() - _TYPES.keys()
        if unknown:
            raise TypeError(f"not columns of a pattern: {', '.join(sorted(unknown))}")
        for name in _TYPES:
            value = given.get(name)
            setattr(self, name, _empty(name) if value is None else clamp01(value) if name in _SHARES else value)
        self.frequency = max(int(self.frequency), 0)

    def __eq__(self, other) -> bool:
        return isinstance(other, Pattern) and self.to_dict() == other.to_dict()

    def __repr__(self) -> str:
        return f"Pattern({self.to_json()})"

    def to_dict(self) -> dict:
        return {name: getattr(self, name) for name in _TYPES}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, default=str)

    @classmethod
    def from_dict(cls, data: dict) -> Pattern:
        return cls(**{name: data[name] for name in _TYPES if name in data})

    @classmethod
    def from_row(cls, row: Row) -> Pattern:
        return cls.from_dict(row.asDict(recursive=True))
