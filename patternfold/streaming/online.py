"""Running statistics and causal anomalies of unbounded streams.

Each series keeps the last ``size`` slots (missing values take one) and a count. Rows of a micro-batch are put in order
by (ts, idx) within their series; rows that come after a later one has been seen are given out as late and change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patternfold.schema import KEY, finite

_OUT = f"{KEY} string, idx long, value double, z double, score double, late boolean"
_STATE = "slots array<double>, seen long, last long"


def running_stats(stream: DataFrame) -> DataFrame:
    """n, missing, mean, variance, stdev of each series so far (complete or update mode)."""
    v = finite()
    return stream.groupBy(KEY).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stdev"))


def windowed_stats(stream: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Statistics of event-time windows; rows later than the watermark are dropped by Spark."""
    v = finite()
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), KEY).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"))


def judge(slots: list[float], x: float | None, threshold: float) -> tuple[float, float] | None:
    """z and score of x against the slots before it, if it stands out."""
    past = [s for s in slots if s == s]
    if x is None or not math.isfinite(x) or not past:
        return None
    mean = math.fsum(past) / len(past)
    sd = math.sqrt(math.fsum((p - mean) ** 2 for p in past) / len(past))
    if sd == 0:
        return (math.copysign(math.inf, x - mean), 1.0) if len(past) > 1 and x != mean else None
    z = (x - mean) / sd
    return (z, min(1.0, abs(z) / (2 * threshold))) if abs(z) >= threshold else None


def stream_anomalies(stream: DataFrame, size: int = 50, threshold: float = 3.0, warmup: int | None = None) -> DataFrame:
    """Rows of a stream (series_id, idx, value) that stand out from the ``size`` before them (append mode)."""
    wait = size if warmup is None else warmup

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, seen, last = state.get if state.exists else ([], 0, None)
        slots = list(slots)
        out = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for idx, value in zip(rows.idx.tolist(), rows.value.tolist()):
            value = None if value is None or value != value else value
            if last is not None and idx <= last:
                out.append((key[0], idx, value, None, None, True))
                continue
            found = judge(slots, value, threshold) if seen >= wait else None
            if found:
                out.append((key[0], idx, value, *found, False))
            slots.append(value if value is not None and math.isfinite(value) else math.nan)
            slots, seen, last = slots[-size:], seen + 1, idx
        state.update((slots, seen, -1 if last is None else last))
        yield pd.DataFrame(out, columns=[KEY, "idx", "value", "z", "score", "late"]).astype({"idx": "int64", "value": "float64", "z": "float64", "score": "float64", "late": "bool"})

    return stream.select(KEY, "idx", "value").groupBy(KEY).applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
