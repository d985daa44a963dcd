"""Sums of numpy arrays over a whole DataFrame: each task emits pieces of its array, equal pieces meet and add up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 15
SALT = 8


def pieces(array: np.ndarray, first: int = 0) -> tuple[list[int], list[bytes]]:
    """Numbers and bytes of the pieces of an int64 array that aren't all zero."""
    keys, data = [], []
    for k, i in enumerate(range(0, len(array), PIECE)):
        part = array[i : i + PIECE]
        if part.any():
            keys.append(first + k)
            data.append(part.astype(np.int64).tobytes())
    return keys, data


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, np.int64)
            if key in sums:
                sums[key] += part
            else:
                sums[key] = part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], ["key", "data"])


def total(rows: DataFrame, length: int) -> np.ndarray:
    """The sum of the arrays whose pieces are the rows key int, data binary. ``length`` bounds what reaches the driver.

    Pieces are added in two rounds, so no task holds more than a part of those of one key.
    """
    parts = max(2, -(-length // PIECE))
    once = rows.select("key", "data").repartition(min(parts * SALT, 256), "key", (F.rand(1) * SALT).cast("int")).mapInArrow(_add, "key int, data binary")
    out = np.zeros(parts * PIECE, np.int64)
    for row in once.repartition(min(parts, 64), "key").mapInArrow(_add, "key int, data binary").collect():
        out[row.key * PIECE : row.key * PIECE + len(row.data) // 8] += np.frombuffer(row.data, np.int64)
    return out[:length]
