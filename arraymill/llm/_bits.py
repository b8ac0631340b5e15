"""Tables of a fixed size that all rows add to: counts and bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers that travel in one row.
_CHUNK = 1 << 13


def merged(rows: DataFrame, size: int, kind: type, add: Callable, join: np.ufunc) -> np.ndarray:
    """One array of a fixed size from all rows: add(array, batch) in each task, join between tasks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, kind)
        for b in batches:
            add(own, b)
        for k in range(0, size, _CHUNK):
            if own[k : k + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own[k : k + _CHUNK].tobytes()])], ["k", "part"])

    def meet(t: pa.Table) -> pa.Table:
        whole = np.zeros(_CHUNK, kind)
        for p in t.column("part"):
            join(whole, np.frombuffer(p.as_buffer(), kind), out=whole)
        return pa.table({"k": t.column("k")[:1], "part": pa.array([whole.tobytes()])})

    out = np.zeros(size, kind)
    got = rows.mapInArrow(fill, "k long, part binary").groupBy("k").applyInArrow(meet, "k long, part binary").toArrow()  # in one job; an iterator has one for each partition
    for k, part in zip(got["k"].to_pylist(), got["part"], strict=True):
        out[k : k + _CHUNK] = np.frombuffer(part.as_buffer(), kind)
    return out
