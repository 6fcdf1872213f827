"""Vectors as whole numbers: floor(scale * component), little-endian 64-bit, one binary value a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None, scale: int = SCALE) -> DataFrame:
    """(id long, x binary) of the vectors that are not null and hold no null or non-finite component; with dims, of those with
    exactly so many. Components are taken as double. One that does not fit a 64-bit number is an error. Null and repeated ids
    stay, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.asarray(lists.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]])
            if dims is not None:
                good &= np.diff(ends) == dims
            with np.errstate(all="ignore"):
                scaled = np.floor(values * scale)
            rows = np.flatnonzero(good)
            out = []
            for i in rows.tolist():
                x = scaled[ends[i] : ends[i + 1]]
                if len(x) and np.abs(x).max() >= 2**63:
                    raise ValueError("a component is too large for a 64-bit number")
                out.append(x.astype("<i8").tobytes())
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(out, pa.binary())], names=["id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, x binary")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Binary vectors of equal length as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dims)
