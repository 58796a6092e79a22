"""Feature tables packed for iterative fits.

A fit that passes over its rows hundreds of times should not pay for rows: here
some thousand rows are one record of packed arrays, and a pass is one job of
numpy over records, its sums combined by a Spark aggregate.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of a record at most
BLOCK_ROWS = 8192


def array_column(data: DataFrame, features_col: str = "features") -> Column:
    """The features, a vector or an array, as an array of doubles."""
    c = F.col(features_col)
    return c.cast("array<double>") if data.schema[features_col].dataType.typeName() == "array" else vector_to_array(c)


def feature_arrays(data: DataFrame, features_col: str = "features") -> DataFrame:
    return data.withColumn(features_col, array_column(data, features_col))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def pack(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).tobytes()


def packed(data: DataFrame, convert: Callable[[pa.RecordBatch], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """Records ``n`` and one binary per name, of up to ``BLOCK_ROWS`` rows each.

    ``convert`` turns an Arrow batch into arrays whose first axis is the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                arrays = convert(part)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())] + [pa.array([pack(arrays[k])], pa.binary()) for k in names],
                                                 names=["n", *names])

    return data.mapInArrow(run, ", ".join(["n long", *[f"{k} binary" for k in names]]))


def summed(blocks: DataFrame, emit: Callable[[Iterator[dict]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> dict[int, float]:
    """Sums by index over all records: ``emit`` yields (indices, values) of a
    task, Spark adds them.  The result is as large as what is fitted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for index, value in emit(rows):
            yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(value.astype(np.float64))], names=["i", "v"])

    got = blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    return dict(zip(got.column("i").to_pylist(), got.column("v").to_pylist()))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; what its task has freed goes back to the system, as a worker lives on."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):   # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return held
