"""What the operators on embeddings share: which vectors count, and whole numbers from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there, is not empty and has finite entries only."""
    whole = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & whole, F.lit(False))


def common_length(rows: DataFrame, vec: str) -> int:
    """The length that most vectors have, of two the larger one; 0 for no rows."""
    first = rows.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def whole_numbers(vec: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of every entry c, as double, as long; entries beyond a long's half range fail the job."""

    def one(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(scaled) < F.lit(float(1 << 62)), F.floor(scaled) + F.lit(offset).cast("long")).otherwise(F.raise_error(F.lit("an entry of a vector is too large for whole numbers")).cast("long"))

    return F.transform(vec, one)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of longs, all of one width, as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), dtype=np.int64)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, width)
