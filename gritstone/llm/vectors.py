"""What the operators on embeddings share: clean vectors of one length, and their batches as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector has entries, none of them null, NaN or infinite; false for a null vector."""
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), fits), F.lit(False))


def dimension(clean: DataFrame, vector: str) -> int:
    """The most common length, the larger of two; 0 if there are no rows."""
    top = clean.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of equal length as the rows of one array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def floors(vector: Column) -> Column:
    """Each entry c, as double, as the whole number floor(256 c)."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(256 * c).cast("long"))
