"""What the vector operators share: which vectors count, and cosines that don't depend on a row's place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null or zero and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths_of(df: DataFrame, vector_col: str, least: int = 1) -> list[int]:
    """The lengths that at least so many vectors have: a handful in any table of embeddings."""
    return sorted(r["n"] for r in df.groupBy(F.size(vector_col).alias("n")).count().where(F.col("count") >= least).collect())


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduce(x * x, axis=-1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / lengths(x)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order for every row: equal vectors get equal cosines."""
    return np.add.reduce(a * b, axis=-1) / (lengths(a) * lengths(b))


def sample(df: DataFrame, order: Column, vector_col: str, rows: int) -> np.ndarray:
    """At most rows unit vectors, the first in an order such as a hash of their ids."""
    table = df.orderBy(order).limit(rows).select(vector_col).toArrow()
    return unit(matrix(table.column(0).combine_chunks())) if table.num_rows else np.zeros((0, 1))
