"""What the vector operators share: which vectors take part, and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQL: no component is null or not finite.
FINITE = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def dimension(vectors: DataFrame) -> int:
    """The most common length of a vector that is not empty; the smaller of equals. 0 without any."""
    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes["d"] if sizes else 0


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: named, of ``dim`` finite components, not all zero."""
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(
        f"vec_id IS NOT NULL AND size(embedding) = {dim} AND {FINITE} AND exists(embedding, x -> x <> 0)"
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column without nulls, as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that nothing under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    flat = np.ascontiguousarray(x)
    width = flat.shape[1] * flat.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary()) if len(flat) else pa.array([], pa.binary())


def unpacked(column, dtype, width: int) -> np.ndarray:
    """The reverse of ``packed``."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), dtype).reshape(-1, width)


def common_length(vectors: DataFrame) -> int:
    """As ``dimension``, of the vectors whose components are all finite."""
    return dimension(vectors.where(FINITE))


def finite_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, label, embedding) of the vectors of ``dim`` finite components; zero vectors and rows without vec_id stay."""
    return vectors.where(f"size(embedding) = {dim} AND {FINITE}").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
