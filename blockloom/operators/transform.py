"""Orthonormal DCT of one and two dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, basis_relation, dct_matrix

#: Digits that a coefficient keeps.  Ties at half a quantizer step are common, and
#: which side float noise picks depends on the order of summation; after this
#: rounding every order gives the exact result.
DIGITS = 9


def dct_1d(samples: DataFrame, key: list[str], n: int = BLOCK, inverse: bool = False) -> DataFrame:
    """``key, k, value`` of ``key, n, value`` rows: a broadcast join on the n*n matrix and a sum.

    The sum is partial before its shuffle.  ``inverse`` takes ``k`` and gives ``n``.
    """
    have, give = ("k", "n") if inverse else ("n", "k")
    basis = F.broadcast(basis_relation(samples.sparkSession, n))
    return samples.join(basis, have).groupBy(*key, give).agg(F.sum(F.col("value") * F.col("b")).alias("value"))


def _matrices(values: pa.Array, n: int) -> np.ndarray:
    """A batch of square blocks; one of another length, or with a null, is an error."""
    flat = values.flatten()
    if values.null_count or flat.null_count or (np.diff(values.offsets.to_numpy()) != n * n).any():
        raise ValueError(f"each block must hold {n * n} values")
    return np.asarray(flat, dtype=np.float64).reshape(-1, n, n)


def _lists(values: np.ndarray) -> pa.Array:
    n = values.shape[1] * values.shape[2]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n), pa.array(values.reshape(-1)))


def _udf(n: int, inverse: bool):
    m = dct_matrix(n).T if inverse else dct_matrix(n)

    @F.arrow_udf("array<double>")
    def apply(values: pa.Array) -> pa.Array:
        return _lists(np.round(m @ _matrices(values, n) @ m.T, DIGITS))

    return apply


def dct2(blocks: DataFrame, source: str = "px", target: str = "f", n: int = BLOCK) -> DataFrame:
    """Coefficients of each block: one batched matrix product an Arrow batch, no shuffle."""
    return blocks.withColumn(target, _udf(n, False)(F.col(source)))


def idct2(blocks: DataFrame, source: str = "f", target: str = "px", n: int = BLOCK) -> DataFrame:
    return blocks.withColumn(target, _udf(n, True)(F.col(source)))


def dct2_relational(cells: DataFrame, key: list[str], n: int = BLOCK) -> DataFrame:
    """The same transform on ``key, x, y, value`` rows as two joins and sums (rows, then columns).

    For data that is already one row a cell; 16 times the rows of the packed form.
    """
    rows = dct_1d(cells.withColumnRenamed("x", "n"), [*key, "y"], n).withColumnRenamed("k", "u")
    return dct_1d(rows.withColumnRenamed("y", "n"), [*key, "u"], n).withColumnRenamed("k", "v").withColumn("value", F.round("value", DIGITS))


def block_error(back: str = "f", original: str = "px", shift: float = 128.0, n: int = BLOCK):
    """Sums of squared and absolute errors and the number of pixels, of a block and its restored whole numbers.

    From dequantized coefficients and the block before its shift: the inverse transform,
    the shift, clipping and rounding within the row; the padding does not count.
    """
    m = dct_matrix(n)

    @F.arrow_udf("array<double>")
    def compute(f: pa.Array, px: pa.Array, h: pa.Array, w: pa.Array, br: pa.Array, bc: pa.Array) -> pa.Array:
        a = np.rint(np.clip(np.round(m.T @ _matrices(f, n) @ m, DIGITS) + shift, 0, 255))
        d = np.abs(a - _matrices(px, n))
        rows, cols = ((np.asarray(size) - np.asarray(at) * n)[:, None] > np.arange(n) for size, at in ((h, br), (w, bc)))
        inside = rows[:, :, None] & cols[:, None, :]
        d *= inside
        out = np.stack([(d**2).sum((1, 2)), d.sum((1, 2)), inside.sum((1, 2))], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 3), pa.array(out.reshape(-1)))

    return compute(*map(F.col, (back, original, "h", "w", "br", "bc")))


def basis_images(spark, n: int = BLOCK) -> DataFrame:
    """``u, v, x, y, value, shown``: all n*n basis images; ``shown`` is clipped to a display range of 0.25."""
    b = basis_relation(spark, n)
    rows = b.select(F.col("k").alias("u"), F.col("n").alias("x"), F.col("b").alias("bx"))
    cols = b.select(F.col("k").alias("v"), F.col("n").alias("y"), F.col("b").alias("by"))
    value = F.col("bx") * F.col("by")
    return rows.crossJoin(F.broadcast(cols)).select("u", "v", "x", "y", value.alias("value"), F.least(F.greatest(value, F.lit(-0.25)), F.lit(0.25)).alias("shown"))
