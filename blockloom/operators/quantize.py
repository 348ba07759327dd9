"""Global and content-adaptive quantization of packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, CLASS_SCALES, EDGE, SMOOTH, TEXTURE, require
from blockloom.operators.preprocess import PLANE
from blockloom.operators.transform import _matrices

FEATURES = ("mean", "variance", "gradient_energy_x", "gradient_energy_y", "gradient_energy", "directionality")


def literal_table(table: list[float]) -> Column:
    return F.array(*(F.lit(float(q)) for q in table))


def with_table(blocks: DataFrame, tables: dict[str, list[float]]) -> DataFrame:
    """Adds ``q``, the table of each row's channel."""
    pick = F.create_map(*(x for k, t in tables.items() for x in (F.lit(k), literal_table(t))))
    return blocks.withColumn("q", pick[F.col("channel")])


def quantize(f: Column, q: Column) -> Column:
    """Nearest multiple of each step, half to even."""
    return F.zip_with(f, q, lambda a, b: F.rint(a / b).cast("int"))


def dequantize(qf: Column, q: Column) -> Column:
    return F.zip_with(qf, q, lambda a, b: a * b)


def zero_count(qf: Column) -> Column:
    return F.size(F.filter(qf, lambda x: x == 0))


def zero_percentage(blocks: DataFrame, key: list[str], column: str = "qf") -> DataFrame:
    """Counts and the share of zero coefficients, padding included."""
    total, zeros = F.sum(F.size(column)).cast("long"), F.sum(zero_count(F.col(column))).cast("long")
    return blocks.groupBy(*key).agg(total.alias("total_coefficients"), zeros.alias("zero_coefficients"), (100.0 * zeros / total).alias("zero_percentage"))


def _sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both gradients within each block, edges repeated; separable: smooth one way, differ the other."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    across = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    return down[:, :, :-2] - down[:, :, 2:], across[:, :-2] - across[:, 2:]


def block_features(blocks: DataFrame, column: str = "px", n: int = BLOCK, epsilon: float = 1e-12) -> DataFrame:
    """Adds six features of each (unshifted) block, rounded to nine digits so that thresholds have no noise."""

    @F.arrow_udf("array<double>")
    def compute(values: pa.Array) -> pa.Array:
        x = _matrices(values, n)
        ex, ey = (np.mean(g**2, axis=(1, 2)) for g in _sobel(x))
        out = np.stack([x.mean((1, 2)), x.var((1, 2)), ex, ey, ex + ey, abs(ex - ey) / (ex + ey + epsilon)], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(np.round(out, 9).reshape(-1)))

    return blocks.withColumn("bl_feat", compute(F.col(column))).withColumns({k: F.col("bl_feat")[i] for i, k in enumerate(FEATURES)}).drop("bl_feat")


def classify_blocks(
    features: DataFrame,
    variance_threshold: float | None = None,
    gradient_threshold: float | None = None,
    directionality_threshold: float = 0.35,
    smooth_variance_percentile: float = 35,
    gradient_percentile: float = 55,
) -> DataFrame:
    """Adds ``class``: smooth, edge or texture.

    Thresholds that aren't given are exact percentiles of each plane, interpolated
    as usual; they are one row a plane and meet the blocks in a join on the plane.
    """
    require(0 <= directionality_threshold <= 1, "the directionality threshold must be in 0..1")
    require(all(0 <= p <= 100 for p in (smooth_variance_percentile, gradient_percentile)), "percentiles must be in 0..100")
    require(all(t is None or t >= 0 for t in (variance_threshold, gradient_threshold)), "thresholds must not be negative")

    if variance_threshold is None or gradient_threshold is None:
        cut = features.groupBy(*PLANE).agg(F.percentile("variance", F.lit(smooth_variance_percentile / 100)).alias("bl_tv"), F.percentile("gradient_energy", F.lit(gradient_percentile / 100)).alias("bl_tg"))
        df = features.join(cut, PLANE)
    else:
        df = features.withColumns({"bl_tv": F.lit(0.0), "bl_tg": F.lit(0.0)})
    tv = F.round(F.col("bl_tv"), 9) if variance_threshold is None else F.lit(float(variance_threshold))
    tg = F.round(F.col("bl_tg"), 9) if gradient_threshold is None else F.lit(float(gradient_threshold))
    v, g = F.col("variance"), F.col("gradient_energy")
    kind = F.when((v <= tv) & (g <= tg), SMOOTH).when((g > tg) & (F.col("directionality") >= directionality_threshold), EDGE).otherwise(TEXTURE)
    return df.withColumn("class", kind).drop("bl_tv", "bl_tg")


def with_scale(classes: DataFrame, smooth: float = CLASS_SCALES[SMOOTH], edge: float = CLASS_SCALES[EDGE], texture: float = CLASS_SCALES[TEXTURE]) -> DataFrame:
    """Adds ``scale`` by class; a class outside 0, 1, 2 is an error."""
    require(min(smooth, edge, texture) > 0, "scales must be positive")
    known = F.when(F.col("class") == SMOOTH, smooth).when(F.col("class") == EDGE, edge).when(F.col("class") == TEXTURE, texture)
    return classes.withColumn("scale", known.otherwise(F.raise_error(F.lit("unknown block class")).cast("double")))


def adaptive_table(q: Column, scale: Column, low: float = 1, high: float = 255) -> Column:
    """The already rounded table times the block's scale, rounded and clipped again."""
    return F.transform(q, lambda x: F.least(F.greatest(F.rint(x * scale), F.lit(float(low))), F.lit(float(high))))


def class_counts(classes: DataFrame) -> DataFrame:
    """Blocks of each class with their share; classes that don't occur count 0."""
    one = classes.groupBy(*PLANE).agg(*(F.count_if(F.col("class") == k).alias(n) for k, n in ((SMOOTH, "smooth"), (EDGE, "edge"), (TEXTURE, "texture"))), F.count(F.lit(1)).alias("total"))
    return one.select(*PLANE, *(x for n in ("smooth", "edge", "texture") for x in (F.col(n), F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col(n) / F.col("total")).alias(f"{n}_percentage"))))
