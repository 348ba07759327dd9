"""Quality and compression figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.coding import AC, EOB, count_kind
from blockloom.operators.preprocess import PLANE, expected_blocks
from blockloom.operators.quantize import zero_count

BITS_PIXEL, BITS_DC, BITS_RUN, BITS_AMP, BITS_EOB, BITS_COEFFICIENT = 8, 16, 6, 16, 4, 16


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels; infinite for equal images."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.lit(peak * peak) / mse))


def quality(original: DataFrame, restored: DataFrame, key: list[str] = PLANE, peak: float = 255.0) -> DataFrame:
    """MSE, MAE and PSNR of planes of one shape; a pixel that only one of them has is an error.

    ``key`` may name more than the plane (the settings of a sweep): each original
    pixel then meets one restored pixel a setting, in one join on the place.
    """
    at = [*PLANE, "r", "c"]
    a = original.select(*at, F.col("v").cast("double").alias("bl_a"))
    b = restored.select(*dict.fromkeys([*key, *at]), F.col("v").cast("double").alias("bl_b"))
    d = F.col("bl_a") - F.col("bl_b")
    one = b.join(a, at, "left").groupBy(*dict.fromkeys([*key, *PLANE])).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("bl_n"), F.count("bl_a").alias("bl_m"))
    sizes = a.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("bl_size"))
    same = (F.col("bl_n") == F.col("bl_m")) & (F.col("bl_m") == F.col("bl_size"))
    checked = F.when(same, F.col("mse")).otherwise(F.raise_error(F.lit("the images differ in shape")).cast("double"))
    out = one.join(sizes, PLANE).withColumn("mse", checked).select(*key, "mse", "mae")
    return out.withColumn("psnr", psnr(F.col("mse"), peak))


def quality_of(sums: DataFrame, column: str = "bl_error", peak: float = 255.0) -> DataFrame:
    """``mse, mae, psnr`` from sums of squares, of absolute values and of pixels in one array, which goes."""
    e = F.col(column)
    return sums.withColumns({"mse": e[0] / e[2], "mae": e[1] / e[2]}).withColumn("psnr", psnr(F.col("mse"), peak)).drop(column)


def original_bits(h: Column, w: Column, bits_per_pixel: int = BITS_PIXEL) -> Column:
    return (h.cast("long") * w * bits_per_pixel).cast("long")


def coefficient_bits(blocks: DataFrame, key: list[str] = PLANE, column: str = "qf", bits: int = BITS_COEFFICIENT) -> DataFrame:
    """A fixed price for each nonzero coefficient."""
    return blocks.groupBy(*key).agg((F.sum(F.size(column) - zero_count(F.col(column))) * bits).cast("long").alias("nonzero_bits"))


def rle_bits(dc: int = BITS_DC, run: int = BITS_RUN, amp: int = BITS_AMP, eob: int = BITS_EOB) -> Column:
    """Price of one encoded block."""
    return F.lit(dc) + count_kind(AC) * (run + amp) + count_kind(EOB) * eob


def compression_ratio(original: Column, compressed: Column) -> Column:
    ok = (original > 0) & (compressed > 0)
    return F.when(ok, original / compressed).otherwise(F.raise_error(F.lit("bit counts must be positive")).cast("double"))


def reduction_percentage(original: Column, compressed: Column) -> Column:
    ok = (original > 0) & (compressed > 0)
    return F.when(ok, (1 - compressed / original) * 100).otherwise(F.raise_error(F.lit("bit counts must be positive")).cast("double"))


def block_counts(column: str = "qf") -> dict[str, Column]:
    """What one encoded block adds to the figures of compression: a few numbers that stand for its symbols."""
    return {"bl_size": F.size(column), "bl_zeros": zero_count(F.col(column)), "bl_symbols": count_kind(), "bl_bits": rle_bits()}


def compression(encoded: DataFrame, key: list[str] = PLANE, column: str = "qf") -> DataFrame:
    """Ten figures from one pass over encoded blocks: padded blocks against unpadded pixels.

    The plane's sizes come from the same pass, for runs that report them.
    """
    return compression_of(encoded.withColumns(block_counts(column)), key)


def compression_of(counted: DataFrame, key: list[str] = PLANE, *more: Column) -> DataFrame:
    """The same from ``block_counts``; a plane whose blocks are not all there is an error.  ``more`` aggregates go along."""
    total, zeros, n = F.sum("bl_size"), F.sum("bl_zeros"), F.sum("bl_symbols")
    whole = F.count(F.lit(1)) == expected_blocks(F.max("h"), F.max("w"))
    total = F.when(whole, total).otherwise(F.raise_error(F.lit("a plane must have each of its blocks once")).cast("long"))
    one = counted.groupBy(*key).agg(
        *more, total.cast("long").alias("total_coefficients"), zeros.cast("long").alias("zero_coefficients"), (total - zeros).cast("long").alias("nonzero_coefficients"), (100.0 * zeros / total).alias("zero_percentage"),
        n.cast("long").alias("rle_symbols"), (n / F.count(F.lit(1))).alias("average_rle_symbols_per_block"),
        original_bits(F.max("h"), F.max("w")).alias("original_bits"), F.sum("bl_bits").cast("long").alias("compressed_bits"),
        F.max("h").alias("original_height"), F.max("w").alias("original_width"), (F.max("br") + 1).alias("num_blocks_vertical"), (F.max("bc") + 1).alias("num_blocks_horizontal"),
    )
    return one.withColumns({"compression_ratio": compression_ratio(F.col("original_bits"), F.col("compressed_bits")), "reduction_percentage": reduction_percentage(F.col("original_bits"), F.col("compressed_bits"))})
