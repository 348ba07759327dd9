"""From quantized blocks back to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, require
from blockloom.operators.color import to_uint8
from blockloom.operators.preprocess import PLANE
from blockloom.operators.quantize import dequantize
from blockloom.operators.transform import idct2


def inverse_shift(blocks: DataFrame, shift: float = 128.0, column: str = "px") -> DataFrame:
    return blocks.withColumn(column, F.transform(column, lambda v: v + shift))


def merge_blocks(blocks: DataFrame, key: list[str] = PLANE, column: str = "px", n: int = BLOCK) -> DataFrame:
    """One row a pixel of the padded plane."""
    cells = blocks.select(*key, "h", "w", "br", "bc", F.posexplode(column).alias("i", "v"))
    return cells.select(*key, "h", "w", (F.col("br") * n + F.floor(F.col("i") / n).cast("int")).alias("r"), (F.col("bc") * n + F.col("i") % n).alias("c"), "v")


def crop(pixels: DataFrame) -> DataFrame:
    """Without the padding."""
    return pixels.where((F.col("r") < F.col("h")) & (F.col("c") < F.col("w")))


def clip(pixels: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    require(low <= high, "the lower bound must not be above the upper")
    return pixels.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)))


def whole_blocks(blocks: DataFrame, column: str = "qf", table: str = "q") -> DataFrame:
    """Blocks of whole numbers from quantized ones, the padding with them."""
    back = idct2(blocks.withColumn("bl_f", dequantize(F.col(column), F.col(table))), "bl_f")
    return inverse_shift(back.drop("bl_f")).withColumn("px", F.transform("px", to_uint8))


def from_blocks(blocks: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Shifted blocks to whole numbers of the original plane."""
    return crop(merge_blocks(inverse_shift(blocks), key)).withColumn("v", to_uint8(F.col("v")))


def from_quantized(blocks: DataFrame, key: list[str] = PLANE, column: str = "qf", table: str = "q") -> DataFrame:
    """Dequantizes with each row's table (already adapted, if it was), transforms back, cuts the padding."""
    return from_blocks(idct2(blocks.withColumn("f", dequantize(F.col(column), F.col(table)))), key)
