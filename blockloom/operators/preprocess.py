"""Gray conversion, edge padding, tiling.

Relations: ``pixels(image_id, channel, r, c, v, h, w)`` has one row a pixel and
carries the plane's size; ``blocks(image_id, channel, h, w, br, bc, px)`` has one
row a block with its values in row-major order.  After tiling, every step up to
the symbols works within a row: no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, require

PLANE = ["image_id", "channel"]
BLOCK_KEY = [*PLANE, "br", "bc"]
COLOR = ("red", "green", "blue")


def gray_value(red: Column, green: Column, blue: Column) -> Column:
    """Luma in single precision, term by term."""
    parts = [F.lit(w).cast("float") * x.cast("float") for w, x in zip((0.299, 0.587, 0.114), (red, green, blue), strict=True)]
    return parts[0] + parts[1] + parts[2]


def rgb_to_gray(pixels: DataFrame) -> DataFrame:
    """Gray plane of ``red, green, blue`` pixels; a relation with ``v`` passes as float."""
    if "v" in pixels.columns:
        return pixels.withColumn("v", F.col("v").cast("float"))
    require(all(c in pixels.columns for c in COLOR), "pixels need v, or red, green and blue")
    return pixels.withColumn("v", gray_value(*map(F.col, COLOR))).drop(*COLOR).withColumn("channel", F.lit("gray"))


def padded(n: Column, block: int = BLOCK) -> Column:
    return n + F.pmod(-n, F.lit(block))


def _repeat_last(df: DataFrame, at: str, size: str, block: int) -> DataFrame:
    last = F.when(F.col(at) == F.col(size) - 1, padded(F.col(size), block) - 1).otherwise(F.col(at))
    return df.withColumn(at, F.explode(F.sequence(F.col(at), last)))


def pad_edge(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repeats the last row and column up to a multiple of ``block``; values become float.

    A narrow step: the pixels at the edge are exploded, nothing is joined.
    """
    require(block > 0, "the block size must be positive")
    return _repeat_last(_repeat_last(pixels.withColumn("v", F.col("v").cast("float")), "r", "h", block), "c", "w", block)


def split_blocks(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds block row and column ``br, bc`` and the place ``x, y`` within the block."""
    def div(c: str) -> Column:
        return F.floor(F.col(c) / block).cast("int")

    return pixels.withColumns({"br": div("r"), "bc": div("c"), "x": F.col("r") % block, "y": F.col("c") % block})


def pack_blocks(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: the single shuffle of the forward path, on the block's key."""
    cell = F.struct((F.col("x") * block + F.col("y")).alias("i"), F.col("v"))
    return tiles.groupBy(*PLANE, "h", "w", "br", "bc").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda s: s["v"]).alias("px"))


def level_shift(blocks: DataFrame, shift: float = 128.0, column: str = "px") -> DataFrame:
    """Takes ``shift`` off each value, in single precision."""
    return blocks.withColumn(column, F.transform(column, lambda v: (v.cast("float") - F.lit(shift).cast("float")).cast("float")))


def preprocess(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels of any planes to shifted blocks."""
    return level_shift(pack_blocks(split_blocks(pad_edge(rgb_to_gray(pixels), block), block), block))


def plane_info(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Original and padded sizes of each plane."""
    one = blocks.groupBy(*PLANE).agg(F.max("h").alias("orig_h"), F.max("w").alias("orig_w"))
    ph, pw = padded(F.col("orig_h"), block), padded(F.col("orig_w"), block)
    return one.select(*PLANE, "orig_h", "orig_w", ph.alias("padded_h"), pw.alias("padded_w"), (ph - F.col("orig_h")).alias("pad_h"), (pw - F.col("orig_w")).alias("pad_w"), F.lit(block).alias("block_size"))


def checked_values(values: Column, n: int = BLOCK * BLOCK, name: str = "a block") -> Column:
    """The array, if it holds ``n`` values and no null; an error otherwise."""
    sound = (F.size(values) == n) & ~F.exists(values, lambda x: x.isNull())
    return F.when(sound, values).otherwise(F.raise_error(F.lit(f"{name} must hold {n} values")))


def checked_blocks(blocks: DataFrame, column: str = "px", block: int = BLOCK) -> DataFrame:
    """The blocks, each checked for its length."""
    return blocks.withColumn(column, checked_values(F.col(column), block * block, f"each {column}"))


def expected_blocks(h: Column, w: Column, block: int = BLOCK) -> Column:
    """Blocks of a whole padded plane."""
    return ((padded(h, block) / block) * (padded(w, block) / block)).cast("long")


def check_info(info: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``plane_info`` whose sizes do not fit each other, with the reason; empty if all are sound."""
    h, w, ph, pw = (F.col(c) for c in ("orig_h", "orig_w", "padded_h", "padded_w"))
    reason = (
        F.when(F.coalesce(F.least(h, w), F.lit(0)) <= 0, "the original sizes must be positive")
        .when(F.coalesce(F.col("block_size"), F.lit(0)) <= 0, "the block size must be positive")
        .when((F.col("block_size") != block) | (ph % F.col("block_size") != 0) | (pw % F.col("block_size") != 0), "the padded sizes must be multiples of the block size")
        .when((F.least(F.col("pad_h"), F.col("pad_w")) < 0) | (F.greatest(F.col("pad_h"), F.col("pad_w")) >= F.col("block_size")), "the padding must be under a block")
        .when((h + F.col("pad_h") != ph) | (w + F.col("pad_w") != pw), "the padded sizes must be the original ones and the padding")
    )
    return info.withColumn("reason", reason).where("reason is not null")


def bad_planes(pixels: DataFrame, *columns: str) -> DataFrame:
    """Planes without one value for each place, and planes with a null, NaN or infinite one; empty if all are sound.

    ``columns`` are the values, ``v`` by default; colour pixels have three and no channel.
    """
    key = [c for c in PLANE if c in pixels.columns]
    values = [F.col(c).cast("double") for c in columns or ("v",)]
    odd = F.lit(False)
    for v in values:
        odd = odd | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False)) | v.isNull()
    inside = (F.col("r") >= 0) & (F.col("r") < F.col("h")) & (F.col("c") >= 0) & (F.col("c") < F.col("w"))
    one = pixels.groupBy(*key).agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("r", "c").alias("places"), F.count_if(odd).alias("odd"), F.coalesce(F.bool_and(inside), F.lit(False)).alias("inside"), F.count_distinct("h", "w").alias("sizes"), F.max(F.col("h").cast("long") * F.col("w")).alias("want"))
    return one.where((F.col("pixels") != F.col("want")) | (F.col("places") != F.col("want")) | (F.col("odd") > 0) | ~F.col("inside") | (F.col("sizes") != 1))


def missing_blocks(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Planes whose blocks are not one for each place of the padded plane; empty if all are whole."""
    n = blocks.groupBy(*PLANE, "h", "w").agg(F.count_distinct("br", "bc").alias("distinct_blocks"), F.count(F.lit(1)).alias("blocks"))
    want = expected_blocks(F.col("h"), F.col("w"), block)
    return n.where((F.col("blocks") != want) | (F.col("distinct_blocks") != want))
