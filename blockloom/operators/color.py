"""YCbCr conversion and 4:2:0 chroma resampling on pixel relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import require
from blockloom.operators.preprocess import _repeat_last, padded

CHANNELS = ("Y", "Cb", "Cr")
MODE = "4:2:0"


def rgb_to_ycbcr(pixels: DataFrame) -> DataFrame:
    """``y, cb, cr`` in double precision from ``red, green, blue``."""
    r, g, b = (F.col(c).cast("double") for c in ("red", "green", "blue"))
    return pixels.withColumns(
        {
            "y": 0.299 * r + 0.587 * g + 0.114 * b,
            "cb": F.lit(128.0) - 0.168736 * r - 0.331264 * g + 0.5 * b,
            "cr": F.lit(128.0) + 0.5 * r - 0.418688 * g - 0.081312 * b,
        }
    )


def ycbcr_to_rgb(pixels: DataFrame) -> DataFrame:
    """``red, green, blue`` in double precision, not clipped."""
    y, cb, cr = F.col("y"), F.col("cb") - 128.0, F.col("cr") - 128.0
    return pixels.withColumns({"red": y + 1.402 * cr, "green": y - 0.344136 * cb - 0.714136 * cr, "blue": y + 1.772 * cb})


def split_channels(pixels: DataFrame) -> DataFrame:
    """One row a pixel and channel."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).alias("v")) for k, c in zip(CHANNELS, ("y", "cb", "cr"), strict=True))))
    return pixels.withColumn("one", rows).select("image_id", "one.channel", "r", "c", "one.v", "h", "w")


def merge_channels(planes: DataFrame) -> DataFrame:
    """One row a pixel with ``y, cb, cr``; a pixel without all three is an error."""
    one = planes.groupBy("image_id", "r", "c", "h", "w").agg(*(F.max(F.when(F.col("channel") == k, F.col("v"))).alias(c) for k, c in zip(CHANNELS, ("y", "cb", "cr"), strict=True)))
    whole = F.col("y").isNotNull() & F.col("cb").isNotNull() & F.col("cr").isNotNull()
    return one.withColumn("y", F.when(whole, F.col("y")).otherwise(F.raise_error(F.lit("the channels differ in shape")).cast("double")))


def to_uint8(v: Column) -> Column:
    """Clipped to 0..255 first, then rounded half to even."""
    return F.rint(F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(255.0))).cast("int")


def pad_even(planes: DataFrame) -> DataFrame:
    """Repeats a last odd row or column; ``h, w`` stay the original sizes."""
    return _repeat_last(_repeat_last(planes, "r", "h", 2), "c", "w", 2)


def downsample_420(planes: DataFrame) -> DataFrame:
    """Mean of each 2x2 cell of an even-padded plane; sizes become those of the small plane.

    The four values are added in a fixed order, so the mean has no noise.
    """
    spot = F.col("r") % 2 * 2 + F.col("c") % 2
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("r", "c")]
    small = [(padded(F.col(c), 2) / 2).cast("int").alias(c) for c in ("h", "w")]
    keyed = pad_even(planes).select("image_id", "channel", *half, *small, spot.alias("spot"), "v")
    at = {k: F.max(F.when(F.col("spot") == k, F.col("v"))) for k in range(4)}
    return keyed.groupBy("image_id", "channel", "r", "c", "h", "w").agg(((at[0] + at[2] + at[1] + at[3]) / 4).alias("v"))


def chroma_info(planes: DataFrame) -> DataFrame:
    """Sizes before and after subsampling, one row an image and channel."""
    one = planes.groupBy("image_id", "channel").agg(F.max("h").alias("orig_h"), F.max("w").alias("orig_w"))
    ph, pw = padded(F.col("orig_h"), 2), padded(F.col("orig_w"), 2)
    return one.select("image_id", "channel", "orig_h", "orig_w", ph.alias("padded_h"), pw.alias("padded_w"), (ph - F.col("orig_h")).alias("pad_h"), (pw - F.col("orig_w")).alias("pad_w"), (ph / 2).cast("int").alias("sub_h"), (pw / 2).cast("int").alias("sub_w"), F.lit(MODE).alias("mode"))


def check_same_info(info: DataFrame) -> DataFrame:
    """Images whose ``chroma_info`` is not the same for both chroma channels, or does not fit itself; empty if all are sound."""
    fits = (F.col("padded_h") == padded(F.col("orig_h"), 2)) & (F.col("padded_w") == padded(F.col("orig_w"), 2)) & (F.col("sub_h") * 2 == F.col("padded_h")) & (F.col("sub_w") * 2 == F.col("padded_w"))
    fits &= (F.col("orig_h") > 0) & (F.col("orig_w") > 0) & (F.col("pad_h") == F.col("padded_h") - F.col("orig_h")) & (F.col("pad_w") == F.col("padded_w") - F.col("orig_w")) & (F.col("mode") == MODE)
    sizes = F.struct(*(c for c in info.columns if c not in ("image_id", "channel")))
    one = info.groupBy("image_id").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("channel")).alias("channels"), F.count_distinct(sizes).alias("kinds"), F.bool_and(fits).alias("fits"))
    sound = (F.col("rows") == 2) & (F.col("channels") == F.array(F.lit("Cb"), F.lit("Cr"))) & (F.col("kinds") == 1) & F.coalesce("fits", F.lit(False))
    return one.where(~sound)


def _taps(at: str, size: str, target: Column) -> Column:
    """Target positions that take from source position ``at``, with their weights."""
    scale = F.col(size) / target
    def source(t: Column) -> Column:
        return F.least(F.greatest((t + 0.5) * scale - 0.5, F.lit(0.0)), F.col(size) - 1.0)

    first = F.greatest(F.floor((F.col(at) - 1) / scale).cast("int") - 1, F.lit(0))
    last = F.least(F.ceil((F.col(at) + 2) / scale).cast("int") + 1, target - 1)
    edges = F.when(F.col(at) == 0, F.lit(0)).otherwise(first), F.when(F.col(at) == F.col(size) - 1, target - 1).otherwise(last)
    weighted = F.transform(F.sequence(*edges), lambda t: F.struct(t.alias("t"), (1.0 - F.abs(source(t) - F.col(at))).alias("k")))
    return F.filter(weighted, lambda s: s["k"] > 0)


def resize_bilinear(planes: DataFrame, target_h: Column, target_w: Column) -> DataFrame:
    """Bilinear resampling with centred pixels and clamped edges.

    Each source pixel is exploded to the targets that it has a share in (four to
    nine at a scale of two) and the shares are summed; no neighbour join.
    """
    rows = planes.withColumns({"bl_h": target_h, "bl_w": target_w}).withColumn("a", F.explode(_taps("r", "h", F.col("bl_h"))))
    cells = rows.withColumn("b", F.explode(_taps("c", "w", F.col("bl_w"))))
    keyed = cells.select("image_id", "channel", F.col("a.t").alias("r"), F.col("b.t").alias("c"), F.col("bl_h").alias("h"), F.col("bl_w").alias("w"), (F.col("a.k") * F.col("b.k") * F.col("v")).alias("v"))
    return keyed.groupBy("image_id", "channel", "r", "c", "h", "w").agg(F.sum("v").alias("v"))


def upsample_420(small: DataFrame, sizes: DataFrame, mode: str = MODE) -> DataFrame:
    """Small planes at twice their size, cropped to the original one.

    ``sizes`` has one row an image with its ``orig_h`` and ``orig_w``.
    """
    require(mode == MODE, "only 4:2:0 is known")
    big = resize_bilinear(small.withColumn("v", F.col("v").cast("double")), F.col("h") * 2, F.col("w") * 2).drop("h", "w")
    cut = big.join(sizes, "image_id").where((F.col("r") < F.col("orig_h")) & (F.col("c") < F.col("orig_w")))
    return cut.select("image_id", "channel", "r", "c", F.col("orig_h").alias("h"), F.col("orig_w").alias("w"), "v")
