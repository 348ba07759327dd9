"""Whole runs: gray single runs and sweeps, and the colour run, each as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, LUMA, color_tables, configs, quality_table, scale_table
from blockloom.operators import color, metrics
from blockloom.operators.coding import decode_blocks, encode_blocks, rle_encode, with_dc_before, zigzag_scan
from blockloom.operators.macro import color_blocks, color_pixels
from blockloom.operators.preprocess import PLANE, level_shift, pack_blocks, pad_edge, preprocess, rgb_to_gray, split_blocks
from blockloom.operators.quantize import adaptive_table, block_features, classify_blocks, dequantize, quantize, with_scale, with_table
from blockloom.operators.reconstruct import whole_blocks
from blockloom.operators.transform import block_error, dct2
from blockloom.storage import drop, written

RUN = ["config_id", *PLANE]


def setting_name(kind: str, value: float) -> str:
    """``scale_2``, ``scale_0.25``, ``quality_80``: the value to the last digit."""
    return f"{kind}_{value:g}" if float(f"{value:g}") == value else f"{kind}_{value!r}"


def sweep_tables(scales: list[float] = (), qualities: list[int] = (), base: list[float] | None = None) -> dict[str, list[float]]:
    """Named tables, one for each entry in order: ``scale_2`` and so on, ``quality_80`` and so on.

    An entry that stands again gets a name of its own (``scale_2_again1``).
    """
    out: dict[str, list[float]] = {}
    for kind, value in [*(("scale", s) for s in scales), *(("quality", q) for q in qualities)]:
        name = first = setting_name(kind, value)
        again = 0
        while name in out:
            again += 1
            name = f"{first}_again{again}"
        out[name] = scale_table(base or LUMA, value) if kind == "scale" else quality_table(value, base)
    return out


def coefficients(pixels: DataFrame) -> DataFrame:
    """Pixels of gray planes to coefficient blocks."""
    return dct2(preprocess(pixels)).drop("px")


def transformed(pixels: DataFrame) -> DataFrame:
    """Blocks of gray planes, ``px`` as it is and ``f``, written once: all settings of all runs read them."""
    raw = pack_blocks(split_blocks(pad_edge(rgb_to_gray(pixels))))
    shifted = level_shift(raw.withColumn("bl_shifted", F.col("px")), column="bl_shifted")
    return written(dct2(shifted, "bl_shifted").drop("bl_shifted"), "coefficients")


def quantized_sweep(coeffs: DataFrame, tables: dict[str, list[float]]) -> DataFrame:
    """Each block under each table.  The transform is done once; the tables are few literals."""
    rows = configs(coeffs.sparkSession, tables)
    return coeffs.crossJoin(F.broadcast(rows)).withColumn("qf", quantize(F.col("f"), F.col("q"))).drop("f")


def encoded_sweep(blocks: DataFrame, tables: dict[str, list[float]]) -> DataFrame:
    """``encode_blocks`` of each block under each table.

    A plane's table holds for all its blocks, so what the DC before is quantized to
    follows from its coefficient: neighbours meet once, not once a setting.
    """
    before = with_dc_before(blocks.withColumn("bl_f0", F.col("f")[0]), "bl_f0", PLANE, "bl_before").drop("bl_f0")
    z = quantized_sweep(before, tables).withColumn("bl_z", zigzag_scan(F.col("qf")))
    last = F.coalesce(F.rint(F.col("bl_before") / F.col("q")[0]), F.lit(0.0)).cast("int")
    return z.withColumns({"dc_diff": F.col("bl_z")[0] - last, "ac_symbols": rle_encode(F.col("bl_z"))}).drop("bl_z", "bl_before")


def run_blocks(blocks: DataFrame, tables: dict[str, list[float]], decode: bool = True) -> DataFrame:
    """One row of all figures for each plane of ``transformed`` blocks and each table.

    A block's original values stand in its row, so errors are summed there: no
    pixel is exploded or joined, and one sum a plane and setting ends it.
    """
    encoded = encoded_sweep(blocks, tables).withColumns(metrics.block_counts("qf"))
    back = decode_blocks(encoded.drop("qf"), RUN) if decode else encoded
    done = back.withColumn("bl_f", dequantize(F.col("qf"), F.col("q"))).withColumn("bl_e", block_error("bl_f", "px"))
    errors = F.array(*(F.sum(F.col("bl_e")[i]) for i in range(3))).alias("bl_error")
    figures = metrics.quality_of(metrics.compression_of(done, RUN, errors))
    ph, pw = F.col("num_blocks_vertical") * BLOCK, F.col("num_blocks_horizontal") * BLOCK
    return figures.withColumns({"padded_height": ph, "padded_width": pw, "pad_height": ph - F.col("original_height"), "pad_width": pw - F.col("original_width")})


def run_gray(pixels: DataFrame, tables: dict[str, list[float]], decode: bool = True) -> DataFrame:
    """One row of all figures for each plane and table.

    ``decode`` restores the image from its symbols, not from the quantized blocks.
    """
    return run_blocks(transformed(pixels), tables, decode)


def color_planes(pixels: DataFrame) -> DataFrame:
    """Y at full size, chroma subsampled, as one relation of planes."""
    planes = color.split_channels(color.rgb_to_ycbcr(pixels))
    return planes.where("channel = 'Y'").unionByName(color.downsample_420(planes.where("channel <> 'Y'")))


def color_quantized(blocks: DataFrame, scale: float = 1.0, adaptive: bool = True, chroma_scale: float | None = None) -> DataFrame:
    """Quantized blocks of three channels, from tiled planes; Y by block class if ``adaptive``, on unshifted values.

    ``q`` is the table that each block was quantized with.  Thresholds are a row a
    plane; features, class and table stay in the block's row.
    """
    raw = with_table(blocks, color_tables(scale, chroma_scale))
    if adaptive:
        y = with_scale(classify_blocks(block_features(raw.where("channel = 'Y'"))))
        known = F.when(F.col("scale").isNull(), F.raise_error(F.lit("a Y block has no class")).cast("array<double>")).otherwise(adaptive_table(F.col("q"), F.col("scale")))
        raw = y.withColumn("q", known).select(*raw.columns).unionByName(raw.where("channel <> 'Y'"))
    return dct2(level_shift(raw)).withColumn("qf", quantize(F.col("f"), F.col("q"))).drop("px", "f")


def color_restored(planes_back: DataFrame, sizes: DataFrame) -> DataFrame:
    """RGB pixels from restored planes; chroma is rounded before it is enlarged.

    ``sizes`` has one row an image with its ``orig_h`` and ``orig_w``.
    """
    y = planes_back.where("channel = 'Y'")
    big = color.upsample_420(planes_back.where("channel <> 'Y'"), sizes)
    merged = color.merge_channels(y.withColumn("v", F.col("v").cast("double")).unionByName(big))
    return color.ycbcr_to_rgb(merged).select("image_id", "r", "c", "h", "w", *(color.to_uint8(F.col(c)).alias(c) for c in ("red", "green", "blue")))


def run_color(pixels: DataFrame, scale: float = 4.0, adaptive: bool = True, chroma_scale: float | None = None) -> DataFrame:
    """Encoded, decoded and restored RGB pixels, by squares of 16 x 16.

    Tiled planes, quantized and encoded blocks are written once; each is read by two
    branches after it.
    """
    blocks = written(color_blocks(pixels), "blocks")
    quantized = written(color_quantized(blocks, scale, adaptive, chroma_scale), "quantized")
    encoded = written(encode_blocks(quantized, PLANE).drop("qf"), "encoded")
    drop(blocks, quantized)
    return color_pixels(whole_blocks(decode_blocks(encoded, PLANE)))
