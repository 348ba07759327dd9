"""Command line: one image, or a sweep, to PNG files, one CSV and a summary."""

from __future__ import annotations

import argparse
import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, dct_matrix, parse_numbers
from blockloom.operators.coding import decode_blocks
from blockloom.operators.preprocess import rgb_to_gray
from blockloom.operators.reconstruct import from_quantized
from blockloom.plans.pipelines import RUN, encoded_sweep, run_blocks, sweep_tables, transformed
from blockloom.sources.images import png, read_rgb, save_csv, save_png, to_png

#: Result columns in the order of the CSV file.
RESULT = (
    "image_path output_image_path scale quality original_height original_width padded_height padded_width pad_height pad_width "
    "num_blocks_vertical num_blocks_horizontal mse mae psnr total_coefficients zero_coefficients nonzero_coefficients zero_percentage "
    "rle_symbols average_rle_symbols_per_block original_bits compressed_bits compression_ratio reduction_percentage"
).split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description="Block-transform compression of images on Spark")
    p.add_argument("--image", required=True, help="an image file, or a folder of them")
    p.add_argument("--output-dir", default="results")
    p.add_argument("--scale", type=float, default=1.0, help="scale of the quantization table")
    p.add_argument("--quality", type=int, help="quality from 1 to 100; goes before --scale")
    p.add_argument("--sweep-scales", help="comma-separated scales; goes before all others")
    p.add_argument("--sweep-qualities", help="comma-separated qualities")
    p.add_argument("--no-plots", action="store_true", help="a sweep leaves out its plots")
    return p


def run(spark: SparkSession, image: str, output_dir: str, scales: list[float] = (), qualities: list[int] = (), save_images: bool = True, scale: float = 1.0) -> DataFrame:
    """``RESULT``, a row for each image and setting in the order given; restored images are saved beside.

    All settings share one plan and one transform.  A row of a quality records
    ``scale``, which it doesn't use; a row of a scale has no quality.  For a folder of images, each
    file's name is part of its restored images' names.
    """
    if not Path(image).exists():
        raise FileNotFoundError(image)
    tables = sweep_tables(scales, qualities)
    blocks = transformed(rgb_to_gray(read_rgb(spark, image)))
    stem = F.regexp_extract("image_id", "([^/]*?)(?:[.][^./]*)?$", 1)
    settings = [(k, float(s), None if q is None else int(q), i) for i, (k, s, q) in enumerate(zip(tables, [*scales, *(scale for _ in qualities)], [*(None for _ in scales), *qualities], strict=True))]
    known = spark.createDataFrame(settings, "config_id string, scale double, quality int, place int")
    name = F.concat(F.lit("reconstructed_"), F.concat(stem, F.lit("_")) if Path(image).is_dir() else F.lit(""), F.col("config_id"))
    if save_images:
        encoded = encoded_sweep(blocks, tables)
        back = from_quantized(decode_blocks(encoded.drop("qf", "px"), RUN), RUN)
        save_png(to_png(back, ["image_id", "config_id"]).withColumn("name", name), str(Path(output_dir).resolve()))
    out = F.concat(F.lit(f"{output_dir}/"), name, F.lit(".png")) if save_images else F.lit("")
    path = F.regexp_replace("image_id", "^file:/+", "/") if Path(image).is_dir() else F.lit(str(image))
    rows = run_blocks(blocks, tables).join(F.broadcast(known), "config_id").withColumns({"image_path": path, "output_image_path": out})
    return rows.orderBy("place", "image_path").select(*RESULT)


def plot_points(results: DataFrame) -> DataFrame:
    """``x, psnr, compression_ratio, zero_percentage``: what a sweep's three plots show, by quality or else by scale."""
    return results.select(F.coalesce(F.col("quality").cast("double"), "scale").alias("x"), "psnr", "compression_ratio", "zero_percentage").orderBy("x")


def save_plots(results: DataFrame, output_dir: str) -> list[str]:
    """Three plots as PDF and PNG; none without matplotlib or rows."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    points = [r.asDict() for r in plot_points(results).collect()]  # one a setting
    made = []
    for y, label in (("psnr", "PSNR [dB]"), ("compression_ratio", "Compression ratio"), ("zero_percentage", "Zero coefficients [%]")) if points else ():
        figure, axes = pyplot.subplots()
        axes.plot([p["x"] for p in points], [p[y] for p in points], marker="o")
        axes.set(xlabel="quality or scale", ylabel=label)
        for kind in ("pdf", "png"):
            made.append(f"{output_dir}/{y}.{kind}")
            figure.savefig(made[-1])
        pyplot.close(figure)
    return made


def summary(row: dict) -> str:
    """A result row for reading."""
    setting = f"Quality             {row['quality']}" if row["quality"] is not None else f"Scale               {row['scale']}"
    psnr = "infinite" if math.isinf(row["psnr"]) else f"{row['psnr']:.2f} dB"
    lines = [
        f"Image               {row['original_height']} x {row['original_width']}",
        f"Padded              {row['padded_height']} x {row['padded_width']} (+{row['pad_height']} rows, +{row['pad_width']} columns)",
        f"Blocks              {row['num_blocks_vertical']} x {row['num_blocks_horizontal']}",
        setting,
        quality_text(row | {"psnr_text": psnr}),
        compression_text(row),
    ]
    return "\n".join([*lines, f"Restored image      {row['output_image_path']}"] if row["output_image_path"] else lines)


def quality_text(row: dict) -> str:
    psnr = row.get("psnr_text") or ("infinite" if math.isinf(row["psnr"]) else f"{row['psnr']:.2f} dB")
    return f"MSE                 {row['mse']:.4f}\nMAE                 {row['mae']:.4f}\nPSNR                {psnr}"


def compression_text(row: dict) -> str:
    return "\n".join((
        f"Zero coefficients   {row['zero_percentage']:.2f} % ({row['zero_coefficients']} of {row['total_coefficients']})",
        f"RLE symbols         {row['rle_symbols']} ({row['average_rle_symbols_per_block']:.2f} a block)",
        f"Bits                {row['original_bits']} to {row['compressed_bits']}",
        f"Compression         {row['compression_ratio']:.2f}:1 ({row['reduction_percentage']:.2f} % less)",
    ))


def huffman_text(row: dict) -> str:
    return "\n".join((
        f"Symbols             {row['symbol_count']} of {row['alphabet_size']} kinds",
        f"Entropy             {row['entropy']:.4f} bits a symbol",
        f"Mean code           {row['average_code_length']:.4f} bits a symbol",
        f"Bits                {row['bit_count']} (fixed length {row['fixed_length_bits']}, {row['compression_gain_vs_fixed']:.4f} x)",
    ))


def class_text(row: dict) -> str:
    return "\n".join(f"{k:<20}{row[k]} ({row[f'{k}_percentage']:.2f} %)" for k in ("smooth", "edge", "texture"))


def save_basis(output_dir: str, zoom: int = 12) -> list[str]:
    """The basis images in four groups of 4 x 4, one PNG each; values from -0.25 to 0.25 go from black to white."""
    m = dct_matrix(BLOCK)
    shown = np.clip(np.einsum("ux,vy->uvxy", m, m), -0.25, 0.25)
    gray = np.rint((shown + 0.25) * 510).astype(np.uint8).repeat(zoom, 2).repeat(zoom, 3)
    made, half, size = [], BLOCK // 2, BLOCK * zoom + zoom
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    for u in (0, half):
        for v in (0, half):
            sheet = np.full((half * size + zoom, half * size + zoom), 255, np.uint8)
            for i, j in np.ndindex(half, half):
                sheet[i * size + zoom : (i + 1) * size, j * size + zoom : (j + 1) * size] = gray[u + i, v + j]
            made.append(f"{output_dir}/dct_bases_{u}_{u + half - 1}_{v}_{v + half - 1}.png")
            Path(made[-1]).write_bytes(png(sheet))
    return made


def main(argv: list[str] | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    if not Path(args.image).exists():
        raise FileNotFoundError(args.image)
    scales, qualities, name = [args.scale], [], "results_single_run"
    if args.sweep_scales is not None:
        scales, name = parse_numbers(args.sweep_scales), "results_sweep_scales"
    elif args.sweep_qualities is not None:
        scales, qualities, name = [], parse_numbers(args.sweep_qualities, int), "results_sweep_qualities"
    elif args.quality is not None:
        scales, qualities = [], [args.quality]
    spark = SparkSession.builder.getOrCreate()
    results = run(spark, args.image, args.output_dir, scales, qualities, scale=args.scale if name == "results_single_run" else 1.0).cache()
    save_csv(results, f"{args.output_dir}/{name}.csv")
    if name != "results_single_run" and not args.no_plots:
        save_plots(results, args.output_dir)
    for row in results.collect():
        print(summary(row.asDict()), end="\n\n")
    print(f"Results             {args.output_dir}/{name}.csv")
    return results


if __name__ == "__main__":
    main()
