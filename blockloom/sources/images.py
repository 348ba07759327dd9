"""Image files to pixel relations, and pixel relations to PNG files and CSV."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.params import require

PIXELS = "image_id string, r int, c int, red int, green int, blue int, h int, w int"


def read_rgb(spark: SparkSession, path: str, skip_invalid: bool = False) -> DataFrame:
    """Pixels of every image under ``path``, one file or a folder, in any format Spark's image source reads.

    Gray images repeat their value, an alpha channel is dropped.  A path
    that doesn't exist is an error when the plan is made; a file that is no
    image is an error when it is read, or left out if ``skip_invalid``.  Batches of a few rows bound the memory.
    """

    def decode(batches):
        for batch in batches:
            for img in batch.column("image").to_pylist():
                h, w, n = img["height"], img["width"], img["nChannels"]
                require(h > 0 and w > 0, f"{img['origin']} can't be read as an image")
                require(n in (1, 3, 4), f"{n} channels are not known")
                px = np.frombuffer(img["data"], np.uint8).reshape(h, w, n)
                bgr = np.repeat(px, 3, axis=2) if n == 1 else px[:, :, :3]
                step = max(1, 100_000 // max(w, 1))
                for top in range(0, h, step):
                    part = bgr[top : top + step]
                    r, c = np.indices(part.shape[:2], np.int32)
                    m = r.size
                    cols = [pa.array([img["origin"]] * m, pa.string()), r.ravel() + np.int32(top), c.ravel(), *(part[:, :, k].ravel().astype(np.int32) for k in (2, 1, 0)), np.full(m, h, np.int32), np.full(m, w, np.int32)]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=[x.split()[0] for x in PIXELS.split(", ")])

    files = spark.read.format("image").option("dropInvalid", skip_invalid).load(path)
    return files.mapInArrow(decode, PIXELS)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of a gray (h, w) or colour (h, w, 3) array."""
    require(pixels.dtype == np.uint8 and pixels.ndim in (2, 3) and pixels.size > 0, "a PNG needs bytes of two or three dimensions")
    color = pixels.ndim == 3
    require(not color or pixels.shape[2] == 3, "a colour image has three channels")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1)
    header = struct.pack(">IIBBBBB", w, h, 8, 2 if color else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def to_png(pixels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``key, png``: one file's bytes for each image of ``v`` or of ``red, green, blue``.

    An image is one task's work, as it is one file.
    """
    key = key or ["image_id"]
    bands = ["v"] if "v" in pixels.columns else ["red", "green", "blue"]
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}

    def build(pdf):
        import pandas as pd

        out = np.zeros((int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), len(bands)), np.uint8)
        out[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf[bands].to_numpy().astype(np.uint8)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), png(out[:, :, 0] if len(bands) == 1 else out)]], columns=[*key, "png"])

    return pixels.select(*key, "r", "c", "h", "w", *bands).groupBy(*key).applyInPandas(build, ", ".join(f"{k} {kinds[k]}" for k in key) + ", png binary")


def save_png(images: DataFrame, folder: str, name_col: str = "name") -> None:
    """Writes each row's ``png`` to ``folder/name.png`` from the executors, folders made as needed."""

    def write(batches):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(at, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_output_stream(f"{at}/{row[name_col]}.png", compression=None) as f:
                    f.write(row["png"])
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    images.select(F.col(name_col), "png").mapInArrow(write, "done int").count()


def save_csv(results: DataFrame, path: str) -> None:
    """Result rows as one CSV file of that name, header first; no rows are an error.

    Results are one row a run, so they pass through the driver.  Nulls are
    empty, an infinite value is ``inf``.
    """
    import csv
    from pathlib import Path

    rows = results.collect()
    require(bool(rows), "there are no results to save")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, results.columns)
        out.writeheader()
        out.writerows({k: "" if v is None else v for k, v in r.asDict().items()} for r in rows)
