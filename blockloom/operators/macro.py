"""The colour path by squares of 16 x 16 pixels: four Y blocks and one block of each chroma channel.

A square is one row, so conversion, subsampling, padding and tiling need one
shuffle, and so do enlarging, merging and the way back.  The results are those of
the pixel operators in ``color``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK
from blockloom.operators.color import CHANNELS

SIDE = 2 * BLOCK
_BLOCKS = "array<struct<channel:string,h:int,w:int,br:int,bc:int,px:array<float>>>"
_PIXELS = "array<struct<r:int,c:int,red:int,green:int,blue:int>>"


def _ycbcr(x: np.ndarray) -> tuple[np.ndarray, ...]:
    r, g, b = (x[..., k] for k in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b, 128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b


def _to(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Edges repeated to so many rows and columns."""
    return np.pad(x, ((0, 0), (0, rows - x.shape[1]), (0, cols - x.shape[2])), mode="edge")


def _halved(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 cells of even-padded planes; the four values are added in a fixed order."""
    x = _to(x, x.shape[1] + x.shape[1] % 2, x.shape[2] + x.shape[2] % 2)
    return (x[:, ::2, ::2] + x[:, 1::2, ::2] + x[:, ::2, 1::2] + x[:, 1::2, 1::2]) / 4


def _tile(red: pa.Array, green: pa.Array, blue: pa.Array, h: pa.Array, w: pa.Array, mr: pa.Array, mc: pa.Array) -> pa.Array:
    ends = red.offsets.to_numpy()
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    flat = np.stack([np.asarray(x.flatten(), float) for x in (red, green, blue)], -1)
    h, w, mr, mc = (np.asarray(x).astype(np.int64) for x in (h, w, mr, mc))
    high, wide = np.minimum(h - mr * SIDE, SIDE), np.minimum(w - mc * SIDE, SIDE)
    if (sizes != high * wide).any():
        raise ValueError("a square must have each of its pixels once")
    out: list[tuple] = []  # row, channel, br, bc, values
    for a, b in sorted(set(zip(high.tolist(), wide.tolist(), strict=True))):
        at = np.flatnonzero((high == a) & (wide == b))
        y, *chroma = _ycbcr(flat[starts[at][:, None] + np.arange(a * b)].reshape(-1, a, b, 3))
        y = _to(y, -(-a // BLOCK) * BLOCK, -(-b // BLOCK) * BLOCK)
        for i, j in np.ndindex(y.shape[1] // BLOCK, y.shape[2] // BLOCK):
            out.append((at, 0, mr[at] * 2 + i, mc[at] * 2 + j, y[:, i * BLOCK : (i + 1) * BLOCK, j * BLOCK : (j + 1) * BLOCK]))
        for k, x in enumerate(chroma, 1):
            out.append((at, k, mr[at], mc[at], _to(_halved(x), BLOCK, BLOCK)))
    if not out:
        return pa.array([], pa.list_(pa.struct([("channel", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("br", pa.int32()), ("bc", pa.int32()), ("px", pa.list_(pa.float32()))])))
    row = np.concatenate([x[0] for x in out])
    kind = np.concatenate([np.full(len(x[0]), x[1]) for x in out])
    br, bc = (np.concatenate([x[k] for x in out]) for k in (2, 3))
    px = np.concatenate([x[4].reshape(-1, BLOCK * BLOCK) for x in out]).astype(np.float32)
    order = np.argsort(row, kind="stable")
    row, kind, br, bc, px = (x[order] for x in (row, kind, br, bc, px))
    sub = np.where(kind == 0, 1, 2)
    parts = [
        pa.array(np.array(CHANNELS, object)[kind], pa.string()), *(pa.array((-(-x // sub)).astype(np.int32)) for x in (h[row], w[row])), pa.array(br.astype(np.int32)), pa.array(bc.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.arange(len(px) + 1, dtype=np.int32) * BLOCK * BLOCK), pa.array(px.reshape(-1))),
    ]
    cuts = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(parts, names=["channel", "h", "w", "br", "bc", "px"]))


def color_blocks(pixels: DataFrame) -> DataFrame:
    """Tiled planes of RGB pixels, as tiling Y and the subsampled chroma channels gives them."""
    def div(c: str):
        return F.floor(F.col(c) / SIDE).cast("int")

    cell = F.struct((F.col("r") % SIDE * SIDE + F.col("c") % SIDE).alias("i"), *(F.col(k).cast("double").alias(k) for k in ("red", "green", "blue")))
    squares = pixels.groupBy("image_id", "h", "w", div("r").alias("mr"), div("c").alias("mc")).agg(F.sort_array(F.collect_list(cell)).alias("s"))
    tiled = squares.select("image_id", F.explode(F.arrow_udf(_tile, _BLOCKS)(*(F.col(f"s.{k}") for k in ("red", "green", "blue")), "h", "w", "mr", "mc")).alias("b"))
    return tiled.select("image_id", "b.channel", "b.h", "b.w", "b.br", "b.bc", "b.px")


#: Where the blocks around a square stand in its bordered chroma block, and which of their values: row 0, 7 or all.
_ALL = slice(1, BLOCK + 1)
_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _strip(dy: int, dx: int) -> list[int]:
    """Places of the values that a block gives to the square ``dy, dx`` away."""
    rows, cols = ({-1: [0], 0: range(BLOCK), 1: [BLOCK - 1]}[d] for d in (dy, dx))
    return [i * BLOCK + j for i in rows for j in cols]


def _enlarged(x: np.ndarray, size: np.ndarray, first: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many rows (or columns) of bordered blocks; ``first`` and ``size`` are of the whole plane."""
    t = first[:, None] * SIDE + np.arange(SIDE)
    source = np.clip((t + 0.5) / 2 - 0.5, 0, size[:, None] - 1.0)
    low = np.floor(source).astype(np.int64)
    high = np.minimum(low + 1, size[:, None] - 1)
    base = first[:, None] * BLOCK - 1
    shape = (-1, SIDE, 1) if axis == 1 else (-1, 1, SIDE)
    near, far = (np.take_along_axis(x, (i - base).reshape(shape), axis) for i in (low, high))
    share = (source - low).reshape(shape)
    return near * (1 - share) + far * share


def _merge(kinds: pa.Array, values: pa.Array, h: pa.Array, w: pa.Array, mr: pa.Array, mc: pa.Array) -> pa.Array:
    n = len(kinds)
    owner = np.repeat(np.arange(n), np.diff(kinds.offsets.to_numpy()))
    kind, lists = np.asarray(kinds.flatten()), values.flatten()
    flat, begin = np.asarray(lists.flatten(), float), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    h, w, mr, mc = (np.asarray(x).astype(np.int64) for x in (h, w, mr, mc))
    high, wide = np.minimum(h - mr * SIDE, SIDE), np.minimum(w - mc * SIDE, SIDE)
    y, chroma = np.full((n, SIDE, SIDE), np.nan), np.full((2, n, BLOCK + 2, BLOCK + 2), np.nan)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        if k < 4:
            i, j = divmod(int(k), 2)
            y[owner[at], i * BLOCK : (i + 1) * BLOCK, j * BLOCK : (j + 1) * BLOCK] = flat[begin[at][:, None] + np.arange(BLOCK * BLOCK)].reshape(-1, BLOCK, BLOCK)
        else:
            channel, (dy, dx) = (int(k) - 4) // 9, _AROUND[(int(k) - 4) % 9]
            rows, cols = ({-1: slice(BLOCK + 1, BLOCK + 2), 0: _ALL, 1: slice(0, 1)}[d] for d in (dy, dx))
            shape = [BLOCK if d == 0 else 1 for d in (dy, dx)]
            chroma[channel, owner[at], rows, cols] = flat[begin[at][:, None] + np.arange(shape[0] * shape[1])].reshape(-1, *shape)
    sub_h, sub_w = -(-h // 2), -(-w // 2)
    cb, cr = (_enlarged(_enlarged(x, sub_h, mr, 1), sub_w, mc, 2) - 128.0 for x in chroma)
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])
    inside = (np.arange(SIDE) < high[:, None])[:, :, None] & (np.arange(SIDE) < wide[:, None])[:, None, :]
    if np.isnan(rgb[:, inside]).any():
        raise ValueError("the channels differ in shape")
    row, i, j = np.nonzero(inside)
    whole = np.rint(np.clip(rgb[:, inside], 0, 255)).astype(np.int32)
    parts = [pa.array((mr[row] * SIDE + i).astype(np.int32)), pa.array((mc[row] * SIDE + j).astype(np.int32)), *(pa.array(x) for x in whole)]
    cuts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(parts, names=["r", "c", "red", "green", "blue"]))


def color_pixels(blocks: DataFrame, column: str = "px") -> DataFrame:
    """RGB pixels of restored blocks: chroma is enlarged with a border of one value from the blocks around.

    ``blocks`` hold whole numbers; sizes are those of Y, which each square has at least one block of.
    """
    px = F.col(column).cast("array<double>")

    def piece(kind: int, dy: int, dx: int, value):
        return F.struct((F.col("br") + dy).alias("mr"), (F.col("bc") + dx).alias("mc"), F.lit(kind).alias("kind"), value.alias("value"))

    y = F.array(F.struct(F.floor(F.col("br") / 2).cast("int").alias("mr"), F.floor(F.col("bc") / 2).cast("int").alias("mc"), (F.col("br") % 2 * 2 + F.col("bc") % 2).cast("int").alias("kind"), px.alias("value")))
    around = {k: F.array(*(piece(4 + 9 * k + i, dy, dx, px if dy == dx == 0 else F.array(*(px[p] for p in _strip(dy, dx)))) for i, (dy, dx) in enumerate(_AROUND))) for k in (0, 1)}
    pieces = F.explode(F.when(F.col("channel") == "Y", y).when(F.col("channel") == "Cb", around[0]).otherwise(around[1]))
    is_y = F.col("channel") == "Y"
    sized = blocks.select("image_id", F.when(is_y, F.col("h")).alias("h"), F.when(is_y, F.col("w")).alias("w"), pieces.alias("p"))
    squares = sized.groupBy("image_id", "p.mr", "p.mc").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.collect_list(F.struct("p.kind", "p.value")).alias("s"))
    pixels = squares.where("h is not null").withColumn("b", F.explode(F.arrow_udf(_merge, _PIXELS)("s.kind", "s.value", "h", "w", "mr", "mc")))
    return pixels.select("image_id", "b.r", "b.c", "h", "w", "b.red", "b.green", "b.blue")
