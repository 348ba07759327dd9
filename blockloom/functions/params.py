"""Fixed tables and small matrices of the block codec, and checks of its parameters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BLOCK = 8

# The example quantization tables of ITU-T T.81, Annex K, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

# Block classes, and the quantizer scale of each.
SMOOTH, EDGE, TEXTURE = 0, 1, 2
CLASS_NAMES = {SMOOTH: "smooth", EDGE: "edge", TEXTURE: "texture"}
CLASS_SCALES = {SMOOTH: 1.5, EDGE: 0.75, TEXTURE: 1.0}


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def alpha(k: int, n: int) -> float:
    """Normalizer of basis vector ``k`` of ``n``."""
    require(n > 0 and 0 <= k < n, f"k must be in 0..{n - 1}")
    return math.sqrt((1 if k == 0 else 2) / n)


def dct_matrix(n: int = BLOCK) -> np.ndarray:
    """Orthonormal DCT-II: row ``k`` holds frequency ``k``."""
    require(n > 0, "the size must be positive")
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.array([[alpha(i, n)] for i in range(n)]) * np.cos(np.pi / n * (x + 0.5) * k)


def basis_relation(spark: SparkSession, n: int = BLOCK) -> DataFrame:
    """``k, n, b``: the DCT matrix as rows."""
    return spark.createDataFrame([(k, x, float(v)) for k, row in enumerate(dct_matrix(n)) for x, v in enumerate(row)], "k int, n int, b double")


def is_orthonormal(matrix: np.ndarray, atol: float = 1e-10) -> bool:
    """Whether the matrix times its transpose is the identity; false if it isn't square."""
    m = np.asarray(matrix, float)
    return m.ndim == 2 and m.shape[0] == m.shape[1] and bool(np.allclose(m @ m.T, np.eye(len(m)), atol=atol))


def zigzag_order(n: int = BLOCK) -> list[int]:
    """Row-major position of each zig-zag step: diagonals in turn, up on even sums, down on odd."""
    require(n > 0, "the size must be positive")
    cells = [(u, v) for u in range(n) for v in range(n)]
    return [u * n + v for u, v in sorted(cells, key=lambda p: (sum(p), -p[0] if sum(p) % 2 == 0 else p[0]))]


def zigzag_relation(spark: SparkSession, n: int = BLOCK) -> DataFrame:
    return spark.createDataFrame([(p // n, p % n, z) for z, p in enumerate(zigzag_order(n))], "u int, v int, z int")


def check_order(order: list[int], n: int = BLOCK) -> None:
    require(sorted(order) == list(range(n * n)), "a scan order must hold each of the n*n positions once")


def scale_table(table: list[float], scale: float = 1.0, low: float = 1, high: float = 255) -> list[float]:
    """The table times ``scale``, rounded half to even and clipped."""
    require(scale > 0, "the scale must be positive")
    require(low > 0, "the lower bound must be positive")
    require(high >= low, "the upper bound must not be below the lower")
    require(len(table) > 0 and math.isqrt(len(table)) ** 2 == len(table), "a quantization table must be square")
    require(all(q > 0 for q in table), "quantization steps must be positive")
    return np.clip(np.rint(scale * np.asarray(table, float)), low, high).tolist()


def quality_to_scale(quality: int) -> float:
    """Scale of a quality from 1 to 100, 0.01 at least."""
    if isinstance(quality, bool) or not isinstance(quality, int):
        raise TypeError("the quality must be an integer")
    require(1 <= quality <= 100, "the quality must be in 1..100")
    return max((5000 / quality if quality < 50 else 200 - 2 * quality) / 100, 0.01)


def quality_table(quality: int, base: list[float] | None = None, low: float = 1, high: float = 255) -> list[float]:
    return scale_table(LUMA if base is None else base, quality_to_scale(quality), low, high)


def color_tables(scale: float = 1.0, chroma_scale: float | None = None, low: float = 1, high: float = 255) -> dict[str, list[float]]:
    """Tables of the three channels; chroma follows ``scale`` unless it has a scale of its own."""
    chroma = scale_table(CHROMA, scale if chroma_scale is None else chroma_scale, low, high)
    return {"Y": scale_table(LUMA, scale, low, high), "Cb": chroma, "Cr": chroma}


def configs(spark: SparkSession, tables: dict[str, list[float]]) -> DataFrame:
    """``config_id, q``: one row for each named table."""
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in tables.items()], "config_id string, q array<double>")


def padding(height: int, width: int, block: int = BLOCK) -> tuple[int, int]:
    """Rows and columns missing to the next multiple of ``block``."""
    require(height > 0 and width > 0 and block > 0, "sizes must be positive")
    return -height % block, -width % block


def parse_numbers(text: str, kind: type = float) -> list:
    """Comma-separated numbers; blank entries are skipped, an empty list is an error."""
    out = [kind(x) for x in (p.strip() for p in text.split(",")) if x]
    require(bool(out), "the list is empty")
    return out
