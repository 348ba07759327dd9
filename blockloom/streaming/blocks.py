"""The stateless part of the codec on streams.

A block's transform, quantization and symbols look at no other row, so they run
on a stream of packed blocks as they do on a table.  Classes by percentile, DC
differences and codebooks need a whole plane and stay batch steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, require
from blockloom.operators.coding import rle_encode, zigzag_scan
from blockloom.operators.preprocess import level_shift
from blockloom.operators.quantize import literal_table, quantize
from blockloom.operators.transform import dct2


def encode_stream(blocks: DataFrame, table: list[float]) -> DataFrame:
    """Adds ``qf``, ``dc`` and ``ac_symbols`` to blocks of unshifted values ``px``."""
    require(len(table) == BLOCK * BLOCK, "the table must have one step a coefficient")
    q = dct2(level_shift(blocks)).withColumn("qf", quantize(F.col("f"), literal_table(table)))
    z = q.withColumn("bl_z", zigzag_scan(F.col("qf")))
    return z.withColumns({"dc": F.col("bl_z")[0], "ac_symbols": rle_encode(F.col("bl_z"))}).drop("bl_z", "f", "px")
