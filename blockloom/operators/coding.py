"""Zig-zag order, DC differences, run lengths: symbols of packed blocks and back.

A block's AC symbols are an array in its row, so run lengths need no window and
no shuffle.  Only DC differences look at another row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.params import BLOCK, check_order, zigzag_order
from blockloom.operators.preprocess import PLANE, checked_values

SYMBOL = "struct<kind:string,run:int,amp:int>"
DC, AC, EOB, BLOCK_END = "DC", "AC", "EOB", "BLOCK_END"


def zigzag_scan(q: Column, order: list[int] | None = None) -> Column:
    """A packed block in scan order."""
    order = zigzag_order(BLOCK) if order is None else order
    return F.transform(F.array(*map(F.lit, order)), lambda i: q[i])


def inverse_zigzag(z: Column, order: list[int] | None = None) -> Column:
    order = zigzag_order(BLOCK) if order is None else order
    check_order(order, round(len(order) ** 0.5))
    back = sorted(range(len(order)), key=order.__getitem__)
    return F.when(F.size(z) == len(order), F.array(*(z[i] for i in back))).otherwise(F.raise_error(F.lit("a scanned block has the wrong length")).cast("array<int>"))


def with_dc_before(blocks: DataFrame, column: str, key: list[str] = PLANE, target: str = "f0_before") -> DataFrame:
    """Adds the value of the block before in raster order over the whole plane, null for the first.

    The window runs within a block row; the first block of a row takes the last
    value of the row above through a join of one row a block row.  So a large
    plane is spread over its rows.
    """
    last = blocks.groupBy(*key, F.col("br")).agg(F.max_by(column, "bc").alias("bl_last")).withColumn("br", F.col("br") + 1)
    here = Window.partitionBy(*key, "br").orderBy("bc")
    return blocks.join(last, [*key, "br"], "left").withColumn(target, F.coalesce(F.lag(column).over(here), F.col("bl_last"))).drop("bl_last")


def dc_encode(blocks: DataFrame, key: list[str] = PLANE, dc: str = "dc", target: str = "dc_diff", initial: int = 0) -> DataFrame:
    """Difference to the block before, in raster order over the whole plane."""
    before = F.coalesce(F.col("bl_before"), F.lit(initial))
    return with_dc_before(blocks, dc, key, "bl_before").withColumn(target, (F.col(dc) - before).cast("int")).drop("bl_before")


def dc_decode(blocks: DataFrame, key: list[str] = PLANE, diff: str = "dc_diff", target: str = "dc", initial: int = 0) -> DataFrame:
    """Running sum in raster order: within rows, plus what the rows above sum to."""
    above = Window.partitionBy(*key).orderBy("br").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.groupBy(*key, F.col("br")).agg(F.sum(diff).alias("bl_sum")).withColumn("bl_above", F.coalesce(F.sum("bl_sum").over(above), F.lit(0))).drop("bl_sum")
    here = Window.partitionBy(*key, "br").orderBy("bc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.join(rows, [*key, "br"]).withColumn(target, (F.sum(diff).over(here) + F.col("bl_above") + initial).cast("int")).drop("bl_above")


def _symbol(kind: str, run: Column | None = None, amp: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if run is None else run).cast("int").alias("run"), (F.lit(None) if amp is None else amp).cast("int").alias("amp"))


def rle_encode(scan: Column, first: int = 1, length: int = BLOCK * BLOCK) -> Column:
    """``(zeros before, value)`` of each nonzero from place ``first`` of a scanned block on, and one EOB if zeros trail.

    Runs have no cap.  The places of nonzeros are zipped with the same places one
    later, so a block costs its length; ``scan`` should be a plain column, as it is
    looked into once a place.
    """
    at = F.filter(F.sequence(F.lit(first), F.lit(length - 1)), lambda i: scan[i] != 0)
    before = F.slice(F.concat(F.array(F.lit(first - 1)), at), F.lit(1), F.size(at))
    pairs = F.zip_with(at, before, lambda i, p: _symbol(AC, i - p - 1, scan[i]))
    return F.when(scan[length - 1] == 0, F.concat(pairs, F.array(_symbol(EOB)))).otherwise(pairs)


def rle_decode(symbols: Column, length: int = BLOCK * BLOCK - 1) -> Column:
    """Values from symbols: what follows the first EOB is ignored, a missing tail is zero.

    A pair with a negative run, or one past the end, is an error.  All blocks of
    an Arrow batch are placed at once, by a running sum over their runs.
    """

    @F.arrow_udf("array<int>")
    def place(blocks: pa.Array) -> pa.Array:
        sizes = np.diff(blocks.offsets.to_numpy())
        flat = blocks.flatten()
        is_end = np.asarray(pc.equal(flat.field("kind"), EOB))
        run, amp = (np.asarray(pc.fill_null(flat.field(k), 0)).astype(np.int64) for k in ("run", "amp"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ended = np.cumsum(is_end)
        first = np.concatenate([[0], ended])[np.cumsum(sizes) - sizes]
        pair = ended == first[owner]  # before the block's own first EOB
        step = np.where(pair, run + 1, 0)
        total = np.cumsum(step)
        at = total - np.concatenate([[0], total])[np.cumsum(sizes) - sizes][owner] - 1
        if (pair & ((run < 0) | (at >= length))).any():
            raise ValueError("run lengths pass the end of the block")
        out = np.zeros((len(sizes), length), np.int32)
        out[owner[pair], at[pair]] = amp[pair]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * length), pa.array(out.reshape(-1)))

    return place(symbols)


def encode_blocks(blocks: DataFrame, key: list[str] = PLANE, column: str = "qf", initial: int = 0) -> DataFrame:
    """Adds ``dc_diff`` and ``ac_symbols`` to quantized blocks; a block of another length is an error."""
    z = blocks.withColumn("bl_z", zigzag_scan(checked_values(F.col(column))))
    return dc_encode(z.withColumn("bl_dc", F.col("bl_z")[0]), key, "bl_dc", "dc_diff", initial).withColumn("ac_symbols", rle_encode(F.col("bl_z"))).drop("bl_z", "bl_dc")


def decode_blocks(encoded: DataFrame, key: list[str] = PLANE, target: str = "qf", initial: int = 0) -> DataFrame:
    """Adds the quantized block back from ``dc_diff`` and ``ac_symbols``."""
    d = dc_decode(encoded.withColumn("bl_ac", rle_decode(F.col("ac_symbols"))), key, "dc_diff", "bl_dc", initial)
    whole = d.withColumn("bl_z", F.concat(F.array("bl_dc"), F.col("bl_ac")))
    return whole.withColumn(target, inverse_zigzag(F.col("bl_z"))).drop("bl_dc", "bl_ac", "bl_z")


def count_kind(kind: str | None = None) -> Column:
    """Symbols of a block of one AC kind, or of both."""
    return F.size("ac_symbols") if kind is None else F.size(F.filter("ac_symbols", lambda s: s["kind"] == kind))


def rle_statistics(encoded: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Symbols (pairs and EOBs), mean a block, blocks that end in EOB."""
    n = F.sum(count_kind()).cast("long")
    return encoded.groupBy(*key).agg(n.alias("rle_symbols"), (n / F.count(F.lit(1))).alias("average_rle_symbols_per_block"), F.sum(count_kind(EOB)).cast("long").alias("eob_symbols"))


def symbol_stream(encoded: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """``key, br, bc, pos, kind, run, amp``: DC, AC pairs, EOB if any, BLOCK_END of each block."""
    every = F.concat(F.array(_symbol(DC, None, F.col("dc_diff"))), F.col("ac_symbols"), F.array(_symbol(BLOCK_END)))
    return encoded.select(*key, "br", "bc", F.posexplode(every).alias("pos", "s")).select(*key, "br", "bc", "pos", "s.kind", "s.run", "s.amp")


def blocks_from_symbols(symbols: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """``dc_diff`` and ``ac_symbols`` back from a symbol stream.

    A block must be one DC, pairs, at most one EOB after them, and BLOCK_END.
    """
    item = F.struct("pos", F.struct("kind", "run", "amp").alias("s"))
    b = symbols.groupBy(*key, "br", "bc").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias("bl_s"))
    ac = F.slice("bl_s", F.lit(2), F.size("bl_s") - 2)
    grammar = F.array_join(F.transform("bl_s", lambda s: F.substring(s["kind"], 1, 1)), "").rlike("^DA*E?B$")
    checked = F.when(grammar, ac).otherwise(F.raise_error(F.lit("symbols do not form a block")).cast(f"array<{SYMBOL}>"))
    return b.select(*key, "br", "bc", F.col("bl_s")[0]["amp"].alias("dc_diff"), checked.alias("ac_symbols"))
