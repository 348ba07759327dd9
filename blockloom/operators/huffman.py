"""Entropy coding of symbol streams: frequencies, codebook, bits, and back."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.params import require
from blockloom.operators.coding import SYMBOL
from blockloom.operators.preprocess import PLANE

NAME = ["kind", "run", "amp"]


def frequencies(symbols: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Count of each symbol and where it first stands; counted before the shuffle.

    ``first`` is block row, block column (28 bits) and position (7 bits) in one number, so that
    the aggregate can be hashed.
    """
    place = (F.col("br").cast("long") * (1 << 28) + F.col("bc")) * (1 << 7) + F.col("pos")
    return symbols.groupBy(*key, *NAME).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def entropy(freq: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Bits a symbol, from one pass: log2(N) - sum(n log2 n) / N."""
    n = F.sum("n")
    return freq.groupBy(*key).agg((F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"))


def huffman_codes(counts: list[int]) -> list[str]:
    """Codes for counts in order of first appearance.

    Ties go to the older node (leaves by appearance, then merges in turn); the
    first of two merged nodes gets 0.  One symbol alone gets "0".
    """
    require(bool(counts) and all(isinstance(n, int) and n > 0 for n in counts), "counts must be positive integers")
    if len(counts) == 1:
        return ["0"]
    heap = [(n, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, str]] = {}
    for node in range(len(counts), 2 * len(counts) - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right] = (node, "0"), (node, "1")
        heapq.heappush(heap, (a + b, node))
    codes = {2 * len(counts) - 2: ""}
    for node in range(2 * len(counts) - 3, -1, -1):  # parents come after their children
        up, bit = parent[node]
        codes[node] = codes[up] + bit
    return [codes[i] for i in range(len(counts))]


def codebook(freq: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """``key, kind, run, amp, n, code``.  A group is one plane's alphabet, not its stream."""
    fields = {f.name: f.dataType.simpleString() for f in freq.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*key, *NAME, "n"]) + ", code string"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        pdf["code"] = huffman_codes([int(n) for n in pdf["n"]])
        return pdf[[*key, *NAME, "n", "code"]]

    return freq.groupBy(*key).applyInPandas(build, schema)


def check_codebook(book: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Codes that are empty, not binary, or a prefix of another; empty if the book is sound.

    In sorted order a prefix stands right before a code that it starts, so one
    neighbour is enough.
    """
    from pyspark.sql import Window

    after = F.lead("code").over(Window.partitionBy(*key).orderBy("code"))
    return book.withColumn("bl_next", after).where(~F.col("code").rlike("^[01]+$") | F.coalesce(F.col("bl_next").startswith(F.col("code")), F.lit(False))).drop("bl_next")


def statistics(book: DataFrame, freq_entropy: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """Bits, mean length, entropy and the fixed-length comparison; no bit is written for it."""
    n, bits = F.sum("n"), F.sum(F.col("n") * F.length("code"))
    one = book.groupBy(*key).agg(n.alias("symbol_count"), F.count(F.lit(1)).alias("alphabet_size"), bits.alias("bit_count"))
    width = F.when(F.col("alphabet_size") <= 1, 1).otherwise(F.ceil(F.log2(F.col("alphabet_size").cast("double")))).cast("long")
    full = one.join(freq_entropy, key).withColumn("fixed_length_bits", F.col("symbol_count") * width)
    return full.select(*key, "symbol_count", "alphabet_size", "bit_count", (F.col("bit_count") / F.col("symbol_count")).alias("average_code_length"), "entropy", "fixed_length_bits", (F.col("fixed_length_bits") / F.col("bit_count")).alias("compression_gain_vs_fixed"))


def encode(symbols: DataFrame, book: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """``key, br, bc, bits``: each block's bits.  A symbol without a code is an error.

    Bits stay cut by block, so a plane of any size is never one value, and decoding is parallel.
    """
    codes = book.select(*key, *(F.col(c).alias(f"bl_{c}") for c in NAME), "code")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key] + [F.col(f"s.{c}").eqNullSafe(F.col(f"b.bl_{c}")) for c in NAME]
    known = F.when(F.col("code").isNull(), F.raise_error(F.lit("a symbol has no code")).cast("string")).otherwise(F.col("code"))
    joined = symbols.alias("s").join(codes.alias("b"), same, "left").select("s.*", known.alias("code"))
    return joined.groupBy(*key, "br", "bc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("bits"))


def bitstream(bits: DataFrame, key: list[str] = PLANE) -> DataFrame:
    """The blocks' bits joined in raster order to one string a plane, for planes that fit in one value."""
    return bits.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("br", "bc", "bits"))), lambda x: x["bits"]), "").alias("bitstream"))


def decode_bits(bits: str, codes: dict[str, tuple]) -> list[tuple]:
    """Symbols of a bit string; a rest that is no code, or another sign than 0 and 1, is an error."""
    out, start, longest = [], 0, max(map(len, codes))
    for end in range(1, len(bits) + 1):
        symbol = codes.get(bits[start:end])
        if symbol is not None:
            out.append(symbol)
            start = end
        elif end - start > longest:
            break
    require(bool(bits) and start == len(bits), "the bits do not end with a whole code")
    return out


#: Blocks on a side of the square that is decoded together.
_SQUARE = 32


def code_table(codes: list[str], symbols: list[tuple]) -> dict[str, tuple]:
    """Symbols by code.  Codes must be bits, and none may start another."""
    ordered = sorted(codes)
    require(bool(codes) and all(c and not c.strip("01") for c in codes), "codes must be made of 0 and 1")
    require(not any(b.startswith(a) for a, b in itertools.pairwise(ordered)), "a code starts another one")
    return dict(zip(codes, symbols, strict=True))


def decode(bits: DataFrame, book: DataFrame, key: list[str] = PLANE, column: str = "bits") -> DataFrame:
    """Adds ``symbols`` to rows of bits (blocks, or whole bitstreams).

    Blocks meet their plane's book square by square, so a book is sent once a square and
    not with every row.  An unsound book, bits that don't end with a whole code, and a plane
    without a book are errors.
    """
    square = F.xxhash64(F.floor(F.col("br") / _SQUARE), F.floor(F.col("bc") / _SQUARE)) if "br" in bits.columns else F.lit(0).cast("long")
    dealt = bits.withColumn("bl_square", square)
    books = dealt.select(*key, "bl_square").distinct().join(book.select(*key, *NAME, "code"), key)
    books = books.select(*(F.col(c).alias(f"bl_{i}") for i, c in enumerate([*key, "bl_square"])), *NAME, "code")
    names, at = [*bits.columns], len(bits.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bits.schema) + f", symbols array<{SYMBOL}>"

    def walk(blocks: pa.Table, codes: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return blocks.select(names).append_column("symbols", pa.array([], kind))
        require(codes.num_rows > 0, "a plane has no codebook")
        table = code_table(codes.column("code").to_pylist(), list(zip(*(codes.column(c).to_pylist() for c in NAME), strict=True)))
        found = [decode_bits(b, table) for b in blocks.column(column).to_pylist()]
        flat = list(zip(*itertools.chain.from_iterable(found), strict=True))
        parts = [pa.array(x, t) for x, t in zip(flat, (pa.string(), pa.int32(), pa.int32()), strict=True)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        symbols = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=NAME))
        return blocks.select(names).add_column(at, "symbols", symbols)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("run", pa.int32()), ("amp", pa.int32())]))
    return dealt.groupBy(*key, "bl_square").cogroup(books.groupBy(*(f"bl_{i}" for i in range(len(key) + 1)))).applyInArrow(walk, schema)


def fixed_width(alphabet: int) -> int:
    return 1 if alphabet <= 1 else math.ceil(math.log2(alphabet))
