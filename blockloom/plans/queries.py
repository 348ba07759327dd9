"""The registered queries of the block codec: one for each operator family, with SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import params
from blockloom.operators import coding, color, huffman, macro, metrics, preprocess, quantize, reconstruct, transform
from blockloom.plans import pipelines, sql
from blockloom.plans.sql import BLOCKS, CHAIN, query
from blockloom.sources import rasters
from blockloom.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SCALES, QUALITIES = [0.25, 0.5, 1.0, 2.0, 4.0], [20, 40, 60, 80, 95]
ONE = {"scale_1": params.LUMA}
THREE = pipelines.sweep_tables([0.5, 1.0, 4.0])
SWEEP = pipelines.sweep_tables(SCALES)
QUALITY = pipelines.sweep_tables(qualities=QUALITIES)


def add(name: str, text: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if text:
            ORACLE_SQL[name] = text
        return fn

    return keep


def rounded(c: Column | str, digits: int) -> Column:
    """To so many digits, with one zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def long(*names: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in names]


def chain(final: str, upto: str, *more: str, src: str = "gray", tables: dict | None = None, **own: str) -> str:
    """Oracle of a gray run: the parts up to ``upto``, and ``more``."""
    names = CHAIN[: CHAIN.index(upto) + 1]
    own = {"src": f"SELECT * FROM {src}", "blocks": BLOCKS} | ({"qt": sql.gray_tables(tables)} if tables else {}) | own
    first = ["rgb", "rgbgray"] if src == "rgbgray" else [src] if src in sql.PARTS else []
    return query(final, *first, *names, *more, **own)


def cells(blocks: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row a value of a packed block."""
    return blocks.select(*keep, "br", "bc", F.posexplode(column).alias("i", "value"))


def uv(a: str = "u", b: str = "v") -> list[Column]:
    return [F.floor(F.col("i") / 8).cast("long").alias(a), (F.col("i") % 8).cast("long").alias(b)]


def _quantized(spark: SparkSession, sf_dir: str, tables: dict = ONE, raster=rasters.gray_orders) -> DataFrame:
    return pipelines.quantized_sweep(pipelines.coefficients(raster(spark, sf_dir)), tables)


def _encoded(spark: SparkSession, sf_dir: str, tables: dict = ONE) -> DataFrame:
    return coding.encode_blocks(_quantized(spark, sf_dir, tables), pipelines.RUN)


def _sweep(spark: SparkSession, sf_dir: str, tables: dict) -> DataFrame:
    return pipelines.encoded_sweep(pipelines.transformed(rasters.gray_orders(spark, sf_dir)), tables)


def _stream(spark: SparkSession, sf_dir: str, tables: dict) -> DataFrame:
    """Symbols of encoded blocks that are written once, for what reads them more than once."""
    return coding.symbol_stream(written(_sweep(spark, sf_dir, tables).select(*pipelines.RUN, "br", "bc", "dc_diff", "ac_symbols"), "encoded"), pipelines.RUN)


# --- preprocessing ---------------------------------------------------------------------------


@add("gray_convert", query("SELECT r::BIGINT AS r, c::BIGINT AS c, round(v::DOUBLE, 4) + 0.0 AS v FROM rgbgray", "rgb", "rgbgray"))
def gray_convert(spark, sf_dir):
    return preprocess.rgb_to_gray(rasters.rgb_part(spark, sf_dir)).select(*long("r", "c"), rounded(F.col("v").cast("double"), 4).alias("v"))


@add("pad_edge", query("SELECT (br * 8 + x)::BIGINT AS r, (bc * 8 + y)::BIGINT AS c, v::BIGINT AS v FROM blocks", "gray", src="SELECT * FROM gray", blocks=BLOCKS))
def pad_edge(spark, sf_dir):
    return preprocess.pad_edge(rasters.gray_orders(spark, sf_dir)).select(*long("r", "c", "v"))


@add("split_blocks", query("SELECT br::BIGINT AS br, bc::BIGINT AS bc, count(*)::BIGINT AS n, sum(x * 8 + y)::BIGINT AS places, sum((x * 8 + y) * v::BIGINT)::BIGINT AS weighted FROM blocks GROUP BY br, bc", "gray", src="SELECT * FROM gray", blocks=BLOCKS))
def split_blocks(spark, sf_dir):
    """The places come from the tiles, what they weigh from the packed blocks."""
    tiles = preprocess.split_blocks(preprocess.pad_edge(rasters.gray_orders(spark, sf_dir)))
    places = tiles.groupBy("br", "bc").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") * 8 + F.col("y")).cast("long")).alias("places"))
    total = F.aggregate(F.transform("px", lambda v, i: (v * i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = preprocess.pack_blocks(tiles).select("br", "bc", total.alias("weighted"))
    return places.join(weighted, ["br", "bc"]).select(*long("br", "bc", "n", "places", "weighted"))


@add("level_shift", query("SELECT br::BIGINT AS br, bc::BIGINT AS bc, sum((v - 128)::BIGINT)::BIGINT AS total, min((v - 128)::BIGINT)::BIGINT AS low FROM blocks GROUP BY br, bc", "gray", src="SELECT * FROM gray", blocks=BLOCKS))
def level_shift(spark, sf_dir):
    b = preprocess.preprocess(rasters.gray_orders(spark, sf_dir))
    return b.select(*long("br", "bc"), F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"), F.array_min("px").cast("long").alias("low"))


@add("plane_info", """SELECT max(r) + 1 AS orig_h, 100::BIGINT AS orig_w, (max(r) + 8) // 8 * 8 AS padded_h, 104::BIGINT AS padded_w, (max(r) + 8) // 8 * 8 - max(r) - 1 AS pad_h, 4::BIGINT AS pad_w FROM (SELECT (o_orderkey // 100)::BIGINT AS r FROM orders)""")
def plane_info(spark, sf_dir):
    return preprocess.plane_info(preprocess.preprocess(rasters.gray_orders(spark, sf_dir))).select(*long("orig_h", "orig_w", "padded_h", "padded_w", "pad_h", "pad_w"))


# --- colour ----------------------------------------------------------------------------------


@add("ycbcr_forward", query("SELECT r::BIGINT AS r, c::BIGINT AS c, round(y, 6) + 0.0 AS y, round(cb, 6) + 0.0 AS cb, round(cr, 6) + 0.0 AS cr FROM ycc", "rgb", "ycc"))
def ycbcr_forward(spark, sf_dir):
    return color.rgb_to_ycbcr(rasters.rgb_part(spark, sf_dir)).select(*long("r", "c"), *(rounded(k, 6).alias(k) for k in ("y", "cb", "cr")))


def _rgb_sql(y: str, cb: str, cr: str) -> str:
    one = {"red": f"{y} + 1.402::DOUBLE * ({cr} - 128.0)", "green": f"{y} - 0.344136::DOUBLE * ({cb} - 128.0) - 0.714136::DOUBLE * ({cr} - 128.0)", "blue": f"{y} + 1.772::DOUBLE * ({cb} - 128.0)"}
    return ", ".join(f"{sql.U8.format(v)} AS {k}" for k, v in one.items())


@add("ycbcr_roundtrip", query(f"SELECT r::BIGINT AS r, c::BIGINT AS c, {_rgb_sql('y', 'cb', 'cr')} FROM ycc", "rgb", "ycc"))
def ycbcr_roundtrip(spark, sf_dir):
    planes = color.split_channels(color.rgb_to_ycbcr(rasters.rgb_part(spark, sf_dir)))
    back = color.ycbcr_to_rgb(color.merge_channels(planes))
    return back.select(*long("r", "c"), *(color.to_uint8(F.col(k)).alias(k) for k in ("red", "green", "blue")))


@add("chroma_420_down", query("SELECT ch AS channel, r::BIGINT AS r, c::BIGINT AS c, round(v, 6) + 0.0 AS v FROM small", "rgb", "ycc", "chan", "small"))
def chroma_420_down(spark, sf_dir):
    planes = color.split_channels(color.rgb_to_ycbcr(rasters.rgb_part(spark, sf_dir)))
    return color.downsample_420(planes.where("channel <> 'Y'")).select("channel", *long("r", "c"), rounded("v", 6).alias("v"))


@add("bilinear_up", query("SELECT ch AS channel, r::BIGINT AS r, c::BIGINT AS c, round(v, 6) + 0.0 AS v FROM big WHERE r < (SELECT max(r) + 1 FROM rgb) AND c < (SELECT max(c) + 1 FROM rgb)", "rgb", "ycc", "chan", "small", whole="SELECT ch, r, c, round_even(v, 0) AS v FROM small", big=sql.enlarged("whole", "2 * sh", "2 * sw")))
def bilinear_up(spark, sf_dir):
    rgb = rasters.rgb_part(spark, sf_dir)
    sizes = rgb.groupBy("image_id").agg(F.max("h").alias("orig_h"), F.max("w").alias("orig_w"))
    small = color.downsample_420(color.split_channels(color.rgb_to_ycbcr(rgb)).where("channel <> 'Y'")).withColumn("v", F.rint("v"))
    return color.upsample_420(small, sizes).select("channel", *long("r", "c"), rounded("v", 6).alias("v"))


@add("chroma_info", "SELECT h::BIGINT AS orig_h, 45::BIGINT AS orig_w, ((h + 1) // 2 * 2)::BIGINT AS padded_h, 46::BIGINT AS padded_w, ((h + 1) // 2)::BIGINT AS sub_h, 23::BIGINT AS sub_w FROM (SELECT max(p_partkey) // 45 + 1 AS h FROM part)")
def chroma_info(spark, sf_dir):
    planes = color.split_channels(color.rgb_to_ycbcr(rasters.rgb_part(spark, sf_dir)))
    return color.chroma_info(planes.where("channel = 'Cb'")).select(*long("orig_h", "orig_w", "padded_h", "padded_w", "sub_h", "sub_w"))


# --- transform -------------------------------------------------------------------------------


@add("dct_basis", query("SELECT a.k::BIGINT AS u, b.k::BIGINT AS v, a.n::BIGINT AS x, b.n::BIGINT AS y, round(a.b * b.b, 9) + 0.0 AS value, round(least(greatest(a.b * b.b, -0.25), 0.25), 9) + 0.0 AS shown FROM basis a, basis b", "basis"))
def dct_basis(spark, sf_dir):
    return transform.basis_images(spark).select(*long("u", "v", "x", "y"), rounded("value", 9).alias("value"), rounded("shown", 9).alias("shown"))


@add("dct_orthonormality", query("SELECT a.k::BIGINT AS i, c.k::BIGINT AS j, abs(round(sum(a.b * c.b), 9)) AS dot FROM basis a JOIN basis c ON a.n = c.n GROUP BY a.k, c.k", "basis"))
def dct_orthonormality(spark, sf_dir):
    b = params.basis_relation(spark)
    other = b.select(F.col("k").alias("j"), "n", F.col("b").alias("b2"))
    return b.join(F.broadcast(other), "n").groupBy(F.col("k").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.abs(F.round(F.sum(F.col("b") * F.col("b2")), 9)).alias("dot"))


_SIGNAL = "SELECT event_id // 8 AS segment, event_id % 8 AS n, value::DOUBLE AS value FROM events"


@add("dct1_events", query("SELECT segment::BIGINT AS segment, k::BIGINT AS k, round(sum(s.value * b), 6) + 0.0 AS value FROM s JOIN basis USING (n) GROUP BY segment, k", "basis", s=_SIGNAL))
def dct1_events(spark, sf_dir):
    return transform.dct_1d(rasters.signal_events(spark, sf_dir), ["segment"]).select(*long("segment", "k"), rounded("value", 6).alias("value"))


@add("idct1_events", f"SELECT segment::BIGINT AS segment, n::BIGINT AS n, round(value, 6) + 0.0 AS value FROM ({_SIGNAL}) WHERE segment < (SELECT count(*) // 8 FROM events)")
def idct1_events(spark, sf_dir):
    s = rasters.signal_events(spark, sf_dir)
    back = transform.dct_1d(transform.dct_1d(s, ["segment"]), ["segment"], inverse=True)
    return back.select(*long("segment", "n"), rounded("value", 6).alias("value"))


@add("dct2_blocks", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, u::BIGINT AS u, v::BIGINT AS v, round(f, 6) + 0.0 AS f FROM coef", "coef"))
def dct2_blocks(spark, sf_dir):
    return cells(pipelines.coefficients(rasters.gray_orders(spark, sf_dir)), "f").select(*long("br", "bc"), *uv(), rounded("value", 6).alias("f"))


@add("dct2_relational", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, u::BIGINT AS u, v::BIGINT AS v, round(f, 6) + 0.0 AS f FROM coef", "coef"))
def dct2_relational(spark, sf_dir):
    tiles = preprocess.split_blocks(preprocess.pad_edge(rasters.gray_orders(spark, sf_dir)))
    flat = tiles.select("br", "bc", "x", "y", (F.col("v") - 128.0).cast("double").alias("value"))
    return transform.dct2_relational(flat, ["br", "bc"]).select(*long("br", "bc", "u", "v"), rounded("value", 6).alias("f"))


@add("idct2_roundtrip", query("SELECT br::BIGINT AS br, bc::BIGINT AS bc, x::BIGINT AS x, y::BIGINT AS y, (v - 128)::DOUBLE AS v FROM blocks", "gray", src="SELECT * FROM gray", blocks=BLOCKS))
def idct2_roundtrip(spark, sf_dir):
    back = transform.idct2(pipelines.coefficients(rasters.gray_orders(spark, sf_dir)))
    return cells(back, "px").select(*long("br", "bc"), *uv("x", "y"), rounded("value", 6).alias("v"))


# --- quantization ----------------------------------------------------------------------------


def _table_rows(spark: SparkSession, tables: dict[str, list[float]]) -> DataFrame:
    return params.configs(spark, tables).select("config_id", F.posexplode("q").alias("i", "q")).select("config_id", *uv(), "q")


def _scaled(base: str, scales: dict[str, str]) -> str:
    values = ", ".join(f"({i // 8}, {i % 8}, {q}::DOUBLE)" for i, q in enumerate(sql.BASE[base]))
    configs = ", ".join(f"('{k}', {s}::DOUBLE)" for k, s in scales.items())
    return f"SELECT config_id, u::BIGINT AS u, v::BIGINT AS v, least(greatest(round_even(s * q, 0), 1), 255) AS q FROM (VALUES {values}) AS t(u, v, q), (VALUES {configs}) AS c(config_id, s)"


@add("q_scaled", _scaled("luma", {f"scale_{s:g}": f"{s}" for s in SCALES}))
def q_scaled(spark, sf_dir):
    return _table_rows(spark, SWEEP)


@add("q_quality", _scaled("luma", {f"quality_{q}": f"(greatest(CASE WHEN {q} < 50 THEN 5000.0::DOUBLE / {q} ELSE 200 - 2 * {q} END / 100, 0.01))" for q in QUALITIES}))
def q_quality(spark, sf_dir):
    return _table_rows(spark, QUALITY)


@add("q_color", f"{_scaled('luma', {'Y': '4.0'})} UNION ALL {_scaled('chroma', {'Cb': '4.0', 'Cr': '4.0'})}")
def q_color(spark, sf_dir):
    return _table_rows(spark, params.color_tables(4.0))


@add("quantize_scale", chain("SELECT config_id, br::BIGINT AS br, bc::BIGINT AS bc, u::BIGINT AS u, v::BIGINT AS v, qf FROM qc", "qc", tables=THREE))
def quantize_scale(spark, sf_dir):
    return cells(_quantized(spark, sf_dir, THREE), "qf", "config_id").select("config_id", *long("br", "bc"), *uv(), F.col("value").alias("qf"))


@add("dequantize", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, u::BIGINT AS u, v::BIGINT AS v, qf * q + 0.0 AS f, abs(f0 - qf * q) <= q / 2 AS close FROM (SELECT qc.*, f AS f0 FROM qc JOIN coef USING (ch, br, bc, u, v))", "qc", tables=ONE))
def dequantize(spark, sf_dir):
    b = pipelines.coefficients(rasters.gray_orders(spark, sf_dir)).withColumn("q", quantize.literal_table(params.LUMA)).withColumn("qf", quantize.quantize(F.col("f"), F.col("q")))
    one = b.withColumn("one", F.arrays_zip(F.col("f").alias("f0"), quantize.dequantize(F.col("qf"), F.col("q")).alias("f"), F.col("q").alias("q")))
    return cells(one, "one").select(*long("br", "bc"), *uv(), (F.col("value.f") + 0.0).alias("f"), (F.abs(F.col("value.f0") - F.col("value.f")) <= F.col("value.q") / 2).alias("close"))


@add("zero_percentage", chain("SELECT config_id, count(*)::BIGINT AS total_coefficients, (count(*) FILTER (qf = 0))::BIGINT AS zero_coefficients, round(100.0::DOUBLE * count(*) FILTER (qf = 0) / count(*), 6) AS zero_percentage FROM qc GROUP BY config_id", "qc", tables=SWEEP))
def zero_percentage(spark, sf_dir):
    return quantize.zero_percentage(_quantized(spark, sf_dir, SWEEP), ["config_id"]).withColumn("zero_percentage", F.round("zero_percentage", 6))


_FB = {"fb": "SELECT * FROM emb"}
_EMB = {"src": "SELECT ch, br, bc, x, y, v FROM emb", "blocks": "SELECT * FROM src"}


@add("sobel_features", query("SELECT br::BIGINT AS vec_id, round(mean, 5) AS mean, round(variance, 5) AS variance, round(gradient_energy_x, 5) AS gradient_energy_x, round(gradient_energy_y, 5) AS gradient_energy_y, round(gradient_energy, 5) AS gradient_energy, round(directionality, 6) AS directionality FROM feat", "emb", "fb", "taps", "feat", **_FB))
def sobel_features(spark, sf_dir):
    f = quantize.block_features(rasters.embedding_blocks(spark, sf_dir))
    return f.select(F.col("br").cast("long").alias("vec_id"), *(F.round(k, 6 if k == "directionality" else 5).alias(k) for k in quantize.FEATURES))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.with_scale(quantize.classify_blocks(quantize.block_features(rasters.embedding_blocks(spark, sf_dir))))


@add("block_classes", query("SELECT br::BIGINT AS vec_id, class, scale FROM scl", "emb", "fb", "taps", "feat", "cls", "scl", **_FB))
def block_classes(spark, sf_dir):
    return _classes(spark, sf_dir).select(F.col("br").cast("long").alias("vec_id"), "class", "scale")


@add("class_counts", query("SELECT count(*) FILTER (class = 0) AS smooth, count(*) FILTER (class = 1) AS edge, count(*) FILTER (class = 2) AS texture, round(100.0::DOUBLE * count(*) FILTER (class = 0) / count(*), 6) AS smooth_percentage FROM cls", "emb", "fb", "taps", "feat", "cls", **_FB))
def class_counts(spark, sf_dir):
    return quantize.class_counts(_classes(spark, sf_dir)).select("smooth", "edge", "texture", F.round("smooth_percentage", 6).alias("smooth_percentage"))


@add("adaptive_q", query("SELECT DISTINCT class, u::BIGINT AS u, v::BIGINT AS v, least(greatest(round_even(q * scale, 0), 1), 255) AS q FROM scl, qt", "emb", "fb", "taps", "feat", "cls", "scl", qt=sql.gray_tables(ONE), **_FB))
def adaptive_q(spark, sf_dir):
    kinds = _classes(spark, sf_dir).select("class", "scale").distinct().withColumn("q", quantize.adaptive_table(quantize.literal_table(params.LUMA), F.col("scale")))
    return kinds.select("class", F.posexplode("q").alias("i", "q")).select("class", *uv(), "q")


@add("quantize_adaptive", query("SELECT br::BIGINT AS vec_id, u::BIGINT AS u, v::BIGINT AS v, qf, qf * q + 0.0 AS f FROM qa", "basis", "emb", "src", "blocks", "half", "coef", "fb", "taps", "feat", "cls", "scl", "qt", "qa", qt=sql.gray_tables(ONE), **_FB, **_EMB))
def quantize_adaptive(spark, sf_dir):
    b = _classes(spark, sf_dir).withColumn("q", quantize.adaptive_table(quantize.literal_table(params.LUMA), F.col("scale")))
    b = transform.dct2(preprocess.level_shift(b)).withColumn("qf", quantize.quantize(F.col("f"), F.col("q")))
    one = b.withColumn("one", F.arrays_zip(F.col("qf").alias("qf"), quantize.dequantize(F.col("qf"), F.col("q")).alias("f")))
    return cells(one, "one").select(F.col("br").cast("long").alias("vec_id"), *uv(), F.col("value.qf").alias("qf"), (F.col("value.f") + 0.0).alias("f"))


# --- symbols ---------------------------------------------------------------------------------


@add("zigzag_order", "SELECT a.u::BIGINT AS u, b.v::BIGINT AS v, (row_number() OVER (ORDER BY a.u + b.v, CASE WHEN (a.u + b.v) % 2 = 0 THEN -a.u ELSE a.u END) - 1)::BIGINT AS z FROM range(8) a(u), range(8) b(v)")
def zigzag_order(spark, sf_dir):
    return params.zigzag_relation(spark).select(*long("u", "v", "z"))


@add("dc_delta", chain("SELECT config_id, br::BIGINT AS br, bc::BIGINT AS bc, dc_diff FROM dc", "zc", "dc", tables=THREE))
def dc_delta(spark, sf_dir):
    return _encoded(spark, sf_dir, THREE).select("config_id", *long("br", "bc"), "dc_diff")


@add("dc_prefix", chain("SELECT config_id, br::BIGINT AS br, bc::BIGINT AS bc, dc FROM dc", "zc", "dc", tables=THREE))
def dc_prefix(spark, sf_dir):
    return coding.dc_decode(_encoded(spark, sf_dir, THREE), pipelines.RUN).select("config_id", *long("br", "bc"), "dc")


@add("rle_symbols", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, pos, kind, run, amp FROM sym WHERE kind IN ('AC', 'EOB')", "zc", "dc", "ac", "last", "sym", tables=ONE))
def rle_symbols(spark, sf_dir):
    stream = coding.symbol_stream(_encoded(spark, sf_dir), pipelines.RUN).where(F.col("kind").isin("AC", "EOB"))
    return stream.select(*long("br", "bc"), "pos", "kind", "run", "amp")


@add("rle_decode", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, u::BIGINT AS u, v::BIGINT AS v, qf FROM qc", "qc", tables=ONE))
def rle_decode(spark, sf_dir):
    back = coding.decode_blocks(_encoded(spark, sf_dir).drop("qf"), pipelines.RUN)
    return cells(back, "qf").select(*long("br", "bc"), *uv(), F.col("value").alias("qf"))


@add("rle_stats", chain("SELECT config_id, rle_symbols, eob_symbols, round(average_rle_symbols_per_block, 6) AS average_rle_symbols_per_block FROM bits", "zc", "bits", tables=THREE))
def rle_stats(spark, sf_dir):
    return coding.rle_statistics(_sweep(spark, sf_dir, THREE), ["config_id"]).select("config_id", "rle_symbols", "eob_symbols", F.round("average_rle_symbols_per_block", 6).alias("average_rle_symbols_per_block"))


_SYM = ["dc", "ac", "last", "sym"]
_STREAM = chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, pos, kind, run, amp FROM sym", "zc", *_SYM, tables=ONE)


@add("symbol_stream", _STREAM)
def symbol_stream(spark, sf_dir):
    return coding.symbol_stream(_encoded(spark, sf_dir), pipelines.RUN).select(*long("br", "bc"), "pos", "kind", "run", "amp")


@add("blocks_from_symbols", chain("SELECT br::BIGINT AS br, bc::BIGINT AS bc, (max(amp) FILTER (kind = 'DC'))::INT AS dc_diff, (count(*) FILTER (kind IN ('AC', 'EOB')))::BIGINT AS symbols, coalesce(sum(run), 0)::BIGINT AS zeros FROM sym GROUP BY br, bc", "zc", *_SYM, tables=ONE))
def blocks_from_symbols(spark, sf_dir):
    back = coding.blocks_from_symbols(coding.symbol_stream(_encoded(spark, sf_dir), pipelines.RUN), pipelines.RUN)
    zeros = F.aggregate("ac_symbols", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["run"], F.lit(0)))
    return back.select(*long("br", "bc"), "dc_diff", F.size("ac_symbols").cast("long").alias("symbols"), zeros.alias("zeros"))


@add("symbol_freq", chain("SELECT config_id, kind, run, amp, n FROM freq", "zc", *_SYM, "freq", tables=THREE))
def symbol_freq(spark, sf_dir):
    return huffman.frequencies(coding.symbol_stream(_sweep(spark, sf_dir, THREE), pipelines.RUN), pipelines.RUN).select("config_id", "kind", "run", "amp", "n")


@add("entropy", chain("SELECT config_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT config_id, n::DOUBLE / sum(n) OVER (PARTITION BY config_id) AS p FROM freq) GROUP BY config_id", "zc", *_SYM, "freq", tables=THREE))
def entropy(spark, sf_dir):
    freq = huffman.frequencies(coding.symbol_stream(_sweep(spark, sf_dir, THREE), pipelines.RUN), pipelines.RUN)
    return huffman.entropy(freq, ["config_id"]).withColumn("entropy", F.round("entropy", 6))


def _statistics(encoded: DataFrame, key: list[str]) -> DataFrame:
    freq = written(huffman.frequencies(coding.symbol_stream(encoded, key), key), "frequencies")
    return huffman.statistics(huffman.codebook(freq, key), huffman.entropy(freq, key), key)


@add("huffman_bits")
def huffman_bits(spark, sf_dir):
    return _statistics(_sweep(spark, sf_dir, THREE), pipelines.RUN)


_NO_HEAP = "sum(n)::BIGINT AS symbol_count, count(*)::BIGINT AS alphabet_size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, (sum(n) * ceil(log2(count(*))))::BIGINT AS fixed_length_bits FROM freq"


def _no_heap(statistics: DataFrame, key: str) -> DataFrame:
    """What the heap has no part in, and whether the mean code keeps to its bounds."""
    mean = F.col("average_code_length")
    bounds = (F.col("entropy") <= mean) & (mean < F.col("entropy") + 1) & (F.col("bit_count") <= F.col("fixed_length_bits"))
    return statistics.select(key, *long("symbol_count", "alphabet_size"), F.round("entropy", 6).alias("entropy"), *long("fixed_length_bits"), bounds.alias("in_bounds"))


@add("huffman_counts", chain(f"SELECT config_id, true AS in_bounds, {_NO_HEAP} GROUP BY config_id", "zc", *_SYM, "freq", tables=THREE))
def huffman_counts(spark, sf_dir):
    return _no_heap(huffman_bits(spark, sf_dir), "config_id")


@add("huffman_roundtrip", _STREAM)
def huffman_roundtrip(spark, sf_dir):
    stream = _stream(spark, sf_dir, ONE)
    book = written(huffman.codebook(huffman.frequencies(stream, pipelines.RUN), pipelines.RUN), "codebook")
    back = huffman.decode(huffman.encode(stream, book, pipelines.RUN), book, pipelines.RUN)
    return back.select(*long("br", "bc"), F.posexplode("symbols").alias("pos", "s")).select("br", "bc", "pos", "s.kind", "s.run", "s.amp")


# --- reconstruction, figures, whole runs -----------------------------------------------------


@add("reconstruct_gray", chain("SELECT r::BIGINT AS r, c::BIGINT AS c, v FROM image", "qc", "ihalf", "back", "image", src="rgbgray", tables=ONE))
def reconstruct_gray(spark, sf_dir):
    back = reconstruct.from_quantized(_quantized(spark, sf_dir, ONE, rasters.rgb_part), pipelines.RUN)
    return back.select(*long("r", "c"), "v")


_QUALITY = "round(mse, 6) AS mse, round(mae, 6) AS mae, round(10 * log10(65025.0 / mse), 6) AS psnr"
_COMPRESSION = """total_coefficients, zero_coefficients, nonzero_coefficients, round(100.0::DOUBLE * zero_coefficients / total_coefficients, 6) AS zero_percentage, rle_symbols, round(average_rle_symbols_per_block, 6) AS average_rle_symbols_per_block,
  ob AS original_bits, compressed_bits, round(ob::DOUBLE / compressed_bits, 6) AS compression_ratio, round((1 - compressed_bits::DOUBLE / ob) * 100, 6) AS reduction_percentage"""
_OB = "(SELECT ((max(r) + 1) * (max(c) + 1) * 8)::BIGINT AS ob FROM src)"


@add("quality_metrics", chain(f"SELECT config_id, {_QUALITY} FROM err", "qc", "ihalf", "back", "image", "err", src="rgbgray", tables=THREE))
def quality_metrics(spark, sf_dir):
    gray = preprocess.rgb_to_gray(rasters.rgb_part(spark, sf_dir))
    back = reconstruct.from_quantized(_quantized(spark, sf_dir, THREE, rasters.rgb_part), pipelines.RUN)
    q = metrics.quality(gray, back, pipelines.RUN)
    return q.select("config_id", *(F.round(k, 6).alias(k) for k in ("mse", "mae", "psnr")))


_RATIOS = ("zero_percentage", "average_rle_symbols_per_block", "compression_ratio", "reduction_percentage")
_COUNTS = ("total_coefficients", "zero_coefficients", "nonzero_coefficients", "rle_symbols", "original_bits", "compressed_bits")


@add("compression_metrics", chain(f"SELECT config_id, {_COMPRESSION} FROM bits, {_OB}", "zc", "bits", tables=THREE))
def compression_metrics(spark, sf_dir):
    c = metrics.compression(_sweep(spark, sf_dir, THREE), ["config_id"])
    return c.select("config_id", *_COUNTS, *(F.round(k, 6).alias(k) for k in _RATIOS))


@add("bits_nonzero", chain("SELECT config_id, (16 * count(*) FILTER (qf <> 0))::BIGINT AS nonzero_bits FROM qc GROUP BY config_id", "qc", tables=THREE))
def bits_nonzero(spark, sf_dir):
    return metrics.coefficient_bits(_quantized(spark, sf_dir, THREE), ["config_id"])


_RUN_SQL = f"""SELECT config_id, h::BIGINT AS original_height, w::BIGINT AS original_width, ((h + 7) // 8 * 8)::BIGINT AS padded_height, ((w + 7) // 8 * 8)::BIGINT AS padded_width, ((h + 7) // 8)::BIGINT AS num_blocks_vertical, ((w + 7) // 8)::BIGINT AS num_blocks_horizontal, {_QUALITY}, {_COMPRESSION}
  FROM err JOIN bits USING (config_id, ch), {_OB}, (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM src)"""
_SHAPE = ("original_height", "original_width", "padded_height", "padded_width", "num_blocks_vertical", "num_blocks_horizontal")


def _run(spark: SparkSession, sf_dir: str, tables: dict, raster) -> DataFrame:
    r = pipelines.run_gray(raster(spark, sf_dir), tables)
    return r.select("config_id", *long(*_SHAPE), *(F.round(k, 6).alias(k) for k in ("mse", "mae", "psnr", *_RATIOS)), *_COUNTS)


_BACK = ["ihalf", "back", "image", "err", "bits"]


@add("run_gray", chain(_RUN_SQL, "zc", *_BACK, src="rgbgray", tables=ONE))
def run_gray(spark, sf_dir):
    return _run(spark, sf_dir, ONE, rasters.rgb_part)


@add("scale_sweep", chain(_RUN_SQL, "zc", *_BACK, tables=SWEEP))
def scale_sweep(spark, sf_dir):
    return _run(spark, sf_dir, SWEEP, rasters.gray_orders)


@add("quality_sweep", chain(_RUN_SQL, "zc", *_BACK, src="rgbgray", tables=QUALITY))
def quality_sweep(spark, sf_dir):
    return _run(spark, sf_dir, QUALITY, rasters.rgb_part)


@add("plot_points", chain(f"SELECT config_id, round(10 * log10(65025.0 / mse), 6) AS psnr, round(ob::DOUBLE / compressed_bits, 6) AS compression_ratio, round(100.0::DOUBLE * zero_coefficients / total_coefficients, 6) AS zero_percentage FROM err JOIN bits USING (config_id, ch), {_OB}", "zc", *_BACK, src="rgbgray", tables=SWEEP))
def plot_points(spark, sf_dir):
    return _run(spark, sf_dir, SWEEP, rasters.rgb_part).select("config_id", "psnr", "compression_ratio", "zero_percentage")


_COLOR_OWN = {"src": "SELECT * FROM planes", "blocks": BLOCKS, "fb": "SELECT * FROM blocks WHERE ch = 'Y'", "qt": sql.COLOR_TABLES[4.0], "qc": "SELECT config_id, ch, br, bc, u, v, qf, q FROM qa",
              "whole": "SELECT ch, r, c, v::DOUBLE AS v FROM image WHERE ch <> 'Y'", "big": sql.enlarged("whole", "2 * sh", "2 * sw"), "yy": "SELECT r, c, v::DOUBLE AS v FROM image WHERE ch = 'Y'"}
_COLOR_PARTS = ["rgb", "ycc", "chan", "small", "planes", "basis", "src", "blocks", "half", "coef", "qt", "fb", "taps", "feat", "cls", "scl", "qa", "qc", "ihalf", "back", "image", "whole", "big", "yy"]


@add("color_pipeline", query(f"SELECT y.r::BIGINT AS r, y.c::BIGINT AS c, {_rgb_sql('y.v', 'b.v', 'd.v')} FROM yy y JOIN big b ON b.r = y.r AND b.c = y.c AND b.ch = 'Cb' JOIN big d ON d.r = y.r AND d.c = y.c AND d.ch = 'Cr'", *_COLOR_PARTS, **_COLOR_OWN))
def color_pipeline(spark, sf_dir):
    return pipelines.run_color(rasters.rgb_part(spark, sf_dir)).select(*long("r", "c"), "red", "green", "blue")


@add("color_plain", query(f"SELECT y.r::BIGINT AS r, y.c::BIGINT AS c, {_rgb_sql('y.v', 'b.v', 'd.v')} FROM yy y JOIN big b ON b.r = y.r AND b.c = y.c AND b.ch = 'Cb' JOIN big d ON d.r = y.r AND d.c = y.c AND d.ch = 'Cr'",
     *(p for p in _COLOR_PARTS if p not in ("fb", "taps", "feat", "cls", "scl", "qa")), **{k: v for k, v in _COLOR_OWN.items() if k not in ("fb", "qc", "qt")}, qc="SELECT config_id, ch, br, bc, u, v, round_even(f / q, 0)::INT AS qf, q FROM coef JOIN qt USING (ch, u, v)", qt=sql.color_rows(2.0, 0.5)))
def color_plain(spark, sf_dir):
    """Y by one table, chroma by a scale of its own."""
    return pipelines.run_color(rasters.rgb_part(spark, sf_dir), 2.0, False, 0.5).select(*long("r", "c"), "red", "green", "blue")


def _color_encoded(spark, sf_dir) -> DataFrame:
    blocks = written(macro.color_blocks(rasters.rgb_part(spark, sf_dir)), "blocks")
    quantized = written(pipelines.color_quantized(blocks, 4.0), "quantized")
    return coding.encode_blocks(quantized)


@add("color_huffman")
def color_huffman(spark, sf_dir):
    return _statistics(_color_encoded(spark, sf_dir), preprocess.PLANE)


@add("color_huffman_counts", query(f"SELECT ch AS channel, true AS in_bounds, {_NO_HEAP} GROUP BY ch", *_COLOR_PARTS[: _COLOR_PARTS.index("ihalf")], "zz", "zc", *_SYM, "freq", **{k: v for k, v in _COLOR_OWN.items() if k not in ("whole", "big", "yy")}))
def color_huffman_counts(spark, sf_dir):
    return _no_heap(color_huffman(spark, sf_dir), "channel")


@add("bilinear_resize", query("SELECT ch AS channel, r::BIGINT AS r, c::BIGINT AS c, round(v, 6) + 0.0 AS v FROM big", "rgb", "ycc", "chan", "small", big=sql.resized("small", 31, 50)))
def bilinear_resize(spark, sf_dir):
    """To a fixed size: other factors than two, up one way and down the other."""
    small = color.downsample_420(color.split_channels(color.rgb_to_ycbcr(rasters.rgb_part(spark, sf_dir))).where("channel <> 'Y'"))
    return color.resize_bilinear(small, F.lit(31), F.lit(50)).select("channel", *long("r", "c"), rounded("v", 6).alias("v"))
