"""Operators against plain NumPy, and their properties and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import params
from blockloom.operators import coding, color, huffman, macro, metrics, preprocess, quantize, reconstruct, transform
from blockloom.plans import pipelines

PIX = "image_id string, channel string, r int, c int, v float, h int, w int"


def pixels(spark, a, image="i", channel="gray"):
    h, w = a.shape
    return spark.createDataFrame([(image, channel, r, c, float(a[r, c]), h, w) for r in range(h) for c in range(w)], PIX)


def plane(rows, h, w, column="v"):
    out = np.full((h, w), np.nan)
    for r in rows:
        out[r.r, r.c] = r[column]
    return out


def tiles(a, n=8):
    h, w = a.shape
    p = np.pad(a, ((0, -h % n), (0, -w % n)), mode="edge")
    return p.reshape(p.shape[0] // n, n, -1, n).swapaxes(1, 2)


def blocks(spark, t, column="qf", kind="int"):
    rows = [("i", "gray", t.shape[0] * 8, t.shape[1] * 8, b, c, [x.item() for x in t[b, c].ravel()]) for b in range(t.shape[0]) for c in range(t.shape[1])]
    return spark.createDataFrame(rows, f"image_id string, channel string, h int, w int, br int, bc int, {column} array<{kind}>")


def sparse(seed=0, shape=(3, 4, 8, 8)):
    r = np.random.default_rng(seed)
    return np.where(r.random(shape) < 0.85, 0, r.integers(-5, 6, shape)).astype(np.int32)


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (9, 8), (7, 17)])
def test_padding_and_tiling(spark, shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.float32)
    got = preprocess.preprocess(pixels(spark, a)).collect()
    want = tiles(a) - 128
    assert len(got) == want.shape[0] * want.shape[1]
    for b in got:
        assert b.px == want[b.br, b.bc].ravel().tolist()
    df = preprocess.preprocess(pixels(spark, a))
    assert preprocess.missing_blocks(df).count() == 0
    info = preprocess.plane_info(df).first()
    assert (info.pad_h, info.pad_w) == params.padding(*shape) == (-shape[0] % 8, -shape[1] % 8)


def test_missing_block_is_found(spark):
    df = preprocess.preprocess(pixels(spark, np.zeros((16, 16), np.float32)))
    assert preprocess.missing_blocks(df.where("bc = 0 or br = 0")).count() == 1


def test_wrong_shapes_are_errors(spark):
    a = np.zeros((9, 17), np.float32)
    px = pixels(spark, a)
    good = preprocess.pack_blocks(preprocess.split_blocks(preprocess.pad_edge(px)))
    assert preprocess.check_info(preprocess.plane_info(good)).count() == 0
    for change in ({"padded_h": 17}, {"pad_w": 8}, {"orig_h": 0}, {"block_size": 0}, {"padded_w": 32}):
        assert preprocess.check_info(preprocess.plane_info(good).withColumns({k: F.lit(v) for k, v in change.items()})).count() == 1, change
    assert preprocess.bad_planes(px).count() == 0
    bad = px.where("r > 0"), px.unionByName(px.limit(1)), px.withColumn("v", F.when(F.col("r") == 0, float("nan")).otherwise(F.col("v"))), px.withColumn("v", F.nullif(F.col("r"), F.lit(3))), px.withColumn("r", F.col("r") + 1)
    assert all(preprocess.bad_planes(x).count() == 1 for x in bad)
    short = good.withColumn("px", F.when(F.col("bc") == 1, F.slice("px", 1, 63)).when(F.col("bc") == 2, F.concat("px", F.array(F.lit(0.0)))).otherwise(F.col("px")))
    with pytest.raises(Exception, match="must hold 64 values"):  # 63 and 65 would else make up two blocks
        transform.dct2(short.where("bc > 0")).collect()
    with pytest.raises(Exception, match="must hold 64 values"):
        preprocess.checked_blocks(short).collect()
    for hole in (F.lit(None).cast("array<float>"), F.transform("px", lambda x: F.nullif(x, x))):
        with pytest.raises(Exception, match="must hold 64 values"):
            transform.idct2(good.withColumn("f", hole)).collect()
    with pytest.raises(Exception, match="must hold 64 values"):
        coding.encode_blocks(blocks(spark, sparse()).withColumn("qf", F.slice("qf", 1, 60))).collect()
    encoded = coding.encode_blocks(blocks(spark, sparse()))
    with pytest.raises(Exception, match="each of its blocks once"):
        metrics.compression(encoded.where("bc > 0")).collect()


def test_a_y_block_without_a_class_is_an_error(spark, monkeypatch):
    real = pipelines.classify_blocks
    monkeypatch.setattr(pipelines, "classify_blocks", lambda f: real(f).withColumn("class", F.when(F.col("br") > 0, F.col("class"))))
    a = np.random.default_rng(1).integers(0, 256, (20, 20, 3))
    with pytest.raises(Exception, match="class"):
        pipelines.color_quantized(macro.color_blocks(rgb(spark, a))).collect()


@pytest.mark.parametrize("shape", [(1, 1), (16, 16), (17, 33), (31, 8), (9, 50)])
def test_squares_equal_the_pixel_operators(spark, shape):
    a = np.random.default_rng(sum(shape)).integers(0, 256, (*shape, 3))
    px = rgb(spark, a).unionByName(rgb(spark, a[:1, :1]).withColumn("image_id", F.lit("j")))
    planes = pipelines.color_planes(px)
    want = preprocess.pack_blocks(preprocess.split_blocks(preprocess.pad_edge(planes)))

    def rows(df):
        return sorted((r.image_id, r.channel, r.br, r.bc, r.h, r.w, tuple(r.px)) for r in df.collect())

    tiled = macro.color_blocks(px)
    assert rows(tiled) == rows(want)
    whole = tiled.withColumn("px", F.transform("px", color.to_uint8))
    back = reconstruct.crop(reconstruct.merge_blocks(whole)).withColumn("v", F.col("v").cast("double"))
    sizes = px.groupBy("image_id").agg(F.max("h").alias("orig_h"), F.max("w").alias("orig_w"))

    def image(df):
        return sorted(tuple(r[c] for c in ("image_id", "r", "c", "h", "w", "red", "green", "blue")) for r in df.collect())

    assert image(macro.color_pixels(whole)) == image(pipelines.color_restored(back, sizes))
    with pytest.raises(Exception, match="differ in shape"):
        macro.color_pixels(whole.where("not (channel = 'Cr' and br = 0)")).collect()
    if sum(shape) > 2:
        with pytest.raises(Exception, match="each of its pixels once"):
            macro.color_blocks(px.where("not (image_id = 'i' and r = 0 and c = 0)")).collect()


def test_chroma_info_of_both_channels(spark):
    planes = color.split_channels(color.rgb_to_ycbcr(rgb(spark, np.zeros((5, 6, 3), int)))).where("channel <> 'Y'")
    info = color.chroma_info(planes)
    assert color.check_same_info(info).count() == 0
    for bad in (info.where("channel = 'Cb'"), info.unionByName(info), info.withColumn("sub_h", F.lit(2)), info.withColumn("orig_w", F.when(F.col("channel") == "Cr", 5).otherwise(F.col("orig_w"))), info.withColumn("mode", F.lit("4:4:4"))):
        assert color.check_same_info(bad).count() == 1


def test_dct_matrix_and_round_trips(spark):
    c = params.dct_matrix()
    assert params.is_orthonormal(c) and not params.is_orthonormal(c * 1.001) and not params.is_orthonormal(c[:4])
    x = np.random.default_rng(0).integers(-128, 128, (4, 5, 8, 8)).astype(np.float32)
    f = transform.dct2(blocks(spark, x, "px", "float"))
    for b in f.collect():
        assert np.allclose(np.reshape(b.f, (8, 8)), c @ x[b.br, b.bc] @ c.T, atol=1e-8)
    for b in transform.idct2(f).collect():
        assert abs(np.reshape(b.px, (8, 8)) - x[b.br, b.bc]).max() < 1e-8
    with pytest.raises(ValueError):
        params.alpha(8, 8)


def test_flat_levels_round_exactly(spark):
    """DC is 8 m; at a step of 16 every odd m is a tie and must go to the even side."""
    x = np.broadcast_to(np.arange(256)[:, None, None, None] - 128.0, (256, 1, 8, 8))
    q = transform.dct2(blocks(spark, x, "px", "double")).withColumn("qf", quantize.quantize(F.col("f"), quantize.literal_table(params.LUMA)))
    for b in q.collect():
        assert b.qf == [int(np.rint((b.br - 128) / 2)), *[0] * 63]


@pytest.mark.parametrize(("quality", "scale"), [(1, 50), (49, 5000 / 4900), (50, 1), (80, 0.4), (99, 0.02), (100, 0.01)])
def test_quality_scale(quality, scale):
    assert params.quality_to_scale(quality) == pytest.approx(scale)


def test_tables():
    assert params.quality_table(100) == [1.0] * 64 and set(params.scale_table(params.LUMA, 100)) == {255.0} and set(params.scale_table(params.LUMA, 0.001)) == {1.0}
    t = params.color_tables(2.0, 1.0)
    assert t["Cb"] == t["Cr"] == params.scale_table(params.CHROMA) and t["Y"][0] == 32
    assert params.scale_table([11.0] * 4, 1.5) == [16.0] * 4
    for bad in (0, 101):
        with pytest.raises(ValueError):
            params.quality_to_scale(bad)
    for bad in ("80", 80.0, True):
        with pytest.raises(TypeError):
            params.quality_to_scale(bad)
    for args in ((params.LUMA, 0), (params.LUMA, 1, 0), (params.LUMA, 1, 9, 3), ([1.0, 2.0], 1), ([0.0] * 4, 1)):
        with pytest.raises(ValueError):
            params.scale_table(*args)
    assert params.parse_numbers(" 1, 2.5,, ") == [1.0, 2.5] and params.parse_numbers("3,4", int) == [3, 4]
    with pytest.raises(ValueError):
        params.parse_numbers(" , ")


def test_quantization_error_is_half_a_step(spark):
    f = np.random.default_rng(0).normal(0, 80, (4, 5, 8, 8))
    q = params.quality_table(80)
    b = blocks(spark, f, "f", "double").withColumn("qf", quantize.quantize(F.col("f"), quantize.literal_table(q))).withColumn("back", quantize.dequantize(F.col("qf"), quantize.literal_table(q)))
    for r in b.collect():
        assert r.qf == np.rint(np.array(r.f) / q).astype(int).tolist()
        assert (abs(np.array(r.f) - r.back) <= np.array(q) / 2 + 1e-9).all()


def test_features_and_classes(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(0, 1, (5, 6, 8, 8)) * rng.uniform(0, 60, (5, 6, 1, 1)) + np.arange(8) * rng.uniform(-9, 9, (5, 6, 1, 1))).astype(np.float32)
    feats = {}
    for i in np.ndindex(5, 6):
        b = x[i].astype(float)
        p = np.pad(b, 1, mode="edge")
        kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
        conv = lambda k: np.array([[(p[r : r + 3, c : c + 3] * k[::-1, ::-1]).sum() for c in range(8)] for r in range(8)])
        ex, ey = (conv(kx) ** 2).mean(), (conv(kx.T) ** 2).mean()
        feats[i] = (b.mean(), b.var(), ex, ey, ex + ey, abs(ex - ey) / (ex + ey + 1e-12))
    tv, tg = np.percentile([f[1] for f in feats.values()], 35), np.percentile([f[4] for f in feats.values()], 55)
    got = quantize.with_scale(quantize.classify_blocks(quantize.block_features(blocks(spark, x, "px", "float")))).collect()
    for r in got:
        f = feats[r.br, r.bc]
        assert np.allclose([r[k] for k in quantize.FEATURES], f, atol=1e-6)
        want = 0 if f[1] <= tv + 1e-9 and f[4] <= tg + 1e-9 else 1 if f[4] > tg and f[5] >= 0.35 else 2
        assert r["class"] == want and r.scale == params.CLASS_SCALES[want]
    counts = quantize.class_counts(spark.createDataFrame([("i", "Y", 0), ("i", "Y", 0), ("i", "Y", 2)], "image_id string, channel string, class int")).first()
    assert (counts.smooth, counts.edge, counts.texture) == (2, 0, 1)
    with pytest.raises(ValueError):
        quantize.classify_blocks(None, directionality_threshold=2)
    with pytest.raises(Exception, match="unknown block class"):
        quantize.with_scale(spark.createDataFrame([(7,)], "class int")).collect()


def test_adaptive_table_rounds_twice(spark):
    row = spark.range(1).select(quantize.adaptive_table(quantize.literal_table([11.0, 13.0, 200.0, 1.0]), F.lit(1.5)).alias("q")).first()
    assert row.q == [16.0, 20.0, 255.0, 2.0]


def walk_rle(ac):
    out, zeros = [], 0
    for x in ac:
        if x:
            out.append(("AC", zeros, int(x)))
            zeros = 0
        else:
            zeros += 1
    return out + ([("EOB", None, None)] if zeros or not len(ac) else [])


def test_symbols_round_trip(spark):
    t = sparse()
    t[0, 0] = 0
    t[0, 1].flat[:] = 0
    t[0, 1, 7, 7] = 3
    order = params.zigzag_order()
    enc = coding.encode_blocks(blocks(spark, t), initial=5)
    rows = {(r.br, r.bc): r for r in enc.collect()}
    before = 5
    for i in np.ndindex(t.shape[:2]):
        z = t[i].ravel()[order]
        assert [tuple(s) for s in rows[i].ac_symbols] == walk_rle(z[1:]) and rows[i].dc_diff == z[0] - before
        before = z[0]
    assert [tuple(s) for s in rows[0, 1].ac_symbols] == [("AC", 62, 3)]
    back = coding.decode_blocks(enc.drop("qf"), initial=5).collect()
    assert all(r.qf == t[r.br, r.bc].ravel().tolist() for r in back)
    s = coding.symbol_stream(enc)
    again = {(r.br, r.bc): r for r in coding.blocks_from_symbols(s).collect()}
    assert all(again[k].dc_diff == rows[k].dc_diff and again[k].ac_symbols == rows[k].ac_symbols for k in rows)
    stats = coding.rle_statistics(enc).first()
    n = [len(r.ac_symbols) for r in rows.values()]
    assert (stats.rle_symbols, stats.average_rle_symbols_per_block) == (sum(n), sum(n) / len(n))


def _decode(spark, symbols, length=63):
    df = spark.createDataFrame([(symbols,)], f"s array<{coding.SYMBOL}>")
    return df.select(coding.rle_decode(F.col("s"), length).alias("x")).first().x


def test_rle_decoder(spark):
    assert _decode(spark, [("AC", 1, 5), ("EOB", None, None), ("AC", 9, 9)], 4) == [0, 5, 0, 0]
    assert _decode(spark, [("AC", 0, 1)], 3) == [1, 0, 0] and _decode(spark, [], 3) == [0, 0, 0]
    for bad in ([("AC", 3, 1)], [("AC", -1, 1)]):
        with pytest.raises(Exception, match="run lengths"):
            _decode(spark, bad, 3)


def test_bad_grammar_and_order(spark):
    rows = [("i", "g", 0, 0, 0, "DC", None, 1), ("i", "g", 0, 0, 1, "EOB", None, None), ("i", "g", 0, 0, 2, "AC", 0, 1), ("i", "g", 0, 0, 3, "BLOCK_END", None, None)]
    df = spark.createDataFrame(rows, "image_id string, channel string, br int, bc int, pos int, kind string, run int, amp int")
    with pytest.raises(Exception, match="do not form a block"):
        coding.blocks_from_symbols(df).collect()
    with pytest.raises(ValueError):
        params.check_order([0, 0, 1, 2], 2)
    assert params.zigzag_order(3) == [0, 1, 3, 6, 4, 2, 5, 7, 8]


def test_huffman(spark):
    enc = coding.encode_blocks(blocks(spark, sparse(4)))
    s = coding.symbol_stream(enc)
    freq = huffman.frequencies(s)
    book = huffman.codebook(freq)
    assert huffman.check_codebook(book).count() == 0
    st = huffman.statistics(book, huffman.entropy(freq)).first()
    assert st.entropy <= st.average_code_length < st.entropy + 1
    bits = huffman.encode(s, book)
    assert huffman.decode(bits, book).selectExpr("sum(size(symbols))").first()[0] == st.symbol_count == s.count()
    stream = huffman.bitstream(bits)
    assert len(stream.first().bitstream) == st.bit_count
    flat = [tuple(x) for x in huffman.decode(stream, book, column="bitstream").first().symbols]
    assert flat == [(r.kind, r.run, r.amp) for r in s.orderBy("br", "bc", "pos").collect()]
    with pytest.raises(Exception, match="no code"):
        huffman.encode(s, book.where("kind <> 'DC'")).collect()


def test_huffman_codes():
    assert huffman.huffman_codes([5]) == ["0"]
    assert huffman.huffman_codes([1, 1, 1, 1]) == ["00", "01", "10", "11"]
    assert huffman.huffman_codes([1, 1, 2]) == ["10", "11", "0"]
    assert sorted(map(len, huffman.huffman_codes([2**i for i in range(1200)])))[-1] == 1199
    for bad in ([], [0, 1], [1.5]):
        with pytest.raises(ValueError):
            huffman.huffman_codes(bad)
    assert huffman.decode_bits("0110", {"0": ("a",), "11": ("b",)}) == [("a",), ("b",), ("a",)]
    for bits in ("", "01", "0x"):
        with pytest.raises(ValueError):
            huffman.decode_bits(bits, {"0": ("a",), "11": ("b",)})
    assert (huffman.fixed_width(1), huffman.fixed_width(2), huffman.fixed_width(5)) == (1, 1, 3)


def test_decode_checks_the_codebook(spark):
    enc = coding.encode_blocks(blocks(spark, sparse(4)))
    s = coding.symbol_stream(enc)
    book = huffman.codebook(huffman.frequencies(s))
    bits = huffman.encode(s, book)
    for bad in (book.withColumn("code", F.substring("code", 1, 1)), book.withColumn("code", F.concat(F.lit("2"), "code")), book.limit(0)):
        with pytest.raises(Exception, match="code"):
            huffman.decode(bits, bad).collect()
    with pytest.raises(Exception, match="whole code"):
        huffman.decode(bits.withColumn("bits", F.concat("bits", F.lit("0"))), book.withColumn("code", F.concat(F.lit("11"), "code"))).collect()


def test_prefix_is_found(spark):
    rows = [("i", "g", "DC", None, k, 1, c) for k, c in enumerate(["0", "10", "101", "11"])]
    bad = huffman.check_codebook(spark.createDataFrame(rows, "image_id string, channel string, kind string, run int, amp int, n long, code string"))
    assert [r.code for r in bad.collect()] == ["10"]


def rgb(spark, a):
    h, w, _ = a.shape
    return spark.createDataFrame([("i", r, c, *map(int, a[r, c]), h, w) for r in range(h) for c in range(w)], "image_id string, r int, c int, red int, green int, blue int, h int, w int")


def test_color_round_trip_and_subsampling(spark):
    a = np.random.default_rng(2).integers(0, 256, (7, 5, 3))
    y = color.rgb_to_ycbcr(rgb(spark, a))
    back = color.ycbcr_to_rgb(y).collect()
    for k, n in enumerate(("red", "green", "blue")):
        assert abs(plane(back, 7, 5, n) - a[:, :, k]).max() < 1e-3
    cb = plane(y.collect(), 7, 5, "cb")
    planes = color.split_channels(y)
    small = color.downsample_420(planes.where("channel = 'Cb'"))
    want = np.pad(cb, ((0, 1), (0, 1)), mode="edge").reshape(4, 2, 3, 2).mean((1, 3))
    assert np.allclose(plane(small.collect(), 4, 3), want)
    big = plane(color.upsample_420(small, spark.createDataFrame([("i", 7, 5)], "image_id string, orig_h int, orig_w int")).collect(), 7, 5)
    assert np.allclose(big, bilinear(want, 8, 6)[:7, :5])
    up = color.resize_bilinear(small, F.lit(9), F.lit(3))
    assert np.allclose(plane(up.collect(), 9, 3), bilinear(want, 9, 3))
    with pytest.raises(Exception, match="differ in shape"):
        color.merge_channels(planes.where("not (channel = 'Cr' and r = 0)")).collect()
    with pytest.raises(ValueError):
        color.upsample_420(small, None, "4:4:4")


def bilinear(a, h, w):
    def side(n, t):
        s = np.clip((np.arange(t) + 0.5) * n / t - 0.5, 0, n - 1)
        lo = np.floor(s).astype(int)
        return lo, np.minimum(lo + 1, n - 1), s - lo

    (r0, r1, wr), (c0, c1, wc) = side(a.shape[0], h), side(a.shape[1], w)
    top, low = (a[r][:, c0] * (1 - wc) + a[r][:, c1] * wc for r in (r0, r1))
    return top * (1 - wr)[:, None] + low * wr[:, None]


def test_quality_figures(spark):
    a = np.random.default_rng(5).integers(0, 256, (9, 11)).astype(np.float32)
    one = metrics.quality(pixels(spark, a), pixels(spark, a)).first()
    assert (one.mse, one.mae, one.psnr) == (0, 0, np.inf)
    b = np.clip(a + 3, 0, 255)
    two = metrics.quality(pixels(spark, a), pixels(spark, b)).first()
    assert two.mse == pytest.approx(((a - b) ** 2).mean()) and two.psnr == pytest.approx(10 * np.log10(255**2 / two.mse))
    with pytest.raises(Exception, match="differ in shape"):
        metrics.quality(pixels(spark, a), pixels(spark, b).where("r > 0")).collect()


def test_whole_gray_run(spark):
    a = np.random.default_rng(6).integers(0, 256, (13, 18)).astype(np.float32)
    tables = pipelines.sweep_tables([0.01, 2.0], [50])
    got = {r.config_id: r for r in pipelines.run_gray(pixels(spark, a), tables).collect()}
    c, t = params.dct_matrix(), tiles(a) - 128
    for name, q in tables.items():
        q = np.reshape(q, (8, 8))
        k = np.rint(np.round(c @ t @ c.T, 9) / q)
        back = (c.T @ (k * q) @ c + 128).swapaxes(1, 2).reshape(16, 24)[:13, :18]
        img = np.rint(np.clip(back, 0, 255))
        r = got[name]
        assert r.mse == pytest.approx(((img - a) ** 2).mean(), abs=1e-3) and r.zero_coefficients == (k == 0).sum()
        symbols = [walk_rle(b.ravel()[params.zigzag_order()][1:]) for b in k.reshape(-1, 8, 8)]
        bits = sum(16 + sum(22 if s[0] == "AC" else 4 for s in b) for b in symbols)
        assert (r.compressed_bits, r.original_bits, r.rle_symbols) == (bits, 13 * 18 * 8, sum(map(len, symbols)))
    assert got["quality_50"].pad_height == 3 and got["quality_50"].num_blocks_horizontal == 3


def test_every_setting_of_a_sweep_has_its_row(spark):
    scales = [1.0, 1.0, 1.0000001, 0.123456789]
    tables = pipelines.sweep_tables(scales, [50, 50])
    assert list(tables) == ["scale_1", "scale_1_again1", "scale_1.0000001", "scale_0.123456789", "quality_50", "quality_50_again1"]
    a = np.random.default_rng(7).integers(0, 256, (9, 9)).astype(np.float32)
    got = {r.config_id: r for r in pipelines.run_gray(pixels(spark, a), tables).collect()}
    assert set(got) == set(tables) and got["scale_1"].mse == got["scale_1_again1"].mse
    plain = {r.config_id: r for r in pipelines.run_gray(pixels(spark, a), tables, decode=False).collect()}
    assert all(plain[k].mse == got[k].mse and plain[k].compressed_bits == got[k].compressed_bits for k in got)


def test_errors_within_blocks_are_those_of_pixels(spark):
    """Several planes of several sizes: the figures of a run equal those of a join of pixels."""
    r = np.random.default_rng(8)
    planes = pixels(spark, r.integers(0, 256, (13, 30)).astype(np.float32), "a").unionByName(pixels(spark, r.integers(0, 256, (8, 7)).astype(np.float32), "b"))
    tables = pipelines.sweep_tables([0.5, 3.0])
    got = {(x.image_id, x.config_id): x for x in pipelines.run_gray(planes, tables).collect()}
    back = reconstruct.from_quantized(pipelines.quantized_sweep(pipelines.coefficients(planes), tables), pipelines.RUN)
    want = metrics.quality(planes, back, pipelines.RUN).collect()
    assert len(got) == len(want) == 4
    for x in want:
        g = got[x.image_id, x.config_id]
        assert (g.mse, g.mae, g.psnr) == pytest.approx((x.mse, x.mae, x.psnr))


def test_whole_color_run_is_close_at_fine_scale(spark):
    r, c = np.indices((15, 21))
    a = np.stack([r * 12, c * 10, 255 - r * 8 - c * 4], 2).clip(0, 255)
    got = pipelines.run_color(rgb(spark, a), scale=0.05).collect()
    assert len(got) == 15 * 21
    assert max(abs(plane(got, 15, 21, n) - a[:, :, k]).mean() for k, n in enumerate(("red", "green", "blue"))) < 3


def test_reconstruct_parts(spark):
    x = np.arange(2 * 3 * 64).reshape(2, 3, 8, 8).astype(float)
    p = reconstruct.merge_blocks(blocks(spark, x, "px", "double")).collect()
    assert np.array_equal(plane(p, 16, 24), x.swapaxes(1, 2).reshape(16, 24))
    assert [r.v for r in reconstruct.clip(spark.createDataFrame([(-1.0,), (300.0,)], "v double")).collect()] == [0.0, 255.0]
