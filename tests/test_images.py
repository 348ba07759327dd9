import csv

import numpy as np
import pytest

from blockloom import cli
from blockloom.sources import images


@pytest.fixture()
def color_file(tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (13, 10, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(a))
    return a, str(tmp_path / "a.png")


def test_png_round_trip(spark, tmp_path, color_file):
    a, path = color_file
    got = images.read_rgb(spark, path).collect()
    assert len(got) == 130 and {(r.h, r.w) for r in got} == {(13, 10)}
    assert all(tuple(a[r.r, r.c]) == (r.red, r.green, r.blue) for r in got)
    (tmp_path / "g.png").write_bytes(images.png(a[:, :, 0].copy()))
    assert all(r.red == r.green == r.blue == a[r.r, r.c, 0] for r in images.read_rgb(spark, str(tmp_path / "g.png")).collect())
    back = images.to_png(images.read_rgb(spark, path)).first()
    assert bytes(back.png) == images.png(a)
    with pytest.raises(ValueError):
        images.png(a.astype(float))


def test_single_run_and_sweep(spark, tmp_path, color_file, capsys):
    _, path = color_file
    rows = cli.main(["--image", path, "--output-dir", str(tmp_path / "o"), "--quality", "80"]).collect()
    assert len(rows) == 1 and rows[0].quality == 80 and rows[0].scale == 1.0 and list(rows[0].asDict()) == cli.RESULT
    assert (tmp_path / "o/reconstructed_quality_80.png").exists() and "PSNR" in capsys.readouterr().out
    rows = cli.main(["--image", path, "--output-dir", str(tmp_path / "o"), "--quality", "80", "--scale", "2.5"]).collect()
    assert (rows[0].scale, rows[0].quality) == (2.5, 80) and (tmp_path / "o/results_single_run.csv").exists()
    rows = cli.main(["--image", path, "--output-dir", str(tmp_path / "s"), "--sweep-scales", "0.5, 2", "--sweep-qualities", "50", "--no-plots"]).collect()
    assert [r.scale for r in rows] == [0.5, 2.0] and {r.quality for r in rows} == {None}
    with open(tmp_path / "s/results_sweep_scales.csv") as f:
        assert [(r["scale"], r["quality"]) for r in csv.DictReader(f)] == [("0.5", ""), ("2.0", "")]
    assert {p.name for p in (tmp_path / "s").iterdir()} == {"results_sweep_scales.csv", "reconstructed_scale_0.5.png", "reconstructed_scale_2.png"}


def test_repeated_settings_and_folders(spark, tmp_path, color_file):
    a, path = color_file
    folder = tmp_path / "many"
    folder.mkdir()
    for k in ("x", "y"):
        (folder / f"{k}.png").write_bytes(images.png(a if k == "x" else a[:9]))
    rows = cli.run(spark, str(folder), str(tmp_path / "f"), [1.0, 1.0, 1.0000001], [50]).collect()
    assert [(r.scale, r.quality, r.original_height) for r in rows] == [(1.0, None, 13), (1.0, None, 9)] * 2 + [(1.0000001, None, 13), (1.0000001, None, 9), (1.0, 50, 13), (1.0, 50, 9)]
    names = {p.name for p in (tmp_path / "f").iterdir()}
    assert len(names) == 8 and {r.output_image_path.rpartition("/")[2] for r in rows} == names
    for options in (["--sweep-scales", ""], ["--sweep-qualities", " , "]):
        with pytest.raises(ValueError):
            cli.main(["--image", path, "--output-dir", str(tmp_path / "e"), *options])


def test_basis_sheets(spark, tmp_path):
    made = cli.save_basis(str(tmp_path / "b"))
    assert [m.rpartition("/")[2] for m in made] == [f"dct_bases_{u}_{v}.png" for u in ("0_3", "4_7") for v in ("0_3", "4_7")]
    sheet = images.read_rgb(spark, made[0]).where("r = 20 and c = 20").first()
    assert sheet.red == sheet.green == 191  # a flat block of an eighth


def test_texts_of_figures():
    row = {"mse": 1.0, "mae": 0.5, "psnr": 48.13, "zero_percentage": 50.0, "zero_coefficients": 32, "total_coefficients": 64, "rle_symbols": 3, "average_rle_symbols_per_block": 3.0, "original_bits": 512, "compressed_bits": 64, "compression_ratio": 8.0, "reduction_percentage": 87.5}
    assert "PSNR                48.13 dB" in cli.quality_text(row) and "infinite" in cli.quality_text(row | {"psnr": float("inf")})
    assert "8.00:1 (87.50 % less)" in cli.compression_text(row) and "32 of 64" in cli.compression_text(row)
    stats = {"symbol_count": 9, "alphabet_size": 4, "entropy": 1.5, "average_code_length": 1.6, "bit_count": 15, "fixed_length_bits": 18, "compression_gain_vs_fixed": 1.2}
    assert "9 of 4 kinds" in cli.huffman_text(stats) and "15 (fixed length 18, 1.2000 x)" in cli.huffman_text(stats)
    assert cli.class_text({"smooth": 1, "edge": 0, "texture": 3, "smooth_percentage": 25.0, "edge_percentage": 0.0, "texture_percentage": 75.0}).splitlines()[2].endswith("3 (75.00 %)")


def test_errors(spark, tmp_path):
    (tmp_path / "no.png").write_bytes(b"not an image")
    with pytest.raises(Exception, match="can't be read"):
        images.read_rgb(spark, str(tmp_path / "no.png")).collect()
    assert images.read_rgb(spark, str(tmp_path / "no.png"), skip_invalid=True).count() == 0
    with pytest.raises(FileNotFoundError):
        cli.run(spark, str(tmp_path / "none.png"), str(tmp_path))
    with pytest.raises(ValueError):
        images.save_csv(spark.range(0), str(tmp_path / "x.csv"))
    images.save_csv(spark.sql("select 1 as a, cast('inf' as double) as b, cast(null as int) as c"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text().split() == ["a,b,c", "1,inf,"]
