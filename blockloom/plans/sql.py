"""The same computations in DuckDB's SQL, put together from named parts."""

from __future__ import annotations

from blockloom.functions.params import CHROMA, LUMA, color_tables, zigzag_order

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def query(final: str, *names: str, **own: str) -> str:
    parts = [f"{n} AS ({own.get(n) or PARTS[n]})" for n in [*names, *(k for k in own if k not in names)]]
    return f"WITH {',\n'.join(parts)}\n{final}"


def table_rows(tables: dict[tuple[str, str], list[float]]) -> str:
    """``config_id, ch, u, v, q`` of tables by (config, channel)."""
    values = ", ".join(f"('{c}', '{ch}', {i // 8}, {i % 8}, {q:.6f}::DOUBLE)" for (c, ch), t in tables.items() for i, q in enumerate(t))
    return f"SELECT * FROM (VALUES {values}) AS t(config_id, ch, u, v, q)"


def gray_tables(tables: dict[str, list[float]]) -> str:
    return table_rows({(k, "gray"): v for k, v in tables.items()})


U8 = "round_even(least(greatest({}, 0.0), 255.0), 0)::INT"

part("basis", "SELECT k, n, sqrt(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END / 8) * cos(pi() / 8 * (n + 0.5) * k) AS b FROM range(8) a(k), range(8) c(n)")
part("zz", "SELECT * FROM (VALUES " + ", ".join(f"({p // 8}, {p % 8}, {z})" for z, p in enumerate(zigzag_order())) + ") AS t(u, v, z)")
part("gray", "SELECT 'gray' AS ch, o_orderkey // 100 AS r, o_orderkey % 100 AS c, (floor(o_totalprice)::BIGINT % 256)::FLOAT AS v FROM orders")
part("rgb", """SELECT p_partkey // 45 AS r, c, (floor(p_retailprice)::INT - 900) * 2 AS red, p_size * 5 AS green, (p_partkey % 256)::INT AS blue
  FROM (SELECT *, unnest(range(p_partkey % 45, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 45 ELSE p_partkey % 45 + 1 END)) AS c FROM part)""")
part("rgbgray", "SELECT 'gray' AS ch, r, c, 0.299::FLOAT * red::FLOAT + 0.587::FLOAT * green::FLOAT + 0.114::FLOAT * blue::FLOAT AS v FROM rgb")
part("ycc", "SELECT r, c, 0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue AS y, 128.0::DOUBLE - 0.168736::DOUBLE * red - 0.331264::DOUBLE * green + 0.5::DOUBLE * blue AS cb, 128.0::DOUBLE + 0.5::DOUBLE * red - 0.418688::DOUBLE * green - 0.081312::DOUBLE * blue AS cr FROM rgb")
part("chan", "SELECT 'Y' AS ch, r, c, y AS v FROM ycc UNION ALL SELECT 'Cb', r, c, cb FROM ycc UNION ALL SELECT 'Cr', r, c, cr FROM ycc")
part("small", """SELECT ch, a.r // 2 AS r, a.c // 2 AS c,
  (max(v) FILTER (a.r % 2 = 0 AND a.c % 2 = 0) + max(v) FILTER (a.r % 2 = 1 AND a.c % 2 = 0) + max(v) FILTER (a.r % 2 = 0 AND a.c % 2 = 1) + max(v) FILTER (a.r % 2 = 1 AND a.c % 2 = 1)) / 4 AS v
  FROM (SELECT ch, i AS r, j AS c, v FROM (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM chan) d, LATERAL (SELECT unnest(range((h + 1) // 2 * 2)) AS i) x, LATERAL (SELECT unnest(range((w + 1) // 2 * 2)) AS j) y
    JOIN chan p ON p.r = least(i, h - 1) AND p.c = least(j, w - 1) WHERE ch <> 'Y') a GROUP BY ch, a.r // 2, a.c // 2""")
part("planes", "SELECT * FROM chan WHERE ch = 'Y' UNION ALL SELECT * FROM small")


def blocks_of(source: str) -> str:
    """Edge padding and tiling of a ``ch, r, c, v`` relation."""
    return f"""SELECT d.ch, i // 8 AS br, j // 8 AS bc, i % 8 AS x, j % 8 AS y, p.v::FLOAT AS v
  FROM (SELECT ch, max(r) + 1 AS h, max(c) + 1 AS w FROM {source} GROUP BY ch) d,
    LATERAL (SELECT unnest(range((h + 7) // 8 * 8)) AS i) a, LATERAL (SELECT unnest(range((w + 7) // 8 * 8)) AS j) b
  JOIN {source} p ON p.ch = d.ch AND p.r = least(i, h - 1) AND p.c = least(j, w - 1)"""


part("emb", """SELECT 'gray' AS ch, vec_id AS br, 0 AS bc, i // 8 AS x, i % 8 AS y, least(greatest(round_even(128.0::DOUBLE + 255.0::DOUBLE * e::DOUBLE, 0), 0), 255)::FLOAT AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings)""")
part("half", "SELECT ch, br, bc, k AS u, y, sum(b * (v - 128.0::FLOAT)::DOUBLE) AS s FROM blocks JOIN basis ON n = x GROUP BY ch, br, bc, k, y")
part("coef", "SELECT ch, br, bc, u, k AS v, round(sum(b * s), 9) AS f FROM half JOIN basis ON n = y GROUP BY ch, br, bc, u, k")
part("qc", "SELECT config_id, ch, br, bc, u, v, round_even(f / q, 0)::INT AS qf, q FROM coef JOIN qt USING (ch, u, v)")
part("zc", "SELECT config_id, ch, br, bc, z, qf FROM qc JOIN zz USING (u, v)")
part("dc", "SELECT config_id, ch, br, bc, (qf - coalesce(lag(qf) OVER (PARTITION BY config_id, ch ORDER BY br, bc), 0))::INT AS dc_diff, qf AS dc FROM zc WHERE z = 0")
part("ac", "SELECT config_id, ch, br, bc, (row_number() OVER w)::INT AS pos, 'AC' AS kind, (z - coalesce(lag(z) OVER w, 0) - 1)::INT AS run, qf AS amp FROM zc WHERE z > 0 AND qf <> 0 WINDOW w AS (PARTITION BY config_id, ch, br, bc ORDER BY z)")
part("last", "SELECT config_id, ch, br, bc, coalesce(max(z) FILTER (z > 0 AND qf <> 0), 0) AS z, (count(*) FILTER (z > 0 AND qf <> 0))::INT AS n FROM zc GROUP BY config_id, ch, br, bc")
part("sym", """SELECT config_id, ch, br, bc, 0 AS pos, 'DC' AS kind, NULL::INT AS run, dc_diff AS amp FROM dc UNION ALL SELECT * FROM ac
  UNION ALL SELECT config_id, ch, br, bc, n + 1, 'EOB', NULL, NULL FROM last WHERE z < 63
  UNION ALL SELECT config_id, ch, br, bc, CASE WHEN z < 63 THEN n + 2 ELSE n + 1 END, 'BLOCK_END', NULL, NULL FROM last""")
part("freq", "SELECT config_id, ch, kind, run, amp, count(*) AS n FROM sym GROUP BY config_id, ch, kind, run, amp")
part("ihalf", "SELECT config_id, ch, br, bc, v, n AS x, sum(b * qf * q) AS s FROM qc JOIN basis ON k = u GROUP BY config_id, ch, br, bc, v, n")
part("back", "SELECT config_id, ch, br, bc, x, n AS y, round(sum(b * s), 9) + 128.0 AS p FROM ihalf JOIN basis ON k = v GROUP BY config_id, ch, br, bc, x, n")
part("image", f"SELECT config_id, ch, br * 8 + x AS r, bc * 8 + y AS c, {U8.format('p')} AS v FROM back JOIN (SELECT ch, max(r) + 1 AS h, max(c) + 1 AS w FROM src GROUP BY ch) USING (ch) WHERE br * 8 + x < h AND bc * 8 + y < w")
part("err", "SELECT config_id, ch, avg(pow(s.v::DOUBLE - i.v, 2)) AS mse, avg(abs(s.v::DOUBLE - i.v)) AS mae FROM image i JOIN src s USING (ch, r, c) GROUP BY config_id, ch")
part("bits", """SELECT config_id, ch, (count(*) * 64)::BIGINT AS total_coefficients, (sum(64 - nz))::BIGINT AS zero_coefficients, sum(nz)::BIGINT AS nonzero_coefficients, sum(ac + eob)::BIGINT AS rle_symbols, sum(eob)::BIGINT AS eob_symbols,
  sum(ac + eob)::DOUBLE / count(*) AS average_rle_symbols_per_block, sum(16 + 22 * ac + 4 * eob)::BIGINT AS compressed_bits
  FROM (SELECT config_id, ch, br, bc, count(*) FILTER (qf <> 0) AS nz, count(*) FILTER (qf <> 0 AND z > 0) AS ac, CASE WHEN coalesce(max(z) FILTER (qf <> 0 AND z > 0), 0) < 63 THEN 1 ELSE 0 END AS eob FROM zc GROUP BY config_id, ch, br, bc) GROUP BY config_id, ch""")
part("taps", """SELECT b.ch, b.br, b.bc, b.x, b.y, sum(k.gx * p.v::DOUBLE) AS gx, sum(k.gy * p.v::DOUBLE) AS gy
  FROM fb b, (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) AS k(dx, dy, gx, gy)
  JOIN fb p ON p.ch = b.ch AND p.br = b.br AND p.bc = b.bc AND p.x = least(greatest(b.x + k.dx, 0), 7) AND p.y = least(greatest(b.y + k.dy, 0), 7) GROUP BY b.ch, b.br, b.bc, b.x, b.y""")
part("feat", """SELECT ch, br, bc, round(m, 9) AS mean, round(vr, 9) AS variance, round(ex, 9) AS gradient_energy_x, round(ey, 9) AS gradient_energy_y, round(ex + ey, 9) AS gradient_energy, round(abs(ex - ey) / (ex + ey + 1e-12), 9) AS directionality
  FROM (SELECT ch, br, bc, avg(v::DOUBLE) AS m, var_pop(v::DOUBLE) AS vr FROM fb GROUP BY ch, br, bc) JOIN (SELECT ch, br, bc, avg(gx * gx) AS ex, avg(gy * gy) AS ey FROM taps GROUP BY ch, br, bc) USING (ch, br, bc)""")
part("cls", """SELECT f.ch, br, bc, CASE WHEN variance <= tv AND gradient_energy <= tg THEN 0 WHEN gradient_energy > tg AND directionality >= 0.35 THEN 1 ELSE 2 END AS class
  FROM feat f JOIN (SELECT ch, round(quantile_cont(variance, 0.35), 9) AS tv, round(quantile_cont(gradient_energy, 0.55), 9) AS tg FROM feat GROUP BY ch) t ON f.ch = t.ch""")
part("scl", "SELECT *, CASE class WHEN 0 THEN 1.5 WHEN 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS scale FROM cls")
part("qa", "SELECT config_id, ch, br, bc, u, v, round_even(f / aq, 0)::INT AS qf, aq AS q FROM (SELECT config_id, ch, br, bc, u, v, f, CASE WHEN scale IS NULL THEN q ELSE least(greatest(round_even(q * scale, 0), 1), 255) END AS aq FROM coef JOIN qt USING (ch, u, v) LEFT JOIN scl USING (ch, br, bc))")

BLOCKS = blocks_of("src")
#: Gray chain over ``src``, up to the named part.
CHAIN = ["basis", "zz", "src", "blocks", "half", "coef", "qt", "qc", "zc"]
COLOR_TABLES = {s: table_rows({("c", k): t for k, t in color_tables(s).items()}) for s in (1.0, 4.0)}


def color_rows(scale: float, chroma_scale: float) -> str:
    """Colour tables, scaled here and not by the library."""
    rows = [(k, i, s, q) for k, base, s in (("Y", LUMA, scale), ("Cb", CHROMA, chroma_scale), ("Cr", CHROMA, chroma_scale)) for i, q in enumerate(base)]
    values = ", ".join(f"('{k}', {i // 8}, {i % 8}, {s}::DOUBLE, {q}::DOUBLE)" for k, i, s, q in rows)
    return f"SELECT 'c' AS config_id, ch, u, v, least(greatest(round_even(s * q, 0), 1), 255) AS q FROM (VALUES {values}) AS t(ch, u, v, s, q)"


BASE = {"luma": LUMA, "chroma": CHROMA}


def enlarged(source: str, h: str, w: str) -> str:
    """Bilinear resampling by two of ``ch, r, c, v``, with edges clamped, cropped to h by w."""
    def side(t: str, n: str) -> str:
        return f"least(greatest(({t} + 0.5) / 2 - 0.5, 0.0), {n} - 1.0)"

    return f"""SELECT g.ch, g.r, g.c, (1 - wr) * ((1 - wc) * a.v + wc * b.v) + wr * ((1 - wc) * e.v + wc * f.v) AS v
  FROM (SELECT ch, i AS r, j AS c, floor({side('i', 'sh')})::INT AS r0, floor({side('j', 'sw')})::INT AS c0, {side('i', 'sh')} - floor({side('i', 'sh')}) AS wr, {side('j', 'sw')} - floor({side('j', 'sw')}) AS wc, sh, sw
    FROM (SELECT ch, max(r) + 1 AS sh, max(c) + 1 AS sw FROM {source} GROUP BY ch) d, LATERAL (SELECT unnest(range({h})) AS i) x, LATERAL (SELECT unnest(range({w})) AS j) y) g
  JOIN {source} a ON a.ch = g.ch AND a.r = r0 AND a.c = c0 JOIN {source} b ON b.ch = g.ch AND b.r = r0 AND b.c = least(c0 + 1, sw - 1)
  JOIN {source} e ON e.ch = g.ch AND e.r = least(r0 + 1, sh - 1) AND e.c = c0 JOIN {source} f ON f.ch = g.ch AND f.r = least(r0 + 1, sh - 1) AND f.c = least(c0 + 1, sw - 1)"""


def resized(source: str, h: int, w: int) -> str:
    """Bilinear resampling of ``ch, r, c, v`` to a fixed size, with edges clamped."""
    def side(t: str, n: str, size: int) -> str:
        return f"least(greatest(({t} + 0.5::DOUBLE) * {n} / {size} - 0.5, 0.0), {n} - 1.0)"

    y, x = side("i", "sh", h), side("j", "sw", w)
    return f"""SELECT g.ch, g.r, g.c, (1 - wr) * ((1 - wc) * a.v + wc * b.v) + wr * ((1 - wc) * e.v + wc * f.v) AS v
  FROM (SELECT ch, i AS r, j AS c, floor({y})::INT AS r0, floor({x})::INT AS c0, {y} - floor({y}) AS wr, {x} - floor({x}) AS wc, sh, sw
    FROM (SELECT ch, max(r) + 1 AS sh, max(c) + 1 AS sw FROM {source} GROUP BY ch) d, range({h}) p(i), range({w}) q(j)) g
  JOIN {source} a ON a.ch = g.ch AND a.r = r0 AND a.c = c0 JOIN {source} b ON b.ch = g.ch AND b.r = r0 AND b.c = least(c0 + 1, sw - 1)
  JOIN {source} e ON e.ch = g.ch AND e.r = least(r0 + 1, sh - 1) AND e.c = c0 JOIN {source} f ON f.ch = g.ch AND f.r = least(r0 + 1, sh - 1) AND f.c = least(c0 + 1, sw - 1)"""
