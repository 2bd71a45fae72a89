"""DuckDB queries with the results of framelake.queries, written from the operators' rules and not from their plans."""

from __future__ import annotations

import math

from framelake.operators.geometry import FONT

_level = "floor(least(255e0, greatest(0e0, ({}::DOUBLE + 0.6e0) / 1.2e0 * 255e0)) + 0.5e0)::INT".format
GRAY = f"gray AS MATERIALIZED (SELECT e.vec_id AS f, (i // 8)::INT AS y, (i % 8)::INT AS x, {_level('e.embedding[i + 1]')} AS v FROM embeddings e, range(64) t(i))"
# Three embeddings come together by one grouping, before they are laid out: no join for an optimiser to order.
COLOUR = (f"{GRAY}, rgb AS MATERIALIZED (SELECT f, (i // 8)::INT AS y, (i % 8)::INT AS x, {', '.join(f'{_level(f'e[{k}][i + 1]')} AS {c}' for k, c in enumerate('rgb', 1))} FROM "
          "(SELECT vec_id // 3 AS f, list(embedding ORDER BY vec_id) AS e FROM embeddings GROUP BY ALL HAVING count(*) = 3), range(64) t(i))")
LUMA = "(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b)"


def t(e: str) -> str:
    return f"floor(least(255e0, greatest(0e0, {e})))::INT"


def r(e: str) -> str:
    return f"floor(least(255e0, greatest(0e0, {e})) + 0.5e0)::INT"


def unit(e: str) -> str:
    return f"least(1e0, greatest(0e0, {e}))"


def gray(sql: str) -> str:
    return f"WITH {GRAY} {sql}"


def rgb(sql: str) -> str:
    return f"WITH {COLOUR} {sql}"


def each(f, tail: str = "FROM rgb") -> str:
    """Pixels with f applied to every channel."""
    return rgb("SELECT f, y, x, " + ", ".join(f"{f(c)} AS {c}" for c in "rgb") + " " + tail)


ORACLES: dict[str, str] = {}
O = ORACLES

# Planes of full-range colour, as a table p(f, p, y, x, v).


def planes(y: str, u: str, v: str) -> str:
    even = "FROM rgb WHERE x % 2 = 0 AND y % 2 = 0"
    return (f"SELECT f, 0 AS p, y, x, {y} AS v FROM rgb UNION ALL SELECT f, 1, (y // 2)::INT, (x // 2)::INT, {u} {even} "
            f"UNION ALL SELECT f, 2, (y // 2)::INT, (x // 2)::INT, {v} {even}")


def scaled(coefs) -> str:
    return " + ".join(f"{k}e0 * (rgb.{c} / 255e0)" for k, c in zip(coefs, "rgb"))


M709 = [scaled(c) for c in ((0.2126, 0.7152, 0.0722), (-0.1146, -0.3854, 0.5), (0.5, -0.4542, -0.0458))]
M601 = [scaled(c) for c in ((0.299, 0.587, 0.114), (-0.16874, -0.33126, 0.5), (0.5, -0.41869, -0.08131))]
FULL = planes(t(f"({M709[0]}) * 255e0"), t(f"({M709[1]} + 0.5e0) * 255e0"), t(f"({M709[2]} + 0.5e0) * 255e0"))


def limited(m) -> str:
    return planes(r(f"({m[0]}) * 219e0 + 16e0"), r(f"({m[1]}) * 224e0 + 128e0"), r(f"({m[2]}) * 224e0 + 128e0"))


O["c03_rgb_to_planes"] = rgb(FULL)
O["c04_rgb_to_planes_709"] = rgb(limited(M709))
O["c05_rgb_to_planes_601"] = O["c06_matrix_by_height"] = rgb(limited(M601))
O["c07_rgb_to_planes_integer"] = rgb(planes("(((66*r+129*g+25*b+128) >> 8) + 16)::INT", "(floor((-38*r-74*g+112*b+128) / 256e0) + 128)::INT", "(floor((112*r-94*g-18*b+128) / 256e0) + 128)::INT"))


def from_planes(l: str, u: str, w: str) -> str:
    back = {"r": f"{l} + 1.5748e0 * {w}", "g": f"{l} - 0.1873e0 * {u} - 0.4681e0 * {w}", "b": f"{l} + 1.8556e0 * {u}"}
    cols = ", ".join(f"{t(unit(e) + ' * 255e0')} AS {c}" for c, e in back.items())
    return (f"WITH {COLOUR}, p AS MATERIALIZED ({FULL}) SELECT a.f, a.y, a.x, {cols} FROM p a JOIN p u ON u.p = 1 AND u.f = a.f AND u.y = a.y // 2 AND u.x = a.x // 2 "
            f"JOIN p w ON w.p = 2 AND w.f = a.f AND w.y = a.y // 2 AND w.x = a.x // 2 WHERE a.p = 0")


O["c01_planes_to_rgb"] = from_planes("(a.v / 255e0)", "(u.v / 255e0 - 0.5e0)", "(w.v / 255e0 - 0.5e0)")
O["c02_planes_to_rgb_limited"] = from_planes("(greatest(a.v - 16, 0) / 219e0)", "((u.v - 128) / 224e0)", "((w.v - 128) / 224e0)")
O["c10_swap"] = rgb("SELECT f, y, x, b AS r, g, r AS b FROM rgb")
REINHARD = lambda c, peak: t(f"({c} / 255e0 * 100e0 / {peak}e0) / (1e0 + {c} / 255e0 * 100e0 / {peak}e0) * 255e0")
O["c11_pq_to_sdr"] = each(lambda c: REINHARD(c, 100))
O["c12_yuy2"] = (f"WITH {COLOUR}, p AS MATERIALIZED ({FULL}) SELECT a.f, a.y, (a.x // 2)::INT AS x2, a.v AS y0, u.v AS u, b.v AS y1, w.v AS w FROM p a JOIN p b ON b.p = 0 AND b.f = a.f AND b.y = a.y AND b.x = a.x + 1 "
                 "JOIN p u ON u.p = 1 AND u.f = a.f AND u.y = a.y // 2 AND u.x = a.x // 2 JOIN p w ON w.p = 2 AND w.f = a.f AND w.y = a.y // 2 AND w.x = a.x // 2 WHERE a.p = 0 AND a.x % 2 = 0")
O["c13_luminance"] = rgb(f"SELECT f, y, x, {r(LUMA)} AS v FROM rgb")
O["c14_channels"] = rgb("SELECT f, y, x, b AS r, g, b FROM rgb")

# Tone.
O["p01_brightness_contrast"] = ("WITH q AS (SELECT (l_partkey % 256)::INT AS r, (l_suppkey * 37 % 256)::INT AS g, (l_orderkey * 91 % 256)::INT AS b FROM lineitem), "
                                "o AS (SELECT " + ", ".join(f"{r(f'({c} - 128) * 1.3e0 + 128e0 + 12e0')} AS {c}" for c in "rgb") + " FROM q) SELECT r, g, b, count(*) AS n FROM o GROUP BY ALL")
O["p02_saturation"] = each(lambda c: r(f"{LUMA} + 1.4e0 * ({c} - {LUMA})"))
O["p03_gamma"] = each(lambda c: r(f"pow({c} / 255e0, 1e0 / 0.8e0) * 255e0"))
O["p04_white_balance"] = rgb(f"SELECT f, y, x, {r('r + 15e0')} AS r, {r('g - 5e0')} AS g, {r('b - 15e0')} AS b FROM rgb")
O["p05_vignette"] = each(lambda c: r(f"{c} * greatest(0e0, 1e0 - 0.6e0 * ((x - 4e0) * (x - 4e0) + (y - 4e0) * (y - 4e0)) / 32e0)"))
O["p06_film_grain"] = rgb("SELECT f, y, x, " + ", ".join(f"{r(f'{c} + noise')} AS {c}" for c in "rgb") + " FROM (SELECT *, ((h2 & 65535) / 65535e0 - 0.5e0) * 2e0 * 20e0 AS noise FROM "
                          "(SELECT *, (xor(h1, h1 >> 13) * 1274126177) & 4294967295 AS h2 FROM (SELECT *, (x::BIGINT * 374761393 + y::BIGINT * 668265263 + 42) & 4294967295 AS h1 FROM rgb)))")
O["p07_hdr_reinhard"] = each(lambda c: REINHARD(c, 120))
_ACES = {c: "(" + " + ".join(f"{k}e0 * ({s} / 255e0 * 100e0 / 150e0)" for k, s in zip(row, "rgb")) + ")" for c, row in {
    "r": (0.59719, 0.35458, 0.04823), "g": (0.07600, 0.90834, 0.01566), "b": (0.02840, 0.13383, 0.83777)}.items()}
O["p08_hdr_aces"] = each(lambda c: t(f"({_ACES[c]} * ({_ACES[c]} + 0.0245786e0) - 0.000090537e0) / ({_ACES[c]} * (0.983729e0 * {_ACES[c]} + 0.4329510e0) + 0.238081e0) * 255e0"))
LUTGRID = "grid AS (SELECT (i % 17)::INT AS ri, (i // 17 % 17)::INT AS gi, (i // 289)::INT AS bi FROM range(4913) s(i))"
_in = lambda c: f"({c}i / 16e0)"
_out = lambda e: r(unit(e) + " * 255e0")
_linear = lambda c, k, b: f"({_in(c)} * {k}e0 + {b}e0)"
_faded = {c: _linear(c, *k) for c, k in {"r": (0.95, 0.05), "g": (0.92, 0.04), "b": (0.85, 0.06)}.items()}
_grayed = f"(0.299e0 * {_faded['r']} + 0.587e0 * {_faded['g']} + 0.114e0 * {_faded['b']})"
O["p10_lut"] = (f"WITH {LUTGRID}, looks AS (SELECT ri, gi, bi, {_out(_in('r') + f' * 1.05e0 + CASE WHEN {_in('r')} > 0.5e0 THEN 0.03e0 ELSE -0.01e0 END')} AS r, {_out(_in('g') + ' * 0.98e0')} AS g, "
                f"{_out(_in('b') + f' * 1.08e0 + CASE WHEN {_in('b')} < 0.5e0 THEN 0.04e0 ELSE -0.01e0 END')} AS b, 'cinematic' AS preset FROM grid UNION ALL SELECT ri, gi, bi, "
                + ", ".join(_out(f"{_faded[c]} + ({_grayed} - {_faded[c]}) * 0.2e0") for c in "rgb")
                + ", 'vintage' FROM grid) SELECT c_custkey, preset, r, g, b FROM customer JOIN looks ON preset = CASE WHEN c_nationkey % 2 = 0 THEN 'cinematic' ELSE 'vintage' END AND ri = c_custkey % 17 AND gi = c_custkey * 3 % 17 AND bi = c_custkey * 7 % 17")
_cell = ", ".join(f"least(floor({c} / 255e0 * 16e0), 15)::INT AS {c}0, {c} / 255e0 * 16e0 - least(floor({c} / 255e0 * 16e0), 15) AS {c}f" for c in "rgb")
_weights = " * ".join(f"(CASE WHEN d{c} = 1 THEN {c}f ELSE 1e0 - {c}f END)" for c in "rgb")
O["p09_apply_lut"] = (f"WITH {COLOUR}, {LUTGRID}, lut AS (SELECT ri, gi, bi, {_out(_linear('r', 1.1, 0.02))} AS lr, {_out(_linear('g', 1.02, 0.01))} AS lg, {_out(_in('b') + ' * 0.9e0')} AS lb FROM grid), "
                      f"c AS (SELECT *, {_cell} FROM rgb), k AS (SELECT c.*, dr, dg, db, {_weights} AS w FROM c, range(2) a(dr), range(2) b(dg), range(2) d(db)), "
                      "s AS (SELECT f, y, x, k.r, k.g, k.b, sum(w * lr) AS sr, sum(w * lg) AS sg, sum(w * lb) AS sb FROM k JOIN lut ON ri = r0 + dr AND gi = g0 + dg AND bi = b0 + db GROUP BY ALL) "
                      "SELECT f, y, x, " + ", ".join(f"floor(least(255e0, greatest(0e0, {c} + 0.75e0 * (s{c} - {c}) + 0.5e0 + 1e-9)))::INT AS {c}" for c in "rgb") + " FROM s")
_half = "least(1e0, greatest(0e0, {}))".format
O["p11_chroma_key"] = rgb("""SELECT f, y, x, {R} AS r, {G} AS g, {B} AS b FROM (SELECT *, CASE WHEN m > 0.001e0 AND m < 0.999e0 THEN u * u * (3e0 - 2e0 * u) ELSE 1e0 - m END AS a FROM
 (SELECT *, least(1e0, greatest(0e0, (1e0 - m - 0.1e0) / 0.8e0)) AS u FROM (SELECT *, CASE WHEN h >= 60 AND h <= 160 AND s >= 0.3e0 AND hi >= 0.2e0 THEN
  least(1e0, greatest(0e0, (1e0 - least(abs(h - 110e0), 50e0) / 50e0) * least((s - 0.3e0) / 0.701e0, 1e0) * least((hi - 0.2e0) / 0.801e0, 1e0))) ELSE 0e0 END AS m FROM
 (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360e0 ELSE h0 END AS h, CASE WHEN hi > 0.001e0 THEN d / hi ELSE 0e0 END AS s FROM
 (SELECT *, CASE WHEN d <= 0.001e0 THEN 0e0 WHEN hi = fr THEN fmod((fg - fb) / d, 6e0) WHEN hi = fg THEN (fb - fr) / d + 2e0 ELSE (fr - fg) / d + 4e0 END * 60e0 AS h0 FROM
 (SELECT f, y, x, r / 255e0 AS fr, g / 255e0 AS fg, b / 255e0 AS fb, greatest(r, g, b) / 255e0 AS hi, greatest(r, g, b) / 255e0 - least(r, g, b) / 255e0 AS d FROM rgb))))))""".format(
    R=t("a * fr * 255e0"), G=t("a * greatest(fg - CASE WHEN m > 0.01e0 THEN greatest(fg - greatest(fr, fb), 0e0) * 0.3e0 * m ELSE 0e0 END, 0e0) * 255e0"), B=t("a * fb * 255e0")))
_a = "(x / 7e0)"
_u = unit(_a)
_s = f"({_u} * {_u} * (3e0 - 2e0 * {_u}))"
O["p12_composite"] = rgb(f"SELECT f, y, x, {r(f'{_s} * r + (1e0 - {_s}) * b')} AS r, {r(f'{_s} * g + (1e0 - {_s}) * g')} AS g, {r(f'{_s} * b + (1e0 - {_s}) * r')} AS b FROM rgb")
O["p13_blend"] = rgb("SELECT a.f, a.y, a.x, " + ", ".join(f"{r(f'0.7e0 * a.{c} + 0.3e0 * n.{c}')} AS {c}" for c in "rgb") + " FROM rgb a JOIN rgb n ON n.f = a.f + 1 AND n.y = a.y AND n.x = a.x")
O["p14_relight"] = each(lambda c: r(f"{c} * (least({r(LUMA)} + 30, 255) / greatest({r(LUMA)}, 1)::DOUBLE)"))
O["p15_depth_to_gray"] = gray(f"SELECT f, y, x, {t(unit('v / 200e0') + ' * 255e0')} AS v FROM gray")
O["p17_sigmoid"] = "SELECT event_id, floor(1e0 / (1e0 + exp(-(value / 50e0 - 1e0))) * 1e6)::BIGINT AS s FROM events"

# Geometry: g(w, h) is the grid of target cells of every frame.
FRAMES = ", fr AS (SELECT DISTINCT f FROM rgb)"


def cells(w: int, h: int) -> str:
    return f"(SELECT f, yy::INT AS y, xx::INT AS x FROM fr, range({h}) a(yy), range({w}) b(xx))"


def gathered(w: int, h: int, sx: str, sy: str, fill=(0, 0, 0), source: str = "rgb") -> str:
    cols = ", ".join(f"coalesce(p.{c}, {v}) AS {c}" for c, v in zip("rgb", fill))
    return f"SELECT c.f, c.y, c.x, {cols} FROM {cells(w, h)} c LEFT JOIN {source} p ON p.f = c.f AND p.x = {sx} AND p.y = {sy}"


geo = lambda body: f"WITH {COLOUR}{FRAMES} {body}"
O["g01_crop"] = geo(gathered(6, 5, "c.x + 4", "c.y + 2"))
O["g02_crop_planes"] = (f"WITH {COLOUR}{FRAMES}, p AS MATERIALIZED ({FULL}) SELECT c.f, 0 AS p, c.y, c.x, coalesce(p.v, 16) AS v FROM {cells(6, 6)} c LEFT JOIN p ON p.p = 0 AND p.f = c.f AND p.x = c.x + 4 AND p.y = c.y + 2 UNION ALL "
                        f"SELECT c.f, k, c.y, c.x, coalesce(p.v, 128) FROM {cells(3, 3)} c CROSS JOIN (VALUES (1), (2)) t(k) LEFT JOIN p ON p.p = k AND p.f = c.f AND p.x = c.x + 2 AND p.y = c.y + 1")
O["g03_pad"] = geo(gathered(12, 10, "c.x - 2", "c.y - 1", (10, 20, 30)))
O["g04_flip"] = rgb("SELECT f, 7 - y AS y, 7 - x AS x, r, g, b FROM rgb")
O["g05_translate"] = geo(gathered(8, 8, "c.x - 2", "c.y + 1"))
_d = "(1e0 + 0.2e0 * (((c.x - 4e0) / 4e0) * ((c.x - 4e0) / 4e0) + ((c.y - 4e0) / 4e0) * ((c.y - 4e0) / 4e0)))"
O["g06_lens"] = geo(gathered(8, 8, f"floor((c.x - 4e0) / 4e0 * {_d} * 4e0 + 4e0 + 0.5e0)", f"floor((c.y - 4e0) / 4e0 * {_d} * 4e0 + 4e0 + 0.5e0)"))
O["g10_resize_nearest"] = geo(gathered(5, 11, "c.x * 8 // 5", "c.y * 8 // 11"))
O["g12_crop_inside"] = rgb("SELECT f, y - 3 AS y, x - 2 AS x, r, g, b FROM rgb WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6")


def bilinear(sw: int, sh: int, dw: int, dh: int, source: str = "rgb") -> str:
    fx, fy = f"(c.x * ({sw}e0 / {dw}e0))", f"(c.y * ({sh}e0 / {dh}e0))"
    tap = lambda j, i: f"p{j}{i}"
    joins = " ".join(f"JOIN {source} p{j}{i} ON p{j}{i}.f = c.f AND p{j}{i}.y = least(floor({fy})::INT + {j}, {sh - 1}) AND p{j}{i}.x = least(floor({fx})::INT + {i}, {sw - 1})" for j in (0, 1) for i in (0, 1))
    wx, wy = f"({fx} - floor({fx}))", f"({fy} - floor({fy}))"
    cols = ", ".join(r(" + ".join(f"{tap(j, i)}.{c} * ({wx if i else f'(1e0 - {wx})'} * {wy if j else f'(1e0 - {wy})'})" for j in (0, 1) for i in (0, 1)) ) + f" AS {c}" for c in "rgb")
    return f"SELECT c.f, c.y, c.x, {cols} FROM {cells(dw, dh)} c {joins}"


O["g07_resize_bilinear"] = geo(bilinear(8, 8, 12, 6))
O["g13_zoom"] = f"WITH {COLOUR}{FRAMES}, z AS (SELECT f, y - 2 AS y, x - 2 AS x, r, g, b FROM rgb WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) {bilinear(4, 4, 8, 8, 'z')}"
_lx, _ly = "(c.x / 1.375e0)", "((c.y - 2.75e0) / 1.375e0)"
_lt = lambda j, i, c: f"p{j}{i}.{c} * ({f'({_lx} - floor({_lx}))' if i else f'(1e0 - ({_lx} - floor({_lx})))'} * {f'({_ly} - floor({_ly}))' if j else f'(1e0 - ({_ly} - floor({_ly})))'})"
O["g11_letterbox"] = (f"WITH {COLOUR}{FRAMES}, z AS (SELECT f, y - 2 AS y, x, r, g, b FROM rgb WHERE y BETWEEN 2 AND 5) SELECT c.f, c.y, c.x, "
                      + ", ".join(f"CASE WHEN p00.f IS NULL THEN 128 ELSE {r(' + '.join(_lt(j, i, c) for j in (0, 1) for i in (0, 1)))} END AS {c}" for c in "rgb") + f" FROM {cells(11, 11)} c "
                      + " ".join(f"LEFT JOIN z p{j}{i} ON p{j}{i}.f = c.f AND {_ly} >= 0 AND {_ly} < 4 AND p{j}{i}.y = least(floor({_ly})::INT + {j}, 3) AND p{j}{i}.x = least(floor({_lx})::INT + {i}, 7)" for j in (0, 1) for i in (0, 1)))
_cub = lambda tt: f"(CASE WHEN abs({tt}) <= 1 THEN (1.5e0 * abs({tt}) - 2.5e0) * abs({tt}) * abs({tt}) + 1e0 WHEN abs({tt}) < 2 THEN ((-0.5e0 * abs({tt}) + 2.5e0) * abs({tt}) - 4e0) * abs({tt}) + 2e0 ELSE 0e0 END)"
O["g08_resize_bicubic"] = (f"WITH {COLOUR}{FRAMES}, k AS (SELECT c.f, c.y, c.x, c.x * (8e0 / 12e0) AS fx, c.y * (8e0 / 6e0) AS fy, least(7, greatest(0, floor(c.x * (8e0 / 12e0))::INT + i)) AS sx, least(7, greatest(0, floor(c.y * (8e0 / 6e0))::INT + j)) AS sy "
                           f"FROM {cells(12, 6)} c, range(-1, 3) a(i), range(-1, 3) b(j)) SELECT k.f, k.y, k.x, " + ", ".join(f"{r(f'sum(p.{c} * {_cub('(fy - sy)')} * {_cub('(fx - sx)')})')} AS {c}" for c in "rgb")
                           + " FROM k JOIN rgb p ON p.f = k.f AND p.y = k.sy AND p.x = k.sx GROUP BY k.f, k.y, k.x")
def composed(p: str, tiles: str, tw: int, th: int, sw: int, sh: int, w: int, h: int) -> str:
    """(y, x, v) of a canvas with tiles (n, f, dx, dy) of tw by th over source `p` (f, y, x, v) of sw by sh."""
    fx, fy = f"(tx * {sw}e0 / {tw}e0)", f"(ty * {sh}e0 / {th}e0)"
    wt = lambda o, e: f"({e} - floor({e}))" if o else f"(1e0 - ({e} - floor({e})))"
    taps = " + ".join(f"q{j}{i}.v * ({wt(i, fx)} * {wt(j, fy)})" for j in (0, 1) for i in (0, 1))
    joins = " ".join(f"JOIN {p} q{j}{i} ON q{j}{i}.f = l.f AND q{j}{i}.y = least(floor({fy})::INT + {j}, {sh - 1}) AND q{j}{i}.x = least(floor({fx})::INT + {i}, {sw - 1})" for j in (0, 1) for i in (0, 1))
    hit = f"SELECT dy + ty AS y, dx + tx AS x, arg_max({r(taps)}, n) AS v FROM {tiles} l CROSS JOIN range({th}) a(ty) CROSS JOIN range({tw}) b(tx) {joins} GROUP BY ALL"
    return f"SELECT cy::INT AS y, cx::INT AS x, coalesce(v, 0) AS v FROM range({h}) e(cy) CROSS JOIN range({w}) g(cx) LEFT JOIN ({hit}) ON y = cy AND x = cx"


O["g14_compose"] = f"WITH {GRAY}, l AS (SELECT r_regionkey AS n, r_regionkey AS f, (r_regionkey % 3) * 10 AS dx, r_regionkey // 3 * 9 AS dy FROM region WHERE r_regionkey <> 2) {composed('gray', 'l', 12, 10, 8, 8, 30, 20)}"
_plane = lambda k, n: f"SELECT {k} AS p, y, x, v FROM ({composed(f'(SELECT * FROM p WHERE p = {k})', n, *((12, 10, 8, 8, 60, 50) if k == 0 else (6, 5, 4, 4, 30, 25)))})"
O["g14_compose_planes"] = (f"WITH {COLOUR}, p AS MATERIALIZED ({FULL}), l AS (SELECT n_nationkey AS n, n_nationkey * 3 AS f, (n_nationkey % 5) * 12 AS dx, n_nationkey // 5 * 10 AS dy FROM nation), "
                           f"l2 AS (SELECT n, f, dx // 2 AS dx, dy // 2 AS dy FROM l) {_plane(0, 'l')} UNION ALL {_plane(1, 'l2')} UNION ALL {_plane(2, 'l2')}")
O["g15_grid"] = ("SELECT n_nationkey, CASE WHEN k <= 1 THEN 1 WHEN k <= 4 THEN 2 WHEN k <= 9 THEN 3 ELSE 4 END::INT AS cols, CASE WHEN k <= 2 THEN 1 WHEN k <= 6 THEN 2 WHEN k <= 9 THEN 3 ELSE 4 END::INT AS rows FROM (SELECT n_nationkey, n_nationkey % 17 AS k FROM nation)")
O["g16_pip_box"] = ("SELECT p_partkey, bw AS box_w, bh AS box_h, w - bw - 12 AS box_x, h - bh - 12 AS box_y, w - bw - 12 >= 3 AND h - bh - 12 >= 3 AS ok FROM (SELECT *, least(320, greatest(96, w // 6 & ~1))::INT AS bw, least(240, greatest(72, h // 6 & ~1))::INT AS bh "
                    "FROM (SELECT p_partkey, (p_size * 47)::INT AS w, (p_partkey % 1500)::INT AS h FROM part))")
_col = (0, 180, 255)
O["g17_inset"] = geo("SELECT c.f, c.y, c.x, " + ", ".join(f"(CASE WHEN c.x BETWEEN 9 AND 13 AND c.y BETWEEN 9 AND 12 THEN i.{c} WHEN c.x BETWEEN 7 AND 15 AND c.y BETWEEN 7 AND 14 THEN {v} ELSE p.{c} END)::INT AS {c}" for c, v in zip("rgb", _col))
                     + f" FROM {cells(16, 16)} c JOIN rgb p ON p.f = c.f AND p.y = c.y // 2 AND p.x = c.x // 2 LEFT JOIN rgb i ON i.f = c.f AND i.x = (c.x - 9) * 8 // 5 AND i.y = (c.y - 9) * 8 // 4 AND c.x >= 9 AND c.y >= 9")
_box = "x BETWEEN f % 4 AND 6 AND y BETWEEN 1 AND 5 AND (x = f % 4 OR x = 6 OR y = 1 OR y = 5)"
_disc = "(x - 4) * (x - 4) + (y - f % 8) * (y - f % 8) <= 4"
O["g19_draw"] = rgb("SELECT f, y, x, " + ", ".join(f"(CASE WHEN {_disc} THEN {dv} WHEN {_box} THEN {bv} ELSE {c} END)::INT AS {c}" for c, bv, dv in zip("rgb", (255, 0, 0), (0, 255, 9))) + " FROM rgb")
O["g22_outline"] = rgb("SELECT f, y, x, " + ", ".join(f"(CASE WHEN x < 2 OR x >= 6 OR y < 2 OR y >= 6 THEN CASE WHEN f % 2 = 0 THEN {g} ELSE {a} END ELSE {c} END)::INT AS {c}" for c, g, a in zip("rgb", (0, 255, 0), (255, 191, 0))) + " FROM rgb")

# Neighbourhoods.
_w = "exp(-((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x)) / (2e0 * 15e0 * 15e0)) * exp(-((n.v - p.v) * (n.v - p.v)) / (2e0 * 25e0 * 25e0))"


def bilateral_of(radius: int) -> str:
    return (f"SELECT p.f, p.y, p.x, {r(f'sum({_w} * n.v) / sum({_w})')} AS v FROM gray p JOIN gray n ON n.f = p.f AND n.y BETWEEN p.y - {radius} AND p.y + {radius} AND n.x BETWEEN p.x - {radius} AND p.x + {radius} GROUP BY p.f, p.y, p.x")


O["n01_bilateral"] = O["n01_bilateral_planes"] = gray(bilateral_of(2))
_g = [math.exp(-(i * i) / 8.0) for i in range(-3, 4)]
_g = [x / sum(_g) for x in _g]
_k = "(VALUES " + ", ".join(f"({i - 3}, {x!r}::DOUBLE)" for i, x in enumerate(_g)) + ") k(d, w)"
O["n03_gaussian"] = (f"WITH {GRAY}, a AS (SELECT p.f, p.y, p.x, {r('sum(k.w * n.v)')} AS v FROM gray p, {_k}, gray n WHERE n.f = p.f AND n.y = p.y AND n.x = least(7, greatest(0, p.x + k.d)) GROUP BY p.f, p.y, p.x) "
                     f"SELECT p.f, p.y, p.x, {r('sum(k.w * n.v)')} AS v FROM a p, {_k}, a n WHERE n.f = p.f AND n.x = p.x AND n.y = least(7, greatest(0, p.y + k.d)) GROUP BY p.f, p.y, p.x")
O["n04_sharpen"] = gray(f"SELECT p.f, p.y, p.x, {r('any_value(p.v) + 1e0 * (any_value(p.v) - sum(n.v) / count(*)::DOUBLE)')} AS v FROM gray p JOIN gray n ON n.f = p.f AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY p.f, p.y, p.x")
_sx, _sy = "(VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) k(dy, dx, kx, ky)", ""
O["n05_edges"] = (f"WITH {COLOUR}, l AS (SELECT f, y, x, {LUMA} AS l FROM rgb), g AS (SELECT p.f, p.y, p.x, sum(kx * n.l) AS gx, sum(ky * n.l) AS gy FROM l p, {_sx}, l n WHERE n.f = p.f AND n.y = least(7, greatest(0, p.y + dy)) AND n.x = least(7, greatest(0, p.x + dx)) GROUP BY ALL), "
                  "m AS (SELECT f, y, x, floor(least(255e0, sqrt(gx * gx + gy * gy) + 1e-9))::INT AS m FROM g) SELECT f, y, x, m AS r, m AS g, m AS b FROM m")
_c30, _s30 = repr(math.cos(math.radians(30.0))), repr(math.sin(math.radians(30.0)))
O["n06_directional_blur"] = gray(f"SELECT p.f, p.y, p.x, {r('sum(n.v) / count(*)::DOUBLE')} AS v FROM gray p, range(-2, 3) k(k), gray n WHERE n.f = p.f AND n.x = trunc(p.x + {_c30}::DOUBLE * k + 0.5e0)::INT AND n.y = trunc(p.y + {_s30}::DOUBLE * k + 0.5e0)::INT GROUP BY p.f, p.y, p.x")


def motion(search: int) -> str:
    return (f"sad AS (SELECT p.f, (p.y // 4)::INT AS \"by\", (p.x // 4)::INT AS bx, dy, dx, sum(abs(p.v - n.v)) AS sad FROM gray p, range(-{search}, {search + 1}, 2) a(dy), range(-{search}, {search + 1}, 2) b(dx), gray n "
            "WHERE p.y % 4 % 2 = 0 AND p.x % 4 % 2 = 0 AND n.f = p.f - 1 AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY ALL), "
            "motion AS (SELECT f, \"by\", bx, dy::INT AS dy, dx::INT AS dx FROM (SELECT *, row_number() OVER (PARTITION BY f, \"by\", bx ORDER BY sad, dy, dx) AS k FROM sad) WHERE k = 1)")


O["n09_block_motion"] = f"WITH {GRAY}, {motion(2)} SELECT f, \"by\", bx, dy, dx FROM motion"
_mean = "mean AS (SELECT f, trunc(sum(dx) / count(*)::DOUBLE)::INT AS dx, trunc(sum(dy) / count(*)::DOUBLE)::INT AS dy FROM motion GROUP BY f)"
O["a05_mean_motion"] = f"WITH {GRAY}, {motion(2)}, {_mean} SELECT f, dx, dy FROM mean"
_way = lambda last, now: f"trunc(0.8e0 * {last} + (1 - 0.8e0) * {now})::INT"
O["t04_stabilise"] = (f"WITH RECURSIVE {GRAY}, {motion(4)}, {_mean}, o AS (SELECT *, f // 25 AS camera, row_number() OVER (PARTITION BY f // 25 ORDER BY f) AS k FROM mean), s AS (SELECT camera, k, f, {_way('0', 'dx')} AS sx, {_way('0', 'dy')} AS sy FROM o WHERE k = 1 UNION ALL "
                      f"SELECT o.camera, o.k, o.f, {_way('s.sx', 'o.dx')}, {_way('s.sy', 'o.dy')} FROM s JOIN o ON o.camera = s.camera AND o.k = s.k + 1) SELECT camera, f, sx, sy FROM s")

# Histograms.
def tiled(side: int, clip: float, source: str = "gray") -> str:
    """Common tables up to tab(f, ty, tx, v, cdf)."""
    return (f"cnt AS (SELECT f, (y // {side})::INT AS ty, (x // {side})::INT AS tx, v, count(*) AS n FROM {source} GROUP BY ALL), lim AS (SELECT f, ty, tx, sum(n)::DOUBLE / 256e0 * {clip}e0 AS m FROM cnt GROUP BY ALL), "
            "full_ AS (SELECT t.f, t.ty, t.tx, t.m, l::INT AS v, coalesce(c.n, 0)::DOUBLE AS n FROM lim t CROSS JOIN range(256) a(l) LEFT JOIN cnt c ON c.f = t.f AND c.ty = t.ty AND c.tx = t.tx AND c.v = l), "
            "bins AS (SELECT f, ty, tx, v, CASE WHEN n > m THEN floor(m) + floor(n - m)::INT // 256 + CASE WHEN v < floor(n - m)::INT % 256 THEN 1 ELSE 0 END ELSE n END AS n FROM full_), "
            "tab AS (SELECT f, ty, tx, v, floor(least(255e0, coalesce(sum(n) OVER (PARTITION BY f, ty, tx ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 255e0 / greatest(sum(n) OVER (PARTITION BY f, ty, tx), 1)) + 0.5e0)::INT AS cdf FROM bins)")


def levelled(source: str) -> str:
    """(f, y, x, v) of source through the tables of 4 by 4 tiles of an 8 by 8 frame."""
    w = lambda c, o: f"(CASE WHEN {o} = 1 THEN (g.{c} % 4) / 4e0 ELSE 1e0 - (g.{c} % 4) / 4e0 END)"
    return (f"SELECT c.f, c.y, c.x, {r('sum(k * cdf)')} AS v FROM (SELECT g.f, g.y, g.x, g.v, least(1, g.y // 4 + j) AS ty, least(1, g.x // 4 + i) AS tx, {w('y', 'j')} * {w('x', 'i')} AS k FROM {source} g, range(2) a(j), range(2) b(i)) c "
            "JOIN tab t ON t.f = c.f AND t.ty = c.ty AND t.tx = c.tx AND t.v = c.v GROUP BY c.f, c.y, c.x")
_sums = "SELECT f, ty, tx, count(*) AS n, sum(cdf)::BIGINT AS total, sum(cdf * v)::BIGINT AS weighed FROM tab GROUP BY f, ty, tx"
O["a01_tile_tables"] = f"WITH {GRAY}, {tiled(4, 3.0)} {_sums}"
O["a01_tile_tables_wide"] = f"WITH {GRAY}, {tiled(8, 12.0)} {_sums}"
O["a03_equalise"] = f"WITH {GRAY}, {tiled(4, 3.0)} {levelled('gray')}"
O["a03_equalise_rgb"] = (f"WITH {COLOUR}, lum AS (SELECT f, y, x, {r(LUMA)} AS v FROM rgb), {tiled(4, 40.0, 'lum')}, e AS ({levelled('lum')}) SELECT f, y, x, "
                         + ", ".join(f"{r(f'{c} * (e.v / greatest(lum.v, 1)::DOUBLE)')} AS {c}" for c in "rgb") + " FROM rgb JOIN lum USING (f, y, x) JOIN e USING (f, y, x)")
O["a03_equalise_planes"] = f"WITH {COLOUR}, p AS MATERIALIZED ({FULL}), lum AS (SELECT f, y, x, v FROM p WHERE p = 0), {tiled(4, 40.0, 'lum')} SELECT f, 0 AS p, y, x, v FROM ({levelled('lum')}) UNION ALL SELECT f, p, y, x, v FROM p WHERE p > 0"
O["a04_normalise_depth"] = gray("SELECT g.f, y, x, CASE WHEN v = 200 OR hi - lo <= 1e-6 THEN 0 ELSE floor((v / 7e0 - lo) / (hi - lo) * 1000e0 + 1e-7) END::INT AS d FROM gray g JOIN (SELECT f, min(v / 7e0) AS lo, max(v / 7e0) AS hi FROM gray WHERE v <> 200 GROUP BY f) e ON e.f = g.f")
_milli = lambda e: f"floor(({e}) * 1000e0 + 1e-6)::BIGINT"
O["a06_sampled_mean"] = gray(f"SELECT f, {_milli('avg(v)')} AS mean FROM gray WHERE (y * 8 + x) % 13 = 0 GROUP BY f")
O["a07_channel_stats"] = rgb(" UNION ALL ".join(f"SELECT f, '{c}' AS c, min({c}) AS lo, max({c}) AS hi, {_milli(f'avg({c})')} AS mean FROM rgb GROUP BY f" for c in "rgb"))
O["a08_mean_absolute_error"] = gray(f"SELECT a.f, {_milli('avg(abs(a.v - n.v))')} AS mae FROM gray a JOIN gray n ON n.f = a.f + 1 AND n.y = a.y AND n.x = a.x GROUP BY a.f")
_in25 = "x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5"
O["a09_matte_stats"] = gray("SELECT f, count(*) FILTER (v >= 128) AS mass, min(x) FILTER (v >= 128) AS x1, min(y) FILTER (v >= 128) AS y1, max(x) FILTER (v >= 128) AS x2, max(y) FILTER (v >= 128) AS y2, "
                            f"{_milli(f'avg(v) FILTER ({_in25})')} AS inside, {_milli(f'avg(v) FILTER (NOT ({_in25}))')} AS outside FROM gray GROUP BY f")
O["a10_throughput"] = "SELECT user_id, n, ms, CASE WHEN ms > 0 THEN floor(n * 1000e0 / ms * 1e6 + 1e-6)::BIGINT END AS ufps FROM (SELECT user_id, count(*) AS n, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000e0)::BIGINT AS ms FROM events GROUP BY user_id)"
O["a12_peak"] = "SELECT user_id, max(abs(value)) AS peak FROM events GROUP BY user_id"
O["flagship"] = (f"WITH {GRAY}, d AS ({bilateral_of(1)}), g AS (SELECT f, {r('(v - 128) * 1.2e0 + 128e0 + 20e0')} AS v FROM d), h AS (SELECT f, v, count(*) AS n FROM g GROUP BY f, v) "
                 "SELECT f, v, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, v)::INT AS rank FROM h) WHERE rank <= 5")

# Time.
O["t01_fir_denoise"] = gray("SELECT f, y, x, CASE WHEN lag(v) OVER w IS NULL THEN v ELSE floor(0.3e0 * lag(v) OVER w + 0.7e0 * v + 0.5e0)::INT END AS v FROM gray WINDOW w AS (PARTITION BY y, x ORDER BY f)")
O["t02_iir_denoise"] = f"WITH RECURSIVE {GRAY}, s AS (SELECT f, y, x, v FROM gray WHERE f = 0 UNION ALL SELECT g.f, g.y, g.x, floor(0.3e0 * s.v + 0.7e0 * g.v + 0.5e0)::INT FROM s JOIN gray g ON g.f = s.f + 1 AND g.y = s.y AND g.x = s.x) SELECT f, y, x, v FROM s"
O["t03_ring"] = gray("SELECT * FROM (SELECT f, y, x, " + ", ".join(f"lag(v, {4 - i}) OVER w AS v{i}" for i in range(5)) + " FROM gray WINDOW w AS (PARTITION BY y, x ORDER BY f)) WHERE v0 IS NOT NULL")
O["t05_interpolate"] = gray("SELECT 2 * f AS f, y, x, v FROM gray UNION ALL SELECT 2 * a.f + 1, a.y, a.x, floor(0.5e0 * a.v + 0.5e0 * n.v + 0.5e0)::INT FROM gray a JOIN gray n ON n.f = a.f + 1 AND n.y = a.y AND n.x = a.x")
O["t06_with_previous"] = gray("SELECT a.f, a.y, a.x, a.v, p.v AS previous FROM gray a JOIN gray p ON p.f = a.f - 1 AND p.y = a.y AND p.x = a.x")
STREAM = "st AS (SELECT user_id, floor(epoch_us(ts) / 1000e0)::BIGINT AS t_ms, event_id AS seq, event_type AS kind, floor(value)::INT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"
stm = lambda sql: f"WITH {STREAM} {sql}"
O["t08_every_nth"] = stm("SELECT user_id, seq, first_value(v) OVER (PARTITION BY user_id, (k - 1) // 3 ORDER BY k) AS cached FROM st")
O["t09_as_of"] = ("SELECT p.user_id, p.event_id, v.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts")


def folded(first: str, nxt: str, out: str) -> str:
    """A recursion over each user's rows in order: `first` and `nxt` list the state's columns, s is the state before row o."""
    return (f"WITH RECURSIVE {STREAM}, s AS (SELECT o.*, {first} FROM st o WHERE k = 1 UNION ALL SELECT o.*, {nxt} FROM s JOIN st o ON o.user_id = s.user_id AND o.k = s.k + 1) SELECT {out} FROM s")


O["t10_pace"] = folded("t_ms AS last_, true AS kept", "CASE WHEN o.t_ms - s.last_ >= 100000 THEN o.t_ms ELSE s.last_ END, o.t_ms - s.last_ >= 100000", "user_id, seq, t_ms, kept")
O["t11_hysteresis"] = folded("CASE WHEN v < 40 THEN 1 ELSE 0 END AS run, false AS on_", "CASE WHEN o.v < 40 THEN s.run + 1 ELSE 0 END, CASE WHEN o.v > 90 THEN false WHEN o.v < 40 AND s.run + 1 > 2 THEN true ELSE s.on_ END", 'user_id, seq, v, on_ AS "on"')
O["t12_quiet_runs"] = folded("CASE WHEN v <= 50 THEN 1 ELSE 0 END::BIGINT AS run", "CASE WHEN o.v <= 50 THEN s.run + 1 ELSE 0 END::BIGINT", "user_id, seq, run")
O["t14_display_order"] = stm("SELECT user_id, seq, k::INT AS display_no FROM st")
O["s15_fallback"] = "SELECT user_id, count(*) FILTER (gap > 500000) AS stale, count(*) AS n FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000e0 AS gap FROM events) GROUP BY user_id"

# Detection.
BOXES = ("bx AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS box, (l_partkey * 7 % 600)::INT AS x1, (l_suppkey * 13 % 440)::INT AS y1, "
         "(l_partkey * 7 % 600 + 20 + l_partkey % 160)::INT AS x2, (l_suppkey * 13 % 440 + 20 + l_orderkey % 120)::INT AS y2, floor(l_extendedprice * 100 + 0.5e0)::BIGINT AS score, l_linenumber AS cls FROM lineitem)")
box = lambda sql: f"WITH {BOXES} {sql}"
_iw, _ih = "(least(a.x2, b.x2) - greatest(a.x1, b.x1))", "(least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_iou = f"CASE WHEN {_iw} <= 0 OR {_ih} <= 0 THEN 0e0 ELSE ({_iw} * {_ih})::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_iw} * {_ih}) END"
O["m14_iou"] = box(f"SELECT a.frame, a.box AS p, b.box AS q, floor(({_iou}) * 1e6 + 1e-6)::BIGINT AS iou FROM bx a JOIN bx b ON b.frame = a.frame AND a.box < b.box")
O["m01_best_class"] = box("SELECT frame, cls, score FROM (SELECT frame, cls, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, cls) AS k FROM bx) WHERE k = 1 AND score >= 2000000")
O["m01_unletterbox"] = box("SELECT * FROM (SELECT frame, box, " + ", ".join(f"least({m}e0, greatest(0e0, ({c}::DOUBLE - {p}e0) / 0.5e0)) AS {c}" for c, p, m in (("x1", 0, 640), ("y1", 80, 480), ("x2", 0, 640), ("y2", 80, 480))) + " FROM bx) WHERE x2 > x1 AND y2 > y1")
O["m02_point_priors"] = ("SELECT stride::INT AS stride, i::INT AS i, event_id, (i % (64 // stride) + 0.5e0) * stride AS px, (i // (64 // stride) + 0.5e0) * stride AS py FROM "
                         "(SELECT event_id, [8, 16, 32][event_id % 3 + 1] AS stride, user_id % 16 AS i FROM events) WHERE i < (64 // stride) * (64 // stride)")
O["m04_eye_windows"] = box("SELECT frame, box, e::INT AS eye, floor((x1 + (CASE WHEN e = 0 THEN 0.3e0 ELSE 0.7e0 END) * (x2 - x1)) * 100 + 1e-6)::BIGINT AS cx, floor((y1 + 0.42e0 * (y2 - y1)) * 100 + 1e-6)::BIGINT AS cy, floor(greatest(6e0, 0.16e0 * (x2 - x1)) * 100 + 1e-6)::BIGINT AS radius FROM bx, range(2) t(e)")
O["m13_label_place"] = box("SELECT frame, box, (CASE WHEN y1 >= 12 THEN y1 - 12 WHEN y2 + 12 <= 480 THEN y2 ELSE 0 END)::INT AS at FROM bx")
O["m15_suppress"] = (f"WITH RECURSIVE {BOXES}, o AS (SELECT frame, box, x1 % 100 AS x1, y1, x1 % 100 + 150 AS x2, y2, score, cls, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box) AS k FROM bx), "
                     "s AS (SELECT frame, 1 AS k, [{'box': box, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score, 'cls': cls}] AS kept FROM o WHERE k = 1 UNION ALL "
                     "SELECT b.frame, b.k, CASE WHEN len(s.kept) >= 5 OR len(list_filter(s.kept, lambda a: (" + _iou + ") > 0.45e0)) > 0 THEN s.kept ELSE list_append(s.kept, {'box': b.box, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'score': b.score, 'cls': b.cls}) END FROM s JOIN o b ON b.frame = s.frame AND b.k = s.k + 1), "
                     "last_ AS (SELECT frame, arg_max(kept, k) AS kept FROM s GROUP BY frame), u AS (SELECT frame, unnest(range(len(kept)))::INT AS rank, unnest(kept) AS b FROM last_) SELECT frame, b.box AS box, rank, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.score AS score, b.cls AS cls FROM u")

# Events.
HANDS = "hd AS (SELECT vec_id AS hand, j::INT AS joint, floor((embedding[j + 1]::DOUBLE + 0.6e0) * 500)::INT AS x, floor((embedding[j + 22]::DOUBLE + 0.6e0) * 500)::INT AS y FROM embeddings, range(21) t(j))"
_dd = "(SELECT a.hand, a.joint, (a.x - w.x) * (a.x - w.x) + (a.y - w.y) * (a.y - w.y) AS d FROM hd a JOIN hd w ON w.hand = a.hand AND w.joint = 0)"
_open = lambda tip, mid, k: f"max(d) FILTER (joint = {tip}) > {k} * max(d) FILTER (joint = {mid})"
O["e01_gesture"] = (f"WITH {HANDS}, q AS (SELECT hand, {_open(8, 6, '1.21e0')} AS a, {_open(12, 10, '1.21e0')} AS b, {_open(16, 14, '1.21e0')} AS c, {_open(20, 18, '1.21e0')} AS d, {_open(4, 3, '1.32e0')} AS th FROM {_dd} GROUP BY hand) "
                    "SELECT hand, CASE WHEN a AND b AND c AND d THEN 'palm' WHEN NOT (a OR b OR c OR d) THEN CASE WHEN th THEN 'thumb' ELSE 'fist' END WHEN a AND b AND NOT c AND NOT d THEN 'peace' ELSE 'none' END AS gesture FROM q")
_pt = lambda j, c: f"max({c}) FILTER (joint = {j})"
O["e14_hand_shape"] = (f"WITH {HANDS}, q AS (SELECT hand, {_milli('sum(x) FILTER (joint IN (5, 9, 13, 17)) / 4e0')} AS cx, {_milli('sum(y) FILTER (joint IN (5, 9, 13, 17)) / 4e0')} AS cy, "
                       f"{_milli(f'sqrt(pow({_pt(4, 'x')} - {_pt(8, 'x')}, 2) + pow({_pt(4, 'y')} - {_pt(8, 'y')}, 2)) / greatest(sqrt(pow({_pt(0, 'x')} - {_pt(9, 'x')}, 2) + pow({_pt(0, 'y')} - {_pt(9, 'y')}, 2)), 1e0)')} AS pinch FROM hd GROUP BY hand), "
                       f"o AS (SELECT hand, {_open(8, 6, '1.21e0')} AND NOT {_open(12, 10, '1.21e0')} AND NOT {_open(16, 14, '1.21e0')} AND NOT {_open(20, 18, '1.21e0')} AS pointing FROM {_dd} GROUP BY hand) SELECT hand, cx, cy, pinch, pointing FROM q JOIN o USING (hand)")
O["e02_best_hand"] = box("SELECT frame, hand, score FROM (SELECT frame, box AS hand, score % 1000 / 1000e0 AS score, row_number() OVER (PARTITION BY frame ORDER BY score % 1000 DESC, box) AS k FROM bx) WHERE k = 1 AND score > 0.5e0")
O["e03_holds"] = stm("SELECT user_id, no, min(kind) AS kind, min(t_ms) AS start, max(t_ms) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k)::BIGINT AS no FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY k) AS p FROM st)) GROUP BY user_id, no")
_need = "CASE o.kind WHEN 'click' THEN 1 WHEN 'view' THEN 60000 END"
_since = "(CASE WHEN o.kind = s.kind THEN s.since ELSE o.t_ms END)"
_fire = f"coalesce(o.t_ms - {_since} >= {_need} AND (s.last_ IS NULL OR o.t_ms - s.last_ >= 3600000), false)"
O["e03_gesture_actions"] = folded("t_ms AS since, NULL::BIGINT AS last_, NULL::VARCHAR AS action", f"CASE WHEN {_fire} THEN o.t_ms ELSE {_since} END, CASE WHEN {_fire} THEN o.t_ms ELSE s.last_ END, CASE WHEN {_fire} THEN o.kind END", "user_id, seq, action")
O["e04_segments"] = folded("0 AS seg, 1 AS n", "s.seg + CASE WHEN (s.n >= 5 AND o.kind = 'view') OR s.n >= 9 THEN 1 ELSE 0 END, CASE WHEN (s.n >= 5 AND o.kind = 'view') OR s.n >= 9 THEN 1 ELSE s.n + 1 END", "user_id, seq, kind = 'view' AS idr, seg::INT AS segment")
_spans = "spans AS (SELECT user_id, min(seq) AS start_, end_ FROM (SELECT c.user_id, c.seq, (SELECT min(i.seq) FROM st i WHERE i.user_id = c.user_id AND i.kind = 'view' AND i.seq > c.seq) AS end_ FROM st c WHERE c.kind = 'error') GROUP BY user_id, end_)"
O["e05_cut_spans"] = f"WITH {STREAM}, {_spans} SELECT user_id, start_ AS start, coalesce(end_, -1) AS \"end\" FROM spans"
O["e10_without_spans"] = f"WITH {STREAM}, {_spans} SELECT user_id, seq FROM st WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM spans WHERE spans.user_id = st.user_id AND seq >= start_ AND (end_ IS NULL OR seq < end_))"
O["e06_last_kept"] = stm("SELECT user_id, max(seq) AS seq, arg_max(v, seq) AS v FROM st WHERE kind = 'view' GROUP BY user_id")
O["e07_marks"] = stm("SELECT user_id, seq, 'mark ' || row_number() OVER (PARTITION BY user_id ORDER BY seq) AS label FROM st WHERE kind = 'purchase'")
O["e07_paused"] = stm("SELECT user_id, seq, count(*) FILTER (kind = 'signup') OVER (PARTITION BY user_id ORDER BY seq) % 2 = 1 AS paused FROM st")
O["e08_long_enough"] = stm("SELECT user_id, kind, count(*) AS n FROM st GROUP BY user_id, kind HAVING count(*) >= 10")
O["e11_measured_fps"] = stm("SELECT user_id, CASE WHEN s > 0.5e0 THEN least(60, greatest(5, floor(n / s + 0.5e0))) ELSE 30 END::INT AS fps FROM (SELECT user_id, count(*) AS n, (max(seq) - min(seq)) / 400e0 AS s FROM st GROUP BY user_id)")
O["e12_voice_gain"] = "SELECT event_id, floor((CASE WHEN -value > -50 THEN least(30e0, greatest(0e0, -20e0 + value)) ELSE 0e0 END) * 1000)::BIGINT AS gain FROM events"
O["e13_debounce"] = folded("v > 50 AS prev, false AS on_, CASE WHEN v > 50 THEN 0 ELSE 0 END AS edge", "o.v > 50, CASE WHEN (o.v > 50) = s.prev THEN o.v > 50 ELSE s.on_ END, CASE WHEN (o.v > 50) = s.prev THEN (o.v > 50)::INT - s.on_::INT ELSE 0 END", "user_id, seq, edge::INT AS edge")
_aim = lambda o: f"least(1e0, greatest(0e0, CASE WHEN abs(({o}v / 128e0 - 0.375e0) * 1.5e0) < 0.0625e0 THEN 0.5e0 ELSE ({o}v / 128e0 - 0.375e0) * 1.5e0 + 0.5e0 END))"
O["e16_smooth_aim"] = folded(f"{_aim('')} AS aim", f"s.aim + ({_aim('o.')} - s.aim) * 0.5e0", "user_id, seq, floor(aim * 1000e0 + 1e-6)::BIGINT AS aim")
_moved = "((o.v - s.v) / 128e0 * 1.5e0 * 2e0)"
O["e16_relative_aim"] = folded("0.5e0 AS aim", f"least(1e0, greatest(0e0, s.aim + CASE WHEN abs({_moved}) < 0.0625e0 * 0.2e0 THEN 0e0 ELSE {_moved} END * 0.5e0))", "user_id, seq, floor(aim * 1000e0 + 1e-6)::BIGINT AS aim")
_up = "coalesce(o.h3 / 100e0 - o.v / 100e0 > 0.185e0, false)"
O["e17_flicks"] = folded("NULL::BIGINT AS last_, false AS hit", f"CASE WHEN {_up} AND (s.last_ IS NULL OR o.t_ms - s.last_ > 800000) THEN o.t_ms ELSE s.last_ END, {_up} AND (s.last_ IS NULL OR o.t_ms - s.last_ > 800000)", "user_id, seq, hit AS flick").replace(
    ", s AS (", ", st3 AS (SELECT *, lag(v, 3) OVER (PARTITION BY user_id ORDER BY k) AS h3 FROM st), s AS (").replace("FROM st o", "FROM st3 o").replace("JOIN st o", "JOIN st3 o")
O["e19_zones"] = "SELECT event_id, CASE WHEN value / 100e0 - 0.5e0 < -0.25e0 THEN 'left' WHEN value / 100e0 - 0.5e0 > 0.25e0 THEN 'right' ELSE 'still' END AS zone, CASE WHEN value / 200e0 - 0.2e0 < -0.08e0 THEN 'left' WHEN value / 200e0 - 0.2e0 > 0.08e0 THEN 'right' ELSE 'none' END AS lean FROM events"
O["e20_hits"] = stm("SELECT a.user_id, a.seq AS shot, min(b.seq) AS target FROM st a JOIN st b ON b.user_id = a.user_id AND a.kind = 'click' AND b.kind = 'purchase' AND (a.v - b.v) * (a.v - b.v) + (a.seq % 100 - b.seq * 7 % 100) * (a.seq % 100 - b.seq * 7 % 100) <= 400 GROUP BY a.user_id, a.seq")
O["e21_window_matches"] = "SELECT p_partkey, contains(lower(p_name), 'a') AND p_name <> 'self' AS ok FROM part"
O["e22_spawn"] = ("WITH RECURSIVE s AS (SELECT c_custkey, 0 AS i, (c_custkey * 1103515245 + 12345) % 4294967296 AS n FROM customer UNION ALL SELECT c_custkey, i + 1, (n * 1103515245 + 12345) % 4294967296 FROM s WHERE i < 3) "
                  "SELECT c_custkey, i, n // 65536 % [800, 650, 2, 500][i + 1] AS n FROM s")
O["e23_bitrate"] = "SELECT p_partkey, floor(least(50000e0, greatest(500e0, p_size * 40e0 * (p_size * 22e0) * 30e0 * 0.07e0 / 1000e0)))::INT AS kbps FROM part"

# Sources.
_sized = "(SELECT s_suppkey AS f, 4 + 2 * (s_nationkey % 7) AS w, 2 + 2 * (s_nationkey % 3) AS h FROM supplier)"
_cells = lambda k=1: f"{_sized}, range(6 // {k}) b(y), range(16 // {k}) c(x) WHERE y < h // {k} AND x < w // {k}"
O["s13_pattern"] = f"SELECT f, y::INT AS y, x::INT AS x, ((x + y) & 255)::INT AS v FROM {_cells()}"
_bar = {"r": "[255, 255, 0, 0, 255, 255, 0]", "g": "[255, 255, 255, 255, 0, 0, 0]", "b": "[255, 0, 255, 0, 255, 0, 255]"}
O["s14_bars"] = "SELECT f, y::INT AS y, x::INT AS x, " + ", ".join(f"{v}[((x + f * 4) * 7 // w) % 7 + 1]::INT AS {c}" for c, v in _bar.items()) + f" FROM {_cells()}"
O["s21_pcm16"] = "SELECT event_id, trunc(least(1e0, greatest(-1e0, value / 100e0 * 0.7e0)) * 32767)::INT AS sample FROM events"
O["s22_edit_list"] = "SELECT type, event_id AS frame, printf('%.2f', event_id / 30e0) AS time_s, label FROM events JOIN (VALUES ('view', 'segment', 'take'), ('error', 'cut', 'cut'), ('purchase', 'mark', 'mark')) k(event_type, type, label) USING (event_type)"
O["s27_probe"] = "SELECT p_partkey, p_size * 16 AS width, p_size * 9 AS height, CASE p_partkey % 3 WHEN 0 THEN 33 WHEN 1 THEN 35 ELSE 49 END::INT AS codec FROM part"

# Plans.
O["x01_file_chain"] = ("WITH " + COLOUR + ", a AS (SELECT f, y - 1 AS y, x - 1 AS x, " + ", ".join(f"{r(f'{LUMA} + 1.2e0 * ({c} - {LUMA})')} AS {c}" for c in "rgb") + " FROM rgb WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) "
                       "SELECT f, y, 5 - x AS x, " + ", ".join(f"{r(f'pow({c} / 255e0, 1e0 / 0.9e0) * 255e0')} AS {c}" for c in "rgb") + " FROM a")
O["s24_batch_matrix"] = rgb(f"SELECT 'plain' AS config, f, y, x, r, g, b FROM rgb UNION ALL SELECT 'warm', f, y, x, {r('r + 12e0')}, {r('g + 2e0')}, {r('b - 12e0')} FROM rgb UNION ALL SELECT 'flipped', f, y, 7 - x, r, g, b FROM rgb UNION ALL SELECT 'small', f, y // 4, x // 2, r, g, b FROM rgb WHERE y % 4 = 0 AND x % 2 = 0")

# Rules without a table of their own above.
_dx, _dy = "(v / 32e0 - 4e0)", "(x / 2e0 - 1.7e0)"
_level = {"v": "floor(val)::INT", "q": "floor(val * (1e0 - sat))::INT", "t": "floor(val * sat * (h6 - floor(h6)))::INT"}
O["p16_flow_to_rgb"] = gray("SELECT f, y, x, " + ", ".join("CASE floor(h6)::INT % 6 " + " ".join(f"WHEN {n} THEN {_level[s[c]]}" for n, s in enumerate(("vtq", "tvq", "qvt", "qtv", "tqv", "vqt"))) + f" END AS {'rgb'[c]}" for c in range(3))
                            + f" FROM (SELECT f, y, x, least(mag / 6e0, 1e0) AS sat, least(30e0 * mag, 255e0) AS val, h6 FROM (SELECT f, y, x, sqrt({_dx} * {_dx} + {_dy} * {_dy}) AS mag, (atan2({_dy}, {_dx}) / 3.14159265e0 + 1e0) / 2e0 * 6e0 AS h6 FROM gray))")
_far = "greatest(0e0, least(1e0, (sqrt(pow((c.x - 4e0) / 4e0, 2) + pow((c.y - 4e0) / 4e0, 2)) - 0.3e0) / 0.701e0))"
_wide = "greatest(0.1e0, 2e0 * pow(8e0 * (1e0 - c.focus), 2))"
O["n07_background_blur"] = gray("SELECT f, y, x, floor(focus * v + (1e0 - focus) * top / bottom + 1e-9)::INT AS v FROM (SELECT c.f, c.y, c.x, any_value(c.v) AS v, any_value(c.focus) AS focus, "
                                f"sum(exp(-(j * j + i * i) / {_wide}) * p.v) AS top, sum(exp(-(j * j + i * i) / {_wide})) AS bottom "
                                f"FROM (SELECT c.*, (1e0 - {_far}) * (1e0 - {_far}) AS focus FROM gray c) c, range(-15, 16) a(j), range(-15, 16) b(i), gray p WHERE p.f = c.f AND p.y = least(7, greatest(0, c.y + j)) AND p.x = least(7, greatest(0, c.x + i)) "
                                "AND greatest(abs(j), abs(i)) <= least(15, greatest(1, floor(24e0 * (1e0 - c.focus)))) GROUP BY c.f, c.y, c.x)")
_names = "['person', 'bicycle', 'car', 'motorcycle', 'airplane', 'bus', 'train', 'truck', 'boat', 'traffic light', 'fire hydrant', 'stop sign', 'parking meter', 'bench', 'bird', 'cat', 'dog', 'horse', 'sheep', 'cow', 'elephant', 'bear', 'zebra', 'giraffe', 'backpack', 'umbrella', 'handbag', 'tie', 'suitcase', 'frisbee', 'skis', 'snowboard', 'sports ball', 'kite', 'baseball bat', 'baseball glove', 'skateboard', 'surfboard', 'tennis racket', 'bottle', 'wine glass', 'cup', 'fork', 'knife', 'spoon', 'bowl', 'banana', 'apple', 'sandwich', 'orange', 'broccoli', 'carrot', 'hot dog', 'pizza', 'donut', 'cake', 'chair', 'couch', 'potted plant', 'bed', 'dining table', 'toilet', 'tv', 'laptop', 'mouse', 'remote', 'keyboard', 'cell phone', 'microwave', 'oven', 'toaster', 'sink', 'refrigerator', 'book', 'clock', 'vase', 'scissors', 'teddy bear', 'hair drier', 'toothbrush']"
O["m12_with_class"] = box(f"SELECT frame, box, cls, CASE WHEN cls BETWEEN 0 AND 79 THEN {_names}[cls + 1] ELSE '?' END AS class_name, " + ", ".join(f"(80 + greatest(cls, 0) * {k} % 176)::INT AS {c}" for c, k in (("cr", 149), ("cg", 97), ("cb", 61))) + " FROM (SELECT frame, box, (cls * 13 % 90 - 2)::INT AS cls FROM bx)")
_to = lambda c, dead: f"CASE WHEN s.{c} IS NULL THEN o.t{c} WHEN abs(o.t{c} - s.{c}) < {dead} THEN s.{c} ELSE s.{c} + (o.t{c} - s.{c}) * 0.12e0 END"
_held = lambda c, e: f"CASE WHEN o.tx IS NULL THEN s.{c} ELSE {e} END"
_win, _hin = f"least({_to('w', 4)}, 640e0)", f"least({_to('h', 4)}, 480e0)"
_even = lambda c: f"(floor(floor({c}) / 2e0) * 2)::INT"
_shown = f"tx IS NOT NULL AND {_even('w')} >= 16 AND {_even('h')} >= 16"
O["t07_auto_frame"] = box(f"SELECT frame % 50 AS camera, frame AS f, CASE WHEN {_shown} THEN floor(x)::INT ELSE 0 END AS \"left\", CASE WHEN {_shown} THEN floor(y)::INT ELSE 0 END AS top, CASE WHEN {_shown} THEN {_even('w')} ELSE 640 END AS w, CASE WHEN {_shown} THEN {_even('h')} ELSE 480 END AS h FROM s").replace("WITH ", "WITH RECURSIVE ", 1)
_best = ("best AS (SELECT frame, CASE WHEN sc > 400 THEN (x1 + x2) / 2e0 - tw / 2e0 END AS tx, CASE WHEN sc > 400 THEN (y1 + y2) / 2e0 - 0.1e0 * th - th / 2e0 END AS ty, tw, th, row_number() OVER (PARTITION BY frame % 50 ORDER BY frame) AS k FROM "
         "(SELECT *, least((x2 - x1) * 2e0, 640e0) AS tw, least((y2 - y1) * 2e0, 480e0) AS th FROM (SELECT *, score % 1000 AS sc, row_number() OVER (PARTITION BY frame ORDER BY score % 1000 DESC, x1, y1) AS no FROM bx) WHERE no = 1)), "
         f"s AS (SELECT o.*, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS w, NULL::DOUBLE AS h FROM (SELECT DISTINCT frame % 50 AS frame, NULL::DOUBLE AS tx, NULL::DOUBLE AS ty, NULL::DOUBLE AS tw, NULL::DOUBLE AS th, 0::BIGINT AS k FROM bx) o UNION ALL "
         f"SELECT o.*, {_held('x', f'least(greatest({_to('x', 5)}, 0e0), 640e0 - {_win})')}, {_held('y', f'least(greatest({_to('y', 5)}, 0e0), 480e0 - {_hin})')}, {_held('w', _win)}, {_held('h', _hin)} FROM s JOIN best o ON o.frame % 50 = s.frame % 50 AND o.k = s.k + 1)")
O["t07_auto_frame"] = O["t07_auto_frame"].replace(" SELECT frame % 50 AS camera", f", {_best} SELECT frame % 50 AS camera", 1) + " WHERE k > 0"
_bare = "regexp_split_to_array(url, '[?#]')[1]"
_ext = rf"lower(regexp_extract({_bare}, '(\.[^./\\]+)$', 1))"
O["s03_extension"] = f"SELECT page_id, ext, CASE WHEN ext IN ('.mp4', '.mov', '.m4v') THEN 'mp4' WHEN ext IN ('.mkv', '.webm', '.ivf') THEN 'mkv' ELSE 'raw' END AS container FROM (SELECT page_id, {_ext} AS ext FROM pages)"
_pieces = ("SELECT doc_id AS id, no - 1 AS no, piece FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS no FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^ -~]', '#', 'g'), 'e ')[2:], lambda x: x <> '') AS p FROM documents))")
O["s04_units"] = f"SELECT id, no::INT AS no, (ascii(piece) & 31)::INT AS type, (ascii(piece) & 31) BETWEEN 1 AND 5 AS is_vcl, length(piece)::INT AS n FROM ({_pieces})"
O["s05_vcl"] = f"SELECT id, count(*) AS n, sum(length(piece))::BIGINT AS bytes FROM ({_pieces}) WHERE (ascii(piece) & 31) BETWEEN 1 AND 5 GROUP BY id"
_soft = ", ".join(f"CASE WHEN lag({c}) OVER w IS NULL THEN {c} ELSE {r(f'0.25e0 * lag({c}) OVER w + 0.75e0 * {c}')} END AS {c}" for c in "rgb")
_bright = ", ".join(f"{r(f'({c} - 128) * 1.1e0 + 128e0')} AS {c}" for c in "rgb")
O["x02_live_chain"] = (f"WITH {COLOUR}, soft AS (SELECT f, y, x, {_soft} FROM rgb WINDOW w AS (PARTITION BY f // 25, y, x ORDER BY f)), bright AS (SELECT f, y, x, {_bright} FROM soft) "
                       + O["p06_film_grain"].removeprefix(f"WITH {COLOUR} ").replace("FROM rgb", "FROM bright"))

# Planes, flow, eyes and text.
_BARS = "[[180, 168, 133, 87, 105, 63, 29, 16], [128, 44, 29, 217, 120, 166, 154, 128], [128, 136, 177, 146, 176, 88, 29, 128]]"
_bar8 = lambda p, k: f"SELECT f, {p} AS p, y::INT AS y, x::INT AS x, {_BARS}[{p} + 1][((x * {k} + f * 4) * 8 // w) % 8 + 1]::INT AS v FROM {_cells(k)}"
O["s14_bars_planes"] = f"{_bar8(0, 1)} UNION ALL {_bar8(1, 2)} UNION ALL {_bar8(2, 2)}"


def resized_plane(p: int, sw: int, sh: int, dw: int, dh: int, cubic: bool) -> str:
    lo, hi = (-1, 3) if cubic else (0, 2)
    near = lambda e, most: f"least({most}, greatest(0, floor({e})::INT + {{}}))"
    fx, fy = f"(xx * ({sw}e0 / {dw}e0))", f"(yy * ({sh}e0 / {dh}e0))"
    part = lambda e, o: f"(CASE WHEN {o} = 1 THEN {e} - floor({e}) ELSE 1e0 - ({e} - floor({e})) END)"
    wt = f"{_cub('(fy - sy)')} * {_cub('(fx - sx)')}" if cubic else f"{part('fx', 'i')} * {part('fy', 'j')}"
    return (f"SELECT k.f, {p} AS p, k.y, k.x, {r(f'sum(q.v * ({wt}))')} AS v FROM (SELECT f, yy::INT AS y, xx::INT AS x, {fx} AS fx, {fy} AS fy, i, j, {near(fx, sw - 1).format('i')} AS sx, {near(fy, sh - 1).format('j')} AS sy "
            f"FROM fr, range({dh}) a(yy), range({dw}) b(xx), range({lo}, {hi}) e(i), range({lo}, {hi}) g(j)) k JOIN p q ON q.p = {p} AND q.f = k.f AND q.y = k.sy AND q.x = k.sx GROUP BY k.f, k.y, k.x")


for _name, _cubic in (("g09_resize_planes", False), ("g09_resize_planes_cubic", True)):
    O[_name] = f"WITH {COLOUR}{FRAMES}, p AS MATERIALIZED ({FULL}) " + " UNION ALL ".join(resized_plane(p, 8 // k, 8 // k, 12 // k, 6 // k, _cubic) for p, k in ((0, 1), (1, 2), (2, 2)))
O["m07_resize_flow"] = gray("SELECT c.f, yy::INT AS y, xx::INT AS x, g.v / 8e0 * (12e0 / 8e0) AS dx, (g.x - 4e0) * (4e0 / 8e0) AS dy FROM (SELECT DISTINCT f FROM gray) c, range(4) a(yy), range(12) b(xx), gray g WHERE g.f = c.f AND g.y = yy * 8 // 4 AND g.x = xx * 8 // 12")


def eye_pass(source: str, n: int) -> str:
    """Pixels of `source` with eye n (at column 4 n + 2, row 4, radius 3) drawn back."""
    rim = f"sqrt(pow((p.x - {4 * n + 2}) / 3e0, 2) + pow((p.y - 4) / 3e0, 2))"
    at = lambda c, g: f"least(7e0, greatest(0e0, {c} + {g} * 0.45e0 * 0.8e0 * 3e0 * (1e0 - rim * rim * (3e0 - 2e0 * rim))))"
    part = lambda e, o: f"({e} - floor({e}))" if o else f"(1e0 - ({e} - floor({e})))"
    mix = lambda c: " + ".join(f"q{j}{i}.{c} * ({part('sx', i)} * {part('sy', j)})" for j in (0, 1) for i in (0, 1))
    joins = " ".join(f"JOIN {source} q{j}{i} ON q{j}{i}.f = p.f AND q{j}{i}.y = least(floor(sy)::INT + {j}, 7) AND q{j}{i}.x = least(floor(sx)::INT + {i}, 7)" for j in (0, 1) for i in (0, 1))
    return (f"SELECT p.f, p.y, p.x, " + ", ".join(f"CASE WHEN inside THEN {r(mix(c))} ELSE p.{c} END AS {c}" for c in "rgb")
            + f" FROM (SELECT *, {at('x', '(f % 3 - 1e0)')} AS sx, {at('y', '0.5e0')} AS sy, rim < 1 AND f % 5 <> 0 AS inside FROM (SELECT p.*, {rim} AS rim FROM {source} p)) p {joins}")


O["g18_redirect_eyes"] = f"WITH {COLOUR}, one AS ({eye_pass('rgb', 0)}) {eye_pass('one', 1)}"
_glyphs = "glyphs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {list(rows)})" for c, rows in FONT.items()) + ") t(c, rows_))"


def lettered(texts: str, scale: int) -> str:
    """(f, y, x, dot): cells of texts(f, x0, y0, text) by pixel."""
    wide = 3 * scale + 1
    return (f"{_glyphs}, letters AS (SELECT f, x0, y0, i, upper(text[i::INT]) AS c FROM ({texts}), range(1, 64) t(i) WHERE i <= length(text)), "
            f"ink AS (SELECT f, (y0 + py)::INT AS y, (x0 + (i - 1) * {wide} + px)::INT AS x, px // {scale} < 3 AND (coalesce(rows_, [0, 0, 0, 0, 0])[(py // {scale} + 1)::INT]::INT >> greatest(0, 2 - px // {scale})::INT) & 1 = 1 AS dot "
            f"FROM letters LEFT JOIN glyphs USING (c), range({5 * scale}) a(py), range({wide}) b(px))")


O["g20_text_dots"] = ("WITH " + lettered("SELECT p_partkey AS f, 2 AS x0, 1 AS y0, p_partkey::VARCHAR || '-' || p_brand || '-a.b c' AS text FROM part", 2)
                      + " SELECT f, count(*) FILTER (dot) AS dots, count(*) AS cells, sum(CASE WHEN dot THEN x * 31 + y ELSE 0 END)::BIGINT AS places FROM ink GROUP BY f")
O["g20_draw_text"] = (f"WITH {COLOUR}, " + lettered("SELECT DISTINCT f, 1 AS x0, 2 AS y0, 'h7' AS text FROM rgb", 1)
                      + " SELECT f, y, x, " + ", ".join(f"CASE WHEN dot THEN {i} WHEN NOT dot THEN {b} ELSE {c} END::INT AS {c}" for c, i, b in zip("rgb", (250, 240, 10), (5, 6, 7))) + " FROM rgb LEFT JOIN ink USING (f, y, x)")
_boxed = lambda p: (f"SELECT a.f, {p} AS p, a.y, a.x, {r('sum(b.v * CASE WHEN b.x = a.x THEN 2 ELSE 1 END)::DOUBLE / sum(CASE WHEN b.x = a.x THEN 2 ELSE 1 END)')} AS v "  # noqa: E731
                    f"FROM p a JOIN p b ON b.p = {p} AND b.f = a.f AND abs(b.y - a.y) <= 1 AND b.x IN (a.x, a.x - 1) WHERE a.p = {p} GROUP BY a.f, a.y, a.x")
O["n02_denoise_planes"] = f"WITH {COLOUR}, p AS MATERIALIZED ({FULL}), luma0 AS (SELECT f, y, x, v FROM p WHERE p = 0) SELECT f, 0 AS p, y, x, v FROM ({bilateral_of(2).replace('gray', 'luma0')}) UNION ALL {_boxed(1)} UNION ALL {_boxed(2)}"
O["n08_double"] = (f"WITH {GRAY}, k AS (SELECT c.f, yy::INT AS y, xx::INT AS x, yy / 2e0 AS fy, xx / 2e0 AS fx, least(7, greatest(0, yy // 2 + j)) AS sy, least(7, greatest(0, xx // 2 + i)) AS sx "
                   "FROM (SELECT DISTINCT f FROM gray) c, range(16) a(yy), range(16) b(xx), range(-1, 3) e(j), range(-1, 3) g(i)), "
                   f"up AS (SELECT k.f, k.y, k.x, least(255e0, greatest(0e0, sum(p.v * {_cub('(fy - sy)')} * {_cub('(fx - sx)')}))) AS v FROM k JOIN gray p ON p.f = k.f AND p.y = k.sy AND p.x = k.sx GROUP BY k.f, k.y, k.x) "
                   f"SELECT a.f, a.y, a.x, {r('any_value(a.v) + 0.5e0 * (any_value(a.v) - sum(b.v) / count(*)::DOUBLE)')} AS v FROM up a JOIN up b ON b.f = a.f AND b.y - a.y IN (-2, 0, 2) AND b.x - a.x IN (-2, 0, 2) GROUP BY a.f, a.y, a.x")

# Detector composition.
_raw = ("raw AS (SELECT frame, box, x1 % 300 + 20 AS cx, y1 % 200 + 120 AS cy, x2 - x1 + 100 AS bw, y2 - y1 + 100 AS bh, score * 1 % 101 / 128e0 AS s0, score * 7 % 101 / 128e0 AS s1, score * 11 % 101 / 128e0 AS s2 FROM bx), "
        "cut_ AS (SELECT frame, box, greatest(s0, s1, s2) AS score, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS cls, least(640e0, greatest(0e0, (cx - bw / 2e0) / 0.5e0)) AS x1, least(480e0, greatest(0e0, (cy - bh / 2e0 - 80e0) / 0.5e0)) AS y1, "
        "least(640e0, greatest(0e0, (cx + bw / 2e0) / 0.5e0)) AS x2, least(480e0, greatest(0e0, (cy + bh / 2e0 - 80e0) / 0.5e0)) AS y2 FROM raw WHERE greatest(s0, s1, s2) >= 0.35e0)")
O["m01_detections"] = (O["m15_suppress"].replace(", o AS (SELECT frame, box, x1 % 100 AS x1, y1, x1 % 100 + 150 AS x2, y2, score, cls,", f", {_raw}, o AS (SELECT frame, box, x1, y1, x2, y2, score, cls,", 1)
                       .replace("ORDER BY score DESC, box) AS k FROM bx)", "ORDER BY score DESC, box) AS k FROM cut_ WHERE x2 > x1 AND y2 > y1)", 1).replace("len(s.kept) >= 5", "len(s.kept) >= 3", 1))
for _c in ("x1", "y1", "x2", "y2"):
    O["m01_detections"] = O["m01_detections"].replace(f"b.{_c} AS {_c}", f"floor(b.{_c})::INT AS {_c}")
_sig = "(1e0 / (1e0 + exp(-(value / 50e0 - 1e0)))) * (1e0 / (1e0 + exp(-2e0)))"
_mid = lambda i, d: f"(({i}) + 0.5e0) * 16 + ({d}) * 16"
_sides = {"x1": f"{_mid('user_id % 16 % 4', 'event_id % 7 / 8e0')} - exp(event_id % 5 / 4e0) * 16 / 2e0", "y1": f"{_mid('user_id % 16 // 4', '0.25e0')} - exp(0.5e0) * 16 / 2e0",
          "x2": f"{_mid('user_id % 16 % 4', 'event_id % 7 / 8e0')} + exp(event_id % 5 / 4e0) * 16 / 2e0", "y2": f"{_mid('user_id % 16 // 4', '0.25e0')} + exp(0.5e0) * 16 / 2e0"}
O["m02_decode_points"] = f"SELECT event_id AS frame, floor(({_sig}) * 1000 + 1e-6)::BIGINT AS score, " + ", ".join(f"floor(({e}) * 1000 + 1e-6)::BIGINT AS {c}" for c, e in _sides.items()) + f" FROM events WHERE {_sig} >= 0.4e0"
_part = lambda e: f"floor(CASE WHEN {e} > 1.5e0 THEN {e} / 256e0 ELSE {e} END * 1e6 + 1e-3)::BIGINT"
O["m05_pose"] = f"SELECT event_id, {_part('(value * 2e0)')} AS x, {_part('(value / 64e0)')} AS y, floor({_sig} * 1e6 + 1e-3)::BIGINT AS visibility FROM events"

# Gates, holds, hands and score, by recursion over each user's rows.
_fails = "CASE WHEN o.kind = 'purchase' THEN 0 WHEN o.t_ms - s.t0 >= 2000000 THEN s.fails + 1 ELSE s.fails END"
O["t13_breaker"] = folded("t_ms AS t0, 0 AS fails, false AS open_", f"s.t0, {_fails}, s.open_ OR ({_fails}) > 9", 'user_id, seq, open_ AS "open"')
_gate = lambda k: {"on_": f"CASE {k}kind WHEN 'signup' THEN true WHEN 'error' THEN false ELSE {{0}} END",
                   "odd": f"CASE WHEN {k}kind = 'signup' THEN false WHEN {k}kind = 'purchase' AND {k}v > 60 THEN NOT {{0}} ELSE {{0}} END",
                   "gap": f"CASE WHEN {k}kind = 'signup' THEN false WHEN {k}kind = 'click' AND {k}v > 70 THEN true WHEN {k}kind = 'view' THEN false ELSE {{0}} END"}
O["e09_audio_gate"] = folded(", ".join(f"{e.format('false')} AS {n}" for n, e in _gate("").items()), ", ".join(e.format(f"s.{n}") for n, e in _gate("o.").items()), 'user_id, seq, on_ AND NOT odd AND NOT gap AS "open"')
_seen = {"a": "({k}kind NOT IN ('click', 'error'))", "b": "({k}kind NOT IN ('view', 'error'))"}
_far2 = lambda m: f"(o.v * {m} % 101 - s.px) * (o.v * {m} % 101 - s.px) + (o.seq * {m} % 89 - s.py) * (o.seq * {m} % 89 - s.py)"
_who = lambda k, both: f"CASE WHEN {_seen['a'].format(k=k)} AND {_seen['b'].format(k=k)} THEN {both} WHEN {_seen['a'].format(k=k)} THEN 0 WHEN {_seen['b'].format(k=k)} THEN 1 END"
_next = "(" + _who("o.", f"CASE WHEN s.px IS NULL OR {_far2(3)} <= {_far2(7)} THEN 0 ELSE 1 END") + ")"
_place = lambda who, k, c, m, old: f"CASE {who} WHEN 0 THEN {k}{c} * 3 % {m} WHEN 1 THEN {k}{c} * 7 % {m} ELSE {old} END::DOUBLE"
_first = "(" + _who("", "0") + ")"
O["e15_aim_hand"] = folded(f"{_place(_first, '', 'v', 101, 'NULL')} AS px, {_place(_first, '', 'seq', 89, 'NULL')} AS py, {_first} AS aim", f"{_place(_next, 'o.', 'v', 101, 's.px')}, {_place(_next, 'o.', 'seq', 89, 's.py')}, {_next}", "user_id, seq, coalesce(aim, -1) AS aim")
_since = "CASE WHEN o.v > 40 THEN coalesce(s.since, o.t_ms) END"
O["e18_palm_hold"] = folded("CASE WHEN v > 40 THEN t_ms END AS since, false AS was, v > 40 AS tap, false AS kill", f"{_since}, o.v > 40 AND o.t_ms - s.since > 2000000, coalesce(o.t_ms - ({_since}) < 600000, false), o.v > 40 AND coalesce(o.t_ms - s.since > 2000000, false) AND NOT coalesce(s.was, false)", "user_id, seq, tap, kill")
O["e19_move_keys"] = "SELECT event_id, event_id % 8 / 8e0 - 0.5e0 < -0.25e0 AS w, event_id % 8 / 8e0 - 0.5e0 > 0.25e0 AS s, value / 100e0 - 0.5e0 < -0.25e0 AS a, value / 100e0 - 0.5e0 > 0.25e0 AS d, value % 1e0 < 0.5e0 AS shift FROM events"
O["e19_crouched"] = folded("CASE WHEN v / 100e0 - 0.25e0 > 0.1e0 THEN 1 ELSE 0 END AS run", "CASE WHEN o.v / 100e0 - 0.25e0 > 0.1e0 THEN s.run + 1 ELSE 0 END", "user_id, seq, run >= 3 AS crouch")
_loads = "(s.since IS NOT NULL AND o.t_ms - s.since > 900000)"
_tries = f"(o.kind <> 'error' AND (s.since IS NULL OR {_loads}))"
_rounds = f"(CASE WHEN {_loads} THEN 4 ELSE s.ammo END)"
_shoots = f"({_tries} AND {_rounds} > 0)"
_before = "(CASE WHEN o.v > 97 THEN 0 ELSE s.combo END)"
_after = f"(CASE WHEN {_shoots} AND o.v % 3 <> 0 THEN {_before} + 1 WHEN {_shoots} THEN 0 ELSE {_before} END)"
_left = f"({_rounds} - {_shoots}::INT)"
_alive = lambda c, e: f"CASE WHEN s.health <= 0 THEN s.{c} ELSE {e} END"
_turn = {"points": f"s.points + CASE WHEN {_shoots} AND o.v % 3 <> 0 THEN 100 * {_after} ELSE 0 END", "combo": _after, "best": f"greatest(s.best, {_after})", "ammo": _left,
         "health": "greatest(0, s.health - CASE WHEN o.v > 97 THEN 5 ELSE 0 END)", "since": f"CASE WHEN {_tries} AND {_left} <= 0 THEN o.t_ms WHEN {_loads} THEN NULL ELSE s.since END"}
_zero = "SELECT DISTINCT user_id, 0::BIGINT AS t_ms, 0::BIGINT AS seq, '' AS kind, 0 AS v, 0::BIGINT AS k, 0::BIGINT AS points, 0 AS combo, 0 AS best, 4 AS ammo, 100 AS health, NULL::BIGINT AS since FROM st"
O["e20_score"] = (f"WITH RECURSIVE {STREAM}, s AS ({_zero} UNION ALL SELECT o.*, " + ", ".join(_alive(c, e) for c, e in _turn.items()) + " FROM s JOIN st o ON o.user_id = s.user_id AND o.k = s.k + 1) SELECT user_id, seq, points, combo, best, ammo, health FROM s WHERE k > 0")

# Hands, mattes, working sizes, waves of targets.
_palm = "palm AS (SELECT frame, box, x1 % 60 AS x1, y1 % 90 AS y1, x1 % 60 + x2 - x1 - 24 AS x2, y1 % 90 + y2 - y1 - 24 AS y2, 1e0 / (1e0 + exp(-(score % 1001 / 100e0 - 4e0))) AS score, 0 AS cls FROM bx WHERE x2 - x1 > 24 AND y2 - y1 > 24 AND score % 1001 >= 400)"
_hands = (O["m15_suppress"].replace(", o AS (SELECT frame, box, x1 % 100 AS x1, y1, x1 % 100 + 150 AS x2, y2, score, cls,", f", {_palm}, o AS (SELECT frame, box, x1, y1, x2, y2, score, cls,", 1)
          .replace("AS k FROM bx)", "AS k FROM palm)", 1).replace("len(s.kept) >= 5", "len(s.kept) >= 2", 1).replace("> 0.45e0", "> 0.3e0", 1).rsplit(" SELECT frame, b.box", 1)[0]
          + ", z AS (SELECT frame, rank AS hand, b.score AS score, (b.x1 + (b.x2 - b.x1) / 2e0) * (640e0 / 192e0) AS cx, (b.y1 + (b.y2 - b.y1) / 2e0) * (480e0 / 192e0) AS cy, greatest(32, floor(1.6e0 * greatest((b.x2 - b.x1) * (640e0 / 192e0), (b.y2 - b.y1) * (480e0 / 192e0)))::INT) AS side FROM u), "
          "hw AS (SELECT frame, hand, floor(score * 1e6 + 1e-3)::BIGINT AS score, least(640 - side, greatest(0, floor(cx - side // 2)::INT)) AS \"left\", least(480 - side, greatest(0, floor(cy - side // 2)::INT)) AS top, side FROM z WHERE side <= 480) ")
O["m03_hands"] = _hands + "SELECT * FROM hw"
_joint = lambda place, e: f"floor(({place} + CASE WHEN {e} > 1.5e0 THEN {e} / 224e0 ELSE {e} END * side) * 1000 + 1e-6)::BIGINT"
_across, _down = _joint('"left"', "(j / 8e0)"), _joint("top", "(j * 7e0)")
O["m03_hand_joints"] = _hands + f"SELECT frame, hand, j::INT AS joint, {_across} AS x, {_down} AS y FROM hw, range(21) t(j)"
_fit = lambda c: f"CASE WHEN w * h > 921600 THEN greatest(64, floor({c} * sqrt(921600e0 / (w * h)) / 2e0)::INT * 2) ELSE {c} END::INT"
O["m08_work_size"] = f"SELECT p_partkey, {_fit('w')} AS dw, {_fit('h')} AS dh FROM (SELECT p_partkey, 64 + p_partkey * 37 % 4000 AS w, 48 + p_partkey * 91 % 2200 AS h FROM part)"
_pass = lambda src, a, b: (f"SELECT p.f, p.y, p.x, " + ", ".join(f"{r(f'sum(k.w * n.{c})')} AS {c}" for c in "rgb") + f" FROM {src} p, {_k}, {src} n WHERE n.f = p.f AND n.{b} = p.{b} AND n.{a} = least(7, greatest(0, p.{a} + k.d)) GROUP BY p.f, p.y, p.x")
_tap = lambda c, o: f"CASE {o} WHEN 1 THEN p.{c} % 2 / 2e0 ELSE 1e0 - p.{c} % 2 / 2e0 END"
O["m09_blur_behind"] = rgb(f", b1 AS ({_pass('rgb', 'x', 'y')}), b2 AS ({_pass('b1', 'y', 'x')}), m AS (SELECT p.f, p.y, p.x, sum((q.r + q.g) / 512e0 * {_tap('x', 'i')} * {_tap('y', 'j')}) AS a FROM rgb p, range(2) s(i), range(2) t(j), rgb q "
                           "WHERE q.f = p.f AND q.x = least(3, p.x // 2 + i) AND q.y = least(3, p.y // 2 + j) GROUP BY p.f, p.y, p.x), e AS (SELECT f, y, x, least(1e0, a) * least(1e0, a) * (3e0 - 2e0 * least(1e0, a)) AS a FROM m) "
                           "SELECT p.f, p.y, p.x, " + ", ".join(f"{r(f'e.a * p.{c} + (1e0 - e.a) * b2.{c}')} AS {c}" for c in "rgb") + " FROM rgb p JOIN b2 USING (f, y, x) JOIN e USING (f, y, x)")
_pick = lambda i: f"max(n) FILTER (i % 5 = {i})"
_fast = f"((20 + wave * 6) * CASE {_pick(2)} % 2 WHEN 1 THEN 1e0 ELSE -1e0 END)"
O["e20_wave_targets"] = ("WITH RECURSIVE s AS (SELECT c_custkey, c_custkey % 12 + 1 AS wave, -1 AS i, (c_custkey + (c_custkey % 12 + 1) * 7919) % 4294967296 AS z FROM customer UNION ALL SELECT c_custkey, wave, i + 1, (z * 1103515245 + 12345) % 4294967296 FROM s WHERE i < 59), "
                         "d AS (SELECT c_custkey, wave, i, z // 65536 AS n FROM s WHERE i >= 0) SELECT c_custkey, wave, (i // 5)::INT AS target, "
                         + ", ".join(f"floor(({e}) * 1000 + 0.5e0)::BIGINT AS {c}" for c, e in {"x": f"0.1e0 + {_pick(0)} % 800 / 1000e0", "y": f"0.15e0 + {_pick(1)} % 650 / 1000e0", "r": "greatest(14e0, 30e0 - wave * 1.5e0)",
                                                                                                       "vx": f"{_fast} * (0.5e0 + {_pick(3)} % 500 / 1000e0)", "vy": f"{_fast} * 0.6e0 * CASE {_pick(4)} % 2 WHEN 1 THEN 1e0 ELSE -1e0 END"}.items())
                         + " FROM d WHERE i // 5 < least(12, 3 + wave) GROUP BY c_custkey, wave, i // 5")
_to = "(s.spot + s.way * (o.v / 64e0) / 64)"
O["e20_drift"] = (f"WITH RECURSIVE {STREAM}, s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS seq, 0.5e0 AS spot, 16e0 AS way FROM st UNION ALL SELECT o.user_id, o.k, o.seq, {_to}, CASE WHEN {_to} < 0.0625e0 OR {_to} > 0.9375e0 THEN -s.way ELSE s.way END FROM s JOIN st o ON o.user_id = s.user_id AND o.k = s.k + 1) "
                  "SELECT user_id, seq, floor(spot * 4096)::BIGINT AS \"at\", way::INT AS v FROM s WHERE k > 0")

# Frames as rows: chains, layouts, regions, windows and carried state.


def doubled(src: str, w: int, h: int) -> str:
    """Tables k and up: `src` (f, y, x, r, g, b) of w by h at twice the size, cubic, as doubles."""
    return (f"k AS (SELECT c.f, yy::INT AS y, xx::INT AS x, yy / 2e0 AS fy, xx / 2e0 AS fx, least({h - 1}, greatest(0, yy // 2 + j)) AS sy, least({w - 1}, greatest(0, xx // 2 + i)) AS sx "
            f"FROM (SELECT DISTINCT f FROM {src}) c, range({2 * h}) a(yy), range({2 * w}) b(xx), range(-1, 3) e(j), range(-1, 3) g(i)), "
            "up AS (SELECT k.f, k.y, k.x, " + ", ".join(f"least(255e0, greatest(0e0, sum(p.{c} * {_cub('(fy - sy)')} * {_cub('(fx - sx)')}))) AS {c}" for c in "rgb") + f" FROM k JOIN {src} p ON p.f = k.f AND p.y = k.sy AND p.x = k.sx GROUP BY k.f, k.y, k.x)")


_beside = lambda src, step, e: (f"SELECT a.f, a.y, a.x, " + ", ".join(f"{r(e.format(c=c))} AS {c}" for c in "rgb")
                                + f" FROM {src} a JOIN {src} b ON b.f = a.f AND abs(b.y - a.y) IN (0, {step}) AND abs(b.x - a.x) IN (0, {step}) GROUP BY a.f, a.y, a.x")
_less = "any_value(a.{c}) + {k} * (any_value(a.{c}) - sum(b.{c}) / count(*)::DOUBLE)"
O["x01_frame_chain"] = (f"WITH {COLOUR}{FRAMES}, framed AS (SELECT c.f, c.y, c.x, " + ", ".join(f"coalesce(p.{c}, {v}) AS {c}" for c, v in zip("rgb", (9, 8, 7)))
                        + f" FROM {cells(10, 10)} c LEFT JOIN rgb p ON p.f = c.f AND p.x = c.x - 1 AND p.y = c.y - 1 AND c.y BETWEEN 2 AND 7), {doubled('framed', 10, 10)}, "
                        f"big AS ({_beside('up', 2, _less.replace('{k}', '0.5e0'))}), warm AS (SELECT f, y, x, {r('r + 12e0')} AS r, {r('g + 2e0')} AS g, {r('b - 12e0')} AS b FROM big) {_beside('warm', 1, _less.replace('{k}', '1e0'))}")
_next = ", ".join(f"floor(0.25e0 * s.{c} + 0.75e0 * o.{c} + 0.5e0)::INT" for c in "rgb")
O["x01_recursive_chain"] = (f"WITH RECURSIVE {COLOUR}, o AS (SELECT f // 25 AS camera, f, y, 7 - x AS x, r, g, b, row_number() OVER (PARTITION BY f // 25, y, x ORDER BY f) AS k FROM rgb), s AS (SELECT * FROM o WHERE k = 1 UNION ALL "
                            f"SELECT o.camera, o.f, o.y, o.x, {_next}, o.k FROM s JOIN o ON o.camera = s.camera AND o.y = s.y AND o.x = s.x AND o.k = s.k + 1) SELECT f, y, x, r, g, b FROM s")
_micro = lambda e: f"floor(({e})::DOUBLE * 1e6 + 0.5e0)::BIGINT"
_float = lambda c, k: f"{c}::FLOAT * ({k} / 255e0)::FLOAT"
_laid = lambda at, e: rgb(" UNION ALL ".join(f"SELECT f, ({at(i)})::INT AS i, {_micro(e(c))} AS v FROM rgb" for i, c in enumerate("rgb")))
O["g21_planar"] = _laid(lambda i: f"{i} * 64 + y * 8 + x", lambda c: _float(c, "1e0"))
O["g21_signed_bgr"] = _laid(lambda i: f"(y * 8 + x) * 3 + {2 - i}", lambda c: f"{_float(c, '2e0')} - 1::FLOAT")
O["g21_interleaved"] = _laid(lambda i: f"(y * 8 + x) * 3 + {i}", lambda c: c)
O["g21_back"] = rgb("SELECT f, y, x, r, g, b FROM rgb")
_cut = lambda c: " + ".join(f"q{j}{i}.{c} * ({f'(sx - floor(sx))' if i else '(1e0 - (sx - floor(sx)))'} * {'(sy - floor(sy))' if j else '(1e0 - (sy - floor(sy)))'})" for j in (0, 1) for i in (0, 1))
O["m03_crops"] = (f"WITH {COLOUR}, z AS (SELECT f, hand AS id, f % 3 + hand AS l, f % 2 AS t, 2 + 2 * hand AS side, yy::INT AS y, xx::INT AS x, yy * (2 + 2 * hand) / 4e0 AS sy, xx * (2 + 2 * hand) / 4e0 AS sx "
                  "FROM (SELECT DISTINCT vec_id // 3 AS f FROM embeddings), range(2) h(hand), range(4) a(yy), range(4) b(xx)) SELECT z.f, id, z.y, z.x, " + ", ".join(f"{r(_cut(c))} AS {c}" for c in "rgb") + " FROM z "
                  + " ".join(f"JOIN rgb q{j}{i} ON q{j}{i}.f = z.f AND q{j}{i}.y = t + least(floor(sy)::INT + {j}, side - 1) AND q{j}{i}.x = l + least(floor(sx)::INT + {i}, side - 1)" for j in (0, 1) for i in (0, 1)))
_held_at = lambda c, most: f"least(greatest(0, trunc({c} - 32e0)::INT), {most} - 64)"
_unit = lambda c: f"CASE WHEN n > 1e-3 THEN {c} / n ELSE 0 END"
O["m04_gaze"] = box(f"SELECT frame, id, {_milli('l + mx')} AS cx, {_milli('t + my')} AS cy, {_milli('greatest(6e0, 0.16e0 * fw)')} AS er, {_milli(_unit('ex'))} AS dx, {_milli(_unit('ey'))} AS dy, score FROM (SELECT *, mx - 32e0 AS ex, my - 32e0 AS ey, sqrt((mx - 32e0) * (mx - 32e0) + (my - 32e0) * (my - 32e0)) AS n FROM "
                    f"(SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY box, eye) - 1 AS id, score, (x2 - x1) AS fw, {_held_at('x1 + [0.3e0, 0.7e0][eye + 1] * (x2 - x1)', 640)} AS l, {_held_at('y1 + 0.42e0 * (y2 - y1)', 480)} AS t FROM bx, range(2) e(eye)) p, "
                    "LATERAL (SELECT avg((p.frame * 7 + p.id * 5 + k * 3) % 80) AS mx, avg((p.frame * 3 + k * 8) % 64) AS my FROM range(5) q(k)) WHERE id < 4 AND mx >= 0 AND mx < 64 AND my >= 0 AND my < 64)")
O["m08_five_frames"] = rgb("SELECT f, y, x, " + ", ".join(f"least(255, {c} + 13)::INT AS {c}" for c in "rgb") + " FROM (SELECT f, y, x, " + ", ".join(f"max({c}) OVER w AS {c}" for c in "rgb")
                           + ", count(*) OVER w AS n FROM rgb WINDOW w AS (PARTITION BY f // 25, y, x ORDER BY f ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5")
_near = [math.exp(-(i * i) / 0.5) for i in (-1, 0, 1)]
_near = "(VALUES " + ", ".join(f"({i - 1}, {x / sum(_near)!r}::DOUBLE)" for i, x in enumerate(_near)) + ") k(d, w)"
_soft3 = lambda src, a, b: "SELECT p.f, p.y, p.x, " + ", ".join(f"{r(f'sum(k.w * n.{c})')} AS {c}" for c in "rgb") + f" FROM {src} p, {_near}, {src} n WHERE n.f = p.f AND n.{b} = p.{b} AND n.{a} = least(7, greatest(0, p.{a} + k.d)) GROUP BY p.f, p.y, p.x"
O["t16_matting"] = rgb(f", b1 AS ({_soft3('rgb', 'x', 'y')}), b2 AS ({_soft3('b1', 'y', 'x')}), m AS (SELECT f, y, x, ({_float('max(r) OVER (PARTITION BY f // 25, y, x ORDER BY f)', '1e0')})::DOUBLE AS a FROM rgb), e AS (SELECT f, y, x, a * a * (3e0 - 2e0 * a) AS a FROM m) "
                       "SELECT p.f, p.y, p.x, " + ", ".join(f"{r(f'e.a * p.{c} + (1e0 - e.a) * b2.{c}')} AS {c}" for c in "rgb") + " FROM rgb p JOIN b2 USING (f, y, x) JOIN e USING (f, y, x)")
O["s02_written_frames"] = gray("SELECT f, y, x, v FROM gray")

# Displays: texts, discs and bars as cells (f, y, x, z, r, g, b), the highest z first.
_WHITE, _GOLD = (255, 255, 255), (255, 220, 0)
_lines = (("true", 8, 8, "'SC ' || score || ' HP ' || health || ' AMMO ' || CASE WHEN reloading THEN 0 ELSE ammo END || ' T ' || floor(time)::BIGINT || 's W' || wave", _WHITE), ("combo > 1", 8, 30, "'COMBO X' || combo", _GOLD),
          ("phase = 1", 30, 40, "'THUMB UP TO START'", _WHITE), ("phase = 2", 0, 40, "'PAUSED - THUMB RESUME'", _GOLD), ("phase = 3", -10, 40, "'GAME OVER SC ' || score || ' BEST X' || best", (255, 80, 80)),
          ("phase = 3", 10, 64, "'THUMB TO RETRY'", _WHITE), ("reloading", 70, 70, "'RELOADING'", _GOLD))
_written = " UNION ALL ".join(f"SELECT f * 10 + {i} AS f, {x} AS x0, {y} AS y0, {text} AS text FROM hs WHERE {on}" for i, (on, x, y, text, _) in enumerate(_lines))
_inked = ", ".join(f"CASE WHEN dot THEN CASE f % 10 {' '.join(f'WHEN {i} THEN {ink[c]}' for i, (*_, ink) in enumerate(_lines))} END ELSE 0 END AS {n}" for c, n in enumerate("rgb"))
_disc = lambda z, r, colour, src: f"SELECT f, (cy + j)::INT AS y, (cx + i)::INT AS x, {z} AS z, {colour} FROM {src}, range(-20, 21) a(j), range(-20, 21) b(i) WHERE i * i + j * j <= ({r}) * ({r})"
_arm = lambda z, y, x: f"SELECT f, (cy + {y})::INT, (cx + {x})::INT, {z}, 0, 255, 255 FROM aim, range(-18, 19) a(i)"
O["g23_trainer"] = ("WITH hs AS (SELECT s_suppkey AS f, s_suppkey * 37 AS score, 100 - s_nationkey AS health, s_suppkey % 13 AS ammo, s_suppkey % 5 = 0 AS reloading, abs(s_acctbal) / 100e0 AS time, s_suppkey % 9 AS wave, s_suppkey % 4 AS combo, s_suppkey % 7 AS best, s_suppkey % 4 AS phase FROM supplier), "
                    "aim AS (SELECT s_suppkey AS f, floor(s_nationkey / 25e0 * 240)::INT AS cx, floor(s_suppkey % 8 / 8e0 * 100)::INT AS cy FROM supplier WHERE s_suppkey % 3 <> 0), "
                    "goal AS (SELECT s_suppkey AS f, k, floor((s_suppkey + k * 3) % 10 / 10e0 * 240)::INT AS cx, floor((s_suppkey + k * 5) % 10 / 10e0 * 100)::INT AS cy, 6 + 3 * k AS r, (s_suppkey + k) % 2 = 1 AS lit FROM supplier, range(3) t(k) WHERE (s_suppkey + k) % 4 <> 0), "
                    + lettered(_written, 2) + f", made AS (SELECT f // 10 AS f, y, x, CASE f % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 200 + f % 10 END AS z, {_inked} FROM ink UNION ALL "
                    + " UNION ALL ".join((_disc("2 + 2 * k", "r", "CASE WHEN lit THEN 255 ELSE 230 END AS r, CASE WHEN lit THEN 255 ELSE 40 END AS g, 40 AS b", "goal"), _disc("3 + 2 * k", "greatest(r - 4, 2)", "255, 255, 255", "goal"),
                                          _disc("100", "12", "0, 255, 255", "aim"), _arm("101", "0", "i"), _arm("102", "i", "0")))
                    + "), top AS (SELECT * FROM made WHERE x BETWEEN 0 AND 239 AND y BETWEEN 0 AND 99 QUALIFY row_number() OVER (PARTITION BY f, y, x ORDER BY z DESC) = 1) "
                    "SELECT f, count(*) AS n, sum(x * 31 + y)::BIGINT AS places, " + ", ".join(f"sum({c} * (x + 1))::BIGINT AS {c}" for c in "rgb") + " FROM top GROUP BY f")

# Byte streams and settings.
_split = "(SELECT doc_id AS id, list_filter(string_split(regexp_replace(text, '[^ -~]', '#', 'g'), 'e '), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)"
O["s06_start_codes"] = f"SELECT id, (4 * len(p) + coalesce(list_sum(list_transform(p, lambda x: length(x))), 0))::INT AS n, md5(array_to_string(list_transform(p, lambda x: chr(0) || chr(0) || chr(0) || chr(1) || x), '')) AS digest FROM {_split}"
O["s08_ivf"] = f"SELECT id, (unnest(range(1, len(p) + 1)) - 1)::INT AS no, unnest(p) AS piece FROM {_split}"
O["s11_raw_frames"] = "SELECT doc_id AS id, no::INT AS no, substr(rpad(regexp_replace(text, '[^ -~]', '#', 'g'), 120, '.'), 1 + 12 * no::INT, 12) AS unit FROM documents, range(10) t(no)"
O["s23_concatenate"] = "SELECT user_id, md5(string_agg(event_type, '' ORDER BY event_id)) AS digest FROM events WHERE event_type <> 'error' GROUP BY user_id"
_dt = "(o.v / 40e0)"
O["a11_rate"] = (f"WITH RECURSIVE {STREAM}, s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS seq, 0e0 AS rate FROM st UNION ALL SELECT o.user_id, o.k, o.seq, CASE WHEN {_dt} <= 0.001e0 OR {_dt} >= 2e0 THEN s.rate WHEN s.rate = 0 THEN 1e0 / {_dt} "
                 f"ELSE 0.9e0 * s.rate + (1e0 - 0.9e0) / {_dt} END FROM s JOIN st o ON o.user_id = s.user_id AND o.k = s.k + 1) SELECT user_id, seq, floor(rate * 1e6 + 1e-3)::BIGINT AS rate FROM s WHERE k > 0")
O["e24_settings"] = "SELECT p_partkey, p_brand || '=x' AS name, p_size::VARCHAR AS size, 2 AS n FROM part"
O["e25_progress"] = ("SELECT user_id, event_id AS seq, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT ELSE -1 END AS frame, CASE WHEN event_type <> 'error' THEN floor(value) / 4e0 ELSE -1e0 END AS fps "
                     "FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
O["x09_readiness"] = "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END::INT AS ready FROM part"

# Recordings: one command after the other, with lists of segments, cuts and frame times.
_last_kept = "coalesce(list_max(list_transform(s.segs, lambda y, j: CASE WHEN y.kept THEN j END)), 0)"
_frame, _cut_now, _back = "NOT s.paused AND o.kind IN ('frame', 'idr')", "NOT s.paused AND o.kind = 'cut'", f"NOT s.paused AND o.kind = 'cut_prev' AND {_last_kept} > 0"
_file = "NOT s.paused AND (o.kind = 'idr' OR o.kind = 'frame' AND NOT s.disc)"
_turn = f"({_file} AND (s.bs >= 4 AND o.kind = 'idr' OR s.bs >= 8))"
_resume = "NOT s.paused AND s.disc AND o.kind = 'idr'"
_ft = lambda i, other: f"CASE WHEN {i} < len(s.ft) THEN s.ft[{i} + 1] ELSE {other} END"
_prev_cut = f"list_append(s.cuts, {{'start': s.segs[{_last_kept}].s, 'stop': s.segs[{_last_kept}].e, 't0': {_ft(f's.segs[{_last_kept}].s', '-1e0')}, 't1': {_ft(f's.segs[{_last_kept}].e', 'o.t')}, 'live': false}})"
_shut = lambda cuts, stop, t: f"list_transform({cuts}, lambda x, i: CASE WHEN x.live AND x.stop < 0 AND i = coalesce(list_max(list_transform({cuts}, lambda y, j: CASE WHEN y.live THEN j END)), 0) THEN {{'start': x.start, 'stop': {stop}, 't0': x.t0, 't1': {t}, 'live': true}} ELSE x END)"
_TAKES = ("WITH RECURSIVE ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, floor(epoch_us(ts) / 1000e0) / 1000e0 AS t, CASE WHEN event_type = 'view' THEN 'idr' WHEN event_type = 'error' THEN 'cut' WHEN event_type = 'signup' THEN 'cut_prev' "
          "WHEN event_type = 'purchase' AND value > 60 THEN 'mark' WHEN event_type = 'purchase' AND value > 55 THEN 'pause' ELSE 'frame' END AS kind FROM events), "
          "s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS n, 0e0 AS now, false AS paused, false AS disc, 0::BIGINT AS start, 0::BIGINT AS bs, []::STRUCT(s BIGINT, e BIGINT, kept BOOLEAN)[] AS segs, "
          "[]::STRUCT(start BIGINT, stop BIGINT, t0 DOUBLE, t1 DOUBLE, live BOOLEAN)[] AS cuts, []::DOUBLE[] AS ft FROM ev UNION ALL SELECT o.user_id, o.k, s.n + ({frame})::INT, CASE WHEN s.paused OR o.kind = 'pause' THEN s.now ELSE o.t END, s.paused <> (o.kind = 'pause'), "
          "CASE WHEN {cut} THEN true WHEN {resume} THEN false ELSE s.disc END, CASE WHEN {turn} THEN s.n + 1 WHEN {cut} THEN s.n ELSE s.start END, CASE WHEN {turn} THEN 1 WHEN {file} THEN s.bs + 1 WHEN {cut} THEN 0 ELSE s.bs END, "
          "CASE WHEN {turn} THEN list_append(s.segs, {{'s': s.start, 'e': s.n + 1, 'kept': true}}) WHEN {back} THEN list_transform(s.segs, lambda x, i: {{'s': x.s, 'e': x.e, 'kept': x.kept AND i <> {kept}}}) ELSE s.segs END, "
          "CASE WHEN {cut} THEN list_append(s.cuts, {{'start': s.start, 'stop': -1, 't0': o.t, 't1': -1e0, 'live': true}}) WHEN {back} THEN {prev} WHEN {resume} THEN {shut} ELSE s.cuts END, "
          "CASE WHEN {frame} THEN list_append(s.ft, o.t) ELSE s.ft END FROM s JOIN ev o ON o.user_id = s.user_id AND o.k = s.k + 1), "
          "z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)").format(
    frame=_frame, cut=_cut_now, back=_back, file=_file, turn=_turn, resume=_resume, kept=_last_kept, prev=_prev_cut, shut=_shut("s.cuts", "s.n + 1", "o.t"))
_kept_cuts = f"CASE WHEN disc THEN {_shut('cuts', 'n', 'now')} ELSE cuts END"
O["e05_recorder_segments"] = (_TAKES + " SELECT user_id, x.s AS start, x.e AS \"end\", x.kept AS kept FROM (SELECT user_id, unnest(CASE WHEN bs >= 2 THEN list_append(segs, {'s': start, 'e': n, 'kept': true}) ELSE segs END) AS x FROM z)")
O["e06_recorder_cuts"] = _TAKES + f" SELECT user_id, x.start AS start, x.stop AS \"end\", x.live AS live, floor(x.t0 * 1000 + 0.5e0)::BIGINT AS t0, floor(x.t1 * 1000 + 0.5e0)::BIGINT AS t1 FROM (SELECT user_id, unnest({_kept_cuts}) AS x FROM z)"
O["e10_recorder_snips"] = (_TAKES + ", sn AS (SELECT user_id, CASE WHEN x.live THEN CASE WHEN x.start < len(ft) THEN ft[x.start + 1] END WHEN x.t0 >= 0 AND x.t1 > x.t0 THEN x.t0 END AS a, CASE WHEN x.live THEN x.t0 ELSE x.t1 END AS b FROM (SELECT user_id, ft, unnest(cuts) AS x FROM z)), "
                           "ok AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS k FROM sn WHERE a IS NOT NULL AND b > a + 0.05e0), g AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM ok), "
                           "h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS no FROM g) SELECT user_id, floor(min(a) * 1000 + 0.5e0)::BIGINT AS a, floor(max(b) * 1000 + 0.5e0)::BIGINT AS b FROM h GROUP BY user_id, no")
