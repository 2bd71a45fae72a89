"""Geometry: output pixels gathered from source pixels. Invertible moves are projections; the rest join a grid to its sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.frames import clamp, grid, rounded
from framelake.operators import packed

RGB = ("r", "g", "b")


def _gather(cells: DataFrame, px: DataFrame, sx: Column, sy: Column, channels: tuple[str, ...], fill: tuple[int, ...]) -> DataFrame:
    """Each cell (f, y, x) takes the source pixel at (sy, sx), or fill where there is none."""
    at = cells.withColumns({"_sy": sy.cast("int"), "_sx": sx.cast("int")})
    src = px.select("f", F.col("y").alias("_sy"), F.col("x").alias("_sx"), *channels).hint("merge")
    return at.join(src, ["f", "_sy", "_sx"], "left").select("f", "y", "x", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip(channels, fill)))


def crop(px: DataFrame, w: int, h: int, left: int, top: int, channels=RGB, fill=(0, 0, 0)) -> DataFrame:
    """A w by h window at (left, top); what lies outside the source is filled."""
    return _gather(grid(px, w, h), px, F.col("x") + left, F.col("y") + top, channels, fill)


def crop_inside(px: DataFrame, w: int, h: int, left: int, top: int) -> DataFrame:
    """The same where the window lies within the source: a filter and a shift, without a join."""
    x, y = F.col("x") - left, F.col("y") - top
    return px.where(x.between(0, w - 1) & y.between(0, h - 1)).withColumns({"x": x, "y": y})


def crop_planes(planes: DataFrame, w: int, h: int, left: int, top: int) -> DataFrame:
    """Crop of luma and half-size chroma planes; outside, luma is 16 and chroma 128."""
    y = crop(planes.where("p = 0"), w, h, left, top, ("v",), (16,)).select("f", F.lit(0).alias("p"), "y", "x", "v")
    for p in (1, 2):
        c = crop(planes.where(F.col("p") == p), w // 2, h // 2, left // 2, top // 2, ("v",), (128,))
        y = y.unionByName(c.select("f", F.lit(p).alias("p"), "y", "x", "v"))
    return y


def pad(px: DataFrame, w: int, h: int, px_x: int, px_y: int, colour=(0, 0, 0)) -> DataFrame:
    """A border of px_x columns and px_y rows around a w by h frame."""
    return _gather(grid(px, w + 2 * px_x, h + 2 * px_y), px, F.col("x") - px_x, F.col("y") - px_y, RGB, colour)


def flip(px: DataFrame, w: int, h: int, horizontal: bool = True) -> DataFrame:
    return px.withColumn("x", w - 1 - F.col("x")) if horizontal else px.withColumn("y", h - 1 - F.col("y"))


def translate(px: DataFrame, w: int, h: int, dx: int, dy: int) -> DataFrame:
    """The frame moved by (dx, dy): output (y, x) from source (y - dy, x - dx), zero outside."""
    return _gather(grid(px, w, h), px, F.col("x") - dx, F.col("y") - dy, RGB, (0, 0, 0))


def lens(px: DataFrame, w: int, h: int, k1: float) -> DataFrame:
    """Radial distortion: the normalised distance is scaled by 1 + k1 r**2, nearest sample, zero outside."""
    cx, cy = w / 2.0, h / 2.0
    nx, ny = (F.col("x") - cx) / cx, (F.col("y") - cy) / cy
    d = 1 + k1 * (nx * nx + ny * ny)
    cells = grid(px, w, h).withColumns({"_gx": F.floor(nx * d * cx + cx + 0.5), "_gy": F.floor(ny * d * cy + cy + 0.5)})
    return _gather(cells, px, F.col("_gx"), F.col("_gy"), RGB, (0, 0, 0))


def _summed(px: DataFrame, taps: DataFrame, channels: tuple[str, ...], whole: bool = True) -> DataFrame:
    """Weighted sums by cell of the source pixels that taps (f, y, x, sy, sx, wt) name: one join and one aggregation. whole: as sample values.

    Both sides are as large as the frames, however small their shuffled bytes, so neither is broadcast.
    """
    made = rounded if whole else lambda c: c
    src = px.select("f", F.col("y").alias("sy"), F.col("x").alias("sx"), *channels).hint("merge")
    each = taps.select("f", "y", "x", F.col("sy").cast("int").alias("sy"), F.col("sx").cast("int").alias("sx"), "wt").join(src, ["f", "sy", "sx"])
    return each.groupBy("f", "y", "x").agg(*(made(F.sum(F.col(c) * F.col("wt"))).alias(c) for c in channels))


def _offsets(cells: DataFrame, lo: int, hi: int) -> DataFrame:
    """Each cell beside all offsets (_j, _i) from lo to hi."""
    span = F.sequence(F.lit(lo), F.lit(hi))
    return cells.select("*", F.explode(span).alias("_j")).select("*", F.explode(span).alias("_i"))


def _bilinear_taps(cells: DataFrame, sw: int, sh: int) -> DataFrame:
    """Each cell with a source place (_fy, _fx) beside its four source pixels (sy, sx) and their weights wt; edges repeat."""
    part = lambda c, o: F.when(o == 1, c - F.floor(c)).otherwise(1 - (c - F.floor(c)))
    return _offsets(cells, 0, 1).withColumns({
        "sx": F.least(F.floor("_fx") + F.col("_i"), F.lit(sw - 1)), "sy": F.least(F.floor("_fy") + F.col("_j"), F.lit(sh - 1)),
        "wt": part(F.col("_fx"), F.col("_i")) * part(F.col("_fy"), F.col("_j"))})


def resize_bilinear(px: DataFrame, sw: int, sh: int, dw: int, dh: int, channels=RGB, whole: bool = True) -> DataFrame:
    """Source coordinate = output coordinate * source size / output size, without a half-pixel shift; edges repeat. whole: as sample values."""
    at = grid(px, dw, dh).withColumns({"_fx": F.col("x") * (sw / dw), "_fy": F.col("y") * (sh / dh)})
    return _summed(px, _bilinear_taps(at, sw, sh), channels, whole)


def _cubic(t: Column) -> Column:
    a, t = -0.5, F.abs(t)
    return F.when(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1).when(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a).otherwise(0.0)


def resize_bicubic(px: DataFrame, sw: int, sh: int, dw: int, dh: int, channels=RGB) -> DataFrame:
    """Sixteen taps, a = -0.5; weights are taken at the clamped coordinates and not normalised at the border."""
    at = grid(px, dw, dh).withColumns({"_fx": F.col("x") * (sw / dw), "_fy": F.col("y") * (sh / dh)})
    taps = _offsets(at, -1, 2).withColumns({"sx": clamp(F.floor("_fx") + F.col("_i"), 0, sw - 1), "sy": clamp(F.floor("_fy") + F.col("_j"), 0, sh - 1)})
    return _summed(px, taps.withColumn("wt", _cubic(F.col("_fy") - F.col("sy")) * _cubic(F.col("_fx") - F.col("sx"))), channels)


def resize_nearest(px: DataFrame, sw: int, sh: int, dw: int, dh: int, channels=RGB) -> DataFrame:
    return _gather(grid(px, dw, dh), px, F.floor(F.col("x") * sw / dw), F.floor(F.col("y") * sh / dh), channels, tuple(0 for _ in channels))


def resize_planes(planes: DataFrame, sw: int, sh: int, dw: int, dh: int, cubic: bool = False) -> DataFrame:
    """Luma and half-size chroma planes (f, p, y, x, v), each resized at its own size."""
    resize = resize_bicubic if cubic else resize_bilinear
    out = None
    for p, k in ((0, 1), (1, 2), (2, 2)):
        one = resize(planes.where(F.col("p") == p), sw // k, sh // k, dw // k, dh // k, ("v",)).select("f", F.lit(p).alias("p"), "y", "x", "v")
        out = one if out is None else out.unionByName(one)
    return out


def resize_flow(flow: DataFrame, sw: int, sh: int, dw: int, dh: int) -> DataFrame:
    """Vectors (f, y, x, dx, dy) at another size: the nearest one towards the origin, its components scaled with the frame."""
    near = resize_nearest(flow, sw, sh, dw, dh, ("dx", "dy"))
    return near.withColumns({"dx": F.col("dx") * (dw / sw), "dy": F.col("dy") * (dh / sh)})


def letterbox_fit(sw: int, sh: int, w: int, h: int) -> tuple[float, float, float]:
    """(scale, left, top) of a frame scaled to fit w by h, centred; places are fractions of a pixel."""
    scale = min(w / sw, h / sh)
    return scale, (w - sw * scale) / 2, (h - sh * scale) / 2


def letterbox(px: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Scaled to fit, centred, bilinear; cells whose source lies outside the frame are 128."""
    scale, left, top = letterbox_fit(sw, sh, w, h)
    cells = grid(px, w, h)
    at = cells.withColumns({"_fx": (F.col("x") - left) / scale, "_fy": (F.col("y") - top) / scale}).where(f"_fx >= 0 and _fx < {sw} and _fy >= 0 and _fy < {sh}")
    found = _summed(px, _bilinear_taps(at, sw, sh), RGB)
    return cells.join(found, ["f", "y", "x"], "left").select("f", "y", "x", *(F.coalesce(F.col(c), F.lit(128)).alias(c) for c in RGB))


def zoom(px: DataFrame, w: int, h: int, factor: float) -> DataFrame:
    """A centred, even-sized window scaled back to the whole frame."""
    cw, ch = int(w / factor) & ~1, int(h / factor) & ~1
    return resize_bilinear(crop_inside(px, cw, ch, (w - cw) // 2, (h - ch) // 2), cw, ch, w, h)


def grid_layout(tiles: Column) -> tuple[Column, Column]:
    """(columns, rows) of a grid for so many tiles; more than 16 do not fit."""
    cols = F.when(tiles <= 1, 1).when(tiles <= 2, 2).when(tiles <= 4, 2).when(tiles <= 6, 3).when(tiles <= 9, 3).otherwise(4)
    rows = F.when(tiles <= 2, 1).when(tiles <= 4, 2).when(tiles <= 6, 2).when(tiles <= 9, 3).otherwise(4)
    return cols, rows


def compose(px: DataFrame, layout: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """(y, x, v): a w by h canvas of zeros with tiles of (tile, src_f, dst_x, dst_y, tile_w, tile_h, active) scaled onto it; the later tile wins.

    A tile is scaled bilinearly. layout has a row a tile; its cells are laid out and joined with the pixels
    that they take, so only frames that it names are read on.
    """
    cells = layout.where("active").select("tile", F.col("src_f").alias("f"), "dst_x", "dst_y", "tile_w", "tile_h",
                                          F.explode(F.sequence(F.lit(0), F.col("tile_h") - 1)).alias("ty")).withColumn(
        "tx", F.explode(F.sequence(F.lit(0), F.col("tile_w") - 1)))
    cells = cells.select("tile", "f", (F.col("dst_y") + F.col("ty")).alias("y"), (F.col("dst_x") + F.col("tx")).alias("x"),
                         (F.col("ty") * sh / F.col("tile_h")).alias("_fy"), (F.col("tx") * sw / F.col("tile_w")).alias("_fx")).where(f"y < {h} and x < {w}")
    taps = _bilinear_taps(cells, sw, sh).select("tile", "f", "y", "x", F.col("sy").cast("int").alias("sy"), F.col("sx").cast("int").alias("sx"), "wt")
    hit = taps.join(px.select("f", F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["f", "sy", "sx"])
    tiles = hit.groupBy("tile", "y", "x").agg(rounded(F.sum(F.col("v") * F.col("wt"))).alias("v"))
    top = tiles.groupBy("y", "x").agg(F.max_by("v", "tile").alias("v"))
    canvas = grid(px.sparkSession.range(1).select(F.col("id").alias("f")), w, h).select("y", "x")
    return canvas.join(top, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def compose_planes(planes: DataFrame, layout: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """(p, y, x, v): the same for luma and half-size chroma planes, every measure halved for chroma."""
    half = layout.withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in ("dst_x", "dst_y", "tile_w", "tile_h")})
    parts = [compose(planes.where("p = 0"), layout, sw, sh, w, h).withColumn("p", F.lit(0))]
    parts += [compose(planes.where(F.col("p") == p), half, sw // 2, sh // 2, w // 2, h // 2).withColumn("p", F.lit(p)) for p in (1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("p", "y", "x", "v")


def pip_box(w: Column, h: Column) -> dict[str, Column]:
    """Size and place of the inset: a sixth of the screen, even, within 96..320 by 72..240, 12 pixels from the lower right; ok if it fits."""
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    bw, bh = clamp(even(F.floor(w / 6)), 96, 320), clamp(even(F.floor(h / 6)), 72, 240)
    x, y = w - bw - 12, h - bh - 12
    return {"box_w": bw.cast("int"), "box_h": bh.cast("int"), "box_x": x.cast("int"), "box_y": y.cast("int"), "ok": (x >= 3) & (y >= 3)}


def inset(screen: DataFrame, camera: DataFrame, x: int, y: int, w: int, h: int, cw: int, ch: int, border: int = 3, colour=(0, 180, 255)) -> DataFrame:
    """camera (one frame for each screen frame) nearest-scaled into a box with a border."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    near = F.col("x").between(x - border, x + w - 1 + border) & F.col("y").between(y - border, y + h - 1 + border)
    at = screen.withColumns({"_sx": F.when(inside, F.floor((F.col("x") - x) * cw / w)).cast("int"), "_sy": F.when(inside, F.floor((F.col("y") - y) * ch / h)).cast("int")})
    cam = camera.select("f", F.col("y").alias("_sy"), F.col("x").alias("_sx"), *(F.col(c).alias(f"_{c}") for c in RGB))
    j = at.join(cam, ["f", "_sy", "_sx"], "left")
    return j.select("f", "y", "x", *(F.when(inside, F.col(f"_{c}")).when(near, v).otherwise(F.col(c)).cast("int").alias(c) for c, v in zip(RGB, colour)))


def draw_boxes(px: DataFrame, boxes: DataFrame, thickness: int = 1) -> DataFrame:
    """Hollow rectangles (f, z, x1, y1, x2, y2, r, g, b) over frames; the highest z wins. Each box is laid out by its own outline."""
    xs, ys = F.sequence("x1", "x2"), F.sequence("y1", "y2")
    cells = boxes.select("*", F.explode(ys).alias("y")).select("*", F.explode(xs).alias("x"))
    t = thickness
    edge = (F.col("x") < F.col("x1") + t) | (F.col("x") > F.col("x2") - t) | (F.col("y") < F.col("y1") + t) | (F.col("y") > F.col("y2") - t)
    top = cells.where(edge).groupBy("f", "y", "x").agg(F.max_by(F.struct("r", "g", "b"), "z").alias("c"))
    return px.join(top, ["f", "y", "x"], "left").select("f", "y", "x", *(F.coalesce(F.col(f"c.{n}"), F.col(n)).alias(n) for n in RGB))


def draw_discs(px: DataFrame, discs: DataFrame) -> DataFrame:
    """Filled discs (f, z, cx, cy, radius, r, g, b) over frames; the highest z wins."""
    cells = discs.select("*", F.explode(F.sequence(F.col("cy") - F.col("radius"), F.col("cy") + F.col("radius"))).alias("y")).select(
        "*", F.explode(F.sequence(F.col("cx") - F.col("radius"), F.col("cx") + F.col("radius"))).alias("x"))
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    top = cells.where(d2 <= F.col("radius") ** 2).groupBy("f", "y", "x").agg(F.max_by(F.struct("r", "g", "b"), "z").alias("c"))
    return px.join(top, ["f", "y", "x"], "left").select("f", "y", "x", *(F.coalesce(F.col(f"c.{n}"), F.col(n)).alias(n) for n in RGB))


def redirect_eyes(px: DataFrame, eyes: DataFrame, w: int, h: int, strength: float = 0.5) -> DataFrame:
    """Irises drawn back to the middle of eyes (f, eye, cx, cy, er, dx, dy, score): pixels as redirect_eyes_frames has frames."""
    return packed.unpack(redirect_eyes_frames(packed.pack(px, w, h), eyes, strength))


def redirect_eyes_frames(frames: DataFrame, eyes: DataFrame, strength: float = 0.5) -> DataFrame:
    """frames with all eyes (f, eye, cx, cy, er, dx, dy, score) of each drawn back, one after the other by their number.

    Inside an eye's circle a pixel is read from up to 0.45 of the radius along the gaze, less towards the rim,
    bilinear. Eyes that score under 0.4 are passed over.
    """
    places = ("cx", "cy", "er", "dx", "dy")
    per = eyes.where("score >= 0.4").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("eye", *(F.col(c).cast("double").alias(c) for c in places)))).alias("_eyes"))
    share = 0.45 * min(strength, 1.0)

    def drawn(frame: np.ndarray, cx: float, cy: float, er: float, dx: float, dy: float) -> np.ndarray:
        h, w = frame.shape[:2]
        y, x = np.mgrid[0:h, 0:w]
        d2 = ((x - cx) / er) ** 2 + ((y - cy) / er) ** 2
        y, x = np.nonzero(d2 < 1)
        d = np.sqrt(d2[y, x])
        pull = share * er * (1 - d * d * (3 - 2 * d))
        fx, fy = np.clip(x + dx * pull, 0, w - 1), np.clip(y + dy * pull, 0, h - 1)
        x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
        x1, y1, ax, ay = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), fx - x0, fy - y0
        taps = ((y0, x0, (1 - ax) * (1 - ay)), (y0, x1, ax * (1 - ay)), (y1, x0, (1 - ax) * ay), (y1, x1, ax * ay))
        out = frame.copy()
        out[y, x] = packed.quantised(sum(frame[j, i] * k[:, None] for j, i, k in taps))
        return out

    def run(stack: np.ndarray, rows) -> list[np.ndarray]:
        out = []
        for frame, found in zip(stack, rows.column("_eyes").to_pylist()):
            for e in found or ():
                frame = drawn(frame, *(e[c] for c in places))
            out.append(frame)
        return out
    return packed.map_each(frames.join(per, "f", "left"), run).drop("_eyes")


#: The 3 x 5 font. Five rows from the top, the leftmost dot has value 4.
FONT = {
    "A": (2, 5, 7, 5, 5), "B": (6, 5, 6, 5, 6), "C": (3, 4, 4, 4, 3), "D": (6, 5, 5, 5, 6), "E": (7, 4, 6, 4, 7), "F": (7, 4, 6, 4, 4),
    "G": (3, 4, 5, 5, 3), "H": (5, 5, 7, 5, 5), "I": (7, 2, 2, 2, 7), "J": (1, 1, 1, 5, 2), "K": (5, 5, 6, 5, 5), "L": (4, 4, 4, 4, 7),
    "M": (5, 7, 7, 5, 5), "N": (6, 5, 5, 5, 5), "O": (2, 5, 5, 5, 2), "P": (6, 5, 6, 4, 4), "Q": (2, 5, 5, 2, 1), "R": (6, 5, 6, 5, 5),
    "S": (3, 4, 2, 1, 6), "T": (7, 2, 2, 2, 2), "U": (5, 5, 5, 5, 7), "V": (5, 5, 5, 5, 2), "W": (5, 5, 7, 7, 5), "X": (5, 5, 2, 5, 5),
    "Y": (5, 5, 2, 2, 2), "Z": (7, 1, 2, 4, 7),
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7),
    "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7),
    "-": (0, 0, 7, 0, 0), ".": (0, 0, 0, 0, 2),
}


def text_dots(texts: DataFrame, scale: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """texts (f, z, x0, y0, text) as cells (f, z, y, x, dot): 3 by 5 dots a character and a column between, each `scale` pixels wide.

    Upper case only, at most 63 characters; others are blank, and blank dots are cells too. carry: other columns that cells keep.
    """
    font = F.create_map(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in FONT.items() for v in kv))
    chars = texts.select("f", "z", "x0", "y0", *carry, F.posexplode(F.split(F.upper(F.substring("text", 1, 63)), "")).alias("i", "c")).where("c <> ''")
    rows = chars.select("*", F.posexplode(F.coalesce(F.try_element_at(font, F.col("c")), F.array(*(F.lit(0),) * 5))).alias("gy", "bits"))
    wide = 3 * scale + 1
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("lx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))).alias("ly"))
    gx = F.floor(F.col("lx") / scale).cast("int")
    dot = (gx < 3) & (F.expr("shiftright(bits, greatest(0, 2 - cast(floor(lx / %d) as int)))" % scale).bitwiseAND(1) == 1)
    return cells.select("f", "z", (F.col("y0") + F.col("gy") * scale + F.col("ly")).alias("y"), (F.col("x0") + F.col("i") * wide + F.col("lx")).alias("x"), dot.alias("dot"), *carry)


def draw_text(px: DataFrame, texts: DataFrame, scale: int = 1, ink=(255, 255, 255), paper=(0, 0, 0)) -> DataFrame:
    """Texts (f, z, x0, y0, text) over frames on their own background; the highest z wins."""
    top = text_dots(texts, scale).groupBy("f", "y", "x").agg(F.max_by("dot", "z").alias("dot"))
    j = px.join(top, ["f", "y", "x"], "left")
    return j.select("f", "y", "x", *(F.when(F.col("dot"), i).when(~F.col("dot"), p).otherwise(F.col(c)).cast("int").alias(c) for c, i, p in zip(RGB, ink, paper)))


def outline(px: DataFrame, w: int, h: int, fired: Column, thickness: int = 6) -> DataFrame:
    """A frame border, green where `fired`, else amber."""
    t = thickness
    edge = (F.col("x") < t) | (F.col("x") >= w - t) | (F.col("y") < t) | (F.col("y") >= h - t)
    colour = {"r": (0, 255), "g": (255, 191), "b": (0, 0)}
    return px.withColumns({c: F.when(edge, F.when(fired, g).otherwise(a)).otherwise(F.col(c)) for c, (g, a) in colour.items()})


def to_nchw(px: DataFrame, scale: float = 255.0, offset: float = 0.0) -> DataFrame:
    """(f, data array<double>): channel, row, column order, v / scale * (1 or 2) + offset already folded into scale and offset."""
    each = px.select("f", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("y"), F.col("x"), (F.col(n) / scale + offset).alias("e")) for i, n in enumerate(RGB)))).alias("s"))
    return each.groupBy("f").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]).alias("data"))
