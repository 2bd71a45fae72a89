"""Tone and colour operators: each pixel from itself alone, one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.frames import clamp, each_channel, luma, rounded, truncated


def brightness_contrast(px: DataFrame, brightness: float = 0.0, contrast: float = 1.0) -> DataFrame:
    """(v - 128) * contrast + 128 + brightness, half added and cut towards zero before clamping."""
    return each_channel(px, lambda v: rounded((v - 128) * contrast + 128 + brightness), ("r", "g", "b", "v"))


def saturation(rgb: DataFrame, factor: float = 1.0) -> DataFrame:
    out = rgb.withColumn("_l", luma())
    return each_channel(out, lambda v: rounded(F.col("_l") + factor * (v - F.col("_l")))).drop("_l")


def gamma(px: DataFrame, g: float = 1.0) -> DataFrame:
    """(v / 255) ** (1 / g): g below 1 darkens."""
    return each_channel(px, lambda v: rounded(F.pow(v / 255.0, F.lit(1.0 / g)) * 255), ("r", "g", "b", "v"))


def white_balance(rgb: DataFrame, temperature: float, tint: float) -> DataFrame:
    return rgb.withColumns({"r": rounded(F.col("r") + 1.5 * temperature), "g": rounded(F.col("g") + tint), "b": rounded(F.col("b") - 1.5 * temperature)})


def vignette(rgb: DataFrame, w: int, h: int, strength: float = 0.5) -> DataFrame:
    dx, dy = F.col("x") - w / 2.0, F.col("y") - h / 2.0
    far = (w / 2.0) ** 2 + (h / 2.0) ** 2
    keep = F.greatest(F.lit(0.0), 1 - strength * (dx * dx + dy * dy) / far)
    return each_channel(rgb, lambda v: rounded(v * keep))


def film_grain(rgb: DataFrame, amount: float = 20.0, seed: int = 42) -> DataFrame:
    """The same hashed noise on all channels; 32-bit unsigned arithmetic in masked longs."""
    mask = 0xFFFFFFFF
    h = (F.col("x").cast("long") * 374761393 + F.col("y").cast("long") * 668265263 + seed).bitwiseAND(mask)
    h = (h.bitwiseXOR(F.shiftrightunsigned(h, 13)) * 1274126177).bitwiseAND(mask)
    noise = (h.bitwiseAND(65535) / 65535.0 - 0.5) * 2 * amount
    return each_channel(rgb.withColumn("_n", noise), lambda v: rounded(v + F.col("_n"))).drop("_n")


def hdr_reinhard(rgb: DataFrame, peak: float = 1000.0) -> DataFrame:
    x = lambda v: v / 255.0 * 100.0 / peak
    return each_channel(rgb, lambda v: truncated(x(v) / (1 + x(v)) * 255))


#: Fixed values of the ACES input matrix and curve.
ACES_IN = ((0.59719, 0.35458, 0.04823), (0.07600, 0.90834, 0.01566), (0.02840, 0.13383, 0.83777))


def hdr_aces(rgb: DataFrame, peak: float = 1000.0) -> DataFrame:
    """Input matrix, then the rational reference and output curve; no output matrix."""
    x = [F.col(c) / 255.0 * 100.0 / peak for c in "rgb"]
    out = {}
    for name, row in zip("rgb", ACES_IN):
        v = row[0] * x[0] + row[1] * x[1] + row[2] * x[2]
        out[name] = truncated((v * (v + 0.0245786) - 0.000090537) / (v * (0.983729 * v + 0.4329510) + 0.238081) * 255)
    return rgb.withColumns(out)


#: Fixed values of the built-in looks on channels 0..1: the share by which colours are drawn to grey first, each channel's lines
#: (gain, lift) below, at and above one half, and the share of grey afterwards (before the last gain and lift, if any).
LOOKS = {
    "warm": (0.0, (((1.1, 0.02),) * 3, ((1.02, 0.01),) * 3, ((0.9, 0.0),) * 3), 0.0),
    "cool": (0.0, (((0.9, 0.0),) * 3, ((1.0, 0.01),) * 3, ((1.1, 0.02),) * 3), 0.0),
    "cinematic": (0.0, (((1.05, -0.01), (1.05, -0.01), (1.05, 0.03)), ((0.98, 0.0),) * 3, ((1.08, 0.04), (1.08, -0.01), (1.08, -0.01))), 0.0),
    "vintage": (0.0, (((0.95, 0.05),) * 3, ((0.92, 0.04),) * 3, ((0.85, 0.06),) * 3), 0.2),
    "high_contrast": (0.0, (((0.8, 0.0), (1.2, 0.05), (1.2, 0.05)),) * 3, 0.0),
    "desaturate": (0.6, (((1.1, 0.02),) * 3,) * 3, 0.0),
}
PRESETS = tuple(LOOKS)


def _preset(name: str, *rgb: Column) -> list[Column]:
    """Curves of a look: drawn to BT.601 grey, bent by lines, drawn to grey again."""
    before, lines, after = LOOKS[name]

    def muted(c: list[Column], share: float) -> list[Column]:
        gray = 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
        return [x + (gray - x) * share for x in c] if share else c

    def bent(x: Column, below, at, above) -> Column:
        line = lambda k: x * k[0] + k[1]
        return line(at) if below == at == above else F.when(x < 0.5, line(below)).when(x > 0.5, line(above)).otherwise(line(at))
    return muted([bent(x, *k) for x, k in zip(muted(list(rgb), before), lines)], after)


def lut(spark, preset: str, size: int = 17) -> DataFrame:
    """(ri, gi, bi, r, g, b): the look on a grid of size**3 points, size fixed and small."""
    i = spark.range(size**3)
    at = i.select((F.col("id") % size).cast("int").alias("ri"), (F.floor(F.col("id") / size) % size).cast("int").alias("gi"), F.floor(F.col("id") / size**2).cast("int").alias("bi"))
    out = _preset(preset, *(F.col(c) / float(size - 1) for c in ("ri", "gi", "bi")))
    return at.select("ri", "gi", "bi", *(rounded(clamp(c, 0.0, 1.0) * 255).alias(n) for c, n in zip(out, "rgb")))


def apply_lut(rgb: DataFrame, table: DataFrame, size: int = 17, strength: float = 1.0) -> DataFrame:
    """Trilinear look-up: the eight grid points around each colour come from the small table as one broadcast array, indexed by place."""
    packed = table.agg(F.array_sort(F.collect_list(F.struct((F.col("ri") + size * F.col("gi") + size * size * F.col("bi")).alias("k"), "r", "g", "b"))).alias("_lut"))
    cells = {}
    for c in "rgb":
        place = F.col(c) / 255.0 * (size - 1)
        low = F.least(F.floor(place), F.lit(size - 2)).cast("int")
        cells |= {f"_{c}0": low, f"_{c}f": place - low}
    out = rgb.withColumns(cells).join(F.broadcast(packed))
    for n in "rgb":
        total = F.lit(0.0)
        for i in range(8):
            dr, dg, db = i & 1, i >> 1 & 1, i >> 2
            weight = F.lit(1.0)
            for c, d in (("r", dr), ("g", dg), ("b", db)):
                weight = weight * (F.col(f"_{c}f") if d else 1 - F.col(f"_{c}f"))
            key = (F.col("_r0") + dr) + size * (F.col("_g0") + dg) + size * size * (F.col("_b0") + db)
            total = total + weight * F.get("_lut", key.cast("int"))[n]
        # The small addition keeps exact halves from falling to either side with the order of the sum.
        cells[f"_{n}"] = F.floor(clamp(F.col(n) + strength * (total - F.col(n)) + 0.5 + 1e-9)).cast("int")
    return out.select(*(c for c in rgb.columns if c not in "rgb"), *(cells[f"_{n}"].alias(n) for n in "rgb"))


def smoothstep(lo: float, hi: float, v: Column) -> Column:
    t = clamp((v - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def chroma_key(rgb: DataFrame, hue: tuple[float, float] = (60.0, 160.0), s_min: float = 0.3, v_min: float = 0.2, spill: float = 0.3,
               background: tuple[int, int, int] = (0, 0, 0), edge: float = 0.1) -> DataFrame:
    """Pixels inside a box of hue, saturation and value become transparent over a background colour, with green spill removed."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    far = F.when(d > 0.001, d).otherwise(1.0)
    turn = F.when(d <= 0.001, 0.0).when(hi == r, ((g - b) / far) % 6).when(hi == g, (b - r) / far + 2).otherwise((r - g) / far + 4) * 60
    df = rgb.withColumns({"_h": F.when(turn < 0, turn + 360).otherwise(turn), "_s": F.when(hi > 0.001, d / F.when(hi > 0.001, hi).otherwise(1.0)).otherwise(0.0), "_v": hi})
    mid, half = (hue[0] + hue[1]) / 2, (hue[1] - hue[0]) / 2
    inside = F.col("_h").between(*hue) & (F.col("_s") >= s_min) & (F.col("_v") >= v_min)
    share = lambda c, least: F.least((F.col(c) - least) / (1 - least + 0.001), F.lit(1.0))
    factor = clamp((1 - F.least(F.abs(F.col("_h") - mid), F.lit(half)) / half) * share("_s", s_min) * share("_v", v_min), 0.0, 1.0)
    df = df.withColumn("_m", F.when(inside, factor).otherwise(0.0))
    alpha = 1 - F.col("_m")
    if edge > 0.001:
        alpha = F.when((F.col("_m") > 0.001) & (F.col("_m") < 0.999), smoothstep(0.1, 0.9, alpha)).otherwise(alpha)
    df = df.withColumn("_a", alpha)
    lost = F.greatest(g - F.greatest(r, b), F.lit(0.0)) * spill * F.col("_m")
    green = F.greatest(g - F.when(F.col("_m") > 0.01, lost).otherwise(0.0), F.lit(0.0)) if spill > 0.001 else g
    out = {n: truncated(F.col("_a") * c * 255 + (1 - F.col("_a")) * bg) for n, c, bg in zip("rgb", (r, green, b), background)}
    return df.withColumns(out).drop("_h", "_s", "_v", "_m", "_a")


def composite_alpha(front: DataFrame, back: DataFrame, alpha: DataFrame) -> DataFrame:
    """front over back by a matte (f, y, x, a) that is smoothed over its whole range."""
    keys = ["f", "y", "x"]
    j = front.join(back.select(*keys, *(F.col(c).alias(f"_{c}") for c in "rgb")), keys).join(alpha, keys)
    a = smoothstep(0.0, 1.0, F.col("a"))
    return j.select(*keys, *(rounded(a * F.col(c) + (1 - a) * F.col(f"_{c}")).alias(c) for c in "rgb"))


def blend(a: DataFrame, b: DataFrame, alpha: float, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(1 - alpha) a + alpha b of frames with the same f."""
    keys = ["f", "y", "x"]
    j = a.join(b.select(*keys, *(F.col(c).alias(f"_{c}") for c in channels)), keys)
    return j.select(*keys, *(rounded((1 - alpha) * F.col(c) + alpha * F.col(f"_{c}")).alias(c) for c in channels))


def relight(rgb: DataFrame, enhanced: DataFrame) -> DataFrame:
    """rgb scaled by enhanced luminance (f, y, x, v) over its own."""
    ratio = F.col("v") / F.greatest(rounded(luma()), F.lit(1))
    return each_channel(rgb.join(enhanced, ["f", "y", "x"]).withColumn("_k", ratio), lambda c: rounded(c * F.col("_k"))).select("f", "y", "x", "r", "g", "b")


def depth_to_gray(px: DataFrame, depth: Column) -> DataFrame:
    return px.withColumn("v", truncated(clamp(depth, 0.0, 1.0) * 255))


def flow_to_rgb(px: DataFrame, dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Direction as one of six sectors of a colour wheel, strength as value, of a flow field.

    A sector names the channel of full value; of the others, one falls with saturation and one rises with
    saturation and the place in the sector.
    """
    mag = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    turn = (F.atan2(F.col(dy), F.col(dx)) / 3.14159265 + 1) / 2 * 6
    df = px.withColumns({"_s": F.least(mag / 6, F.lit(1.0)), "_v": F.least(30 * mag, F.lit(255.0)), "_h": turn})
    part = F.col("_h") - F.floor("_h")
    level = {"v": F.floor("_v"), "q": F.floor(F.col("_v") * (1 - F.col("_s"))), "t": F.floor(F.col("_v") * F.col("_s") * part)}
    sectors = F.array(*(F.struct(*(level[k].cast("int").alias(n) for k, n in zip(kinds, "rgb"))) for kinds in ("vtq", "tvq", "qvt", "qtv", "tqv", "vqt")))
    df = df.withColumn("_c", F.get(sectors, (F.floor("_h") % 6).cast("int")))
    return df.withColumns({n: F.col(f"_c.{n}") for n in "rgb"}).drop("_s", "_v", "_h", "_c")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
