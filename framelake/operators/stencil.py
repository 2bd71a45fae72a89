"""Neighbourhood operators, in two plans.

The relational plan scatters each pixel to the neighbours that need it and sums by target. The plane plan
packs a frame into one row and works in numpy on binaries; it is for image-sized frames. Both give the
same quantised results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import cos, exp, floor, radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.frames import clamp, luma, rounded

RGB = ("r", "g", "b")


def _offsets(radius_x: int, radius_y: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius_y, radius_y + 1) for dx in range(-radius_x, radius_x + 1)]


def _scatter(px: DataFrame, taps: list[tuple[int, int, float]], channels: tuple[str, ...]) -> DataFrame:
    """(f, y, x, _k, channels): each pixel as seen by the targets at (y - dy, x - dx); _k is the tap's weight."""
    t = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(k)).alias("k")) for dy, dx, k in taps)))
    return px.select("f", "y", "x", *channels, t.alias("t")).select("f", (F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), F.col("t.k").alias("_k"), *channels)


def mean_box(px: DataFrame, radius: int, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """(f, y, x, mean of each channel as double) over the neighbours that exist, for all targets that exist."""
    seen = _scatter(px, [(dy, dx, 1.0) for dy, dx in _offsets(radius, radius)], channels)
    sums = seen.groupBy("f", "y", "x").agg(*((F.sum(c) / F.count("*")).alias(c) for c in channels))
    return sums.join(px.select("f", "y", "x"), ["f", "y", "x"], "left_semi")


def bilateral(px: DataFrame, sigma_s: float = 15.0, sigma_c: float = 25.0, kernel: int = 5, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Edge-keeping mean per channel; the kernel is odd and at least 3, and neighbours outside are skipped."""
    radius = max(3, kernel | 1) // 2
    taps = [(dy, dx, exp(-(dy * dy + dx * dx) / (2 * sigma_s * sigma_s))) for dy, dx in _offsets(radius, radius)]
    centre = px.select("f", "y", "x", *(F.col(c).alias(f"_{c}") for c in channels))
    seen = _scatter(px, taps, channels).join(centre, ["f", "y", "x"])
    weight = lambda c: F.col("_k") * F.exp(-((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))) / (2 * sigma_c * sigma_c))
    return seen.groupBy("f", "y", "x").agg(*(rounded(F.sum(weight(c) * F.col(c)) / F.sum(weight(c))).alias(c) for c in channels))


def denoise_planes(planes: DataFrame, sigma_s: float = 15.0, sigma_c: float = 25.0, kernel: int = 5) -> DataFrame:
    """Luma and half-size chroma planes (f, p, y, x, v): bilateral luma, chroma by its neighbours of three rows.

    Chroma is read at three interleaved columns, of which the middle and the right one are the pixel's own:
    the left neighbour counts once, the own column twice, the right one not at all.
    """
    out = bilateral(planes.where("p = 0"), sigma_s, sigma_c, kernel).select("f", F.lit(0).alias("p"), "y", "x", "v")
    taps = [(dy, dx, 2.0 + dx) for dy in (-1, 0, 1) for dx in (-1, 0)]
    for p in (1, 2):
        one = planes.where(F.col("p") == p)
        sums = _scatter(one, taps, ("v",)).groupBy("f", "y", "x").agg(rounded(F.sum(F.col("_k") * F.col("v")) / F.sum("_k")).alias("v"))
        out = out.unionByName(sums.join(one.select("f", "y", "x"), ["f", "y", "x"], "left_semi").select("f", F.lit(p).alias("p"), "y", "x", "v"))
    return out


def gaussian_weights(sigma: float) -> list[float]:
    sigma = max(0.5, sigma)
    radius = max(1, int(1.5 * sigma))
    raw = [exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _clamped_pass(px: DataFrame, weights: list[float], axis: str, size: int, channels: tuple[str, ...]) -> DataFrame:
    """One pass along an axis with edges repeated: each target sums its taps, found by one join."""
    radius = len(weights) // 2
    t = F.explode(F.array(*(F.struct(F.lit(i - radius).alias("d"), F.lit(w).alias("k")) for i, w in enumerate(weights))))
    cells = px.select("f", "y", "x", t.alias("t")).withColumn("_s", clamp(F.col(axis) + F.col("t.d"), 0, size - 1).cast("int"))
    other = "y" if axis == "x" else "x"
    src = px.select("f", F.col(other), F.col(axis).alias("_s"), *channels)
    return cells.join(src, ["f", other, "_s"]).groupBy("f", "y", "x").agg(*(rounded(F.sum(F.col("t.k") * F.col(c))).alias(c) for c in channels))


def gaussian(px: DataFrame, w: int, h: int, sigma: float = 2.0, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Separable, edges repeated, rounded after each pass."""
    k = gaussian_weights(sigma)
    return _clamped_pass(_clamped_pass(px, k, "x", w, channels), k, "y", h, channels)


def sharpen(px: DataFrame, strength: float = 1.0, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    m = mean_box(px, 1, channels).select("f", "y", "x", *(F.col(c).alias(f"_{c}") for c in channels))
    return px.join(m, ["f", "y", "x"]).select("f", "y", "x", *(rounded(F.col(c) + strength * (F.col(c) - F.col(f"_{c}"))).alias(c) for c in channels))


#: Fixed Sobel weights by (dy, dx).
SOBEL_X = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
SOBEL_Y = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}


def edges(rgb: DataFrame, w: int, h: int) -> DataFrame:
    """Sobel magnitude of luma with edges repeated, cut to 255, the same on all channels."""
    px = rgb.select("f", "y", "x", luma().alias("l"))
    t = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(SOBEL_X.get((dy, dx), 0))).alias("kx"), F.lit(float(SOBEL_Y.get((dy, dx), 0))).alias("ky"))
                            for dy, dx in _offsets(1, 1) if (dy, dx) != (0, 0))))
    cells = px.select("f", "y", "x", t.alias("t")).withColumns({
        "_sy": clamp(F.col("y") + F.col("t.dy"), 0, h - 1).cast("int"), "_sx": clamp(F.col("x") + F.col("t.dx"), 0, w - 1).cast("int")})
    src = px.select("f", F.col("y").alias("_sy"), F.col("x").alias("_sx"), "l")
    g = cells.join(src, ["f", "_sy", "_sx"]).groupBy("f", "y", "x").agg(F.sum(F.col("t.kx") * F.col("l")).alias("gx"), F.sum(F.col("t.ky") * F.col("l")).alias("gy"))
    m = F.floor(F.least(F.lit(255.0), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + 1e-9)).cast("int")
    return g.select("f", "y", "x", *(m.alias(c) for c in RGB))


def directional_blur(px: DataFrame, angle: float, length: int, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Mean along a line of `length` + 1 samples, nearest, skipping those outside."""
    dx, dy, half = cos(radians(angle)), sin(radians(angle)), length // 2
    k = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    cells = px.select("f", "y", "x", k.alias("k")).withColumns({"_sx": trunc(F.col("x") + dx * F.col("k") + 0.5), "_sy": trunc(F.col("y") + dy * F.col("k") + 0.5)})
    src = px.select("f", F.col("y").alias("_sy"), F.col("x").alias("_sx"), *channels)
    return cells.join(src, ["f", "_sy", "_sx"]).groupBy("f", "y", "x").agg(*(rounded(F.sum(c) / F.count("*")).alias(c) for c in channels))


def block_motion(px: DataFrame, block: int = 16, search: int = 8, step: int = 2, w: int = 8, h: int = 8) -> DataFrame:
    """(f, by, bx, dy, dx): for each full block, the offset into the frame before it with the least sum of absolute differences.

    px holds integer luma v. Samples are taken every `step` pixels and those that fall outside are skipped;
    equal sums go to the first offset in row order.
    """
    full = (F.floor(F.col("y") / block) < h // block) & (F.floor(F.col("x") / block) < w // block)
    cur = px.where(full & (F.col("y") % block % step == 0) & (F.col("x") % block % step == 0))
    o = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-search, search + 1, step) for dx in range(-search, search + 1, step))))
    cells = cur.select((F.col("f") - 1).alias("pf"), "f", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx"), "y", "x", "v", o.alias("o"))
    cells = cells.withColumns({"sy": F.col("y") + F.col("o.dy"), "sx": F.col("x") + F.col("o.dx")})
    prev = px.select(F.col("f").alias("pf"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("pv"))
    sad = cells.join(prev, ["pf", "sy", "sx"]).groupBy("f", "by", "bx", "o").agg(F.sum(F.abs(F.col("v") - F.col("pv"))).alias("sad"))
    best = sad.groupBy("f", "by", "bx").agg(F.min(F.struct("sad", "o.dy", "o.dx")).alias("m"))
    return best.select("f", "by", "bx", "m.dy", "m.dx")


# ---- plane plan -------------------------------------------------------------------------------------


def pack_planes(px: DataFrame, w: int, h: int) -> DataFrame:
    """(f, w, h, plane binary): one row for each frame; a frame is the unit of work and must be whole."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), F.col("v"))))
    return px.groupBy("f").agg(F.transform(cells, lambda c: F.lpad(F.hex(c["v"]), 2, "0")).alias("bytes")).select(
        "f", F.lit(w).alias("w"), F.lit(h).alias("h"), F.unhex(F.concat_ws("", "bytes")).alias("plane"))


def unpack_planes(planes: DataFrame) -> DataFrame:
    at = F.posexplode(F.split(F.regexp_replace(F.hex("plane"), "(..)", "$1,"), ","))
    p = planes.select("f", "w", at.alias("i", "hex")).where("hex != ''")
    return p.select("f", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), F.conv("hex", 16, 10).cast("int").alias("v"))


def map_planes(planes: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """planes with f applied to each as a float64 array; the result is clamped and rounded half up."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows = []
            for x in b.itertuples(index=False):
                out = f(np.frombuffer(x.plane, np.uint8).reshape(x.h, x.w).astype(np.float64))
                rows.append((x.f, out.shape[1], out.shape[0], np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["f", "w", "h", "plane"])
    return planes.mapInPandas(run, "f long, w int, h int, plane binary")


def plane_bilateral(sigma_s: float = 15.0, sigma_c: float = 25.0, kernel: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    radius = max(3, kernel | 1) // 2

    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape
        top, bottom = np.zeros_like(p), np.zeros_like(p)
        for dy, dx in _offsets(radius, radius):
            to = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
            src = slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx))
            if p[to].size:
                k = exp(-(dy * dy + dx * dx) / (2 * sigma_s**2)) * np.exp(-((p[src] - p[to]) ** 2) / (2 * sigma_c**2))
                top[to] += k * p[src]
                bottom[to] += k
        return top / bottom
    return run


def plane_gaussian(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    k = gaussian_weights(sigma)
    r = len(k) // 2

    def run(p: np.ndarray) -> np.ndarray:
        wide = np.pad(p, ((0, 0), (r, r)), mode="edge")
        p = np.floor(sum(w * wide[:, i:i + p.shape[1]] for i, w in enumerate(k)) + 0.5)
        tall = np.pad(p, ((r, r), (0, 0)), mode="edge")
        return sum(w * tall[i:i + p.shape[0]] for i, w in enumerate(k))
    return run


def _cubic_rows(n: int) -> np.ndarray:
    """(2 n, n) weights of a plane's rows for twice as many: cubic, a = -0.5, at clamped places and not normalised."""
    at = np.arange(2 * n) / 2
    out = np.zeros((2 * n, n))
    for i in range(-1, 3):
        src = np.clip(np.floor(at) + i, 0, n - 1).astype(int)
        t = np.abs(at - src)
        k = np.where(t <= 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
        np.add.at(out, (np.arange(2 * n), src), k)
    return out


def plane_double(strength: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """Twice the size, cubic, then sharpened against the mean of the samples a source pixel away on all sides that exist.

    The weights are separable, so a frame is multiplied by one small matrix on each side.
    """
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape
        up = np.clip(_cubic_rows(h) @ p @ _cubic_rows(w).T, 0, 255)
        wide, there = np.pad(up, 2), np.pad(np.ones_like(up), 2)
        near = [(slice(2 + j, 2 + j + 2 * h), slice(2 + i, 2 + i + 2 * w)) for j in (-2, 0, 2) for i in (-2, 0, 2)]
        mean = sum(wide[at] for at in near) / sum(there[at] for at in near)
        return up + strength * (up - mean)
    return run


def plane_background_blur(cx: float, cy: float, radius: float = 0.3, strength: float = 8.0) -> Callable[[np.ndarray], np.ndarray]:
    """Blur that grows with the distance from a focus (in shares of the frame; 1 is half its width or height): radius and width of the kernel vary by pixel.

    Weights by offset, up to 16 MB of them, are kept for the next frame of the same shape.
    """
    known: dict[tuple[int, int], list] = {}

    def taps(h: int, w: int):
        yy, xx = np.mgrid[0:h, 0:w]
        d = np.hypot((xx - cx * w) / (w / 2), (yy - cy * h) / (h / 2))
        focus = (1 - np.clip((d - radius) / (1 - radius + 0.001), 0, 1)) ** 2
        reach = np.clip(np.floor(3 * strength * (1 - focus)), 1, 15).astype(int)
        spread = np.maximum(0.1, 2 * (strength * (1 - focus)) ** 2)

        def each():
            for dy, dx in _offsets(int(reach.max()), int(reach.max())):
                use = (np.abs(dy) <= reach) & (np.abs(dx) <= reach)
                yield np.where(use, np.exp(-(dy * dy + dx * dx) / spread), 0.0), np.clip(yy + dy, 0, h - 1) * w + np.clip(xx + dx, 0, w - 1)
        return focus, each

    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape
        if (h, w) not in known:
            focus, each = taps(h, w)
            if 31 * 31 * h * w * 16 <= 16 << 20:
                weights, places = map(np.stack, zip(*each()))
                known[h, w] = focus, weights, weights.sum(0), places
            else:
                known[h, w] = focus, None, None, each
        focus, weights, bottom, places = known[h, w]
        flat = np.ascontiguousarray(p).reshape(-1)
        if weights is None:
            top, bottom = np.zeros(p.shape), np.zeros(p.shape)
            for k, at in places():
                top += k * flat[at]
                bottom += k
        else:
            top = (weights * flat[places]).sum(0)
        return np.floor(focus * p + (1 - focus) * top / bottom + 1e-9) - 0.25
    return run
