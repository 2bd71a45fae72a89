"""Colour conversion: luma and half-size chroma planes to and from r, g, b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.frames import clamp, luma, nv12, rounded, truncated


def _chroma_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """BT.709 from values scaled to 0..1 and chroma around 0."""
    raw = {"r": y + 1.5748 * v, "g": y - 0.1873 * u - 0.4681 * v, "b": y + 1.8556 * u}
    return {n: truncated(clamp(c, 0.0, 1.0) * 255) for n, c in raw.items()}


def planes_to_rgb(planes: DataFrame, limited: bool = False) -> DataFrame:
    """(f, y, x, r, g, b) from (f, p, y, x, v): each pixel takes the chroma of its 2 by 2 block. limited: 16..235 and 16..240 ranges."""
    y = planes.where("p = 0").select("f", "y", "x", F.col("v").alias("l"), F.floor(F.col("y") / 2).cast("int").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx"))
    uv = planes.where("p > 0").groupBy("f", F.col("y").alias("cy"), F.col("x").alias("cx")).agg(
        F.max(F.when(F.col("p") == 1, F.col("v"))).alias("u"), F.max(F.when(F.col("p") == 2, F.col("v"))).alias("w"))
    if limited:
        scale = F.greatest(F.col("l") - 16, F.lit(0)) / 219.0, (F.col("u") - 128) / 224.0, (F.col("w") - 128) / 224.0
    else:
        scale = F.col("l") / 255.0, F.col("u") / 255.0 - 0.5, F.col("w") / 255.0 - 0.5
    return y.join(uv, ["f", "cy", "cx"]).select("f", "y", "x", *(c.alias(n) for n, c in _chroma_to_rgb(*scale).items()))


def _channels() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) / 255.0 for c in "rgb")


def rgb_to_planes(rgb: DataFrame, matrix: str = "709", limited: bool = False) -> DataFrame:
    """(f, p, y, x, v) planes; chroma from the pixel at even row and column alone. Full range truncates, limited range rounds."""
    r, g, b = _channels()
    if matrix == "709":
        y, u, v = 0.2126 * r + 0.7152 * g + 0.0722 * b, -0.1146 * r - 0.3854 * g + 0.5 * b, 0.5 * r - 0.4542 * g - 0.0458 * b
    else:
        y, u, v = 0.299 * r + 0.587 * g + 0.114 * b, -0.16874 * r - 0.33126 * g + 0.5 * b, 0.5 * r - 0.41869 * g - 0.08131 * b
    if limited:
        return nv12(rgb, rounded(y * 219 + 16), rounded(u * 224 + 128), rounded(v * 224 + 128))
    return nv12(rgb, truncated(y * 255), truncated((u + 0.5) * 255), truncated((v + 0.5) * 255))


def rgb_to_planes_by_height(rgb: DataFrame, height: int) -> DataFrame:
    """Limited-range planes by BT.709 from 720 rows on, else BT.601."""
    return rgb_to_planes(rgb, "709" if height >= 720 else "601", limited=True)


def rgb_to_planes_integer(rgb: DataFrame) -> DataFrame:
    """BT.601 planes in integers with arithmetic shifts."""
    mixed = lambda r, g, b, base: (F.shiftright(r * F.col("r") + g * F.col("g") + b * F.col("b") + 128, 8) + base).cast("int")
    return nv12(rgb, mixed(66, 129, 25, 16), mixed(-38, -74, 112, 128), mixed(112, -94, -18, 128))


def swap_red_blue(rgb: DataFrame) -> DataFrame:
    return rgb.withColumns({"r": F.col("b"), "b": F.col("r")})


def pq_to_sdr(rgb: DataFrame, peak: float = 1000.0) -> DataFrame:
    """x / (1 + x) of the sample as a share of the peak; not a transfer-function inverse, whatever its name says."""
    def tone(c: str) -> Column:
        x = F.col(c) / 255.0 * 100.0 / peak
        return truncated(x / (1 + x) * 255)
    return rgb.withColumns({c: tone(c) for c in "rgb"})


def pack_yuy2(planes: DataFrame) -> DataFrame:
    """(f, y, x2, packed): y0 u y1 v of each pair of neighbouring pixels."""
    y = planes.where("p = 0").groupBy("f", "y", F.floor(F.col("x") / 2).cast("int").alias("x2")).agg(
        F.max(F.when(F.col("x") % 2 == 0, F.col("v"))).alias("y0"), F.max(F.when(F.col("x") % 2 == 1, F.col("v"))).alias("y1"))
    uv = planes.where("p > 0").groupBy("f", F.col("y").alias("cy"), F.col("x").alias("x2")).agg(
        F.max(F.when(F.col("p") == 1, F.col("v"))).alias("u"), F.max(F.when(F.col("p") == 2, F.col("v"))).alias("w"))
    return y.withColumn("cy", F.floor(F.col("y") / 2).cast("int")).join(uv, ["f", "cy", "x2"]).select("f", "y", "x2", "y0", "u", "y1", "w")


def luminance(rgb: DataFrame) -> DataFrame:
    return rgb.select("f", "y", "x", rounded(luma()).alias("v"))


def channel(rgb: DataFrame, name: str) -> DataFrame:
    return rgb.select("f", "y", "x", F.col(name).alias("v"))


def with_channel(rgb: DataFrame, name: str, plane: DataFrame) -> DataFrame:
    return rgb.drop(name).join(plane.withColumnRenamed("v", name), ["f", "y", "x"]).select("f", "y", "x", "r", "g", "b")
