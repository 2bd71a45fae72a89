"""Frames as tables of pixels, the generators that derive them, and the rounding rules that all operators share.

A pixel table has one row for each pixel: f (frame), y, x and either v (one plane) or r, g, b, all 0..255.
Samples are quantised after every operator, because rounding between operators is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def clamp(c: Column, lo: float = 0, hi: float = 255) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def truncated(c: Column) -> Column:
    """Towards zero after clamping: the fraction is dropped."""
    return F.floor(clamp(c)).cast("int")


def rounded(c: Column) -> Column:
    """Half up after clamping."""
    return F.floor(clamp(c) + 0.5).cast("int")


def luma(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """BT.709 luma as a double."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return 0.2126 * col(r) + 0.7152 * col(g) + 0.0722 * col(b)


def each_channel(df: DataFrame, f, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """df with every channel replaced by f(channel), all in one projection."""
    return df.withColumns({c: f(F.col(c)) for c in channels if c in df.columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(e: Column) -> Column:
    return rounded((e.cast("double") + 0.6) / 1.2 * 255)


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, y, x, v): an 8 by 8 frame from each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("f"), F.posexplode("embedding").alias("i", "e"))
    return e.select("f", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), _level(F.col("e")).alias("v"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, y, x, r, g, b): an 8 by 8 frame from each three consecutive embeddings, joined as whole rows before they are laid out."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("f"), (F.col("vec_id") % 3).alias("c"), "embedding")
    part = [e.where(F.col("c") == i).select("f", F.col("embedding").alias(n)) for i, n in enumerate("rgb")]
    rows = part[0].join(part[1], "f").join(part[2], "f").select("f", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return rows.select("f", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), *(_level(F.col(f"p.{n}")).alias(n) for n in "rgb"))


def sizes(spark: SparkSession, frames: int, w: int, h: int) -> DataFrame:
    """(f, w, h) of so many frames of one size."""
    return spark.range(frames).select(F.col("id").alias("f"), F.lit(w).alias("w"), F.lit(h).alias("h"))


def pattern(frames: DataFrame) -> DataFrame:
    """(f, y, x, w, v) with v = (x + y) & 255 in every frame (f, w, h)."""
    rows = frames.select("f", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return rows.select("f", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), "w").withColumn("v", (F.col("x") + F.col("y")).bitwiseAND(255))


def test_pattern(spark: SparkSession, frames: int, w: int, h: int) -> DataFrame:
    """(f, y, x, v) of the pattern in so many frames of one size."""
    return pattern(sizes(spark, frames, w, h)).drop("w")


def ramp(spark: SparkSession, frames: int, w: int, h: int) -> DataFrame:
    """(f, y, x, v) with v = (3 x + 5 y + 7 f) & 255."""
    p = test_pattern(spark, frames, w, h)
    return p.withColumn("v", (3 * F.col("x") + 5 * F.col("y") + 7 * F.col("f")).bitwiseAND(255).cast("int"))


def colour_bars(frames: DataFrame, step: int = 4) -> DataFrame:
    """(f, y, x, r, g, b): seven vertical bars that move by `step` pixels a frame, in frames (f, w, h)."""
    bars = ((255, 255, 255), (255, 255, 0), (0, 255, 255), (0, 255, 0), (255, 0, 255), (255, 0, 0), (0, 0, 255))
    at = (F.floor((F.col("x") + F.col("f") * step) * 7 / F.col("w")) % 7 + 1).cast("int")
    return pattern(frames).select("f", "y", "x", *(F.element_at(F.array(*(F.lit(b[i]) for b in bars)), at).alias(n) for i, n in enumerate("rgb")))


def colour_bars_planes(frames: DataFrame, step: int = 4) -> DataFrame:
    """(f, p, y, x, v): eight bars as luma and half-size chroma planes of frames (f, w, h); a chroma sample takes the bar of its left upper pixel."""
    # Luma and the two chroma samples of each bar.
    bars = ((180, 128, 128), (168, 44, 136), (133, 29, 177), (87, 217, 146), (105, 120, 176), (63, 166, 88), (29, 154, 29), (16, 128, 128))
    at = (F.floor((F.col("x") + F.col("f") * step) * 8 / F.col("w")) % 8 + 1).cast("int")
    of = lambda p: F.element_at(F.array(*(F.lit(b[p]) for b in bars)), at)
    return nv12(pattern(frames), of(0), of(1), of(2))


def grid(frames: DataFrame, w: int, h: int) -> DataFrame:
    """(f, y, x) for all pixels of a w by h frame, for each f in frames."""
    return frames.select("f").distinct().select("f", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).select(
        "f", "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))


def nv12(rgb: DataFrame, luma_expr: Column, u: Column, v: Column) -> DataFrame:
    """(f, p, y, x, v): plane p 0 holds luma, planes 1 and 2 chroma of even rows and columns."""
    even = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    y = rgb.select("f", F.lit(0).alias("p"), "y", "x", luma_expr.alias("v"))
    half = rgb.where(even).select("f", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"),
                                  F.explode(F.array(F.struct(F.lit(1).alias("p"), u.alias("v")), F.struct(F.lit(2).alias("p"), v.alias("v")))).alias("c"))
    return y.unionByName(half.select("f", "c.p", "y", "x", "c.v"))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp as it reads, whatever the session's time zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(t.cast("date")) * F.lit(86_400_000_000)
    return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
