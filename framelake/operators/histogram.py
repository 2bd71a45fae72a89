"""Tile histograms, adaptive equalisation and frame-level reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.frames import clamp, micros, rounded
from framelake.operators import color, tone


def histogram(px: DataFrame, keys: list[Column | str]) -> DataFrame:
    """(keys, v, n): how often each level occurs."""
    return px.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def tile_tables(px: DataFrame, tile: int, clip: float) -> DataFrame:
    """(f, ty, tx, v, cdf): for each tile, a look-up of all 256 levels.

    A bin above pixels / 256 * clip is cut to its whole part; of its own whole excess it gets a 256th back, and
    one more if its level is below the remainder. The running sum is exclusive and scaled to 0..255 by the
    tile's clipped total.
    """
    at = px.select("f", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), "v")
    counts = at.groupBy("f", "ty", "tx", "v").agg(F.count("*").alias("n"))
    total = counts.groupBy("f", "ty", "tx").agg(F.sum("n").alias("px"), F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("h"))
    limit = F.col("px") / 256.0 * clip
    level = total.select("f", "ty", "tx", limit.alias("lim"), "h", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    n = F.coalesce(F.element_at("h", F.col("v")), F.lit(0))
    over = F.floor(n - F.col("lim"))
    bins = level.select("f", "ty", "tx", "v", F.when(n > F.col("lim"), F.floor("lim") + F.floor(over / 256) + (F.col("v") < over % 256).cast("int")).otherwise(n).alias("n"))
    tile_w = Window.partitionBy("f", "ty", "tx")
    before = F.coalesce(F.sum("n").over(tile_w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.select("f", "ty", "tx", "v", rounded(before * 255.0 / F.greatest(F.sum("n").over(tile_w), F.lit(1))).alias("cdf"))


def equalise(px: DataFrame, w: int, h: int, tile: int = 8, clip: float = 3.0) -> DataFrame:
    """Each level through the tables of the four tiles around it, mixed by its place in its tile (measured from the tile's corner)."""
    tables = tile_tables(px, tile, clip)
    last_x, last_y = -(-w // tile) - 1, -(-h // tile) - 1
    ty, tx = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    wy, wx = (F.col("y") % tile) / float(tile), (F.col("x") % tile) / float(tile)
    corner = F.explode(F.array(*(F.struct(clamp(ty + j, 0, last_y).cast("int").alias("ty"), clamp(tx + i, 0, last_x).cast("int").alias("tx"),
                                          ((wy if j else 1 - wy) * (wx if i else 1 - wx)).alias("k")) for j in (0, 1) for i in (0, 1))))
    each = px.select("f", "y", "x", "v", corner.alias("c")).select("f", "y", "x", "v", "c.ty", "c.tx", "c.k")
    return each.join(tables, ["f", "ty", "tx", "v"]).groupBy("f", "y", "x").agg(rounded(F.sum(F.col("k") * F.col("cdf"))).alias("v"))


def equalise_rgb(rgb: DataFrame, w: int, h: int, tile: int = 8, clip: float = 3.0) -> DataFrame:
    """Colours scaled by their equalised luminance."""
    return tone.relight(rgb, equalise(color.luminance(rgb), w, h, tile, clip))


def equalise_planes(planes: DataFrame, w: int, h: int, tile: int = 8, clip: float = 3.0) -> DataFrame:
    """Luma equalised, chroma as it is."""
    luma = equalise(planes.where("p = 0"), w, h, tile, clip).select("f", F.lit(0).alias("p"), "y", "x", "v")
    return luma.unionByName(planes.where("p > 0").select("f", "p", "y", "x", "v"))


def normalise_depth(px: DataFrame, depth: str = "d") -> DataFrame:
    """depth scaled to 0..1 by each frame's finite extremes, 0 where they don't differ; non-finite values count as the least."""
    fine = ~F.isnan(depth) & (F.abs(depth) < float("inf"))
    ends = px.groupBy("f").agg(F.min(F.when(fine, F.col(depth))).alias("_lo"), F.max(F.when(fine, F.col(depth))).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return px.join(ends, "f").withColumn(depth, F.when(fine & (span > 1e-6), (F.col(depth) - F.col("_lo")) / F.when(span > 1e-6, span).otherwise(1.0)).otherwise(0.0)).drop("_lo", "_hi")


def mean_motion(motion: DataFrame) -> DataFrame:
    """(f, dx, dy): block offsets summed and divided, towards zero."""
    s = motion.groupBy("f").agg(F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.count("*").alias("n"))
    whole = lambda c: F.when(F.col(c) >= 0, F.floor(F.col(c) / F.col("n"))).otherwise(F.ceil(F.col(c) / F.col("n"))).cast("int")
    return s.select("f", whole("sx").alias("dx"), whole("sy").alias("dy"))


def sampled_mean(px: DataFrame, w: int, step: int = 997) -> DataFrame:
    """(f, mean) over every step-th sample in row order."""
    return px.where((F.col("y") * w + F.col("x")) % step == 0).groupBy("f").agg(F.avg("v").alias("mean"))


def channel_stats(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(f, c, lo, hi, mean)."""
    rows = px.select("f", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in channels))).alias("s")).select("f", "s.c", "s.v")
    return rows.groupBy("f", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))


def mean_absolute_error(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.join(b.select("f", "y", "x", F.col("v").alias("_v")), ["f", "y", "x"])
    return j.groupBy("f").agg(F.avg(F.abs(F.col("v") - F.col("_v"))).alias("mae"))


def matte_stats(px: DataFrame, box: tuple[int, int, int, int], level: int = 128) -> DataFrame:
    """(f, mass, x1, y1, x2, y2, inside, outside): mass and bounds of v >= level, mean in and out of a box."""
    x1, y1, x2, y2 = box
    on, within = F.col("v") >= level, F.col("x").between(x1, x2) & F.col("y").between(y1, y2)
    return px.groupBy("f").agg(
        F.count_if(on).alias("mass"), F.min(F.when(on, F.col("x"))).alias("x1"), F.min(F.when(on, F.col("y"))).alias("y1"),
        F.max(F.when(on, F.col("x"))).alias("x2"), F.max(F.when(on, F.col("y"))).alias("y2"),
        F.avg(F.when(within, F.col("v"))).alias("inside"), F.avg(F.when(~within, F.col("v"))).alias("outside"))


def throughput(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, ms, fps): how many, over which time, and how many a second."""
    ms = (F.max(micros(ts)) - F.min(micros(ts))) / 1000.0
    t = events.groupBy(key).agg(F.count("*").alias("n"), F.floor(ms).cast("long").alias("ms"))
    return t.withColumn("fps", F.when(F.col("ms") > 0, F.col("n") * 1000.0 / F.when(F.col("ms") > 0, F.col("ms")).otherwise(1)))


def peak(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.abs(value)).alias("peak"))
