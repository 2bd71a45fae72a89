"""Operators over ordered frames or samples.

Non-recursive ones are windows. Recursive ones quantise at every step, so they fold each key's history in
order; a key's history has to fit in a row, and streaming twins (framelake.streaming) carry only the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.frames import micros, rounded

PIXEL = ("y", "x")


def fir_denoise(px: DataFrame, strength: float, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """strength * previous raw frame + rest of the current one; the first frame passes."""
    w = Window.partitionBy(*PIXEL).orderBy("f")
    one = lambda c: F.when(F.lag(c).over(w).isNull(), F.col(c)).otherwise(rounded(strength * F.lag(c).over(w) + (1 - strength) * F.col(c)))
    return px.select("f", *PIXEL, *(one(c).alias(c) for c in channels))


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, step: Callable[[Column, Column], Column], out: str = "out", block: int = 256) -> DataFrame:
    """Rows of each key in order, with the state after each: state = step(state, row). start is null before the first row if typed so.

    States are gathered by blocks of rows, so that appending copies at most a block and the list of blocks.
    """
    columns = list(dict.fromkeys([*order, value]))
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    history = df.groupBy(*keys).agg(rows.alias("_h")).where(F.size("_h") > 0)
    last = lambda states: F.element_at(states, -1)
    of_block = lambda state, part: F.aggregate(part, F.array(state), lambda states, x: F.concat(states, F.array(step(last(states), x[value]))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_h") - 1) / block).cast("int")), lambda i: F.slice("_h", i * block + 1, block))
    done = F.aggregate(blocks, F.array(F.array(start)), lambda acc, part: F.concat(acc, F.array(of_block(last(last(acc)), part))))
    states = F.flatten(F.transform(F.slice(done, 2, F.size("_h")), lambda b: F.slice(b, 2, block)))
    each = history.select(*keys, F.explode(F.arrays_zip("_h", states.alias("_s"))).alias("_r"))
    return each.select(*keys, *(F.col(f"_r._h.{c}") for c in columns), F.col("_r")["_s"].alias(out))


def iir_denoise(px: DataFrame, strength: float) -> DataFrame:
    """strength * previous output + rest of the current frame, rounded at each step; the first frame passes."""
    step = lambda s, v: F.when(s.isNull(), v).otherwise(F.floor(strength * s + (1 - strength) * v + 0.5).cast("int"))
    return fold(px, list(PIXEL), ["f"], "v", F.lit(None).cast("int"), step).select("f", *PIXEL, F.col("out").alias("v"))


def ring(px: DataFrame, size: int = 5) -> DataFrame:
    """(f, y, x, window array): the last `size` frames of each pixel once there are as many."""
    w = Window.partitionBy(*PIXEL).orderBy("f").rowsBetween(-(size - 1), 0)
    return px.withColumn("window", F.collect_list("v").over(w)).where(F.size("window") == size).select("f", *PIXEL, "window")


def stabilise(motion: DataFrame, factor: float = 0.8, camera: str = "camera") -> DataFrame:
    """(camera, f, sx, sy): mean motion (camera, f, dx, dy) smoothed recursively and cut to integers, so slow drift never registers.

    The fold runs over one row a frame, a camera's history in one row of small structs.
    """
    trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    m = motion.withColumn("m", F.struct("dx", "dy"))
    step = lambda s, v: F.struct(trunc(factor * s["x"] + (1 - factor) * v["dx"]).alias("x"), trunc(factor * s["y"] + (1 - factor) * v["dy"]).alias("y"))
    return fold(m, [camera], ["f"], "m", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")), step).select(camera, "f", F.col("out.x").alias("sx"), F.col("out.y").alias("sy"))


def interpolate(px: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Frames 2 f, and the midpoint of f and the next as 2 f + 1."""
    w = Window.partitionBy(*PIXEL).orderBy("f")
    mid = px.select("f", *PIXEL, F.lead("f").over(w).alias("_next"), *(rounded(0.5 * F.col(c) + 0.5 * F.lead(c).over(w)).alias(c) for c in channels)).where("_next is not null").drop("_next")
    return px.select((2 * F.col("f")).alias("f"), *PIXEL, *channels).unionByName(mid.withColumn("f", 2 * F.col("f") + 1))


def with_previous(px: DataFrame) -> DataFrame:
    """(f, y, x, v, previous): each frame beside the one before it."""
    prev = px.select((F.col("f") + 1).alias("f"), *PIXEL, F.col("v").alias("previous"))
    return px.join(prev, ["f", *PIXEL])


def auto_frame(faces: DataFrame, w: int, h: int, camera: str = "camera", zoom: float = 2.0, gain: float = 0.12, dead_move: float = 5.0, dead_size: float = 4.0, min_score: float = 0.4) -> DataFrame:
    """(camera, f, left, top, w, h): a smoothed window that follows the best face (f, x1, y1, x2, y2, score) of each frame of a camera.

    The target is `zoom` times the face, at most the frame, a tenth of its height above the face's centre. The
    first one is taken as it is; then place and size follow by `gain`, where they differ by the dead band or
    more. The window is kept inside the frame. A frame without a face keeps the state and shows the whole
    frame, as does one whose even-sized window is under 16 pixels.
    """
    best = faces.groupBy(camera, "f").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "score"), F.struct("score", -F.col("x1"), -F.col("y1"))).alias("b"))
    at = lambda c: F.col(f"b.{c}").cast("double")
    tw, th = (F.least((at(b) - at(a)) * zoom, F.lit(float(most))) for a, b, most in (("x1", "x2", w), ("y1", "y2", h)))
    target = F.struct(((at("x1") + at("x2")) / 2 - tw / 2).alias("x"), ((at("y1") + at("y2")) / 2 - 0.1 * th - th / 2).alias("y"), tw.alias("w"), th.alias("h"))
    t = best.select(camera, "f", F.when(F.col("b.score") > min_score, target).alias("t"))

    def step(s: Column, v: Column) -> Column:
        moved = {c: F.when(s[c].isNull(), v[c]).when(F.abs(v[c] - s[c]) < dead, s[c]).otherwise(s[c] + (v[c] - s[c]) * gain) for c, dead in (("x", dead_move), ("y", dead_move), ("w", dead_size), ("h", dead_size))}
        size = {"w": F.least(moved["w"], F.lit(float(w))), "h": F.least(moved["h"], F.lit(float(h)))}
        place = {c: F.least(F.greatest(moved[c], F.lit(0.0)), most - size[n]) for c, n, most in (("x", "w", w), ("y", "h", h))}
        return F.when(v.isNull(), s).otherwise(F.struct(*(c.alias(n) for n, c in (place | size).items())))
    out = fold(t, [camera], ["f"], "t", F.struct(*(F.lit(None).cast("double").alias(c) for c in "xywh")), step)
    cw, ch = (F.floor(F.floor(F.col(f"out.{c}")) / 2) * 2 for c in "wh")
    shown = F.col("t").isNotNull() & (cw >= 16) & (ch >= 16)
    cells = {"left": (F.floor("out.x"), 0), "top": (F.floor("out.y"), 0), "w": (cw, w), "h": (ch, h)}
    return out.select(camera, "f", *(F.when(shown, c).otherwise(whole).cast("int").alias(n) for n, (c, whole) in cells.items()))


def every_nth(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """value refreshed on every n-th row of a key and carried on in between."""
    w = Window.partitionBy(key).orderBy(order)
    at = F.row_number().over(w) - 1
    return df.withColumn("_a", F.when(at % n == 0, F.col(value))).withColumn("cached", F.last("_a", ignorenulls=True).over(w)).drop("_a")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, seq: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it, within its key: one union and one window, no range join."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).select(key, ts, seq, "_side", "_v").unionByName(
        right.select(key, ts, seq, F.lit(0).alias("_side"), F.col(value).alias("_v")))
    w = Window.partitionBy(key).orderBy(ts, "_side", seq).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(key, ts, seq, f"{value}_as_of")


def fallback(df: DataFrame, key: str, ts: str, limit_ms: int) -> DataFrame:
    """df with `stale`: whether more than limit_ms passed since the key's last row."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = (micros(ts) - F.lag(micros(ts)).over(w)) / 1000.0
    return df.withColumn("stale", F.coalesce(gap > limit_ms, F.lit(False)))


def pace(df: DataFrame, key: str, order: list[str], ms: str, gap_ms: int) -> DataFrame:
    """df with `kept`: whether at least gap_ms passed since the key's last kept row."""
    step = lambda s, v: F.when(s["last"].isNull() | (v - s["last"] >= gap_ms), F.struct(v.alias("last"), F.lit(True).alias("kept"))).otherwise(F.struct(s["last"].alias("last"), F.lit(False).alias("kept")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("kept"))
    return fold(df, [key], order, ms, start, step).select(key, *order, ms, F.col("out.kept").alias("kept"))


def hysteresis(df: DataFrame, key: str, order: list[str], value: str, low: float, high: float, after: int) -> DataFrame:
    """df with `on`: set after more than `after` rows in a row below low, cleared by one above high."""
    def step(s: Column, v: Column) -> Column:
        run = F.when(v < low, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.when(v > high, F.lit(False)).when(run > after, F.lit(True)).otherwise(s["on"]).alias("on"))
    return fold(df, [key], order, value, F.struct(F.lit(0).alias("run"), F.lit(False).alias("on")), step).select(key, *order, value, F.col("out.on").alias("on"))


def breaker(df: DataFrame, key: str, order: list[str], ms: str, ok: str, grace_ms: int = 4000, most: int = 120) -> DataFrame:
    """df with `open`: more than `most` polls failed since the last success, those of the first grace_ms of a key not counted; an open one stays so.

    Failures are counted by windows, not by a fold: a running sum within the stretch since the last success.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(F.col(ok), F.lit(False))
    d = df.withColumns({"_n": F.sum(good.cast("int")).over(w), "_x": (~good & (F.col(ms) - F.first(ms).over(w) >= grace_ms)).cast("int")})
    run = F.sum("_x").over(Window.partitionBy(key, "_n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_r", run).withColumn("open", F.max("_r").over(w) > most).drop("_n", "_x", "_r")


def runs_of(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """df with `run`: how many rows in a row, up to this one, flag held (0 where it doesn't)."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_g", F.sum((~F.col("_f")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("run", n.cast("long")).drop("_f", "_g")


def rate(df: DataFrame, key: str, order: list[str], dt: str, keep: float = 0.9, lo: float = 0.001, hi: float = 2.0) -> DataFrame:
    """df with `rate`: recursive mean of 1 / dt, ignoring dt outside (lo, hi)."""
    step = lambda s, v: F.when(v.isNull() | (v <= lo) | (v >= hi), s).otherwise(F.when(s == 0, 1 / v).otherwise(keep * s + (1 - keep) / v))
    return fold(df, [key], order, dt, F.lit(0.0), step, "rate")


def display_order(df: DataFrame, key: str, pts: str) -> DataFrame:
    return df.withColumn("display_no", F.row_number().over(Window.partitionBy(key).orderBy(pts)))
