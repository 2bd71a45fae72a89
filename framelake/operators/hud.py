"""A game's display drawn from its state: shapes in layers, laid out as cells and put over frames by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.geometry import text_dots

WHITE, BLACK, GOLD, RED, GREEN, CYAN = (255, 255, 255), (0, 0, 0), (255, 220, 0), (255, 80, 80), (0, 255, 0), (0, 255, 255)


def _colour(rgb: tuple[int, int, int]) -> Column:
    return F.struct(*(F.lit(v).alias(c) for c, v in zip("rgb", rgb)))


def text_cells(texts: DataFrame, scale: int = 2) -> DataFrame:
    """(f, y, x, z, colour) of texts (f, z, x0, y0, text, ink, paper): letters on their own background."""
    return text_dots(texts, scale, ("ink", "paper")).select("f", "y", "x", "z", F.when(F.col("dot"), F.col("ink")).otherwise(F.col("paper")).alias("colour"))


def disc_cells(discs: DataFrame) -> DataFrame:
    """(f, y, x, z, colour) of filled discs (f, z, cx, cy, radius, colour)."""
    span = lambda c: F.explode(F.sequence(F.col(c) - F.ceil("radius").cast("int"), F.col(c) + F.ceil("radius").cast("int")))
    cells = discs.select("*", span("cy").alias("y")).select("*", span("cx").alias("x"))
    inside = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= F.col("radius") ** 2
    return cells.where(inside).select("f", "y", "x", "z", "colour")


def bar_cells(bars: DataFrame) -> DataFrame:
    """(f, y, x, z, colour) of filled bars (f, z, x1, y1, x2, y2, colour), ends included."""
    cells = bars.select("*", F.explode(F.sequence("y1", "y2")).alias("y")).select("*", F.explode(F.sequence("x1", "x2")).alias("x"))
    return cells.select("f", "y", "x", "z", "colour")


def top_cells(cells: DataFrame, w: int, h: int) -> DataFrame:
    """(f, y, x, r, g, b): of the cells within a w by h frame, the one of the highest layer at each place.

    Layer and colour are one number, which a hash aggregation takes; a struct would have every cell sorted.
    """
    layered = F.shiftleft(F.col("z").cast("long"), 24) + F.col("colour.r") * 65536 + F.col("colour.g") * 256 + F.col("colour.b")
    top = cells.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).groupBy("f", "y", "x").agg(F.max(layered).alias("_top"))
    part = lambda n: F.shiftright("_top", n).bitwiseAND(255).cast("int")
    return top.select("f", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def draw(px: DataFrame, cells: DataFrame, w: int, h: int) -> DataFrame:
    """Frames (f, y, x, r, g, b) with cells over them."""
    top = top_cells(cells, w, h).select("f", "y", "x", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    return px.join(top, ["f", "y", "x"], "left").select("f", "y", "x", *(F.coalesce(f"_{c}", c).alias(c) for c in "rgb"))


def _texts(state: DataFrame, lines: list[tuple[int, Column, Column | int, Column | int, Column, tuple, tuple]]) -> DataFrame:
    """Texts (f, z, x0, y0, text, ink, paper) of (z, when, x0, y0, text, ink, paper), those whose condition holds."""
    whole = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    each = F.array(*(F.struct(F.lit(z).alias("z"), when.alias("on"), whole(x).alias("x0"), whole(y).alias("y0"), text.alias("text"), _colour(ink).alias("ink"), _colour(paper).alias("paper")) for z, when, x, y, text, ink, paper in lines))
    return state.select("f", F.explode(each).alias("t")).where("t.on").select("f", "t.z", "t.x0", "t.y0", "t.text", "t.ink", "t.paper")


def _cross(state: DataFrame, w: int, h: int, z: int, arm: int, colour: tuple, discs: tuple[float, ...]) -> DataFrame:
    """Discs and a cross at each aim (aim_x, aim_y: shares of the frame, null for none)."""
    aim = state.where("aim_x is not null and aim_y is not null").select("f", F.floor(F.col("aim_x") * w).cast("int").alias("cx"), F.floor(F.col("aim_y") * h).cast("int").alias("cy"))
    radius = F.posexplode(F.array(*map(F.lit, discs))).alias("i", "radius")
    round_ = disc_cells(aim.select("f", "cx", "cy", radius).withColumns({"z": F.col("i") + z, "colour": _colour(colour)}))
    cx, cy = F.col("cx"), F.col("cy")
    place = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    bars = aim.select("f", F.posexplode(F.array(place(cx - arm, cy, cx + arm, cy), place(cx, cy - arm, cx, cy + arm))).alias("i", "b"))
    return round_.unionByName(bar_cells(bars.select("f", (F.col("i") + z + len(discs)).alias("z"), "b.*", _colour(colour).alias("colour"))))


def trainer(state: DataFrame, w: int, h: int) -> DataFrame:
    """Cells of the trainer's display for each state (f, score, health, ammo, reloading, time, wave, combo, best, phase, aim_x, aim_y, targets).

    phase is play, idle, pause or over; targets are structs (nx, ny, r, alive, flash), places in shares of the frame.
    Layers from below: status line, combo, targets in their order, aim, the phase's text, reloading. States are dealt
    out first: a state makes thousands of cells, and few readers would make them all.
    """
    state = state.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f")
    num = lambda c: F.col(c).cast("long").cast("string")
    status = F.concat(F.lit("SC "), num("score"), F.lit(" HP "), num("health"), F.lit(" AMMO "), F.when(F.col("reloading"), F.lit("0")).otherwise(num("ammo")), F.lit(" T "), num("time"), F.lit("s W"), num("wave"))
    yes, phase = F.lit(True), F.col("phase")
    lines = [(0, yes, 8, 8, status, WHITE, BLACK), (1, F.col("combo") > 1, 8, 30, F.concat(F.lit("COMBO X"), num("combo")), GOLD, BLACK),
             (10_000_010, phase == "idle", w // 2 - 90, h // 2 - 10, F.lit("THUMB UP TO START"), WHITE, BLACK), (10_000_011, phase == "pause", w // 2 - 120, h // 2 - 10, F.lit("PAUSED - THUMB RESUME"), GOLD, BLACK),
             (10_000_012, phase == "over", w // 2 - 130, h // 2 - 10, F.concat(F.lit("GAME OVER SC "), num("score"), F.lit(" BEST X"), num("best")), RED, BLACK),
             (10_000_013, phase == "over", w // 2 - 110, h // 2 + 14, F.lit("THUMB TO RETRY"), WHITE, BLACK), (10_000_014, F.col("reloading"), w // 2 - 50, h - 30, F.lit("RELOADING"), GOLD, BLACK)]
    t = state.select("f", F.posexplode("targets").alias("i", "t")).where("t.alive").select(
        "f", "i", F.floor(F.col("t.nx") * w).cast("int").alias("cx"), F.floor(F.col("t.ny") * h).cast("int").alias("cy"), F.floor("t.r").cast("double").alias("r"), (F.col("t.flash") > 0).alias("lit"))
    rim = F.struct(F.when(F.col("lit"), 255).otherwise(230).alias("r"), F.when(F.col("lit"), 255).otherwise(40).alias("g"), F.lit(40).alias("b"))
    rings = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("r").alias("radius"), rim.alias("colour")), F.struct(F.lit(1).alias("k"), F.greatest(F.col("r") - 4, F.lit(2.0)).alias("radius"), _colour(WHITE).alias("colour")))).alias("d")
    discs = t.select("f", "i", "cx", "cy", rings).select("f", (F.col("i") * 2 + F.col("d.k") + 2).alias("z"), "cx", "cy", "d.radius", "d.colour")
    return text_cells(_texts(state, lines)).unionByName(disc_cells(discs)).unionByName(_cross(state, w, h, 10_000_000, 18, CYAN, (12.0,)))


def external(state: DataFrame, w: int, h: int) -> DataFrame:
    """Cells of the display over another program (f, aim_x, aim_y, program): its name, and the aim."""
    line = [(10_000_010, F.lit(True), 8, 8, F.concat(F.lit("GAME EXT "), F.coalesce("program", F.lit(""))), WHITE, (0, 120, 0))]
    return text_cells(_texts(state, line)).unionByName(_cross(state, w, h, 0, 16, GREEN, (10.0, 2.0)))
