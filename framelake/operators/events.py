"""Event logic: gestures, holds, recordings, cuts, hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.temporal import fold, runs_of


def gesture(hands: DataFrame, key: str = "hand") -> DataFrame:
    """(key, gesture) from 21 joints (key, joint, x, y).

    A finger is open if its tip is further from the wrist than 1.1 times its middle joint (squared 1.21;
    the thumb 1.32). Four open: palm; none: thumb or fist by the thumb; the first two alone: peace.
    """
    p = hands.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y")))).alias("j"))
    at = lambda i: F.element_at("j", F.lit(i))
    d2 = lambda i: (at(i)["x"] - at(0)["x"]) * (at(i)["x"] - at(0)["x"]) + (at(i)["y"] - at(0)["y"]) * (at(i)["y"] - at(0)["y"])
    fingers = [(d2(t) > 1.21 * d2(m)).cast("int") for t, m in ((8, 6), (12, 10), (16, 14), (20, 18))]
    q = p.select(key, *(f.alias(f"o{i}") for i, f in enumerate(fingers)), (d2(4) > 1.32 * d2(3)).alias("thumb"))
    n = sum((F.col(f"o{i}") for i in range(4)), F.lit(0))
    name = F.when(n == 4, "palm").when((n == 0) & ~F.col("thumb"), "fist").when(n == 0, "thumb").when((n == 2) & (F.col("o0") + F.col("o1") == 2), "peace").otherwise("none")
    return q.select(key, name.alias("gesture"))


def hand_shape(hands: DataFrame, key: str = "hand") -> DataFrame:
    """(key, cx, cy, pinch, pointing): centre of the knuckles, pinch by hand size, index finger alone open."""
    p = hands.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y")))).alias("j"))
    at = lambda i: F.element_at("j", F.lit(i))
    square = lambda a, b: (at(a)["x"] - at(b)["x"]) ** 2 + (at(a)["y"] - at(b)["y"]) ** 2
    dist = lambda a, b: F.sqrt(square(a, b))
    opened = [square(t, 0) > 1.21 * square(m, 0) for t, m in ((8, 6), (12, 10), (16, 14), (20, 18))]  # a root's rounding would decide ties
    mean = lambda c: sum((at(i)[c] for i in (5, 9, 13, 17)), F.lit(0.0)) / 4
    return p.select(key, mean("x").alias("cx"), mean("y").alias("cy"), (dist(4, 8) / F.greatest(dist(0, 9), F.lit(1.0))).alias("pinch"), (opened[0] & ~opened[1] & ~opened[2] & ~opened[3]).alias("pointing"))


def best_hand(hands: DataFrame, frame: str, score: str = "score", id: str = "hand", least: float = 0.5) -> DataFrame:
    """The best scoring hand of each frame over `least`, the first on ties."""
    ok = hands.where(F.col(score) > least)
    return ok.groupBy(frame).agg(F.max_by(id, F.struct(score, -F.col(id))).alias(id), F.max(score).alias(score))


def holds(df: DataFrame, key: str, order: list[str], ts: str, state: str) -> DataFrame:
    """(key, no, state, start, end, n): stretches of equal state in order, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))) | (F.row_number().over(w) == 1), F.lit(True)).cast("int")
    no = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_new", new).withColumn("no", no.cast("long"))
    return d.groupBy(key, "no").agg(F.first(state).alias(state), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def gesture_actions(df: DataFrame, key: str, order: list[str], ms: str, state: str, needs: dict[str, int], cooldown_ms: int = 2000) -> DataFrame:
    """(key, order, action): a gesture held for its time fires; nothing fires within the cooldown, and firing begins the hold anew."""
    need = F.create_map(*[F.lit(x) for kv in needs.items() for x in kv])
    d = df.withColumn("_x", F.struct(F.col(ms).alias("t"), F.col(state).alias("g")))

    def step(s: Column, x: Column) -> Column:
        same = s["g"].eqNullSafe(x["g"])
        since = F.when(same, s["since"]).otherwise(x["t"])
        least = F.try_element_at(need, x["g"])
        fire = least.isNotNull() & (x["t"] - since >= least) & (s["last"].isNull() | (x["t"] - s["last"] >= cooldown_ms))
        fire = F.coalesce(fire, F.lit(False))
        return F.struct(x["g"].alias("g"), F.when(fire, x["t"]).otherwise(since).alias("since"), F.when(fire, x["t"]).otherwise(s["last"]).alias("last"), F.when(fire, x["g"]).alias("action"))

    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).cast("long").alias("since"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("action"))
    return fold(d, [key], order, "_x", start, step).select(key, *order, F.col("out.action").alias("action"))


def segments(df: DataFrame, key: str, order: list[str], idr: str, least: int = 120, most: int = 240) -> DataFrame:
    """df with `segment`: a new one begins at the first key frame once the open one has `least` frames, at the latest after `most`."""
    def step(s: Column, v: Column) -> Column:
        cut = ((s["n"] >= least) & v) | (s["n"] >= most)
        return F.struct((s["seg"] + cut.cast("int")).alias("seg"), F.when(cut, 1).otherwise(s["n"] + 1).alias("n"))
    start = F.struct(F.lit(0).alias("seg"), F.lit(0).alias("n"))
    return fold(df, [key], order, idr, start, step).select(key, *order, F.col(idr), F.col("out.seg").alias("segment"))


def cut_spans(df: DataFrame, key: str, seq: str, cmd: str, idr: str) -> DataFrame:
    """(key, start, end): each cut command discards until the next key frame after it (null if none came); cuts inside an open span don't count."""
    w = Window.partitionBy(key).orderBy(seq)
    nxt = F.min(F.when(F.col(idr), F.col(seq))).over(w.rowsBetween(1, Window.unboundedFollowing))
    spans = df.withColumn("end", nxt).where(F.col(cmd)).groupBy(key, "end").agg(F.min(seq).alias("start"))
    return spans.select(key, "start", "end")


def without_spans(samples: DataFrame, spans: DataFrame, key: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Samples outside all spans of their key (from start up to end, a null end never comes), however the spans overlap.

    One union and one window: a sample lies in a span if the latest end of those that began by then is still to come.
    """
    rows = samples.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(spans.schema[end].dataType).alias("_e"), F.lit(False).alias("_open"), F.struct(*samples.columns).alias("_row"))
    begun = spans.select(F.col(key), F.col(start), F.lit(0), F.col(end), F.col(end).isNull(), F.lit(None).cast(rows.schema["_row"].dataType))
    w = Window.partitionBy("_k").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.union(begun).withColumns({"_last": F.max("_e").over(w), "_never": F.max("_open").over(w)})
    return d.where((F.col("_side") == 1) & ~F.col("_never") & F.coalesce(F.col("_last") <= F.col("_at"), F.lit(True))).select("_row.*")


def marks(df: DataFrame, key: str, order: list[str], is_mark: Column) -> DataFrame:
    """Marked rows with automatic labels in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(is_mark).withColumn("label", F.concat(F.lit("mark "), n))


def paused(df: DataFrame, key: str, order: list[str], toggle: Column) -> DataFrame:
    """df with `paused`: an odd number of toggles up to this row."""
    n = F.sum(F.coalesce(toggle, F.lit(False)).cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("paused", n % 2 == 1)


def last_kept(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def long_enough(df: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def measured_fps(frames: Column, seconds: Column) -> Column:
    """Rounded and cut to 5..60 after half a second, else 30."""
    return F.when(seconds > 0.5, F.greatest(F.lit(5), F.least(F.lit(60), F.floor(frames / F.when(seconds > 0, seconds).otherwise(1.0) + 0.5)))).otherwise(30).cast("int")


def voice_gain(mean_db: Column) -> Column:
    return F.when(mean_db > -50, F.greatest(F.lit(0.0), F.least(F.lit(30.0), -20 - mean_db))).otherwise(0.0)


def debounce(df: DataFrame, key: str, order: list[str], held: Column) -> DataFrame:
    """df with `edge`: 1 where two equal samples in a row turn the state on, -1 where they turn it off."""
    d = df.withColumn("_x", F.coalesce(held, F.lit(False)))

    def step(s: Column, v: Column) -> Column:
        stable = v == s["prev"]
        new = F.when(stable, v).otherwise(s["on"])
        return F.struct(v.alias("prev"), new.alias("on"), (new.cast("int") - s["on"].cast("int")).alias("edge"))
    start = F.struct(F.lit(False).alias("prev"), F.lit(False).alias("on"), F.lit(0).alias("edge"))
    return fold(d, [key], order, "_x", start, step).select(key, *order, F.col("out.edge").alias("edge"))


def smooth_aim(df: DataFrame, key: str, order: list[str], value: str, smoothing: float, deadzone: float, sensitivity: float = 1.0, centre: float = 0.5, relative: bool = False) -> DataFrame:
    """df with `aim` (0..1) from a place `value` (0..1) of the hand.

    Absolute: the place relative to `centre`, scaled, snaps to the middle within the dead zone and is followed
    by a share 1 - smoothing; the first one is taken as it is. Relative: the aim, in the middle at first,
    moves by that share of twice the scaled movement, where it is a fifth of the dead zone or more.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if relative:
        move = (F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))) * sensitivity * 2
        d = df.withColumn("_t", F.when(F.abs(move) < deadzone * 0.2, 0.0).otherwise(F.coalesce(move, F.lit(0.0))))
        start, step = F.lit(0.5), lambda s, v: unit(s + v * (1 - smoothing))
    else:
        at = (F.col(value) - centre) * sensitivity + 0.5
        d = df.withColumn("_t", unit(F.when(F.abs(at - 0.5) < deadzone, 0.5).otherwise(at)))
        start, step = F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v).otherwise(s + (v - s) * (1 - smoothing))
    return fold(d, [key], order, "_t", start, step, "aim").drop("_t")


def flicks(df: DataFrame, key: str, order: list[str], ms: str, y: str, rise: float = 0.18, back: int = 3, cooldown_ms: int = 800) -> DataFrame:
    """df with `flick`: y fell by more than `rise` over `back` rows, and more than the cooldown has passed since the last one."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_x", F.struct(F.col(ms).alias("t"), F.coalesce(F.lag(y, back).over(w) - F.col(y) > rise, F.lit(False)).alias("up")))
    step = lambda s, x: F.when(x["up"] & (s["last"].isNull() | (x["t"] - s["last"] > cooldown_ms)), F.struct(x["t"].alias("last"), F.lit(True).alias("hit"))).otherwise(F.struct(s["last"].alias("last"), F.lit(False).alias("hit")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("hit"))
    return fold(d, [key], order, "_x", start, step).select(key, *order, F.col("out.hit").alias("flick"))


def zones(x: Column, lean: Column) -> tuple[Column, Column]:
    """(left, right or still, lean left, right or none)."""
    return (F.when(x < -0.25, "left").when(x > 0.25, "right").otherwise("still"), F.when(lean < -0.08, "left").when(lean > 0.08, "right").otherwise("none"))


def move_keys(x: Column, y: Column, pinch: Column) -> dict[str, Column]:
    """Keys held by a hand's place relative to its rest (shares of the frame): w, a, s, d beyond a quarter, shift by a pinch."""
    return {"w": y < -0.25, "s": y > 0.25, "a": x < -0.25, "d": x > 0.25, "shift": pinch < 0.5}


def crouched(df: DataFrame, key: str, order: list[str], drop: Column, least: int = 3) -> DataFrame:
    """df with `crouch`: the face has been more than a tenth of the frame lower for `least` rows in a row."""
    return runs_of(df, key, order, drop > 0.1).withColumn("crouch", F.col("run") >= least).drop("run")


def audio_gate(df: DataFrame, key: str, order: list[str], start: Column, stop: Column, toggle: Column, cut: Column, idr: Column) -> DataFrame:
    """df with `open`: the row's recording runs, isn't paused and isn't between a cut and the next key frame. Each start begins afresh."""
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    switch = lambda on, off: F.last(F.when(on, True).when(off, False), ignorenulls=True)
    d = df.withColumn("_take", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(upto(key)))
    w = upto(key, "_take")
    on = F.coalesce(switch(start, stop).over(w), F.lit(False))
    paused = F.sum(F.coalesce(toggle, F.lit(False)).cast("int")).over(w) % 2 == 1
    gap = F.coalesce(switch(cut, idr).over(w), F.lit(False))
    return d.withColumn("open", on & ~paused & ~gap).drop("_take")


def palm_hold(df: DataFrame, key: str, order: list[str], ms: str, palm: Column, tap_ms: int = 600, kill_ms: int = 2000) -> DataFrame:
    """df with `tap` (a palm held for less than tap_ms so far) and `kill` (the first row at which one was held for more than kill_ms)."""
    d = df.withColumn("_p", F.coalesce(palm, F.lit(False)))
    w = Window.partitionBy(key).orderBy(*order)
    d = d.withColumn("_g", F.sum((~F.col("_p")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hold = Window.partitionBy(key, "_g", "_p").orderBy(*order)
    d = d.withColumn("_held", F.when(F.col("_p"), F.col(ms) - F.first(ms).over(hold.rowsBetween(Window.unboundedPreceding, 0))))
    over = F.col("_held") > kill_ms
    kill = over & ~F.coalesce(F.lag("_held").over(hold) > kill_ms, F.lit(False))
    return d.withColumns({"tap": F.coalesce(F.col("_held") < tap_ms, F.lit(False)), "kill": F.coalesce(kill, F.lit(False))}).drop("_p", "_g", "_held")


def aim_hand(df: DataFrame, key: str, order: list[str], first: str, second: str) -> DataFrame:
    """df with `aim`: 0 or 1, the hand of first and second (structs x, y; null if not seen) that aims; null if none is seen.

    A single hand aims. Of two, the one nearer to the last aiming hand's place does, the first on ties and at the start.
    """
    d = df.withColumn("_x", F.struct(F.col(first).alias("a"), F.col(second).alias("b")))
    d2 = lambda s, p: (p["x"] - s["x"]) * (p["x"] - s["x"]) + (p["y"] - s["y"]) * (p["y"] - s["y"])

    def step(s: Column, v: Column) -> Column:
        a, b = v["a"], v["b"]
        aim = F.when(a.isNull() & b.isNull(), F.lit(None).cast("int")).when(b.isNull(), 0).when(a.isNull(), 1).when(s["x"].isNull() | (d2(s, a) <= d2(s, b)), 0).otherwise(1)
        place = F.when(aim == 0, F.struct(a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"))).when(aim == 1, F.struct(b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y")))
        kept = F.coalesce(place, F.struct(s["x"].alias("x"), s["y"].alias("y")))
        return F.struct(kept["x"].alias("x"), kept["y"].alias("y"), aim.alias("aim"))
    nowhere = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("int").alias("aim"))
    return fold(d, [key], order, "_x", nowhere, step).select(key, *order, F.col("out.aim").alias("aim"))


def score(df: DataFrame, key: str, order: list[str], ms: str, fire: str, hit: str, lost: str, clip: int = 12, reload_ms: int = 1200) -> DataFrame:
    """df with `points`, `combo`, `best`, `ammo`, `health`: the game's state after each row of a player.

    `lost` targets that expired cost 5 health each and the combo; at no health all stands still. A shot needs a
    round and no reload going on; a hit raises the combo and scores 100 times it, a miss ends it. An empty clip
    begins a reload, which ends with the first row more than reload_ms later.
    """
    d = df.withColumn("_x", F.struct(F.col(ms).alias("t"), F.col(fire).alias("fire"), F.col(hit).alias("hit"), F.col(lost).alias("lost")))

    def bound(c: Column, f: Callable[[Column], Column]) -> Column:
        """f(c) with c computed once."""
        return F.get(F.transform(F.array(c), f), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        loaded = s["since"].isNotNull() & (x["t"] - s["since"] > reload_ms)
        since = F.when(~loaded, s["since"])
        ammo = F.when(loaded, clip).otherwise(s["ammo"])
        health = F.greatest(F.lit(0), s["health"] - 5 * x["lost"]).cast("int")
        combo = F.when(x["lost"] > 0, 0).otherwise(s["combo"])
        shot = x["fire"] & since.isNull() & (ammo > 0)
        ready = F.struct(since.alias("since"), ammo.alias("ammo"), health.alias("health"), combo.alias("combo"), shot.alias("shot"), s["points"].alias("points"), s["best"].alias("best"), x["t"].alias("t"), x["hit"].alias("hit"), (x["fire"] & since.isNull()).alias("tried"))

        def after(r: Column) -> Column:
            combo = F.when(r["shot"] & r["hit"], r["combo"] + 1).when(r["shot"], 0).otherwise(r["combo"])
            ammo = r["ammo"] - r["shot"].cast("int")
            return F.struct((r["points"] + F.when(r["shot"] & r["hit"], 100 * combo).otherwise(0)).cast("long").alias("points"), combo.alias("combo"), F.greatest(r["best"], combo).alias("best"), ammo.alias("ammo"),
                            r["health"].alias("health"), F.when(r["tried"] & (ammo <= 0), r["t"]).otherwise(r["since"]).alias("since"))
        return F.when(s["health"] <= 0, s).otherwise(bound(ready, after))
    names = ("points", "combo", "best", "ammo", "health")
    start = F.struct(F.lit(0).cast("long").alias("points"), F.lit(0).alias("combo"), F.lit(0).alias("best"), F.lit(clip).alias("ammo"), F.lit(100).alias("health"), F.lit(None).cast("long").alias("since"))
    return fold(d, [key], order, "_x", start, step).select(key, *order, *(F.col(f"out.{n}").alias(n) for n in names))


def hits(shots: DataFrame, targets: DataFrame, key: str, radius: float) -> DataFrame:
    """(shot, target): the first live target of the key within radius of the shot.

    Targets stand in the nine squares of side radius around them, so a shot meets only those of its own square.
    """
    square = lambda c: F.floor(F.col(c) / radius)
    t = targets.select(key, "target", "tx", "ty", F.explode(F.sequence(square("tx") - 1, square("tx") + 1)).alias("_cx"), square("ty").alias("_ty")).select(
        key, "target", "tx", "ty", "_cx", F.explode(F.sequence(F.col("_ty") - 1, F.col("_ty") + 1)).alias("_cy"))
    j = shots.withColumns({"_cx": square("x"), "_cy": square("y")}).join(t, [key, "_cx", "_cy"]).where((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 <= radius * radius)
    return j.groupBy(key, "shot").agg(F.min("target").alias("target"))


def spawn(seed: Column, n: int, moduli: tuple[int, ...] = (800, 650, 2, 500, 2)) -> Column:
    """n numbers drawn after seed: states of the 32-bit linear congruential sequence, their upper half modulo each of moduli in turn."""
    nxt = lambda s: (s * 1103515245 + 12345).bitwiseAND(0xFFFFFFFF)
    m = F.array(*map(F.lit, moduli))
    start = F.struct(seed.cast("long").bitwiseAND(0xFFFFFFFF).alias("s"), F.array().cast("array<bigint>").alias("a"))
    draw = lambda s, i: F.array((F.shiftright(s, 16) % F.get(m, (i % len(moduli)).cast("int"))).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, lambda acc, i: F.struct(nxt(acc["s"]).alias("s"), F.concat(acc["a"], draw(nxt(acc["s"]), i)).alias("a")))["a"]


def wave_targets(waves: DataFrame, wave: str, tick: Column) -> DataFrame:
    """waves with a row for each target: target, its place (shares of the frame), radius and speed (pixels a second).

    Wave n has 3 + n targets, at most 12; each takes five draws of the sequence after tick + 7919 n.
    """
    n = F.col(wave)
    drawn = waves.withColumn("_d", spawn(tick + n * 7919, 60)).withColumn("target", F.explode(F.sequence(F.lit(0), F.least(F.lit(11), n + 2))))
    draw = lambda i: F.get(F.col("_d"), (F.col("target") * 5 + i).cast("int"))
    sign = lambda i: F.when(draw(i) == 1, 1.0).otherwise(-1.0)
    speed = (20 + n * 6) * sign(2)
    return drawn.withColumns({"x": 0.1 + draw(0) / 1000, "y": 0.15 + draw(1) / 1000, "r": F.greatest(F.lit(14.0), 30 - n * 1.5),
                              "vx": speed * (0.5 + draw(3) / 1000), "vy": speed * 0.6 * sign(4)}).drop("_d")


def drift(df: DataFrame, key: str, order: list[str], dt: str, place: Column, speed: Column, size: int, lo: float, hi: float) -> DataFrame:
    """df with `at` and `v`: a target's place along one axis (a share of `size`) and its speed after each row's dt seconds; it turns beyond lo and hi."""
    d = df.withColumn("_x", F.struct(F.col(dt).cast("double").alias("dt"), place.cast("double").alias("at"), speed.cast("double").alias("v")))

    def step(s: Column, x: Column) -> Column:
        v = F.coalesce(s["v"], x["v"])
        at = F.coalesce(s["at"], x["at"]) + v * x["dt"] / size
        return F.struct(at.alias("at"), F.when((at < lo) | (at > hi), -v).otherwise(v).alias("v"))
    start = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("at", "v")))
    return fold(d, [key], order, "_x", start, step).select(key, *order, F.col("out.at").alias("at"), F.col("out.v").alias("v"))


def bitrate(w: Column, h: Column, fps: Column) -> Column:
    """Kilobits a second for a frame size and rate, 500..50000; 5000 where something is unknown."""
    return F.coalesce(F.floor(F.greatest(F.lit(500.0), F.least(F.lit(50000.0), w * h * fps * 0.07 / 1000))).cast("int"), F.lit(5000))


def settings(text: Column) -> Column:
    """key=value lines as a map; blank lines and comments go, the first of equal keys stays out of trouble by being the last written."""
    lines = F.filter(F.split(text, "\\r?\\n"), lambda x: x.contains("=") & ~F.trim(x).startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(unique)


def window_matches(title: Column, wanted: str, own: str) -> Column:
    """Whether a title holds the wanted text in any case, and isn't the program's own."""
    return F.lower(title).contains(wanted.lower()) & (title != own) & (F.lit(wanted) != "")


def progress(lines: DataFrame, key: str, order: str, text: str, last: int = 200) -> DataFrame:
    """The last lines of each key with the frame number and rate they report."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    num = lambda p: F.regexp_extract(text, p, 1)
    out = lines.withColumn("_n", n).where(F.col("_n") <= last).drop("_n")
    return out.withColumns({"frame": F.expr("try_cast(regexp_extract(`%s`, 'frame= *([0-9]+)', 1) as bigint)" % text), "fps": F.expr("try_cast(regexp_extract(`%s`, 'fps= *([0-9.]+)', 1) as double)" % text)})
