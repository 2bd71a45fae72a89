"""The display worked by hand."""

from pyspark.sql import functions as F

from framelake.operators import hud

STATE = "f long, score long, health int, ammo int, reloading boolean, time double, wave int, combo int, best int, phase string, aim_x double, aim_y double, targets array<struct<nx:double,ny:double,r:double,alive:boolean,flash:double>>"


def shown(df):
    return {(r.f, r.y, r.x): (r.r, r.g, r.b) for r in df.collect()}


def test_layers_of_the_trainer(spark):
    targets = [(0.5, 0.5, 9.7, True, 0.0), (0.5, 0.52, 5.0, True, 0.4), (0.1, 0.9, 9.0, False, 0.0)]
    rows = [(0, 300, 95, 7, False, 12.9, 2, 3, 4, "play", 0.9, 0.5, targets), (1, 0, 100, 12, True, 0.0, 1, 1, 0, "idle", None, None, [])]
    out = shown(hud.top_cells(hud.trainer(spark.createDataFrame(rows, STATE), 200, 100), 200, 100))
    assert out[0, 8, 8] == (0, 0, 0) and out[0, 8, 10] == (255, 255, 255)  # the S of SC: its upper row is .##
    assert out[0, 30, 10] == (255, 220, 0) and (1, 30, 10) not in out  # a combo of 3; one of 1 isn't shown
    assert out[0, 50, 91] == (230, 40, 40) and (0, 50, 90) not in out  # rim of 9 around column 100
    assert out[0, 50, 104] == (255, 255, 40)  # the second target, lit, lies over the first one's middle: 4 columns, 2 rows from its centre (100, 52)
    assert out[0, 52, 101] == (255, 255, 255) and (0, 90, 20) not in out  # its middle of radius 2; a dead one isn't drawn
    assert out[0, 50, 162] == (0, 255, 255) and out[0, 32, 180] == (0, 255, 255) and (0, 31, 180) not in out  # arms of 18
    assert out[1, 40, 10] == (255, 255, 255) and out[1, 70, 50] == (255, 220, 0) and not any(k[0] == 1 and v == (0, 255, 255) for k, v in out.items())


def test_display_over_a_program_on_a_frame(spark):
    state = spark.createDataFrame([(0, 0.05, 0.05, "CS"), (1, None, 0.5, None)], "f long, aim_x double, aim_y double, program string")
    px = spark.range(2).select(F.col("id").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y")).select("f", "y", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("x"), *(F.lit(7).alias(c) for c in "rgb"))
    out = shown(hud.draw(px, hud.external(state, 60, 40), 60, 40))
    assert len(out) == 2 * 60 * 40 and out[0, 39, 59] == (7, 7, 7)
    assert out[0, 2, 19] == (0, 255, 0) and out[0, 2, 20] == (7, 7, 7)  # the right arm ends at 3 + 16
    assert out[0, 8, 8] == (0, 120, 0) and out[0, 8, 10] == (255, 255, 255)  # the text's background lies over the disc
    assert out[1, 2, 19] == (7, 7, 7) and out[1, 8, 8] == (0, 120, 0)
