"""Results worked by hand from the operators' rules."""

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import detect, events, geometry, histogram, stencil, temporal, tone
from framelake.sources import bitstream


def px(spark, *rows):
    return spark.createDataFrame(list(rows), "f long, y int, x int, r int, g int, b int")


def colours(df):
    return {(r.y, r.x): (r.r, r.g, r.b) for r in df.collect()}


def test_green_is_keyed_with_soft_edge_and_spill(spark):
    # Hue 120, saturation 1, value .784: mask .8 * .9986 * .7295 = .5828, alpha .4172 steepened to .3471, green .7843 less .1371.
    assert colours(tone.chroma_key(px(spark, (0, 0, 0, 0, 200, 0), (0, 0, 1, 200, 0, 0)))) == {(0, 0): (0, 57, 0), (0, 1): (200, 0, 0)}


def test_matte_is_smoothed_over_its_whole_range(spark):
    front, back = px(spark, (0, 0, 0, 200, 200, 200)), px(spark, (0, 0, 0, 100, 100, 100))
    alpha = spark.createDataFrame([(0, 0, 0, 0.25)], "f long, y int, x int, a double")  # .0625 * 2.5 = .15625
    assert colours(tone.composite_alpha(front, back, alpha)) == {(0, 0): (116, 116, 116)}


def test_looks(spark):
    at = lambda preset, *key: next((r.r, r.g, r.b) for r in tone.lut(spark, preset).where("ri = {} and gi = {} and bi = {}".format(*key)).collect())
    assert at("warm", 16, 16, 16) == (255, 255, 230)
    assert at("cool", 8, 8, 8) == (115, 130, 145)
    assert at("cinematic", 8, 8, 8) == (131, 125, 135)  # one half itself: red falls by .01, blue too
    assert at("vintage", 0, 0, 0) == (13, 10, 15)  # grey of the lifted blacks .04527
    assert at("high_contrast", 4, 8, 16) == (51, 166, 255)
    assert at("desaturate", 16, 0, 0) == (168, 55, 55)  # grey .299: .5794 and .1794, then 1.1 c + .02


def test_flow_to_the_right_is_in_the_fourth_sector(spark):
    flow = spark.createDataFrame([(0, 0, 0, 3.0, 0.0)], "f long, y int, x int, dx double, dy double")
    assert colours(tone.flow_to_rgb(flow)) == {(0, 0): (45, 0, 90)}


def test_translation_moves_the_frame(spark):
    out = colours(geometry.translate(px(spark, *((0, y, x, 10 * y + x, 0, 0) for y in range(3) for x in range(3))), 3, 3, 1, -1))
    assert out[0, 1] == (10, 0, 0) and out[0, 0] == (0, 0, 0) and out[2, 2] == (0, 0, 0) and out[1, 2] == (21, 0, 0)


def test_letterbox_has_places_between_pixels(spark):
    out = colours(geometry.letterbox(px(spark, *((0, y, x, 40 * y, 0, 0) for y in range(2) for x in range(4))), 4, 2, 5, 5))
    # Scale 1.25, top (5 - 2.5) / 2 = 1.25: row 1 lies above the frame, row 2 at source row .6, row 3 at 1.4.
    assert [out[y, 0] for y in range(5)] == [(128, 128, 128), (128, 128, 128), (24, 0, 0), (40, 0, 0), (128, 128, 128)]


def test_tiles_fill_their_places_on_an_empty_canvas(spark):
    gray = spark.createDataFrame([(f, y, x, 50 * (f + 1)) for f in range(4) for y in range(4) for x in range(4)], "f long, y int, x int, v int")
    layout = spark.createDataFrame([(i, i, 4 * (i % 2), 4 * (i // 2), 4, 4, i != 3) for i in range(4)], "tile int, src_f long, dst_x int, dst_y int, tile_w int, tile_h int, active boolean")
    out = {(r.y, r.x): r.v for r in geometry.compose(gray, layout, 4, 4, 9, 8).collect()}
    assert [out[k] for k in ((2, 2), (2, 6), (6, 2), (6, 6), (0, 8))] == [50, 100, 150, 0, 0] and len(out) == 72


def test_clipped_bins_keep_their_own_remainder(spark):
    tile = spark.createDataFrame([(0, y, x, 5) for y in range(4) for x in range(4)], "f long, y int, x int, v int")
    # Limit .1875: the bin becomes 0, its excess 15 gives it one back since 5 < 15.
    assert {r.v: r.cdf for r in histogram.tile_tables(tile, 4, 3.0).collect()} == {v: 255 * (v > 5) for v in range(256)}


def test_background_blur_keeps_the_focus_and_a_flat_frame(spark):
    import numpy as np
    blur = stencil.plane_background_blur(0.5, 0.5)
    flat = blur(np.full((16, 16), 128.0)) + 0.5
    assert ((flat >= 127) & (flat < 129)).all()
    dot = np.zeros((17, 17))
    dot[8, 8] = 200.0
    assert np.floor(blur(dot)[8, 8] + 0.5) == 200 and blur(dot)[8, 12] > -0.5
    dot = np.zeros((16, 16))
    dot[8, 14] = 200.0  # three quarters of half the width away: well outside the focus
    assert blur(dot)[8, 14] < 100


def test_window_follows_the_first_face_at_once(spark):
    faces = spark.createDataFrame([(0, 100, 100, 200, 180, 0.9), (1, 100, 100, 200, 180, 0.3), (2, 150, 100, 250, 180, 0.9), (3, 153, 100, 253, 180, 0.9)], "f long, x1 int, y1 int, x2 int, y2 int, score double")
    out = {r.f: (r.left, r.top, r.w, r.h) for r in temporal.auto_frame(faces.withColumn("camera", F.lit(1)), 640, 480).collect()}
    # Twice the face, 16 above its centre; no face shows all; then 12 % of a move by 50, to 56; then of one by 47.
    assert out == {0: (50, 44, 200, 160), 1: (0, 0, 640, 480), 2: (56, 44, 200, 160), 3: (61, 44, 200, 160)}


def test_classes_and_their_colours(spark):
    d = spark.createDataFrame([(2,), (-5,), (9,), (80,)], "cls int")
    assert {r.cls: (r.class_name, r.cr, r.cg, r.cb) for r in detect.with_class(d).collect()} == {
        2: ("car", 202, 98, 202), -5: ("?", 80, 80, 80), 9: ("traffic light", 80 + 1341 % 176, 80 + 873 % 176, 80 + 549 % 176), 80: ("?", 80 + 11920 % 176, 80 + 7760 % 176, 80 + 4880 % 176)}


def test_a_hold_fires_again_after_the_cooldown(spark):
    d = spark.createDataFrame([(1, i, 100 * i, "a") for i in range(48)], "k int, seq int, ms long, g string")
    out = events.gesture_actions(d, "k", ["seq"], "ms", "g", {"a": 300}, 2000)
    assert sorted(r.seq for r in out.where("action = 'a'").collect()) == [3, 23, 43]


def test_aim_snaps_to_the_middle_and_relative_aim_adds_up(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.9, 0.52, 0.1, 0.101))], "k int, seq int, v double")
    out = [round(r.aim, 4) for r in events.smooth_aim(d, "k", ["seq"], "v", 0.5, 0.05).orderBy("seq").collect()]
    assert out == [0.9, 0.7, 0.4, 0.2505]  # towards .5 (within the dead zone), .1, .101
    out = [round(r.aim, 4) for r in events.smooth_aim(d, "k", ["seq"], "v", 0.5, 0.05, relative=True).orderBy("seq").collect()]
    assert out == [0.5, 0.12, 0.0, 0.0]  # moves -.38, -.42 (cut at 0), and one too small to count


def test_a_flick_needs_more_than_the_cooldown(spark):
    d = spark.createDataFrame([(1, i, 400 * i, 1.0 - 0.1 * i) for i in range(9)], "k int, seq int, ms long, y double")
    assert sorted(r.seq for r in events.flicks(d, "k", ["seq"], "ms", "y").where("flick").collect()) == [3, 6]


def test_double_of_a_flat_frame_keeps_its_middle():
    out = stencil.plane_double(0.5)(np.full((8, 8), 100.0))
    # Sixteen taps at clamped places: within the frame the weights sum to 1; away from the border nothing is sharpened.
    assert out.shape == (16, 16) and abs(out[8, 8] - 100) < 1e-9


def test_chroma_box_counts_the_own_column_twice(spark):
    rows = [(0, 1, 0, 0, 10), (0, 1, 0, 1, 40), (0, 0, 0, 0, 7)]
    got = {(r.p, r.x): r.v for r in stencil.denoise_planes(spark.createDataFrame(rows, "f long, p int, y int, x int, v int")).collect()}
    assert got == {(0, 0): 7, (1, 0): 10, (1, 1): 30}  # (10 + 2 * 40) / 3


def test_letters(spark):
    cells = geometry.text_dots(spark.createDataFrame([(0, 0, 0, 0, "i?")], "f long, z int, x0 int, y0 int, text string"))
    dots = sorted((r.y, r.x) for r in cells.where("dot").collect())
    assert dots == [(0, 0), (0, 1), (0, 2), (1, 1), (2, 1), (3, 1), (4, 0), (4, 1), (4, 2)] and cells.count() == 2 * 4 * 5


def test_flow_grows_with_the_frame(spark):
    flow = spark.createDataFrame([(0, 0, 0, 1.0, -2.0)], "f long, y int, x int, dx double, dy double")
    assert {(r.dx, r.dy) for r in geometry.resize_flow(flow, 1, 1, 2, 3).collect()} == {(2.0, -6.0)}


def test_eye_of_low_score_is_left_alone(spark):
    df = px(spark, *((0, y, x, 10 * x, 0, 0) for y in range(5) for x in range(5)))
    eyes = lambda score: spark.createDataFrame([(0, 0, 2.0, 2.0, 2.0, 1.0, 0.0, score)], "f long, eye int, cx double, cy double, er double, dx double, dy double, score double")
    assert colours(geometry.redirect_eyes(df, eyes(0.3), 5, 5, 1.0)) == colours(df)
    assert colours(geometry.redirect_eyes(df, eyes(0.9), 5, 5, 1.0))[2, 2] == (29, 0, 0)  # read .45 * 2 columns further on


def test_every_eye_of_a_frame_is_drawn_back_in_turn(spark):
    df = px(spark, *((0, y, x, 10 * x, 0, 0) for y in range(5) for x in range(20)))
    eyes = spark.createDataFrame([(0, n, 2.0 + 5 * n, 2.0, 2.0, 1.0, 0.0, 0.9) for n in range(4)], "f long, eye int, cx double, cy double, er double, dx double, dy double, score double")
    out = colours(geometry.redirect_eyes(df, eyes, 20, 5, 1.0))
    assert [out[2, 2 + 5 * n][0] for n in range(4)] == [29, 79, 129, 179]


def frames_of(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, n int, ms long, flag boolean")


def test_breaker_opens_after_enough_failures_and_stays_open(spark):
    polls = frames_of(spark, (0, False), (10, False), (5000, False), (5010, True), (5020, False), (5030, False), (5040, True))
    assert [r.open for r in temporal.breaker(polls, "k", ["n"], "ms", "flag", 4000, 1).orderBy("n").collect()] == [False] * 5 + [True, True]


def test_palm_taps_then_kills_once(spark):
    got = events.palm_hold(frames_of(spark, (0, True), (500, True), (700, True), (2100, True), (2200, True), (2300, False), (2400, True)), "k", ["n"], "ms", F.col("flag")).orderBy("n").collect()
    assert [(r.tap, r.kill) for r in got] == [(True, False), (True, False), (False, False), (False, True), (False, False), (False, False), (True, False)]


def test_nearest_hand_aims(spark):
    rows = [(1, 0, (0.0, 0.0), (9.0, 9.0)), (1, 1, (8.0, 8.0), (1.0, 1.0)), (1, 2, None, None), (1, 3, (2.0, 2.0), (5.0, 5.0)), (1, 4, (9.0, 9.0), None)]
    df = spark.createDataFrame(rows, "k int, n int, a struct<x: double, y: double>, b struct<x: double, y: double>")
    assert [r.aim for r in events.aim_hand(df, "k", ["n"], "a", "b").orderBy("n").collect()] == [0, 1, None, 0, 0]


def test_audio_is_kept_while_the_recording_runs(spark):
    rows = [(1, i, c) for i, c in enumerate(["", "start", "", "cut", "", "key", "pause", "", "pause", "stop", "start", "pause", "start"])]
    df = spark.createDataFrame(rows, "k int, n int, c string")
    is_ = lambda c: F.col("c") == c
    got = events.audio_gate(df, "k", ["n"], is_("start"), is_("stop"), is_("pause"), is_("cut"), is_("key")).orderBy("n").collect()
    assert [r.n for r in got if r.open] == [1, 2, 5, 8, 10, 12]


def test_score(spark):
    rows = [(1, 0, 0, True, True, 0), (1, 1, 1, True, True, 0), (1, 2, 2, True, True, 0), (1, 3, 1300, True, False, 0), (1, 4, 1400, False, False, 2)]
    df = spark.createDataFrame(rows, "k int, n int, ms long, fire boolean, hit boolean, lost int")
    got = events.score(df, "k", ["n"], "ms", "fire", "hit", "lost", clip=2).orderBy("n").collect()
    # Two hits empty the clip, the third shot finds a reload going on, after it a miss ends the combo.
    assert [tuple(r)[2:] for r in got] == [(100, 1, 1, 1, 100), (300, 2, 2, 0, 100), (300, 2, 2, 0, 100), (300, 0, 2, 1, 100), (300, 0, 2, 1, 90)]


def test_folds_go_on_across_blocks(spark):
    df = spark.range(20).select(F.lit(1).alias("k"), "id")
    got = temporal.fold(df, ["k"], ["id"], "id", F.lit(0).cast("long"), lambda s, v: s + v, block=3).orderBy("id").collect()
    assert [r.out for r in got] == [sum(range(i + 1)) for i in range(20)]


def test_parameter_sets_come_first(spark):
    hvcc = bytes(22) + bytes([2]) + bytes([32, 0, 1, 0, 2]) + b"vp" + bytes([33, 0, 1, 0, 1]) + b"s"
    assert bitstream.hevc_parameter_sets(hvcc) == [b"vp", b"s"] and bitstream.hevc_parameter_sets(b"") == []
    out = bitstream.with_parameter_sets(spark.createDataFrame([(1, hvcc)], "id int, payload binary"), spark.createDataFrame([(1, 0, b"x"), (2, 0, b"y")], "id int, no int, unit binary"), True)
    assert sorted((r.id, r.no, bytes(r.unit)) for r in out.collect()) == [(1, 0, b"vp"), (1, 1, b"s"), (1, 2, b"x"), (2, 0, b"y")]


def test_detector_cells(spark):
    rows = [(1, 0, 50.0, 50.0, 20.0, 20.0, [0.1, 0.9]), (1, 1, 51.0, 50.0, 20.0, 20.0, [0.8, 0.8]), (1, 2, 5.0, 5.0, 20.0, 20.0, [0.5, 0.2]), (1, 3, 50.0, 50.0, 9.0, 9.0, [0.3, 0.3])]
    got = detect.detections(spark.createDataFrame(rows, "frame int, cell int, cx double, cy double, bw double, bh double, scores array<double>"), 1.0, 0.0, 0.0, 100, 100)
    assert [(r.box, r.cls, r.x1, r.y2) for r in got.orderBy("rank").collect()] == [(0, 1, 40.0, 60.0), (2, 0, 0.0, 15.0)]


def test_face_points(spark):
    rows = [(1, 32, 0, 9.0, 9.0, 0.0, 0.0, 0.0, 0.0), (1, 32, 3, -9.0, 9.0, 0.0, 0.0, 0.0, 0.0)]
    got = detect.faces(spark.createDataFrame(rows, "frame int, stride int, i int, cls double, obj double, dx double, dy double, lw double, lh double"), 64, 1.0, 0.0, 0.0, 64, 64).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(0.0, 0.0, 32.0, 32.0)]


def test_hand_windows_and_joints(spark):
    rows = [(1, 0, 10.0, 10.0, 30.0, 20.0, 3.0), (1, 1, 12.0, 10.0, 30.0, 20.0, 2.0), (1, 2, 180.0, 180.0, 6.0, 6.0, 0.0), (1, 3, 50.0, 50.0, 9.0, 9.0, -0.1), (2, 0, 0.0, 0.0, 150.0, 9.0, 1.0)]
    raw = spark.createDataFrame(rows, "frame int, anchor int, x double, y double, bw double, bh double, logit double")
    windows = detect.hands(raw, 384, 192)
    # 1.6 * 60 = 96 around (50, 20); at least 32 around (366, 183); 480 is more than the frame.
    assert sorted((r.frame, r.hand, r.left, r.top, r.side) for r in windows.collect()) == [(1, 0, 2, 0, 96), (1, 1, 350, 160, 32)]
    points = spark.createDataFrame([(1, 0, 0, 0.5, 112.0), (1, 0, 1, 1.5, 1.6)], "frame int, hand int, joint int, x double, y double")
    assert [(r.x, round(r.y, 4)) for r in detect.hand_joints(points, windows).orderBy("joint").collect()] == [(50.0, 48.0), (146.0, 0.6857)]


def test_working_sizes(spark):
    d = spark.createDataFrame([(1280, 720), (3840, 2160), (921600, 4)], "w int, h int")
    assert [tuple(r) for r in d.select(*detect.work_size(F.col("w"), F.col("h"))).collect()] == [(1280, 720), (1280, 720), (460800, 64)]


def test_blur_behind_keeps_what_the_matte_covers(spark):
    p = px(spark, *((1, y, x, 200 if x < 2 else 0, 0, 0) for y in range(4) for x in range(4)))
    whole = spark.createDataFrame([(1, y, x, 1.0) for y in range(2) for x in range(2)], "f long, y int, x int, a double")
    assert colours(detect.blur_behind(p, whole, 2, 2, 4, 4)) == colours(p)
    none = detect.blur_behind(p, whole.withColumn("a", F.lit(0.0)), 2, 2, 4, 4)
    assert colours(none) == colours(stencil.gaussian(p, 4, 4, 6.0, ("r", "g", "b")))


def test_targets_of_a_wave_and_their_way(spark):
    got = events.wave_targets(spark.createDataFrame([(1, 10)], "k int, wave int"), "wave", F.lit(0))
    assert got.count() == 12 and {r.r for r in got.collect()} == {15.0}
    first = (10 * 7919 * 1103515245 + 12345) % 2**32
    assert got.where("target = 0").first().x == 0.1 + (first >> 16) % 800 / 1000
    d = spark.createDataFrame([(1, t, 1.0) for t in range(4)], "k int, t int, dt double")
    out = events.drift(d, "k", ["t"], "dt", F.lit(0.5), F.lit(16.0), 64, 0.1, 0.9).orderBy("t").collect()
    assert [(r.at, r.v) for r in out] == [(0.75, 16.0), (1.0, -16.0), (0.75, -16.0), (0.5, -16.0)]
