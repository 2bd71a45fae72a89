"""Frame operators on the usable reference inputs, and the properties every operator of a kind shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import frames
from framelake.operators import color, detect, geometry, histogram, stencil, temporal, tone
from framelake.plans import chain


def image(spark, rows):
    """(f, y, x, r, g, b) from {(f, y, x): (r, g, b)}."""
    return spark.createDataFrame([(f, y, x, *c) for (f, y, x), c in rows.items()], "f long, y int, x int, r int, g int, b int")


def values(df, channels=("r", "g", "b")):
    return {(r.f, r.y, r.x): tuple(r[c] for c in channels) for r in df.collect()}


@pytest.fixture(scope="module")
def noisy(spark):
    """One 12 by 8 frame of pseudo-random colours, and a second one."""
    rng = np.random.default_rng(5)
    return image(spark, {(f, y, x): tuple(int(v) for v in rng.integers(0, 256, 3)) for f in (0, 1) for y in range(8) for x in range(12)}).cache()


def test_planes_to_colour_and_back_stays_close(spark):
    p = frames.ramp(spark, 1, 16, 16).select("f", F.lit(0).alias("p"), "y", "x", ((3 * F.col("x") + 5 * F.col("y")) % 256).cast("int").alias("v"))
    half = frames.test_pattern(spark, 1, 8, 8).select("f", "y", "x", F.lit(128).alias("v"))
    planes = p.unionByName(half.select("f", F.lit(1).alias("p"), "y", "x", "v")).unionByName(half.select("f", F.lit(2).alias("p"), "y", "x", "v"))
    back = color.rgb_to_planes(color.planes_to_rgb(planes)).where("p = 0")
    assert histogram.mean_absolute_error(p.drop("p"), back.drop("p")).first().mae < 5


@pytest.mark.parametrize("alpha,want", [(0.0, 100), (0.5, 150), (1.0, 200)])
def test_blend_of_constants(spark, alpha, want):
    a, b = (image(spark, {(0, y, x): (v, v, v) for y in range(4) for x in range(4)}) for v in (100, 200))
    assert set(values(tone.blend(a, b, alpha)).values()) == {(want,) * 3}


def test_flips_undo_themselves_and_whole_crops_change_nothing(noisy):
    same = values(noisy)
    assert values(geometry.flip(geometry.flip(noisy, 12, 8), 12, 8)) == same
    assert values(geometry.flip(geometry.flip(noisy, 12, 8, False), 12, 8, False)) == same
    assert values(geometry.crop(noisy, 12, 8, 0, 0)) == same == values(geometry.crop_inside(noisy, 12, 8, 0, 0))
    assert values(geometry.translate(noisy, 12, 8, 0, 0)) == same and values(geometry.lens(noisy, 12, 8, 0.0)) == same


def test_resizing_to_the_same_size_changes_nothing(noisy):
    same = values(noisy)
    for f in (geometry.resize_bilinear, geometry.resize_nearest):
        assert values(f(noisy, 12, 8, 12, 8)) == same
    # Bicubic taps that fall outside are weighted at the clamped place, so only the interior is kept.
    cubic = values(geometry.resize_bicubic(noisy, 12, 8, 12, 8))
    assert all(cubic[k] == same[k] for k in same if 1 <= k[1] <= 5 and 1 <= k[2] <= 9)


def test_smoothing_keeps_a_constant_image(spark):
    flat = image(spark, {(0, y, x): (77, 77, 77) for y in range(8) for x in range(8)})
    rgb = ("r", "g", "b")
    for out in (stencil.bilateral(flat, channels=rgb), stencil.gaussian(flat, 8, 8, channels=rgb), stencil.sharpen(flat, channels=rgb), stencil.directional_blur(flat, 20.0, 5, rgb)):
        assert set(values(out).values()) == {(77, 77, 77)}
    gray = flat.select("f", "y", "x", F.col("r").alias("v"))
    blurred = stencil.unpack_planes(stencil.map_planes(stencil.pack_planes(gray, 8, 8), stencil.plane_background_blur(0.5, 0.5)))
    assert {r.v for r in blurred.collect()} <= {76, 77}


def test_relational_and_plane_plans_agree(noisy):
    gray = noisy.select("f", "y", "x", F.col("r").alias("v"))
    packed = stencil.pack_planes(gray, 12, 8)
    assert values(stencil.unpack_planes(packed), ("v",)) == values(gray, ("v",))
    for kernel in (3, 5):
        assert values(stencil.unpack_planes(stencil.map_planes(packed, stencil.plane_bilateral(kernel=kernel))), ("v",)) == values(stencil.bilateral(gray, kernel=kernel), ("v",))
    assert values(stencil.unpack_planes(stencil.map_planes(packed, stencil.plane_gaussian(2.0))), ("v",)) == values(stencil.gaussian(gray, 12, 8, 2.0), ("v",))


def test_crop_pads_with_its_fill_and_temporal_mean(spark):
    flat = image(spark, {(0, y, x): (100,) * 3 for y in range(4) for x in range(4)})
    got = values(geometry.crop(flat, 4, 4, 2, 2, fill=(1, 2, 3)))
    assert got[(0, 0, 0)] == (100,) * 3 and got[(0, 3, 3)] == (1, 2, 3)
    two = spark.createDataFrame([(0, 0, 0, 100), (1, 0, 0, 105)], "f long, y int, x int, v int")
    assert values(temporal.fir_denoise(two, 0.5), ("v",)) == {(0, 0, 0): (100,), (1, 0, 0): (103,)}
    assert values(temporal.iir_denoise(two, 0.5), ("v",)) == {(0, 0, 0): (100,), (1, 0, 0): (103,)}


def test_hdr_and_tables_stay_in_range_and_running_sums_grow(spark, noisy):
    for f in (tone.hdr_reinhard, tone.hdr_aces):
        assert all(0 <= v <= 255 for c in values(f(noisy, 100.0)).values() for v in c)
    gray = noisy.select("f", "y", "x", F.col("g").alias("v"))
    rows = histogram.tile_tables(gray, 4, 3.0).orderBy("f", "ty", "tx", "v").collect()
    for a, b in zip(rows, rows[1:]):
        assert (a.f, a.ty, a.tx) != (b.f, b.ty, b.tx) or a.cdf <= b.cdf


def test_identity_look_up_table(spark, noisy):
    grid = spark.range(17**3).select((F.col("id") % 17).cast("int").alias("ri"), (F.floor(F.col("id") / 17) % 17).cast("int").alias("gi"), F.floor(F.col("id") / 289).cast("int").alias("bi"))
    plain = grid.select("*", *(F.floor(F.col(f"{c}i") / 16.0 * 255 + 0.5).cast("int").alias(c) for c in "rgb"))
    got, want = values(tone.apply_lut(noisy, plain)), values(noisy)
    assert all(abs(a - b) <= 1 for k in want for a, b in zip(got[k], want[k]))
    assert values(tone.apply_lut(noisy, tone.lut(spark, "cool"), strength=0.0)) == want
    for preset in tone.PRESETS:
        assert tone.lut(spark, preset).count() == 17**3


def test_inset_geometry(spark):
    sizes = spark.createDataFrame([(960, 540), (1920, 1080), (100, 60)], "w int, h int")
    got = {(r.w, r.h): r for r in sizes.select("*", *(c.alias(n) for n, c in geometry.pip_box(F.col("w"), F.col("h")).items())).collect()}
    assert tuple(got[(960, 540)])[2:] == (160, 90, 788, 438, True)
    assert tuple(got[(1920, 1080)])[2:4] == (320, 180) and not got[(100, 60)].ok


def test_suppression_leaves_no_overlap_and_is_idempotent(spark):
    rng = np.random.default_rng(3)
    rows = [(f, i, int(x), int(y), int(x + w), int(y + h), int(s), 0) for f in range(4) for i, (x, y, w, h, s) in enumerate(rng.integers(1, 60, (14, 5)))]
    boxes = spark.createDataFrame(rows, "frame long, box int, x1 int, y1 int, x2 int, y2 int, score long, cls int")
    kept = detect.suppress(boxes, 0.3)
    pairs = kept.alias("a").join(kept.alias("b"), F.expr("a.frame = b.frame and a.box < b.box"))
    s = lambda n: F.struct(*(F.col(f"{n}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    assert pairs.where(detect.iou(s("a"), s("b")) > 0.3).count() == 0
    assert sorted(map(tuple, detect.suppress(kept, 0.3).drop("rank").collect())) == sorted(map(tuple, kept.drop("rank").collect()))
    assert len(detect.CLASSES) == 80


def test_block_motion_finds_a_shift(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (40, 40))
    rows = [(f, y, x, int(base[y + 4 * f, x + 2 * f])) for f in (0, 1) for y in range(32) for x in range(32)]
    px = spark.createDataFrame(rows, "f long, y int, x int, v int")
    got = stencil.block_motion(px, 16, 8, 2, 32, 32).where("f = 1").collect()
    inside = [(r.dy, r.dx) for r in got if (r.by, r.bx) == (0, 0)]
    assert inside == [(4, 2)]


def test_chain_flags_round_trip_and_order(spark, noisy):
    spec = chain.parse_flags("--flip --gamma g=0.8 --crop w=6 h=4 left=1 top=2 --lut preset=warm strength=0.5", 12, 8)
    assert spec.chain() == ("crop", "lut", "gamma", "flip") and chain.parse_flags(chain.to_flags(spec), 12, 8) == spec
    assert not chain.Spec(4, 4, "file", {"crop": {}}).needs_rgb() and spec.needs_rgb()
    with pytest.raises(ValueError):
        chain.parse_flags("--unknown", 4, 4)
    by_hand = tone.gamma(geometry.crop(noisy, 6, 4, 1, 2), 0.8)
    assert values(chain.compile_chain(chain.Spec(12, 8, "file", {"gamma": {"g": 0.8}, "crop": {"w": 6, "h": 4, "left": 1, "top": 2}}), noisy)) == values(by_hand)
