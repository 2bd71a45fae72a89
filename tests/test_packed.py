"""Whole frames: the chain's steps against their pixel forms, layouts, regions, windows, carried state, containers."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import detect, geometry, grades, histogram, packed, sequence, stencil, tone
from framelake.plans import chain
from framelake.sources import containers
from framelake.streaming import states

W, H = 9, 7


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(5)
    rows = [(f, y, x, *map(int, rng.integers(0, 256, 3))) for f in range(4) for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "f long, y int, x int, r int, g int, b int").repartition(3).cache()


@pytest.fixture(scope="module")
def frames(noise):
    return packed.pack(noise, W, H).cache()


def values(px):
    return {(r.f, r.y, r.x): (r.r, r.g, r.b) for r in px.collect()}


def test_packing_is_reversible_and_joins_split_frames(spark, noise, frames):
    assert values(packed.unpack(frames)) == values(noise)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)  # frames of 63 pixels come in pieces
    try:
        assert values(packed.unpack(packed.pack(noise, W, H))) == values(noise)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert packed.pack(noise.limit(0), W, H).count() == 0


STEPS = {
    "saturation": (lambda p: tone.saturation(p, 1.4), grades.saturation(1.4)), "gamma": (lambda p: tone.gamma(p, 0.8), grades.gamma(0.8)),
    "vignette": (lambda p: tone.vignette(p, W, H, 0.6), grades.vignette(0.6)), "grain": (tone.film_grain, grades.grain()),
    "reinhard": (lambda p: tone.hdr_reinhard(p, 120.0), grades.hdr(peak=120.0)), "aces": (lambda p: tone.hdr_aces(p, 150.0), grades.hdr("aces", 150.0)),
    "chroma": (tone.chroma_key, grades.chroma_key()), "look": (lambda p: tone.apply_lut(p, tone.lut(p.sparkSession, "vintage"), strength=0.75), grades.lut("vintage", 0.75)),
    "lens": (lambda p: geometry.lens(p, W, H, 0.2), grades.lens(0.2)), "crop": (lambda p: geometry.crop(p, 6, 5, 5, 4), grades.crop(6, 5, 5, 4)),
    "pad": (lambda p: geometry.pad(p, W, H, 2, 1, (1, 2, 3)), grades.pad(2, 1, (1, 2, 3))), "cubic": (lambda p: geometry.resize_bicubic(p, W, H, 12, 5), grades.scale(12, 5, "bicubic")),
    "nearest": (lambda p: geometry.resize_nearest(p, W, H, 12, 5), grades.scale(12, 5, "nearest")), "zoom": (lambda p: geometry.zoom(p, W, H, 2.0), grades.zoom(2.0)),
    "bilateral": (lambda p: stencil.bilateral(p, channels=packed.RGB), packed.bilateral()), "gaussian": (lambda p: stencil.gaussian(p, W, H, 2.0, packed.RGB), packed.gaussian(2.0)),
    "sharpen": (lambda p: stencil.sharpen(p, 1.0, packed.RGB), packed.sharpen(1.0)), "edges": (lambda p: stencil.edges(p, W, H), packed.edges()),
    "line": (lambda p: stencil.directional_blur(p, 30.0, 4, packed.RGB), packed.directional_blur(30.0, 4)), "clahe": (lambda p: histogram.equalise_rgb(p, W, H, 4, 40.0), grades.clahe(4, 40.0)),
}


@pytest.mark.parametrize("name", STEPS)
def test_steps_on_frames_are_those_on_pixels(noise, frames, name):
    pixels, stack = STEPS[name]
    assert values(packed.unpack(packed.map_frames(frames, stack))) == values(pixels(noise))


def test_chains_of_both_plans_agree_and_frames_are_read_once(spark, noise, frames, tmp_path):
    spec = chain.Spec(W, H, "file", {"crop": {"w": 6, "h": 4, "left": 1, "top": 2}, "gamma": {"g": 0.8}, "flip": {}, "vignette": {}})
    assert values(chain.compile_chain(spec, noise)) == values(packed.unpack(chain.compile_frames(spec, frames)))
    both = chain.Spec(W, H, "live", {"clahe": {"tile": 4}, "super_res": {}, "background_blur": {}, "pad": {"px_x": 1, "px_y": 1}})
    out = chain.compile_chain(both, noise)
    assert both.chain() == ("super_res", "clahe", "background_blur", "pad") and out.agg(F.max("x"), F.max("y")).first()[:] == (2 * W + 1, 2 * H + 1)
    matrix = chain.batch_matrix(frames, {"a": spec, "b": both, "c": chain.Spec(W, H)})
    assert {(r.config, r.w, r.h) for r in matrix.collect()} == {("a", 6, 4), ("b", 2 * W + 2, 2 * H + 2), ("c", W, H)}
    frames.write.parquet(str(tmp_path / "frames"))
    stored = chain.batch_matrix(spark.read.parquet(str(tmp_path / "frames")), {"a": spec, "b": both})
    assert stored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError):
        chain.compile_frames(chain.Spec(W, H, "file", {"stabilise": {}}), frames)


def film(spark, rows, c=1):
    """(camera, f, w, h, c, data) of rows (camera, f, array)."""
    return spark.createDataFrame([(k, f, a.shape[1], a.shape[0], c, a.astype(np.uint8).tobytes()) for k, f, a in rows], f"camera long, f long, {packed.FRAME}")


def shots(df):
    return {(r.camera, r.f): np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, r.c)[..., 0].tolist() for r in df.collect()}


@pytest.fixture
def adding():
    """Makes a step whose state is the sum of the frames so far and their number."""
    def make():
        def step(state, frame):
            total = frame.astype(int) + (state[0] if state else 0)
            return np.minimum(total, 255).astype(np.uint8), [total, np.array([1 + (int(state[1][0]) if state else 0)])]
        return step
    return make


ROWS = [(1, f, np.full((2, 3), 10 + f)) for f in range(4)] + [(1, 4, np.full((2, 2), 7)), (1, 5, np.full((2, 2), 5))] + [(2, f, np.full((1, 1), 100)) for f in (0, 3, 9)]


def test_state_is_carried_and_begins_anew_with_another_shape(spark, adding):
    out = shots(sequence.recurrent(film(spark, ROWS).repartition(4), adding))
    assert [out[1, f][0][0] for f in range(6)] == [10, 21, 33, 46, 7, 12] and [out[2, f][0][0] for f in (0, 3, 9)] == [100, 200, 255]


def test_a_stream_carries_the_same_state_over_its_batches(spark, tmp_path, adding):
    schema = film(spark, ROWS).schema
    for i, part in enumerate((lambda k, f: f < 2, lambda k, f: 2 <= f < 5, lambda k, f: f >= 5)):
        film(spark, [r for r in ROWS if part(*r[:2])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = states.recurrent(stream, adding).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert shots(spark.read.parquet(str(tmp_path / "out"))) == shots(sequence.recurrent(film(spark, ROWS), adding))


def test_windows_cross_blocks_and_need_numbers_in_a_row(spark):
    rows = [(1, f, np.full((1, 1), f)) for f in range(12) if f != 8] + [(2, f, np.full((1, 1 + f % 2), f)) for f in range(4)]
    out = shots(sequence.map_windows(film(spark, rows).repartition(3), lambda: lambda window: sum(x.astype(int) for x in window).astype(np.uint8), 3, block=4))
    assert out == {(1, f): [[3 * f - 3]] for f in (2, 3, 4, 5, 6, 7, 11)}


def test_denoiser_sees_planes_and_a_noise_map_at_its_working_size(spark):
    seen = []

    def model():
        def run(t, noise):
            assert t.shape == (1, 6, 8, 8) or t.shape == (1, 6, 64, 64)
            assert noise.shape == (1, 1, *t.shape[2:]) and np.allclose(noise, 0.05)
            return t[:, 3:]
        return run
    work = sequence.denoised(model, budget=100)()
    frame = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    assert (work([frame, frame]) == frame).all() and not seen
    assert (work([np.full((20, 20, 3), 9, np.uint8)] * 2) == 9).all()


def test_matting_smooths_the_matte_and_feeds_its_states_back():
    shapes = []

    def model():
        def run(t, states):
            shapes.append([s.shape for s in states])
            return np.full(t.shape[2:], 0.25, np.float32), [np.ones((1, 2, 1, 1), np.float32)]
        return run
    step = sequence.matted(model, (4, 4), (2, 3), sigma=0.5)()
    frame = np.full((4, 4, 3), 200, np.uint8)
    out, state = step(None, frame)
    assert np.allclose(out, 200) and shapes == [[(1, 2, 1, 1), (1, 3, 1, 1)]]
    step(state, frame)
    assert shapes[1] == [(1, 2, 1, 1)]


def test_a_moved_picture_is_steadied():
    rng = np.random.default_rng(2)
    big = rng.integers(0, 256, (40, 40, 1)).astype(np.uint8)
    a, b = big[4:36, 4:36], big[4:36, 8:40]  # seen from further right, the picture moves to the left
    assert sequence.motion(a, b) == (4, 0)
    step = sequence.steadied(0.5)()
    first, state = step(None, a)
    out, state = step(state, b)
    assert (first == a).all() and state[1].tolist() == [2, 0] and (out == sequence.translated(b, 2, 0)).all()
    assert (sequence.translated(a, 3, -2)[:-2, 3:] == a[2:, :-3]).all() and not sequence.translated(a, 40, 0).any()


def test_layouts(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 51, 255), (0, 0, 1, 255, 102, 0)], "f long, y int, x int, r int, g int, b int")
    fr = packed.pack(px, 2, 1)
    numbers = lambda t: [round(r.v, 4) for r in packed.samples(t).orderBy("i").collect()]
    assert numbers(packed.to_tensors(fr)) == [0, 1, 0.2, 0.4, 1, 0]
    assert numbers(packed.to_tensors(fr, "nhwc", "signed", bgr=True)) == [1, -0.6, -1, -1, -0.2, 1]
    assert packed.to_tensors(fr).first().shape == [1, 3, 1, 2] and packed.interleaved(packed.to_tensors(fr)).first().shape == [1, 1, 2, 3]
    for layout in ("nchw", "nhwc"):
        for span in packed.RANGES:
            for bgr in (False, True):
                assert values(packed.unpack(packed.from_tensors(packed.to_tensors(fr, layout, span, bgr), layout, span, bgr))) == values(px)


def test_regions(spark):
    fr = film(spark, [(0, f, np.arange(100).reshape(10, 10)) for f in range(2)]).drop("camera")
    w = spark.createDataFrame([(0, 0, 2, 1, 4), (0, 1, 7, 0, 4), (1, 0, 0, 0, 2)], "frame long, hand int, left int, top int, side int")
    out = {(r.f, r.id): np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w).tolist() for r in detect.hand_crops(fr, w, 2).collect()}
    assert out == {(0, 0): [[12, 14], [32, 34]], (1, 0): [[0, 1], [10, 11]]}  # the second window of frame 0 leaves it


def test_eyes_and_gaze(spark):
    faces = spark.createDataFrame([(0, 0, 0.0, 0.0, 100.0, 100.0, 0.9), (0, 1, 500.0, 400.0, 660.0, 520.0, 0.8)], "frame long, box int, x1 double, y1 double, x2 double, y2 double, score double")
    places = detect.eye_places(faces, 640, 480)
    assert {(r.id, r.left, r.top) for r in places.collect()} == {(0, 0, 10), (1, 38, 10), (2, 516, 416), (3, 576, 416)}  # 30 - 32 is pushed in; 612 - 32 too
    points = spark.createDataFrame([(0, i, p, 35.0 + d, 36.0) for i in (0, 3) for p, d in enumerate((-2, -1, 0, 1, 2))] + [(0, 1, 0, 70.0, 1.0)], "frame long, id long, point int, x double, y double")
    got = {r.id: r for r in detect.gaze(points, places).collect()}
    assert set(got) == {0, 3} and (got[0].cx, got[0].cy, got[0].er, got[0].dx, got[0].dy) == (35.0, 46.0, 16.0, 0.6, 0.8) and got[3].er == pytest.approx(25.6)
    assert detect.eye_places(faces, 63, 480).count() == 0


def mp4(samples, chunk=2):
    """A file with a sound track and a video track of samples, `chunk` of them in a chunk."""
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    full = lambda kind, *parts: box(kind, b"\0" * 4, *parts)
    head = box(b"ftyp", b"isom")
    at, chunks = len(head) + 8, []
    for i in range(0, len(samples), chunk):
        chunks.append(at)
        at += sum(map(len, samples[i:i + chunk]))
    n = len(samples)
    runs = [(1, chunk, 1)] + ([(len(chunks), n % chunk, 1)] if n % chunk else [])
    stbl = box(b"stbl", full(b"stts", struct.pack(">III", 1, n, 40)), full(b"stsz", struct.pack(">II", 0, n), b"".join(struct.pack(">I", len(s)) for s in samples)),
               full(b"stco", struct.pack(">I", len(chunks)), b"".join(struct.pack(">I", c) for c in chunks)), full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)))
    track = lambda kind, *rest: box(b"trak", box(b"mdia", full(b"hdlr", b"\0" * 4, kind, b"\0" * 12), *rest))
    return head + box(b"mdat", *samples) + box(b"moov", track(b"soun"), track(b"vide", box(b"minf", stbl)))


def test_containers_are_read_in_ranges(spark, tmp_path):
    containers.register(spark)
    samples = [bytes([i]) * (5 + i) for i in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(mp4(samples))
    (tmp_path / "in" / "b.ivf").write_bytes(b"DKIF" + b"\0" * 28 + b"".join(struct.pack("<IQ", len(s), 7 * i) + s for i, s in enumerate(samples)) + b"\x09\0\0\0half")
    df = spark.read.format(containers.NAME).option("bytesPerPartition", 20).load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() >= 6  # more tasks than files
    got = {(r.path[-5:], r.no): (r.pts, bytes(r.unit)) for r in df.collect()}
    assert got == {("a.mp4", i): (40 * i, s) for i, s in enumerate(samples)} | {("b.ivf", i): (7 * i, s) for i, s in enumerate(samples)}
    raw = tmp_path / "c.yuv"
    raw.write_bytes(bytes(range(36)))
    frames = spark.read.format(containers.NAME).option("w", 4).option("h", 2).load(str(raw))
    assert [(r.no, bytes(r.unit)) for r in frames.orderBy("no").collect()] == [(i, bytes(range(12 * i, 12 * i + 12))) for i in range(3)]
    with pytest.raises(Exception, match="whole number"):
        spark.read.format(containers.NAME).option("w", 4).option("h", 4).load(str(raw)).count()


def test_written_samples_read_back_and_a_failed_write_shows_nothing(spark, tmp_path):
    containers.register(spark)
    at = str(tmp_path / "out")
    df = spark.range(40).select(F.col("id").alias("no"), F.unhex(F.format_string("%04x", "id")).alias("unit")).repartition(5)
    read = lambda: sorted((r.no, bytes(r.unit)) for r in spark.read.format(containers.NAME).option("bytesPerPartition", 10).load(at).collect())
    want = [(i, i.to_bytes(2, "big")) for i in range(40)]
    df.write.format(containers.NAME).mode("append").save(at)
    assert read() == want
    broken = df.withColumn("unit", F.when(F.col("no") == 33, F.raise_error(F.lit("power cut")).cast("binary")).otherwise(F.col("unit")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="power cut"):
            broken.write.format(containers.NAME).mode(mode).save(at)
        assert read() == want
    df.write.format(containers.NAME).mode("append").save(at)
    assert read() == sorted(want * 2)
    df.write.format(containers.NAME).mode("overwrite").save(at)
    assert read() == want
    with open(os.path.join(at, containers.MANIFEST)) as f:
        assert len(json.load(f)) == 5
    fresh = str(tmp_path / "never")
    with pytest.raises(Exception, match="power cut"):
        broken.write.format(containers.NAME).mode("append").save(fresh)
    assert spark.read.format(containers.NAME).load(fresh).count() == 0


def test_samples_come_as_a_stream_and_are_shown_in_order_over_restarts(spark, tmp_path):
    containers.register(spark)
    rng = np.random.default_rng(4)
    order = [i + int(rng.integers(0, 5)) for i in range(30)]  # decoding order: no sample is shown more than a few places away
    pts = np.argsort(np.argsort(order, kind="stable"), kind="stable").tolist()
    at, frames, step = str(tmp_path / "in"), [(i, p, bytes([i]) * 3) for i, p in enumerate(pts)], 0
    for part in (frames[:7], frames[7:8], frames[8:25], frames[25:]):
        spark.createDataFrame(part, "no long, pts long, unit binary").coalesce(1).write.format(containers.NAME).mode("append").save(at)
        stream = spark.readStream.format(containers.NAME).load(at).withColumn("camera", F.lit(1))
        if part[-1] == frames[-1]:
            stream = stream.withColumn("end", F.explode(F.when(F.col("no") == 29, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("unit", F.when(~F.col("end"), F.col("unit"))).drop("end")
        q = states.display_order(stream, "camera", 6).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        now = sorted((r.display_no, r.pts, r.no) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        step += len(part)
        assert len(now) == (30 if step == 30 else max(0, step - 6)) and [x[:2] for x in now] == [(i, i) for i in range(len(now))]
    assert [no for _, _, no in now] == np.argsort(pts).tolist()
