import struct

import pytest
from pyspark.sql import functions as F

from framelake.operators import events, temporal
from framelake.sources import bitstream


def hand(*joints):
    """21 joints, all (0, 0) but those given as {joint: (x, y)}."""
    return [dict(j) for j in joints]


def test_gestures(spark):
    up = {8: (0, 100), 12: (0, 100), 16: (0, 100), 20: (0, 100), 6: (0, 50), 10: (0, 50), 14: (0, 50), 18: (0, 50), 4: (10, 0), 3: (10, 0)}
    shut = up | {t: (0, 40) for t in (8, 12, 16, 20)}
    cases = {"palm": up, "fist": shut, "thumb": shut | {4: (60, 0), 3: (30, 0)}, "peace": shut | {8: (0, 100), 12: (0, 100)}, "none": shut | {8: (0, 100)}}
    cases["palm2"] = {j: (2 * x, 2 * y) for j, (x, y) in up.items()}
    rows = [(n, j, float(p.get(j, (0, 0))[0]), float(p.get(j, (0, 0))[1])) for n, p in cases.items() for j in range(21)]
    got = events.gesture(spark.createDataFrame(rows, "hand string, joint int, x double, y double")).collect()
    assert {r.hand: r.gesture for r in got} == {n: n.rstrip("2") for n in cases}


def stream(spark, values, kind="int"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"k long, seq int, v {kind}")


def test_debounce_hysteresis_and_pace(spark):
    d = stream(spark, [0, 9, 9, 0, 9, 0, 0, 9, 9])
    assert [r.edge for r in events.debounce(d, "k", ["seq"], F.col("v") > 5).orderBy("seq").collect()] == [0, 0, 1, 0, 0, 0, -1, 0, 1]
    h = stream(spark, [1, 1, 1, 5, 1, 9, 1])
    assert [r.on for r in temporal.hysteresis(h, "k", ["seq"], "v", 3, 8, 2).orderBy("seq").collect()] == [False, False, True, True, True, False, False]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 20, 40, 60, 75))], "k long, seq int, ms long")
    assert [r.kept for r in temporal.pace(p, "k", ["seq"], "ms", 33).orderBy("seq").collect()] == [True, False, True, False, True]


def test_segments_cuts_and_spans(spark):
    d = stream(spark, [True, False, False, True, False, False, False, False, True], "boolean")
    assert [r.segment for r in events.segments(d, "k", ["seq"], "v", 3, 5).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 2]
    c = spark.createDataFrame([(1, 0, True, False), (1, 1, False, True), (1, 2, True, False), (1, 3, False, False), (1, 4, False, True), (1, 5, False, False), (1, 6, True, False)], "k long, seq int, idr boolean, cut boolean")
    spans = events.cut_spans(c, "k", "seq", "cut", "idr")
    assert sorted((r.start, r.end) for r in spans.collect()) == [(1, 2), (4, 6)]
    assert sorted(r.seq for r in events.without_spans(c.select("k", "seq"), spans, "k", "seq").collect()) == [0, 2, 3, 6]


def test_gesture_actions_fire_once_and_cool_down(spark):
    rows = [(1, i, 100 * i, g) for i, g in enumerate("aaaaaabbaaaaaaaaaaaaaaaaaaaa")]
    d = spark.createDataFrame(rows, "k long, seq int, ms long, g string")
    got = events.gesture_actions(d, "k", ["seq"], "ms", "g", {"a": 300}, 1500).where("action is not null").orderBy("seq").collect()
    assert [(r.seq, r.action) for r in got] == [(3, "a"), (18, "a")]


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, 5, 1), (1, 20, 2), (2, 9, 3)], "k long, ts int, seq int")
    right = spark.createDataFrame([(1, 5, 1, "a"), (1, 19, 2, "b"), (1, 21, 3, "c")], "k long, ts int, seq int, v string")
    assert {(r.k, r.ts): r.v_as_of for r in temporal.as_of(left, right, "k", "ts", "seq", "v").collect()} == {(1, 5): "a", (1, 20): "b", (2, 9): None}


def test_settings_and_spawn(spark):
    df = spark.createDataFrame([("a=1\n# c=3\n b = x=y \na=2\n",), ("",)], "t string")
    assert [r.m for r in df.select(events.settings(F.col("t")).alias("m")).collect()] == [{"a": "2", "b": "x=y"}, {}]
    # By hand: 7 * 1103515245 + 12345 = 7724619060, less 4294967296 is 3429651764, whose upper half is 52332; 52332 % 800 = 332.
    assert spark.range(1).select(events.spawn(F.lit(7), 1).alias("a")).first().a == [332]
    got = spark.range(1).select(events.spawn(F.lit(7), 7).alias("a")).first().a
    s, want = 7, []
    for m in (800, 650, 2, 500, 2, 800, 650):
        s = (s * 1103515245 + 12345) % 2**32
        want.append((s >> 16) % m)
    assert got == want


def test_units_keep_their_last_bytes(spark):
    stream = b"\0\0\0\1\x67\x01\x02\0\0\1\x68\x03\0\0\1\x65\x09\x08\x07\x06\x05"
    df = spark.createDataFrame([(1, bytearray(stream)), (2, bytearray(b"no code")), (3, None)], "id long, payload binary")
    got = [(r.no, r.type, r.is_vcl, bytes(r.unit)) for r in bitstream.split_units(df).orderBy("no").collect()]
    assert got == [(0, 7, False, b"\x67\x01\x02"), (1, 8, False, b"\x68\x03"), (2, 5, True, b"\x65\x09\x08\x07\x06\x05")]
    assert bitstream.parameter_sets(bitstream.split_units(df)).count() == 2
    framed = b"".join(len(u).to_bytes(4, "big") + u for _, _, _, u in got)
    back = bitstream.split_units(bitstream.reframe(spark.createDataFrame([(1, bytearray(framed))], "id long, payload binary")))
    assert [bytes(r.unit) for r in back.orderBy("no").collect()] == [u for *_, u in got]


def test_containers():
    ivf = b"DKIF" + bytes(28) + b"".join(struct.pack("<IQ", len(x), i) + x for i, x in enumerate((b"one", b"three")))
    assert bitstream.ivf_frames(ivf) == [(0, b"one"), (1, b"three")] and bitstream.ivf_frames(b"none") == []
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    u = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    samples = [b"aa", b"bbb", b"c"]

    def movie(at):
        stbl = box(b"stsz", u(0, 0, 3, 2, 3, 1)) + box(b"stsc", u(0, 1, 1, 3, 1)) + box(b"stco", u(0, 1, at))
        mdia = box(b"mdhd", u(0, 0, 0, 1000, 100)) + box(b"hdlr", u(0, 0) + b"vide" + bytes(12)) + box(b"minf", box(b"stbl", stbl))
        return box(b"moov", box(b"trak", box(b"mdia", mdia)))
    head = len(movie(0)) + 8
    assert bitstream.mp4_video(movie(head) + box(b"mdat", b"".join(samples))) == (30.0, samples)
    assert bitstream.mp4_video(b"junk") is None
    avcc = bytes([1, 66, 0, 30, 255, 0xE1]) + (3).to_bytes(2, "big") + b"sps" + bytes([1]) + (2).to_bytes(2, "big") + b"pp"
    assert bitstream.avc_parameter_sets(avcc) == [b"sps", b"pp"]
    assert bitstream.wav_header(4)[:4] == b"RIFF" and len(bitstream.wav_header(4)) == 44


def test_raw_frames_must_be_whole(spark):
    df = spark.createDataFrame([(1, bytearray(range(12)))], "id long, payload binary")
    assert [bytes(r.unit) for r in bitstream.raw_frames(df, 2, 2).orderBy("no").collect()] == [bytes(range(6)), bytes(range(6, 12))]
    with pytest.raises(Exception, match="whole number"):
        bitstream.raw_frames(df, 4, 2).where("no >= 0").selectExpr("no + 1 as n").collect() and bitstream.raw_frames(spark.createDataFrame([(1, bytearray(5))], "id long, payload binary"), 2, 2).collect()


def test_streamed_folds_carry_state_over_batches(spark, tmp_path):
    from framelake.streaming import states
    px = spark.createDataFrame([(f, y, 0, (37 * f + 11 * y) % 256) for f in range(6) for y in range(3)], "f long, y int, x int, v int")
    for i, part in enumerate(((0, 1), (2, 3), (4, 5))):
        px.where(F.col("f").isin(*part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_ = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (states.iir_denoise(stream_, 0.3).writeStream.format("memory").queryName("iir_twin").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    key = lambda r: (r.f, r.y, r.x, r.v)
    assert sorted(map(key, spark.table("iir_twin").collect())) == sorted(map(key, temporal.iir_denoise(px, 0.3).collect()))
