"""Recordings against a player of the commands, and sound without its cuts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import recorder


def played(rows, target, least):
    """(segments, cuts, marks) of one recording's rows (t, kind), command by command."""
    times, segs, cuts, marks = [], [], [], []
    start = bs = n = 0
    discarding = paused = False
    for t, kind in rows:
        if kind == "pause":
            paused = not paused
        elif paused:
            continue
        elif kind in ("frame", "idr"):
            n += 1
            times.append(t)
            if discarding:
                if kind != "idr":
                    continue
                discarding = False
                cuts[-1][1], cuts[-1][3] = (n, t) if cuts[-1][1] < 0 else (cuts[-1][1], cuts[-1][3])
            if (bs >= target and kind == "idr") or bs >= 2 * target:
                segs.append([start, n, True])
                start, bs = n, 0
            bs += 1
        elif kind == "cut":
            cuts.append([start, -1, t, -1.0, True])
            start, bs, discarding = n, 0, True
        elif kind == "cut_prev":
            for s in reversed(segs):
                if s[2]:
                    s[2] = False
                    cuts_at = times[s[0]] if s[0] < len(times) else -1.0
                    cuts.insert(next((i for i, c in enumerate(cuts) if c[1] < 0 and c[4] and discarding and i == len(cuts) - 1), len(cuts)), [s[0], s[1], cuts_at, times[s[1]] if s[1] < len(times) else t, False])
                    break
        elif kind == "mark":
            marks.append((n, f"mark {len(marks) + 1}"))
    if discarding:
        cuts[-1][1], cuts[-1][3] = n, max(t for t, _ in counted(rows))
    if bs >= least:
        segs.append([start, n, True])
    return sorted(map(tuple, segs)), sorted(map(tuple, cuts)), marks


def counted(rows):
    paused = False
    for t, kind in rows:
        if kind == "pause":
            paused = not paused
        elif not paused:
            yield t, kind


def script(rng, n):
    kinds = ["frame"] * 12 + ["idr"] * 4 + ["cut", "cut_prev", "mark"] + ["pause"] * (rng.random() < 0.5)
    return [(0.04 * i, rng.choice(kinds)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_recordings(spark, seed):
    rng = random.Random(seed)
    takes = {k: script(rng, rng.randint(1, 150)) for k in range(25)}
    rows = spark.createDataFrame([(k, i, t, x) for k, v in takes.items() for i, (t, x) in enumerate(v)], "take long, seq long, t double, kind string").repartition(3)
    got = recorder.recording(rows, "take", "seq", target=4, least=2)
    want = {k: played(v, 4, 2) for k, v in takes.items()}
    for i, (name, columns) in enumerate((("segments", ("start", "end", "kept")), ("cuts", ("start", "end", "t0", "t1", "live")), ("marks", ("frame", "label")))):
        found = {k: [] for k in takes}
        for r in got[name].collect():
            found[r["take"]].append(tuple(r[c] for c in columns))
        for k in takes:
            assert sorted(found[k]) == sorted(want[k][i]), (name, k, takes[k])


def test_snips_are_long_enough_and_made_one(spark):
    spans = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 2.0), (1, 2.0, 2.5), (1, 3.0, 4.0), (2, 0.0, 9.0), (2, 1.0, 2.0)], "take long, a double, b double")
    assert sorted(tuple(r) for r in recorder.coalesced(spans, "take").collect()) == [(1, 0.0, 2.5), (1, 3.0, 4.0), (2, 0.0, 9.0)]
    rows = [(1, i, 10 + 0.02 * i, k) for i, k in enumerate(["idr", "frame", "frame", "frame", "frame", "cut", "idr", "frame", "cut", "idr"])]
    got = recorder.recording(spark.createDataFrame(rows, "take long, seq long, t double, kind string"), "take", "seq")["snips"].collect()
    assert [(round(r.a, 2), round(r.b, 2)) for r in got] == [(10.0, 10.1)]  # the second cut is .02 s after its segment's frame 5


def test_samples_in_snips_go(spark):
    sound = np.arange(95, dtype="<i2")
    chunks = spark.createDataFrame([(1, i, sound[10 * i:10 * i + 10].tobytes()) for i in range(10)] + [(2, 0, sound[:10].tobytes())], "take long, no long, pcm binary")
    snips = spark.createDataFrame([(1, 101.5, 102.2), (1, 102.0, 103.0), (1, 99.0, 100.3), (1, 109.3, 130.0), (1, 90.0, 95.0)], "take long, a double, b double")
    got = {}
    for r in recorder.snipped(chunks, snips, "take", 10, F.lit(100.0), 10).orderBy("take", "no").collect():
        got.setdefault(r["take"], []).extend(np.frombuffer(r.pcm, "<i2").tolist())
    assert got == {1: [i for i in range(95) if not (i <= 3 or 15 <= i <= 30 or i >= 93)], 2: list(range(10))}
