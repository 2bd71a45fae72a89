"""A recording's segments, cuts and marks from its frames and commands, and the sound that cuts take with them.

Rows are (key, order, t, kind): frames `frame` and `idr` (one that others don't depend on), commands `cut`, `cut_prev`, `mark`
and `pause`. Everything is windows and joins by key but the rotation of segments, a fold over the frames of one
stretch between cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.temporal import fold


def timeline(rows: DataFrame, key: str, order: str, t: str = "t", kind: str = "kind") -> DataFrame:
    """rows (key, order, t, kind) that count, with n (frames so far, this one included), stretch (cuts so far) and written: frames that reach the file.

    While paused nothing counts but the next pause. After a cut frames are passed over until an idr.
    """
    upto = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda c, w: F.sum(c.cast("int")).over(w)
    k = F.col("kind")
    d = rows.select(key, order, F.col(t).alias("t"), F.col(kind).alias("kind"))
    d = d.withColumn("_p", sums(k == "pause", upto(key))).where((F.col("_p") % 2 == 0) & (k != "pause")).drop("_p")
    d = d.withColumns({"n": sums(k.isin("frame", "idr"), upto(key)), "stretch": sums(k == "cut", upto(key))})
    seen = sums(k == "idr", upto(key, "stretch"))
    return d.withColumn("written", k.isin("frame", "idr") & ((F.col("stretch") == 0) | (seen > 0)))


def segments(line: DataFrame, key: str, order: str, target: int = 120, least: int = 5) -> DataFrame:
    """(key, stretch, no, first, last, start, end, closed, payloads): each stretch's segments with the orders of their first frame and of what closed them.

    A segment is closed by the first idr once it has `target` frames, at the latest at twice as many. start and end
    are frame numbers; a stretch's first segment starts where the cut before it came. The one that is open at a
    cut, or that ends a recording with fewer than `least` frames, is never closed.
    """
    step = lambda s, idr: F.when(((s["bs"] >= target) & idr) | (s["bs"] >= 2 * target), F.struct((s["no"] + 1).alias("no"), F.lit(1).alias("bs"))).otherwise(F.struct(s["no"].alias("no"), (s["bs"] + 1).alias("bs")))
    frames = line.where("written").withColumn("_idr", F.col("kind") == "idr")
    cut = fold(frames, [key, "stretch"], [order, "n"], "_idr", F.struct(F.lit(0).alias("no"), F.lit(0).alias("bs")), step)
    seg = cut.groupBy(key, "stretch", F.col("out.no").alias("no")).agg(F.min(order).alias("first"), F.min("n").alias("_n"), F.count("*").alias("payloads"))
    w = Window.partitionBy(key).orderBy("first")
    seg = seg.withColumns({"_s": F.lead("stretch").over(w), "_next": F.lead("first").over(w), "_end": F.lead("_n").over(w)})
    base = line.where("kind = 'cut'").select(key, "stretch", F.col("n").alias("_at"))
    whole = line.groupBy(key).agg(F.max("n").alias("_all"), F.max("stretch").alias("_cuts"), F.max(order).alias("_done"))
    d = seg.join(base, [key, "stretch"], "left").join(whole, key)
    rotated = F.coalesce(F.col("_s") == F.col("stretch"), F.lit(False))
    trailing = ~rotated & (F.col("stretch") == F.col("_cuts")) & (F.col("payloads") >= least)
    return d.select(key, "stretch", "no", "first", F.when(rotated, F.col("_next")).when(trailing, F.col("_done")).alias("last"),
                    F.when(F.col("no") > 0, F.col("_n")).otherwise(F.coalesce("_at", F.lit(0))).alias("start"),
                    F.when(rotated, F.col("_end")).when(trailing, F.col("_all")).alias("end"), (rotated | trailing).alias("closed"), rotated.alias("rotated"), "payloads")


def _popped(seg: DataFrame, line: DataFrame, key: str, order: str) -> DataFrame:
    """(key, stretch, no, popped): the order of the cut_prev that takes each rotated segment, the last one kept when it comes.

    Rotations push, commands pop: a segment at some height of the stack is taken by the next command at that height.
    Commands on an empty stack do nothing.
    """
    # A rotation comes with a frame's row, before any command after it.
    push = seg.where("rotated").select(key, F.col("last").alias("_o"), F.lit(1).alias("_d"), "stretch", "no")
    pop = line.where("kind = 'cut_prev'").select(key, F.col(order).alias("_o"), F.lit(-1).alias("_d"), F.lit(None).cast("int").alias("stretch"), F.lit(None).cast("int").alias("no"))
    w = Window.partitionBy(key).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    d = push.unionByName(pop).withColumn("_s", F.sum("_d").over(w))
    low = F.least(F.min("_s").over(w), F.lit(0))
    d = d.withColumns({"_h": F.col("_s") - low, "_idle": (F.col("_d") < 0) & (F.col("_s") == low) & (F.col("_s") < F.least(F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))}).where("not _idle")
    level = F.when(F.col("_d") > 0, F.col("_h")).otherwise(F.col("_h") + 1)
    nxt = F.lead(F.struct("_d", "_o")).over(Window.partitionBy(key, "_l").orderBy("_o"))
    return d.withColumn("_l", level).withColumn("_n", nxt).where("_d > 0").select(key, "stretch", "no", F.when(F.col("_n._d") < 0, F.col("_n._o")).alias("popped"))


def recording(rows: DataFrame, key: str, order: str, t: str = "t", kind: str = "kind", target: int = 120, least: int = 5) -> dict[str, DataFrame]:
    """segments (key, start, end, kept), cuts (key, start, end, t0, t1, live), marks (key, frame, label) and snips (key, a, b) of recordings.

    A live cut takes the open segment, from its start to the idr that resumes (or the last frame), and holds the
    times of both; cut_prev takes the last kept segment, and holds the times of its ends. A snip is what of the
    sound goes: from the first frame's time of a live cut to its command, or a taken segment's, if over .05 s.
    """
    line = timeline(rows, key, order, t, kind)
    seg = segments(line, key, order, target, least)
    taken = seg.join(_popped(seg, line, key, order), [key, "stretch", "no"], "left")
    kept = taken.where("closed").select(key, "start", "end", F.col("popped").isNull().alias("kept"))
    times = line.where("kind in ('frame', 'idr')").select(key, F.col("n").alias("_n"), F.col("t").alias("_t"))
    at = lambda c, name: times.select(key, (F.col("_n") - 1).alias(c), F.col("_t").alias(name))
    done = line.groupBy(key).agg(F.max("n").alias("_all"), F.max("t").alias("_now"))
    orders = line.select(key, F.col(order).alias("popped"), F.col("t").alias("_when"))
    prev = taken.where("popped is not null").join(orders, [key, "popped"]).join(at("start", "t0"), [key, "start"], "left").join(at("end", "_b"), [key, "end"], "left")
    # A frame that came after the command is not known to it.
    prev = prev.select(key, "start", "end", F.when(F.col("t0") <= F.col("_when"), F.col("t0")).otherwise(-1.0).alias("t0"), F.when(F.col("_b") <= F.col("_when"), F.col("_b")).otherwise(F.col("_when")).alias("t1"), F.lit(False).alias("live"))
    opened = seg.groupBy(key, "stretch").agg(F.max_by("start", "no").alias("_open"))
    back = line.where("written").groupBy(key, "stretch").agg(F.min("n").alias("_r"), F.min("t").alias("_rt"))
    cuts = line.where("kind = 'cut'").select(key, "stretch", F.col("n").alias("_c"), F.col("t").alias("t0"))
    base = cuts.select(key, "stretch", F.col("_c").alias("_base"))
    before = cuts.withColumn("stretch", F.col("stretch") - 1).join(opened, [key, "stretch"], "left").join(base, [key, "stretch"], "left").withColumn("stretch", F.col("stretch") + 1)
    last = F.max("stretch").over(Window.partitionBy(key)) == F.col("stretch")
    live = before.withColumn("_last", last).join(back, [key, "stretch"], "left").join(done, key).select(
        key, F.coalesce("_open", "_base", F.lit(0)).alias("start"), F.coalesce("_r", F.when(F.col("_last"), F.col("_all")).otherwise(-1)).alias("end"), "t0", F.coalesce("_rt", F.when(F.col("_last"), F.col("_now")).otherwise(-1.0)).alias("t1"), F.lit(True).alias("live"))
    all_cuts = live.unionByName(prev)
    a = F.when(F.col("live"), F.col("_f")).otherwise(F.when((F.col("t0") >= 0) & (F.col("t1") > F.col("t0")), F.col("t0")))
    b = F.when(F.col("live"), F.col("t0")).otherwise(F.col("t1"))
    snips = all_cuts.join(at("start", "_f"), [key, "start"], "left").select(key, a.alias("a"), b.alias("b")).where("a >= 0 and b > a + 0.05")
    no = F.row_number().over(Window.partitionBy(key).orderBy(order))
    marks = line.where("kind = 'mark'").select(key, F.col("n").alias("frame"), F.concat(F.lit("mark "), no).alias("label"))
    return {"segments": kept, "cuts": all_cuts, "marks": marks, "snips": snips}


def coalesced(spans: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """(key, a, b): spans of a key with those that overlap or touch made one."""
    w = Window.partitionBy(key).orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col(a) > F.max(b).over(w), F.lit(True)).cast("int")
    d = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "_g").agg(F.min(a).alias("a"), F.max(b).alias("b")).select(key, "a", "b")


def snipped(chunks: DataFrame, snips: DataFrame, key: str, rate: int, epoch: Column | None = None, size: int = 4800) -> DataFrame:
    """(key, no, pcm): 16-bit samples without those in snips (key, a, b), both ends included, in times of the recording.

    Chunks (key, no, pcm) hold `size` samples each, the last one fewer; epoch is the time of sample 0 (a column of
    snips' table, 0 by default), from which a and b count on; what lies before it is cut off. Overlapping snips are
    made one, and go to the chunks that they touch, so no sample meets a snip that it isn't near.
    """
    e = F.lit(0.0) if epoch is None else epoch
    spans = coalesced(snips.withColumns({"a": F.greatest(F.lit(0.0), F.col("a") - e), "b": F.col("b") - e}).where("b >= 0"), key)
    place = spans.select(key, F.ceil(F.col("a") * rate - 1e-9).alias("_a"), (F.floor(F.col("b") * rate + 1e-9) + 1).alias("_b")).where("_b > _a")
    per = place.select(key, F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size))).alias("no"), "_a", "_b").groupBy(key, "no").agg(
        F.collect_list(F.struct("_a", "_b")).alias("_cuts"))
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for no, pcm, cuts in zip(b.column("no").to_pylist(), b.column("pcm").to_pylist(), b.column("_cuts").to_pylist()):
                v = np.frombuffer(pcm, "<i2")
                keep = np.ones(len(v), bool)
                for c in cuts or ():
                    keep[max(c["_a"] - no * size, 0):max(c["_b"] - no * size, 0)] = False
                out.append(v[keep].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("no"), pa.array(out, pa.binary())], [key, "no", "pcm"])
    return chunks.select(key, "no", "pcm").join(per, [key, "no"], "left").mapInArrow(run, f"`{key}` {kind}, no long, pcm binary")
