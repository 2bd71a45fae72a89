"""Detection post-processing: thresholds, priors, suppression of overlaps, landmarks. Models are pluggable and not part of this."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.frames import clamp
from framelake.operators import geometry, packed, stencil, tone


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of structs with x1, y1, x2, y2; 0 if they don't overlap or the union is empty."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = w * h
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def suppress(boxes: DataFrame, threshold: float, most: int = 100, frame: str = "frame", id: str = "box") -> DataFrame:
    """Boxes kept by greedy suppression: best score first (ties to the smaller id), dropped if they overlap a kept one by more.

    A frame's boxes are folded inside its row; a frame holds as many boxes as a detector gives.
    """
    s = F.struct((-F.col("score")).alias("o"), F.col(id).alias("id"), "x1", "y1", "x2", "y2", "score", "cls")
    per = boxes.groupBy(frame).agg(F.array_sort(F.collect_list(s)).alias("_b"))
    start = F.filter(F.col("_b"), lambda _: F.lit(False))
    keep = lambda kept, b: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b)))
    out = per.select(frame, F.posexplode(F.aggregate("_b", start, keep)).alias("rank", "k"))
    return out.select(frame, F.col("k.id").alias(id), F.col("rank").cast("int").alias("rank"), *(F.col(f"k.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "score", "cls")))


def best_class(scores: DataFrame, keys: list[str], min_score: float) -> DataFrame:
    """(keys, cls, score): the best class of each candidate (ties to the smaller class), if it scores enough."""
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("cls", "score"), F.struct("score", -F.col("cls"))).alias("b"))
    return best.select(*keys, "b.cls", "b.score").where(F.col("score") >= min_score)


def unletterbox(boxes: DataFrame, scale: float, left: float, top: float, w: int, h: int) -> DataFrame:
    """Boxes from a letterboxed square back to the frame, cut to it; empty ones go."""
    back = lambda c, pad, most: clamp((F.col(c) - pad) / scale, 0, most)
    out = boxes.withColumns({"x1": back("x1", left, w), "x2": back("x2", left, w), "y1": back("y1", top, h), "y2": back("y2", top, h)})
    return out.where("x2 > x1 and y2 > y1")


def detections(cells: DataFrame, scale: float, left: float, top: float, w: int, h: int, min_score: float = 0.35, threshold: float = 0.45, most: int = 100) -> DataFrame:
    """Boxes from a detector's raw cells (frame, cell, cx, cy, bw, bh, scores array) of a letterboxed square.

    A cell's class is its best score, the first on ties; what scores enough is brought back to the frame, and
    overlaps are suppressed over all classes.
    """
    best = F.array_max("scores")
    ok = cells.where((best > 0) & (best >= min_score)).select("frame", F.col("cell").alias("box"), best.alias("score"), (F.array_position("scores", best) - 1).cast("int").alias("cls"),
                                           *((F.col(c) + side * F.col(s) / 2).cast("double").alias(n) for n, c, s, side in (("x1", "cx", "bw", -1), ("y1", "cy", "bh", -1), ("x2", "cx", "bw", 1), ("y2", "cy", "bh", 1))))
    return suppress(unletterbox(ok, scale, left, top, w, h), threshold, most)


def faces(raw: DataFrame, size: int, scale: float, left: float, top: float, w: int, h: int, min_score: float = 0.4, threshold: float = 0.3, most: int = 100) -> DataFrame:
    """Boxes from a face detector's raw points (frame, stride, i, cls, obj, dx, dy, lw, lh) of a letterboxed square."""
    found = decode_points(raw, point_priors(raw.sparkSession, size), min_score)
    boxes = unletterbox(found.withColumns({"box": F.col("stride") * 1_000_000 + F.col("i"), "cls": F.lit(0)}), scale, left, top, w, h)
    return suppress(boxes, threshold, most)


def hands(raw: DataFrame, w: int, h: int, size: int = 192, min_score: float = 0.5, threshold: float = 0.3, most: int = 2) -> DataFrame:
    """(frame, hand, score, left, top, side): square windows around the palms of raw (frame, anchor, x, y, bw, bh, logit).

    Boxes are in a square of `size` that the frame was stretched to. A window is 1.6 times the longer side of
    its palm and at least 32, moved into the frame; what is larger than the frame goes.
    """
    score = 1 / (1 + F.exp(-F.col("logit")))
    found = raw.withColumn("score", score).where((F.col("score") >= min_score) & (F.col("bw") > 0) & (F.col("bh") > 0)).select(
        "frame", F.col("anchor").alias("box"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("bw")).alias("x2"), (F.col("y") + F.col("bh")).alias("y2"), "score", F.lit(0).alias("cls"))
    kept = suppress(found, threshold, most)
    sx, sy = w / size, h / size
    bw, bh = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = F.greatest(F.lit(32), F.floor(1.6 * F.greatest(bw * sx, bh * sy)))
    placed = kept.select("frame", F.col("rank").alias("hand"), "score", side.cast("int").alias("side"), ((F.col("x1") + bw / 2) * sx).alias("_cx"), ((F.col("y1") + bh / 2) * sy).alias("_cy"))
    start = lambda c, most: F.least(F.greatest(F.lit(0), F.floor(F.col(c) - F.floor(F.col("side") / 2))), F.lit(most) - F.col("side")).cast("int")
    return placed.where(F.col("side") <= min(w, h)).select("frame", "hand", "score", start("_cx", w).alias("left"), start("_cy", h).alias("top"), "side")


def hand_joints(points: DataFrame, windows: DataFrame, size: float = 224.0) -> DataFrame:
    """points (frame, hand, joint, x, y) of each window in the frame; a coordinate above 1.5 is in pixels of a window of `size`."""
    share = lambda c: F.when(F.col(c) > 1.5, F.col(c) / size).otherwise(F.col(c))
    return points.join(windows.select("frame", "hand", "left", "top", "side"), ["frame", "hand"]).select(
        "frame", "hand", "joint", (F.col("left") + share("x") * F.col("side")).alias("x"), (F.col("top") + share("y") * F.col("side")).alias("y"))


def hand_crops(frames: DataFrame, windows: DataFrame, size: int = 224) -> DataFrame:
    """(f, id, w, h, c, data): the square around every hand (frame, hand, left, top, side) cut from its frame and brought to a model's size; id is the hand."""
    return packed.crops(frames, windows.select(F.col("frame").alias("f"), F.col("hand").cast("long").alias("id"), "left", "top", F.col("side").alias("side_w"), F.col("side").alias("side_h")), size)


def eye_places(faces: DataFrame, w: int, h: int, side: int = 64, most: int = 4) -> DataFrame:
    """(frame, id, box, eye, left, top, fw, score): a window of fixed size around both eyes of each face (frame, box, x1, y1, x2, y2, score), moved into the frame.

    Eyes are numbered by their faces' order and their own, and the first `most` of a frame count; a frame smaller than a window has none.
    """
    fw, fh = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    eye = F.explode(F.array(*(F.struct(F.lit(i).alias("eye"), (F.col("x1") + s * fw).alias("cx")) for i, s in enumerate((0.3, 0.7)))))
    trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    start = lambda c, most: F.least(F.greatest(F.lit(0), trunc(c - side / 2)), F.lit(most - side)).cast("int")
    # Faces are numbered, not their eyes: half the rows to sort, and only those that count are kept.
    first = faces.where(F.lit(min(w, h) >= side)).withColumn("_no", F.row_number().over(Window.partitionBy("frame").orderBy("box"))).where(F.col("_no") <= (most + 1) // 2)
    at = first.select("frame", "box", "_no", "score", fw.alias("fw"), (F.col("y1") + 0.42 * fh).alias("cy"), eye.alias("e"))
    no = 2 * (F.col("_no") - 1) + F.col("e.eye")
    return at.select("frame", no.cast("long").alias("id"), "box", "e.eye", start(F.col("e.cx"), w).alias("left"), start(F.col("cy"), h).alias("top"), "fw", "score").where(F.col("id") < most)


def eye_crops(frames: DataFrame, places: DataFrame, side: int = 64) -> DataFrame:
    """(f, id, w, h, c, data): the windows of eye_places cut from their frames."""
    return packed.crops(frames, places.select(F.col("frame").alias("f"), "id", "left", "top", F.lit(side).alias("side_w"), F.lit(side).alias("side_h")))


def gaze(points: DataFrame, places: DataFrame, side: int = 64, parts: int | None = None) -> DataFrame:
    """(frame, id, cx, cy, er, dx, dy, score) from the iris points (frame, id, point, x, y) that a model finds in eye windows.

    An iris is the mean of its points; one outside its window goes. The gaze is the unit vector from the window's
    middle, zero within a thousandth of it; er is 0.16 of the face's width, 6 at least. parts: in how many parts windows
    and irises meet, else the session's number.
    """
    if parts:
        points, places = points.repartition(parts, "frame", "id"), places.repartition(parts, "frame", "id")
    iris = points.groupBy("frame", "id").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y")).where(f"_x >= 0 and _x < {side} and _y >= 0 and _y < {side}")
    dx, dy = F.col("_x") - side / 2, F.col("_y") - side / 2
    far = F.sqrt(dx * dx + dy * dy)
    unit = lambda c: F.when(far > 1e-3, c / F.when(far > 1e-3, far).otherwise(1.0)).otherwise(0.0)
    return places.join(iris, ["frame", "id"]).select("frame", "id", (F.col("left") + F.col("_x")).alias("cx"), (F.col("top") + F.col("_y")).alias("cy"), F.greatest(F.lit(6.0), 0.16 * F.col("fw")).alias("er"), unit(dx).alias("dx"), unit(dy).alias("dy"), "score")


def blur_behind(rgb: DataFrame, alpha: DataFrame, aw: int, ah: int, w: int, h: int, sigma: float = 6.0) -> DataFrame:
    """rgb over its own blur by a matte alpha (f, y, x, a) of a model's working size, brought to the frame's."""
    return tone.composite_alpha(rgb, stencil.gaussian(rgb, w, h, sigma, geometry.RGB), geometry.resize_bilinear(alpha, aw, ah, w, h, ("a",), whole=False))


def work_size(w: Column, h: Column, budget: int = 1280 * 720) -> tuple[Column, Column]:
    """The even size, at least 64, at which a model works on frames of more pixels than the budget; the frame's own below."""
    pixels = (w * h).cast("double")
    fit = lambda c: F.greatest(F.lit(64), F.floor(c * F.sqrt(budget / pixels) / 2) * 2)
    return tuple(F.when(pixels > budget, fit(c)).otherwise(c).cast("int") for c in (w, h))


def pose(points: DataFrame, size: float = 256.0) -> DataFrame:
    """points (x, y, vis, pres in a model's units) with x and y as shares where they are in pixels, and visibility as a probability."""
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    share = {c: F.when(F.col(c) > 1.5, F.col(c) / size).otherwise(F.col(c)) for c in ("x", "y")}
    return points.withColumns(share | {"visibility": sig("vis") * sig("pres")}).drop("vis", "pres")


def point_priors(spark, size: int, strides: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """(stride, i, px, py): centres of the cells of each stride in a square; a table of fixed size."""
    parts = None
    for s in strides:
        n = size // s
        p = spark.range(n * n).select(F.lit(s).alias("stride"), F.col("id").cast("int").alias("i"), ((F.col("id") % n + 0.5) * s).alias("px"), ((F.floor(F.col("id") / n) + 0.5) * s).alias("py"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


def decode_points(raw: DataFrame, priors: DataFrame, min_score: float) -> DataFrame:
    """Boxes of raw (frame, stride, i, cls, obj, dx, dy, lw, lh) at their priors; score = sigmoid(cls) * sigmoid(obj)."""
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    j = raw.join(F.broadcast(priors), ["stride", "i"]).withColumn("score", sig("cls") * sig("obj")).where(F.col("score") >= min_score)
    cx, cy = F.col("px") + F.col("dx") * F.col("stride"), F.col("py") + F.col("dy") * F.col("stride")
    w, h = F.exp("lw") * F.col("stride"), F.exp("lh") * F.col("stride")
    return j.select("frame", "stride", "i", "score", (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def eye_windows(faces: DataFrame) -> DataFrame:
    """(frame, eye, cx, cy, radius) for both eyes of each face: at 30 and 70 % of its width and 42 % of its height."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    eye = F.explode(F.array(*(F.struct(F.lit(i).alias("eye"), (F.col("x1") + s * w).alias("cx")) for i, s in enumerate((0.3, 0.7)))))
    return faces.select("frame", "box", eye.alias("e"), (F.col("y1") + 0.42 * h).alias("cy"), F.greatest(F.lit(6.0), 0.16 * w).alias("radius")).select("frame", "box", "e.eye", "e.cx", "cy", "radius")


def normalise_landmarks(points: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """x and y as shares: divided by size if any of the set's coordinates exceeds 1.5."""
    big = points.groupBy(*keys).agg((F.greatest(F.max("x"), F.max("y")) > 1.5).alias("_p"))
    return points.join(big, keys).withColumns({c: F.when(F.col("_p"), F.col(c) / size).otherwise(F.col(c)) for c in ("x", "y")}).drop("_p")


#: Class names of the detector.
CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed",
    "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven",
    "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)


def with_class(df: DataFrame, cls: str = "cls") -> DataFrame:
    """df with class_name ("?" for unknown ones) and a colour from the class number."""
    known = F.col(cls).between(0, len(CLASSES) - 1)
    name = F.when(known, F.get(F.array(*map(F.lit, CLASSES)), F.when(known, F.col(cls)).otherwise(0).cast("int"))).otherwise("?")
    return df.withColumns({"class_name": name, **{n: (80 + (F.greatest(F.col(cls), F.lit(0)) * k) % 176).cast("int") for n, k in zip(("cr", "cg", "cb"), (149, 97, 61))}})


def label_place(y1: Column, y2: Column, h: int, size: int = 12) -> Column:
    """Row of a box's label: above it, else below, else at the top."""
    return F.when(y1 - size >= 0, y1 - size).when(y2 + size <= h, y2).otherwise(0)


def run_model(frames: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """frames through a model that each worker loads once and applies to pandas batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield model(b)
    return frames.mapInPandas(run, schema)
