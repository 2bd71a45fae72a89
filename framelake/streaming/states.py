"""Streaming twins of the recursive operators: the state of a key crosses micro-batches instead of its history."""

from __future__ import annotations

import heapq
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelake.operators import sequence
from framelake.operators.packed import FRAME

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Keeps one tuple a key and emits the rows of each batch, ordered, with the state after them."""

    def __init__(self, schema: str, order: list[str], start: tuple, step: Callable[[tuple, pd.Series], tuple], emit: Callable[[tuple, object, pd.Series], dict]):
        self.schema, self.order, self.start, self.step, self.emit = schema, order, start, step, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        now = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for row in batch.itertuples(index=False):
            now = self.step(now, row)
            out.append(self.emit(key, now, row))
        self.state.update(now)
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], fold: StatefulProcessor, schema: str) -> DataFrame:
    if ROCKS not in (stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(*keys).transformWithStateInPandas(fold, outputStructType=schema, outputMode="Append", timeMode="None")


def iir_denoise(stream: DataFrame, strength: float) -> DataFrame:
    """(y, x, f, v): recursive denoising of pixels (f, y, x, v), rounded at each step; frames arrive in order within and across batches."""
    def step(s, row):
        return (int(row.v),) if s[0] is None else (int(strength * s[0] + (1 - strength) * row.v + 0.5),)

    emit = lambda key, s, row: {"y": int(key[0]), "x": int(key[1]), "f": int(row.f), "v": s[0]}
    return _run(stream, ["y", "x"], Fold("v int", ["f"], (None,), step, emit), "y int, x int, f long, v int")


def debounce(stream: DataFrame, key: str, order: str, held: str) -> DataFrame:
    """(key, order, edge): rising and falling edges after two equal samples."""
    def step(s, row):
        v = bool(getattr(row, held))
        new = v if v == s[0] else s[1]
        return v, new, int(new) - int(s[1])

    emit = lambda k, s, row: {key: int(k[0]), order: int(getattr(row, order)), "edge": s[2]}
    return _run(stream, [key], Fold("prev boolean, on boolean, edge int", [order], (False, False, 0), step, emit), f"`{key}` long, `{order}` long, edge int")


def stabilise(stream: DataFrame, factor: float = 0.8) -> DataFrame:
    """(camera, f, sx, sy): smoothed integer motion of each camera (camera, f, dx, dy)."""
    step = lambda s, row: (int(factor * s[0] + (1 - factor) * row.dx), int(factor * s[1] + (1 - factor) * row.dy))
    emit = lambda k, s, row: {"camera": int(k[0]), "f": int(row.f), "sx": s[0], "sy": s[1]}
    return _run(stream, ["camera"], Fold("x int, y int", ["f"], (0, 0), step, emit), "camera long, f long, sx int, sy int")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """The stream without repeats of keys within a watermark; late rows go."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class Carried(StatefulProcessor):
    """A camera's step over frames: the arrays of its state, and the shape of the last frame, cross micro-batches."""

    def __init__(self, make: Callable, camera: str):
        self.make, self.camera = make, camera

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.step = handle.getValueState("state", "arrays binary, shape string"), self.make()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        arrays, shape = None, None
        if self.state.exists():
            held = self.state.get()
            with np.load(io.BytesIO(bytes(held[0]))) as z:
                arrays = [z[f"arr_{i}"] for i in range(len(z.files))]
            shape = tuple(json.loads(held[1]))
        out = []
        for r in pd.concat(list(rows)).sort_values(["f", "data"], kind="stable").itertuples(index=False):
            frame, arrays, shape = sequence.carried(self.step, arrays, shape, np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.c))
            out.append({self.camera: key[0], "f": int(r.f), "w": frame.shape[1], "h": frame.shape[0], "c": frame.shape[2], "data": np.ascontiguousarray(frame).tobytes()})
        blob = io.BytesIO()
        np.savez(blob, *arrays)
        self.state.update((blob.getvalue(), json.dumps(shape)))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def recurrent(stream: DataFrame, make: Callable, camera: str = "camera") -> DataFrame:
    """Frames (camera, f, w, h, c, data) through a step in order; frames arrive in order within and across batches, as for sequence.recurrent."""
    kind = stream.schema[camera].dataType.simpleString()
    return _run(stream.select(camera, "f", "w", "h", "c", "data"), [camera], Carried(make, camera), f"`{camera}` {kind}, f long, {FRAME}")


class Reorder(StatefulProcessor):
    """Holds up to `delay` samples of a key and lets go of the earliest ones beyond; a sample without a unit ends the key and lets go of all."""

    def __init__(self, key: str, delay: int):
        self.key, self.delay = key, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "pts long, no long, unit binary")
        self.shown = handle.getValueState("shown", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ended = bool(new["unit"].isna().any())
        heap = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        n, out = (self.shown.get()[0] if self.shown.exists() else 0), []
        # One sample after the other, as a decoder would meet them, so that batches of any size give the same order.
        heapq.heapify(heap)
        for r in new[new["unit"].notna()].sort_values("no", kind="stable").itertuples(index=False):
            heapq.heappush(heap, (int(r.pts), int(r.no), bytes(r.unit)))
            if len(heap) > self.delay:
                out.append(heapq.heappop(heap))
        while ended and heap:
            out.append(heapq.heappop(heap))
        self.held.put(heap) if heap else self.held.clear()
        self.shown.update((n + len(out),))
        yield pd.DataFrame([(key[0], n + i, pts, no, unit) for i, (pts, no, unit) in enumerate(out)], columns=[self.key, "display_no", "pts", "no", "unit"])

    def close(self) -> None:
        pass


def display_order(stream: DataFrame, key: str, delay: int = 16) -> DataFrame:
    """(key, display_no, pts, no, unit): samples (key, no, pts, unit) that arrive in decoding order, in the order that they are shown in.

    A sample waits until `delay` others have come after it that are shown later; the end of a key is a sample with a
    null unit and the highest number. State is bounded by the delay; a restart goes on from it.
    """
    kind = stream.schema[key].dataType.simpleString()
    return _run(stream.select(key, "no", "pts", "unit"), [key], Reorder(key, delay), f"`{key}` {kind}, display_no long, pts long, no long, unit binary")
