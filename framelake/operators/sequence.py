"""Operators that need a camera's frames in order: state carried from frame to frame, and windows of whole frames.

Frames are rows (camera, f, w, h, c, data). States are lists of numpy arrays. A camera's frames pass one after the other
through one task, which holds a frame and a state and never the history; framelake.streaming has the same step over
micro-batches. Windows are independent, so a long camera is cut into blocks that any task takes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.packed import FRAME, as_tensor, bilinear, from_tensor, gaussian, quantised

State = list[np.ndarray]
#: step(state or None, frame (h, w, c)) -> (frame, state); None at the start and after a change of the frame's shape.
Step = Callable[[State | None, np.ndarray], tuple[np.ndarray, State]]
COLUMNS = ("w", "h", "c", "data")


def carried(step: Step, state: State | None, shape: tuple | None, frame: np.ndarray) -> tuple[np.ndarray, State, tuple]:
    """One step; a frame of another shape than the last begins anew."""
    out, state = step(state if shape == frame.shape else None, frame)
    return quantised(out), state, frame.shape


def _frames(b: pa.RecordBatch, *keys: str) -> Iterator[tuple]:
    for *key, w, h, c, data in zip(*(b.column(k).to_pylist() for k in (*keys, *COLUMNS))):
        yield *key, np.frombuffer(data, np.uint8).reshape(h, w, c)


def _batch(rows: list[tuple], camera: pa.DataType, name: str) -> pa.RecordBatch:
    frames = [x for _, _, x in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in rows], camera), pa.array([f for _, f, _ in rows], pa.int64()), *(pa.array([x.shape[k] for x in frames], pa.int32()) for k in (1, 0, 2)),
         pa.array([np.ascontiguousarray(x).tobytes() for x in frames], pa.binary())], [name, "f", *COLUMNS])


def recurrent(frames: DataFrame, make: Callable[[], Step], camera: str = "camera") -> DataFrame:
    """Every frame of a camera through a step that each worker makes once, in order of f (repeated numbers in order of their bytes)."""
    kind = frames.schema[camera].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last, state, shape = make(), object(), None, None
        for b in batches:
            rows = []
            for k, f, frame in _frames(b, camera, "f"):
                if k != last:
                    last, state, shape = k, None, None
                out, state, shape = carried(step, state, shape, frame)
                rows.append((k, f, out))
            if rows:
                yield _batch(rows, b.column(camera).type, camera)
    order = frames.select(camera, "f", *COLUMNS).repartition(camera).sortWithinPartitions(camera, "f", "data")
    return order.mapInArrow(run, f"`{camera}` {kind}, f long, {FRAME}")


def map_windows(frames: DataFrame, make: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], size: int = 5, camera: str = "camera", block: int = 256) -> DataFrame:
    """(camera, f, frame): each frame and the size - 1 before it through a function that each worker makes once.

    f numbers a camera's frames; a window needs `size` numbers in a row and frames of one shape, so nothing comes of
    the first ones. Blocks of numbers are dealt to tasks; the last size - 1 frames of a block go to the next one too.
    Equal numbers of a camera count once.
    """
    if block < size:
        raise ValueError("a block holds a window at least")
    kind = frames.schema[camera].dataType.simpleString()
    at = F.floor(F.col("f") / block)
    dealt = frames.select(camera, "f", *COLUMNS, F.explode(F.when(F.col("f") % block > block - size, F.array(at, at + 1)).otherwise(F.array(at))).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, last, held = make(), None, deque(maxlen=size)
        for b in batches:
            rows = []
            for k, n, f, frame in _frames(b, camera, "_b", "f"):
                if (k, n) == last and held and f == held[-1][0]:
                    continue
                if (k, n) != last or (held and (f != held[-1][0] + 1 or frame.shape != held[-1][1].shape)):
                    last = k, n
                    held.clear()
                held.append((f, frame))
                if len(held) == size and f // block == n:
                    rows.append((k, f, quantised(work([x for _, x in held]))))
            if rows:
                yield _batch(rows, b.column(camera).type, camera)
    return dealt.repartition(camera, "_b").sortWithinPartitions(camera, "_b", "f", "data").mapInArrow(run, f"`{camera}` {kind}, f long, {FRAME}")


# ---- steps -------------------------------------------------------------------------------------------


def mixed_with_last(strength: float, recursive: bool = True) -> Callable[[], Step]:
    """strength * last + rest of the frame, half up; the last one is the output before (recursive) or the raw frame before. The first passes."""
    def make() -> Step:
        def step(state: State | None, frame: np.ndarray) -> tuple[np.ndarray, State]:
            out = frame if state is None else quantised(strength * state[0].astype(np.float64) + (1 - strength) * frame)
            return out, [out if recursive else frame]
        return step
    return make


def motion(before: np.ndarray, frame: np.ndarray, block: int = 16, search: int = 8, step: int = 2) -> tuple[int, int]:
    """(dx, dy) from a frame into the one before: the mean, towards zero, over full blocks of the offset with the least sum of absolute differences of luma.

    Samples outside are skipped; equal sums go to the first offset in row order.
    """
    luma = lambda p: (0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]).astype(np.int64) if p.shape[2] == 3 else p[..., 0].astype(np.int64)
    a, b = luma(frame.astype(np.float64)), luma(before.astype(np.float64))
    h, w = a.shape
    rows, cols = h // block, w // block
    if not rows or not cols:
        return 0, 0
    y, x = np.arange(0, rows * block, step), np.arange(0, cols * block, step)
    y, x = y[y % block % step == 0], x[x % block % step == 0]
    best, dx_of, dy_of = np.full((rows, cols), np.inf), np.zeros((rows, cols), int), np.zeros((rows, cols), int)
    for dy in range(-search, search + 1, step):
        for dx in range(-search, search + 1, step):
            sy, sx = y + dy, x + dx
            ok = ((sy >= 0) & (sy < h))[:, None] & ((sx >= 0) & (sx < w))[None, :]
            diff = np.where(ok, np.abs(a[np.ix_(y, x)] - b[np.ix_(np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1))]), 0)
            shape = (rows, len(y) // rows, cols, len(x) // cols)
            total, seen = diff.reshape(shape).sum((1, 3)), ok.reshape(shape).any((1, 3))
            better = seen & (total < best)
            best[better], dx_of[better], dy_of[better] = total[better], dx, dy
    n = np.isfinite(best).sum()
    return (int(dx_of.sum() / n), int(dy_of.sum() / n)) if n else (0, 0)


def steadied(factor: float = 0.8, block: int = 16, search: int = 8, recursive: bool = True) -> Callable[[], Step]:
    """Frames moved by their motion against the last one, smoothed recursively and cut to integers. The last one is as in mixed_with_last."""
    def make() -> Step:
        def step(state: State | None, frame: np.ndarray) -> tuple[np.ndarray, State]:
            if state is None:
                return frame, [frame, np.zeros(2, int)]
            raw = motion(state[0], frame, block, search)
            move = np.array([int(factor * float(m) + (1 - factor) * r) for m, r in zip(state[1], raw)])
            out = translated(frame, *move.tolist())
            return out, [out if recursive else frame, move]
        return step
    return make


def translated(frame: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """A frame moved by (dx, dy), zero where nothing comes from."""
    h, w = frame.shape[:2]
    out = np.zeros_like(frame)
    to = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    src = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if abs(dy) < h and abs(dx) < w:
        out[to] = frame[src]
    return out


def matted(model: Callable[[], Callable[[np.ndarray, State], tuple[np.ndarray, State]]], size: tuple[int, int] = (640, 480), channels: Sequence[int] = (16, 20, 40, 64), sigma: float = 6.0) -> Callable[[], Step]:
    """Frames over their own blur by the matte of a recurrent model.

    The model takes a tensor (1, 3, h, w) of shares at its working size and its states, and gives a matte (h, w) and new
    states. States are zeros (1, c, 1, 1) at first. The matte is brought to the frame's size and smoothed over
    its whole range.
    """
    def make() -> Step:
        run, blur = model(), gaussian(sigma)

        def step(state: State | None, frame: np.ndarray) -> tuple[np.ndarray, State]:
            small = quantised(bilinear(frame[None], *size)) if frame.shape[1::-1] != tuple(size) else frame[None]
            alpha, state = run(as_tensor(small), state or [np.zeros((1, c, 1, 1), np.float32) for c in channels])
            a = np.clip(bilinear(alpha[None, ..., None], frame.shape[1], frame.shape[0])[0], 0, 1)
            a = a * a * (3 - 2 * a)
            return a * frame + (1 - a) * quantised(blur(frame[None]))[0], state
        return step
    return make


def denoised(model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], noise: float = 0.05, budget: int = 1280 * 720) -> Callable[[], Callable[[list[np.ndarray]], np.ndarray]]:
    """The last frame of a window by a model that takes all of them as planes (1, 3 n, h, w) and a noise map (1, 1, h, w), and gives (1, 3, h, w).

    Frames of more pixels than the budget are worked on at an even size within it, 64 at least, and brought back.
    """
    def make() -> Callable[[list[np.ndarray]], np.ndarray]:
        run = model()

        def work(window: list[np.ndarray]) -> np.ndarray:
            h, w = window[-1].shape[:2]
            if w * h > budget:
                dw, dh = (max(64, int(n * np.sqrt(budget / (w * h)) / 2) * 2) for n in (w, h))
                window = [quantised(bilinear(x[None], dw, dh))[0] for x in window]
            t = np.concatenate([as_tensor(x[None]) for x in window], axis=1)
            out = from_tensor(run(t, np.full((1, 1, *t.shape[2:]), noise, np.float32)))
            return quantised(bilinear(out, w, h))[0] if w * h > budget else out[0]
        return work
    return make
