"""Whole frames as rows (f, w, h, c, data): a binary with c samples a pixel, row by row.

A frame is a unit of work here: neighbourhoods, crops, layouts and models take stacks of equal-sized frames as numpy
arrays (n, h, w, c), and nothing is shuffled by pixel. Columns besides w, h, c and data pass through a map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import cos, exp, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.stencil import SOBEL_X, SOBEL_Y, _cubic_rows, gaussian_weights

RGB = ("r", "g", "b")
FRAME = "w int, h int, c int, data binary"
#: Samples that a stack of frames may hold, unless one frame alone has more.
STACK = 1 << 22
#: Rows that a pass takes at once.
ROWS = 1024


def _then(first, columns: list[str], run):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if first:
            return run(b.select(columns) for b in first(batches))
        return run(b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS))
    return both


def arrow_pass(rows: DataFrame, columns: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """run over the columns of rows in Arrow. Directly after another pass it goes on in the same worker, or each pass would have workers of its own."""
    source, first = rows.__dict__.get("_arrow_pass", (None, None))
    source = rows.select(*columns) if source is None else source
    both = _then(first, list(columns), run)
    out = source.mapInArrow(both, schema)
    out._arrow_pass = (source, both)
    return out


def pack(px: DataFrame, w: int, h: int, channels: Sequence[str] = RGB) -> DataFrame:
    """Frames of a pixel table (f, y, x, channels): pixels come together by frame and are laid out as they stream by; missing ones are 0."""
    c = len(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_f, canvas = None, None
        for b in batches:
            f = b.column(0).to_numpy()
            at = b.column(1).to_numpy().astype(np.int64) * w + b.column(2).to_numpy()
            v = np.stack([b.column(3 + k).to_numpy() for k in range(c)], axis=1).astype(np.uint8)
            cuts = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1, [len(f)]])
            done: list[tuple[int, bytes]] = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if open_f is None or f[a] != open_f:
                    if open_f is not None:
                        done.append((open_f, canvas.tobytes()))
                    open_f, canvas = int(f[a]), np.zeros((h * w, c), np.uint8)
                canvas[at[a:z]] = v[a:z]
            if done:
                yield _rows(done, w, h, c)
        if open_f is not None:
            yield _rows([(open_f, canvas.tobytes())], w, h, c)
    return px.select("f", "y", "x", *channels).repartition("f").sortWithinPartitions("f").mapInArrow(run, f"f long, {FRAME}")


def _rows(done: list[tuple[int, bytes]], w: int, h: int, c: int) -> pa.RecordBatch:
    size = lambda v: pa.array([v] * len(done), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.int64()), size(w), size(h), size(c), pa.array([d for _, d in done], pa.binary())], ["f", "w", "h", "c", "data"])


def unpack(frames: DataFrame, channels: Sequence[str] = RGB, keys: dict[str, str] = {"f": "long"}) -> DataFrame:
    """(keys, y, x, channels): the pixels of frames, by columns that tell frames apart (their names and types)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, stack in _stacks(b):
                n, h, w, c = stack.shape
                one = lambda v: pa.array(np.tile(v, n).astype(np.int32))
                owner = pa.array(np.repeat(np.arange(n), h * w))
                flat = stack.reshape(-1, c).astype(np.int32)
                columns = [*(part.column(k).take(owner) for k in keys), one(np.repeat(np.arange(h), w)), one(np.tile(np.arange(w), h)), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(c))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "y", "x", *channels])
    kinds = ", ".join(f"`{k}` {t}" for k, t in keys.items())
    return arrow_pass(frames, [*keys, "w", "h", "c", "data"], run, f"{kinds}, y int, x int, " + ", ".join(f"{n} int" for n in channels))


def _stacks(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of equal-sized frames of a batch as (rows, array); at most STACK samples together."""
    if not b.num_rows:
        return
    size = np.stack([b.column(n).to_numpy() for n in ("h", "w", "c")], axis=1).astype(np.int64)
    cuts = [0, *(np.flatnonzero((size[1:] != size[:-1]).any(1)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts[:-1], cuts[1:]):
        h, w, c = size[a].tolist()
        most = max(1, STACK // max(h * w * c, 1))
        for s in range(a, z, most):
            part = b.slice(s, min(most, z - s))
            yield part, np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8).reshape(part.num_rows, h, w, c)


def quantised(v: np.ndarray) -> np.ndarray:
    """Samples half up after clamping."""
    return v if v.dtype == np.uint8 else np.floor(np.clip(v, 0, 255) + 0.5).astype(np.uint8)


def map_frames(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """frames with f applied to stacks (n, h, w, c); its result is clamped and rounded half up unless it is bytes."""
    return map_rows(frames, lambda stack, part: f(stack))


def map_rows(frames: DataFrame, f: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The same for an f that also takes the rows of the stack, with their other columns."""
    return map_each(frames, lambda stack, part: quantised(f(stack, part)))


def map_each(frames: DataFrame, f: Callable[[np.ndarray, pa.RecordBatch], Sequence[np.ndarray]]) -> DataFrame:
    """The same for an f that gives a frame of bytes for each row, which may differ in size."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, stack in _stacks(b):
                out = f(stack, part)
                new = {n: pa.array([x.shape[k] for x in out], pa.int32()) for n, k in (("w", 1), ("h", 0), ("c", 2))}
                new["data"] = pa.array([np.ascontiguousarray(x).tobytes() for x in out], pa.binary())
                yield pa.RecordBatch.from_arrays([new.get(k, part.column(k)) for k in names], names)
    return arrow_pass(frames, names, run, frames.schema)


def map_variants(frames: DataFrame, each: dict[str, Callable[[np.ndarray], np.ndarray]], name: str = "config") -> DataFrame:
    """(name, f, w, h, c, data): every frame through every function, a stack read once for all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, stack in _stacks(b):
                for key, f in each.items():
                    out = quantised(f(stack))
                    n, h, w, c = out.shape
                    size = [pa.array([k] * n, pa.int32()) for k in (w, h, c)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n), part.column("f"), *size, pa.array([x.tobytes() for x in out], pa.binary())], [name, "f", "w", "h", "c", "data"])
    return arrow_pass(frames, ["f", "w", "h", "c", "data"], run, f"`{name}` string, f long, {FRAME}")


# ---- neighbourhoods of stacks ------------------------------------------------------------------------


def _moved(p: np.ndarray, dy: int, dx: int) -> tuple[tuple, tuple]:
    """(targets, sources): where the samples at (y + dy, x + dx) exist."""
    h, w = p.shape[1:3]
    to = (slice(None), slice(max(0, -dy), max(0, h - max(0, dy))), slice(max(0, -dx), max(0, w - max(0, dx))))
    src = (slice(None), slice(max(0, dy), max(0, h + min(0, dy))), slice(max(0, dx), max(0, w + min(0, dx))))
    return to, src


def bilateral(sigma_s: float = 15.0, sigma_c: float = 25.0, kernel: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    """Edge-keeping mean per channel; neighbours outside are skipped. A weight depends on a difference of bytes: 511 of them are looked up."""
    radius = max(3, kernel | 1) // 2
    near = np.exp(-(np.arange(-255.0, 256.0) ** 2) / (2 * sigma_c**2))

    def run(p: np.ndarray) -> np.ndarray:
        whole, v = p.astype(np.int16), p.astype(np.float64)
        top, bottom = np.zeros(p.shape), np.zeros(p.shape)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                to, src = _moved(p, dy, dx)
                k = exp(-(dy * dy + dx * dx) / (2 * sigma_s**2)) * near[whole[src] - whole[to] + 255]
                top[to] += k * v[src]
                bottom[to] += k
        return top / bottom
    return run


def gaussian(sigma: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """Separable, edges repeated, rounded after each pass."""
    k = gaussian_weights(sigma)
    r = len(k) // 2

    def run(p: np.ndarray) -> np.ndarray:
        wide = np.pad(p.astype(np.float64), ((0, 0), (0, 0), (r, r), (0, 0)), mode="edge")
        p = np.floor(sum(w * wide[:, :, i:i + p.shape[2]] for i, w in enumerate(k)) + 0.5)
        tall = np.pad(p, ((0, 0), (r, r), (0, 0), (0, 0)), mode="edge")
        return sum(w * tall[:, i:i + p.shape[1]] for i, w in enumerate(k))
    return run


def sharpen(strength: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    def run(p: np.ndarray) -> np.ndarray:
        v, total, count = p.astype(np.float64), np.zeros(p.shape), np.zeros(p.shape)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                to, src = _moved(p, dy, dx)
                total[to] += v[src]
                count[to] += 1
        return v + strength * (v - total / count)
    return run


def edges() -> Callable[[np.ndarray], np.ndarray]:
    """Sobel magnitude of BT.709 luma with edges repeated, cut to 255, the same on all channels."""
    def run(p: np.ndarray) -> np.ndarray:
        v = p.astype(np.float64)
        l = np.pad(0.2126 * v[..., 0] + 0.7152 * v[..., 1] + 0.0722 * v[..., 2], ((0, 0), (1, 1), (1, 1)), mode="edge")
        h, w = p.shape[1:3]
        gx, gy = (sum(k * l[:, 1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for (dy, dx), k in weights.items()) for weights in (SOBEL_X, SOBEL_Y))
        return np.repeat(np.floor(np.minimum(255.0, np.sqrt(gx * gx + gy * gy) + 1e-9)).astype(np.uint8)[..., None], 3, axis=3)
    return run


def directional_blur(angle: float, length: int) -> Callable[[np.ndarray], np.ndarray]:
    """Mean along a line of `length` + 1 samples, nearest, skipping those outside."""
    ux, uy, half = cos(radians(angle)), sin(radians(angle)), length // 2

    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        yy, xx = np.mgrid[0:h, 0:w]
        total, count = np.zeros(p.shape), np.zeros((h, w))
        for k in range(-half, half + 1):
            sx, sy = np.trunc(xx + ux * k + 0.5).astype(int), np.trunc(yy + uy * k + 0.5).astype(int)
            ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
            total += np.where(ok[None, ..., None], p[:, np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0)
            count += ok
        return total / count[None, ..., None]
    return run


def background_blur(cx: float = 0.5, cy: float = 0.5, radius: float = 0.3, strength: float = 8.0) -> Callable[[np.ndarray], np.ndarray]:
    """Blur that grows with the distance from a focus (in shares of the frame; 1 is half its width or height): reach and width of the kernel vary by pixel."""
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        yy, xx = np.mgrid[0:h, 0:w]
        d = np.hypot((xx - cx * w) / (w / 2), (yy - cy * h) / (h / 2))
        focus = (1 - np.clip((d - radius) / (1 - radius + 0.001), 0, 1)) ** 2
        reach = np.clip(np.floor(3 * strength * (1 - focus)), 1, 15).astype(int)
        spread = np.maximum(0.1, 2 * (strength * (1 - focus)) ** 2)
        v, most = p.astype(np.float64), int(reach.max())
        small = h * w <= 1024  # then weights by pairs of places are few, and each place is read once, not once for each step of the kernel
        pairs = np.zeros((h * w, h * w)) if small else None
        top, bottom = np.zeros(p.shape), np.zeros((h, w))
        for dy in range(-most, most + 1):
            for dx in range(-most, most + 1):
                k = np.where((abs(dy) <= reach) & (abs(dx) <= reach), np.exp(-(dy * dy + dx * dx) / spread), 0.0)
                sy, sx = np.clip(yy + dy, 0, h - 1), np.clip(xx + dx, 0, w - 1)
                if small:
                    pairs[np.arange(h * w), (sy * w + sx).ravel()] += k.ravel()
                else:
                    top += k[None, ..., None] * v[:, sy, sx]
                bottom += k
        if small:
            top = np.einsum("ij,njc->nic", pairs, v.reshape(len(v), h * w, -1), optimize=True).reshape(p.shape)
        mix = focus[None, ..., None]
        return np.floor(np.clip(mix * v + (1 - mix) * top / bottom[None, ..., None] + 1e-9, 0, 255)).astype(np.uint8)
    return run


def double(strength: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """Twice the size, cubic, then sharpened against the mean of the samples a source pixel away on all sides that exist."""
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        up = np.clip(np.einsum("yh,nhwc,xw->nyxc", _cubic_rows(h), p.astype(np.float64), _cubic_rows(w), optimize=True), 0, 255)
        total, count = np.zeros(up.shape), np.zeros(up.shape)
        for dy in (-2, 0, 2):
            for dx in (-2, 0, 2):
                to, src = _moved(up, dy, dx)
                total[to] += up[src]
                count[to] += 1
        return up + strength * (up - total / count)
    return run


def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(m) * (n / m)
    low = np.floor(at).astype(int)
    return np.minimum(low, n - 1), np.minimum(low + 1, n - 1), at - low


def bilinear(v: np.ndarray, dw: int, dh: int) -> np.ndarray:
    """A stack at another size, as doubles: source coordinate = target coordinate * source size / target size; edges repeat."""
    v = v.astype(np.float64)
    y0, y1, fy = _taps(v.shape[1], dh)
    x0, x1, fx = _taps(v.shape[2], dw)
    fx, fy = fx[None, None, :, None], fy[None, :, None, None]
    taps = ((y0, 1 - fy, x0, 1 - fx), (y0, 1 - fy, x1, fx), (y1, fy, x0, 1 - fx), (y1, fy, x1, fx))
    return sum(v[:, y][:, :, x] * (wx * wy) for y, wy, x, wx in taps)


def resize(dw: int, dh: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda p: bilinear(p, dw, dh)


# ---- layouts -----------------------------------------------------------------------------------------

TENSOR = "shape array<int>, data binary"
#: What a sample of a byte becomes: a share, -1 to 1, or itself.
RANGES = {"unit": (np.float32(1 / 255), np.float32(0)), "signed": (np.float32(2 / 255), np.float32(-1)), "raw": (np.float32(1), np.float32(0))}


def as_tensor(stack: np.ndarray, layout: str = "nchw", range: str = "unit", bgr: bool = False) -> np.ndarray:
    """A stack of frames as float32 in a model's layout and range."""
    scale, offset = RANGES[range]
    out = (stack[..., ::-1] if bgr else stack).astype(np.float32) * scale + offset
    return out.transpose(0, 3, 1, 2) if layout == "nchw" else out


def from_tensor(t: np.ndarray, layout: str = "nchw", range: str = "unit", bgr: bool = False) -> np.ndarray:
    """Frames of float32 in a model's layout and range: bytes half up, clamped."""
    v = t.transpose(0, 2, 3, 1) if layout == "nchw" else t
    v = v * np.float32(0.5) + np.float32(0.5) if range == "signed" else v
    v = v if range == "raw" else v * np.float32(255)
    out = np.clip(v + np.float32(0.5), 0, 255).astype(np.uint8)
    return out[..., ::-1] if bgr else out


def to_tensors(frames: DataFrame, layout: str = "nchw", range: str = "unit", bgr: bool = False) -> DataFrame:
    """(f, shape, data): each frame as a little-endian float32 tensor of one batch entry; layout nchw or nhwc."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, stack in _stacks(b):
                t = np.ascontiguousarray(as_tensor(stack, layout, range, bgr), "<f4")
                shape = pa.array([[1, *t.shape[1:]]] * len(t), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("f"), shape, pa.array([x.tobytes() for x in t], pa.binary())], ["f", "shape", "data"])
    return arrow_pass(frames, ["f", "w", "h", "c", "data"], run, f"f long, {TENSOR}")


def _tensors(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of equally shaped tensors of a batch as (rows, one array); at most STACK samples together."""
    shapes = b.column("shape").to_pylist()
    a = 0
    for z in range(1, b.num_rows + 1):
        if z == b.num_rows or shapes[z] != shapes[a] or (z - a + 1) * int(np.prod(shapes[a])) > STACK:
            part = b.slice(a, z - a)
            yield part, np.frombuffer(b"".join(part.column("data").to_pylist()), "<f4").reshape(z - a, *shapes[a][1:])
            a = z


def from_tensors(tensors: DataFrame, layout: str = "nchw", range: str = "unit", bgr: bool = False) -> DataFrame:
    """Frames of tensors (f, shape, data)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in _tensors(b):
                out = from_tensor(t, layout, range, bgr)
                yield _rows([(f, x.tobytes()) for f, x in zip(part.column("f").to_pylist(), out)], out.shape[2], out.shape[1], out.shape[3])
    return arrow_pass(tensors, ["f", "shape", "data"], run, f"f long, {FRAME}")


def interleaved(tensors: DataFrame) -> DataFrame:
    """Tensors of planes one after another as tensors of samples side by side: (1, c, h, w) to (1, h, w, c)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in _tensors(b):
                made = np.ascontiguousarray(t.transpose(0, 2, 3, 1))
                yield pa.RecordBatch.from_arrays([part.column("f"), pa.array([[1, *made.shape[1:]]] * len(made), pa.list_(pa.int32())), pa.array([m.tobytes() for m in made], pa.binary())], ["f", "shape", "data"])
    return arrow_pass(tensors, ["f", "shape", "data"], run, f"f long, {TENSOR}")


def samples(tensors: DataFrame) -> DataFrame:
    """(f, i, v): the numbers of tensors in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in _tensors(b):
                n, each = len(t), t[0].size
                owner = pa.array(np.repeat(np.arange(n), each))
                yield pa.RecordBatch.from_arrays([part.column("f").take(owner), pa.array(np.tile(np.arange(each, dtype=np.int32), n)), pa.array(t.reshape(-1).astype(np.float64))], ["f", "i", "v"])
    return arrow_pass(tensors, ["f", "shape", "data"], run, "f long, i int, v double")


# ---- regions -----------------------------------------------------------------------------------------


def crops(frames: DataFrame, windows: DataFrame, size: int | None = None) -> DataFrame:
    """(f, id, w, h, c, data): a crop of every window (f, id, left, top, side_w, side_h) of its frame, brought to size x size if given.

    A frame's windows come to it together, so a frame is joined once however many it has, and only frames with
    windows are read on. Windows lie inside their frame; what doesn't is left out.
    """
    per = windows.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("id", "left", "top", "side_w", "side_h"))).alias("_windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, stack in _stacks(b):
                for frame, f, wanted in zip(stack, part.column("f").to_pylist(), part.column("_windows").to_pylist()):
                    rows = []
                    for x in wanted:
                        cut = frame[max(x["top"], 0):x["top"] + x["side_h"], max(x["left"], 0):x["left"] + x["side_w"]]
                        if cut.shape[:2] == (x["side_h"], x["side_w"]) and cut.size:
                            rows.append((x["id"], quantised(bilinear(cut[None], size, size)[0]) if size else cut))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f] * len(rows), pa.int64()), pa.array([i for i, _ in rows], pa.int64()),
                             *(pa.array([c.shape[k] for _, c in rows], pa.int32()) for k in (1, 0, 2)), pa.array([np.ascontiguousarray(c).tobytes() for _, c in rows], pa.binary())],
                            ["f", "id", "w", "h", "c", "data"])
    found = frames.select("f", "w", "h", "c", "data").join(per, "f")
    return found.mapInArrow(run, f"f long, id long, {FRAME}")
