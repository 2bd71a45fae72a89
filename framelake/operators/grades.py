"""The chain's steps on stacks of frames (n, h, w, c): the same rules as tone, geometry and histogram have for pixels, for chains that run whole frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from framelake.operators import packed
from framelake.operators.packed import bilinear, quantised
from framelake.operators.tone import ACES_IN, LOOKS

Stack = Callable[[np.ndarray], np.ndarray]


def _cut(v: np.ndarray) -> np.ndarray:
    """Bytes towards zero after clamping."""
    return np.floor(np.clip(v, 0, 255)).astype(np.uint8)


def _luma(p: np.ndarray) -> np.ndarray:
    v = p.astype(np.float64)
    return 0.2126 * v[..., 0] + 0.7152 * v[..., 1] + 0.0722 * v[..., 2]


def brightness_contrast(brightness: float = 0.0, contrast: float = 1.0) -> Stack:
    return lambda p: (p.astype(np.float64) - 128) * contrast + 128 + brightness


def saturation(factor: float = 1.0) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        l = _luma(p)[..., None]
        return l + factor * (p - l)
    return run


def gamma(g: float = 1.0) -> Stack:
    table = quantised((np.arange(256) / 255.0) ** (1.0 / g) * 255)
    return lambda p: table[p]


def white_balance(temperature: float, tint: float) -> Stack:
    return lambda p: p + np.array([1.5 * temperature, tint, -1.5 * temperature])


def vignette(strength: float = 0.5) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        dy, dx = np.mgrid[0:h, 0:w] - np.array([h / 2.0, w / 2.0])[:, None, None]
        keep = np.maximum(0.0, 1 - strength * (dx * dx + dy * dy) / ((w / 2.0) ** 2 + (h / 2.0) ** 2))
        return p * keep[None, ..., None]
    return run


def grain(amount: float = 20.0, seed: int = 42) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        y, x = np.mgrid[0:p.shape[1], 0:p.shape[2]].astype(np.uint64)
        mask = np.uint64(0xFFFFFFFF)
        n = (x * np.uint64(374761393) + y * np.uint64(668265263) + np.uint64(seed)) & mask
        n = ((n ^ (n >> np.uint64(13))) * np.uint64(1274126177)) & mask
        noise = ((n & np.uint64(65535)) / 65535.0 - 0.5) * 2 * amount
        return p + noise[None, ..., None]
    return run


def hdr(method: str = "reinhard", peak: float = 1000.0) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        x = p / 255.0 * 100.0 / peak
        if method != "aces":
            return _cut(x / (1 + x) * 255)
        v = np.stack([row[0] * x[..., 0] + row[1] * x[..., 1] + row[2] * x[..., 2] for row in ACES_IN], axis=-1)
        return _cut((v * (v + 0.0245786) - 0.000090537) / (v * (0.983729 * v + 0.4329510) + 0.238081) * 255)
    return run


def _look(preset: str, size: int) -> np.ndarray:
    """The look's bytes at [b, g, r] of its grid."""
    before, lines, after = LOOKS[preset]
    b, g, r = np.meshgrid(*[np.arange(size) / (size - 1.0)] * 3, indexing="ij")
    muted = lambda c, share: [x + (0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2] - x) * share for x in c] if share else c
    bent = [np.where(x < 0.5, x * lo[0] + lo[1], np.where(x > 0.5, x * hi[0] + hi[1], x * at[0] + at[1])) for x, (lo, at, hi) in zip(muted([r, g, b], before), lines)]
    return quantised(np.clip(np.stack(muted(bent, after), axis=-1), 0.0, 1.0) * 255).astype(np.float64)


def lut(preset: str, strength: float = 1.0, size: int = 17) -> Stack:
    grid = _look(preset, size)

    def run(p: np.ndarray) -> np.ndarray:
        place = p / 255.0 * (size - 1)
        low = np.minimum(np.floor(place), size - 2).astype(int)
        part = place - low
        total = np.zeros(p.shape)
        for i in range(8):
            d = np.array([i & 1, i >> 1 & 1, i >> 2])
            k = np.where(d, part, 1 - part)
            at = low + d
            total += (k[..., 0] * k[..., 1] * k[..., 2])[..., None] * grid[at[..., 2], at[..., 1], at[..., 0]]
        return _cut(p + strength * (total - p) + 0.5 + 1e-9)
    return run


def chroma_key(hue=(60.0, 160.0), s_min: float = 0.3, v_min: float = 0.2, spill: float = 0.3, background=(0, 0, 0), edge: float = 0.1) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        r, g, b = np.moveaxis(p / 255.0, -1, 0)
        hi, lo = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        d = hi - lo
        far = np.where(d > 0.001, d, 1.0)
        turn = np.where(d <= 0.001, 0.0, np.where(hi == r, np.fmod((g - b) / far, 6), np.where(hi == g, (b - r) / far + 2, (r - g) / far + 4))) * 60
        turn = np.where(turn < 0, turn + 360, turn)
        s = np.where(hi > 0.001, d / np.where(hi > 0.001, hi, 1.0), 0.0)
        mid, half = (hue[0] + hue[1]) / 2, (hue[1] - hue[0]) / 2
        share = lambda c, least: np.minimum((c - least) / (1 - least + 0.001), 1.0)
        inside = (turn >= hue[0]) & (turn <= hue[1]) & (s >= s_min) & (hi >= v_min)
        m = np.where(inside, np.clip((1 - np.minimum(np.abs(turn - mid), half) / half) * share(s, s_min) * share(hi, v_min), 0.0, 1.0), 0.0)
        a = 1 - m
        if edge > 0.001:
            t = np.clip((a - 0.1) / (0.9 - 0.1), 0.0, 1.0)
            a = np.where((m > 0.001) & (m < 0.999), t * t * (3 - 2 * t), a)
        if spill > 0.001:
            g = np.maximum(g - np.where(m > 0.01, np.maximum(g - np.maximum(r, b), 0.0) * spill * m, 0.0), 0.0)
        return np.stack([_cut(a * c * 255 + (1 - a) * bg) for c, bg in zip((r, g, b), background)], axis=-1)
    return run


def clahe(tile: int = 8, clip: float = 3.0) -> Stack:
    """Colours scaled by their luminance, equalised by tiles."""
    def run(p: np.ndarray) -> np.ndarray:
        n, h, w = p.shape[:3]
        l = np.floor(_luma(p) + 0.5).astype(int)
        rows, cols = -(-h // tile), -(-w // tile)
        ty, tx = np.mgrid[0:h, 0:w] // tile
        of_tile = (np.arange(n)[:, None, None] * rows + ty) * cols + tx
        count = np.bincount((of_tile * 256 + l).ravel(), minlength=n * rows * cols * 256).reshape(-1, 256)
        limit = count.sum(1, keepdims=True) / 256.0 * clip
        over = np.floor(count - limit)
        bins = np.where(count > limit, np.floor(limit) + np.floor(over / 256) + (np.arange(256) < over % 256), count)
        before = np.cumsum(bins, axis=1) - bins
        table = np.floor(np.clip(before * 255.0 / np.maximum(bins.sum(1, keepdims=True), 1), 0, 255) + 0.5)
        wy, wx = ((np.mgrid[0:h, 0:w] % tile) / float(tile))
        mixed = np.zeros(l.shape)
        for j in (0, 1):
            for i in (0, 1):
                corner = (np.arange(n)[:, None, None] * rows + np.minimum(ty + j, rows - 1)) * cols + np.minimum(tx + i, cols - 1)
                mixed += (wy if j else 1 - wy) * (wx if i else 1 - wx) * table[corner, l]
        return p * (np.floor(np.clip(mixed, 0, 255) + 0.5) / np.maximum(l, 1))[..., None]
    return run


def crop(w: int, h: int, left: int, top: int) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), h, w, p.shape[3]), np.uint8)
        y, x = slice(max(top, 0), min(top + h, p.shape[1])), slice(max(left, 0), min(left + w, p.shape[2]))
        if y.start < y.stop and x.start < x.stop:
            out[:, y.start - top:y.stop - top, x.start - left:x.stop - left] = p[:, y, x]
        return out
    return run


def pad(px_x: int, px_y: int, colour=(0, 0, 0)) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        n, h, w, c = p.shape
        out = np.empty((n, h + 2 * px_y, w + 2 * px_x, c), np.uint8)
        out[:] = np.array(colour, np.uint8)
        out[:, px_y:px_y + h, px_x:px_x + w] = p
        return out
    return run


def flip(horizontal: bool = True) -> Stack:
    return lambda p: np.ascontiguousarray(p[:, :, ::-1] if horizontal else p[:, ::-1])


def lens(k1: float) -> Stack:
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        cx, cy = w / 2.0, h / 2.0
        yy, xx = np.mgrid[0:h, 0:w]
        nx, ny = (xx - cx) / cx, (yy - cy) / cy
        d = 1 + k1 * (nx * nx + ny * ny)
        sx, sy = np.floor(nx * d * cx + cx + 0.5).astype(int), np.floor(ny * d * cy + cy + 0.5).astype(int)
        ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        return np.where(ok[None, ..., None], p[:, np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0).astype(np.uint8)
    return run


def _cubic(n: int, m: int) -> np.ndarray:
    """(m, n) cubic weights, a = -0.5, at clamped places and not normalised."""
    at = np.arange(m) * (n / m)
    out = np.zeros((m, n))
    for i in range(-1, 3):
        src = np.clip(np.floor(at) + i, 0, n - 1).astype(int)
        t = np.abs(at - src)
        np.add.at(out, (np.arange(m), src), np.where(t <= 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0)))
    return out


def scale(w: int, h: int, how: str = "bilinear") -> Stack:
    """Another size: bilinear, bicubic or nearest."""
    def run(p: np.ndarray) -> np.ndarray:
        sh, sw = p.shape[1:3]
        if how == "nearest":
            return p[:, np.arange(h) * sh // h][:, :, np.arange(w) * sw // w]
        if how == "bicubic":
            return np.einsum("yh,nhwc,xw->nyxc", _cubic(sh, h), p.astype(np.float64), _cubic(sw, w), optimize=True)
        return bilinear(p, w, h)
    return run


def zoom(factor: float) -> Stack:
    """A centred, even-sized window scaled back to the whole frame."""
    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[1:3]
        cw, ch = int(w / factor) & ~1, int(h / factor) & ~1
        return bilinear(crop(cw, ch, (w - cw) // 2, (h - ch) // 2)(p), w, h)
    return run


#: Steps of a chain on stacks, by name.
STEPS: dict[str, Callable[..., Stack]] = {
    "crop": crop, "pad": pad, "denoise": packed.bilateral, "clahe": clahe, "scale": scale, "super_res": packed.double, "lut": lut, "brightness_contrast": brightness_contrast,
    "saturation": saturation, "gamma": gamma, "white_balance": white_balance, "blur": packed.gaussian, "sharpen": packed.sharpen, "vignette": vignette, "lens": lens,
    "directional_blur": packed.directional_blur, "edges": packed.edges, "grain": grain, "flip": flip, "chroma_key": chroma_key, "background_blur": packed.background_blur, "hdr": hdr, "zoom": zoom,
}
