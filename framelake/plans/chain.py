"""A processing chain as data: enabled steps in a fixed order, compiled to one DataFrame."""

from __future__ import annotations

import dataclasses
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import color, geometry, grades, packed, sequence, tone

#: Order of steps in the file chain and in the live chain.
FILE_ORDER = ("crop", "pad", "denoise", "clahe", "scale", "super_res", "lut", "brightness_contrast", "saturation", "gamma", "white_balance", "blur", "sharpen", "vignette", "lens",
              "directional_blur", "edges", "grain", "flip", "chroma_key", "background_blur", "ai_denoise", "matting", "autoframe", "hdr", "temporal", "stabilise")
LIVE_ORDER = ("ai_denoise", "matting", "temporal", "stabilise", "super_res", "denoise", "clahe", "lut", "brightness_contrast", "saturation", "gamma", "white_balance", "blur", "sharpen", "vignette", "lens",
              "directional_blur", "edges", "grain", "flip", "chroma_key", "background_blur", "hdr", "zoom", "autoframe", "crop", "pad", "scale")
#: Steps that need a camera's frames in order; all others take a frame alone.
ORDERED = ("ai_denoise", "matting", "temporal", "stabilise", "autoframe")
RGB = ("r", "g", "b")


@dataclass(frozen=True)
class Spec:
    """Frame size, chain order and the enabled steps with their parameters."""

    w: int
    h: int
    order: str = "file"
    steps: dict[str, dict] = field(default_factory=dict)

    def chain(self) -> tuple[str, ...]:
        known = FILE_ORDER if self.order == "file" else LIVE_ORDER
        if extra := set(self.steps) - set(known):
            raise ValueError(f"unknown steps: {sorted(extra)}")
        return tuple(s for s in known if s in self.steps)

    def needs_rgb(self) -> bool:
        """Whether any step works on colour; if not, planes needn't be converted."""
        return any(s not in ("crop", "pad") for s in self.chain())


def _on_pixels(spec: Spec) -> list[Callable[[DataFrame], DataFrame]] | None:
    """The chain's steps on pixel tables, if all of them are projections or filters; sizes follow the crop."""
    w, h, out = spec.w, spec.h, []
    for name in spec.chain():
        k = spec.steps[name]
        if name == "crop" and k["left"] >= 0 and k["top"] >= 0 and k["left"] + k["w"] <= w and k["top"] + k["h"] <= h:
            out.append(lambda d, k=k: geometry.crop_inside(d, **k))
            w, h = k["w"], k["h"]
        elif name in ("brightness_contrast", "saturation", "gamma", "white_balance", "chroma_key"):
            out.append(lambda d, f=getattr(tone, name), k=k: f(d, **k))
        elif name == "hdr":
            out.append(lambda d, f=tone.hdr_aces if k.get("method") == "aces" else tone.hdr_reinhard, peak=k.get("peak", 1000.0): f(d, peak))
        elif name == "lut":
            out.append(lambda d, k=k: tone.apply_lut(d, tone.lut(d.sparkSession, k["preset"]), strength=k.get("strength", 1.0)))
        elif name == "grain":
            out.append(lambda d, k=k: tone.film_grain(d, **k))
        elif name in ("vignette", "flip"):
            out.append(lambda d, f={"vignette": tone.vignette, "flip": geometry.flip}[name], k=k, w=w, h=h: f(d, w, h, **k))
        else:
            return None
    return out


def compile_chain(spec: Spec, px: DataFrame) -> DataFrame:
    """Pixels (f, y, x, r, g, b) through the enabled steps in the spec's order: one lazy plan.

    Chains of projections stay pixels and are one projection. As soon as a step looks at neighbours or changes the
    grid, frames are packed first and the chain runs on them; pixels come together once.
    """
    steps = _on_pixels(spec)
    if steps is None:
        return packed.unpack(compile_frames(spec, packed.pack(px, spec.w, spec.h)))
    for step in steps:
        px = step(px)
    return px


def _fused(spec: Spec, names: tuple[str, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Steps on stacks, one after the other, rounded in between."""
    each = [grades.STEPS[n](**spec.steps[n]) for n in names]

    def run(p: np.ndarray) -> np.ndarray:
        for f in each:
            p = packed.quantised(f(p))
        return p
    return run


def _ordered(spec: Spec, name: str, frames: DataFrame) -> DataFrame:
    """frames (camera, f, ...) through a step that needs them in order. The file chain's last frame is the chain's own output, the live chain's the raw one."""
    k, recursive = spec.steps[name], spec.order == "file"
    if name == "ai_denoise":
        return sequence.map_windows(frames, sequence.denoised(**k))
    if name == "autoframe":
        return _framed(frames, **k)
    make = {"temporal": lambda **k: sequence.mixed_with_last(recursive=recursive, **k), "stabilise": lambda **k: sequence.steadied(recursive=recursive, **k), "matting": sequence.matted}[name]
    return sequence.recurrent(frames, make(**k))


def _framed(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """frames cut to their windows (camera, f, left, top, w, h) and scaled back; those without a window stay."""
    at = windows.select("camera", "f", *(F.col(c).alias(f"_{c}") for c in ("left", "top", "w", "h")))

    def run(stack: np.ndarray, rows) -> np.ndarray:
        cut = zip(stack, *(rows.column(f"_{c}").to_pylist() for c in ("left", "top", "w", "h")))
        return np.stack([frame if left is None else packed.quantised(packed.bilinear(grades.crop(w, h, left, top)(frame[None]), frame.shape[1], frame.shape[0]))[0] for frame, left, top, w, h in cut])
    return packed.map_rows(frames.join(at, ["camera", "f"], "left"), run).drop("_left", "_top", "_w", "_h")


def compile_frames(spec: Spec, frames: DataFrame) -> DataFrame:
    """Frames (f, w, h, c, data), with a camera for ordered steps, through the enabled steps: the runs of steps between ordered ones are one pass each, without a shuffle."""
    names, run = spec.chain(), []
    if any(n in ORDERED for n in names) and "camera" not in frames.columns:
        raise ValueError("ordered steps need a column camera")
    for name in (*names, None):
        if name in ORDERED or name is None:
            if run:
                frames = packed.map_frames(frames, _fused(spec, tuple(run)))
                run = []
            if name:
                frames = _ordered(spec, name, frames)
        else:
            run.append(name)
    return frames


def compile_planes(spec: Spec, planes: DataFrame) -> DataFrame:
    """Planes through the chain, converted to colour and back only if a step needs it."""
    if not spec.chain():
        return planes
    return color.rgb_to_planes(compile_chain(spec, color.planes_to_rgb(planes)))


def parse_flags(line: str, w: int, h: int) -> Spec:
    """A spec from flags like --gamma g=0.8 --flip; --all enables a fixed bundle; unknown flags raise."""
    steps: dict[str, dict] = {}
    name = None
    for word in shlex.split(line):
        if word == "--all":
            steps |= {"denoise": {}, "brightness_contrast": {"contrast": 1.1}, "saturation": {"factor": 1.2}, "sharpen": {}}
        elif word.startswith("--"):
            name = word[2:].replace("-", "_")
            steps[name] = {}
        elif name and "=" in word:
            key, _, value = word.partition("=")
            try:
                steps[name][key] = int(value) if value.lstrip("-").isdigit() else float(value)
            except ValueError:
                steps[name][key] = value
        else:
            raise ValueError(f"unexpected {word!r}")
    spec = Spec(w, h, "file", steps)
    spec.chain()
    return spec


def to_flags(spec: Spec) -> str:
    """The flags that parse_flags reads as this spec."""
    return " ".join(" ".join([f"--{n.replace('_', '-')}", *(f"{k}={v}" for k, v in spec.steps[n].items())]) for n in spec.chain())


def with_steps(spec: Spec, **steps: dict) -> Spec:
    return dataclasses.replace(spec, steps=spec.steps | steps)


def batch_matrix(frames: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """(config, f, w, h, c, data): frames through every named spec of steps on single frames, in one scan: a frame is read once and every spec's chain runs on it."""
    for n, spec in specs.items():
        if bad := [s for s in spec.chain() if s in ORDERED]:
            raise ValueError(f"{n}: {bad} need frames in order")
    return packed.map_variants(frames, {n: _fused(spec, spec.chain()) for n, spec in specs.items()})


def readiness(loaded: Column, warmed: Column) -> Column:
    """0 missing, 1 warming, 2 ready."""
    return F.when(~loaded, 0).when(~warmed, 1).otherwise(2)
