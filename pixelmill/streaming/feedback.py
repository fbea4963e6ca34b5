"""The feedback node over a stream of frames: one state, the last output, for each image.

A stream row is a whole frame in plane form: (image_id, frame, w, h, rgb), rgb being the
pixels in row-major order, three doubles each. Frames of an image must arrive in order
across micro-batches; within one they are sorted. Frame 0 starts from transparent black.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "image_id long, frame long, w long, h long, rgb array<double>"
STATE = "w long, h long, rgb array<double>"


def moved(past: np.ndarray, p: dict) -> np.ndarray:
    """The previous frame (h, w, 3) seen through the inverse move; nothing outside."""
    h, w, _ = past.shape
    c, s = math.cos(-2 * math.pi * p["rotate"]), math.sin(-2 * math.pi * p["rotate"])
    y, x = np.mgrid[0:h, 0:w] + 0.5
    dx, dy = (x - w / 2 - p["offsetX"]) / p["scale"], (y - h / 2 - p["offsetY"]) / p["scale"]
    px, py = dx * c - dy * s + w / 2 - 0.5, dx * s + dy * c + h / 2 - 0.5
    bx, by = np.floor(px).astype(int), np.floor(py).astype(int)
    out = np.zeros_like(past)
    for oy in (0, 1):
        for ox in (0, 1):
            sx, sy = bx + ox, by + oy
            inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
            k = np.where(ox, px - bx, 1 - (px - bx)) * np.where(oy, py - by, 1 - (py - by)) * inside
            out += past[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)] * k[..., None]
    return out


BLEND = {
    "screen": lambda a, b: a + b - a * b,
    "lighten": np.maximum,
    "add": lambda a, b: a + b,
    "difference": lambda a, b: np.abs(a - b),
    "darken": np.minimum,
    "normal": lambda a, b: b,
}


def feedback_stream(frames: DataFrame, params: dict) -> DataFrame:
    """Applies feedback to a streaming DataFrame of frames."""
    p = {"decay": 0.9, "blend": "screen", "opacity": 1.0, "offsetX": 0.0, "offsetY": 0.0, "scale": 1.0, "rotate": 0.0} | params

    def step(key, batches, state):
        rows = sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.frame)
        last = np.array(state.get[2]).reshape(state.get[1], state.get[0], 3) if state.exists else None
        out = []
        for r in rows:
            now = np.array(r.rgb).reshape(r.h, r.w, 3)
            past = moved(last if last is not None else np.zeros_like(now), p) * p["decay"]
            last = now + (BLEND[p["blend"]](now, past) - now) * p["opacity"]
            out.append((key[0], r.frame, r.w, r.h, last.ravel().tolist()))
        if last is not None:
            state.update((last.shape[1], last.shape[0], last.ravel().tolist()))
        yield pd.DataFrame(out, columns=["image_id", "frame", "w", "h", "rgb"])

    return frames.groupBy("image_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
