"""Seeded noise fields over a canvas. A generator's stream is cut by rows: each task jumps to where its rows begin."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelmill.functions.color import fract
from pixelmill.operators.dithers import Pcg32, stream_of

FIELD = "x long, y long, value double"
#: Names of the streams; fixed values.
STREAMS = {"white": "noise/white", "value": "noise/value", "gaussian": "noise/gaussian", "gradient": "noise/interleaved-gradient"}


def draws(seed: int, name: str, first: int, count: int) -> np.ndarray:
    """Numbers in [0, 1) from place ``first`` of a stream on, all at once."""
    rng = Pcg32(seed, stream_of(name)).skip(first)
    step = np.full(count, 6364136223846793005, np.uint64)
    if count:
        step[0] = 1
    step = np.multiply.accumulate(step)  # the state after k steps is step[k] * state + plus[k]
    plus = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)[:-1] * np.uint64(rng.inc)))[:count]
    state = step * np.uint64(rng.state) + plus
    word = (((state >> np.uint64(18)) ^ state) >> np.uint64(27)).astype(np.uint32)
    turn = (state >> np.uint64(59)).astype(np.uint32)
    word = word >> turn | word << (-turn & np.uint32(31))
    return (word >> np.uint32(8)) * 2.0**-24


def _rows(width: int, value_of) -> callable:
    def run(batches):
        for batch in batches:
            for y in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, y)), pa.array(value_of(int(y)))], names=["x", "y", "value"])

    return run


def white(spark: SparkSession, width: int, height: int, seed: int) -> DataFrame:
    """(x, y, value): uniform in [0, 1), in raster order of the stream."""
    return spark.range(height).mapInArrow(_rows(width, lambda y: draws(seed, STREAMS["white"], y * width, width)), FIELD)


def gaussian(spark: SparkSession, width: int, height: int, seed: int) -> DataFrame:
    """(x, y, value): standard normal; a pair of draws gives two neighbours in raster order."""

    def row(y):
        first = y * width // 2
        last = (y * width + width + 1) // 2
        u = draws(seed, STREAMS["gaussian"], 2 * first, 2 * (last - first)).reshape(-1, 2)
        size, angle = np.sqrt(-2 * np.log(1 - u[:, 0])), 2 * math.pi * u[:, 1]
        both = np.stack([size * np.cos(angle), size * np.sin(angle)], 1).reshape(-1)
        return both[y * width - 2 * first :][:width]

    return spark.range(height).mapInArrow(_rows(width, row), FIELD)


def value(spark: SparkSession, width: int, height: int, cells: int, seed: int) -> DataFrame:
    """(x, y, value): smooth between the points of a lattice that wraps round."""
    lattice = draws(seed, STREAMS["value"], 0, cells * cells).reshape(cells, cells)

    def along(n, size):
        at = np.arange(n) * (cells / size)
        low = np.floor(at).astype(int)
        t = at - low
        return low % cells, (low + 1) % cells, t * t * (3 - 2 * t)

    x0, x1, tx = along(width, width)
    y0, y1, ty = along(height, height)

    def row(y):
        top, bottom = (lattice[k][x0] + (lattice[k][x1] - lattice[k][x0]) * tx for k in (y0[y], y1[y]))
        return top + (bottom - top) * ty[y]

    return spark.range(height).mapInArrow(_rows(width, row), FIELD)


def gradient(rel, seed: int | None = None):
    """Adds ``value``: interleaved gradient noise, from an offset of 0 to 4095 on either axis where seeded."""
    ox = oy = 0
    if seed is not None:
        rng = Pcg32(seed, stream_of(STREAMS["gradient"]))
        ox, oy = rng.next_u32() >> 20, rng.next_u32() >> 20
    inner = fract(f"(0.06711056 * (x + {ox}) + 0.00583715 * (y + {oy}))")
    return rel.let(value=fract(f"(52.9829189 * {inner})"))
