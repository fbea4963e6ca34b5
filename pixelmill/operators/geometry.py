"""Extents of whole images: replication, reduction by area and sprite sheets. Each pixel is sent to the pixels it becomes."""

from __future__ import annotations

from pixelmill.plans.rel import num

SUMMED = ("r", "g", "b", "a")


def integer_scale(rel, factor: int):
    """Every pixel becomes a square of ``factor`` by ``factor``; no shuffle."""
    if factor < 1 or factor != int(factor):
        raise ValueError(f"a scale is a positive integer, not {factor}")
    rel = rel.explode("i", rel.d.ints(0, factor - 1)).explode("j", rel.d.ints(0, factor - 1))
    return rel.let(x=f"x * {factor} + i", y=f"y * {factor} + j", w=f"w * {factor}", h=f"h * {factor}").drop("i", "j")


def reduced(rel, width: str, height: str):
    """Area averages in linear light; ``width`` and ``height`` are expressions of w and h, and never enlarge.

    A pixel lies under at most two pixels of the result on each axis, so up to four rows leave for it, and their
    sums are partial before the shuffle. Weights are whole overlaps in units both extents share, divided once.
    """
    d = rel.d
    rel = rel.let(tw=f"greatest(1, least(cast({width} as bigint), w))", th=f"greatest(1, least(cast({height} as bigint), h))")
    for axis, size, to in (("x", "w", "tw"), ("y", "h", "th")):
        rel = rel.explode(f"t{axis}", d.ints(d.div(f"{axis} * {to}", size), d.div(f"({axis} + 1) * {to} - 1", size)))
        overlap = f"least(({axis} + 1) * {to}, (t{axis} + 1) * {size}) - greatest({axis} * {to}, t{axis} * {size})"
        rel = rel.let(**{f"k{axis}": f"cast({overlap} as double) / {size}"})
    keys = [c for c in ("image_id", "frame") if c in rel.columns]
    out = rel.group([*keys, "tx", "ty", "tw", "th"], **{c: f"sum({c} * kx * ky)" for c in SUMMED})
    return out.let(x="tx", y="ty", w="tw", h="th").drop("tx", "ty", "tw", "th")


def sheet_grid(frames: int, columns: int) -> tuple[int, int]:
    """(columns, rows) of a sheet."""
    wide = max(1, min(int(columns), max(1, frames)))
    return wide, -(-max(1, frames) // wide)


def sprite_sheet(rel, frames: int, columns: int, factor: int = 1):
    """The frames of each image side by side, row by row; cells without a frame are transparent."""
    wide, rows = sheet_grid(frames, columns)
    d = rel.d
    kept = [c for c in ("image_id", "frame", "x", "y", "w", "h", *SUMMED) if c in rel.columns]
    rel = rel.keep(*kept)
    if wide * rows > frames:
        rest = rel.where("frame = 0").drop("frame").explode("frame", d.ints(frames, wide * rows - 1))
        rel = rel.union(rest.let(**dict.fromkeys(SUMMED, num(0))).keep(*kept))
    rel = integer_scale(rel, factor)
    return rel.let(x=f"(frame % {wide}) * w + x", y=f"{d.div('frame', wide)} * h + y").let(w=f"w * {wide}", h=f"h * {rows}").drop("frame")
