"""Colour formulas as SQL text, and the same in Python for constants."""

from __future__ import annotations

import math

from pixelmill.plans.rel import num

#: Linear RGB to cone response, and its cube root to OKLab; fixed values.
TO_LMS = (
    (0.41222146, 0.53633255, 0.051445995),
    (0.2119035, 0.6806995, 0.10739696),
    (0.08830246, 0.28171884, 0.6299785),
)
TO_LAB = (
    (0.21045426, 0.7936178, -0.004072047),
    (1.9779985, -2.4285922, 0.4505937),
    (0.025904037, 0.78277177, -0.80867577),
)
LUMA = (0.2126, 0.7152, 0.0722)
RGB = ("r", "g", "b")


def _inverse(m):
    import numpy as np

    return tuple(map(tuple, np.linalg.inv(np.array(m)).tolist()))


FROM_LAB, FROM_LMS = _inverse(TO_LAB), _inverse(TO_LMS)


def clamp(x, low="0.0", high="1.0") -> str:
    return f"least(greatest({x}, {low}), {high})"


def mix(a, b, t) -> str:
    return f"(({a}) + (({b}) - ({a})) * ({t}))"


def fract(x) -> str:
    return f"(({x}) - floor({x}))"


def decode(c) -> str:
    """sRGB to linear."""
    return f"(case when ({c}) <= 0.040448237 then greatest({c}, 0.0) / 12.92 else pow((({c}) + 0.055) / 1.055, 2.4) end)"


def encode(c) -> str:
    """Linear to sRGB; negative light is black."""
    return f"(case when ({c}) <= 0.0031308 then greatest({c}, 0.0) * 12.92 else 1.055 * pow({c}, 1.0 / 2.4) - 0.055 end)"


def smoothstep(low: str, high: str, x: str) -> str:
    """Hermite step; equal edges are a hard step."""
    t = clamp(f"(({x}) - ({low})) / nullif(({high}) - ({low}), 0.0)")
    return f"coalesce({t} * {t} * (3.0 - 2.0 * {t}), case when ({x}) >= ({low}) then 1.0 else 0.0 end)"


def luminance(r="r", g="g", b="b") -> str:
    return f"({LUMA[0]} * ({r}) + {LUMA[1]} * ({g}) + {LUMA[2]} * ({b}))"


def lightness(r="r", g="g", b="b") -> str:
    return f"cbrt(greatest({luminance(r, g, b)}, 0.0))"


def _rows(m, v) -> list[str]:
    return ["(" + " + ".join(f"({num(k)}) * ({x})" for k, x in zip(row, v, strict=True)) + ")" for row in m]


def oklab(rel, names=("lab_l", "lab_a", "lab_b"), of=RGB):
    """Adds the OKLab coordinates of three linear columns."""
    lms = _rows(TO_LMS, [f"greatest({c}, 0.0)" for c in of])
    rel = rel.let(**{f"lms{i}": f"cbrt({v})" for i, v in enumerate(lms)})
    return rel.let(**dict(zip(names, _rows(TO_LAB, ["lms0", "lms1", "lms2"]), strict=True))).drop("lms0", "lms1", "lms2")


def from_oklab(rel, lab, names=RGB, low="0.0", high=None):
    """Sets linear columns from OKLab expressions, bounded below and, if given, above."""
    rel = rel.let(**{f"lms{i}": v for i, v in enumerate(_rows(FROM_LAB, lab))})
    light = _rows(FROM_LMS, [f"(lms{i} * lms{i} * lms{i})" for i in range(3)])
    bounded = [clamp(v, low, high) if high else f"greatest({v}, {low})" for v in light]
    return rel.let(**dict(zip(names, bounded, strict=True))).drop("lms0", "lms1", "lms2")


# ------------------------------------------------------------------ constants


def decode_value(c: float) -> float:
    return c / 12.92 if c <= 0.040448237 else ((c + 0.055) / 1.055) ** 2.4


def oklab_value(rgb) -> tuple[float, float, float]:
    lms = [math.cbrt(sum(k * max(v, 0.0) for k, v in zip(row, rgb, strict=True))) for row in TO_LMS]
    return tuple(sum(k * v for k, v in zip(row, lms, strict=True)) for row in TO_LAB)


def luminance_value(rgb) -> float:
    return sum(k * v for k, v in zip(LUMA, rgb, strict=True))


def from_oklab_value(lab) -> tuple[float, float, float]:
    lms = [sum(k * v for k, v in zip(row, lab, strict=True)) ** 3 for row in FROM_LAB]
    return tuple(sum(k * v for k, v in zip(row, lms, strict=True)) for row in FROM_LMS)


def oklch_value(lightness_: float, chroma: float, degrees: float) -> tuple[float, float, float]:
    return lightness_, chroma * math.cos(math.radians(degrees)), chroma * math.sin(math.radians(degrees))
