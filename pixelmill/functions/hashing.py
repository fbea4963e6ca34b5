"""32-bit hash families over BIGINT columns.

Each function adds columns, so that a value used several times is computed once.
Both engines check BIGINT overflow; a product with a constant of 2**31 or more is
taken with the constant minus 2**32, which is the same modulo 2**32 and fits.
"""

from __future__ import annotations

import itertools

MASK = 4294967295
_names = itertools.count()


def _name() -> str:
    return f"h{next(_names)}"


def times(x: str, c: int) -> str:
    return f"((({x}) * ({c - 2**32 if c >= 2**31 else c})) & {MASK})"


def u32(x: str) -> str:
    return f"(({x}) & {MASK})"


def pcg(rel, x: str) -> tuple:
    """(rel, column): the PCG-RXS-M-XS step of a 32-bit value."""
    d, state, word = rel.d, _name(), _name()
    rel = rel.let(**{state: u32(f"{times(x, 747796405)} + 2891336453")})
    # shifts by 4 to 19 places: the top four bits choose
    shift = f"({d.div(state, 2**28)} + 4)"
    moved = f"shiftright({state}, cast({shift} as int))" if d.spark else f"({state} >> cast({shift} as int))"
    rel = rel.let(**{word: times(d.xor(moved, state), 277803737)})
    out = _name()
    return rel.let(**{out: d.xor(d.div(word, 2**22), word)}).drop(state, word), out


def chain(rel, *parts: str) -> tuple:
    """H1L: pcg(pcg(pcg(a) ^ b) ^ c) ..."""
    rel, h = pcg(rel, u32(parts[0]))
    for p in parts[1:]:
        rel, h = pcg(rel, rel.d.xor(h, u32(p)))
    return rel, h


def nest(rel, *parts: str) -> tuple:
    """H1: pcg(a ^ pcg(b ^ pcg(c))) ..."""
    rel, h = pcg(rel, u32(parts[-1]))
    for p in reversed(parts[:-1]):
        rel, h = pcg(rel, rel.d.xor(u32(p), h))
    return rel, h


def multiplied(rel, a: str, b: str) -> tuple:
    """H2: pcg(a ^ b * 0x9e3779b9)."""
    return pcg(rel, rel.d.xor(u32(a), times(u32(b), 0x9E3779B9)))


def unit(d, h: str) -> str:
    """The top 24 bits as a number in [0, 1)."""
    return f"({d.div(h, 256)} * cast(5.9604644775390625e-8 as double))"


def lowbias(rel, x: str) -> tuple:
    """H3: xor-shift multiply with 0x7feb352d and 0x846ca68b."""
    d, a, b, c = rel.d, _name(), _name(), _name()
    rel = rel.let(**{a: times(d.xor(u32(x), d.div(u32(x), 65536)), 0x7FEB352D)})
    rel = rel.let(**{b: times(d.xor(a, d.div(a, 32768)), 0x846CA68B)})
    return rel.let(**{c: d.xor(b, d.div(b, 65536))}).drop(a, b), c


# ------------------------------------------------------------------ constants


def pcg_value(v: int) -> int:
    state = (v * 747796405 + 2891336453) & MASK
    word = (((state >> ((state >> 28) + 4)) ^ state) * 277803737) & MASK
    return (word >> 22) ^ word


def nest_value(*parts: int) -> int:
    h = pcg_value(parts[-1] & MASK)
    for p in reversed(parts[:-1]):
        h = pcg_value((p & MASK) ^ h)
    return h


def multiplied_value(a: int, b: int) -> int:
    return pcg_value((a ^ (b * 0x9E3779B9)) & MASK)


def unit_value(h: int) -> float:
    return (h >> 8) * 2.0**-24
