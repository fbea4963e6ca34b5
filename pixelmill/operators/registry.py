"""The effect registry: declared parameters, checks, and the function of each effect."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

_SPEC = re.compile(r"(\w+):(\w+)(?:\[([^\]]*)\]|\{([^}]*)\})?=(.*)")


@dataclass(frozen=True)
class Param:
    key: str
    kind: str  # float, int, bool, enum, seed, curve
    low: float | None
    high: float | None
    choices: tuple[str, ...]
    default: object


def _value(kind: str, text: str):
    if kind in ("int", "seed"):
        return int(text, 0)
    if kind == "float":
        return float(text)
    if kind == "bool":
        return text == "true"
    if kind == "curve":
        return [tuple(map(float, p.split(","))) for p in text.split(" ")]
    return text


def parse(spec: str) -> dict[str, Param]:
    """``key:kind[low,high]=default`` or ``key:enum{a/b}=a``, separated by semicolons."""
    out = {}
    for part in filter(None, (s.strip() for s in spec.split(";"))):
        key, kind, bounds, choices, default = _SPEC.fullmatch(part).groups()
        low, high = map(float, bounds.split(",")) if bounds else (None, None)
        out[key] = Param(key, kind, low, high, tuple(choices.split("/")) if choices else (), _value(kind, default))
    return out


@dataclass(frozen=True)
class Effect:
    id: str
    slot: str
    params: dict[str, Param]
    run: Callable
    access: str = "pointwise"  # pointwise, neighbourhood, global, serial
    produces_index: bool = False
    requires_index: bool = False
    resamples: bool = False
    needs: tuple[str, ...] = field(default=())


EFFECTS: dict[str, Effect] = {}


def effect(id: str, slot: str, spec: str = "", **flags):
    """Registers ``run(rel, p, ctx) -> rel`` under an id."""

    def add(run):
        EFFECTS[id] = Effect(id, slot, parse(spec), run, **flags)
        return run

    return add


def problems(effect_id: str, given: dict) -> list[tuple[str, str]]:
    """(code, key) of everything wrong with the parameters."""
    e = EFFECTS.get(effect_id)
    if e is None:
        return [("unknown-effect", effect_id)]
    out = [("unknown-param", k) for k in given if k not in e.params]
    for k, v in given.items():
        p = e.params.get(k)
        if p is None:
            continue
        if p.kind == "bool":
            ok = isinstance(v, bool)
        elif p.kind == "enum":
            ok = v in p.choices
        elif p.kind == "curve":
            ok = isinstance(v, list) and len(v) >= 2 and all(a[0] < b[0] for a, b in zip(v, v[1:], strict=False))
        elif p.kind == "seed":
            ok = isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 2**32
        else:
            ok = isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and (p.kind == "float" or v == int(v))
        if not ok:
            out.append(("wrong-type", k))
        elif p.low is not None and not p.low <= v <= p.high:
            out.append(("out-of-range", k))
    return out


def coerce(effect_id: str, given: dict) -> dict:
    """Defaults for what is missing or of a wrong kind; numbers into their legal range; unknown keys dropped."""
    bad = dict((k, code) for code, k in problems(effect_id, given))
    out = {}
    for k, p in EFFECTS[effect_id].params.items():
        v = given.get(k, p.default)
        if bad.get(k) == "wrong-type":
            v = round(v) if p.kind == "int" and isinstance(v, float) and v == v else p.default
        if p.low is not None:
            v = min(max(v, p.low), p.high)
            v = int(v) if p.kind == "int" else v
        out[k] = v
    return out


def apply(rel, effect_id: str, params: dict | None = None, ctx=None):
    """Runs one effect; parameters are checked first."""
    given = params or {}
    if wrong := problems(effect_id, given):
        raise ValueError(f"{effect_id}: {wrong}")
    e = EFFECTS[effect_id]
    return e.run(rel, {k: p.default for k, p in e.params.items()} | given, ctx)
