"""Palettes: constants, matching, candidate pairs, sorting, ramps."""

from __future__ import annotations

from dataclasses import dataclass

from pixelmill.functions import color
from pixelmill.plans.rel import num

#: Built-in palettes, sRGB; fixed values.
BUILT_IN = {
    "mono": "000000 FFFFFF",
    "mac-1bit": "000000 FFFFFF",
    "gameboy-dmg": "081820 346856 88C070 E0F8D0",
    "gameboy-pocket": "000000 555555 AAAAAA FFFFFF",
    "cga-16": "000000 0000AA 00AA00 00AAAA AA0000 AA00AA AA5500 AAAAAA 555555 5555FF 55FF55 55FFFF FF5555 FF55FF FFFF55 FFFFFF",
    "cga-0-low": "000000 00AA00 AA0000 AA5500",
    "cga-0-high": "000000 55FF55 FF5555 FFFF55",
    "cga-1-low": "000000 00AAAA AA00AA AAAAAA",
    "cga-1-high": "000000 55FFFF FF55FF FFFFFF",
    "cga-mode-5": "000000 00AAAA AA0000 AAAAAA",
    "ega-16": "000000 0000AA 00AA00 00AAAA AA0000 AA00AA AA5500 AAAAAA 555555 5555FF 55FF55 55FFFF FF5555 FF55FF FFFF55 FFFFFF",
    "c64": "000000 FFFFFF 68372B 70A4B2 6F3D86 588D43 352879 B8C76F 6F4F25 433900 9A6759 444444 6C6C6C 9AD284 6C5EB5 959595",
    "zx-spectrum": "000000 0000D7 D70000 D700D7 00D700 00D7D7 D7D700 D7D7D7 0000FF FF0000 FF00FF 00FF00 00FFFF FFFF00 FFFFFF",
    "pico-8": "000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA",
    "teletext": "000000 FF0000 00FF00 FFFF00 0000FF FF00FF 00FFFF FFFFFF",
}


@dataclass(frozen=True)
class Palette:
    colors: tuple[tuple[int, int, int], ...]
    metric: str = "oklab"

    @classmethod
    def of(cls, name: str, metric: str = "oklab") -> Palette:
        return cls(tuple(tuple(bytes.fromhex(c)) for c in BUILT_IN[name].split()), metric)

    @property
    def linear(self):
        return [tuple(color.decode_value(v / 255) for v in c) for c in self.colors]

    @property
    def match(self):
        return [color.oklab_value(c) if self.metric == "oklab" else tuple(v / 255 for v in b) for c, b in zip(self.linear, self.colors, strict=True)]

    def sort_order(self, by: str, population: list[int] | None = None) -> list[int]:
        lab = [color.oklab_value(c) for c in self.linear]
        import math

        if by == "hue":
            keys = [(math.atan2(b, a) % (2 * math.pi), light, i) for i, (light, a, b) in enumerate(lab)]
        elif by == "luminance":
            keys = [(light, i) for i, (light, _, _) in enumerate(lab)]
        else:
            keys = [(-population[i], i) for i in range(len(lab))]
        return [k[-1] for k in sorted(keys)]

    def reordered(self, order: list[int]) -> tuple[Palette, list[int]]:
        """(palette, where each old index went)."""
        inverse = [0] * len(order)
        for new, old in enumerate(order):
            inverse[old] = new
        return Palette(tuple(self.colors[i] for i in order), self.metric), inverse

    @classmethod
    def ramp(cls, first, last, steps: int) -> Palette:
        """Evenly spaced in OKLab, ends exact."""
        def lin(c):
            return tuple(color.decode_value(v / 255) for v in c)

        a, b = color.oklab_value(lin(first)), color.oklab_value(lin(last))
        out = []
        if steps < 2:
            return cls((tuple(first),))
        for k in range(steps):
            t = k / (steps - 1)
            rgb = color.from_oklab_value([p + (q - p) * t for p, q in zip(a, b, strict=True)])
            enc = [12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055 for v in (min(max(v, 0.0), 1.0) for v in rgb)]
            out.append(tuple(round(255 * v) for v in enc))
        return cls((tuple(first), *out[1:-1], tuple(last)))


def pick(idx: str, values) -> str:
    """The constant at a column's index."""
    arms = " ".join(f"when {i} then {num(v)}" for i, v in enumerate(values))
    return f"(case {idx} {arms} end)"


def match_columns(rel, palette: Palette, of=color.RGB):
    if palette.metric == "oklab":
        return color.oklab(rel, ("m0", "m1", "m2"), of)
    return rel.let(**{f"m{i}": color.encode(c) for i, c in enumerate(of)})


def _distances(rel, palette: Palette, of):
    rel = match_columns(rel, palette, of)
    d = {}
    for i, m in enumerate(palette.match):
        d[f"d{i}"] = " + ".join(f"(m{k} - ({num(v)})) * (m{k} - ({num(v)}))" for k, v in enumerate(m))
    return rel.let(**d).drop("m0", "m1", "m2"), list(d)


def _first_least(names, values, least) -> str:
    arms = " ".join(f"when {v} <= {least} then {i}" for i, v in zip(names, values, strict=True))
    return f"coalesce(case {arms} end, 0)"  # never null: a null check on it would repeat its whole formula


def nearest(rel, palette: Palette, of=color.RGB, name="idx"):
    """The index of the nearest entry; the lowest of equals."""
    rel, d = _distances(rel, palette, of)
    least = f"least({', '.join(d)})" if len(d) > 1 else d[0]
    return rel.let(dmin=least).let(**{name: _first_least(range(len(d)), d, "dmin")}).drop("dmin", *d)


def candidate_pair(rel, palette: Palette, of=color.RGB):
    """Columns lo and hi: the two nearest entries, darker first, then f: where the colour lies between them."""
    n = len(palette.colors)
    rel, d = _distances(rel, palette, of)
    if n == 1:
        return rel.let(lo="0", hi="0", f=num(0)).drop(*d)
    rel = rel.let(dmin=f"least({', '.join(d)})").let(first=_first_least(range(n), d, "dmin"))
    rest = [f"(case when first = {i} then 1e30 else d{i} end)" for i in range(n)]
    rel = rel.let(dnext=f"least({', '.join(rest)})").let(second=_first_least(range(n), rest, "dnext"))
    lum = [color.luminance_value(c) for c in palette.linear]
    rank = {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(lum)))}
    ranks = [rank[i] for i in range(n)]
    swap = f"{pick('second', ranks)} < {pick('first', ranks)}"
    rel = rel.let(lo=f"case when {swap} then second else first end", hi=f"case when {swap} then first else second end")
    rel = rel.drop("dmin", "dnext", "first", "second", *d)
    at = {c: (pick("lo", [v[k] for v in palette.linear]), pick("hi", [v[k] for v in palette.linear])) for k, c in enumerate("rgb")}
    rel = rel.let(**{f"e{k}": v for k, (v, _) in at.items()}, **{f"x{k}": f"{v} - {u}" for k, (u, v) in at.items()})
    rel = rel.let(len2="xr * xr + xg * xg + xb * xb")
    dot = " + ".join(f"({c} - e{k}) * x{k}" for c, k in zip(of, "rgb", strict=True))
    rel = rel.let(f=f"case when len2 > 1e-12 then {color.clamp(f'({dot}) / len2')} else 0.0 end")
    return rel.drop("er", "eg", "eb", "xr", "xg", "xb", "len2")


def paint(rel, palette: Palette, idx: str):
    """Sets idx and the colour of that entry."""
    rel = rel.let(idx=f"cast({idx} as int)")
    return rel.let(**{c: pick("idx", [v[k] for v in palette.linear]) for k, c in enumerate("rgb")})


def merge_locked(rel, previous: list[tuple[int, bool]], most: int = 256):
    """(image_id, position, code, population, locked): extracted colours placed around the locked swatches of a palette.

    rel: (image_id, place, code, population), places from 0 and below ``most``. previous: (code, locked) in order. Locked
    swatches keep their positions and lose their populations; extracted colours take the others in order. Where they do
    not reach, the palette shrinks: positions close up, nothing is padded.
    """
    d = rel.d
    held = [(k, code) for k, (code, locked) in enumerate(previous) if locked]
    taken = {k for k, _ in held}
    free = [k for k in range(len(previous) + most) if k not in taken][:most]
    columns = ("image_id", "position", "code", "population", "locked")
    out = rel.let(position=f"cast({d.at(d.array(free), 'place')} as bigint)", locked="false").keep(*columns)
    if held:
        own = rel.group(["image_id"], n="count(*)").explode("k", d.ints(0, len(held) - 1))
        at = {"position": [k for k, _ in held], "code": [c for _, c in held]}
        own = own.let(**{c: f"cast({d.at(d.array(v), 'k')} as bigint)" for c, v in at.items()}, population="cast(null as bigint)", locked="true")
        out = out.union(own.keep(*columns))
    return out.let(position="cast(row_number() over (partition by image_id order by position) - 1 as bigint)")
