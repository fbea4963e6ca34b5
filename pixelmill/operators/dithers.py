"""Ordered and pattern dithers: a threshold for each pixel picks one of two candidate colours."""

from __future__ import annotations

import functools
import math

from pixelmill.functions.color import clamp, fract
from pixelmill.functions.color import luminance_value
from pixelmill.operators import palettes
from pixelmill.operators.pointwise import TAU, done
from pixelmill.operators.registry import effect
from pixelmill.plans.rel import num, whole

ORDERED = "thresholdOffset:float[-0.5,0.5]=0; contrast:float[0.05,4]=1; spread:float[0,2]=1; tileScale:float[0.25,64]=1; tileRotation:float[-1,1]=0; offsetX:float[-1024,1024]=0; offsetY:float[-1024,1024]=0"


def bayer_ranks(size: int) -> list[int]:
    """Row-major ranks of the recursive matrix."""
    m = [[0]]
    while len(m) < size:
        m = [[4 * v + a for a in pair for v in row] for pair in ((0, 2), (3, 1)) for row in m]
    return [v for row in m for v in row]


class Pcg32:
    """PCG32 XSH-RR with a named stream."""

    def __init__(self, seed: int, stream: int):
        self.inc = (stream << 1 | 1) & (2**64 - 1)
        self.state = 0
        self.next_u32()
        self.state = (self.state + seed) & (2**64 - 1)
        self.next_u32()

    def skip(self, n: int) -> Pcg32:
        """Past ``n`` draws: the step applied n times, by squaring."""
        times, plus, step, add = 1, 0, 6364136223846793005, self.inc
        while n:
            if n & 1:
                times, plus = times * step, plus * step + add
            step, add, n = step * step % 2**64, (step + 1) * add % 2**64, n >> 1
        self.state = (self.state * times + plus) % 2**64
        return self

    def next_u32(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.inc) & (2**64 - 1)
        x = ((old >> 18) ^ old) >> 27 & 0xFFFFFFFF
        r = old >> 59
        return (x >> r | x << (-r & 31)) & 0xFFFFFFFF

    def next_f32(self) -> float:
        return (self.next_u32() >> 8) * 2.0**-24

    def next_below(self, n: int) -> int:
        least = (2**32 - n) % n
        while (v := self.next_u32()) < least:
            pass
        return v % n


def stream_of(name: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


@functools.cache
def blue_noise_ranks(size: int = 64, seed: int = 0x5EED0D17) -> tuple[int, ...]:
    """Ranks by void and cluster on a torus, sigma 1.5, a tenth set at first."""
    import numpy as np

    n = size * size
    rng = Pcg32(seed, stream_of("noise/blue-noise"))
    tie = np.array([rng.next_u32() for _ in range(n)], np.int64)
    axis = np.minimum(np.arange(size), size - np.arange(size))
    kernel = np.exp(-(axis[:, None] ** 2 + axis[None, :] ** 2) / (2 * 1.5**2))
    energy, on = np.zeros((size, size)), np.zeros(n, bool)

    def put(i, value):
        nonlocal energy
        on[i] = value
        energy += (1 if value else -1) * np.roll(kernel, (i // size, i % size), (0, 1))

    def extreme(cluster):
        e = energy.ravel()
        own = np.flatnonzero(on if cluster else ~on)
        best = e[own].max() if cluster else e[own].min()
        ties = own[np.abs(e[own] - best) < 1e-12]
        return int(ties[tie[ties].argmin()])

    first = max(n // 10, 1)
    while on.sum() < first:
        i = rng.next_below(n)
        if not on[i]:
            put(i, True)
    while True:
        c = extreme(True)
        put(c, False)
        v = extreme(False)
        put(v, True)
        if v == c:
            break
    rank, kept, kept_energy = np.zeros(n, int), on.copy(), energy.copy()
    for r in reversed(range(first)):
        c = extreme(True)
        put(c, False)
        rank[c] = r
    on[:], energy = kept, kept_energy
    for r in range(first, n):
        v = extreme(False)
        put(v, True)
        rank[v] = r
    return tuple(rank.tolist())


@functools.cache
def clustered_ranks(cell: int, diagonal: bool) -> tuple[int, tuple[int, ...]]:
    """(tile side, ranks): dots grow from centres a cell apart, orthogonal or turned by 45 degrees."""
    tile = 2 * cell if diagonal else cell
    centres = [(cell / 2, cell / 2), (1.5 * cell, 1.5 * cell)] if diagonal else [(cell / 2, cell / 2)]
    cells = []
    for y in range(tile):
        for x in range(tile):
            near = []
            for k, (cx, cy) in enumerate(centres):
                for oy in (-tile, 0, tile):
                    for ox in (-tile, 0, tile):
                        dx, dy = x + 0.5 - cx - ox, y + 0.5 - cy - oy
                        near.append((dx * dx + dy * dy, k, dx, dy))
            d2, k, dx, dy = min(near)
            cells.append((d2, math.atan2(dy, dx) % TAU, k, y, x))
    ranks = [0] * (tile * tile)
    for r, (_, _, _, y, x) in enumerate(sorted(cells)):
        ranks[y * tile + x] = r
    return tile, tuple(ranks)


def wrapped(v: str, n: int) -> str:
    return f"(({whole(v)} % {n} + {n}) % {n})"


def decide(rel, palette, decision: str):
    """Paints the darker or, where the decision is above 0, the lighter candidate."""
    return done(palettes.paint(rel, palette, f"case when {decision} > 0.0 then hi else lo end"))


def by_threshold(rel, p, palette, t: str):
    """The ordered rule: f against a shaped threshold."""
    rel = palettes.candidate_pair(rel.let(t=t), palette)
    shaped = clamp(f"0.5 + (t - 0.5) * {num(p['contrast'])}")
    return decide(rel, palette, f"(f - 0.5) + ({shaped} - 0.5) * {num(p['spread'])} + {num(p['thresholdOffset'])}")


def tile_place(rel, p):
    """Columns qx, qy: a pixel's place in the rotated, scaled tile plane."""
    c, s = math.cos(TAU * p["tileRotation"]), math.sin(TAU * p["tileRotation"])
    scale = num(max(p["tileScale"], 2**-10))
    dx, dy = "(x + 0.5 - w / 2.0)", "(y + 0.5 - h / 2.0)"
    return rel.let(
        qx=f"({dx} * {num(c)} - {dy} * {num(s)}) / {scale} + {num(p['offsetX'])}",
        qy=f"({dx} * {num(s)} + {dy} * {num(c)}) / {scale} + {num(p['offsetY'])}",
    )


def _bayer(size):
    @effect(f"bayer-{size}", "dither", ORDERED, produces_index=True)
    def run(rel, p, ctx):
        rel = tile_place(rel, p)
        rank = rel.d.at(rel.d.array(bayer_ranks(size)), f"{wrapped('qy', size)} * {size} + {wrapped('qx', size)}")
        return by_threshold(rel, p, ctx.palette, f"({rank} + 0.5) / {num(size * size)}")


for _size in (2, 4, 8, 16):
    _bayer(_size)


@effect("blue-noise", "dither", ORDERED, produces_index=True)
def blue_noise(rel, p, ctx):
    ranks = blue_noise_ranks()
    rel = tile_place(rel, p).let(tx=wrapped("qx", 64), ty=wrapped("qy", 64))
    tile = ctx.src.values(["tx", "ty", "rank"], [(i % 64, i // 64, r) for i, r in enumerate(ranks)])  # 4096 rows
    return by_threshold(rel.join(tile, ["tx", "ty"]), p, ctx.palette, "(rank + 0.5) / 4096.0")


@effect("threshold-map", "dither", ORDERED, produces_index=True, needs=("tile",))
def threshold_map(rel, p, ctx):
    """ctx.tile: (tx, ty, value) of ctx.tile_size: the user's image as 8-bit luminance over 255."""
    tw, th = ctx.tile_size
    rel = tile_place(rel, p).let(tx=wrapped("qx", tw), ty=wrapped("qy", th))
    return by_threshold(rel.join(ctx.tile, ["tx", "ty"]), p, ctx.palette, "value")


# ------------------------------------------------------------------- screens


def _arc(x: str, c: str) -> str:
    u = f"least(greatest({x}, 0.0), {c})"
    return f"(0.5 * ({u} * sqrt(greatest({c} * {c} - {u} * {u}, 0.0)) + {c} * {c} * asin({clamp(f'{u} / {c}')})))"


def dot_area(rel, shape: str, aspect: float, x: str, y: str, name: str):
    """The share of a cell that a dot reaching (x, y) covers; (x, y) within half a cell of the centre."""
    rel = rel.let(lx=x, ly=y)
    if shape == "square":
        return rel.let(**{name: clamp("4.0 * pow(greatest(abs(lx), abs(ly)), 2)")}).drop("lx", "ly")
    if shape == "diamond":
        s = clamp("abs(lx) + abs(ly)")
        return rel.let(**{name: clamp(f"2.0 * pow({s}, 2) - 4.0 * pow(greatest({s} - 0.5, 0.0), 2)")}).drop("lx", "ly")
    k = max(aspect, 2**-5) if shape == "ellipse" else 1.0
    a, b = num(k / 2), num(0.5 / k)
    rel = rel.let(c=f"sqrt(pow(lx * {num(k)}, 2) + pow(ly / {num(k)}, 2))").let(c=f"case when c <= 0.0 then 1e-12 else c end")
    rel = rel.let(xm=f"least({a}, c)").let(xf=f"least(sqrt(greatest(c * c - {b} * {b}, 0.0)), xm)")
    return rel.let(**{name: clamp(f"4.0 * ({b} * xf + ({_arc('xm', 'c')} - {_arc('xf', 'c')}))")}).drop("lx", "ly", "c", "xm", "xf")


def screen(rel, angle, cell, shape, aspect, name, ox=0.0, oy=0.0):
    a = math.radians(angle)
    dx, dy, size = "(x + 0.5 - w / 2.0)", "(y + 0.5 - h / 2.0)", num(max(cell, 2**-5))
    rel = rel.let(
        u=f"({dx} * {num(math.cos(a))} + {dy} * {num(math.sin(a))}) / {size} + {num(ox)}",
        v=f"(-{dx} * {num(math.sin(a))} + {dy} * {num(math.cos(a))}) / {size} + {num(oy)}",
    )
    return dot_area(rel, shape, aspect, f"u - {rel.d.rint('u')}", f"v - {rel.d.rint('v')}", name).drop("u", "v")


@effect(
    "halftone",
    "dither",
    "cellSize:float[1,256]=8; angle:float[-180,180]=45; dotShape:enum{round/square/diamond/ellipse}=round; dotAspect:float[0.25,4]=1.6; coverage:float[-0.5,0.5]=0; spread:float[0,2]=1; offsetX:float[-1024,1024]=0; offsetY:float[-1024,1024]=0",
    produces_index=True,
)
def halftone(rel, p, ctx):
    rel = screen(rel, p["angle"], p["cellSize"], p["dotShape"], p["dotAspect"], "t", p["offsetX"], p["offsetY"])
    rel = palettes.candidate_pair(rel, ctx.palette)
    return decide(rel, ctx.palette, f"(0.5 - {clamp(f'1.0 - f + {num(p['coverage'])}')}) + (t - 0.5) * {num(p['spread'])}")


@effect(
    "cmyk-halftone",
    "dither",
    "cyanAngle:float[-180,180]=15; magentaAngle:float[-180,180]=75; yellowAngle:float[-180,180]=0; blackAngle:float[-180,180]=45; cyanCell:float[1,256]=8; magentaCell:float[1,256]=8; yellowCell:float[1,256]=8; blackCell:float[1,256]=8; blackGeneration:float[0,1]=0.5; inkDensity:float[0,1]=1; dotShape:enum{round/square/diamond/ellipse}=round; dotAspect:float[0.25,4]=1.6",
)
def cmyk_halftone(rel, p, ctx):
    for ink in ("cyan", "magenta", "yellow", "black"):
        rel = screen(rel, p[f"{ink}Angle"], p[f"{ink}Cell"], p["dotShape"], p["dotAspect"], f"t_{ink}")
    rel = rel.let(**{f"c{c}": clamp(c) for c in "rgb"})
    rel = rel.let(black=clamp(f"(1.0 - greatest(cr, cg, cb)) * {num(p['blackGeneration'])}"))
    leak = num(min(max(1 - p["inkDensity"], 0), 1))
    key = f"(case when t_black < black then {leak} else 1.0 end)"
    out = {}
    for c, ink in zip("rgb", ("cyan", "magenta", "yellow"), strict=True):
        want = f"(case when 1.0 - black > 1e-6 then {clamp(f'1.0 - c{c} / nullif(1.0 - black, 0.0)')} else 0.0 end)"
        out[c] = f"cast((case when t_{ink} < {want} then {leak} else 1.0 end) * {key} as double)"
    return done(rel.let(**out))


def _line(angle: float, pitch: float, phase: float) -> str:
    a = math.radians(angle)
    across = f"(-(x + 0.5 - w / 2.0) * {num(math.sin(a))} + (y + 0.5 - h / 2.0) * {num(math.cos(a))})"
    return f"(abs({fract(f'({across} / {num(max(pitch, 0.5))} + {num(phase)})')} - 0.5) * 2.0)"


def _by_ink(rel, p, palette, t):
    rel = palettes.candidate_pair(rel.let(t=t), palette)
    ink = clamp(f"(1.0 - f) * {num(p['duty'] / 0.5)}")
    return decide(rel, palette, f"(0.5 - {ink}) + (t - 0.5) * {num(p['spread'])}")


@effect("line-screen", "dither", "pitch:float[1,256]=6; angle:float[-180,180]=45; duty:float[0.05,0.95]=0.5; phase:float[-1024,1024]=0; spread:float[0,2]=1", produces_index=True)
def line_screen(rel, p, ctx):
    return _by_ink(rel, p, ctx.palette, _line(p["angle"], p["pitch"], p["phase"]))


@effect(
    "cross-hatch",
    "dither",
    "layers:int[2,4]=2; pitch:float[1,256]=8; angle:float[-180,180]=45; angleSpread:float[15,180]=180; pitchRatio:float[0.5,2]=1.3; duty:float[0.05,0.95]=0.5; spread:float[0,2]=1",
    produces_index=True,
)
def cross_hatch(rel, p, ctx):
    n = p["layers"]
    lines = [_line(p["angle"] + k * p["angleSpread"] / n, p["pitch"] * p["pitchRatio"] ** k, 0.0) for k in range(n)]
    return _by_ink(rel, p, ctx.palette, clamp(f"1.0 - pow(greatest(1.0 - least({', '.join(lines)}), 0.0), {n})"))


def _saw(cycles: str) -> str:
    return f"(1.0 - abs(2.0 * {fract(f'({cycles})')} - 1.0))"


RINGS = "contrast:float[0.05,4]=1; spread:float[0,2]=1; thresholdOffset:float[-0.5,0.5]=0"


@effect("concentric-rings", "dither", f"centreX:float[-1,2]=0.5; centreY:float[-1,2]=0.5; pitch:float[0.5,512]=8; phase:float[-1,1]=0; {RINGS}", produces_index=True)
def concentric_rings(rel, p, ctx):
    rel = rel.let(dx=f"x + 0.5 - {num(p['centreX'])} * w", dy=f"y + 0.5 - {num(p['centreY'])} * h")
    return by_threshold(rel, p, ctx.palette, _saw(f"sqrt(dx * dx + dy * dy) / {num(p['pitch'])} + {num(p['phase'])}"))


@effect("spiral", "dither", f"centreX:float[-1,2]=0.5; centreY:float[-1,2]=0.5; pitch:float[0.5,512]=8; twist:int[-12,12]=1; rotation:float[-1,1]=0; {RINGS}", produces_index=True)
def spiral(rel, p, ctx):
    rel = rel.let(dx=f"x + 0.5 - {num(p['centreX'])} * w", dy=f"y + 0.5 - {num(p['centreY'])} * h")
    turns = f"(atan2(dy, dx) / {num(TAU)} + {num(p['rotation'])})"
    return by_threshold(rel, p, ctx.palette, _saw(f"sqrt(dx * dx + dy * dy) / {num(p['pitch'])} - {num(p['twist'])} * {turns}"))


@effect("clustered-dot", "dither", f"cellSize:int[2,16]=4; angle:enum{{diagonal/orthogonal}}=diagonal; offsetX:float[-1024,1024]=0; offsetY:float[-1024,1024]=0; {RINGS}", produces_index=True)
def clustered_dot(rel, p, ctx):
    tile, ranks = clustered_ranks(p["cellSize"], p["angle"] == "diagonal")
    tx, ty = wrapped(f"x + {num(p['offsetX'])}", tile), wrapped(f"y + {num(p['offsetY'])}", tile)
    rank = rel.d.at(rel.d.array(ranks), f"{ty} * {tile} + {tx}")
    return by_threshold(rel, p, ctx.palette, f"({rank} + 0.5) / {num(tile * tile)}")


#: Glyph bitmaps of 8 rows from sparse to dense; drawn here, not taken from a font.
GLYPHS = {
    "block": ["00" * 8, "8800220088002200", "AA55AA55AA55AA55", "77DD77DD77DD77DD", "FF" * 8],
    "ascii": ["00" * 8, "0000000000181800", "0000183C3C180000", "00667E18187E6600", "3C66C3DBDBC3663C", "FFDBFFE7E7FFDBFF", "FF" * 8],
}


@effect(
    "glyph-tile",
    "dither",
    "glyphSet:enum{ascii/block}=ascii; cellSize:int[4,16]=8; invert:bool=false; offsetX:float[-1024,1024]=0; offsetY:float[-1024,1024]=0; contrast:float[0.05,4]=1; thresholdOffset:float[-0.5,0.5]=0",
    access="neighbourhood",
    produces_index=True,
)
def glyph_tile(rel, p, ctx):
    """Each cell's mean picks the glyph whose coverage is nearest to the wanted one (ties: the sparser)."""
    cs, ox, oy = p["cellSize"], math.floor(p["offsetX"]), math.floor(p["offsetY"])
    rel = rel.let(cx=whole(f"(x - ({ox})) / {num(cs)}"), cy=whole(f"(y - ({oy})) / {num(cs)}"))
    cell_of = [c for c in ("image_id", "frame", "cx", "cy") if c in rel.columns]
    cell = rel.group(cell_of, mr="avg(r)", mg="avg(g)", mb="avg(b)")
    cell = palettes.candidate_pair(cell, ctx.palette, ("mr", "mg", "mb"))
    shaped = clamp(f"0.5 + (f - 0.5) * {num(p['contrast'])} + {num(p['thresholdOffset'])}")
    glyphs = [bytes.fromhex(g) for g in GLYPHS[p["glyphSet"]]]
    cover = [sum(b.bit_count() for b in g) / 64 for g in glyphs]
    cell = cell.let(want=shaped if p["invert"] else f"1.0 - {shaped}").let(**{f"g{k}": f"abs({num(c)} - want)" for k, c in enumerate(cover)})
    names = [f"g{k}" for k in range(len(cover))]
    cell = cell.let(best=f"least({', '.join(names)})").let(glyph="(case " + " ".join(f"when {n} <= best then {k}" for k, n in enumerate(names)) + " end)")
    cell = cell.keep(*cell_of, "lo", "hi", "glyph")
    rel = rel.join(cell, cell_of)
    rel = rel.let(gx=rel.d.div(f"(x - ({ox}) - cx * {cs}) * 8", cs), gy=rel.d.div(f"(y - ({oy}) - cy * {cs}) * 8", cs))
    bits = rel.d.array([b >> k & 1 for g in glyphs for b in g for k in range(8)])
    on = f"{rel.d.at(bits, 'glyph * 64 + gy * 8 + gx')} = 1"
    ink, paper = ("hi", "lo") if p["invert"] else ("lo", "hi")
    return done(palettes.paint(rel, ctx.palette, f"case when {on} then {ink} else {paper} end"))


def lightest_darkest(palette) -> tuple[int, int]:
    y = [luminance_value(c) for c in palette.linear]
    return max(range(len(y)), key=lambda i: (y[i], -i)), min(range(len(y)), key=lambda i: (y[i], i))
