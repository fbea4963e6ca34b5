"""Sources: noise fields, gradients and shapes painted on a blank canvas."""

from __future__ import annotations

import math

from pixelmill.functions import hashing
from pixelmill.functions.color import RGB, clamp, decode, fract, mix, smoothstep
from pixelmill.operators.pointwise import TAU, done, from_lut, monotone_lut
from pixelmill.operators.registry import effect
from pixelmill.plans.rel import SparkRel, num, whole

#: Amplitudes and salts of the noise kinds; fixed values.
PERLIN_SCALE, SIMPLEX_SCALE, WORLEY_SCALE = 0.9, 32.0, 1.1
OCTAVE_SALT = 0x6A09E667


def _cell_hash(rel, cell, seed):
    return hashing.chain(rel, *cell, str(seed))


def _gradient(d, h, v) -> str:
    """One of twelve edge directions, by the low four bits of a hash."""
    bits = f"({h} & 15)"
    x, y, z = v
    u = f"(case when {bits} < 8 then {x} else {y} end)"
    w = f"(case when {bits} < 4 then {y} when {bits} in (12, 14) then {x} else {z} end)"
    return f"((case when {h} % 2 = 0 then {u} else -{u} end) + (case when ({h} & 2) = 0 then {w} else -{w} end))"


def _lattice(rel, kind, seed):
    """Value or Perlin noise at (qx, qy, qz)."""
    rel = rel.let(**{f"i{c}": whole(f"q{c}") for c in "xyz"})
    rel = rel.let(**{f"f{c}": f"q{c} - i{c}" for c in "xyz"})
    ease = (lambda f: f"{f} * {f} * (3.0 - 2.0 * {f})") if kind == "value" else (lambda f: f"{f} * {f} * {f} * ({f} * ({f} * 6.0 - 15.0) + 10.0)")
    rel = rel.let(**{f"w{c}": ease(f"f{c}") for c in "xyz"})
    corner = {}
    for k in range(8):
        o = (k & 1, k >> 1 & 1, k >> 2)
        rel, h = _cell_hash(rel, [f"(i{c} + {n})" for c, n in zip("xyz", o, strict=True)], seed)
        if kind == "value":
            rel = rel.let(**{f"k{k}": hashing.unit(rel.d, h)})
        else:
            rel = rel.let(**{f"k{k}": _gradient(rel.d, h, [f"(f{c} - {n})" for c, n in zip("xyz", o, strict=True)])})
        corner[k] = f"k{k}"
    for axis, n in (("x", 4), ("y", 2), ("z", 1)):
        corner = {k: mix(corner[2 * k], corner[2 * k + 1], f"w{axis}") for k in range(n)}
    v = corner[0]
    return rel, v if kind == "value" else clamp(f"({v}) * {num(PERLIN_SCALE / 2)} + 0.5")


def _simplex(rel, seed):
    rel = rel.let(skew="(qx + qy + qz) / 3.0")
    rel = rel.let(**{f"i{c}": whole(f"q{c} + skew") for c in "xyz"}).let(un="(ix + iy + iz) / 6.0")
    rel = rel.let(**{f"d{c}": f"q{c} - (i{c} - un)" for c in "xyz"})
    # the walk from corner to corner takes axes in falling order of the offsets; ties: x before y before z
    rel = rel.let(
        rx="(case when dx >= dy then 0 else 1 end) + (case when dx >= dz then 0 else 1 end)",
        ry="(case when dx >= dy then 1 else 0 end) + (case when dy >= dz then 0 else 1 end)",
        rz="(case when dx >= dz then 1 else 0 end) + (case when dy >= dz then 1 else 0 end)",
    )
    total = []
    for step in range(4):
        o = {c: f"(case when r{c} < {step} then 1 else 0 end)" for c in "xyz"}
        off = {c: f"(d{c} - {o[c]} + {num(step / 6)})" for c in "xyz"}
        names = {c: f"o{c}{step}" for c in "xyz"}
        rel = rel.let(**{names[c]: off[c] for c in "xyz"})
        rel, h = _cell_hash(rel, [f"(i{c} + {o[c]})" for c in "xyz"], seed)
        near = f"(0.6 - ({' + '.join(f'{n} * {n}' for n in names.values())}))"
        rel = rel.let(**{f"t{step}": f"case when {near} < 0.0 then 0.0 else pow({near}, 4) * {_gradient(rel.d, h, list(names.values()))} end"})
        total.append(f"t{step}")
    return rel, clamp(f"({' + '.join(total)}) * {num(SIMPLEX_SCALE / 2)} + 0.5")


def _worley(rel, seed, edges):
    rel = rel.let(**{f"i{c}": whole(f"q{c}") for c in "xyz"}).let(**{f"f{c}": f"q{c} - i{c}" for c in "xyz"})
    names = []
    for k in range(27):
        o = (k % 3 - 1, k // 3 % 3 - 1, k // 9 - 1)
        rel, h = _cell_hash(rel, [f"(i{c} + ({n}))" for c, n in zip("xyz", o, strict=True)], seed)
        parts = []
        for c, n, salt in zip("xyz", o, (0, 0x9E3779B9, 0x85EBCA6B), strict=True):
            rel, j = hashing.pcg(rel, rel.d.xor(h, salt))
            rel = rel.let(**{f"g{c}{k}": f"({n}) + {hashing.unit(rel.d, j)} - f{c}"})
            parts.append(f"g{c}{k} * g{c}{k}")
        rel = rel.let(**{f"e{k}": f"sqrt({' + '.join(parts)})"}).drop(*[f"g{c}{k}" for c in "xyz"])
        names.append(f"e{k}")
    rel = rel.let(near=f"least({', '.join(names)})")
    if not edges:
        return rel, clamp(f"near / {num(WORLEY_SCALE)}")
    d = rel.d
    ordered = f"array_sort({d.array(names)})" if d.spark else f"list_sort({d.array(names)})"
    return rel, clamp(f"({d.at(ordered, 1)} - near) / {num(WORLEY_SCALE)}")


@effect(
    "gen-noise",
    "source",
    "kind:enum{value/perlin/simplex/worley/worley-edges}=simplex; scale:float[1,4096]=64; octaves:int[1,8]=4; lacunarity:float[1.01,8]=2; gain:float[0.05,1]=0.5; ridged:bool=false; offsetX:float[-4096,4096]=0; offsetY:float[-4096,4096]=0; evolve:float[-1024,1024]=0; seed:seed=0x5eed",
)
def gen_noise(rel, p, ctx):
    if rel.d.spark:  # the field is the same in every image: computed once for each place
        field = _noise(SparkRel(rel.df.select("x", "y").distinct()), p).keep("x", "y", *RGB, "a")
        return done(rel.drop(*RGB, "a").join(field, ["x", "y"]))
    return done(_noise(rel, p))


def _noise(rel, p):
    """Sets the colours of a noise field at x, y."""
    terms, norm = [], 0.0
    for octave in range(p["octaves"]):
        freq, amp = p["lacunarity"] ** octave, p["gain"] ** octave
        seed = (p["seed"] ^ (octave * OCTAVE_SALT)) & hashing.MASK
        rel = rel.let(
            qx=f"(x + 0.5 + {num(p['offsetX'])}) / {num(p['scale'])} * {num(freq)}",
            qy=f"(y + 0.5 + {num(p['offsetY'])}) / {num(p['scale'])} * {num(freq)}",
            qz=num(p["evolve"] * freq),
        )
        if p["kind"] in ("value", "perlin"):
            rel, n = _lattice(rel, p["kind"], seed)
        elif p["kind"] == "simplex":
            rel, n = _simplex(rel, seed)
        else:
            rel, n = _worley(rel, seed, p["kind"] == "worley-edges")
        rel = rel.let(n=n)
        rel = done_but(rel.let(**{f"oct{octave}": f"{num(amp)} * {'(1.0 - abs(n * 2.0 - 1.0))' if p['ridged'] else 'n'}"}), octave)
        terms.append(f"oct{octave}")
        norm += amp
    return rel.let(tone=clamp(f"({' + '.join(terms)}) / {num(norm)}")).let(**dict.fromkeys(RGB, decode("tone")), a=num(1))


def done_but(rel, octave):
    """Drops what an octave added, but not the octaves' results."""
    kept = {f"oct{k}" for k in range(octave + 1)}
    base = set(done(rel).columns)
    return rel.keep(*[c for c in rel.columns if c in base or c in kept])


@effect(
    "gen-gradient",
    "source",
    "kind:enum{linear/radial/conical}=linear; centerX:float[-1,2]=0.5; centerY:float[-1,2]=0.5; angle:float[-1,1]=0; extent:float[0.01,8]=1; repeats:int[1,64]=1; mirror:bool=true; invert:bool=false; ramp:curve=0,0 1,1",
)
def gen_gradient(rel, p, ctx):
    rel = rel.let(dx=f"x + 0.5 - {num(p['centerX'])} * w", dy=f"y + 0.5 - {num(p['centerY'])} * h", span=f"{num(p['extent'])} * least(w, h)")
    a = TAU * p["angle"]
    t = {
        "linear": f"0.5 + (dx * {num(math.cos(a))} + dy * {num(math.sin(a))}) / span",
        "radial": "sqrt(dx * dx + dy * dy) / span",
        "conical": fract(f"(case when dx * dx + dy * dy < 1e-12 then 0.0 else atan2(dy, dx) end / {num(TAU)} - {num(p['angle'])} + 1.0)"),
    }[p["kind"]]
    rel = rel.let(t=t)
    n = p["repeats"]
    u = clamp("t") if n <= 1 else f"abs({fract(f't * {num(n / 2)}')} * 2.0 - 1.0)" if p["mirror"] else fract(f"(t * {num(n)})")
    rel = rel.let(u=u).let(tone=from_lut(rel.d, monotone_lut(p["ramp"]), "u"))
    return done(rel.let(**dict.fromkeys(RGB, decode("(1.0 - tone)" if p["invert"] else "tone")), a=num(1)))


@effect(
    "gen-shape",
    "source",
    "shape:enum{circle/rectangle/polygon/star}=circle; sides:int[2,24]=5; centerX:float[-1,2]=0.5; centerY:float[-1,2]=0.5; size:float[0,3]=0.6; aspect:float[0.05,20]=1; rotation:float[-1,1]=0; inner:float[0.02,1]=0.382; softness:float[0,2048]=1.5; invert:bool=false",
)
def gen_shape(rel, p, ctx):
    c, s = math.cos(-TAU * p["rotation"]), math.sin(-TAU * p["rotation"])
    rel = rel.let(ux=f"x + 0.5 - {num(p['centerX'])} * w", uy=f"y + 0.5 - {num(p['centerY'])} * h", rad=f"{num(p['size'] / 2)} * least(w, h)")
    rel = rel.let(vx=f"ux * {num(c)} - uy * {num(s)}", vy=f"ux * {num(s)} + uy * {num(c)}", hx=f"rad * {num(p['aspect'])}", hy=f"rad / {num(p['aspect'])}")
    rel = rel.let(len="sqrt(vx * vx + vy * vy)", ang="atan2(vy, vx)")
    n = max(p["sides"], 2 if p["shape"] == "star" else 3)
    seg = TAU / n
    fold = f"(ang - {num(seg)} * {rel.d.rint(f'ang / {num(seg)}')})"
    if p["shape"] == "circle":
        d = "len - hx"
    elif p["shape"] == "rectangle":
        ex, ey = "(abs(vx) - hx)", "(abs(vy) - hy)"
        d = f"sqrt(pow(greatest({ex}, 0.0), 2) + pow(greatest({ey}, 0.0), 2)) + least(greatest({ex}, {ey}), 0.0)"
    elif p["shape"] == "polygon":
        apothem = f"(hx * {num(math.cos(seg / 2))})"
        d = f"case when len < 1e-6 then -{apothem} else len * cos({fold}) - {apothem} end"
    else:
        inner = min(max(p["inner"], 0.001), 1)
        rel = rel.let(fold=f"abs({fold})").let(sx=f"len * cos(fold) - hx", sy="len * sin(fold)")
        rel = rel.let(ex=f"hx * {num(inner * math.cos(seg / 2) - 1)}", ey=f"hx * {num(inner * math.sin(seg / 2))}")
        rel = rel.let(tt=clamp("(sx * ex + sy * ey) / greatest(ex * ex + ey * ey, 1e-12)"))
        away = "sqrt(pow(sx - ex * tt, 2) + pow(sy - ey * tt, 2))"
        d = f"case when len < 1e-6 then -hx * {num(inner)} when ex * sy - ey * sx > 0.0 then -{away} else {away} end"
    soft = max(p["softness"], 1e-4)
    rel = rel.let(dist=d).let(tone=f"1.0 - {smoothstep(num(-soft / 2), num(soft / 2), 'dist')}")
    return done(rel.let(**dict.fromkeys(RGB, decode("(1.0 - tone)" if p["invert"] else "tone")), a=num(1)))
