"""Rasters: (image_id, x, y, w, h, r, g, b, a) rows of linear light, and idx once quantised."""

from __future__ import annotations

from pixelmill.functions.color import clamp, decode_value
from pixelmill.plans.rel import num

PIXEL = ["image_id", "x", "y", "w", "h"]
COLOUR = ["r", "g", "b", "a"]


def emb8(src):
    """One 8x8 colour image for each embedding; its channels read the vector from three places."""
    rel = src.table("embeddings", "vec_id as image_id", "embedding").explode("pos", src.d.ints(0, 63))

    def channel(shift):
        return clamp(f"0.5 + cast({src.d.at('embedding', f'(pos + {shift}) % 64')} as double)")

    rel = rel.let(x="cast(pos % 8 as bigint)", y=f"cast({src.d.div('pos', 8)} as bigint)", w="cast(8 as bigint)", h="cast(8 as bigint)")
    return rel.let(r=channel(0), g=channel(21), b=channel(42), a=num(1)).keep(*PIXEL, *COLOUR)


def blank(src, width: int, height: int, image_id: int = 0):
    """A black canvas; generators paint on it."""
    rel = src.ints("id", width * height)
    rel = rel.let(image_id=f"cast({image_id} as bigint)", x=f"id % {width}", y=src.d.div("id", width), w=f"cast({width} as bigint)", h=f"cast({height} as bigint)")
    return rel.let(r=num(0), g=num(0), b=num(0), a=num(1)).keep(*PIXEL, *COLOUR)


def fixture(src, name: str):
    """The five synthetic test images."""
    sizes = {"linear-ramp": (128, 32), "radial-gradient": (80, 80), "colour-wheel": (81, 81), "hard-edge-chart": (101, 67), "flat-mid-grey": (48, 48)}
    w, h = sizes[name]
    rel = blank(src, w, h)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    if name == "linear-ramp":
        v = f"x / {num(w - 1)}"
        return rel.let(r=v, g=v, b=v)
    if name == "flat-mid-grey":
        v = num(decode_value(128 / 255))
        return rel.let(r=v, g=v, b=v)
    if name == "radial-gradient":
        v = clamp(f"1.0 - sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy})) / sqrt({cx * cx + cy * cy})")
        return rel.let(r=v, g=v, b=v)
    from pixelmill.functions.color import decode

    if name == "colour-wheel":
        rim = min(cx, cy) - 1
        rel = rel.let(dx=f"x - {num(cx)}", dy=f"y - {num(cy)}").let(rad="sqrt(dx * dx + dy * dy)")
        rel = rel.let(hue="(atan2(dy, dx) / (2.0 * pi()) + 0.5) * 6.0", sat=clamp(f"rad / {num(0.9 * rim)}"))

        def channel(shift):  # value 1: 1 - sat * max(0, min(k, 4 - k, 1))
            k = f"(({shift} + hue) - 6.0 * floor(({shift} + hue) / 6.0))"
            return f"case when rad > {num(rim)} then 0.0 else {decode(f'(1.0 - sat * greatest(0.0, least(least({k}, 4.0 - {k}), 1.0)))')} end"

        return rel.let(r=channel("5.0"), g=channel("3.0"), b=channel("1.0")).keep(*PIXEL, *COLOUR)
    # patches in the top half, row by row; fixed values
    patches = ["000000", "FFFFFF", "808080", "FF0000", "00FF00", "0000FF", "00FFFF", "FFFF00"]
    half = h // 2
    rel = rel.let(k=f"case when y < {half} then {src.d.div(f'y * 2', half)} * 4 + {src.d.div('x * 4', w)} else -1 end")
    out = {}
    for c, at in (("r", 0), ("g", 2), ("b", 4)):
        arms = " ".join(f"when k = {i} then {num(decode_value(int(p[at : at + 2], 16) / 255))}" for i, p in enumerate(patches))
        check = f"case when x < {w // 2} then case when (x + y) % 2 = 0 then 1.0 else 0.0 end else case when y % 3 = 0 then 1.0 else 0.0 end end"
        out[c] = f"cast(case {arms} else {check} end as double)"
    return rel.let(**out).keep(*PIXEL, *COLOUR)


def li_rgb(src):
    """lineitem as colour strips: an image for each order, its lines side by side in a total order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    rel = src.table("lineitem", "l_orderkey", *order, "l_discount", "l_tax")
    rel = rel.let(
        image_id="l_orderkey",
        x=f"cast(row_number() over (partition by l_orderkey order by {', '.join(order)}) - 1 as bigint)",
        y="cast(0 as bigint)",
        w="cast(count(*) over (partition by l_orderkey) as bigint)",
        h="cast(1 as bigint)",
    )
    return rel.let(r="(l_discount + 0.0) / 0.1", g="(l_tax + 0.0) / 0.08", b="(l_quantity - 1.0) / 49.0", a=num(1)).keep(*PIXEL, *COLOUR)


def ev_time(src, buckets: int = 31):
    """events as a time raster: x is the day of January, y the user, grey the mean value over its range."""
    day = "cast(extract(day from ts) as bigint) - 1"
    rel = src.table("events", "ts", "user_id", "value").let(x=day, y="cast(user_id as bigint)")
    rel = rel.group(["x", "y"], v="avg(value)")
    rel = rel.let(image_id="cast(0 as bigint)", w=f"cast({buckets} as bigint)", h="cast(max(y) over () + 1 as bigint)", v="v / max(v) over ()")
    return rel.let(r="v", g="v", b="v", a=num(1)).keep(*PIXEL, *COLOUR)


def result(rel, *extra: str):
    """Colours rounded to six places, for comparison; -0.0 becomes 0.0."""
    rounded = {c: f"round({c}, 6) + 0.0" for c in COLOUR if c in rel.columns}
    keep = [c for c in ("image_id", "frame", "x", "y", *COLOUR, "idx") if c in rel.columns]
    return rel.let(**rounded).keep(*keep, *extra)


__all__ = ["PIXEL", "COLOUR", "emb8", "blank", "fixture", "li_rgb", "ev_time", "result"]
