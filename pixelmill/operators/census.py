"""Counting and cutting up indexed rasters: census, palettes over frames, histograms, runs and regions."""

from __future__ import annotations

from pixelmill.functions import color
from pixelmill.operators.spatial import image
from pixelmill.plans.rel import num, whole


def rgba8(rel):
    """Adds 8-bit codes of each channel."""
    code = {f"c{c}": whole(f"{color.clamp(color.encode(c))} * 255.0 + 0.5") for c in "rgb"}
    return rel.let(**code, ca=whole(f"{color.clamp('a')} * 255.0 + 0.5"))


def colour_census(rel, most: int = 256):
    """(image, entry, code, pixels, depth): an image's or a frame's distinct colours, transparent ones first, then by first
    appearance. An image with more than ``most`` has no table, but one row with a null entry, code and depth. depth: bits of an index."""
    rel = rgba8(rel).let(code="((cr * 256 + cg) * 256 + cb) * 256 + ca", place="y * w + x")
    k = image(rel)
    found = rel.group([*k, "code", "ca"], pixels="count(*)", first="min(place)")
    found = found.let(colours=f"count(*) over (partition by {', '.join(k)})")
    order = f"over (partition by {', '.join(k)} order by case when ca < 255 then 0 else 1 end, first)"
    found = found.let(entry=f"row_number() {order} - 1", depth="case when colours <= 2 then 1 when colours <= 4 then 2 when colours <= 16 then 4 else 8 end")
    many = found.where(f"colours > {most}").group(k, pixels="cast(sum(pixels) as bigint)")
    none = many.let(entry="cast(null as bigint)", code="cast(null as bigint)", depth="cast(null as bigint)")
    columns = (*k, "entry", "code", "pixels", "depth")
    found = found.where(f"colours <= {most}").let(entry="cast(entry as bigint)", depth="cast(depth as bigint)")
    return found.keep(*columns).union(none.keep(*columns))


def histogram(rel, bins: int = 32, moments: bool = False):
    """(image, bin, n, mr, mg, mb): OKLab bins over each image's or frame's own bounding box, with their mean colour.

    ``moments`` adds the means of the OKLab axes and of their squared length, and leaves all unrounded."""
    rel = color.oklab(rel)
    names = ("lab_l", "lab_a", "lab_b")
    box = rel.group(image(rel), **{f"{f}_{c}": f"{f}({c})" for c in names for f in ("min", "max")})
    rel = rel.join(box, image(rel))
    cell = [f"least({whole(f'({c} - min_{c}) / greatest(max_{c} - min_{c}, 1e-12) * {num(bins)}')}, {bins - 1})" for c in names]
    rel = rel.let(bin=f"({cell[0]} * {bins} + {cell[1]}) * {bins} + {cell[2]}")
    more = {f"m{c}": f"avg({c})" for c in names} | {"m2": " + ".join(f"avg({c} * {c})" for c in names)} if moments else {}
    means = {f"m{c}": f"avg({c})" if moments else f"round(avg({c}), 6)" for c in "rgb"}
    return rel.group([*image(rel), "bin"], n="count(*)", **means, **more)


def runs(rel):
    """(image, y, start, stop, idx): maximal runs of one index along rows, by gaps and islands."""
    k = image(rel)
    rel = rel.let(isle=f"x - row_number() over (partition by {', '.join(k)}, y, idx order by x)")
    return rel.group([*k, "y", "idx", "isle"], start="min(x)", stop="max(x)").keep(*k, "y", "start", "stop", "idx")


def changed_rectangle(rel):
    """(image_id, frame, left, top, right, bottom): the box of pixels that differ from the frame before; null if none does."""
    rel = rgba8(rel).let(code="((cr * 256 + cg) * 256 + cb) * 256 + ca")
    rel = rel.let(was="lag(code) over (partition by image_id, x, y order by frame)")
    differs = "was is null or was <> code"
    return rel.group(
        ["image_id", "frame"],
        left_="min(case when {0} then x end)".format(differs),
        top_="min(case when {0} then y end)".format(differs),
        right_="max(case when {0} then x end)".format(differs),
        bottom_="max(case when {0} then y end)".format(differs),
    )


def regions_spark(rel):
    """(image, label, idx, area): 4-connected regions of one index; label is the smallest place in it.

    Runs are nodes, touching runs of neighbouring rows edges, and regions their components (see ``contours``).
    """
    from pixelmill.operators import contours
    from pixelmill.plans.rel import SparkRel

    found = contours.regions(contours.settled(contours.layer_runs(rel.df)))
    k = image(rel)
    return SparkRel(found.select(*k, "root", "layer", "area").distinct().selectExpr(*k, "root as label", "layer as idx", "area"))


def regions_duck(rel):
    """The same regions by spreading the smallest place over equal neighbours until nothing changes."""
    k = image(rel)
    ks, same = ", ".join(k), " and ".join(f"n.{c} = r.{c}" for c in k)
    base = rel._next(f"select {ks}, x, y, w, idx, y * w + x as place from {rel.name}", [*k, "x", "y", "w", "idx", "place"])
    b = base.name
    sql = f"""select {ks}, label, cast(idx as bigint) as idx, count(*) as area from (
      with recursive reach as (
        select {ks}, place, place as label, idx, x, y from {b}
        union
        select {', '.join(f'n.{c}' for c in k)}, n.place, r.label, n.idx, n.x, n.y from reach r join {b} n
        on {same} and n.idx = r.idx and abs(n.x - r.x) + abs(n.y - r.y) = 1 and r.label < n.place)
      select {ks}, place, idx, min(label) as label from reach group by all) group by {ks}, label, idx"""
    return base._next(sql, [*k, "label", "idx", "area"])
