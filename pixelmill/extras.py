"""Queries beyond single effects: compositing, palettes, animation, census, tracing, tables as rasters."""

from __future__ import annotations

import math

from pixelmill.functions import color
from pixelmill.operators import animation, census, compositing, dithers, extract, geometry, noise, palettes
from pixelmill.operators.context import Context
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import EFFECTS, apply
from pixelmill.plans import animate, document
from pixelmill.plans.rel import Spark, SparkRel
from pixelmill.sources import rasters
from pixelmill.sources.rasters import emb8, result


def dithered(src, palette="gameboy-dmg"):
    return apply(emb8(src), "bayer-4", {}, Context(src, Palette.of(palette)))


def blend_modes(src):
    """Every blend mode; on Spark from one join, as SQL mode by mode."""
    base = emb8(src)
    top = apply(base, "invert", {"amount": 0.9})
    if src.d.spark:
        return result(compositing.composites(base, top, list(compositing.BLENDS), 0.7), "mode")
    out = None
    for mode in compositing.BLENDS:
        own = result(compositing.composite(base, top, mode, 0.7)).let(mode=f"'{mode}'")
        out = own if out is None else out.union(own)
    return out


def _masked(mask):
    def run(src):
        base = emb8(src)
        top = apply(base, "posterize", {"levels": 2})
        return result(compositing.composite(base, top, "multiply", 0.8, mask, base))

    return run


def sequence(src, n=4):
    """Four embeddings in a row as the frames of one image."""
    rel = emb8(src)
    return rel.let(frame=f"image_id % {n}", image_id=rel.d.div("image_id", n)).where("image_id >= 0")


def feedback_loop(src):
    ctx = Context(src)
    ctx.frames = 4
    return result(apply(sequence(src), "feedback", {"decay": 0.8, "offsetX": 0.5, "rotate": 0.03, "blend": "lighten"}, ctx))


def framed(id, params):
    """An effect over four frames of each image."""

    def run(src):
        return result(apply(sequence(src), id, params, Context(src)))

    return run


def composite_frames(src):
    base = sequence(src)
    return result(compositing.composite(base, apply(base, "invert", {"amount": 0.9}), "screen", 0.7))


def palette_match(metric):
    def run(src):
        return palettes.nearest(emb8(src), Palette.of("cga-16", metric)).let(idx="cast(idx as int)").keep("image_id", "x", "y", "idx")

    return run


def palette_remap(src):
    """Indices after sorting the palette by luminance: the inverse permutation, joined as a table."""
    p = Palette.of("cga-16")
    _, inverse = p.reordered(p.sort_order("luminance"))
    table = src.values(["idx", "new_idx"], list(enumerate(inverse)))
    rel = palettes.nearest(emb8(src), p).let(idx="cast(idx as bigint)")
    return rel.join(table, ["idx"]).keep("image_id", "x", "y", "idx", "new_idx")


def populations(src):
    return dithered(src).group(["idx"], pixels="count(*)").let(rank="row_number() over (order by pixels desc, idx)")


def gradient_noise(src):
    """Interleaved gradient noise over a canvas."""
    return noise.gradient(rasters.blank(src, 64, 48), 11).let(value="round(value, 6)").keep("x", "y", "value")


def _field(kind, width=40, height=23, seed=9, cells=6):
    def run(src):
        if src.d.spark:
            more = (cells,) if kind == "value" else ()
            return SparkRel(getattr(noise, kind)(src.spark, width, height, *more, seed)).let(value="round(value, 6) + 0.0")
        # draw by draw, as the definition has it
        rng = dithers.Pcg32(seed, dithers.stream_of(noise.STREAMS[kind]))
        if kind == "value":
            points = src.values(["k", "v"], [(k, rng.next_f32()) for k in range(cells * cells)])
            rel = src.ints("id", width * height).let(x=f"id % {width}", y=f"id // {width}")
            for a, n in (("x", width), ("y", height)):
                rel = rel.let(**{f"{a}0": f"(({a} * {cells}) // {n}) % {cells}", f"t{a}": f"{a} * {cells}.0 / {n} - ({a} * {cells}) // {n}"}).let(**{f"{a}1": f"({a}0 + 1) % {cells}"})
            for i in "01":
                for j in "01":
                    rel = rel.let(k=f"y{i} * {cells} + x{j}").join(points, ["k"]).let(**{f"v{i}{j}": "v"}).drop("v", "k")
            rel = rel.let(tx="tx * tx * (3.0 - 2.0 * tx)", ty="ty * ty * (3.0 - 2.0 * ty)").let(p="v00 + (v01 - v00) * tx", q="v10 + (v11 - v10) * tx")
            return rel.let(value="round(p + (q - p) * ty, 6) + 0.0").keep("x", "y", "value")
        v = []
        while len(v) < width * height:
            if kind == "white":
                v.append(rng.next_f32())
            else:
                size, angle = math.sqrt(-2 * math.log(1 - rng.next_f32())), 2 * math.pi * rng.next_f32()
                v += [size * math.cos(angle), size * math.sin(angle)]
        rows = [(k % width, k // width, u) for k, u in enumerate(v[: width * height])]
        return src.values(["x", "y", "value"], rows).let(value="round(value, 6) + 0.0")

    return run


def threshold_by(field, wide, high):
    """A field (x, y, value) as the threshold of the embeddings' images, which lie side by side on it, row by row, over and over."""
    columns, rows = wide // 8, high // 8

    def run(src):
        rel = emb8(src)
        rel = rel.let(px=f"(image_id % {columns}) * 8 + x", py=f"({rel.d.div('image_id', columns)} % {rows}) * 8 + y")
        cells = field(src).let(px="x", py="y").keep("px", "py", "value")
        return rel.join(cells, ["px", "py"]).let(is_on="case when r >= value then 1 else 0 end").keep("image_id", "x", "y", "value", "is_on")

    return run


def by_event(table, frames):
    """A table over frames, and the events that fall on each frame of it."""

    def run(src):
        rows = table(src)
        events = src.table("events", "event_id", "value as amount").let(frame=f"event_id % {frames}")
        return rows.join(events, ["frame"]).group(rows.columns, events="count(*)", total="round(sum(amount), 3)")

    return run


def images_by_palette(src):
    """For each image and built-in palette the entry nearest to the image's mean colour, and where that stands in the palette's orders."""
    mean = emb8(src).group(["image_id"], **{c: f"avg({c})" for c in "rgb"})
    out = None
    for name in palettes.BUILT_IN:
        own = palettes.nearest(mean, Palette.of(name)).let(entry="cast(idx as bigint)", palette=f"'{name}'").keep("image_id", "palette", "entry")
        out = own if out is None else out.union(own)
    return out.join(all_palettes(src), ["palette", "entry"])


def all_palettes(src):
    """Every built-in palette's entries and where they stand when sorted by hue, by luminance and as given."""
    rows = []
    for name in palettes.BUILT_IN:
        p = Palette.of(name)
        place = {by: {i: k for k, i in enumerate(p.sort_order(by))} for by in ("hue", "luminance")}
        rows += [(name, i, *c, place["hue"][i], place["luminance"][i]) for i, c in enumerate(p.colors)]
    return src.values(["palette", "entry", "cr", "cg", "cb", "by_hue", "by_luminance"], rows)


BINDINGS = [
    {"shape": s, "cycles": k + 1, "phase": 0.1 * k, "base": 2.0, "amount": 1.5, "legal": (0.0, 3.2), "seed": 40 + k, "bipolar": k % 2 == 0, "kind": "int" if k == 3 else "float"}
    for k, s in enumerate(animation.SHAPES)
]
TEMPORAL = {
    "static": {},
    "per-frame-reseed": {"base": 5},
    "hold-k-frames": {"base": 5, "hold": 4},
    "ping-pong": {"base": 5, "hold": 3},
    "blue-noise-cycle": {"period": 64},
    "bayer-offset-scroll": {"cells": (8, -16), "period": 8},
    "ign-scroll": {"period": 64},
    "bayer-rotation": {"turns": 2},
    "golden-ratio-rotation": {},
}


def modulators(src):
    return animation.modulated(src, BINDINGS, 48).let(value="round(value, 6) + 0.0")


def temporal_modes(src):
    out = None
    for mode, v in TEMPORAL.items():
        own = animation.temporal(src, mode, 24, **v).let(mode=f"'{mode}'", ox="round(ox, 6) + 0.0", oy="round(oy, 6) + 0.0", turns="round(turns, 6) + 0.0")
        out = own if out is None else out.union(own)
    return out


def keyframes(src):
    return animation.keyframed(src, [(3, 1.0, "linear"), (9, 4.0, "ease-in-out"), (14, -2.0, "hold"), (20, 0.5, "ease-out")], 24).let(value="round(value, 6) + 0.0")


def animated_levels(src):
    """A bound parameter: frames are added only where the first animated node begins."""
    gammas = animation.modulated(src, [{"shape": "sine", "cycles": 1, "base": 1.0, "amount": 0.5, "legal": (0.1, 9.99)}], 6)
    still = emb8(src)  # frame-invariant, computed once
    rel = still.explode("frame", still.d.ints(0, 5)).let(frame="cast(frame as bigint)").join(gammas.keep("frame", "value"), ["frame"])
    rel = rel.let(**{c: color.decode(f"pow({color.clamp(color.encode(c))}, 1.0 / value)") for c in "rgb"})
    return result(rel.drop("value"))


def flatten_on_matte(src):
    return result(compositing.flatten(emb8(src).let(a="(r + g) / 2.0"), (0.2, 0.4, 0.6)))


def loop_palette(src):
    rel = census.rgba8(apply(sequence(src).drop("frame"), "bayer-4", {}, Context(src, Palette.of("cga-16"))))
    return rel.group(["cr", "cg", "cb"], pixels="count(*)")


def dithered_frames(src):
    return apply(sequence(src), "bayer-4", {}, Context(src))


def regions_of(rel):
    return census.regions_spark(rel) if isinstance(rel, SparkRel) else census.regions_duck(rel)


def regions(src):
    return regions_of(dithered(src, "mono"))


def small_features(src):
    """Regions of fewer than four pixels: what a trace with that minimum drops."""
    return regions(src).where("area < 4").group(["image_id"], dropped="count(*)", pixels="sum(area)").let(pixels="cast(pixels as bigint)")


def order_strips(src):
    """Colour strips of all orders, levelled and indexed; how often each colour occurs."""
    rel = apply(rasters.li_rgb(src), "levels", {"gamma": 1.4})
    rel = palettes.nearest(rel, Palette.of("cga-16"))
    return rel.group(["idx"], pixels="count(*)", orders="count(distinct image_id)")


def event_raster(src):
    rel = apply(rasters.ev_time(src), "bayer-8", {}, Context(src))
    return result(rel)


#: Weights of the fields this catalogue has, and how strongly a token matches; fixed values.
FIELD_WEIGHTS = {"id": 3.0, "slot": 1.0}
EXACT, PREFIX, SUBSTRING = 1.0, 0.7, 0.4


def catalogue_search(src, searches=("noise", "dis", "edge", "post glow", "row displacement", "dither tone")):
    """Effects in which every token of a search is found; each token counts by its best field."""
    fields = [(id, e.slot, f, w, FIELD_WEIGHTS[f]) for id, e in sorted(EFFECTS.items()) for f, v in (("id", id), ("slot", e.slot)) for w in v.split("-")]
    texts = {"id": "replace(id, '-', ' ')", "slot": "slot"}
    rel = src.values(["id", "slot", "field", "word", "weight"], fields)
    rel = rel.let(content="case field " + " ".join(f"when '{k}' then {v}" for k, v in texts.items()) + " end")
    out = None
    for search in searches:
        tokens, hits = search.split(), None
        for k, q in enumerate(tokens):
            strength = f"case when word = '{q}' then {EXACT} when substring(word, 1, {len(q)}) = '{q}' then {PREFIX} when content like '%{q}%' then {SUBSTRING} else 0.0 end"
            own = rel.let(score=f"weight * {strength}").group(["id", "slot"], best="max(score)").where("best > 0.0").let(token=str(k))
            hits = own if hits is None else hits.union(own)
        found = hits.group(["id", "slot"], score="round(sum(best), 9)", n="count(*)").where(f"n = {len(tokens)}").drop("n")
        found = found.let(query=f"'{search}'", rank="row_number() over (order by score desc, id)")
        out = found if out is None else out.union(found)
    return out


def locked_palette(src):
    """The six commonest colours of each image around two locked swatches."""
    found = census.rgba8(emb8(src)).let(code="(cr * 256 + cg) * 256 + cb").group(["image_id", "code"], population="count(*)")
    found = found.let(place="row_number() over (partition by image_id order by population desc, code) - 1").where("place < 6")
    return palettes.merge_locked(found, [(0x101010, False), (0xFF0000, True), (0x202020, False), (0x00FF00, True)])


def bound(src):
    """A set of bindings of which most are refused, each for another reason."""
    rows = [(0, "a", "contrast", 0.5), (1, "z", "contrast", 0.5), (2, "b", "x", 0.5), (3, "a", "nothing", 0.5), (4, "c", "mode", 0.5), (5, "a", "contrast", 0.1), (6, "a", "exposure", math.inf)]
    kept = src.values(["nth", "node", "param", "amount"], [r if math.isfinite(r[3]) else (*r[:3], -1.0) for r in rows])
    kept = kept.let(amount="case when amount >= 0.0 then amount end")
    nodes = src.values(["node", "effect"], [("a", "brightness-contrast"), ("b", "no-such-effect"), ("c", "levels")])
    params = src.values(["effect", "param", "kind"], [(id, k, p.kind) for id, e in sorted(EFFECTS.items()) for k, p in e.params.items()])
    return animation.binding_problems(kept, nodes, params)


def batch_plan(src):
    """Output names of a batch by template, and which of them collide regardless of case."""
    rel = src.table("part", "p_partkey", "p_name", "p_brand")
    rel = rel.let(name="concat(lower(replace(p_name, ' ', '_')), '-', p_brand, '.png')")
    rel = rel.let(same="lower(name)").let(copies="count(*) over (partition by same)")
    return rel.let(status="case when copies > 1 then 'collision' else 'ok' end").keep("p_partkey", "name", "status")


def fixtures(src):
    out = None
    for name in ("linear-ramp", "radial-gradient", "colour-wheel", "hard-edge-chart", "flat-mid-grey"):
        own = result(rasters.fixture(src, name)).let(fixture=f"'{name}'")
        out = own if out is None else out.union(own)
    return out


def blue_tile(src):
    """The rank tile itself, a permutation of 0 .. 4095, as thresholds."""
    rel = src.values(["place", "rank"], list(enumerate(dithers.blue_noise_ranks())))
    return rel.let(x="place % 64", y=rel.d.div("place", 64), value="(rank + 0.5) / 4096.0").keep("x", "y", "value")


def output_modes(src):
    """RGB levels as a palette: every combination of evenly spaced codes."""
    levels = src.ints("i", 4 * 4 * 2)
    d = levels.d
    return levels.let(cr=f"{d.div('i', 8)} * 85", cg=f"{d.div('i', 2)} % 4 * 85", cb="i % 2 * 255")


DOCUMENT = """{"stack": [
  {"id": "tone", "effect": "levels", "params": {"gamma": 1.3}},
  {"id": "off", "effect": "invert", "enabled": false},
  {"id": "soft", "effect": "blur", "params": {"radius": 1.0}, "opacity": 0.6, "blend": "screen",
   "mask": {"kind": "luminance", "low": 0.1, "high": 0.8, "feather": 0.1}},
  {"id": "dither", "effect": "bayer-4"},
  {"id": "line", "effect": "outline", "params": {"targetIndex": 2, "colorIndex": 0}},
  {"id": "unused", "effect": "grain"}],
 "edges": [{"from": "tone", "to": "off"}, {"from": "off", "to": "soft"}, {"from": "soft", "to": "dither"},
  {"from": "dither", "to": "line"}, {"from": "tone", "to": "unused"}],
 "output": "line"}"""


def document_render(src):
    return result(document.plan(document.Document.parse(DOCUMENT), emb8(src), Context(src)))


ANIMATED = """{"stack": [
  {"id": "tone", "effect": "levels", "params": {"gamma": 1.2}},
  {"id": "shade", "effect": "vignette", "blend": "multiply", "opacity": 0.5},
  {"id": "bits", "effect": "brightness-contrast", "params": {"contrast": 1.1}},
  {"id": "dither", "effect": "bayer-4"}],
 "edges": [{"from": "tone", "to": "shade"}, {"from": "shade", "to": "bits"}, {"from": "bits", "to": "dither"}],
 "output": "dither", "clock": {"frames": 6, "fps": 12},
 "bindings": [{"node": "bits", "param": "exposure", "shape": "triangle", "cycles": 1, "phase": 0.25, "amount": 0.8}],
 "variations": [{"node": "dither", "mode": "bayer-offset-scroll", "cells": [4, -8], "period": 4}]}"""


def animated_document(src):
    """All frames of an animated document: on Spark by the plan that splits still from moving, as SQL frame by frame."""
    anim = animate.Animation.parse(ANIMATED, seed=5)
    if src.d.spark:
        return result(animate.plan(anim, emb8(src), Context(src)))
    out = None
    for f in range(anim.frames):
        own = document.plan(animate.document_at(anim, f), emb8(src), Context(src))
        own = result(own.let(frame=f"cast({f} as bigint)"))
        out = own if out is None else out.union(own)
    return out


def _extracted(method):
    def run(spark, sf_dir):
        rel = emb8(Spark(spark, sf_dir))
        return result(extract.populations(rel, extract.extract(rel, 4, method)), "entry", "pixels").df

    return run


PAIRS = {
    "document_render": document_render,
    "animation_document": animated_document,
    "blend_modes": blend_modes,
    "mask_luminance": _masked({"kind": "luminance", "low": 0.2, "high": 0.7, "feather": 0.1}),
    "mask_color": _masked({"kind": "color", "color": (200, 120, 90), "tolerance": 0.1, "feather": 0.2, "invert": True}),
    "mask_image": _masked({"kind": "image", "channel": "green"}),
    "feedback_loop": feedback_loop,
    "composite_frames": composite_frames,
    "fx_floyd_steinberg_frames": framed("floyd-steinberg", {}),
    "fx_row_displacement_frames": framed("row-displacement", {"maxSliceHeight": 0.4, "offsetRange": 0.5, "probability": 0.8, "seed": 8}),
    "fx_glyph_tile_frames": framed("glyph-tile", {"cellSize": 4}),
    "fx_datamosh_smear_frames": framed("datamosh-smear", {"dragLength": 5.0, "threshold": 0.8, "seed": 1}),
    "palette_match_oklab": palette_match("oklab"),
    "palette_match_srgb": palette_match("srgb"),
    "palette_remap": palette_remap,
    "palette_populations": populations,
    "palette_histogram": lambda src: census.histogram(emb8(src)),
    "palette_output_modes": output_modes,
    "noise_interleaved_gradient": threshold_by(gradient_noise, 64, 48),
    "noise_white": threshold_by(_field("white"), 40, 23),
    "noise_gaussian": threshold_by(_field("gaussian"), 40, 23),
    "noise_value": threshold_by(_field("value"), 40, 23),
    "noise_blue_tile": threshold_by(blue_tile, 64, 64),
    "palette_built_in": images_by_palette,
    "animation_modulators": by_event(modulators, 48),
    "animation_temporal_modes": by_event(temporal_modes, 24),
    "animation_keyframes": by_event(keyframes, 24),
    "animation_bound_levels": animated_levels,
    "census_colours": lambda src: census.colour_census(dithered(src)),
    "census_colours_frames": lambda src: census.colour_census(dithered_frames(src)),
    "palette_histogram_frames": lambda src: census.histogram(sequence(src)),
    "trace_runs_frames": lambda src: census.runs(dithered_frames(src)),
    "trace_regions_frames": lambda src: regions_of(dithered_frames(src)),
    "census_loop_palette": loop_palette,
    "census_changed_rectangle": lambda src: census.changed_rectangle(sequence(src)),
    "flatten_on_matte": flatten_on_matte,
    "trace_runs": lambda src: census.runs(dithered(src, "mono")),
    "trace_regions": regions,
    "trace_small_features": small_features,
    "raster_orders": order_strips,
    "raster_events": event_raster,
    "raster_fixtures": fixtures,
    "catalogue_search": catalogue_search,
    "batch_plan": batch_plan,
    "palette_locked": locked_palette,
    "animation_binding_problems": bound,
    "integer_scale": lambda src: result(geometry.integer_scale(emb8(src), 3), "w", "h"),
    "preview_reduced": lambda src: result(geometry.reduced(sequence(src), "5", "h * 0.4"), "w", "h"),
    "sprite_sheet": lambda src: result(geometry.sprite_sheet(sequence(src), 4, 3, 2), "w", "h"),
}
SPARK_QUERIES: dict = {f"palette_extract_{m.replace('-', '_')}": _extracted(m) for m in extract.METHODS}
ORACLES: dict = {}

