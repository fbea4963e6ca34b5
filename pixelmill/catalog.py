"""All registered queries of the raster engine: Spark plans and their DuckDB oracles.

Effects are written once against ``Rel``; a query runs them on Spark, its oracle is
the same chain as DuckDB SQL. Error diffusion, tracing and other serial work has
its own code on Spark and an independent SQL oracle, or tests against brute force.
"""

from __future__ import annotations

from pixelmill.operators import compositing, diffusion, dithers, generators, pointwise, spatial, waves  # noqa: F401  (register effects)
from pixelmill.operators import geometry
from pixelmill.operators.context import Context
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import EFFECTS, apply
from pixelmill.plans.rel import Duck, Spark
from pixelmill.sources import rasters

#: Parameters of each effect's query; those not named have their defaults.
EXAMPLES = {
    "brightness-contrast": {"exposure": 0.5, "contrast": 1.3, "brightness": -0.1},
    "levels": {"inputBlack": 0.1, "inputWhite": 0.9, "gamma": 1.6, "outputWhite": 0.95, "mode": "luma"},
    "hsl": {"hue": 0.2, "saturation": 1.4, "lightness": 0.05},
    "curves": {},
    "noise-injection": {"kind": "gaussian", "amount": 0.2, "channels": "rgb", "seed": 77},
    "posterize": {"levels": 3},
    "threshold": {"level": 0.7, "softness": 0.2},
    "invert": {"mode": "lightness", "amount": 0.8},
    "gradient-map": {"midChroma": 0.1, "midHue": 140.0, "highlightChroma": 0.05, "highlightHue": 80.0, "midPosition": 0.6},
    "grain": {"size": 2.5, "monochrome": False, "seed": 3},
    "channel-swap": {"sourceR": "b", "sourceB": "r"},
    "scanlines": {"pitch": 3.0},
    "crt-mask": {"geometry": "shadow-mask", "pitch": 4.0},
    "bit-crush": {"redBits": 2, "blueBits": 3, "corruptChance": 0.2, "corruptPlane": 1, "seed": 9},
    "noise-burst": {"cellSize": 3.0, "density": 0.4, "seed": 5},
    "gen-noise": {"scale": 16.0, "octaves": 2, "evolve": 0.3},
    "gen-gradient": {"kind": "conical", "repeats": 3},
    "gen-shape": {"shape": "star", "rotation": 0.1},
    "halftone": {"cellSize": 4.0},
    "cmyk-halftone": {"cyanCell": 3.0, "magentaCell": 3.0, "yellowCell": 3.0, "blackCell": 3.0, "inkDensity": 0.8, "dotShape": "ellipse"},
    "line-screen": {"pitch": 3.0},
    "cross-hatch": {"pitch": 3.0, "layers": 3},
    "concentric-rings": {"pitch": 3.0},
    "spiral": {"pitch": 3.0, "twist": 2},
    "glyph-tile": {"cellSize": 4},
    "ridgeline": {"pitch": 3.0, "amplitude": 1.5},
    "bayer-2": {"tileRotation": 0.05},
    "bayer-8": {"contrast": 1.2, "spread": 0.9},
    "lens-distortion": {"amount": -0.4, "edge": "black"},
    "blur": {"radius": 2.0},
    "sharpen": {"amount": 1.5, "threshold": 0.05},
    "edge-detect": {"mix": 0.9},
    "rgb-split": {"redX": 0.1, "greenY": -0.15, "jitter": 0.05, "edge": "mirror", "seed": 4},
    "chromatic-aberration": {"strength": 0.15, "jitter": 0.02, "seed": 6},
    "wave-warp": {"amplitude": 1.7, "axis": "both"},
    "interlace-tear": {"offset": 2.0},
    "ghost-echo": {"offsetX": 2.0, "offsetY": 1.0},
    "row-displacement": {"minSliceHeight": 0.1, "maxSliceHeight": 0.4, "offsetRange": 0.5, "probability": 0.8, "seed": 8},
    "column-displacement": {"minSliceWidth": 0.1, "maxSliceWidth": 0.4, "offsetRange": 0.5, "probability": 0.8, "edge": "mirror", "seed": 8},
    "slice-repeat": {"sliceSize": 3.0, "probability": 0.7, "offsetRange": 5.0, "seed": 2},
    "block-shuffle": {"columns": 4, "rows": 4, "swapProbability": 0.7, "seed": 11},
    "datamosh-smear": {"dragLength": 5.0, "jitter": 0.5, "decay": 0.8, "angle": 0.1, "threshold": 0.8, "seed": 1},
    "pixel-sort": {"threshold": 0.7, "spanLimit": 4, "jitter": 0.2, "direction": "left", "seed": 12},
    "epsilon-glow": {"radius": 2.0, "blend": "screen"},
    "internal-resolution": {"factor": 3, "filter": "lanczos"},
    "outline": {"placement": "both", "colorIndex": 3, "targetIndex": 2},
    "dilate-erode": {"operation": "erode", "targetIndex": 2},
    "floyd-steinberg": {},
    "wave-field": {"wavelength": 3.0, "thickness": 1.5, "maskThreshold": 0.8, "maskSmoothing": 1.0},
}
#: More queries of an effect, with other parameters.
VARIANTS = {
    "fx_wave_field_shadow": ("wave-field", {"wavelength": 3.0, "thickness": 2.0, "mode": "shadow", "maskThreshold": 0.82, "maskSmoothing": 0.0, "sourceX": -0.3}),
    "fx_wave_field_line": ("wave-field", {"wavelength": 3.5, "sourceKind": "line", "sourceAngle": 0.1, "maskThreshold": 0.8, "maskSmoothing": 2.0, "strength": -0.7, "invert": True}),
}


def run_effect(src, id: str, params: dict | None = None):
    """An effect over the 8x8 rasters, colours rounded to six places; generators are multiplied onto them, at twice the size."""
    e = EFFECTS[id]
    ctx = Context(src)
    if e.slot == "source":
        base = geometry.integer_scale(rasters.emb8(src), 2)
        return rasters.result(compositing.laid_over(base, id, EXAMPLES.get(id, {}) if params is None else params, ctx, "multiply", 0.7))
    rel = rasters.emb8(src)
    if "tile" in e.needs:
        ctx.tile_size = (8, 8)
        luma = "floor(255.0 * (0.2126 * r + 0.7152 * g + 0.0722 * b) + 0.5) / 255.0"
        ctx.tile = rasters.emb8(src).where("image_id = 0").let(tx="x", ty="y", value=luma).keep("tx", "ty", "value")
    if e.requires_index:
        rel = apply(rel, "bayer-4", {}, ctx)
    return rasters.result(apply(rel, id, EXAMPLES.get(id, {}) if params is None else params, ctx))


def _pairs() -> dict:
    """name -> function of a source, for both engines."""
    out = {f"fx_{id.replace('-', '_')}": (lambda src, id=id: run_effect(src, id)) for id in EFFECTS}
    out |= {name: (lambda src, id=id, params=params: run_effect(src, id, params)) for name, (id, params) in VARIANTS.items()}
    from pixelmill import extras

    return out | extras.PAIRS


def flagship(spark, sf_dir):
    """Levels, an 8x8 ordered dither to four greens, and how often each colour is used by image."""
    return census(Spark(spark, sf_dir)).df


def census(src):
    ctx = Context(src, Palette.of("gameboy-dmg"))
    rel = apply(rasters.emb8(src), "levels", {"inputBlack": 0.05, "inputWhite": 0.95, "gamma": 1.2}, ctx)
    rel = apply(rel, "bayer-8", {}, ctx)
    return rel.group(["image_id", "idx"], pixels="count(*)")


def queries() -> dict:
    from pixelmill import extras, files, tracing

    pairs = _pairs() | {"flagship_census": census}
    out = {name: (lambda spark, sf_dir, f=f: f(Spark(spark, sf_dir)).df) for name, f in pairs.items()}
    return out | extras.SPARK_QUERIES | tracing.SPARK_QUERIES | files.SPARK_QUERIES


def oracle_sql() -> dict[str, str]:
    from pixelmill import extras, files, tracing

    pairs = _pairs() | {"flagship_census": census}
    return {name: f(Duck()).sql() for name, f in pairs.items()} | extras.ORACLES | tracing.oracles() | files.oracles()
