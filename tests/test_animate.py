"""Animated documents: one plan for all frames equals the frames one by one; faults and seams by code."""

import json
import random

import pytest

from pixelmill import catalog  # noqa: F401  (registers the effects)
from pixelmill.operators import animation as loop
from pixelmill.operators.context import Context
from pixelmill.plans import animate, document
from pixelmill.plans.rel import Spark
from pixelmill.sources.rasters import result

W, H, N = 7, 5, 6


def animation(stack, edges=None, output=None, bindings=(), variations=(), frames=N, **timing):
    ids = [n["id"] for n in stack]
    edges = edges or [{"from": a, "to": b} for a, b in zip(ids, ids[1:], strict=False)]
    return animate.Animation.parse(json.dumps({"stack": stack, "edges": edges, "output": output or ids[-1], "clock": {"frames": frames, "fps": 12}, "bindings": list(bindings), "variations": list(variations)}), **timing)


CASES = {
    "still": animation([{"id": "a", "effect": "levels", "params": {"gamma": 1.3}}]),
    "bound": animation(
        [{"id": "a", "effect": "invert", "params": {"amount": 0.4}}, {"id": "b", "effect": "levels", "params": {"gamma": 1.2}, "opacity": 0.6, "blend": "multiply"}, {"id": "c", "effect": "posterize"}],
        bindings=[{"node": "b", "param": "gamma", "shape": "triangle", "cycles": 2, "phase": 0.1, "amount": 0.5}, {"node": "c", "param": "levels", "shape": "stepped-random", "amount": 3.0, "bipolar": False}],
        speed=1, phase=0.05, seed=9,
    ),
    "patterns": animation(
        [{"id": "n", "effect": "grain", "seed": 4}, {"id": "d", "effect": "bayer-4"}, {"id": "o", "effect": "outline", "params": {"targetIndex": 1}}],
        variations=[{"node": "n", "mode": "hold-k-frames", "hold": 2}, {"node": "d", "mode": "bayer-offset-scroll", "cells": [4, -8], "period": 4}],
    ),
    "rotation": animation([{"id": "d", "effect": "bayer-8"}], variations=[{"node": "d", "mode": "golden-ratio-rotation"}]),
    "diffusion": animation([{"id": "d", "effect": "floyd-steinberg", "params": {"jitter": 0.5}, "seed": 3}], variations=[{"node": "d", "mode": "ping-pong", "hold": 1}]),
    "mask": animation(
        [{"id": "m", "effect": "threshold"}, {"id": "s", "effect": "posterize"}, {"id": "t", "effect": "invert", "mask": {"kind": "image", "channel": "red"}}],
        edges=[{"from": "s", "to": "t"}, {"from": "m", "to": "t", "port": "mask"}], output="t",
        bindings=[{"node": "m", "param": "level", "shape": "sine", "amount": 0.3}],
    ),
    "off": animation([{"id": "a", "effect": "levels", "enabled": False}, {"id": "b", "effect": "invert"}], bindings=[{"node": "a", "param": "gamma", "shape": "saw", "amount": 0.5}]),
}


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(3)
    rows = [(0, x, y, W, H, rng.random(), rng.random(), rng.random(), 1.0) for y in range(H) for x in range(W)]
    return Spark(spark, "").values(["image_id", "x", "y", "w", "h", "r", "g", "b", "a"], rows)


def colours(rel):
    out = result(rel).df.collect()
    return {(r.asDict().get("frame"), r.x, r.y): (r.r, r.g, r.b, r.asDict().get("idx")) for r in out}


@pytest.mark.parametrize("name", CASES)
def test_frames_in_one_plan(source, name):
    anim = CASES[name]
    whole = colours(animate.plan(anim, source, Context(source)))
    moves = {f for f, _, _ in whole}
    assert moves == ({None} if name in ("still", "off") else set(range(N)))
    for f in range(N):
        still = colours(document.plan(animate.document_at(anim, f), source, Context(source)))
        for (_, x, y), v in still.items():
            assert whole[f if None not in moves else None, x, y] == v
    if name in ("bound", "rotation", "diffusion"):
        assert len({tuple(v for (g, *_), v in sorted(whole.items()) if g == f) for f in range(N)}) > 1


def test_feedback_sees_every_frame(source):
    anim = animation([{"id": "a", "effect": "invert", "params": {"amount": 0.5}}, {"id": "f", "effect": "feedback", "params": {"decay": 0.5}}], frames=3)
    found = colours(animate.plan(anim, source, Context(source)))
    assert {f for f, *_ in found} == {0, 1, 2} and not anim.loops and anim.still_frame == 1
    assert any(found[1, x, y] != found[0, x, y] for x in range(W) for y in range(H))
    assert animate.seam(anim) == [("does-not-loop", "info", "f")]


def test_values_agree_with_the_table_of_modulators(spark):
    """Two definitions of a bound value: at a frame in Python, over a frame column in SQL."""
    for shape in loop.SHAPES:
        anim = animation([{"id": "a", "effect": "levels", "params": {"gamma": 1.5}, "seed": 6}], bindings=[{"node": "a", "param": "gamma", "shape": shape, "cycles": 3, "phase": 0.2, "amount": 0.9}], frames=16)
        b = anim.bindings[0]
        p = document.EFFECTS["levels"].params["gamma"]
        table = loop.modulated(Spark(spark, ""), [{**b, "base": 1.5, "legal": (p.low, p.high), "seed": animate.binding_seed(anim, b)}], 16)
        for r in table.df.collect():
            assert abs(r.value - animate.bound_value(anim, b, r.frame)) < 1e-9
    for mode, v in {"per-frame-reseed": {}, "ping-pong": {"hold": 3}, "hold-k-frames": {"hold": 5}, "blue-noise-cycle": {"hold": 2, "period": 64}, "ign-scroll": {"period": 64}, "bayer-offset-scroll": {"cells": (8, -16), "period": 8}, "bayer-rotation": {"turns": 2}, "golden-ratio-rotation": {}}.items():
        anim = animation([{"id": "a", "effect": "bayer-4", "seed": 6}], variations=[{"node": "a", "mode": mode, **v}], frames=16)
        for r in loop.temporal(Spark(spark, ""), mode, 16, base=6, **v).df.collect():
            got = animate.pattern_at(anim, anim.variations[0], r.frame)
            assert got.get("seed") == r.seed and all(abs(a - b) < 1e-9 for a, b in zip([*got.get("offset", (0, 0)), got.get("rotation", 0)], (r.ox, r.oy, r.turns), strict=True))


def test_faults():
    def codes(**more):
        return [c for c, _ in animate.faults(animation([{"id": "a", "effect": "levels"}, {"id": "d", "effect": "bayer-4"}], **more))]

    def bind(**more):
        return {"node": "a", "param": "gamma", "shape": "sine", "amount": 1.0} | more

    assert codes(bindings=[bind()]) == []
    for code, b in {"unknown-node": bind(node="x"), "unknown-parameter": bind(param="x"), "parameter-not-animatable": bind(param="mode"), "unknown-shape": bind(shape="x"), "invalid-cycles": bind(cycles=0)}.items():
        assert codes(bindings=[b]) == [code]
    assert codes(bindings=[bind(amount=float("inf"))]) == ["non-finite-value"] and codes(bindings=[bind(), bind()]) == ["duplicate-binding"]
    for code, v in {
        "unknown-node": {"node": "x", "mode": "static"}, "unknown-mode": {"node": "d", "mode": "x"}, "unsupported-lever": {"node": "d", "mode": "per-frame-reseed"},
        "invalid-period": {"node": "d", "mode": "ign-scroll", "period": 5000},
    }.items():
        assert codes(variations=[v]) == [code]
    assert codes(variations=[{"node": "d", "mode": "static"}] * 2) == ["duplicate-variation"] and codes(frames=0) == ["invalid-clock"]
    with pytest.raises(ValueError):
        animate.plan(animation([{"id": "a", "effect": "levels"}], bindings=[bind(param="x")]), None, Context(None))


def test_seams():
    stack = [{"id": "a", "effect": "levels", "params": {"gamma": 1.0}}, {"id": "d", "effect": "bayer-4"}]
    bad = animation(stack, bindings=[{"node": "a", "param": "gamma", "shape": "smooth-noise", "amount": 50.0}], variations=[{"node": "d", "mode": "bayer-offset-scroll", "cells": [3, 8], "period": 8, "hold": 4}])
    assert animate.seam(bad) == [
        ("sampled-below-nyquist", "warning", "a.gamma"), ("binding-clips", "warning", "a.gamma"), ("hold-does-not-divide", "warning", "d"), ("scroll-not-period-aligned", "warning", "d"),
    ]
    good = animation(stack, bindings=[{"node": "a", "param": "gamma", "shape": "sine", "amount": 0.1}], variations=[{"node": "d", "mode": "hold-k-frames", "hold": 3}])
    assert animate.seam(good) == []
    half = animate.replace(good, bindings=({**good.bindings[0], "cycles": 1.5},))
    assert ("phase-not-periodic", "error", "a.gamma") in animate.seam(half)


def test_frames_are_compared_image_by_image(spark):
    rows = [(i, f, x, 0, 0.1 * x + (0.2 if i == 1 and f and x == 2 else 0.0), 0.5, 0.5, 1.0) for i in range(3) for f in range(2) for x in range(4)]
    rel = Spark(spark, "").values(["image_id", "frame", "x", "y", "r", "g", "b", "a"], rows)
    got = {r.image_id: (r.matches, r.code) for r in animate.seam_of_frames(rel, []).df.collect()}
    assert got == {0: (True, None), 1: (False, "frame-hash-mismatch"), 2: (True, None)}


def test_a_smaller_mask_covers_nothing_beyond_it(source, spark):
    from pixelmill.operators.compositing import composite

    mask = Spark(spark, "").values(["image_id", "x", "y", "w", "h", "r", "g", "b", "a"], [(0, x, 0, 3, 1, 1.0, 1.0, 1.0, 1.0) for x in range(3)])
    top = source.let(r="1.0 - r")
    got = colours(composite(source, top, "normal", 1.0, {"kind": "image", "channel": "red"}, mask))
    base, over = colours(source), colours(top)
    assert got == {k: over[k] if k[1] < 3 and k[2] == 0 else base[k] for k in base}
