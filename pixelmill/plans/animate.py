"""Animated documents: what a document is at a frame, and one plan for all its frames.

Beside a document's nodes and edges there is a clock (frames, fps), bindings (a
parameter swings around its own value) and variations (a dither's pattern changes from
frame to frame). Planning splits the graph: a node is moving if it is bound or varied
or lies behind one that is. What does not move is one relation without frames, shared
by all of them; a moving node runs once for each of its distinct parameter states,
over just the frames that have it.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass, replace

from pixelmill.operators import animation as loop
from pixelmill.operators.compositing import laid_over
from pixelmill.operators.registry import EFFECTS
from pixelmill.plans.document import Document, Node, content_hash, full_params, validate

OFFSETS, ROTATION = ("offsetX", "offsetY"), "tileRotation"
#: mode -> what it drives; fixed names.
LEVERS = {
    "static": None,
    "per-frame-reseed": "seed",
    "hold-k-frames": "seed",
    "ping-pong": "seed",
    "blue-noise-cycle": "offset",
    "bayer-offset-scroll": "offset",
    "ign-scroll": "offset",
    "bayer-rotation": "rotation",
    "golden-ratio-rotation": "rotation",
}
#: The still of a loop with feedback is the frame at this share of it.
STILL = 0.25


@dataclass(frozen=True)
class Animation:
    document: Document
    frames: int = 48
    fps: float = 24.0
    bindings: tuple[dict, ...] = ()
    variations: tuple[dict, ...] = ()
    speed: int = 1
    phase: float = 0.0
    seed: int = 0

    @classmethod
    def parse(cls, text: str, **timing) -> Animation:
        raw = json.loads(text)
        clock = raw.get("clock", {})
        doc = Document.parse(text)
        return cls(doc, clock.get("frames", 48), clock.get("fps", 24.0), tuple(raw.get("bindings", ())), tuple(raw.get("variations", ())), **timing)

    @property
    def moving(self) -> set[str]:
        """Nodes whose own state changes."""
        return {b["node"] for b in self.bindings} | {v["node"] for v in self.variations if v["mode"] != "static"}

    @property
    def feedback(self) -> list[str]:
        """Enabled nodes that read the frame before; with one the last frame is not followed by the first."""
        return [n.id for n in self.document.nodes.values() if n.enabled and n.effect == "feedback"]

    @property
    def loops(self) -> bool:
        return not self.feedback

    @property
    def still_frame(self) -> int:
        """The frame that stands for the loop."""
        return 0 if self.loops else min(max(self.frames - 1, 0), max(1, math.floor(self.frames * STILL + 0.5)))


def shape_value(shape: str, theta: float, seed: int) -> float:
    """A modulator over its phase, from -1 to 1."""
    theta -= math.floor(theta)
    if shape == "sine":
        return math.sin(2 * math.pi * theta)
    if shape == "triangle":
        return 4 * theta if theta < 0.25 else 2 - 4 * theta if theta < 0.75 else 4 * theta - 4
    if shape == "saw":
        return theta * 2 - 1
    if shape == "square":
        return 1.0 if theta < 0.5 else -1.0
    if shape == "stepped-random":
        return loop.bipolar(seed, min(int(theta * loop.STEPS), loop.STEPS - 1))
    k = int(theta * loop.LATTICE)
    f = theta * loop.LATTICE - k
    a, b = (loop.bipolar(seed, j % loop.LATTICE) for j in (k, k + 1))
    return a + (b - a) * f * f * (3 - 2 * f)


def phase_of(anim: Animation, b: dict, frame: int) -> float:
    x = b.get("cycles", 1) * anim.speed * frame / anim.frames + b.get("phase", 0.0) + anim.phase
    return x - math.floor(x)


def binding_seed(anim: Animation, b: dict) -> int:
    node = anim.document.nodes[b["node"]]
    return loop.fold(anim.seed, node.seed, loop.seed_from_string(b["param"]), loop.seed_from_string(b["shape"]))


def raw_value(anim: Animation, b: dict, frame: int) -> float:
    """A binding before it is rounded and held in its range."""
    node = anim.document.nodes[b["node"]]
    seed = binding_seed(anim, b) if b["shape"] in ("smooth-noise", "stepped-random") else 0
    unit = shape_value(b["shape"], phase_of(anim, b, frame % anim.frames), seed)
    return full_params(node)[b["param"]] + b["amount"] * (unit if b.get("bipolar", True) else (unit + 1) / 2)


def bound_value(anim: Animation, b: dict, frame: int):
    p = EFFECTS[anim.document.nodes[b["node"]].effect].params[b["param"]]
    v = raw_value(anim, b, frame)
    v = math.floor(v + 0.5) if p.kind == "int" else v
    v = min(max(v, p.low), p.high) + 0.0
    return int(v) if p.kind == "int" else v


def faults(anim: Animation) -> list[tuple[str, str]]:
    """(code, where) of all that keeps a document from being animated."""
    nodes, out = anim.document.nodes, []
    if anim.frames < 1 or anim.fps <= 0:
        out.append(("invalid-clock", ""))
    taken = Counter((b["node"], b["param"]) for b in anim.bindings)
    for b in anim.bindings:
        where = f"{b['node']}.{b['param']}"
        node = nodes.get(b["node"])
        p = EFFECTS[node.effect].params.get(b["param"]) if node and node.effect in EFFECTS else None
        if node is None:
            out.append(("unknown-node", where))
        elif node.effect not in EFFECTS:
            out.append(("unknown-effect", where))
        elif p is None:
            out.append(("unknown-parameter", where))
        elif p.kind not in ("float", "int"):
            out.append(("parameter-not-animatable", where))
        elif b["shape"] not in loop.SHAPES:
            out.append(("unknown-shape", where))
        elif not isinstance(b.get("cycles", 1), int) or b.get("cycles", 1) < 1:
            out.append(("invalid-cycles", where))
        elif not math.isfinite(b["amount"]):
            out.append(("non-finite-value", where))
    out += [("duplicate-binding", f"{n}.{p}") for (n, p), k in taken.items() if k > 1]
    for v in anim.variations:
        node, mode = nodes.get(v["node"]), v["mode"]
        if node is None:
            out.append(("unknown-node", v["node"]))
            continue
        if mode not in LEVERS:
            out.append(("unknown-mode", v["node"]))
            continue
        if node.effect not in EFFECTS:
            out.append(("unknown-effect", v["node"]))
            continue
        params = EFFECTS[node.effect].params
        lever = LEVERS[mode]
        can = {
            None: True,
            "seed": any(p.kind == "seed" for p in params.values()),
            "offset": all(k in params for k in OFFSETS),
            "rotation": ROTATION in params and params[ROTATION].low <= 0 and params[ROTATION].high >= 1,
        }
        if not can[lever]:
            out.append(("unsupported-lever", v["node"]))
            continue
        hold, period = v.get("hold", 1), v.get("period", 1)
        if not isinstance(hold, int) or hold < 1 or (mode == "ping-pong" and -(-anim.frames // hold) < 2):
            out.append(("invalid-period", v["node"]))
        elif lever == "offset" and (not isinstance(period, int) or period < 1 or any(params[k].high - params[k].low < period for k in OFFSETS)):
            out.append(("invalid-period", v["node"]))
    varied = Counter(v["node"] for v in anim.variations)
    return out + [("duplicate-variation", n) for n, k in varied.items() if k > 1]


def pattern_at(anim: Animation, v: dict, frame: int) -> dict:
    """What a variation sets at a frame: seed, offset (two numbers) or rotation (turns)."""
    mode, n, i, hold, period = v["mode"], anim.frames, frame % anim.frames, v.get("hold", 1), v.get("period", 1)

    def wrapped(x):
        return x - period * math.floor(x / period)

    if LEVERS[mode] == "seed":
        step, steps = i // hold, -(-n // hold)
        at = min(step, steps - step) if mode == "ping-pong" else i if mode == "per-frame-reseed" else step
        return {"seed": loop.fold(anim.document.nodes[v["node"]].seed, loop.seed_from_string(f"temporal:{mode}"), at)}
    if mode == "blue-noise-cycle":
        return {"offset": [((i // hold) * a % 1.0) * period for a in loop.R2]}
    if mode == "bayer-offset-scroll":
        return {"offset": [wrapped(c * i / n) for c in v["cells"]]}
    if mode == "ign-scroll":
        return {"offset": [wrapped(i * loop.GRADIENT_ADVANCE)] * 2}
    if mode == "bayer-rotation":
        return {"rotation": v["turns"] * i / n % 1.0}
    return {"rotation": i * loop.GOLDEN_TURNS % 1.0} if mode == "golden-ratio-rotation" else {}


def node_at(anim: Animation, id: str, frame: int) -> Node:
    """A node as it is at a frame: bindings first, then the variation, which adds to what they left."""
    node = anim.document.nodes[id]
    params, limits = dict(node.params), EFFECTS[node.effect].params
    for b in anim.bindings:
        if b["node"] == id:
            params[b["param"]] = bound_value(anim, b, frame)
    node = replace(node, params=params)
    for v in anim.variations:
        if v["node"] != id:
            continue
        state, known = pattern_at(anim, v, frame), full_params(node)

        def held(k, x):
            return min(max(x, limits[k].low), limits[k].high)

        if "seed" in state:
            seeds = {k: loop.fold(state["seed"], loop.seed_from_string(k)) for k, p in limits.items() if p.kind == "seed" and EFFECTS[node.effect].access != "serial"}
            node = replace(node, seed=state["seed"], params=params | seeds)
        elif "offset" in state:
            node = replace(node, params=params | {k: held(k, known[k] + x) for k, x in zip(OFFSETS, state["offset"], strict=True)})
        elif "rotation" in state:
            node = replace(node, params=params | {ROTATION: held(ROTATION, (known[ROTATION] + state["rotation"]) % 1.0)})
    return node


def document_at(anim: Animation, frame: int) -> Document:
    """The still document of a frame."""
    return replace(anim.document, nodes={id: node_at(anim, id, frame) for id in anim.document.nodes})


def plan(anim: Animation, source, ctx):
    """The relation of all frames over ``source``, with a frame column; if nothing moves, without one.

    A node's result is a list of parts: frames that look alike there, and their common relation. Parts get
    their frame column where a step reads other frames (feedback), and at the end.
    """
    if wrong := faults(anim) or validate(anim.document):
        raise ValueError(wrong)
    doc, own, every = anim.document, anim.moving, list(range(anim.frames))
    ctx.frames = anim.frames
    known: dict[str | None, list] = {None: [(every, source)]}

    def on(rel, frames):
        if "frame" in rel.columns:
            return rel.where(f"frame in ({', '.join(map(str, frames))})")
        return rel.explode("frame", rel.d.array(f"cast({f} as bigint)" for f in frames))

    def united(parts):
        out = None
        for frames, rel in parts:
            rel = rel if "frame" in rel.columns and len(parts) == 1 else on(rel, frames)
            rel = rel.keep(*sorted(rel.columns))
            out = rel if out is None else out.union(rel)
        return out

    def of(id):
        if id in known:
            return known[id]
        n, base = doc.nodes[id], of(doc.input_of(id))
        if not n.enabled:
            known[id] = base
            return base
        masks = of(doc.input_of(id, "mask")) if n.mask and n.mask["kind"] == "image" else [(every, None)]
        if n.effect == "feedback" and anim.frames > 1:
            base = [(every, united(base))]
        parts = []
        for frames, rel in base:
            alike: dict[tuple, list[int]] = {}
            for f in frames:
                state = content_hash(replace(doc, nodes=doc.nodes | {id: node_at(anim, id, f)}), id) if id in own else ""
                mask = next(i for i, (some, _) in enumerate(masks) if f in some)
                alike.setdefault((state, mask), []).append(f)
            for (_, mask), some in alike.items():
                now, image = node_at(anim, id, some[0]), masks[mask][1]
                framed = "frame" in rel.columns or (image is not None and "frame" in image.columns)
                under = on(rel, some) if framed and (len(some) < len(frames) or "frame" not in rel.columns) else rel
                parts.append((some, laid_over(under, now.effect, full_params(now), ctx, n.blend, n.opacity, n.mask, image)))
        known[id] = parts
        return parts

    parts = of(doc.output)
    return parts[0][1] if len(parts) == 1 else united(parts)


def seam(anim: Animation) -> list[tuple[str, str, str]]:
    """(code, severity, where) of what keeps the last frame from leading into the first, or blurs the way there."""
    out = []
    if anim.feedback:
        out.append(("does-not-loop", "info", ",".join(anim.feedback)))
    for b in anim.bindings:
        where = f"{b['node']}.{b['param']}"
        drift = abs(phase_of(anim, b, 0) - phase_of(anim, b, anim.frames))
        if min(drift, 1 - drift) > 1e-9:
            out.append(("phase-not-periodic", "error", where))
        if 2 * loop.FEATURES[b["shape"]] * b.get("cycles", 1) * anim.speed > anim.frames:
            out.append(("sampled-below-nyquist", "warning", where))
        values = [raw_value(anim, b, f) for f in range(anim.frames)]
        p = EFFECTS[anim.document.nodes[b["node"]].effect].params[b["param"]]
        if min(values) < p.low or max(values) > p.high:
            out.append(("binding-clips", "warning", where))
    for v in anim.variations:
        if "hold" in v and anim.frames % v["hold"]:
            out.append(("hold-does-not-divide", "warning", v["node"]))
        if v["mode"] == "bayer-offset-scroll" and any(c % v["period"] for c in v["cells"]):
            out.append(("scroll-not-period-aligned", "warning", v["node"]))
    return out


def seam_of_frames(rel, issues: list[tuple[str, str, str]]):
    """(image_id, matches): whether frame 0 and frame N of rendered pixels agree, image by image; ``rel`` has both as
    frames 0 and 1. An image that does not match is a ``frame-hash-mismatch``, an error, explained by ``issues`` of that kind or by none."""
    first = rel.where("frame = 0").let(r0="r", g0="g", b0="b", a0="a").keep("image_id", "x", "y", "r0", "g0", "b0", "a0")
    both = rel.where("frame = 1").join(first, ["image_id", "x", "y"])
    known = sum(1 for _, severity, _ in issues if severity == "error")
    out = both.group(["image_id"], odd="sum(case when r = r0 and g = g0 and b = b0 and a = a0 then 0 else 1 end)")
    return out.let(matches="odd = 0", code="case when odd > 0 then 'frame-hash-mismatch' end", explained_by=str(known)).keep("image_id", "matches", "code", "explained_by")
