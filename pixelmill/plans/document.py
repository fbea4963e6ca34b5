"""Effect graphs: documents, their checks and content hashes, and the plan that runs them.

A document is JSON: ``stack`` (nodes: id, effect, params, enabled, opacity, blend, mask, seed), ``edges``
(from, to, port) and ``output``. Planning walks back from the output, so nodes it does
not need never run; equal subgraphs (by content hash) give the same relation, so Spark
sees one subplan; disabled nodes pass their input through.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pixelmill.operators.compositing import laid_over, mask_problem
from pixelmill.operators.registry import EFFECTS, problems

PORTS = ("image", "mask", "feedback")


@dataclass(frozen=True)
class Node:
    id: str
    effect: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    opacity: float = 1.0
    blend: str = "normal"
    mask: dict | None = None
    seed: int = 0


@dataclass(frozen=True)
class Document:
    nodes: dict[str, Node]
    edges: tuple[tuple[str, str, str], ...]
    output: str

    @classmethod
    def parse(cls, text: str) -> Document:
        raw = json.loads(text)
        nodes = {n["id"]: Node(**n) for n in raw["stack"]}
        if len(nodes) < len(raw["stack"]):
            raise ValueError("two nodes share an id")
        return cls(nodes, tuple((e["from"], e["to"], e.get("port", "image")) for e in raw["edges"]), raw["output"])

    def input_of(self, node: str, port: str = "image") -> str | None:
        return next((a for a, b, p in self.edges if b == node and p == port), None)


def full_params(n: Node) -> dict:
    """A node's parameters with defaults; the node's seed is that of effects which draw in order, unless given."""
    e = EFFECTS[n.effect]
    own = {"seed": n.seed} if e.access == "serial" and "seed" in e.params else {}
    return {k: p.default for k, p in e.params.items()} | own | n.params


def validate(doc: Document) -> list[tuple[str, str]]:
    """(code, node) of every fault; an empty list is a document that runs."""
    out = []
    if doc.output not in doc.nodes:
        out.append(("output-missing", doc.output))
    for a, b, port in doc.edges:
        if a not in doc.nodes or b not in doc.nodes:
            out.append(("edge-endpoint-missing", f"{a}->{b}"))
        if port not in PORTS:
            out.append(("unknown-port", b))
    taken = [(b, p) for _, b, p in doc.edges]
    out += [("port-taken-twice", b) for b, p in sorted(set(taken)) if taken.count((b, p)) > 1]
    for n in doc.nodes.values():
        e = EFFECTS.get(n.effect)
        if e is None:
            out.append(("unknown-effect", n.id))
            continue
        out += [(code, f"{n.id}.{k}") for code, k in problems(n.effect, n.params)]
        source = doc.input_of(n.id)
        if e.slot == "source" and source:
            out.append(("source-with-input", n.id))
        if e.requires_index and not (source in doc.nodes and _has_index(doc, source)):
            out.append(("index-map-missing", n.id))
        if e.resamples and (n.opacity != 1 or n.blend != "normal" or n.mask):
            out.append(("resampling-cannot-composite", n.id))
        if not 0 <= n.opacity <= 1:
            out.append(("opacity-range", n.id))
        if n.mask and (code := mask_problem(n.mask)):
            out.append((code, n.id))
        if n.mask and n.mask["kind"] == "image" and not doc.input_of(n.id, "mask"):
            out.append(("mask-input-missing", n.id))
    state: dict[str, int] = {}

    def visit(k):
        if state.get(k) == 1:
            out.append(("cycle", k))
        if state.get(k):
            return
        state[k] = 1
        for a, b, port in doc.edges:
            if b == k and port != "feedback" and a in doc.nodes:
                visit(a)
        state[k] = 2

    for k in doc.nodes:
        visit(k)
    return out


def _has_index(doc: Document, node: str) -> bool:
    """Whether an index map leaves the node: made by it, or passed on by a step that keeps indices."""
    seen = set()
    while node and node not in seen:
        seen.add(node)
        n = doc.nodes[node]
        if n.enabled and EFFECTS[n.effect].produces_index:
            return True
        if n.enabled and n.effect != "nn-upscale":
            return False
        node = doc.input_of(node)
    return False


def content_hash(doc: Document, node: str | None) -> str:
    """SHA-256 over an effect, its parameters in order, composite, mask and inputs; ids and frames stay out."""
    if node is None:
        return hashlib.sha256(b"source").hexdigest()
    n = doc.nodes[node]
    inputs = [content_hash(doc, doc.input_of(node, p)) if doc.input_of(node, p) or p == "image" else "" for p in ("image", "mask")]
    if not n.enabled:
        return inputs[0]
    parts = [n.effect, n.seed, n.opacity, n.blend, n.mask, sorted(n.params.items()), inputs]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def plan(doc: Document, source, ctx):
    """The relation of the document's output over ``source``."""
    if faults := validate(doc):
        raise ValueError(faults)
    known: dict[str, object] = {}

    def of(node):
        if node is None:
            return source
        h = content_hash(doc, node)
        if h not in known:
            n = doc.nodes[node]
            base = of(doc.input_of(node))
            if not n.enabled:
                return base
            image = of(doc.input_of(node, "mask")) if n.mask and n.mask["kind"] == "image" else None
            known[h] = laid_over(base, n.effect, full_params(n), ctx, n.blend, n.opacity, n.mask, image)
        return known[h]

    return of(doc.output)
