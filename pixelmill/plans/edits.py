"""Edits of effect graphs: a log of them is replayed, document by document, each edit accepted or refused with a code.

The log is dealt out by document and sorted within; a task walks it in order and holds
one graph at a time, so a document may have any number of edits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.effects import EFFECTS

MAIN, MASK, FEEDBACK = "in", "mask", "feedback"


def ports_of(effect: str) -> tuple[str, ...]:
    """The inputs of an effect: sources read no image, only feedback reads the frame before."""
    e = EFFECTS[effect]
    return (*(() if e.slot == "source" else (MAIN, MASK)), *((FEEDBACK,) if effect == "feedback" else ()))


@dataclass
class Graph:
    """nodes: id -> effect; inputs: (node, port) -> producer; masked: nodes whose mask is an image."""

    nodes: dict[str, str] = field(default_factory=dict)
    inputs: dict[tuple[str, str], str] = field(default_factory=dict)
    masked: set[str] = field(default_factory=set)
    output: str | None = None

    def reaches(self, start: str, goal: str) -> bool:
        """Whether ``goal`` lies behind ``start`` within a frame; walked back from the goal, over its inputs alone."""
        seen, todo = set(), [goal]
        while todo:
            at = todo.pop()
            if at == start:
                return True
            if at not in seen:
                seen.add(at)
                todo += [self.inputs[at, p] for p in (MAIN, MASK) if (at, p) in self.inputs]
        return False

    def refusal(self, source: str, target: str, port: str) -> str | None:
        """Why an edge cannot be; what is on the port already is a reason too."""
        if source not in self.nodes or target not in self.nodes:
            return "unknown-node"
        if self.nodes[target] not in EFFECTS:
            return "unknown-effect"
        if port not in ports_of(self.nodes[target]):
            return "unknown-port"
        if port == FEEDBACK:
            return None if source == target else "unsupported-feedback"
        if source == target:
            return "self-edge"
        if port == MASK and target not in self.masked:
            return "mask-not-wanted"
        if self.reaches(target, source):
            return "would-cycle"
        return "port-occupied" if self.inputs.get((target, port), source) != source else None

    def connect(self, source: str, target: str, port: str) -> str | None:
        """Puts an edge on a port, in place of the one that is there; the code if it is refused, and then nothing changes."""
        before = self.inputs.pop((target, port), None)
        code = self.refusal(source, target, port)
        if code is None:
            self.inputs[target, port] = source
        elif before is not None:
            self.inputs[target, port] = before
        return code

    def disconnect(self, target: str, port: str) -> str | None:
        return None if self.inputs.pop((target, port), None) else "nothing-connected"

    def add(self, node: str, effect: str, after: str | None) -> str | None:
        """A node on its own, or behind ``after``, whose readers then read it."""
        if node in self.nodes:
            return "duplicate-node-id"
        if after is not None and after not in self.nodes:
            return "unknown-node"
        self.nodes[node] = effect
        if after is None:
            self.output = self.output or node
            return None
        self.inputs = {k: node if v == after and k[1] != FEEDBACK else v for k, v in self.inputs.items()}
        self.inputs[node, MAIN] = after
        self.output = node if self.output == after else self.output
        return None

    def remove(self, node: str) -> str | None:
        """A node goes; its readers read what it read. If it read nothing they are left without, and a mask that
        was its picture is no longer one. An output that was it becomes what it read, else the newest node left."""
        if node not in self.nodes:
            return "unknown-node"
        above = self.inputs.get((node, MAIN))
        kept = {}
        for (target, port), source in self.inputs.items():
            if target == node:
                continue
            if source != node:
                kept[target, port] = source
            elif above is not None:
                kept[target, port] = above
            elif port == MASK:
                self.masked.discard(target)
        self.inputs = kept
        del self.nodes[node]
        self.masked.discard(node)
        if self.output == node:
            self.output = above or next(reversed(self.nodes), None)
        return None

    def show(self, node: str | None) -> str | None:
        """Makes a node the output, or none."""
        if node is not None and node not in self.nodes:
            return "unknown-node"
        self.output = node
        return None

    def edit(self, op: str, a: str | None, b: str | None, port: str | None) -> str | None:
        """connect a -> b on port; disconnect b's port; add node a with effect b behind port; remove a; output a; mask a by image on or off (b)."""
        if op == "connect":
            return self.connect(a, b, port)
        if op == "disconnect":
            return self.disconnect(b, port)
        if op == "add":
            return self.add(a, b, port)
        if op == "remove":
            return self.remove(a)
        if op == "output":
            return self.show(a)
        if op == "mask":
            if a not in self.nodes:
                return "unknown-node"
            self.masked = self.masked | {a} if b == "on" else self.masked - {a}
            if b != "on":
                self.inputs.pop((a, MASK), None)
            return None
        return "unknown-edit"

    def edges(self) -> str:
        """All edges, in order."""
        return ",".join(f"{s}>{t}.{p}" for (t, p), s in sorted(self.inputs.items()))


def replay(log: DataFrame) -> DataFrame:
    """(doc, nth, op, a, b, port) -> (doc, nth, code, nodes, edges, output): every edit in the order of nth (null first, then by
    its fields), why it was refused (null: accepted), and the graph after it. Repeated edits are edits of their own."""
    columns = ["doc", "nth", "op", "a", "b", "port"]

    def run(batches):
        graph, last, begun = Graph(), None, False
        for batch in batches:
            out = []
            for doc, nth, *edit in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if not begun or doc != last:
                    graph, last, begun = Graph(), doc, True
                code = graph.edit(*edit)
                out.append((doc, nth, code, len(graph.nodes), graph.edges(), graph.output))
            rows = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc", "nth", "code", "nodes", "edges", "output"])

    kinds = dict(log.dtypes)
    ordered = log.select(*columns).repartition("doc").sortWithinPartitions(*columns)
    return ordered.mapInArrow(run, f"doc {kinds['doc']}, nth {kinds['nth']}, code string, nodes long, edges string, output string")


def final_edges(log: DataFrame) -> DataFrame:
    """(doc, edges, output) of each document after its last edit."""
    state = replay(log)
    last = state.groupBy("doc").agg(F.max_by(F.struct("edges", "output"), F.struct("nth", "nodes")).alias("s"))
    return last.select("doc", "s.edges", "s.output")
