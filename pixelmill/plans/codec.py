"""Document files: a table of JSON texts -> canonical documents of the current schema, or each row's error.

Schema 1 is a linear stack; its migration makes the chain's edges. Schema 2 is a graph.
The canonical form has its keys in a fixed order, parameters and edges sorted and numbers
as short as they can be, so equal documents have equal texts, and decoding what was
encoded gives the same text again.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.effects import EFFECTS
from pixelmill.plans.animate import Animation, faults, seam
from pixelmill.plans.document import Document, validate

LINEAR, CURRENT = 1, 2
#: The port that a migrated chain uses, and its name in a planned document.
MAIN = "in"
DEFAULT_PALETTE = {"id": "mono", "name": "Black & White", "colors": [0, 0, 0, 255, 255, 255], "metric": "oklab"}
DEFAULT_CLOCK = {"frames": 48, "fps": 24}


class FileError(ValueError):
    def __init__(self, code: str, where: str = ""):
        super().__init__(f"{code}: {where}" if where else code)
        self.code = code


def parsed(text: str | None) -> dict:
    """The JSON object of a document file."""
    if not (text or "").strip():
        raise FileError("not-json", "empty")
    try:
        value = json.loads(text)
    except ValueError as e:
        raise FileError("not-json") from e
    if not isinstance(value, dict):
        raise FileError("unrecognised-file", type(value).__name__)
    if isinstance(value.get("presets"), list):
        raise FileError("unrecognised-file", "presets")
    if "schema" not in value or not isinstance(value.get("stack"), list):
        raise FileError("unrecognised-file", "no schema or stack")
    return value


def migrated(raw: dict) -> dict:
    """``raw`` in the current schema; a current document is returned as it is."""
    schema = raw["schema"]
    if schema == CURRENT and not isinstance(schema, bool):
        return raw
    if schema != LINEAR or isinstance(schema, bool):
        raise FileError("unrecognised-file", f"schema {schema}")
    ids = []
    for i, node in enumerate(raw["stack"]):
        if not isinstance(node, dict) or not isinstance(node.get("id"), str) or not node["id"]:
            raise FileError("unrecognised-file", f"stack[{i}]")
        ids.append(node["id"])
    edges = [{"from": a, "to": b, "port": MAIN} for a, b in zip(ids, ids[1:], strict=False)]
    return raw | {"schema": CURRENT, "edges": edges, "output": ids[-1] if ids else None}


def _number(v):
    return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 2**53 else v


def _take(raw: dict, where: str, **kinds) -> dict:
    """The named fields of ``raw``, in order; kinds: type, or (type, default)."""
    out = {}
    for key, kind in kinds.items():
        kind, *default = kind if isinstance(kind, tuple) else (kind,)
        v = raw.get(key, default[0] if default else None)
        if kind is float:
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or v in (float("inf"), float("-inf")):
                raise FileError("wrong-type", f"{where}.{key}")
            v = _number(v)
        elif kind is int:
            v = _number(v)
            if isinstance(v, bool) or not isinstance(v, int):
                raise FileError("wrong-type", f"{where}.{key}")
        elif not isinstance(v, kind):
            raise FileError("wrong-type", f"{where}.{key}")
        out[key] = v
    return out


MASKS = {
    "luminance": {"low": float, "high": float, "feather": float},
    "color": {"color": list, "tolerance": float, "feather": float},
    "image": {"channel": str},
}


def _mask(raw: dict, where: str) -> dict:
    source = _take(raw, where, source=dict)["source"]
    kind = _take(source, where, kind=str)["kind"]
    if kind not in MASKS:
        raise FileError("wrong-type", f"{where}.mask")
    return {"source": {"kind": kind, **_take(source, where, **MASKS[kind])}, "invert": _take(raw, where, invert=(bool, False))["invert"]}


def _param(v):
    if isinstance(v, list):
        return [{"x": _number(p["x"]), "y": _number(p["y"])} if isinstance(p, dict) else _number(p) for p in v]
    return _number(v)


def _node(raw, i: int) -> dict:
    where = f"stack[{i}]"
    if not isinstance(raw, dict):
        raise FileError("wrong-type", where)
    n = _take(raw, where, id=str, effect=str, enabled=(bool, True), opacity=(float, 1), blend=(str, "normal"), params=(dict, {}), seed=(int, 0))
    if n["effect"] not in EFFECTS:
        raise FileError("unknown-effect", n["effect"])
    n["params"] = {k: _param(n["params"][k]) for k in sorted(n["params"])}
    return n | ({"mask": _mask(raw["mask"], where)} if raw.get("mask") is not None else {})


def canonical(raw: dict) -> dict:
    """A current document with its fields in order; defaults for what may be missing; unknown fields are dropped."""
    d = _take(raw, "document", schema=int, palette=(dict, DEFAULT_PALETTE), clock=(dict, DEFAULT_CLOCK), stack=list, edges=(list, []), bindings=(list, []))
    source, output = raw.get("source"), raw.get("output")
    if output is not None and not isinstance(output, str):
        raise FileError("wrong-type", "document.output")
    if source is not None:
        source = _take(source, "source", name=str, width=int, height=int) | ({"dataUrl": source["dataUrl"]} if "dataUrl" in source else {})
    edges = [_take(e, f"edges[{i}]", **{"from": str, "to": str, "port": (str, MAIN)}) for i, e in enumerate(d["edges"])]
    bound = [_take(b, f"bindings[{i}]", nodeId=str, param=str, shape=str, amount=float, cyclesPerLoop=(int, 1), phase=(float, 0), bipolar=(bool, True)) for i, b in enumerate(d["bindings"])]
    nodes = [_node(n, i) for i, n in enumerate(d["stack"])]
    if len({n["id"] for n in nodes}) < len(nodes):
        raise FileError("duplicate-node")
    return {
        "schema": d["schema"],
        "source": source,
        "palette": _take(d["palette"], "palette", id=str, name=str, colors=list, metric=str),
        "clock": _take(d["clock"], "clock", frames=int, fps=float),
        "stack": nodes,
        "edges": sorted(edges, key=lambda e: (e["to"], e["port"], e["from"])),
        "output": output,
        "bindings": bound,
    } | ({"surpriseSeed": raw["surpriseSeed"]} if isinstance(raw.get("surpriseSeed"), int) else {})


def encoded(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def decoded(text: str | None) -> dict:
    """The canonical current document of a file; ``FileError`` if it is none."""
    return canonical(migrated(parsed(text)))


def planned(document: dict) -> Animation:
    """A canonical document as one that can be planned."""
    nodes = []
    for n in document["stack"]:
        mask = n.get("mask")
        params = {k: [(p["x"], p["y"]) for p in v] if isinstance(v, list) else v for k, v in n["params"].items()}
        nodes.append(n | {"params": params, "mask": mask and mask["source"] | {"invert": mask["invert"]}})
    edges = [e | {"port": "image" if e["port"] == MAIN else e["port"]} for e in document["edges"]]
    text = json.dumps({"stack": nodes, "edges": edges, "output": document["output"]})
    bindings = tuple({"node": b["nodeId"], "cycles": b["cyclesPerLoop"], **{k: b[k] for k in ("param", "shape", "amount", "phase", "bipolar")}} for b in document["bindings"])
    return Animation(Document.parse(text), document["clock"]["frames"], document["clock"]["fps"], bindings)


def problems(document: dict) -> list[str]:
    """Codes of what keeps a readable document from being run."""
    return sorted({code for code, _ in validate(planned(document).document)})


def decode_table(files: DataFrame) -> DataFrame:
    """(id, text) -> (id, schema, document, problems, error): a row each; ``document`` is the canonical text of the current
    schema, ``schema`` the one it was read in, ``problems`` the codes of a graph that does not run. A file that cannot be
    read has only its ``error``; a null text is an empty file. Repeated rows get equal results."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    raw = parsed(text)
                    document = canonical(migrated(raw))
                    out.append((raw["schema"], encoded(document), ",".join(problems(document)), None))
                except FileError as e:
                    out.append((None, None, None, str(e)))
                except (KeyError, TypeError, AttributeError, RecursionError) as e:  # a field of another shape
                    out.append((None, None, None, f"wrong-type: {type(e).__name__}"))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "schema", "document", "problems", "error"])

    own = files.select(F.col(files.columns[0]).alias("id"), F.col(files.columns[1]).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, schema long, document string, problems string, error string")


def seam_table(files: DataFrame) -> DataFrame:
    """(id, text) -> (id, code, severity, place): a row for everything that keeps a document's loop from closing or blurs
    it. A file that cannot be read, or an animation that cannot be planned, has one row with its first fault, an error."""

    def issues(text):
        try:
            anim = planned(decoded(text))
            wrong = faults(anim)
            return [(wrong[0][0], "error", wrong[0][1])] if wrong else seam(anim)
        except FileError as e:
            return [(e.code, "error", "")]
        except (KeyError, TypeError, AttributeError, RecursionError):
            return [("wrong-type", "error", "")]

    def run(batches):
        for batch in batches:
            out = [(id_, *x) for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in issues(text)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "code", "severity", "place"])

    own = files.select(F.col(files.columns[0]).alias("id"), F.col(files.columns[1]).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, code string, severity string, place string")
