"""Document files: round trips, migration, canonical form and errors by row."""

import json

import pytest

from pixelmill import catalog  # noqa: F401  (registers the effects)
from pixelmill.operators.context import Context
from pixelmill.plans import animate, codec
from pixelmill.plans.rel import Spark

STACK = [
    {"id": "a", "effect": "levels", "params": {"outputWhite": 0.9, "gamma": 1.5}, "unknown": 1},
    {"id": "b", "effect": "curves", "params": {"curve": [{"y": 0.0, "x": 0.0}, {"x": 1.0, "y": 0.8}]}, "opacity": 1.0, "seed": 7.0},
    {"id": "c", "effect": "bayer-4", "mask": {"invert": True, "source": {"kind": "luminance", "low": 0.1, "high": 0.9, "feather": 0, "more": 2}}},
]
OLD = {"schema": 1, "stack": STACK, "clock": {"fps": 12.0, "frames": 6}}


def test_migration_makes_the_chain():
    new = codec.decoded(json.dumps(OLD))
    assert new["edges"] == [{"from": "a", "to": "b", "port": "in"}, {"from": "b", "to": "c", "port": "in"}] and new["output"] == "c" and new["schema"] == 2
    assert codec.decoded(json.dumps({"schema": 1, "stack": []}))["output"] is None
    assert list(new) == ["schema", "source", "palette", "clock", "stack", "edges", "output", "bindings"]


def test_canonical_form():
    """One text for all spellings of a document; decoding and encoding again changes nothing."""
    text = codec.encoded(codec.decoded(json.dumps(OLD)))
    assert codec.encoded(codec.decoded(text)) == text and text.endswith("}\n")
    shuffled = {"bindings": [], "surplus": 3, "edges": [{"to": "c", "from": "b"}, {"port": "in", "to": "b", "from": "a"}], "output": "c", "schema": 2.0, "clock": {"frames": 6, "fps": 12},
        "stack": [dict(reversed(n.items())) for n in STACK]}
    assert codec.encoded(codec.decoded(json.dumps(shuffled))) == text
    node = codec.decoded(text)["stack"][1]
    assert list(node) == ["id", "effect", "enabled", "opacity", "blend", "params", "seed"] and node["seed"] == 7 and '"opacity": 1,' in text
    assert list(codec.decoded(text)["stack"][0]["params"]) == ["gamma", "outputWhite"] and '"feather": 0\n' in text


def test_a_document_runs(spark):
    raw = {"schema": 1, "stack": [{"id": "a", "effect": "levels", "params": {"gamma": 1.5}}, {"id": "b", "effect": "bayer-4"}], "clock": {"frames": 2, "fps": 1},
        "bindings": [{"nodeId": "a", "param": "gamma", "shape": "square", "amount": 0.5}]}
    anim = codec.planned(codec.decoded(json.dumps(raw)))
    source = Spark(spark, "").values(["image_id", "x", "y", "w", "h", "r", "g", "b", "a"], [(0, x, 0, 4, 1, x / 4, x / 5, x / 6, 1.0) for x in range(4)])
    assert animate.faults(anim) == [] and animate.plan(anim, source, Context(source)).df.count() == 8


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (None, "not-json: empty"), (" ", "not-json: empty"), ("{", "not-json"), ("[1]", "unrecognised-file: list"), ('{"presets": []}', "unrecognised-file: presets"), ("{}", "unrecognised-file: no schema or stack"),
        ('{"schema": 3, "stack": []}', "unrecognised-file: schema 3"), ('{"schema": true, "stack": []}', "unrecognised-file: schema True"), ('{"schema": 1, "stack": [4]}', "unrecognised-file: stack[0]"),
        ('{"schema": 1, "stack": [{"id": ""}]}', "unrecognised-file: stack[0]"), ('{"schema": 2, "stack": [{"id": "a", "effect": "none"}]}', "unknown-effect: none"),
        ('{"schema": 2, "stack": [{"id": "a", "effect": "invert", "opacity": "x"}]}', "wrong-type: stack[0].opacity"), ('{"schema": 2, "stack": [{"id": "a", "effect": "invert"}, {"id": "a", "effect": "invert"}]}', "duplicate-node"),
        ('{"schema": 2, "stack": [], "edges": [1]}', "wrong-type: AttributeError"), ('{"schema": 2, "stack": [], "output": 4}', "wrong-type: document.output"),
    ],
)
def test_errors(text, error):
    try:
        codec.decoded(text)
    except codec.FileError as e:
        assert str(e) == error
    except AttributeError:
        assert error == "wrong-type: AttributeError"
    else:
        raise AssertionError(text)


def test_table(spark):
    rows = [(1, json.dumps(OLD)), (2, "{"), (3, None), (1, json.dumps(OLD)), (4, json.dumps({"schema": 2, "stack": STACK[:1], "output": "z"})), (5, '{"schema": 2, "stack": [], "edges": [1]}')]
    got = sorted(map(tuple, codec.decode_table(spark.createDataFrame(rows, "key long, body string")).collect()), key=str)
    text = codec.encoded(codec.decoded(json.dumps(OLD)))
    assert got[0] == got[1] == (1, 1, text, "", None)
    assert got[2] == (2, None, None, None, "not-json") and got[3] == (3, None, None, None, "not-json: empty")
    assert got[4][0] == 4 and got[4][3] == "output-missing" and got[4][4] is None
    assert got[5] == (5, None, None, None, "wrong-type: AttributeError")
    assert codec.decode_table(spark.createDataFrame([], "key long, body string")).count() == 0
