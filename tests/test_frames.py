"""Every effect over frames equals the effect over each frame on its own, on an image that is not square."""

import random

import duckdb
import pytest

from pixelmill import catalog
from pixelmill.operators import compositing, diffusion
from pixelmill.operators.context import Context
from pixelmill.operators.registry import EFFECTS, apply
from pixelmill.plans.rel import Duck, Spark
from pixelmill.sources.rasters import result

W, H, N = 9, 6, 3
COLUMNS = ["image_id", "frame", "x", "y", "w", "h", "r", "g", "b", "a"]
SERIAL = [*diffusion.KERNELS, "ostromoukhov", "riemersma"]
RELATIONAL = [id for id, e in EFFECTS.items() if e.slot != "source" and id not in (*SERIAL, "feedback")]


def pixels():
    rng = random.Random(5)
    return [(0, f, x, y, W, H, rng.random(), rng.random(), rng.random(), rng.choice([1.0, 0.5])) for f in range(N) for y in range(H) for x in range(W)]


def run(src, rel, id, params):
    e = EFFECTS[id]
    ctx = Context(src)
    if "tile" in e.needs:
        ctx.tile_size = (2, 2)
        ctx.tile = src.values(["tx", "ty", "value"], [(0, 0, 0.1), (1, 0, 0.6), (0, 1, 0.8), (1, 1, 0.3)])
    if e.requires_index:
        rel = apply(rel, "bayer-4", {}, ctx)
    return result(apply(rel, id, params, ctx))


def rows(rel, src, fetch):
    columns = rel.columns
    return sorted([tuple(dict(zip(columns, r, strict=True))[c] for c in ("x", "y", "r", "g", "b", "a", *(["idx"] if "idx" in columns else []))) for r in fetch(rel)])


def same_by_frame(src, fetch, act):
    every = src.values(COLUMNS, pixels())
    together = act(every)
    assert "frame" in together.columns
    found = 0
    for f in range(N):
        one = act(every.where(f"frame = {f}").drop("frame"))
        got = rows(together.where(f"frame = {f}").drop("frame"), src, fetch)
        want = rows(one, src, fetch)
        assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(got, want, strict=True))
        found += len(want)
    return found


@pytest.mark.parametrize("id", RELATIONAL)
def test_effect(id):
    con = duckdb.connect()
    found = same_by_frame(Duck(), lambda rel: con.sql(rel.sql()).fetchall(), lambda rel: run(Duck(), rel, id, catalog.EXAMPLES.get(id, {})))
    assert found >= N * W * H or id == "internal-resolution"


def test_composite_and_mask():
    con = duckdb.connect()
    mask = {"kind": "image", "channel": "green"}

    def act(rel):
        top = apply(rel, "invert", {})
        return result(compositing.composite(rel, top, "screen", 0.7, mask, rel))

    assert same_by_frame(Duck(), lambda rel: con.sql(rel.sql()).fetchall(), act) == N * W * H


@pytest.mark.parametrize("id", ["floyd-steinberg", "ostromoukhov", "riemersma", "row-displacement"])
def test_on_spark(spark, id):
    src = Spark(spark, "")
    found = same_by_frame(src, lambda rel: [tuple(r) for r in rel.df.collect()], lambda rel: run(src, rel, id, catalog.EXAMPLES.get(id, {})))
    assert found == N * W * H
