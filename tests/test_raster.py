"""Raster engine: oracles on a sample of queries, and properties that need no stored image."""

import itertools

import duckdb
import numpy as np
import pytest

from pixelmill import catalog
from pixelmill.functions import color
from pixelmill.operators import animation, census, diffusion, dithers, extract, spatial
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import EFFECTS, coerce, problems
from pixelmill.plans.rel import Spark

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize(
    "name",
    ["flagship_census", "fx_levels", "fx_grain", "fx_blur", "fx_pixel_sort", "fx_glyph_tile", "fx_floyd_steinberg", "fx_riemersma", "mask_color", "animation_keyframes", "trace_regions", "raster_events", "document_render"],
)
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    expect = duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(expect.columns) and len(got) == len(expect)
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = expect[cols].sort_values(cols).reset_index(drop=True)
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_every_query_but_a_few_has_an_oracle():
    """Extraction is held by clusters with known means, SVG documents by their text (test_contours.py), edits by a plain replay (test_edits.py)."""
    without = {f"palette_extract_{m}" for m in ("median_cut", "wu", "k_means")} | {"trace_svg", "graph_edits"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == without
    assert len(EFFECTS) >= 72


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["image_id", "idx", "pixels"] and rows.groupBy("image_id").sum("pixels").where("`sum(pixels)` <> 64").isEmpty()


def test_bayer_matrix_and_tiles_are_permutations():
    assert dithers.bayer_ranks(4) == [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]
    for n in (2, 8, 16):
        assert sorted(dithers.bayer_ranks(n)) == list(range(n * n))
    assert sorted(dithers.blue_noise_ranks()) == list(range(4096))
    for cell in (2, 5, 8):
        for diagonal in (True, False):
            side, ranks = dithers.clustered_ranks(cell, diagonal)
            assert sorted(ranks) == list(range(side * side))


def test_pcg32_known_vector():
    rng = dithers.Pcg32(42, 54)
    assert [rng.next_u32() for _ in range(3)] == [0xA15C02B7, 0x7B47F409, 0xBA1D3330]


@pytest.mark.parametrize("kernel", [k for k in (*diffusion.KERNELS, "ostromoukhov", "riemersma") if k != "atkinson"])
def test_diffusion_keeps_the_mean(kernel):
    p = {"serpentine": True, "strength": 1.0, "jitter": 0.0, "overshootLimit": 1.0, "channels": "per-channel", "seed": 0}
    for level in (0.2, 0.5, 0.8):
        idx = diffusion.diffuse(np.full((1, 48 * 48, 3), level), 48, 48, kernel, p, Palette.of("mono"))
        assert abs(idx.mean() - level) < 0.05


def test_hilbert_steps_and_covers():
    for w, h in ((8, 8), (16, 16)):
        o = diffusion.hilbert(w, h)
        assert sorted(o) == list(range(w * h))
        assert all(abs(a % w - b % w) + abs(a // w - b // w) == 1 for a, b in zip(o, o[1:], strict=False))
    for w, h in ((1, 7), (13, 5), (37, 23)):
        assert sorted(diffusion.hilbert(w, h)) == list(range(w * h))


def test_tap_weights():
    for k in diffusion.KERNELS:
        assert abs(sum(w for *_, w in diffusion.taps(k)) - (0.75 if k == "atkinson" else 1)) < 1e-12
    assert all(abs(sum(s) - 1) < 1e-12 for s in diffusion.level_shares())


def test_block_permutation_is_an_involution():
    out = spatial.block_permutation(7, 5, 0.6, 3)
    assert sorted(out) == list(range(35)) and all(out[out[b]] == b for b in range(35))


def test_slices_cover_the_side_once(spark):
    rel = Spark(spark, "").values(["h", "one"], [(100, 1), (37, 1), (100, 2)])
    rows = spatial.slices(rel, "y", "h", {"seed": 5, "probability": 0.5}, 0.05, 0.2).df.collect()
    for side in (100, 37):
        own = sorted((r.y, r.moved, r.draw) for r in rows if r.h == side)
        assert [y for y, *_ in own] == list(range(side))
        runs = [len(list(g)) for _, g in itertools.groupby(own, key=lambda r: r[1:])]
        assert all(round(0.05 * side) <= n <= round(0.2 * side) for n in runs[:-1])


def test_parameters_are_checked_and_coerced():
    assert problems("levels", {"gamma": 1.0}) == []
    assert problems("levels", {"gamma": 100.0, "nope": 1}) == [("unknown-param", "nope"), ("out-of-range", "gamma")]
    assert problems("nothing", {}) == [("unknown-effect", "nothing")]
    assert coerce("posterize", {"levels": 99, "mode": 5})["levels"] == 64


def test_seam_report():
    ok = {"shape": "sine", "cycles": 2, "base": 0.0, "amount": 0.5, "legal": (-1, 1)}
    assert animation.seam_report([ok], 48) == []
    bad = [ok | {"cycles": 1.5}, ok | {"shape": "stepped-random", "cycles": 4}, ok | {"amount": 3}]
    assert [c for _, c, _ in animation.seam_report(bad, 48)] == ["phase-drift", "undersampled", "clipped"]


def test_extraction_counts_every_pixel(spark):
    for method in ("median_cut", "wu", "k_means"):
        rows = catalog.queries()[f"palette_extract_{method}"](spark, SF)
        assert rows.groupBy("image_id").sum("pixels").where("`sum(pixels)` <> 64").isEmpty()
        assert rows.where("entry >= 4 or r < 0 or r > 1").isEmpty() and rows.select("image_id").distinct().count() == 500


def test_extraction_finds_separate_clusters():
    """Four tight clusters of unequal weight: every method returns their means; ties and too many entries are harmless."""
    rng = np.random.default_rng(2)
    centres = np.array([[0.05, 0.1, 0.6], [0.9, 0.2, 0.1], [0.3, 0.8, 0.3], [0.95, 0.95, 0.9]])
    which = np.repeat(np.arange(4), (50, 200, 120, 30))
    rgb = np.clip(centres[which] + rng.normal(0, 0.004, (400, 3)), 0, 1)
    lms = np.cbrt(rgb @ np.array(color.TO_LMS).T)
    lab = lms @ np.array(color.TO_LAB).T
    low, size = lab.min(0), np.ptp(lab, axis=0)
    place = np.minimum((lab - low) / size * 32, 31).astype(int) @ [1024, 32, 1]
    rows = []
    for b in np.unique(place):
        own = place == b
        rows.append([b, own.sum(), *rgb[own].mean(0), *lab[own].mean(0), (lab[own] ** 2).sum(1).mean()])
    want = np.array(sorted(rgb[which == k].mean(0).tolist() for k in range(4)))
    for method in ("wu", "k-means"):
        found = np.array(sorted(extract.entries_of(np.array(rows), 4, method, 3).tolist()))
        assert np.allclose(found, want, atol=1e-9), method
    cut = extract.median_cut(extract.Bins(np.array(rows)), 4, 0)
    assert sorted(np.concatenate(cut)) == list(range(len(rows)))
    flat = np.array([[5, 9, 0.2, 0.2, 0.2, 0.5, 0, 0, 0.25]])
    assert all(len(extract.entries_of(flat, 6, m, 0)) == 1 for m in extract.METHODS)


def test_median_cut_splits_at_the_weighted_median():
    rows = np.array([[k, n, k / 10, 0, 0, k / 10, 0, 0, k * k / 100] for k, n in enumerate((1, 1, 8, 1, 1))], float)
    assert [b.tolist() for b in extract.median_cut(extract.Bins(rows), 2, 0)] == [[0, 1, 2], [3, 4]]


def test_temporal_values(spark):
    """Numbers worked out by hand from the definitions."""
    src = Spark(spark, "")

    def at(mode, frame, **v):
        return next(r for r in animation.temporal(src, mode, 24, **v).df.collect() if r.frame == frame)

    assert at("blue-noise-cycle", 0, period=64).ox == 0
    assert abs(at("blue-noise-cycle", 2, period=64).oy - 64 * (2 * 0.5698402909980533 - 1)) < 1e-9
    assert at("bayer-offset-scroll", 6, cells=(8, -16), period=8).ox == 2 and at("bayer-offset-scroll", 9, cells=(8, -16), period=8).oy == 2
    r = at("ign-scroll", 23, period=64)
    assert r.ox == r.oy and abs(r.ox - (23 * 5.588238 - 128)) < 1e-9
    assert abs(at("golden-ratio-rotation", 1).turns - 0.3819660112501051) < 1e-12
    seeds = [at("ping-pong", f, base=5, hold=4).seed for f in (0, 4, 8, 12, 16, 20)]
    assert seeds[4] == seeds[2] and seeds[5] == seeds[1] and len(set(seeds)) == 4
    assert at("per-frame-reseed", 3, base=5).seed == animation.fold(5, animation.seed_from_string("temporal:per-frame-reseed"), 3)


def test_census_of_many_colours(spark):
    rel = Spark(spark, "").values(["image_id", "x", "y", "w", "h", "r", "g", "b", "a"], [(i, x, 0, 300, 1, (x if i else x % 3) / 299, 0.0, 0.0, 1.0) for i in (0, 1) for x in range(300)])
    rows = census.colour_census(rel).df.collect()
    assert sum(r.pixels for r in rows if r.image_id == 0) == 300 and all(r.depth == 2 for r in rows if r.image_id == 0)
    assert len(rows) == 3 or [(r.entry, r.code, r.pixels) for r in rows if r.image_id == 1 and r.entry is None] in ([], [(None, None, 300)])


def test_images_round_trip_and_batch(spark, tmp_path):
    from pixelmill import extras
    from pixelmill.operators import batch
    from pixelmill.operators.context import Context
    from pixelmill.plans.document import Document
    from pixelmill.sources import images

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (7, 11, 4), np.uint8)
    codes[2:5] = codes[1]  # rows that other filters suit
    codes[5] = np.arange(44).reshape(11, 4)
    raw = images.encode_png(codes)
    assert images.extent(raw) == (11, 7) and images.problem(raw) is None and np.array_equal(images.decode_png(raw), codes)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.png").write_bytes(raw)
    (folder / "two.png").write_bytes(raw[:60])
    (folder / "three.txt").write_bytes(b"hello")
    (folder / "big.png").write_bytes(raw[:16] + (9000).to_bytes(4, "big") * 2 + raw[24:])
    pixels, errors = images.read_images(spark, str(folder))
    assert pixels.df.count() == 77 and {r.error.split(":")[0] for r in errors.collect()} == {"broken", "unknown-format", "too-large"}
    again = images.png_files(pixels).collect()
    assert len(again) == 1 and np.array_equal(images.decode_png(bytes(again[0].png)), codes)
    found = batch.run(spark, str(folder), Document.parse(extras.DOCUMENT), Context(Spark(spark, "")), "{name}-{index}")
    found = {r.output: r for r in found.collect()}
    assert set(found) == {"big-1.png", "one-2.png", "three-3.png", "two-4.png"}
    assert found["one-2.png"].error is None and images.extent(bytes(found["one-2.png"].png)) == (11, 7)
    assert all(r.png is None and r.error for n, r in found.items() if n != "one-2.png")
    assert batch.template_problem("  ") == "empty-template" and batch.template_problem("{what}") == "unknown-token"


def test_document_faults():
    from pixelmill.plans.document import Document, content_hash, validate
    from pixelmill import extras

    good = Document.parse(extras.DOCUMENT)
    assert validate(good) == []
    assert content_hash(good, "off") == content_hash(good, "tone")
    bad = Document.parse("""{"stack": [{"id": "a", "effect": "outline"}, {"id": "b", "effect": "blur", "params": {"radius": 99.0}},
      {"id": "c", "effect": "nope"}], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}], "output": "z"}""")
    assert {c for c, _ in validate(bad)} == {"output-missing", "out-of-range", "unknown-effect", "index-map-missing", "cycle"}


def test_streamed_feedback_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from pixelmill import extras
    from pixelmill.operators.context import Context
    from pixelmill.operators.registry import apply
    from pixelmill.plans.rel import Spark
    from pixelmill.streaming.feedback import feedback_stream

    src = Spark(spark, SF)
    params = {"decay": 0.8, "offsetX": 0.5, "rotate": 0.03, "blend": "lighten"}
    rel = extras.sequence(src).where("image_id < 3")
    ctx = Context(src)
    ctx.frames = 4
    batch = {(r.image_id, r.frame, r.x, r.y): r.r for r in apply(rel, "feedback", params, ctx).df.collect()}
    pixels = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    planes = rel.df.groupBy("image_id", "frame", "w", "h").agg(F.flatten(F.transform(pixels, lambda v: F.array(v["r"], v["g"], v["b"]))).alias("rgb"))
    planes.repartition(1, "frame").write.parquet(str(tmp_path / "frames"))
    stream = feedback_stream(spark.readStream.schema(planes.schema).parquet(str(tmp_path / "frames")), params)
    q = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("streamed").collect()
    assert len(rows) == 12
    for r in rows:
        for k in range(64):
            assert abs(r.rgb[3 * k] - batch[r.image_id, r.frame, k % 8, k // 8]) < 1e-9


def test_blend_modes_meet_once(spark):
    """All modes come from one join of base and top; a union of joins would have one task read the rasters once a mode."""
    plan = catalog.queries()["blend_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Union" not in plan


def test_taps_are_exploded_after_the_join(spark):
    """Nine taps a pixel: the pixels meet the squares of their taps first, and only then become rows by tap."""
    plan = catalog.queries()["fx_edge_detect"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(taps" in plan and plan.index("inline(taps") < plan.index("Join LeftOuter")


def test_gather_on_a_raster_with_holes_and_twins(spark):
    from pixelmill.plans.rel import SparkRel

    pixels = [(1, x, y, 19, 11, float(x * 100 + y), 0.0, 0.0, 1.0) for x in range(19) for y in range(11) if (x, y) != (8, 7)] + [(1, 3, 3, 19, 11, 5.5, 0.0, 0.0, 1.0)]
    at = {}
    for _, x, y, _, _, r, *_ in pixels:
        at.setdefault((x, y), []).append(r)
    rel = SparkRel(spark.createDataFrame(pixels, "image_id long, x long, y long, w long, h long, r double, g double, b double, a double")).where("r <> 5.5")
    src = SparkRel(spark.createDataFrame(pixels, "image_id long, x long, y long, w long, h long, r double, g double, b double, a double"))
    taps = [(f"x + ({dx})", f"y + ({dy})", {"k": f"{1 + k}.0"}) for k, (dx, dy) in enumerate([(-9, 0), (0, 0), (1, 1), (5, -4)])]
    got = {(r.x, r.y): r.v for r in spatial.gather(rel, src, taps, {"v": "w_k * s_r"}).df.collect()}
    assert got == {(x, y): sum((1 + k) * v for k, (dx, dy) in enumerate([(-9, 0), (0, 0), (1, 1), (5, -4)]) for v in at.get((x + dx, y + dy), [])) for x, y in at}


def test_wu_lays_out_only_planes_with_bins():
    import tracemalloc

    import numpy as np

    from pixelmill.operators import extract

    at = [(c * 32 + c) * 32 + c for c in (1, 2, 20, 30)]
    lab = np.array([0.0, 0.02, 0.7, 1.0])[:, None] * np.ones(3)
    bins = extract.Bins(np.column_stack([at, [4, 2, 3, 1], lab, lab, (lab**2).sum(1)]))
    tracemalloc.start()
    boxes = extract.wu(bins, 3, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(b.tolist() for b in boxes) == [[0, 1], [2], [3]]
    assert most < 200_000, most  # the whole grid takes 1.4 MB
