"""Plans that must not shuffle: joins with constants, composites of effects on single pixels."""

from pixelmill import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constants_are_broadcast(spark):
    plan = plan_of(catalog.queries()["palette_remap"](spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_pixel_effects_are_composited_without_a_join(spark):
    plan = plan_of(catalog.queries()["animation_document"](spark, SF))
    assert "Join" not in plan and "Exchange" not in plan


def test_composites_without_a_join_are_those_of_the_join(spark):
    from pixelmill.operators import compositing
    from pixelmill.operators.context import Context
    from pixelmill.operators.registry import apply
    from pixelmill.plans.rel import Spark, SparkRel
    from pixelmill.sources.rasters import emb8

    src = Spark(spark, SF)
    base = emb8(src).where("image_id < 20")
    lost = base.let(image_id="case when image_id = 3 then null else image_id end", a="0.25 + r / 2.0")
    mask = {"kind": "luminance", "low": 0.2, "high": 0.7, "feather": 0.1}
    indexed = apply(base, "bayer-4", {}, Context(src))
    for rel, id in ((lost, "vignette"), (indexed, "invert"), (indexed, "bayer-8"), (base, "bayer-8")):
        for how in (("multiply", 0.5), ("normal", 1.0, mask), ("screen", 0.3, {"kind": "image", "channel": "red"}, base)):
            ctx = Context(src)
            old = compositing.composite(rel, apply(rel, id, {}, ctx), *how)
            new = compositing.laid_over(rel, id, {}, ctx, *how)
            assert isinstance(new, SparkRel) and set(new.columns) == set(old.columns)
            names = sorted(old.columns)
            assert old.df.count() > 0 and old.df.select(names).exceptAll(new.df.select(names)).isEmpty() and new.df.count() == old.df.count()


def test_noise_is_computed_once_a_place(spark):
    import re

    plan = plan_of(catalog.queries()["fx_gen_noise"](spark, SF))
    assert len(re.findall(r"\w+Join ", plan)) == 1 and re.search(r"HashAggregate\(keys=\[x#\w+, y#\w+\]", plan)
