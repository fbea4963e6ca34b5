"""Queries that write image files from tables and read them back, and their oracles, which know nothing of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import search
from pixelmill.operators.context import Context
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import EFFECTS, apply
from pixelmill.plans import codec, edits
from pixelmill.plans.rel import Duck, Spark
from pixelmill.plans.scratch import settled
from pixelmill.sources import gif
from pixelmill.sources.rasters import emb8

PALETTE = "gameboy-dmg"


def loops(src, n=4):
    """Dithers of four embeddings in a row as the frames of one image."""
    rel = apply(emb8(src), "bayer-4", {}, Context(src, Palette.of(PALETTE)))
    return rel.let(frame=f"image_id % {n}", image_id=rel.d.div("image_id", n)).where("image_id >= 0")


def _files(spark, sf_dir):
    return gif.gif_files(settled(loops(Spark(spark, sf_dir)).df), Palette.of(PALETTE))


def gif_round_trip(spark, sf_dir):
    """Every pixel of every frame, out of the files."""
    return gif.frames_of(settled(_files(spark, sf_dir).select("image_id", "gif")))


def gif_report(spark, sf_dir):
    return _files(spark, sf_dir).select("image_id", "frames", "cropped_frames", "pixels_written")


#: A document of the old schema for each order, some of them broken; fields out of order.
OLD_DOCUMENT = (
    """case when o_orderkey % 17 = 0 then '{' when o_orderkey % 19 = 0 then '{"schema": 3, "stack": []}' else """
    """concat('{"stack": [{"effect": "posterize", "id": "n1", "params": {"levels": ', 2 + o_orderkey % 30, '}}, {"id": "n2", "effect": "invert", "seed": ', o_custkey, """
    """'}], "clock": {"frames": ', 1 + o_orderkey % 48, ', "fps": 24.0}, "schema": 1}') end"""
)
#: The same document as the codec has to write it; @1 to @3 stand for the levels, the seed and the frames.
NEW_DOCUMENT = """{
  "schema": 2,
  "source": null,
  "palette": {
    "id": "mono",
    "name": "Black & White",
    "colors": [
      0,
      0,
      0,
      255,
      255,
      255
    ],
    "metric": "oklab"
  },
  "clock": {
    "frames": @3,
    "fps": 24
  },
  "stack": [
    {
      "id": "n1",
      "effect": "posterize",
      "enabled": true,
      "opacity": 1,
      "blend": "normal",
      "params": {
        "levels": @1
      },
      "seed": 0
    },
    {
      "id": "n2",
      "effect": "invert",
      "enabled": true,
      "opacity": 1,
      "blend": "normal",
      "params": {},
      "seed": @2
    }
  ],
  "edges": [
    {
      "from": "n1",
      "to": "n2",
      "port": "in"
    }
  ],
  "output": "n2",
  "bindings": []
}
"""


def document_migration(spark, sf_dir):
    """Documents of the old schema, read, migrated and written in canonical form."""
    texts = Spark(spark, sf_dir).table("orders", "o_orderkey as id", f"{OLD_DOCUMENT} as text").df
    return codec.decode_table(texts)


def _migration_sql() -> str:
    text = "'" + NEW_DOCUMENT + "'"
    for k, x in enumerate(("2 + o_orderkey % 30", "o_custkey", "1 + o_orderkey % 48"), 1):
        text = f"replace({text}, '@{k}', cast({x} as varchar))"
    broken = "case when o_orderkey % 17 = 0 then 'not-json' when o_orderkey % 19 = 0 then 'unrecognised-file: schema 3' end"
    whole = "o_orderkey % 17 <> 0 and o_orderkey % 19 <> 0"
    return f"""
select o_orderkey as id, case when {whole} then cast(1 as bigint) end as schema, case when {whole} then {text} end as document,
  case when {whole} then '' end as problems, {broken} as error from orders
"""


SHAPES = ("sine", "triangle", "saw", "square")
#: An animated document for each order: a bound gamma, and for some a feedback node; the second is not read.
LOOP_DOCUMENT = (
    """case when o_orderkey % 23 = 1 then '{"schema": 2}' else concat('{"schema": 2, "stack": [{"id": "g", "effect": "levels", "params": {"gamma": 1.5}}, """
    """{"id": "f", "effect": "feedback", "enabled": ', case when o_orderkey % 5 = 0 then 'true' else 'false' end, '}], "edges": [{"from": "g", "to": "f"}], "output": "f", """
    """"clock": {"fps": 24, "frames": ', 2 + o_orderkey % 40, '}, "bindings": [{"nodeId": "g", "param": "gamma", "shape": "', """
    + "case o_orderkey % 4 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(SHAPES)) + " end, "
    """'", "cyclesPerLoop": ', 1 + o_custkey % 12, ', "amount": ', cast(o_orderkey % 50 as int), ', "phase": 0.125}]}') end"""
)


def loop_seams(spark, sf_dir):
    """What keeps each document's loop from closing, or blurs it."""
    return codec.seam_table(Spark(spark, sf_dir).table("orders", "o_orderkey as id", f"{LOOP_DOCUMENT} as text").df)


def _seams_sql() -> str:
    """Each frame's value of each binding, from the shapes' formulas."""
    gamma = EFFECTS["levels"].params["gamma"]
    return f"""
with docs as (select o_orderkey as id, 2 + o_orderkey % 40 as frames, o_orderkey % 4 as shape, 1 + o_custkey % 12 as cycles, o_orderkey % 50 as amount from orders where o_orderkey % 23 <> 1),
phased as (select *, cycles * f / cast(frames as double) + 0.125e0 as p from docs, lateral (select unnest(range(frames)) as f)),
turned as (select *, p - floor(p) as t from phased),
valued as (
  select id, 1.5e0 + amount * case shape when 0 then sin(2e0 * pi() * t) when 1 then case when t < 0.25e0 then 4e0 * t when t < 0.75e0 then 2e0 - 4e0 * t else 4e0 * t - 4e0 end
    when 2 then t * 2e0 - 1e0 else case when t < 0.5e0 then 1e0 else -1e0 end end as v from turned
)
select id, 'does-not-loop' as code, 'info' as severity, 'f' as place from docs where id % 5 = 0
union all select id, 'sampled-below-nyquist', 'warning', 'g.gamma' from docs where 2 * cycles * case shape when 2 then 1 else 2 end > frames
union all select id, 'binding-clips', 'warning', 'g.gamma' from valued group by id having min(v) < {gamma.low!r} or max(v) > {gamma.high!r}
union all select o_orderkey, 'unrecognised-file', 'error', '' from orders where o_orderkey % 23 = 1
"""


#: What is looked for: of every hundredth part the name, mistyped in each word but for some.
ASKED = "case when p_partkey % 700 = 0 then 'qqzzqqzz' when p_partkey % 300 = 0 then p_name else regexp_replace(p_name, '(^| )(.).', '{g}') end"


def part_search(spark, sf_dir):
    """Parts by name and type; of names that are mistyped the nearest."""
    src = Spark(spark, sf_dir)
    queries = src.table("part", "p_partkey", f"{ASKED.format(g='$1$2')} as text").df.where("p_partkey % 100 = 0").withColumnRenamed("p_partkey", "query_id")
    names = src.table("part", "p_partkey as entry_id", "p_name as text", "3.0D as weight").df
    kinds = src.table("part", "p_partkey as entry_id", "p_type as text", "1.0D as weight").df
    found = search.searched(queries, names.unionAll(kinds))
    return found.withColumn("score", F.round("score", 6))


def _search_sql() -> str:
    """Every token of every query against every word of every part."""
    asked = ASKED.format(g="\\1\\2").replace("\\1\\2')", "\\1\\2', 'g')")
    return f"""
with queries as (select p_partkey as q, string_split(lower({asked}), ' ') as ts from part where p_partkey % 100 = 0),
tokens as (select q, len(ts) as of, unnest(ts) as t, generate_subscripts(ts, 1) as nth from queries),
words as (
  select p_partkey as e, 3.0 as k, unnest(string_split(lower(p_name), ' ')) as w from part union all select p_partkey, 1.0, unnest(string_split(lower(p_type), ' ')) from part
),
cost as (select distinct t, w, case when t = w then 1.0 when starts_with(w, t) then 0.7 when contains(w, t) then 0.4 end as s,
  levenshtein(t, w) <= case when length(t) >= 7 then 2 when length(t) >= 4 then 1 else 0 end and length(t) >= 4 as near from (select distinct t from tokens), (select distinct w from words)),
each as (select q, of, nth, e, max(s * k) as direct, max(case when near then 0.4 * k end) as typo from tokens join cost using (t) join words using (w) where s is not null or near group by all),
total as (select q, e, count(direct) = of as whole, sum(coalesce(direct, typo)) as score from each group by q, of, e),
found as (select q, 'found' as kind, e, score from total where whole),
close as (select q, 'nearest' as kind, e, score from total where q not in (select q from found)),
ranked as (select *, row_number() over (partition by q order by round(score, 9) desc, e) as rank from (from found union all from close))
select q as query_id, kind, rank, e as entry_id, cast(round(score, 6) as double) as score from ranked where kind = 'found' or rank <= 3
union all select q, 'unknown', null, null, null from queries where q not in (select q from total)
"""


#: Each user's events as edits of a graph of their own.
EDIT_LOG = (
    "user_id as doc", "event_id as nth",
    "case event_id % 11 when 0 then 'remove' when 1 then 'disconnect' when 2 then 'output' when 3 then 'mask' when 4 then 'add' when 5 then 'add' when 6 then 'add' else 'connect' end as op",
    "concat('n', event_id div 11 % 7) as a",
    "case when event_id % 11 in (4, 5, 6) then element_at(array('levels', 'invert', 'feedback', 'bayer-4', 'gen-noise'), cast(event_id div 7 % 5 as int) + 1) when event_id % 11 = 3 then 'on' else concat('n', event_id div 5 % 7) end as b",
    "case when event_id % 11 in (4, 5) then concat('n', event_id div 3 % 7) when event_id % 11 = 6 then cast(null as string) else element_at(array('in', 'in', 'mask', 'feedback', 'in'), cast(event_id div 13 % 5 as int) + 1) end as port",
)


def graph_edits(spark, sf_dir):
    """What became of every edit, and the graph after it."""
    return edits.replay(Spark(spark, sf_dir).table("events", *EDIT_LOG).df)


SPARK_QUERIES = {"graph_edits": graph_edits, "part_search": part_search, "animation_seams": loop_seams, "document_migration": document_migration, "gif_round_trip": gif_round_trip, "gif_report": gif_report}


def oracles() -> dict[str, str]:
    picked = " ".join(f"when {i} then {{{i}}}" for i in range(4))
    colours = [", ".join(f"cast(case idx {picked.format(*[c[k] for c in Palette.of(PALETTE).colors])} end as bigint) as c{'rgb'[k]}" for k in range(3))][0]
    rel = loops(Duck()).sql()
    report = f"""
with px as (select * from ({rel})),
marked as (select *, lag(idx) over (partition by image_id, x, y order by frame) as was from px),
box as (
  select image_id, frame, w, h, min(x) filter (changed) as l, max(x) filter (changed) as r, min(y) filter (changed) as t, max(y) filter (changed) as b
  from (select *, was is null or was <> idx as changed from marked) group by image_id, frame, w, h
),
sized as (select *, coalesce(r - l + 1, 1) as wide, coalesce(b - t + 1, 1) as high from box)
select image_id, count(*) as frames, count(*) filter (wide <> w or high <> h) as cropped_frames, cast(sum(wide * high) as bigint) as pixels_written from sized group by image_id
"""
    return {"part_search": _search_sql(), "animation_seams": _seams_sql(), "document_migration": _migration_sql(), "gif_round_trip": f"select image_id, frame, x, y, {colours}, cast(255 as bigint) as ca from ({rel})", "gif_report": report}
