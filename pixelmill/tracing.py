"""Queries of the vector tracer, and their DuckDB oracles, which flood and walk pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import contours
from pixelmill.operators.context import Context
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import apply
from pixelmill.plans.rel import Duck, Spark
from pixelmill.sources.rasters import emb8

#: Smallest region that the queries keep, in pixels.
LEAST_AREA = 4
TOLERANCE = 1.0


def dithered(src, palette="gameboy-dmg"):
    return apply(emb8(src), "bayer-4", {}, Context(src, Palette.of(palette)))


def framed(src, n=4):
    """The dithers of four embeddings in a row as frames of one image."""
    rel = dithered(src, "mono")
    return rel.let(frame=f"image_id % {n}", image_id=rel.d.div("image_id", n)).where("image_id >= 0")


def _traced(make, **options):
    def run(spark, sf_dir):
        return contours.traced(make(Spark(spark, sf_dir)).df, **options)[0]

    return run


def donation(spark, sf_dir):
    """What a minimum feature size drops and fills, and the pixels each layer has then."""
    runs, report = contours.without_specks(contours.settled(contours.layer_runs(dithered(Spark(spark, sf_dir)).df)), LEAST_AREA)
    after = runs.groupBy("image_id", "layer").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    return report.join(after, ["image_id", "layer"], "left").fillna(0, ["pixels"])


def documents(spark, sf_dir):
    """An SVG document for each image, of its simplified dither."""
    pixels = contours.settled(dithered(Spark(spark, sf_dir)).df)
    shown, _ = contours.traced(pixels, least_area=LEAST_AREA, tolerance=TOLERANCE)
    return contours.svg(shown, pixels, Palette.of("gameboy-dmg"), exact=False)


def _walk(pixels: str, image: str) -> str:
    """Unit edges, walked from every first edge until they close; ``px`` has image, x, y, w, layer."""
    return f"""
with recursive px as materialized ({pixels}),
sides(d, nx, ny, vx, vy) as (values (0, 0, -1, 0, 0), (1, 1, 0, 1, 0), (2, 0, 1, 1, 1), (3, -1, 0, 0, 1)),
edges as materialized (
  select {image}, layer, w, d, (y + vy) * (w + 1) + x + vx as v, (y + vy) * (w + 1) + x + vx + case d when 0 then 1 when 1 then w + 1 when 2 then -1 else -w - 1 end as v2
  from px p, sides s where not exists (select 1 from px q where {" and ".join(f"q.{c} = p.{c}" for c in image.split(", "))} and q.layer = p.layer and q.x = p.x + nx and q.y = p.y + ny)
),
steps as materialized (
  select {", ".join(f"e.{c}" for c in image.split(", "))}, e.layer, e.w, e.d, e.v * 4 + e.d as id,
    min_by(n.v * 4 + n.d, case (n.d - e.d + 4) % 4 when 1 then 0 when 0 then 1 else 2 end) as next, min_by(n.d, case (n.d - e.d + 4) % 4 when 1 then 0 when 0 then 1 else 2 end) as next_d
  from edges e join edges n on {" and ".join(f"n.{c} = e.{c}" for c in image.split(", "))} and n.layer = e.layer and n.v = e.v2 group by all
),
walk as (
  select {image}, layer, id as ring, id as cur, 0 as n from steps
  union all
  select {", ".join(f"w.{c}" for c in image.split(", "))}, w.layer, w.ring, s.next, w.n + 1 from walk w
  join steps s on {" and ".join(f"s.{c} = w.{c}" for c in image.split(", "))} and s.layer = w.layer and s.id = w.cur where s.next > w.ring
),
closed as (
  select {", ".join(f"w.{c}" for c in image.split(", "))}, w.layer, w.ring from walk w
  join steps s on {" and ".join(f"s.{c} = w.{c}" for c in image.split(", "))} and s.layer = w.layer and s.id = w.cur where s.next = w.ring
),
corners as (
  select {", ".join(f"w.{c}" for c in image.split(", "))}, w.layer, w.ring, w.n, (w.cur // 4) % (s.w + 1) as x, (w.cur // 4) // (s.w + 1) as y
  from walk w join closed using ({image}, layer, ring)
  join steps s on {" and ".join(f"s.{c} = w.{c}" for c in image.split(", "))} and s.layer = w.layer and s.id = w.cur
  join steps b on {" and ".join(f"b.{c} = w.{c}" for c in image.split(", "))} and b.layer = w.layer and b.next = w.cur and b.d <> s.d
),
near as (
  select *, lag(y) over ring as py, coalesce(lead(x) over ring, first_value(x) over ring) as nx, coalesce(lead(y) over ring, first_value(y) over ring) as ny
  from corners window ring as (partition by {image}, layer, ring order by n rows between unbounded preceding and unbounded following)
)
select {image}, layer, ring, count(*) as points, cast(sum(x * ny - nx * y) as bigint) as area2, sum(x * ny - nx * y) < 0 as is_hole,
  string_agg(case when py is null then 'M' || x || ' ' || y when y = py then 'H' || x else 'V' || y end, '' order by n) || 'Z' as path
from near group by {image}, layer, ring
"""


def _simplified_sql() -> str:
    """The farthest point of every stretch between any two corners of a ring, then the splits that start from the whole ring."""
    walked = _walk(_pixels(dithered(Duck()), "image_id"), "image_id").split("near as (")[0]
    key, same = "image_id, layer, ring", "{0}.image_id = {1}.image_id and {0}.layer = {1}.layer and {0}.ring = {1}.ring".format
    return walked + f"""pts as materialized (
  select {key}, row_number() over (partition by {key} order by n) - 1 as seq, count(*) over (partition by {key}) as n, cast(x as double) as x, cast(y as double) as y from corners
),
far as (
  select p.image_id, p.layer, p.ring, p.n, arg_max(p.seq, pow(p.x - f.x, 2) + pow(p.y - f.y, 2) - p.seq / 1e6) as anchor from pts p join pts f on {same("f", "p")} and f.seq = 0 group by all
),
closed_ring as materialized (select {key}, seq, x, y from pts union all select {key}, n, x, y from pts where seq = 0),
stretches as materialized (
  select a.image_id, a.layer, a.ring, a.seq as lo, b.seq as hi, arg_max(m.seq, d - m.seq / 1e9) as worst, max(d) as d
  from closed_ring a join closed_ring b on {same("b", "a")} and b.seq > a.seq + 1 join closed_ring m on {same("m", "a")} and m.seq > a.seq and m.seq < b.seq,
  lateral (select pow(b.x - a.x, 2) + pow(b.y - a.y, 2) as size),
  lateral (select case when size > 0 then pow((b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x), 2) / size else pow(m.x - a.x, 2) + pow(m.y - a.y, 2) end as d) group by all
),
splits as (
  select {key}, 0 as lo, anchor as hi from far union all select {key}, anchor, n from far
  union all
  select s.image_id, s.layer, s.ring, unnest([s.lo, t.worst]), unnest([t.worst, s.hi]) from splits s join stretches t using ({key}, lo, hi) where t.d > {TOLERANCE**2!r}
),
kept as (select p.* from pts p where exists (select 1 from splits s where {same("s", "p")} and s.lo = p.seq)),
turns as (
  select *, coalesce(lag(x) over ring, last_value(x) over ring) as px, coalesce(lag(y) over ring, last_value(y) over ring) as py,
    coalesce(lead(x) over ring, first_value(x) over ring) as nx, coalesce(lead(y) over ring, first_value(y) over ring) as ny
  from kept window ring as (partition by {key} order by seq rows between unbounded preceding and unbounded following)
),
bent as (select {key}, seq, x, y from turns where (x - px) * (ny - y) - (y - py) * (nx - x) <> 0),
shown as (
  select *, lag(x) over ring as px, lag(y) over ring as py, coalesce(lead(x) over ring, first_value(x) over ring) as nx, coalesce(lead(y) over ring, first_value(y) over ring) as ny
  from bent window ring as (partition by {key} order by seq rows between unbounded preceding and unbounded following)
)
select {key}, count(*) as points, cast(sum(x * ny - nx * y) as bigint) as area2, sum(x * ny - nx * y) < 0 as is_hole,
  string_agg(case when px is null then 'M' || cast(x as int) || ' ' || cast(y as int) when y = py then 'H' || cast(x as int) when x = px then 'V' || cast(y as int)
    else 'L' || cast(x as int) || ' ' || cast(y as int) end, '' order by seq) || 'Z' as path
from shown group by {key} having count(*) >= 3 and sum(x * ny - nx * y) <> 0
"""


def _donation_sql() -> str:
    """Floods: regions of each index, then each layer's background without its specks."""
    return f"""
with recursive px as materialized (select image_id, x, y, w, h, cast(idx as bigint) as layer, y * w + x as place from ({dithered(Duck()).sql()})),
reach as (
  select image_id, layer, x, y, place, place as root from px
  union
  select n.image_id, n.layer, n.x, n.y, n.place, r.root from reach r join px n
  on n.image_id = r.image_id and n.layer = r.layer and abs(n.x - r.x) + abs(n.y - r.y) = 1 and r.root < n.place
),
rooted as (select image_id, layer, x, y, place, min(root) as root from reach group by all),
sized as materialized (select *, count(*) over (partition by image_id, layer, root) as area from rooted),
back as materialized (
  select p.image_id, l.layer, p.x, p.y, p.w, p.h, p.place from px p join (select distinct image_id, layer from px) l using (image_id)
  where not exists (select 1 from sized s where s.image_id = p.image_id and s.layer = l.layer and s.place = p.place and s.area >= {LEAST_AREA})
),
spread as (
  select image_id, layer, x, y, place, place as root from back
  union
  select n.image_id, n.layer, n.x, n.y, n.place, r.root from spread r join back n
  on n.image_id = r.image_id and n.layer = r.layer and abs(n.x - r.x) <= 1 and abs(n.y - r.y) <= 1 and r.root < n.place
),
holes as (
  select image_id, layer, root, count(*) as area from (
    select s.image_id, s.layer, s.place, min(s.root) as root, max(cast(b.x = 0 or b.y = 0 or b.x = b.w - 1 or b.y = b.h - 1 as int)) as edge from spread s
    join back b using (image_id, layer, place) group by all
  ) group by all having max(edge) = 0 and count(*) < {LEAST_AREA}
),
lost as (select image_id, layer, count(distinct root) as n, count(*) as pixels from sized where area < {LEAST_AREA} group by all),
kept as (select image_id, layer, count(*) as pixels from sized where area >= {LEAST_AREA} group by all),
filled as (select image_id, layer, count(*) as n, sum(area) as pixels from holes group by all)
select l.image_id, l.layer, coalesce(lost.n, 0) as regions_dropped, coalesce(lost.pixels, 0) as region_pixels_dropped, coalesce(filled.n, 0) as holes_filled,
  cast(coalesce(filled.pixels, 0) as bigint) as hole_pixels_filled, cast(coalesce(kept.pixels, 0) + coalesce(filled.pixels, 0) as bigint) as pixels
from (select distinct image_id, layer from px) l left join lost using (image_id, layer) left join kept using (image_id, layer) left join filled using (image_id, layer)
"""


def _pixels(rel, image: str) -> str:
    return f"select {image}, x, y, w, cast(idx as bigint) as layer from ({rel.sql()})"


SPARK_QUERIES = {
    "trace_contours": _traced(dithered),
    "trace_contours_frames": _traced(framed),
    "trace_donation": donation,
    "trace_simplified": _traced(dithered, tolerance=TOLERANCE),
    "trace_svg": documents,
}


def oracles() -> dict[str, str]:
    return {
        "trace_contours": _walk(_pixels(dithered(Duck()), "image_id"), "image_id"),
        "trace_contours_frames": _walk(_pixels(framed(Duck()), "image_id, frame"), "image_id, frame"),
        "trace_donation": _donation_sql(),
        "trace_simplified": _simplified_sql(),
    }
