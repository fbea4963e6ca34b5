"""Traces against plain walks, floods and recursion on small index maps."""

import random
import re
from collections import defaultdict

import pytest

from pixelmill.operators import contours
from pixelmill.operators.palettes import Palette

SCHEMA = "image_id long, frame long, x long, y long, w long, h long, idx long"


def maps():
    """(image, frame) -> rows of indices, of several sizes."""
    rng = random.Random(12)
    out = {(0, f): [[rng.choice([0, 0, 1, 2]) for _ in range(9)] for _ in range(6)] for f in range(3)}
    out[1, 0] = [[3]]
    out[2, 0] = [[0] * 7 for _ in range(7)]
    for x, y in ((1, 1), (2, 2), (4, 4), (3, 3), (5, 2)):
        out[2, 0][y][x] = 1
    out[3, 1] = [[rng.choice([0, 1]) for _ in range(5)] for _ in range(13)]
    ring = [[0] * 11 for _ in range(11)]
    for y in range(11):
        for x in range(11):
            ring[y][x] = min(x, y, 10 - x, 10 - y) % 3  # moats around islands
    out[4, 0] = ring
    out[5, 0] = [[int((x - 9) ** 2 + (y - 8) ** 2 < 50) for x in range(19)] for y in range(17)]
    return out


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(i, f, x, y, len(m[0]), len(m), v) for (i, f), m in maps().items() for y, line in enumerate(m) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def flood(cells, near):
    left, found = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for dx, dy in near:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        found.append(part)
    return found


FOUR = [(1, 0), (0, 1), (-1, 0), (0, -1)]
EIGHT = [*FOUR, (1, 1), (-1, -1), (1, -1), (-1, 1)]


def layers(m, least):
    """index -> (cells, regions dropped, pixels, holes filled, pixels)."""
    w, h = len(m[0]), len(m)
    out = {}
    for c in sorted({v for line in m for v in line}):
        cells, dropped, filled = set(), [], []
        for part in flood({(x, y) for y in range(h) for x in range(w) if m[y][x] == c}, FOUR):
            if len(part) < least:
                dropped.append(len(part))
            else:
                cells |= part
        for part in flood({(x, y) for y in range(h) for x in range(w)} - cells, EIGHT):
            if len(part) < least and not any(x in (0, w - 1) or y in (0, h - 1) for x, y in part):
                filled.append(part)
        for part in filled:
            cells |= part
        out[c] = (cells, len(dropped), sum(dropped), len(filled), sum(map(len, filled)))
    return out


def walks(cells, w):
    """Corner lists by first edge, walking unit edges with the cells on the right."""
    going = defaultdict(set)
    for x, y in cells:
        for d, (nx, ny, vx, vy) in enumerate([(x, y - 1, x, y), (x + 1, y, x + 1, y), (x, y + 1, x + 1, y + 1), (x - 1, y, x, y + 1)]):
            if (nx, ny) not in cells:
                going[vx, vy].add(d)
    left = {((y * (w + 1) + x) * 4 + d, x, y, d) for (x, y), ds in going.items() for d in ds}
    out = {}
    while left:
        first = min(left)
        edge, ring = first, []
        while edge in left:
            left.remove(edge)
            ring.append(edge[1:])
            _, x, y, d = edge
            x, y = x + FOUR[d][0], y + FOUR[d][1]
            d = next(e for e in ((d + 1) % 4, d, (d + 3) % 4) if e in going[x, y])
            edge = ((y * (w + 1) + x) * 4 + d, x, y, d)
        out[first[0]] = [(x, y) for (x, y, d), before in zip(ring, [ring[-1], *ring[:-1]], strict=True) if before[2] != d]
    return out


def straight(a, b, points, limit):
    """Recursive Douglas-Peucker between two kept points."""
    if not points:
        return []
    ex, ey = b[0] - a[0], b[1] - a[1]

    def away(p):
        px, py = p[0] - a[0], p[1] - a[1]
        return (ex * py - ey * px) ** 2 / (ex * ex + ey * ey) if ex or ey else px * px + py * py

    far = max(range(len(points)), key=lambda i: (away(points[i]), -i))
    if away(points[far]) <= limit * limit:
        return []
    return [*straight(a, points[far], points[:far], limit), points[far], *straight(points[far], b, points[far + 1 :], limit)]


def area2(ring):
    return sum(x * ny - nx * y for (x, y), (nx, ny) in zip(ring, [*ring[1:], ring[0]], strict=True))


def reduced(ring, limit):
    if len(ring) >= 4:
        cut = max(range(len(ring)), key=lambda i: ((ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2, -i))
        ring = [ring[0], *straight(ring[0], ring[cut], ring[1:cut], limit), ring[cut], *straight(ring[cut], ring[0], ring[cut + 1 :], limit)]
        n = len(ring)
        ring = [q for i, q in enumerate(ring) if (q[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - q[1]) != (q[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - q[0])]
    return ring if len(ring) >= 3 and area2(ring) else None


def path(ring):
    out = f"M{ring[0][0]} {ring[0][1]}"
    for (px, py), (x, y) in zip(ring, ring[1:], strict=False):
        out += f"H{x}" if y == py else f"V{y}" if x == px else f"L{x} {y}"
    return out + "Z"


def painted(paths, w, h):
    """The cells inside some closed paths, by counting crossings to the left (even-odd)."""
    edges = []
    for text in paths:
        x = y = None
        ring = []
        for op, a, b in re.findall(r"([MHVL])(\d+)(?: (\d+))?", text):
            x, y = (int(a), int(b)) if op in "ML" else (int(a), y) if op == "H" else (x, int(a))
            ring.append((x, y))
        edges += list(zip(ring, [*ring[1:], ring[0]], strict=True))
    return {(x, y) for x in range(w) for y in range(h) if sum(ax == bx and ax <= x and min(ay, by) <= y < max(ay, by) for (ax, ay), (bx, by) in edges) % 2}


@pytest.mark.parametrize("least", [0, 2, 5, 13])
def test_traces(pixels, least):
    shown, report = contours.traced(pixels, least_area=least)
    got, counts = defaultdict(dict), {}
    for r in shown.collect():
        got[r.image_id, r.frame, r.layer][r.ring] = (r.points, r.area2, r.is_hole, r.path)
    for r in report.collect():
        counts[r.image_id, r.frame, r.layer] = (r.regions_dropped, r.region_pixels_dropped, r.holes_filled, r.hole_pixels_filled, r.contours, r.points)
    n = 0
    for (i, f), m in maps().items():
        w, h = len(m[0]), len(m)
        covered = 0
        for c, (cells, *numbers) in layers(m, least).items():
            rings = walks(cells, w)
            own = got.get((i, f, c), {})
            assert own == {k: (len(r), area2(r), area2(r) < 0, path(r)) for k, r in rings.items()}
            assert counts[i, f, c] == (*numbers, len(rings), sum(map(len, rings.values())))
            assert painted([p for *_, p in own.values()], w, h) == cells
            covered += sum(a for _, a, *_ in own.values()) // 2
            n += len(rings)
        assert covered == w * h - sum(counts[i, f, c][1] - counts[i, f, c][3] for c in layers(m, least))
    assert n == sum(map(len, got.values()))


@pytest.mark.parametrize("tolerance", [0.6, 1.5])
def test_simplification(pixels, tolerance):
    shown, report = contours.traced(pixels, tolerance=tolerance)
    got = {(r.image_id, r.frame, r.layer, r.ring): r.path for r in shown.collect()}
    expect, lost = {}, 0
    for (i, f), m in maps().items():
        for c, (cells, *_) in layers(m, 0).items():
            for k, ring in walks(cells, len(m[0])).items():
                if short := reduced(ring, tolerance):
                    expect[i, f, c, k] = path(short)
                else:
                    lost += 1
    assert got == expect
    assert sum(r.contours_dropped for r in report.collect()) == lost


def test_svg(pixels):
    shown, _ = contours.traced(pixels)
    found = {(r.image_id, r.frame): r.svg for r in contours.svg(shown, pixels, Palette.of("gameboy-dmg")).collect()}
    assert set(found) == set(maps())
    assert found[1, 0] == (
        '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" width="1" height="1" viewBox="0 0 1 1"'
        ' shape-rendering="crispEdges">\n<g id="colour-3-e0f8d0" inkscape:groupmode="layer" inkscape:label="#e0f8d0" data-palette-index="3" fill="#e0f8d0" fill-rule="evenodd">'
        '<path d="M0 0H1V1H0Z"/></g>\n</svg>\n'
    )
    assert 'fill="none" stroke="#081820" stroke-width="0.5"' in contours.svg(shown, pixels, Palette.of("gameboy-dmg"), stroke=0.5).where("image_id = 2").first().svg
    with pytest.raises(ValueError):
        contours.traced(pixels, tolerance=0.0)


def test_no_pixels(spark):
    shown, report = contours.traced(spark.createDataFrame([], SCHEMA), least_area=3, tolerance=1.0)
    assert shown.count() == report.count() == 0


def wide():
    """A map over several squares: blobs across their borders, a frame, a line through three squares and noise."""
    rng = random.Random(5)
    w, h = 2 * contours.SQUARE + 9, contours.SQUARE + 7
    m = [[int((x - 60) ** 2 + (y - 62) ** 2 < 300) + 2 * int(90 < x < 120 and 20 < y < 68) for x in range(w)] for y in range(h)]
    for x in range(w):
        m[0][x] = m[h - 1][x] = m[10][x] = 3
    for y in range(h):
        m[y][0] = m[y][w - 1] = 3
    for _ in range(400):
        m[rng.randrange(h)][rng.randrange(w)] = rng.randrange(4)
    return m


@pytest.mark.parametrize("tolerance", [None, 1.5])
def test_squares_are_linked(spark, tolerance):
    m = wide()
    w, h = len(m[0]), len(m)
    df = spark.createDataFrame([(7, 0, x, y, w, h, v) for y, line in enumerate(m) for x, v in enumerate(line)], SCHEMA).repartition(3)
    got = {(r.layer, r.ring): r.path for r in contours.traced(df, tolerance=tolerance)[0].collect()}
    expect = {}
    for c, (cells, *_) in layers(m, 0).items():
        for k, ring in walks(cells, w).items():
            if tolerance is None or reduced(ring, tolerance):
                expect[c, k] = path(ring if tolerance is None else reduced(ring, tolerance))
    assert got == expect


def test_blocks_are_linked(spark, monkeypatch):
    """Regions and holes over several blocks, by the floods."""
    monkeypatch.setattr(contours, "BLOCK", 50)
    m = wide()
    w, h = len(m[0]), len(m)
    df = spark.createDataFrame([(7, 0, x, y, w, h, v) for y, line in enumerate(m) for x, v in enumerate(line)], SCHEMA).repartition(3)
    runs, report = contours.without_specks(contours.layer_runs(df), 5)
    got, counts = defaultdict(set), {}
    for r in runs.collect():
        got[r.layer] |= {(x, r.y) for x in range(r.x0, r.x1 + 1)}
    for r in report.collect():
        counts[r.layer] = (r.regions_dropped, r.region_pixels_dropped, r.holes_filled, r.hole_pixels_filled)
    for c, (cells, *numbers) in layers(m, 5).items():
        assert got[c] == cells and counts[c] == tuple(numbers)


def test_regions_of_small_images_take_no_rounds(spark, pixels):
    context = spark.sparkContext
    context.setJobGroup("regions", "")
    try:
        contours.regions(contours.layer_runs(pixels), reach=1).collect()
        assert len(context.statusTracker().getJobIdsForGroup("regions")) <= 14
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("tolerance", [None, 1.5])
def test_small_images_take_no_rounds(spark, pixels, tolerance):
    """Jobs do not grow with the length of contours, or with the splits of the simplification, within a square."""
    context = spark.sparkContext
    context.setJobGroup(f"trace {tolerance}", "")
    try:
        contours.traced(pixels, tolerance=tolerance)[0].collect()
        assert len(context.statusTracker().getJobIdsForGroup(f"trace {tolerance}")) <= 10
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
