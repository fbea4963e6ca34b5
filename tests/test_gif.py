"""GIF files: coder round trips, files read back, and what a frame changes."""

import random

import numpy as np
import pytest

from pixelmill.operators.palettes import Palette
from pixelmill.sources import gif, images

SCHEMA = "image_id long, frame long, x long, y long, w long, h long, idx int"


def blocks(data):
    at, out = 1, b""
    while data[at]:
        out += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    assert at == len(data) - 1
    return out


@pytest.mark.parametrize("bits", [2, 3, 5, 8])
def test_coder(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 3, 17, 1000, 40_000):  # the last fills the table more than once
        for pixels in (bytes(rng.randrange(1 << bits) for _ in range(n)), bytes([1]) * n, bytes((i // 7) % (1 << bits) for i in range(n))):
            data = gif.lzw_coded(pixels, bits)
            assert data[0] == bits and gif.lzw_decoded(blocks(data), bits, n) == pixels
    with pytest.raises(ValueError):
        gif.lzw_decoded(bytes([0xFF] * 8), bits, 100)


def frames():
    rng = random.Random(5)
    out = {}
    for i, (w, h, n) in enumerate([(9, 6, 3), (1, 1, 2), (300, 3, 2)]):
        now = [[rng.randrange(4) for _ in range(w)] for _ in range(h)]
        for f in range(n):
            out[i, f] = [line.copy() for line in now]
            for _ in range(0 if f == 1 and i == 0 else 2):
                now[rng.randrange(h)][rng.randrange(w)] = rng.randrange(4)
    out[0, 3] = out[0, 2]  # nothing changes
    return out


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(i, f, x, y, len(m[0]), len(m), v) for (i, f), m in frames().items() for y, line in enumerate(m) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("transparent", [None, 2])
def test_files(pixels, transparent):
    palette = Palette.of("gameboy-dmg")
    files = gif.gif_files(pixels, palette, delay=7, transparent=transparent)
    got = {r.image_id: r for r in files.collect()}
    for i in {i for i, _ in frames()}:
        own = [m for (j, _), m in sorted(frames().items()) if j == i]
        w, h, read = gif.parts(got[i].gif)
        assert (w, h, len(read)) == (len(own[0][0]), len(own[0]), len(own)) and got[i].frames == len(own)
        assert all(delay == 7 and clear == transparent for _, clear, _, delay, *_ in read)
        for m, shown in zip(own, gif.decode_gif(got[i].gif), strict=True):
            expect = np.array([[(*palette.colors[v], 255) if v != transparent else (0, 0, 0, 0) for v in line] for line in m])
            assert (shown == expect).all()
        assert got[i].pixels_written == sum(p.size for *_, p in read)
    if transparent is None:
        *_, left, top, same = gif.parts(got[0].gif)[2][3]
        assert (left, top, same.shape) == (0, 0, (1, 1)) and got[0].cropped_frames >= 1
        assert b"NETSCAPE2.0" in got[0].gif and b"NETSCAPE2.0" not in gif.gif_files(pixels, palette, loop=False).first().gif
    assert gif.frames_of(files).count() == pixels.count()


def test_refusals(spark, pixels):
    palette = Palette.of("mono")
    with pytest.raises(Exception, match="outside the palette"):
        gif.gif_files(pixels, palette).collect()
    for how in ({"transparent": 2}, {"delay": -1}):
        with pytest.raises(ValueError):
            gif.gif_files(pixels, palette, **how)
    with pytest.raises(ValueError):
        gif.parts(b"GIF90a")


def test_reading_among_other_images(spark, pixels):
    """The first frame of a GIF is the image; a broken one is an error of its own."""
    files = gif.gif_files(pixels, Palette.of("gameboy-dmg")).where("image_id = 0").selectExpr("'a.gif' as path", "gif as content")
    bad = spark.createDataFrame([("b.gif", bytearray(b"GIF89a\x05\x00\x05\x00\x80\x00\x00"))], "path string, content binary")
    found = images.decode_images(files.unionAll(bad)).collect()
    assert sum(r.path == "a.gif" and r.error is None for r in found) == 54
    assert [r.error.split(":")[0] for r in found if r.path == "b.gif"] == ["broken"]
