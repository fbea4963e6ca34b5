"""PNG files of every colour type, depth and layout, written here sample by sample."""

import struct
import zlib

import numpy as np
import pytest

from pixelmill.sources import images

KINDS = [(0, b) for b in (1, 2, 4, 8, 16)] + [(2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def lines(v, bits):
    """Packed rows of samples, each behind filter 0."""
    out = b""
    for row in v:
        text = "".join(format(int(s), f"0{bits}b") for pixel in row for s in pixel)
        text += "0" * (-len(text) % 8)
        out += b"\0" + bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
    return out


def written(v, colour, bits, interlaced, clear=None, palette=None):
    h, w, _ = v.shape
    passes = images.ADAM7 if interlaced else ((0, 0, 1, 1),)
    body = b"".join(lines(v[y::dy, x::dx], bits) for x, y, dx, dy in passes if v[y::dy, x::dx].size)
    out = images.MAGIC["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced))
    out += chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return out + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize(("colour", "bits"), KINDS)
def test_every_kind(colour, bits, interlaced):
    rng = np.random.default_rng(colour * 100 + bits)
    for w, h in ((13, 9), (1, 1), (3, 2)):
        n = images.CHANNELS[colour]
        v = rng.integers(0, 1 << bits, (h, w, n))
        if colour == 3:
            palette, alpha = rng.integers(0, 256, (1 << bits, 3)).astype(np.uint8), bytes([7, 200])
            got = images.decode_png(written(v, colour, bits, interlaced, alpha, palette))
            full = np.full(1 << bits, 255)
            full[:2] = list(alpha)
            assert (got[..., :3] == palette[v[..., 0]]).all() and (got[..., 3] == full[v[..., 0]]).all()
            continue
        codes = np.round(v / ((1 << bits) - 1) * 255).astype(int)
        got = images.decode_png(written(v, colour, bits, interlaced))
        rgb = codes[..., : n - (n % 2 == 0)]
        assert (got[..., :3] == rgb).all() and (got[..., 3] == (codes[..., -1] if n % 2 == 0 else 255)).all()
        if colour in (0, 2):
            one = v[h // 2, w // 2]
            got = images.decode_png(written(v, colour, bits, interlaced, struct.pack(f">{n}H", *one)))
            assert ((got[..., 3] == 0) == (v == one).all(2)).all()


def test_what_is_written_is_read():
    codes = np.random.default_rng(3).integers(0, 256, (7, 11, 4)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(codes)) == codes).all()
