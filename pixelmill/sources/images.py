"""Image files: what they are, how large, and PNG in and out. One bad file is an error row, never a failed job."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.diffusion import PIXEL_LIMIT, SIDE_LIMIT
from pixelmill.operators.spatial import image
from pixelmill.plans.rel import SparkRel
from pixelmill.sources.gif import decode_gif
from pixelmill.sources.rasters import COLOUR, PIXEL

#: First bytes of each format; fixed values.
MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "webp": b"RIFF"}
#: Channels of PNG colour types.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def sniff(raw: bytes) -> str | None:
    kind = next((k for k, m in MAGIC.items() if raw.startswith(m)), None)
    return None if kind == "webp" and raw[8:12] != b"WEBP" else kind


def extent(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from the header alone; None if it does not say."""
    kind = sniff(raw)
    try:
        if kind == "png":
            return struct.unpack(">II", raw[16:24])
        if kind == "gif":
            return struct.unpack("<HH", raw[6:10])
        if kind == "bmp":
            w, h = struct.unpack("<ii", raw[18:26])
            return w, abs(h)
        if kind == "webp":
            if raw[12:16] == b"VP8X":
                return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
            if raw[12:16] == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", raw[26:30])
            return w & 0x3FFF, h & 0x3FFF
        at = 2
        while kind == "jpeg" and at + 9 < len(raw):
            mark, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h
            at += 2 + size
    except struct.error:
        pass
    return None


def problem(raw: bytes) -> str | None:
    """Why a file cannot be read, from its header."""
    if sniff(raw) is None:
        return "unknown-format"
    size = extent(raw)
    if size is None or min(size) < 1:
        return "bad-header"
    return "too-large" if max(size) > SIDE_LIMIT or size[0] * size[1] > PIXEL_LIMIT else None


def _chunks(raw: bytes):
    at = 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        yield kind, raw[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters."""
    kinds, out = lines[:, 0], lines[:, 1:].astype(np.int32)
    before = np.zeros(out.shape[1], np.int32)
    for y, kind in enumerate(kinds):
        row = out[y]
        if kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step])
        elif kind == 2:
            row += before
        elif kind in (3, 4):
            for at in range(0, len(row), step):
                left = row[at - step : at] if at else np.zeros(step, np.int32)
                up, corner = before[at : at + step], before[at - step : at] if at else np.zeros(step, np.int32)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[at : at + step] = (row[at : at + step] + guess) & 255
        row &= 255
        before = row
    return out.astype(np.uint8)


#: Passes of an interlaced PNG: first column and row, and the steps between; fixed values.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(lines: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """(row, column, channel) of unfiltered lines of 1 to 16 bits a sample."""
    h = len(lines)
    if bits == 16:
        return (lines[:, ::2].astype(np.int32) << 8 | lines[:, 1::2]).reshape(h, width, channels)
    if bits < 8:
        each = np.unpackbits(lines, axis=1).reshape(h, -1, bits)
        lines = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2)[:, : width * channels]
    return lines.astype(np.int32).reshape(h, width, channels)


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, 4) codes of a PNG of any kind; samples of other widths are scaled to 8 bits, to the nearest."""
    head, data, palette, clear = None, [], None, None
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
    w, h, bits, colour, _, _, interlaced = head
    if bits not in (1, 2, 4, 8, 16) or colour not in CHANNELS:
        raise ValueError("unsupported-png")
    n = CHANNELS[colour]
    body = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    v, at = np.zeros((h, w, n), np.int32), 0
    for x0, y0, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        wide, high = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if wide > 0 and high > 0:
            line = 1 + -(-wide * n * bits // 8)
            lines = _unfiltered(body[at : at + high * line].reshape(high, line), max(1, n * bits // 8))
            v[y0::dy, x0::dx] = _samples(lines, wide, n, bits)
            at += high * line
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        return np.concatenate((palette[v[..., 0]], alpha[v]), axis=2)
    most = (1 << bits) - 1
    codes = ((v * 255 + most // 2) // most).astype(np.uint8)
    opaque = np.full((h, w, 1), 255, np.uint8)
    if clear is not None and colour in (0, 2):  # one grey or colour, in samples as stored, is transparent
        opaque[(v == np.frombuffer(clear, ">u2", n)).all(2)] = 0
    return np.concatenate({1: (codes, codes, codes, opaque), 2: (codes[..., :1],) * 3 + (codes[..., 1:],), 3: (codes, opaque), 4: (codes,)}[n], axis=2)


def encode_png(codes: np.ndarray) -> bytes:
    """A PNG of (height, width, 4) codes; every row takes the filter with the smallest sum of absolute values."""
    h, w, n = codes.shape
    v = codes.astype(np.int32)
    left, up = np.zeros_like(v), np.zeros_like(v)
    left[:, 1:], up[1:] = v[:, :-1], v[:-1]
    corner = np.zeros_like(v)
    corner[1:, 1:] = v[:-1, :-1]
    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    tries = np.stack([(v - g) & 255 for g in (0 * v, left, up, (left + up) // 2, guess)]).reshape(5, h, w * n)
    best = np.minimum(tries, 256 - tries).sum(2).argmin(0)
    rows = np.concatenate((best[:, None], tries[best, np.arange(h)]), axis=1).astype(np.uint8)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return MAGIC["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def probe(files: DataFrame) -> DataFrame:
    """(path, content) as of ``binaryFile`` -> (path, format, width, height, error), from the headers."""

    def run(batches):
        for batch in batches:
            heads = [v.as_py() or b"" for v in batch.column(1)]
            sizes = [extent(x) or (None, None) for x in heads]
            columns = [[sniff(x) for x in heads], *zip(*sizes, strict=True), [problem(x) for x in heads]] if heads else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["path", "format", "width", "height", "error"])

    # a JPEG's size may stand behind a profile of some hundred KB
    return files.select("path", F.substring("content", 1, 1 << 20).alias("head")).mapInArrow(run, "path string, format string, width long, height long, error string")


DECODED = "image_id long, x long, y long, w long, h long, r double, g double, b double, a double, path string, error string"


def decode_images(files: DataFrame) -> DataFrame:
    """(path, content) -> a row for each pixel in linear light, its ``image_id`` a hash of the path; a file that cannot
    be read has one row with nulls and its ``error``. Files are read one at a time, and only within the limits."""
    linear = np.array([c / 12.92 if c <= 0.040448237 else ((c + 0.055) / 1.055) ** 2.4 for c in np.arange(256) / 255])

    def run(batches):
        for batch in batches:
            for id_, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                error, codes = problem(content or b""), None
                if error is None:
                    try:
                        codes = {"png": decode_png, "gif": lambda x: decode_gif(x)[0]}.get(sniff(content), lambda _: None)(content)
                        error = None if codes is not None else "no-decoder"
                    except Exception as e:  # noqa: BLE001  whatever a broken file does, it is that file's error
                        error = f"broken: {e}"
                if codes is None:
                    none = [pa.nulls(1, t) for t in (pa.int64(),) * 4 + (pa.float64(),) * 4]
                    columns = [pa.array([id_]), *none, pa.array([path]), pa.array([error])]
                else:
                    h, w = codes.shape[:2]
                    y, x = np.divmod(np.arange(w * h), w)
                    flat = codes.reshape(-1, 4)
                    size = [np.full(w * h, v) for v in (id_, w, h)]
                    columns = [size[0], x, y, size[1], size[2], *linear[flat[:, :3]].T, flat[:, 3] / 255.0]
                    columns = [pa.array(c) for c in columns] + [pa.array([path] * (w * h)), pa.nulls(w * h, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DECODED.split(", ")])

    return files.select(F.xxhash64("path").alias("id"), "path", "content").mapInArrow(run, DECODED)


def read_images(spark: SparkSession, path: str) -> tuple[SparkRel, DataFrame]:
    """(pixels, errors) of all files below ``path``; errors are (image_id, path, error)."""
    found = decode_images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return SparkRel(found.where("error is null").select(*PIXEL, *COLOUR)), found.where("error is not null").select("image_id", "path", "error")


def png_files(rel: SparkRel) -> DataFrame:
    """(image_id, [frame,] w, h, png): every image's bytes; an image is one group, within the limits."""
    from pixelmill.operators.census import rgba8

    one = [*image(rel), "w", "h"]
    pixels = F.array_sort(F.collect_list(F.struct("y", "x", "cr", "cg", "cb", "ca")))
    planes = rgba8(rel).df.groupBy(*one).agg(pixels.alias("p"))
    planes = planes.select(F.struct(*one).alias("key"), "w", "h", F.flatten(F.transform("p", lambda v: F.array(v["cr"], v["cg"], v["cb"], v["ca"]))).alias("codes"))
    kind = planes.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)
            files = [encode_png(v.values.to_numpy().astype(np.uint8).reshape(h, w, 4)) for w, h, v in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["key", "png"])

    return planes.mapInArrow(run, f"key {kind}, png binary").select("key.*", "png")
