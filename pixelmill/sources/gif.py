"""GIF: loops of indexed frames to files and back.

Writing: windows find each frame's changed rectangle, the pixels inside it are gathered
into one row a frame and coded there, so frames are coded in parallel; an image's coded
frames are then put behind its header in order. Reading decodes a file at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.palettes import Palette

KEEP, BACKGROUND = 1, 2
LARGEST = 65_535
#: Codes of the dictionary coder.
FULL = 4096


def table_bits(entries: int) -> int:
    """Bits of an index: 2 to 8."""
    return max(2, (entries - 1).bit_length())


def lzw_coded(pixels: bytes, bits: int) -> bytes:
    """The image data block of a frame: code size, codes in sub-blocks of at most 255 bytes, terminator."""
    clear, end = 1 << bits, (1 << bits) + 1
    table: dict[tuple[int, int], int] = {}
    size, following = bits + 1, end + 1
    held = filled = 0
    out = bytearray()

    def put(code):
        nonlocal held, filled
        held |= code << filled
        filled += size
        while filled >= 8:
            out.append(held & 255)
            held >>= 8
            filled -= 8

    put(clear)
    prefix = None
    for k in pixels:
        if prefix is None:
            prefix = k
            continue
        known = table.get((prefix, k))
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if following == FULL:
            put(clear)
            table.clear()
            size, following = bits + 1, end + 1
        else:
            table[prefix, k] = following
            if following == 1 << size and size < 12:
                size += 1
            following += 1
        prefix = k
    if prefix is not None:
        put(prefix)
        if following == 1 << size and size < 12:  # the reader's table grows with the last code too
            size += 1
    put(end)
    if filled:
        out.append(held & 255)
    blocks = b"".join(bytes([len(b)]) + b for b in (bytes(out[i : i + 255]) for i in range(0, len(out), 255)))
    return bytes([bits]) + blocks + b"\0"


def lzw_decoded(data: bytes, bits: int, count: int) -> bytes:
    """``count`` pixels out of joined sub-blocks."""
    clear, end = 1 << bits, (1 << bits) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, last = list(start), bits + 1, None
    out = bytearray()
    held = filled = 0
    for byte in data:
        held |= byte << filled
        filled += 8
        while filled >= size:
            code = held & (1 << size) - 1
            held >>= size
            filled -= size
            if code == clear:
                table, size, last = list(start), bits + 1, None
                continue
            if code == end or len(out) >= count:
                return bytes(out[:count])
            if code > len(table) or (code == len(table) and last is None):
                raise ValueError("a code beyond the table")
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last is not None and len(table) < FULL:
                table.append(last + now[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = now
    return bytes(out[:count])


def boxes(pixels: DataFrame, cropped: bool = True) -> DataFrame:
    """(image_id, frame, left, top, right, bottom): what a frame changes of the one before; the first frame, and all
    if not ``cropped``, whole; one pixel where nothing changes."""
    was = F.lag("idx").over(Window.partitionBy("image_id", "x", "y").orderBy("frame"))
    changed = F.col("was").isNull() | (F.col("was") != F.col("idx")) if cropped else F.lit(True)
    p = pixels.withColumn("was", was).withColumn("changed", changed)
    sides = {"left": F.min, "top": F.min, "right": F.max, "bottom": F.max}
    out = [F.coalesce(f(F.when(F.col("changed"), F.col("x" if c in ("left", "right") else "y"))), F.lit(0)).alias(c) for c, f in sides.items()]
    return p.groupBy("image_id", "frame").agg(*out)


def coded_frames(pixels: DataFrame, bits: int, cropped: bool = True) -> DataFrame:
    """(image_id, frame, left, top, wide, high, data): one row a frame, its changed rectangle coded."""
    inside = pixels.join(boxes(pixels, cropped), ["image_id", "frame"]).where("x between left and right and y between top and bottom")
    rows = inside.groupBy("image_id", "frame", "left", "top", "right", "bottom").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("idx").cast("int").alias("idx")))).alias("p"))
    rows = rows.select("image_id", "frame", "left", "top", (F.col("right") - F.col("left") + 1).alias("wide"), (F.col("bottom") - F.col("top") + 1).alias("high"), F.transform("p", lambda v: v["idx"]).alias("p"))

    def run(batches):
        for batch in batches:
            data = [lzw_coded(v.values.to_numpy().astype(np.uint8).tobytes(), bits) for v in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(data, pa.binary())], names=[*batch.schema.names[:6], "data"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:6])
    return rows.mapInArrow(run, f"{kinds}, data binary")


def _u16(x: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(x.cast("long") % 256), 2, "0"), F.lpad(F.hex(F.shiftright(x.cast("long"), 8)), 2, "0")))


def gif_files(pixels: DataFrame, palette: Palette, *, delay: int = 10, loop: bool = True, transparent: int | None = None) -> DataFrame:
    """(image_id, gif, frames, cropped_frames, pixels_written): a file for each image of (image_id, frame, x, y, w, h, idx).

    ``delay`` is in hundredths of a second. With a ``transparent`` index frames are whole and the background is
    restored after each, else a frame keeps what it does not change. An index outside the palette is an error.
    """
    entries = len(palette.colors)
    if not 0 < entries <= 256:
        raise ValueError(f"a GIF has 1 to 256 colours, not {entries}")
    if transparent is not None and not 0 <= transparent < entries:
        raise ValueError(f"no palette entry {transparent}")
    if not 0 <= delay <= LARGEST:
        raise ValueError(f"a delay of {delay} does not fit")
    checked = F.when((F.col("idx") < 0) | (F.col("idx") >= entries), F.raise_error(F.lit("an index outside the palette"))).otherwise(F.col("idx"))
    sized = F.when((F.col("w") < 1) | (F.col("h") < 1) | (F.greatest("w", "h") > LARGEST), F.raise_error(F.lit("a GIF's sides are 1 to 65535"))).otherwise(F.col("w"))
    pixels = pixels.withColumns({"idx": checked, "w": sized})
    bits = table_bits(entries)
    frames = coded_frames(pixels, bits, transparent is None)
    control = bytes([0x21, 0xF9, 4, (KEEP if transparent is None else BACKGROUND) << 2 | (transparent is not None)]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0, 0x2C])
    block = F.concat(F.lit(control), _u16(F.col("left")), _u16(F.col("top")), _u16(F.col("wide")), _u16(F.col("high")), F.lit(b"\0"), F.col("data"))
    extent = pixels.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    whole = (F.col("wide") == F.col("w")) & (F.col("high") == F.col("h"))
    per = frames.join(extent, "image_id").groupBy("image_id", "w", "h").agg(
        F.array_sort(F.collect_list(F.struct("frame", block.alias("block")))).alias("blocks"),
        F.count("*").alias("frames"),
        F.count(F.when(~whole, 1)).alias("cropped_frames"),
        F.sum(F.col("wide") * F.col("high")).alias("pixels_written"),
    )
    table = bytes(v for c in palette.colors for v in c).ljust(3 << bits, b"\0")
    screen = bytes([0x80 | (bits - 1) << 4 | bits - 1, transparent or 0, 0])
    repeat = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" if loop else b""
    body = F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b["block"]))
    gif = F.concat(F.lit(b"GIF89a"), _u16(F.col("w")), _u16(F.col("h")), F.lit(screen + table + repeat), body, F.lit(b"\x3b"))
    return per.select("image_id", gif.alias("gif"), "frames", "cropped_frames", "pixels_written")


def parts(data: bytes):
    """(width, height, frames): each frame (palette, transparent index or None, disposal, delay, left, top, wide, high, pixels)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    u16 = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, flags = u16(6), u16(8), data[10]
    at, table = 13, b""
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        table, at = data[at : at + n], at + n

    def sub_blocks(at):
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    frames, clear, disposal, delay = [], None, KEEP, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                disposal, delay, clear = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, wide, high, flags = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
            at, own = at + 10, table
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                own, at = data[at : at + n], at + n
            body, after = sub_blocks(at + 1)
            pixels = np.frombuffer(lzw_decoded(body, data[at], wide * high).ljust(wide * high, b"\0"), np.uint8).reshape(high, wide)
            at = after
            if flags & 0x40:  # interlaced: every 8th row from 0 and 4, every 4th from 2, every 2nd from 1
                order = [*range(0, high, 8), *range(4, high, 8), *range(2, high, 4), *range(1, high, 2)]
                rows = np.empty_like(pixels)
                rows[order] = pixels
                pixels = rows
            frames.append((own, clear, disposal, delay, left, top, pixels))
            clear, disposal, delay = None, KEEP, 0
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def decode_gif(data: bytes) -> list[np.ndarray]:
    """The frames as shown, each (height, width, 4) codes."""
    width, height, frames = parts(data)
    shown, out = np.zeros((height, width, 4), np.uint8), []
    for table, clear, disposal, _, left, top, pixels in frames:
        colours = np.frombuffer(table, np.uint8).reshape(-1, 3)
        before = shown.copy()
        h, w = min(pixels.shape[0], height - top), min(pixels.shape[1], width - left)
        drawn = pixels[:h, :w]
        keep = np.ones(drawn.shape, bool) if clear is None else drawn != clear
        region = shown[top : top + h, left : left + w]
        region[keep] = np.concatenate((colours[np.minimum(drawn[keep], len(colours) - 1)], np.full((keep.sum(), 1), 255, np.uint8)), axis=1)
        out.append(shown.copy())
        if disposal == BACKGROUND:
            region[:] = 0
        elif disposal == 3:
            shown = before
    return out


def frames_of(files: DataFrame) -> DataFrame:
    """(image_id, gif) -> (image_id, frame, x, y, cr, cg, cb, ca): every pixel of every frame as shown."""

    def run(batches):
        for batch in batches:
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f, codes in enumerate(decode_gif(data)):
                    h, w = codes.shape[:2]
                    y, x = np.divmod(np.arange(w * h), w)
                    columns = [np.full(w * h, id_), np.full(w * h, f), x, y, *codes.reshape(-1, 4).T.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["image_id", "frame", "x", "y", "cr", "cg", "cb", "ca"])

    kinds = ", ".join(f"{c} long" for c in ("image_id", "frame", "x", "y", "cr", "cg", "cb", "ca"))
    return files.select(F.col("image_id").cast("long"), "gif").mapInArrow(run, kinds)
