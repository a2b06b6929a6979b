"""Image files as pixel tables.

JPEG, PNG, BMP and GIF go through Spark's image source, which decodes in the JVM; its bytes come in the order blue, green,
red. PNM, TGA, PSD, PIC, HDR and PNG files go through `binaryFile` and numpy decoders, which can also give values of 16
bits or floats. Both give image rows (path, height, width, channels, data), with values in the order red, green, blue, which
`pixels` spreads over rows. `read_any` tells the formats apart by their first bytes.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: larger images are refused.
MAX_DIMENSION = 1 << 24
IMAGE = "path string, height int, width int, channels int, data binary"
#: The first bytes, in hexadecimal, of the formats that the JVM decodes (PNG, JPEG, GIF, BMP).
JVM_MARKS = ("89504E47", "FFD8FF", "47494638", "424D")
#: Types of an image row's values by depth.
DEPTHS = {8: "u1", 16: "<u2", "float": "<f4"}
Image = tuple[int, int, int, np.ndarray]


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True, glob: str = "*") -> DataFrame:
    """Image rows of the formats that the JVM decodes; unreadable files are left out or have null data."""
    src = spark.read.format("image").option("dropInvalid", drop_invalid).option("pathGlobFilter", glob).load(path)
    good = F.col("image.nChannels") > 0
    rows = src.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.when(good, F.col("image.data")).alias("data"))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["data"] = [d if d is None or c < 3 else np.frombuffer(d, np.uint8).reshape(-1, c)[:, [2, 1, 0, *range(3, c)]].tobytes() for d, c in zip(pdf["data"], pdf["channels"], strict=True)]
            yield pdf

    return guarded(rows.mapInPandas(ordered, IMAGE))


def guarded(images: DataFrame) -> DataFrame:
    """Images within the dimension limit."""
    return images.where((F.col("height") <= MAX_DIMENSION) & (F.col("width") <= MAX_DIMENSION))


def metadata(images: DataFrame) -> DataFrame:
    """(path, height, width, channels)."""
    return images.select("path", "height", "width", "channels")


def _sized(h: int, w: int) -> tuple[int, int]:
    """Refuse, before anything is decoded, what is no size or beyond the limit."""
    if not (0 < h <= MAX_DIMENSION and 0 < w <= MAX_DIMENSION):
        raise ValueError(f"an image of {h} by {w}")
    return h, w


def _pnm(d: bytes) -> Image:
    fields, at = [], 2
    while len(fields) < 3:
        while d[at : at + 1].isspace():
            at += 1
        if d[at : at + 1] == b"#":
            at = d.index(b"\n", at)
            continue
        end = at
        while end < len(d) and not d[end : end + 1].isspace():
            end += 1
        fields.append(int(d[at:end]))
        at = end
    w, h, top = fields
    h, w = _sized(h, w)
    c = 3 if d[:2] == b"P6" else 1
    raw = np.frombuffer(d, ">u2" if top > 255 else np.uint8, w * h * c, at + 1)
    return h, w, c, raw.astype(np.uint16 if top > 255 else np.uint8)


def _png(d: bytes) -> Image:
    """PNG files that are not interlaced; colors of a palette and with a transparent one are spelled out."""
    at, body, palette, clear = 8, b"", None, None
    while at < len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        part = d[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, color, _, _, laced = struct.unpack(">IIBBBBB", part)
            h, w = _sized(h, w)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if laced:
        raise ValueError("interlaced PNG files are read by the JVM")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, row = max(1, c * bits // 8), (w * c * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8, h * (row + 1)).reshape(h, row + 1)
    out, above = np.zeros((h, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            now, up = line.tolist(), above.tolist()
            for i in range(row):
                left, corner = (now[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                now[i] = (now[i] + guess) & 255
            line = np.array(now, np.uint8)
        elif kind:
            raise ValueError(f"a PNG filter of {kind}")
        out[y] = above = line
    if bits == 16:
        px = out.reshape(h, w * c, 2).astype(np.uint16)
        px = px[..., 0] << 8 | px[..., 1]
    elif bits == 8:
        px = out
    else:
        px = np.unpackbits(out, axis=1).reshape(h, -1, bits)[:, :w]
        px = (px * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)
        px = px if color == 3 else px * (255 // ((1 << bits) - 1))
    if color == 3:
        index, px = px, palette[px]
        if clear is not None:
            alpha = np.frombuffer(clear.ljust(256, b"\xff"), np.uint8)
            px = np.concatenate([px, alpha[index][..., None]], 2)
    px = px.reshape(h, w, -1)
    return h, w, px.shape[2], px


def _tga(d: bytes) -> Image:
    skip, mapped, kind = d[0], d[1], d[2]
    first, count, depth = struct.unpack_from("<HHB", d, 3)
    w, h, bits, flags = struct.unpack_from("<HHBB", d, 12)
    h, w = _sized(h, w)
    at, size = 18 + skip, (bits + 7) // 8
    table = None
    if mapped:
        n = (depth + 7) // 8
        table = np.frombuffer(d, np.uint8, count * n, at).reshape(count, n)
        at += count * n
    if kind >= 9:  # runs
        out, need = bytearray(), w * h * size
        while len(out) < need:
            n, run = (d[at] & 127) + 1, d[at] & 128
            at += 1
            out += d[at : at + size] * n if run else d[at : at + size * n]
            at += size if run else size * n
        raw = np.frombuffer(bytes(out[:need]), np.uint8)
    else:
        raw = np.frombuffer(d, np.uint8, w * h * size, at)
    px = raw.reshape(h, w, size)
    if table is not None:
        px = table[px[..., 0].astype(int) - first]
    if px.shape[2] == 2 and (bits in (15, 16) and kind % 8 != 3):
        word = px[..., 0].astype(int) | px[..., 1].astype(int) << 8
        px = np.stack([(word & 31) * 255 // 31, (word >> 5 & 31) * 255 // 31, (word >> 10 & 31) * 255 // 31], -1).astype(np.uint8)
    if not flags & 32:
        px = px[::-1]
    if px.shape[2] >= 3:
        px = px[..., [2, 1, 0, *range(3, px.shape[2])]]
    return h, w, px.shape[2], px


def _packbits(d: bytes, at: int, need: int) -> tuple[bytes, int]:
    out = bytearray()
    while len(out) < need:
        n = d[at]
        at += 1
        if n < 128:
            out += d[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += d[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:need]), at


def _psd(d: bytes) -> Image:
    version, channels, h, w, depth, mode = struct.unpack_from(">H6xHIIHH", d, 4)
    if version != 1 or depth not in (8, 16) or mode != 3:
        raise ValueError("PSD files are read in RGB with 8 or 16 bits")
    h, w = _sized(h, w)
    at = 26
    for _ in range(3):
        at += 4 + struct.unpack_from(">I", d, at)[0]
    packed = struct.unpack_from(">H", d, at)[0]
    at += 2
    planes = []
    if packed:
        at += 2 * h * channels
    for _ in range(channels):
        if packed:
            raw, at = _packbits(d, at, w * h)
            planes.append(np.frombuffer(raw, np.uint8))
        else:
            planes.append(np.frombuffer(d, ">u2", w * h, at).astype(np.uint16) if depth == 16 else np.frombuffer(d, np.uint8, w * h, at))
            at += w * h * depth // 8
    n = min(channels, 4)
    return h, w, n, np.stack(planes[:n], -1)


def _hdr(d: bytes) -> Image:
    head, _, rest = d.partition(b"\n\n")
    size, _, d = rest.partition(b"\n")
    _, h, _, w = size.split()
    (h, w), at = _sized(int(h), int(w)), 0
    rgbe = np.zeros((h, w, 4), np.uint8)
    if d[:2] != b"\x02\x02" or not 8 <= w < 32768:
        rgbe = np.frombuffer(d, np.uint8, h * w * 4).reshape(h, w, 4)
    else:
        for y in range(h):
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    n = d[at]
                    if n > 128:
                        rgbe[y, x : x + n - 128, c] = d[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        rgbe[y, x : x + n, c] = np.frombuffer(d, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
    light = rgbe[..., :3] * np.exp2(rgbe[..., 3:].astype(float) - 136) * (rgbe[..., 3:] > 0)
    return h, w, 3, light.astype(np.float32)


def _pic(d: bytes) -> Image:
    w, h = struct.unpack_from(">HH", d, 92)
    h, w = _sized(h, w)
    at, packets, more = 104, [], 1
    while more:
        more, size, kind, mask = d[at : at + 4]
        packets.append((size, kind, [c for c in range(4) if mask & (0x80 >> c)]))
        at += 4
    out = np.full((h, w, 4), 255, np.uint8)
    alpha = any(3 in p[2] for p in packets)
    for y in range(h):
        for _, kind, places in packets:
            x, n = 0, len(places)
            while x < w:
                if kind == 0:
                    run, count = False, w - x
                else:
                    count, at = d[at], at + 1
                    run = kind == 1 or count >= 128
                    if kind == 2 and count >= 128:
                        count, at = (struct.unpack_from(">H", d, at)[0], at + 2) if count == 128 else (count - 127, at)
                    elif kind == 2:
                        count += 1
                count = min(count, w - x)
                values = np.frombuffer(d, np.uint8, n if run else n * count, at)
                out[y, x : x + count, places] = np.repeat(values[:, None], count, 1) if run else values.reshape(count, n).T
                x, at = x + count, at + len(values)
    c = 4 if alpha else 3
    return h, w, c, out[..., :c]


def decode(data: bytes, depth: int | str = 8) -> tuple[int, int, int, bytes]:
    """(height, width, channels, values) of a PNM, PNG, PSD, PIC, HDR or TGA file, told by its first bytes; TGA, which has no
    mark, last. Values are bytes (of 16 bits the high one, of floats a gamma of 2.2), 16 bits (a byte twice), or floats
    (bytes back through the gamma; alpha, the last of 2 or 4 channels, as it is)."""
    h, w, c, px = _natural(data)
    if depth == 16 and px.dtype == np.uint16:
        return h, w, c, px.astype("<u2").tobytes()
    if depth == "float" and px.dtype == np.float32:
        return h, w, c, px.astype("<f4").tobytes()
    if px.dtype == np.float32:
        px = np.clip(px.astype(float) ** (1 / 2.2) * 255 + 0.5, 0, 255)
    px = (px >> 8 if px.dtype == np.uint16 else px).astype(np.uint8).reshape(h, w, c)
    if depth == 16:
        px = px.astype("<u2") * 257
    elif depth == "float":
        px = px / 255.0
        colors = c - (c in (2, 4))
        px[..., :colors] **= 2.2
    return h, w, c, px.astype(DEPTHS[depth]).tobytes()


def _natural(data: bytes) -> Image:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    if data[:4] == b"8BPS":
        return _psd(data)
    if data[:4] == b"\x53\x80\xf6\x34":
        return _pic(data)
    if data[:10] == b"#?RADIANCE" or data[:6] == b"#?RGBE":
        return _hdr(data)
    return _tga(data)


def decoded(files: DataFrame, drop_invalid: bool = True, depth: int | str = 8) -> DataFrame:
    """Image rows of binaryFile rows (path, content), batch or streaming, with values of 8 or 16 bits or floats."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((path, *decode(content, depth)))
                except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error):
                    if not drop_invalid:
                        out.append((path, -1, -1, -1, None))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "data"])

    return guarded(files.select("path", "content").mapInPandas(work, IMAGE))


def read_binary_images(spark: SparkSession, path: str, glob: str = "*", drop_invalid: bool = True, depth: int | str = 8) -> DataFrame:
    """Image rows of PNM, TGA, PSD, PIC, HDR and PNG files, with values of 8 or 16 bits or floats."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), drop_invalid, depth)


def read_any(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Image rows of all formats, told by their first bytes; files that are no images are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    mark = F.hex(F.substring("content", 1, 4))
    other = files.where(~functools.reduce(lambda a, b: a | b, [mark.startswith(m) for m in JVM_MARKS]))
    return read_images(spark, path, glob=glob).unionByName(decoded(other))


def pixels(images: DataFrame, channels: int, flip: bool = False, depth: int | str = 8) -> DataFrame:
    """(image_id, y, x, v) for one channel or (image_id, y, x, r, g, b) for three; missing channels are made, extra ones
    folded or dropped. `flip` counts rows from below. Values are of the depth with which the images were read."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, h, w, c, data in pdf[["path", "height", "width", "channels", "data"]].itertuples(index=False):
                if data is None:
                    continue
                px = np.frombuffer(data, DEPTHS[depth]).reshape(h, w, c).astype(kind)
                px = px[::-1] if flip else px
                light = px[..., 0] if c < 3 else 77 * px[..., 0] + 150 * px[..., 1] + 29 * px[..., 2]
                light = light if c < 3 else light / 256 if depth == "float" else light >> 8
                step = max(1, (1 << 20) // max(w, 1))
                for y0 in range(0, h, step):  # some rows at a time
                    n = min(step, h - y0)
                    at = {"image_id": path, "y": np.repeat(np.arange(y0, y0 + n, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), n)}
                    values = {"v": light} if channels == 1 else dict(zip("rgb", [px[..., min(i, c - 1) if c >= 3 else 0] for i in range(3)], strict=True))
                    yield pd.DataFrame(at | {k: v[y0 : y0 + n].reshape(-1) for k, v in values.items()})

    if channels not in (1, 3):
        raise ValueError("pixel tables have one or three channels")
    kind, sql = (np.float64, "double") if depth == "float" else (np.int32, "int")
    return images.mapInPandas(spread, "image_id string, y int, x int, " + ", ".join(f"{c} {sql}" for c in ("v" if channels == 1 else "rgb")))
