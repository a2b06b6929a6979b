"""Pixel tables as image files.

`encode` makes one row per image (image_id, file), each image in one task; `save` writes the bytes with Spark's file system,
one file per image, from the executors' side, so any store works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.per_image import together, whole_images


def png(px: np.ndarray, level: int = 8) -> bytes:
    """An 8-bit PNG (h, w) or (h, w, 3), each row with the filter whose signed sum is least."""
    px = px if px.ndim == 3 else px[..., None]
    h, w, c = px.shape
    rows = px.reshape(h, w * c).astype(np.int16)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, c:], up[1:] = rows[:, :-c], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, c:] = rows[:-1, :-c]
    p = left + up - corner
    a, b, d = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
    forms = np.stack([rows, rows - left, rows - up, rows - (left + up) // 2, rows - paeth]).astype(np.uint8)
    best = np.abs(forms.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    raw = np.concatenate([best[:, None].astype(np.uint8), forms[best, np.arange(h)]], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def pnm(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if px.ndim == 3 else 5, w, h) + px.astype(np.uint8).tobytes()


def bmp(px: np.ndarray) -> bytes:
    """24-bit BMP; gray is repeated."""
    px = px if px.ndim == 3 else np.repeat(px[..., None], 3, 2)
    h, w = px.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = px[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def tga(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    color = px.ndim == 3
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2 if color else 3, 0, 0, 0, 0, 0, w, h, 24 if color else 8, 32) + (px[..., ::-1] if color else px).astype(np.uint8).tobytes()


def hdr(px: np.ndarray) -> bytes:
    """Radiance file without runs, of values in 0 to 255 taken back through a gamma of 2.2."""
    px = px if px.ndim == 3 else np.repeat(px[..., None], 3, 2)
    light = (px / 255.0) ** 2.2
    top = light.max(2)
    e = np.where(top > 1e-32, np.ceil(np.log2(np.maximum(top, 1e-32)) + 1e-12), 0)
    scale = np.where(top > 1e-32, np.exp2(8 - e), 0)
    rgbe = np.concatenate([np.minimum(light * scale[..., None], 255), np.where(top > 1e-32, e + 128, 0)[..., None]], 2).astype(np.uint8)
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % px.shape[:2] + rgbe.tobytes()


def jpg(px: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG without subsampling. Steps of quantization grow with the frequency; codes are of one length per table
    (4 bits for sizes of first coefficients, 8 for runs and sizes of others), which any decoder reads from the file."""
    px = (px if px.ndim == 3 else px[..., None]).astype(float)
    h, w, c = px.shape
    if c == 3:
        r, g, b = px[..., 0], px[..., 1], px[..., 2]
        px = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], -1)
    px = np.pad(px, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    u = np.arange(8)
    wave = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    steps = np.clip(np.rint(1 + (1 + u[:, None] + u[None, :]) * (100 - quality) / 25), 1, 255)
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    tiles = px.reshape(px.shape[0] // 8, 8, px.shape[1] // 8, 8, c).transpose(0, 2, 4, 1, 3)
    values = np.rint(wave @ tiles @ wave.T / steps).astype(int).reshape(-1, c, 64)[:, :, zigzag]
    others = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    code = {v: f"{i:08b}" for i, v in enumerate(others)}
    amount = lambda v: (n := int(abs(v)).bit_length(), f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")
    out, before = [], [0] * c
    for block in values.tolist():
        for k, line in enumerate(block):
            n, bits = amount(line[0] - before[k])
            before[k] = line[0]
            out.append(f"{n:04b}{bits}")
            zeros, last = 0, max((i for i in range(63, 0, -1) if line[i]), default=0)
            for v in line[1 : last + 1]:
                if not v:
                    zeros += 1
                    continue
                out.append(code[0xF0] * (zeros // 16))
                n, bits = amount(max(-1023, min(1023, v)))
                out.append(code[zeros % 16 << 4 | n] + bits)
                zeros = 0
            if last < 63:
                out.append(code[0])
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    part = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    lengths = lambda n, size: bytes(n if i == size else 0 for i in range(1, 17))
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), part(0xDB, b"\0" + bytes(int(steps.reshape(-1)[i]) for i in zigzag)),
        part(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(c))),
        part(0xC4, b"\x00" + lengths(12, 4) + bytes(range(12))), part(0xC4, b"\x10" + lengths(len(others), 8) + bytes(others)),
        part(0xDA, bytes([c]) + b"".join(bytes([k + 1, 0]) for k in range(c)) + b"\0\x3f\0"), body, b"\xff\xd9",
    ])


FORMATS = {"jpg": jpg, "png": png, "pnm": pnm, "bmp": bmp, "tga": tga, "hdr": hdr}


def encode(pixels: DataFrame, fmt: str = "png", flip: bool = False) -> DataFrame:
    """(image_id, file) of pixel rows (image_id, y, x, v) or (image_id, y, x, r, g, b); pixels that are missing are black."""
    make, color = FORMATS[fmt], "v" not in pixels.columns
    values = list("rgb" if color else "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for images in whole_images(batches, ["image_id"]):
            files = []
            for i in images.each(["y", "x", *values]):
                px = np.zeros((int(i["y"].max()) + 1, int(i["x"].max()) + 1, len(values)), np.uint8)
                px[i["y"], i["x"]] = np.stack([i[c] for c in values], 1)
                px = px[::-1] if flip else px
                files.append(make(px if color else px[..., 0]))
            yield pa.RecordBatch.from_arrays([images.table.column("image_id").take(pa.array(images.starts)).combine_chunks(), pa.array(files, pa.binary())], ["image_id", "file"])

    named = pixels.select(F.col("image_id").cast("string").alias("image_id"), "y", "x", *values)
    return together(named, ["image_id"], values).mapInArrow(work, "image_id string, file binary")


def save(pixels: DataFrame, folder: str, fmt: str = "png", flip: bool = False) -> None:
    """One file per image, named by its last path part. Files are written through pyarrow on the executors; `folder` is a
    path or URI that they all reach."""

    def write(batches):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for pdf in batches:
            fs.create_dir(base, recursive=True)
            for name, data in zip(pdf["image_id"], pdf["file"], strict=True):
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                with fs.open_output_stream(f"{base}/.{stem}.{fmt}.part") as f:
                    f.write(data)
                fs.move(f"{base}/.{stem}.{fmt}.part", f"{base}/{stem}.{fmt}")  # a task that runs again replaces its file
            yield pdf[["image_id"]]

    encode(pixels, fmt, flip).mapInPandas(write, "image_id string").count()


def write_text(df: DataFrame, path: str) -> None:
    """All columns as lines of text, separated by blanks."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)
