"""Image files in and out, and streams of them."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from pixelframe.operators import histogram
from pixelframe.sources import images, writers
from pixelframe.streaming import images as streaming


def frame(spark, px, name="a"):
    color = px.ndim == 3
    rows = [(name, y, x, *map(int, px[y, x] if color else [px[y, x]])) for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, " + ("r int, g int, b int" if color else "v int"))


def back(df, color):
    rows = df.orderBy("y", "x").collect()
    h, w = rows[-1]["y"] + 1, rows[-1]["x"] + 1
    values = [[r["r"], r["g"], r["b"]] if color else [r["v"]] for r in rows]
    out = np.array(values).reshape(h, w, -1)
    return out if color else out[..., 0]


@pytest.mark.parametrize("fmt", ["png", "pnm", "bmp", "tga"])
@pytest.mark.parametrize("color", [False, True])
def test_round_trip(spark, tmp_path, fmt, color):
    px = np.random.default_rng(1).integers(0, 256, (5, 7, 3) if color else (5, 7))
    writers.save(frame(spark, px), str(tmp_path), fmt)
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == [f"a.{fmt}"]
    read = images.read_images(spark, str(tmp_path)) if fmt in ("png", "bmp") else images.read_binary_images(spark, str(tmp_path))
    assert (back(images.pixels(read, 3 if color else 1), color) == px).all() or (fmt == "bmp" and not color)
    meta = images.metadata(read).first()
    assert (meta["height"], meta["width"]) == (5, 7)


@pytest.mark.parametrize("shape", [(5, 7, 3), (17, 9), (8, 16, 3)])
def test_jpg(spark, tmp_path, shape):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    px = np.stack([yy * 12, xx * 11, yy * 3 + xx * 5], -1) % 256 if len(shape) == 3 else (yy * 7 + xx * 9) % 256
    writers.save(frame(spark, px), str(tmp_path), "jpg")
    got = back(images.pixels(images.read_images(spark, str(tmp_path)), 3 if len(shape) == 3 else 1), len(shape) == 3)
    assert got.shape == px.shape and np.abs(got - px).max() <= 12 and np.abs(got - px).mean() < 2.5


def test_jpg_of_noise_keeps_its_values(spark, tmp_path):
    px = np.random.default_rng(8).integers(0, 256, (24, 24))
    (tmp_path / "n.jpg").write_bytes(writers.jpg(px, quality=100))
    assert np.abs(back(images.pixels(images.read_images(spark, str(tmp_path)), 1), False) - px).max() <= 3


def test_one_reader_for_all_formats(spark, tmp_path):
    px = np.random.default_rng(9).integers(0, 256, (6, 5, 3))
    for fmt, make in writers.FORMATS.items():
        (tmp_path / f"a_{fmt}.dat").write_bytes(make(px))
    # a GIF of 2 by 1: palette of two colors
    (tmp_path / "g.gif").write_bytes(b"GIF89a\2\0\1\0\x80\0\0" + bytes([10, 20, 30, 200, 100, 50]) + b",\0\0\0\0\2\0\1\0\0\2\2D\n\0;")
    (tmp_path / "x.txt").write_bytes(b"no image at all")
    got = images.read_any(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.collect()) == [*sorted(f"a_{f}.dat" for f in writers.FORMATS), "g.gif"]
    values = images.pixels(got, 3)
    for fmt in ("png", "bmp", "pnm", "tga"):
        assert (back(values.where(f"image_id like '%a_{fmt}.dat'"), True) == px).all()
    assert [tuple(r) for r in values.where("image_id like '%g.gif'").orderBy("x").select("r", "g", "b").collect()] == [(10, 20, 30), (200, 100, 50)]


def test_deep_images(spark, tmp_path):
    deep = np.random.default_rng(2).integers(0, 65536, (3, 4)).astype(">u2")
    (tmp_path / "a.pgm").write_bytes(b"P5 4 3 65535\n" + deep.tobytes())
    read = lambda depth: back(images.pixels(images.read_binary_images(spark, str(tmp_path), depth=depth), 1, depth=depth), False)
    assert (read(16) == deep).all() and (read(8) == deep >> 8).all()
    assert np.allclose(read("float"), ((deep >> 8) / 255) ** 2.2)
    px = np.random.default_rng(3).integers(0, 256, (2, 2)).astype(np.uint8)
    (tmp_path / "a.pgm").write_bytes(writers.pnm(px))
    assert (read(16) == px.astype(int) * 257).all()
    (tmp_path / "a.pgm").unlink()
    (tmp_path / "b.hdr").write_bytes(writers.hdr(px))
    light = (px / 255.0) ** 2.2
    assert np.allclose(read("float"), light, atol=light.max() / 120)


def test_png_decoder_takes_all_depths_and_filters():
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    make = lambda w, h, bits, color, raw, *more: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert images.decode(make(3, 1, 1, 0, b"\0\xa0")) == (1, 3, 1, bytes([255, 0, 255]))
    assert images.decode(make(3, 1, 4, 0, b"\0\x1f\x70")) == (1, 3, 1, bytes([17, 255, 119]))
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])), chunk(b"tRNS", bytes([9]))
    assert images.decode(make(2, 1, 8, 3, b"\0\0\1", *palette)) == (1, 2, 4, bytes([1, 2, 3, 9, 4, 5, 6, 255]))
    assert images.decode(make(2, 1, 16, 0, b"\0\1\2\3\4"), 16) == (1, 2, 1, struct.pack("<HH", 0x102, 0x304))
    px = np.random.default_rng(1).integers(0, 256, (30, 20, 3)).astype(np.uint8)
    px[10:20] = px[10]
    px[:, 5:9] = 7
    assert images.decode(writers.png(px)) == (30, 20, 3, px.tobytes())
    rows = b"".join(bytes([k % 5]) + bytes(60) for k in range(30))  # zeros by every filter
    assert images.decode(make(20, 30, 8, 2, rows))[3] == bytes(1800)


def test_sizes_beyond_the_limit_are_refused_before_decoding():
    for data in (b"P5 99999999 2 255\n", b"8BPS\0\1" + b"\0" * 6 + struct.pack(">HIIHH", 3, 1 << 25, 2, 8, 3), b"P5 0 3 255\n"):
        with pytest.raises(ValueError, match="an image of"):
            images.decode(data)


def test_channels_and_flip(spark, tmp_path):
    px = np.random.default_rng(3).integers(0, 256, (4, 3, 3))
    writers.save(frame(spark, px), str(tmp_path), "png")
    read = images.read_images(spark, str(tmp_path))
    light = (77 * px[..., 0] + 150 * px[..., 1] + 29 * px[..., 2]) >> 8
    assert (back(images.pixels(read, 1), False) == light).all()
    assert (back(images.pixels(read, 1, flip=True), False) == light[::-1]).all()


@pytest.mark.parametrize("fmt", ["png", "pnm", "tga"])
def test_flip_on_write(spark, tmp_path, fmt):
    px = np.random.default_rng(5).integers(0, 256, (4, 3, 3))
    writers.save(frame(spark, px), str(tmp_path), fmt, flip=True)
    read = images.read_any(spark, str(tmp_path))
    assert (back(images.pixels(read, 3), True) == px[::-1]).all()
    assert (back(images.pixels(read, 3, flip=True), True) == px).all()


def test_bad_files_are_left_out(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    assert images.read_images(spark, str(tmp_path)).count() == 0
    assert images.read_binary_images(spark, str(tmp_path)).count() == 0
    assert images.read_binary_images(spark, str(tmp_path), drop_invalid=False).first()["data"] is None


def test_decoders():
    px = np.random.default_rng(4).integers(0, 256, (3, 10, 3)).astype(np.uint8)
    h, w, c, data = images.decode(writers.hdr(px))
    # eight bits of a shared exponent: a value is off by at most half a step of the brightest of its pixel, in light
    light, top = (np.frombuffer(data, np.uint8).reshape(px.shape) / 255.0) ** 2.2, (px / 255.0).max(2, keepdims=True) ** 2.2
    assert (h, w, c) == (3, 10, 3) and (np.abs(light - (px / 255.0) ** 2.2) <= top / 64 + 0.02).all()
    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, 3, 10, 8, 3) + b"\0" * 12
    planes = px.transpose(2, 0, 1)
    assert images.decode(head + b"\0\0" + planes.tobytes())[3] == px.tobytes()
    packed = b"".join(bytes([9]) + row.tobytes() for plane in planes for row in plane)
    assert images.decode(head + b"\0\1" + b"\0" * (2 * 9) + packed)[3] == px.tobytes()
    # an HDR row by runs, an HDR row plain, a TGA with a palette, a PIC with runs of both kinds
    line = b"\2\2\0\x0a" + b"".join(bytes([0x80 + 6, v, 4, *[v] * 4]) for v in (128, 64, 32, 129))
    assert images.decode(b"#?RADIANCE\n\n-Y 1 +X 10\n" + line, "float") == images.decode(b"#?RGBE\n\n-Y 1 +X 10\n" + bytes([128, 64, 32, 129]) * 10, "float")
    assert np.frombuffer(images.decode(b"#?RADIANCE\n\n-Y 1 +X 10\n" + line, "float")[3], "<f4")[:3].tolist() == [1.0, 0.5, 0.25]
    mapped = struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, 2, 24, 0, 0, 2, 1, 8, 32) + bytes([1, 2, 3, 4, 5, 6]) + bytes([1, 0])
    assert images.decode(mapped) == (1, 2, 3, bytes([6, 5, 4, 3, 2, 1]))
    mixed = b"\x53\x80\xf6\x34" + b"\0" * 88 + struct.pack(">HH", 3, 1) + b"\0" * 8 + bytes([0, 8, 2, 0xE0, 0x81, 1, 2, 3, 0, 4, 5, 6])
    assert images.decode(mixed) == (1, 3, 3, bytes([1, 2, 3, 1, 2, 3, 4, 5, 6]))
    runs = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 4, 1, 24, 32) + bytes([0x82, 1, 2, 3, 0x00, 4, 5, 6])
    assert images.decode(runs) == (1, 4, 3, bytes([3, 2, 1] * 3 + [6, 5, 4]))
    assert images.decode(b"P5\n# note\n2 1\n65535\n" + bytes([7, 9, 8, 9])) == (1, 2, 1, bytes([7, 8]))
    pic = b"\x53\x80\xf6\x34" + b"\0" * 88 + struct.pack(">HH", 2, 1) + b"\0" * 8 + bytes([0, 8, 1, 0xE0, 2, 10, 20, 30])
    assert images.decode(pic) == (1, 2, 3, bytes([10, 20, 30, 10, 20, 30]))


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    px = np.random.default_rng(6).integers(0, 256, (6, 6)).astype(np.uint8)
    (source / "a.pgm").write_bytes(writers.pnm(px))
    (source / "b.pgm").write_bytes(writers.pnm(px[::-1]))
    for _ in range(2):  # the second run finds nothing new
        streaming.segment_stream(streaming.read_stream(spark, str(source)), str(out), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.groupBy("image_id").count().count() == 2 and got.count() == 72
    whole = histogram.otsu_binarize(frame(spark, px), ["image_id"]).where("bw = 255").count()
    assert got.where("v = 255").count() == 2 * whole


def test_text(spark, tmp_path):
    writers.write_text(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "1 a"
