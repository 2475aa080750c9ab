"""Figures are decoded from their files, and the pixels of each bar counted."""

import struct
import zlib

import numpy as np

from modetrace.config import CANONICAL
from modetrace.sources import png, render


def decode(raw):
    assert raw[:8] == png.SIGNATURE
    at, data, kinds = 8, b"", []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        kinds.append(kind)
        if kind == b"IHDR":
            width, height, depth, color, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, color, rest) == (8, 2, [0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    assert kinds == [b"IHDR", b"IDAT", b"IEND"]
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + 3 * width)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, 3)


def of_color(pixels, color):
    return int((pixels == np.array(png.rgb(color), dtype=np.uint8)).all(axis=2).sum())


def test_canvas():
    canvas = png.Canvas(40, 20)
    canvas.rectangle(5, 5, 10, 4, "hsl(0,100%,50%)")
    canvas.rectangle(-3, 18, 10, 10, (1, 2, 3))
    canvas.text(20, 2, "É1")
    pixels = decode(canvas.encode())
    assert pixels.shape == (20, 40, 3) and of_color(pixels, (255, 0, 0)) == 40 and of_color(pixels, (1, 2, 3)) == 14
    assert of_color(pixels, png.BLACK) == 4 * sum(bin(int(d)).count("1") for c in "E1" for d in png.FONT[c])
    assert all(len(v) == 5 and set(v) <= set("01234567") for v in png.FONT.values()) and len(set(png.FONT.values())) == len(png.FONT)


def test_transition_bars(spark, tmp_path):
    rows = [("BUS", "WALK", 40), ("WALK", "BUS", 20), ("CAR", "TRAIN", 5), ("BUS", "hovercraft", 1)]
    render.transition_figure(spark.createDataFrame(rows, "prev string, mode string, n long"), str(tmp_path / "t.png"))
    pixels = decode((tmp_path / "t.png").read_bytes())
    for prev, mode, n in rows[:3]:
        assert of_color(pixels, render.TYPES[f"{prev}→{mode}"]) == 12 * render.BAR * n // 40
    assert of_color(pixels, "gray") == 12 * render.BAR // 40
    blue = of_color(pixels, (70, 70, 255))  # the darkest cell, less its number
    assert 52 * 26 - 200 < blue < 52 * 26
    render.transition_figure(spark.createDataFrame([], "prev string, mode string, n long"), str(tmp_path / "none.png"))
    assert decode((tmp_path / "none.png").read_bytes()).shape[1] == 1060


def test_demographic_bars(spark, tmp_path):
    rows = [("sex", "F", "BUS", 3, 75.0), ("sex", "F", "WALK", 1, 25.0), ("sex", "M", "BUS", 0, None), ("age", "18-29", "CAR", 9, 100.0), ("diploma", "ÉCOLE", "CAR", 9, 50.0), ("diploma", "ÉCOLE", "other", 9, 50.0)]
    render.demographic_figure(spark.createDataFrame(rows, "by string, `group` string, mode string, us long, pct double"), str(tmp_path / "d.png"))
    pixels = decode((tmp_path / "d.png").read_bytes())
    legend = 12 * 12
    for mode, share in (("BUS", 0.75), ("WALK", 0.25), ("CAR", 1.5)):
        assert of_color(pixels, render.PALETTE[mode]) == legend + 14 * render.BAR * share
    assert of_color(pixels, "gray") == 14 * render.BAR * 0.5
    assert all(of_color(pixels, render.PALETTE[m]) == legend for m in CANONICAL if m not in ("BUS", "WALK", "CAR"))
