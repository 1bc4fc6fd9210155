import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators.bayer import develop
from pixelloom.sources import dng as D
from pixelloom.sources import export as X

FLAT = np.full((48, 64), 500, dtype=np.uint16)
FLAT[:2, :2] = 67


def test_parse_and_reject():
    header, mosaic = D.parse_raw(D.write_dng(FLAT))
    assert (header["width"], header["height"], header["cfa"], header["white"]) == (64, 48, 0, 1023.0) and (mosaic == FLAT).all()
    assert header["black"] == [64.0] * 4 and header["neutral"] == [1.0] * 3 and header["noise"] == [1e-4, 1e-6] * 4
    assert np.allclose(header["forward_matrix1"], [0.9642, 0, 0, 0, 1, 0, 0, 0, 0.8249])
    for extra, message in [({D.COMPRESSION: (3, [7])}, "compressed"), ({D.BITS: (3, [12])}, "16 bits"), ({D.TILE_WIDTH: (4, [16])}, "tiled"), ({D.PHOTOMETRIC: (3, [2])}, "mosaic"), ({D.CFA_PATTERN: (1, [0, 0, 1, 2])}, "unknown"), ({D.WHITE: (3, [64])}, "levels"), ({D.STRIPS: (4, [8, 9])}, "strip"), ({D.WIDTH: (4, [2])}, "small")]:
        with pytest.raises(D.RawError, match=message):
            D.parse_raw(D.write_dng(FLAT, extra=extra))
    whole = D.write_dng(FLAT)
    for n in (0, 8, len(whole) // 3, len(whole) - 100):
        with pytest.raises(D.RawError):
            D.parse_raw(whole[:n])


def test_files_to_pictures(spark, tmp_path):
    for cfa in range(4):
        (tmp_path / f"shot{cfa}.dng").write_bytes(D.write_dng(FLAT, cfa=cfa))
    (tmp_path / "broken.dng").write_bytes(b"II*\0\x08\0\0\0")
    files = D.binary_files(spark, f"file://{tmp_path}/*.dng")
    headers = D.raw_headers(files).collect()
    assert sorted(r.error or "" for r in headers) == ["", "", "", "", "the file is truncated"]
    assert {r.cfa for r in headers} == {0, 1, 2, 3, None}
    assert {r.k for r in files.select(X.format_of(F.col("content")).alias("k")).collect()} == {"dng"}
    lines = D.raw_mosaics(files)
    pixels = lines.select("path", "cfa", "y", F.posexplode("raw").alias("x", "raw")).where("y < 12 and x < 12")
    out = develop(pixels, ["path"], (1.0, 1.0, 1.0), (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0))
    far = out.where("x > 5 and y > 5").select("r", "g", "b").distinct().collect()
    assert all(abs(v - (500 - 64) / 959) < 1e-9 for r in far for v in r)
    images = X.png_images(X.rendered(out), "path").collect()
    assert len(images) == 4 and all(bytes(r.png)[:8] == b"\x89PNG\r\n\x1a\n" for r in images)


def test_png_round_trip():
    rgb = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    png = X.encode_png(rgb)
    at = png.index(b"IDAT")
    size = int.from_bytes(png[at - 4 : at], "big")
    lines = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + size]), np.uint8).reshape(5, 22)
    assert (lines[:, 0] == 0).all() and (lines[:, 1:].reshape(5, 7, 3) == rgb).all()


def test_names_and_halves(spark):
    df = spark.sql("select * from values ('/a/b.c/pic.one.dng', 16, 9), ('plain', 99, 1), ('/x/.hidden', 13, 11) as t(p, t, q)")
    got = [tuple(r) for r in df.select(X.output_name(F.col("p")), X.transfer_name(F.col("t")), X.primaries_name(F.col("q"))).collect()]
    assert got == [("pic.one_developed.png", "PQ", "2100"), ("plain_developed.png", "Unknown", "sRGB"), (".hidden_developed.png", "sRGB", "P3")]
    named = spark.sql("select timestamp'2024-03-05 06:07:08' t").select(X.export_name(F.lit(""), F.col("t"), ".png"), X.export_name(F.lit("/q/z.dng"), F.col("t"), ".jpg")).first()
    assert tuple(named) == ("IMG_20240305_060708.png", "z.jpg")
    values = np.array([0.0, 1.0, -2.5, 65504.0, 1e6, 1e-9, np.nan, 0.1], dtype=np.float32)
    halves = X.to_half(values).view(np.float16)
    assert halves[:4].tolist() == [0.0, 1.0, -2.5, 65504.0] and np.isinf(halves[4]) and halves[5] == 0 and np.isinf(halves[6]) and 0 <= values[7] - halves[7] < 1e-4
