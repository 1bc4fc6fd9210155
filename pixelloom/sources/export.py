"""Exports: tone-mapped 8-bit images as PNG, half floats, and file names."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.session import ship

# Names shown for transfer functions and primaries.
TRANSFER_NAMES = {1: "709", 8: "Linear", 13: "sRGB", 16: "PQ", 17: "DCI", 18: "HLG", 65535: "Gamma"}
PRIMARIES_NAMES = {1: "sRGB", 2: "Custom", 9: "2100", 11: "P3"}


def rendered(df: DataFrame, ev: float = 0.0, white: float = 1.0, wide: bool = False) -> DataFrame:
    """Adds r8, g8 and b8: exposure, tone curve, gamut and dithered encoding of linear r, g and b."""
    out = C.tone_mapped(F.col("r"), F.col("g"), F.col("b"), ev, white, wide)
    dither = C.bayer_dither(F.col("y"), F.col("x"))
    return df.withColumns({f"{c}8": C.to_srgb8_dithered(v, dither) for c, v in zip("rgb", out)})


def encode_png(rgb: np.ndarray, level: int = 4) -> bytes:
    """A (height, width, 3) byte array as a PNG file."""
    height, width, _ = rgb.shape
    lines = np.zeros((height, 1 + width * 3), dtype=np.uint8)
    lines[:, 1:] = rgb.reshape(height, width * 3)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def png_images(df: DataFrame, by: str, level: int = 4) -> DataFrame:
    """(by, png) of pixels (by, y, x, r8, g8, b8). A file is one task's work, as an image must be written in order."""
    kind = df.schema[by].dataType.simpleString()

    def run(pixels: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pixels["y"].max()) + 1, int(pixels["x"].max()) + 1
        rgb = np.zeros((h, w, 3), dtype=np.uint8)
        rgb[pixels["y"], pixels["x"]] = pixels[["r8", "g8", "b8"]].to_numpy(np.uint8)
        return pd.DataFrame({by: [pixels[by].iloc[0]], "png": [encode_png(rgb, level)]})

    ship(df.sparkSession)
    return df.select(by, "y", "x", "r8", "g8", "b8").groupBy(by).applyInPandas(run, f"{by} {kind}, png binary")


def to_half(values: np.ndarray) -> np.ndarray:
    """Single floats as half floats by truncation: what is too small is 0, what is too large or no number is infinite."""
    bits = np.asarray(values, dtype=np.float32).view(np.uint32)
    sign, exponent, mantissa = (bits >> 16) & 0x8000, ((bits >> 23) & 0xFF).astype(np.int32) - 112, (bits >> 13) & 0x3FF
    inside = sign | (exponent.astype(np.uint32) << 10) | mantissa
    return np.where(exponent <= 0, sign, np.where(exponent >= 31, sign | 0x7C00, inside)).astype(np.uint16)


def output_name(path: Column, suffix: str = "_developed.png") -> Column:
    """The file's name without folder and last extension, with a suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(suffix))


def export_name(source: Column, at: Column, extension: str) -> Column:
    """A name from the source's, or from the time if there is none."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.when(base == "", F.date_format(at, "'IMG_'yyyyMMdd_HHmmss")).otherwise(base), F.lit(extension))


def format_of(content: Column) -> Column:
    """dng, jxl or unknown, by signature; dng first."""
    head = lambda n: F.substring(content, 1, n)
    dng = head(4).isin(F.unhex(F.lit("49492A00")), F.unhex(F.lit("4D4D002A"))) & (F.octet_length(content) >= 8)
    jxl = ((head(2) == F.unhex(F.lit("FF0A"))) | (head(12) == F.unhex(F.lit("0000000C4A584C200D0A870A")))) & (F.octet_length(content) >= 12)
    return F.when(dng, "dng").when(jxl, "jxl").otherwise("unknown")


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.lit("Unknown")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def transfer_name(code: Column) -> Column:
    return _named(code, TRANSFER_NAMES)


def primaries_name(code: Column) -> Column:
    return _named(code, PRIMARIES_NAMES)
