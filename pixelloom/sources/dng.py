"""Camera RAW files: uncompressed 16-bit single-strip Bayer DNG, read through Spark's binary file source.

A file that can't be used is a row with an error, never a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pixelloom.session import ship

# TIFF type widths, tags, and CFA codes.
TYPE_SIZE = {1: 1, 3: 2, 4: 4, 5: 8, 9: 4, 10: 8, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 9: "i", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, STRIP_BYTES, TILE_WIDTH, SUB_IFDS = 256, 257, 258, 259, 262, 273, 274, 279, 322, 330
CFA_PATTERN, BLACK, WHITE, MATRIX1, NEUTRAL, EXPOSURE, ILLUMINANT2, FORWARD1, FORWARD2, NOISE = 33422, 50714, 50717, 50721, 50728, 50730, 50779, 50964, 50965, 51041
PHOTOMETRIC_CFA = 32803
CFA_CODES = {(0, 1, 1, 2): 0, (1, 0, 2, 1): 1, (1, 2, 0, 1): 2, (2, 1, 1, 0): 3}
MOST_IFDS, MOST_DEPTH, MOST_ENTRIES, MOST_TAGS = 8, 4, 512, 64

HEADER = (
    "path string, error string, width int, height int, cfa int, black array<double>, white double, color_matrix1 array<double>, forward_matrix1 array<double>, "
    "forward_matrix2 array<double>, illuminant2 int, neutral array<double>, baseline_exposure double, orientation int, noise array<double>"
)


class RawError(ValueError):
    """Why a file isn't a RAW image that can be read."""


def looks_like_dng(data: bytes) -> bool:
    return len(data) >= 8 and data[:4] in (b"II*\0", b"MM\0*")


class _Tiff:
    """Tags of all directories of a file; of repeated tags the last counts."""

    def __init__(self, data: bytes):
        self.data, self.order, self.tags = data, "<" if data[:1] == b"I" else ">", {}
        at, seen = self._u32(4), 0
        while at and seen < MOST_IFDS:
            at, seen = self._walk(at, 0), seen + 1

    def _read(self, form: str, at: int):
        if at < 0 or at + struct.calcsize(form) > len(self.data):
            raise RawError("the file is truncated")
        return struct.unpack_from(self.order + form, self.data, at)

    def _u32(self, at: int) -> int:
        return self._read("I", at)[0]

    def _walk(self, at: int, depth: int) -> int:
        (count,) = self._read("H", at)
        if count > MOST_ENTRIES:
            raise RawError("a directory has too many entries")
        for i in range(count):
            entry = at + 2 + 12 * i
            tag, kind, n = self._read("HHI", entry)
            size = TYPE_SIZE.get(kind, 0) * n
            if not size:
                continue
            where = entry + 8 if size <= 4 else self._u32(entry + 8)
            if where + size > len(self.data):
                continue
            if len(self.tags) < MOST_TAGS or tag in self.tags:
                self.tags[tag] = (kind, n, where)
            if tag == SUB_IFDS and depth < MOST_DEPTH:
                for sub in self.numbers(tag):
                    self._walk(int(sub), depth + 1)
        return self._u32(at + 2 + 12 * count)

    def numbers(self, tag: int, least: int = 1) -> list[float] | None:
        """All values of a tag; a fraction over zero is 0. None if there are too few."""
        if tag not in self.tags:
            return None
        kind, n, at = self.tags[tag]
        if n < least:
            return None
        if kind in (5, 10):
            pairs = self._read(f"{2 * n}{'I' if kind == 5 else 'i'}", at)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        return [float(x) for x in self._read(f"{n}{FORMATS[kind]}", at)]

    def number(self, tag: int, default: float | None = None) -> float | None:
        values = self.numbers(tag)
        return values[0] if values else default


def parse_raw(data: bytes) -> tuple[dict, np.ndarray]:
    """The header and the mosaic of a file; RawError if it can't be used."""
    if not looks_like_dng(data):
        raise RawError("not a DNG file")
    t = _Tiff(data)
    width, height = int(t.number(WIDTH, 0)), int(t.number(HEIGHT, 0))
    if width < 4 or height < 4:
        raise RawError("the image is too small")
    if t.number(COMPRESSION, 1) != 1:
        raise RawError("the image is compressed")
    if t.number(BITS, 16) != 16:
        raise RawError("samples don't have 16 bits")
    if TILE_WIDTH in t.tags:
        raise RawError("the image is tiled")
    if t.number(PHOTOMETRIC, PHOTOMETRIC_CFA) != PHOTOMETRIC_CFA:
        raise RawError("the image isn't a sensor mosaic")
    strips = t.numbers(STRIPS)
    if not strips or len(strips) != 1:
        raise RawError("the image isn't in a single strip")
    at, size = int(strips[0]), width * height * 2
    if at + size > len(data) or (t.number(STRIP_BYTES) or size) < size:
        raise RawError("the samples are truncated")
    pattern = t.numbers(CFA_PATTERN, 4)
    cfa = CFA_CODES.get(tuple(int(p) for p in pattern[:4])) if pattern else 0
    if cfa is None:
        raise RawError("the mosaic pattern is unknown")
    black = t.numbers(BLACK) or [0.0]
    black = black[:4] if len(black) >= 4 else [black[0]] * 4
    white = t.number(WHITE, 65535.0)
    if white - black[0] < 1:
        raise RawError("the levels are unusable")
    nine = lambda tag: (t.numbers(tag, 9) or [])[:9] or None
    header = {
        "width": width, "height": height, "cfa": cfa, "black": black, "white": white, "color_matrix1": nine(MATRIX1), "forward_matrix1": nine(FORWARD1), "forward_matrix2": nine(FORWARD2),
        "illuminant2": int(t.number(ILLUMINANT2, 0)), "neutral": (t.numbers(NEUTRAL, 3) or [1.0] * 3)[:3], "baseline_exposure": t.number(EXPOSURE, 0.0), "orientation": int(t.number(ORIENTATION, 1)), "noise": (t.numbers(NOISE) or [])[:8] or None,
    }
    return header, np.frombuffer(data, dtype=t.order + "u2", count=width * height, offset=at).reshape(height, width)


def _parsed(path: str, content: bytes) -> tuple[dict, np.ndarray | None]:
    try:
        header, mosaic = parse_raw(content or b"")
        return {"path": path, "error": None, **header}, mosaic
    except (RawError, struct.error, OverflowError) as e:
        return {"path": path, "error": str(e)}, None


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def raw_headers(files: DataFrame) -> DataFrame:
    """One row per (path, content)."""
    columns = [c.split()[0] for c in HEADER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_parsed(p, c)[0] for p, c in zip(batch["path"], batch["content"])], columns=columns).astype(object).where(lambda d: d.notna(), None)

    ship(files.sparkSession)
    return files.mapInPandas(run, HEADER)


def raw_mosaics(files: DataFrame) -> DataFrame:
    """Rows (path, cfa, y, raw ARRAY<INT>) of all usable files, one per line of the sensor, line by line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                header, mosaic = _parsed(p, c)
                if mosaic is not None:
                    for y0 in range(0, len(mosaic), 256):
                        part = mosaic[y0 : y0 + 256].astype(np.int32)
                        yield pd.DataFrame({"path": p, "cfa": header["cfa"], "y": np.arange(y0, y0 + len(part)), "raw": list(part)})

    ship(files.sparkSession)
    return files.mapInPandas(run, "path string, cfa int, y long, raw array<int>")


def write_dng(mosaic: np.ndarray, cfa: int = 0, black: float = 64, white: int = 1023, forward=(0.9642, 0, 0, 0, 1, 0, 0, 0, 0.8249), neutral=(1.0, 1.0, 1.0), extra: dict[int, tuple[int, list]] | None = None) -> bytes:
    """A minimal little-endian file of a mosaic; ``extra`` adds or replaces (tag: type, values), None removes."""
    height, width = mosaic.shape
    pattern = {v: k for k, v in CFA_CODES.items()}[cfa]
    fractions = lambda values: [x for v in values for x in (round(v * 10_000), 10_000)]
    tags: dict[int, tuple[int, list] | None] = {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [16]), COMPRESSION: (3, [1]), PHOTOMETRIC: (3, [PHOTOMETRIC_CFA]), STRIPS: (4, [0]), STRIP_BYTES: (4, [width * height * 2]),
        CFA_PATTERN: (1, list(pattern)), BLACK: (3, [int(black)] * 4), WHITE: (3, [white]), NEUTRAL: (5, fractions(neutral)), FORWARD1: (10, fractions(forward)), NOISE: (12, [1e-4, 1e-6] * 4),
    }
    tags |= extra or {}
    entries = sorted((k, v) for k, v in tags.items() if v)
    body = b""
    start = 8 + 2 + 12 * len(entries) + 4
    form = {1: "B", 3: "H", 4: "I", 5: "I", 9: "i", 10: "i", 12: "d"}
    lines, strip_line = [], None
    for tag, (kind, values) in entries:
        raw = struct.pack(f"<{len(values)}{form[kind]}", *values)
        n = len(raw) // TYPE_SIZE[kind]
        if tag == STRIPS and values == [0]:
            strip_line = len(lines)
        if len(raw) <= 4:
            lines.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        else:
            lines.append(struct.pack("<HHII", tag, kind, n, start + len(body)))
            body += raw + b"\0" * (len(raw) % 2)
    if strip_line is not None:
        lines[strip_line] = struct.pack("<HHII", STRIPS, 4, 1, start + len(body))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(lines)) + b"".join(lines) + struct.pack("<I", 0) + body + mosaic.astype("<u2").tobytes()
