"""What is decided about a decoded image before it is shown, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak of an ordinary display, largest factor, exposure that counts as none.
SDR_NITS, LARGEST_FACTOR, NO_EXPOSURE = 255.0, 1024, 0.01


def downsample_factor(width: Column, height: Column, largest: int) -> Column:
    """The least power of two by which whole division brings both sides to at most ``largest``; null if none up to 1024 does."""
    powers = [1 << k for k in range(LARGEST_FACTOR.bit_length())]
    return F.coalesce(*(F.when(F.floor(F.greatest(width, height) / f) <= largest, F.lit(f)) for f in powers))


def shown_exposure(hdr: Column, intensity: Column, ev: Column, white: Column) -> tuple[Column, Column]:
    """(ev, white): an ordinary image is shown as it is, others as measured."""
    ordinary = ~hdr & (intensity <= SDR_NITS)
    return F.when(ordinary, 0.0).otherwise(ev), F.when(ordinary, 1.0).otherwise(white)


def deep(bits: Column, exponent: Column) -> Column:
    """Finer than 8 bits, or of floating point."""
    return (bits > 8) | (exponent > 0)


def tone_mode(hdr: Column, wide: Column, bits: Column, exponent: Column, white: Column, ev: Column) -> Column:
    needed = hdr | wide | deep(bits, exponent) | (white > 1.0) | (F.abs(ev) > NO_EXPOSURE)
    return F.when(needed, "rolloff").otherwise("clip")


def notes(hdr: Column, wide: Column, bits: Column, exponent: Column, factor: Column) -> Column:
    """Codes of what a viewer should know, in this order."""
    said = [(hdr, "hdr_transfer"), (wide, "wide_primaries"), (deep(bits, exponent), "high_bit_depth"), (factor > 1, "downsampled")]
    return F.array_compact(F.array(*(F.when(c, code) for c, code in said)))


def usable(width: Column, height: Column, error: Column) -> Column:
    """A decoded image without an error."""
    return (F.coalesce(error, F.lit("")) == "") & (width > 0) & (height > 0)
