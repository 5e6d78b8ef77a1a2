"""Seeded draws that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VALIDATION_CUT = "33333333"  # 0.2 of the eight-hex-digit range


def draw(row_id: Column, seed: int) -> Column:
    """A uniform 128-bit draw per row, as hex text; text order is draw order."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"-{seed}")))


def is_validation(row_id: Column, seed: int = 42) -> Column:
    """True for about a fifth of the rows, the same rows on every run."""
    return F.substring(draw(row_id, seed), 1, 8) < F.lit(VALIDATION_CUT)


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")
