"""Deterministic ordering keys that stand in for random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, phase: Column | str, *keys: Column | str) -> Column:
    """md5 of seed, phase and row keys: a fixed pseudo-random order (``phase`` text is a literal)."""
    head = [F.lit(str(seed)), F.lit(phase) if isinstance(phase, str) else phase]
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in head + cols]))


def draw_int(modulus: Column, seed: int, phase: Column | str, *keys: Column | str) -> Column:
    """Hash-derived integer in ``[0, modulus)``."""
    head = F.conv(F.substring(draw_key(seed, phase, *keys), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, modulus.cast("bigint"))
