"""Portable random numbers: integer mixes of (row id, draw, seed).

Unlike ``rand(seed)`` the value depends on the row and not on how rows are partitioned, so a
retried task draws the same numbers. Every product stays inside a BIGINT, so any SQL engine can
compute the same. Two mixes of 32 bits give a number of 52; both halves of a row id count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing function.
MASK = 0xFFFFFFFF
ID_STEP = 2654435
HIGH_STEP = 40692017
DRAW_STEP = 40503
LANE_STEP = 1640531527
MULTIPLIER_1 = 0x7FEB352D
MULTIPLIER_2 = 0x2C1B3C6D
BITS = 52


def mix32(row_id: Column, draw: Column, seed: int) -> Column:
    mask, row = F.lit(MASK), row_id.cast("long")
    high = F.shiftright(row, 32).bitwiseAND(mask)
    h = (row.bitwiseAND(mask) * ID_STEP + high * HIGH_STEP + draw.cast("long") * DRAW_STEP + seed).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = (h * MULTIPLIER_1).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = (h * MULTIPLIER_2).bitwiseAND(mask)
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix52(row_id: Column, draw: Column, seed: int) -> Column:
    """Two mixes side by side: 32 bits of the first, 20 of the second."""
    return mix32(row_id, draw, seed) * (1 << 20) + F.shiftright(mix32(row_id, draw, seed + LANE_STEP), 12)


def uniform(row_id: Column, draw: Column, seed: int) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (mix52(row_id, draw, seed) + 0.5) / float(1 << BITS)


def normal(row_id: Column, draw: Column, seed: int) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    u = uniform(row_id, draw, seed)
    v = uniform(row_id, draw, seed + 7919)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


# The chance of a count beyond these terms is smaller than the step of ``uniform``.
POISSON_TERMS = 18


# Below this uniform number the count is zero.
POISSON_NONE = math.exp(-1.0)


def poisson1(u: Column) -> Column:
    """Poisson(1) count by inversion; the resampling weight of one row in one draw.

    ``u`` is a uniform number that an earlier step has put into a column: it is read many times.
    """
    term, cdf, out = math.exp(-1.0), 0.0, F.lit(0)
    for k in range(POISSON_TERMS):
        cdf += term
        out = out + F.when(u >= cdf, 1).otherwise(0)
        term /= k + 1
    return out
