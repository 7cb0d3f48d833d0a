"""Reproducible random draws that depend only on (seed, variable, row key, sample number).

A draw is a pure function of its key, so it does not change with partitioning, task retries or
executor loss, and samples need no shuffle or join to be generated. The text key is hashed once
per row to 64 bits (`stream`); the per-sample part mixes both halves of them with the sample number,
in 32-bit integer arithmetic that stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.constants import SEED
from furrow.functions.nulls import as_col, ratio

# --- fixed values: mixing constants (all below 2**31, so 32x31-bit products fit a BIGINT) ---
MASK = 0xFFFFFFFF
WEYL = 0x1E3779B1
MUL_A = 0x7FEB352D
MUL_B = 0x2C1B3C6D
SPAN = 4294967296.0


def stream(variable: str, *keys: Column | str, seed: int = SEED) -> Column:
    """64-bit stream id of one variable of one row; leave the keys out for common numbers."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(variable),
                       *[F.coalesce(as_col(k).cast("string"), F.lit("~")) for k in keys])
    high, low = (F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def noise(sample: Column | str) -> Column:
    """Well-mixed 32-bit value of a sample number, shared by every stream."""
    x = (as_col(sample).cast("bigint") * F.lit(WEYL).cast("bigint")).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(MUL_A).cast("bigint")).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 15))


def uniform(stream_id: Column | str, sample_noise: Column | str) -> Column:
    """Uniform number in (0, 1) of a stream and a sample."""
    low = as_col(stream_id).bitwiseAND(F.lit(MASK))
    x = low.bitwiseXOR(as_col(sample_noise))
    x = (x * F.lit(MUL_A).cast("bigint")).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 15)).bitwiseXOR(F.shiftrightunsigned(as_col(stream_id), 32))
    x = (x * F.lit(MUL_B).cast("bigint")).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(MUL_A).cast("bigint")).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    return (x.cast("double") + F.lit(0.5)) / F.lit(SPAN)


def triangular(u: Column | str, low: Column | str, mode: Column | str, high: Column | str) -> Column:
    """Inverse CDF of the triangular distribution; a point if low = high, null if invalid."""
    u, a, c, b = as_col(u), as_col(low), as_col(mode), as_col(high)
    valid = (a <= c) & (c <= b)
    rising = F.sqrt(u * (b - a) * (c - a))
    falling = F.sqrt((F.lit(1.0) - u) * (b - a) * (b - c))
    return (F.when(valid & (a == b), a)
            .when(valid & (u * (b - a) < c - a), a + rising)
            .when(valid, b - falling))


def low_from_sd(value: Column | str, sd: Column | str, rule: str = "ratio") -> Column:
    """Lower bound from a standard deviation; "ratio" divides by 1.96 sd, "difference" subtracts."""
    value, spread = as_col(value), as_col(sd) * F.lit(1.96)
    return ratio(value, spread) if rule == "ratio" else value - spread


def high_from_sd(value: Column | str, sd: Column | str) -> Column:
    return as_col(value) + as_col(sd) * F.lit(1.96)
