"""Hash-seeded random draws.

A draw depends only on (row key, draw index), never on row order or partitioning, so a retried task
or a different partition count gives the same numbers. u = (first 8 hex digits of md5(key:i) + 0.5) / 2^32
is written the same way in the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, i: int) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(4294967296.0)


def normal(key: Column, i: int) -> Column:
    """Standard normal by Box-Muller from draws i and i + 1."""
    u1, u2 = uniform(key, i), uniform(key, i + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gamma(key: Column, shape: Column, i: int) -> Column:
    """Gamma(shape, 1) for shape in {1.5, 2.5, 3.0}: sums of exponentials plus z^2 / 2 for the half."""
    e1 = -F.log(uniform(key, i))
    e2 = -F.log(uniform(key, i + 1))
    e3 = -F.log(uniform(key, i + 2))
    zz = normal(key, i + 3)
    half = zz * zz / F.lit(2.0)
    return (F.when(shape == 3.0, e1 + e2 + e3)
            .when(shape == 2.5, e1 + e2 + half)
            .when(shape == 1.5, e1 + half))


def hash_order_key(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order key (md5 of key and seed), same in DuckDB."""
    return F.md5(F.concat(key, F.lit(f"#{seed}")))
