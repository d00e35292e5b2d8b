"""Numeric column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def round_half_up(col, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: the same IEEE operations in Spark and DuckDB."""
    scale = float(10 ** digits)
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def price_segment(price="price") -> Column:
    """Right-closed bins (0,30] low, (30,100] mid, (100,inf) high; null for price <= 0 or null."""
    p = F.col(price) if isinstance(price, str) else price
    return (F.when(p <= 0, F.lit(None).cast("string"))
            .when(p <= C.SEGMENT_LOW_MAX, "low")
            .when(p <= C.SEGMENT_MID_MAX, "mid")
            .when(p > C.SEGMENT_MID_MAX, "high"))


def ingest_price_segment(price="price") -> Column:
    """Ingest-time rule, left-closed: < 30 low, < 100 mid, else high."""
    p = F.col(price) if isinstance(price, str) else price
    return F.when(p < C.SEGMENT_LOW_MAX, "low").when(p < C.SEGMENT_MID_MAX, "mid").otherwise("high")


def fix_price_original(price="price", original="price_original") -> Column:
    """original := price when it is missing or below price."""
    p, po = F.col(price), F.col(original)
    return F.when(po.isNull() | (po < p), p).otherwise(po)


def recompute_discount(price="price", original="price_original") -> Column:
    """round((po - p) / po * 100, 1) when po > p, else 0.0."""
    p, po = F.col(price), F.col(original)
    return F.when(po > p, round_half_up((po - p) / po * F.lit(100.0), 1)).otherwise(F.lit(0.0))


def ingest_discount(price="price", original="price_original") -> Column:
    """Ingest-time discount (unrounded): (po - p) / po * 100 when po > p else 0."""
    p, po = F.col(price), F.col(original)
    return F.when(po > p, (po - p) / po * F.lit(100.0)).otherwise(F.lit(0.0))


def log1p_(col) -> Column:
    """ln(1 + x), written as in the oracle so both engines do the same operations."""
    c = F.col(col) if isinstance(col, str) else col
    return F.log(F.lit(1.0) + c)


# FIXED VALUES: date formats tried in order for "days since published": ISO with zone offset,
# "date time", ISO with fraction and a literal Z, plain date. A zoneless ISO "T" time matches none.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd",
]


def days_since(col, as_of: str = C.AS_OF) -> Column:
    """Whole days from the parsed timestamp to ``as_of``; null when no format parses."""
    c = F.col(col) if isinstance(col, str) else col
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(parsed)
    return F.floor(micros / F.lit(86400 * 1000000)).cast("int")
