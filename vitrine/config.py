"""Parameters of the catalog jobs.

Everything a user may want to change is a parameter here or a small parameter table built from it.
The values marked FIXED VALUES must equal the original pipeline's for equal results; they are stated
plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: per-source caps (rows kept per store, best popularity first), in their original
# order: 800, 600, 600, 500, 400, 400, 258, 136, 100, 20.  The shared test tables name their
# stores store_0 .. store_9, so the caps are attached to those names in the same order.
# ---------------------------------------------------------------------------------------------
SOURCE_CAP_VALUES = [800, 600, 600, 500, 400, 400, 258, 136, 100, 20]
ADAPTER_STORES = [f"store_{i}" for i in range(10)]
ADAPTER_CAPS = dict(zip(ADAPTER_STORES, SOURCE_CAP_VALUES))

# FIXED VALUES: store-level repairs. One store gets a default brand when its brand is unknown,
# one store (no category in its feed) gets a default category / category from tags.
DEFAULT_BRAND_VALUE = "Taylor Stitch"
DEFAULT_TAG_CATEGORY = "mens clothing"
ADAPTER_BRAND_DEFAULTS = {"store_2": DEFAULT_BRAND_VALUE}
ADAPTER_TAG_CATEGORY_STORE = "store_4"

# FIXED VALUES: tag keyword -> category, first hit wins, in this order.
TAG_CATEGORY_RULES = [
    ("mens", "mens clothing"),
    ("kids", "kids clothing"),
    ("swim", "swimwear"),
    ("shorts", "shorts"),
    ("lounge", "loungewear"),
    ("golf", "golf apparel"),
    ("women", "womens clothing"),
    ("gift", "accessories"),
]

# FIXED VALUES: price segments are right-closed bins (0, 30], (30, 100], (100, inf).
SEGMENT_LOW_MAX = 30.0
SEGMENT_MID_MAX = 100.0
# The ingest-time rule is left-closed: price < 30 low, price < 100 mid, else high.

# FIXED VALUES: rating / review distributions per price segment
# (rating mean, rating std, log-review mean, log-review std).
RATING_PARAMS = {
    "low": (3.7, 0.9, 3.8, 1.3),
    "mid": (3.9, 0.7, 4.5, 1.1),
    "high": (4.1, 0.6, 3.5, 1.0),
}
REVIEW_CAP = 15000
# Older single-distribution rule: N(3.9, 0.7) ratings, LogNormal(4.5, 1.2) reviews capped at 10000.
GLOBAL_RATING_PARAMS = (3.9, 0.7, 4.5, 1.2)
GLOBAL_REVIEW_CAP = 10000

# FIXED VALUES: stock quantity Gamma(shape, scale) per price segment.
STOCK_PARAMS = {
    "low": (3.0, 60.0),
    "mid": (2.5, 40.0),
    "high": (1.5, 20.0),
}

# FIXED VALUES: popularity = 0.4 * rating + 0.4 * ln(1 + reviews) + 0.2 / (rank + 1), rounded to 3.
POP_W_RATING = 0.4
POP_W_REVIEWS = 0.4
POP_W_RANK = 0.2
TOPK_QUANTILE = 0.80
DAYS_DEFAULT = 365

# FIXED VALUES: source-quality scoring.
QUALITY_CRITICAL = ["price", "category", "brand", "name"]
QUALITY_ENRICHABLE = ["rating", "review_count", "stock_qty", "description", "days_since_publish"]
QUALITY_RECOMMENDATIONS = ["KEEP ✓", "KEEP + ENRICH ⚠", "PARTIAL USE ⚠⚠", "CONSIDER DROP ✗"]
QUALITY_KEEP_SCORE = 30.0
QUALITY_CUTS = (75.0, 50.0, 30.0)
MIN_ROWS_FOR_ML = 2000

# FIXED VALUES: association rules.
RULES_MIN_SUPPORT = 0.05
RULES_MIN_SUPPORT_TOPK = 0.01
RULES_MIN_CONFIDENCE = 0.55
RULES_MIN_LIFT = 1.5
RULES_MAX_LIFT = 15.0
RULES_TOPK_MIN_LIFT = 1.2
RULES_INF_LIFT = 999.0

# FIXED VALUES: DBSCAN.
DBSCAN_EPS = 0.8
DBSCAN_MIN_SAMPLES = 5

# FIXED VALUES: evaluation grade bounds.
AUC_GRADES = (0.90, 0.75, 0.60)
SILHOUETTE_GRADES = (0.5, 0.3)
ANOMALY_PCT_BOUNDS = (5.0, 15.0)
RULE_COUNT_GRADES = (50, 15)

# Reference date for "days since" (the original uses the wall clock; here it is a parameter).
AS_OF = "2026-01-01 00:00:00"


@dataclass(frozen=True)
class StoreProfile:
    """Per-store parameters of the preprocessing job (a handful of rows: a fixed-size table)."""

    #: Rows kept per store; None keeps all rows of all stores.
    caps: dict | None = None
    brand_defaults: dict = field(default_factory=lambda: dict(ADAPTER_BRAND_DEFAULTS))
    tag_category_store: str | None = ADAPTER_TAG_CATEGORY_STORE

    @property
    def max_cap(self) -> int:
        return max(self.caps.values())


DEFAULT_PROFILE = StoreProfile()
#: The original's per-store caps, for the jobs whose feature they are.
CAPPED_PROFILE = StoreProfile(caps=dict(ADAPTER_CAPS))
