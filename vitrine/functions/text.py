"""String column helpers: HTML cleaning, category / brand normalisation, description fallback, search.

All are native Catalyst expressions, except that ``clean_html`` hands texts with an HTML reference outside the
native ones to Python's full decoder, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# FIXED VALUES: entities decoded by the native chain, '&amp;' last so '&amp;lt;' becomes '&lt;'.
NATIVE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]
# FIXED VALUES: words that do not count as a description part.
FALLBACK_SKIP = ["unknown", "uncategorized", "nan"]
FALLBACK_SEPARATOR = " — "   # space, em dash, space
FALLBACK_JOIN = " | "
FALLBACK_STRIP = " —|"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_entities(col) -> Column:
    c = _c(col)
    for ent, ch in NATIVE_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags_and_space(col, max_chars: int | None = None) -> Column:
    c = F.regexp_replace(_c(col), r"<[^>]+>", " ")
    # Unicode-aware whitespace (nbsp included), as in Python's re.
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = F.regexp_replace(c, r"^ | $", "")
    return c if max_chars is None else F.substring(c, 1, max_chars)


def clean_html(col, max_chars: int | None = None) -> Column:
    """null/'' -> ''; decode all entities; tags -> space; collapse whitespace; trim. ``max_chars`` cuts the
    result only where the caller asks for it.

    Texts whose every '&' begins one of the native entities are decoded by native replacements; only the
    others reach the Python decoder (it gets null for the rest)."""
    c = _c(col)
    pattern = "&(" + "|".join(e[1:-1] for e, _ in NATIVE_ENTITIES) + ");"
    other = F.contains(F.regexp_replace(c, pattern, ""), F.lit("&"))
    decoded = F.when(other, _html_unescape_udf()(F.when(other, c))).otherwise(decode_entities(c))
    return F.coalesce(strip_tags_and_space(decoded, max_chars), F.lit(""))


_UNESCAPE = None


def _html_unescape_udf():
    """The decoder as a closure that needs nothing of this package on the workers."""
    global _UNESCAPE
    if _UNESCAPE is None:
        def unescape(s: pd.Series) -> pd.Series:
            import html

            return s.map(lambda v: None if v is None else html.unescape(v))

        _UNESCAPE = F.pandas_udf(unescape, "string")
    return _UNESCAPE


def normalize_category(col="category") -> Column:
    """null -> uncategorized; part before '##'; part before '/'; trim; lower; '' -> uncategorized."""
    c = F.trim(F.coalesce(_c(col), F.lit("uncategorized")))
    c = F.trim(F.substring_index(c, "##", 1))
    c = F.lower(F.trim(F.substring_index(c, "/", 1)))
    return F.when(c == "", F.lit("uncategorized")).otherwise(c)


def normalize_brand(col="brand") -> Column:
    """null -> unknown; part before '|'; part before the registered sign; trim; '' -> unknown."""
    c = F.trim(F.coalesce(_c(col), F.lit("unknown")))
    c = F.trim(F.substring_index(c, "|", 1))
    c = F.trim(F.substring_index(c, "®", 1))
    return F.when(c == "", F.lit("unknown")).otherwise(c)


def infer_category_from_tags(tags="tags", rules=C.TAG_CATEGORY_RULES,
                             default: str = C.DEFAULT_TAG_CATEGORY) -> Column:
    """First keyword (in rule order) contained in lower(tags) gives the category."""
    t = F.lower(_c(tags))
    out = None
    for kw, cat in rules:
        cond = F.coalesce(F.contains(t, F.lit(kw)), F.lit(False))
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(default))


def description_fallback(desc_clean, name="name", category="category", brand="brand") -> Column:
    """Clean description if any, else 'name — category | brand' from the informative parts."""
    parts = F.array(
        F.trim(F.coalesce(_c(name), F.lit("nan"))),
        F.trim(F.coalesce(_c(category), F.lit("nan"))),
        F.trim(F.coalesce(_c(brand), F.lit("nan"))),
    )
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*FALLBACK_SKIP))
    built = F.concat(F.element_at(kept, 1), F.lit(FALLBACK_SEPARATOR),
                     F.array_join(F.slice(kept, 2, 3), FALLBACK_JOIN))
    built = F.btrim(built, F.lit(FALLBACK_STRIP))
    fallback = F.when(F.size(kept) > 0, built).otherwise(F.coalesce(_c(name), F.lit("nan")))
    d = _c(desc_clean)
    return F.when(d != "", d).otherwise(fallback)


def text_search(query: str, *cols, regex: bool = False) -> Column:
    """Case-insensitive match of ``query`` in any of ``cols`` (null counts as no match)."""
    out = F.lit(False)
    for col in cols:
        c = _c(col)
        if regex:
            hit = F.rlike(c, F.lit("(?i)" + query))
        else:
            hit = F.contains(F.lower(c), F.lit(query.lower()))
        out = out | F.coalesce(hit, F.lit(False))
    return out
