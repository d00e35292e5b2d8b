"""DuckDB SQL for the catalog jobs, written independently of the Spark code (plain windows and
GROUP BYs over whole tables) so that it checks the Spark plans instead of mirroring them.

Conventions shared with the Spark side: rounding is floor(x * 10^n + 0.5) / 10^n, draws are
md5-seeded, double literals carry an explicit ``::DOUBLE``.
"""

from __future__ import annotations

import math
from html.entities import html5

from .. import config as C
from ..sources.adapters import ORDER_BASKETS_SQL, RAW_PRODUCTS_SQL

TWO_PI = repr(2.0 * math.pi)


def rnd(expr: str, digits: int) -> str:
    scale = repr(float(10 ** digits))
    return f"(floor(({expr}) * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE)"


def u(key: str, i: int) -> str:
    return (f"((('0x' || substr(md5({key} || ':{i}'), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)"
            f" / 4294967296.0::DOUBLE)")


def z(key: str, i: int) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({u(key, i)})) * cos({TWO_PI}::DOUBLE * {u(key, i + 1)}))"


def gamma(key: str, i: int) -> str:
    e1, e2, e3 = (f"(-ln({u(key, i + k)}))" for k in range(3))
    zz = z(key, i + 3)
    half = f"({zz} * {zz} / 2.0::DOUBLE)"
    return (f"(CASE WHEN g_shape = 3.0 THEN {e1} + {e2} + {e3} "
            f"WHEN g_shape = 2.5 THEN {e1} + {e2} + {half} "
            f"WHEN g_shape = 1.5 THEN {e1} + {half} END)")


def clean_html_sql(x: str) -> str:
    """With the seven common entities only; ``clean_pages_sql`` decodes all."""
    s = x
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")]:
        s = f"replace({s}, '{ent}', '{ch}')"
    return _strip_sql(s)


def _strip_sql(s: str) -> str:
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = f"replace({s}, chr(160), ' ')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    s = f"regexp_replace({s}, '^ | $', '', 'g')"
    return f"coalesce({s}, '')"


def clean_pages_sql() -> str:
    """Cleaned ``html`` of ``pages`` with every HTML entity: the text is cut at its references, each is looked
    up in the entity table or read as a number, and the parts are put together again."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quote('&' + k)}, {quote(v)})" for k, v in sorted(html5.items()) if k.endswith(";"))
    number = ("CASE WHEN regexp_matches(ref, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(ref, '[0-9]+') AS INTEGER)) "
              "WHEN regexp_matches(ref, '^&#[xX][0-9a-fA-F]+;$') THEN chr(CAST('0x' || regexp_extract(ref, '[xX]([0-9a-fA-F]+)', 1) AS INTEGER)) END")
    return f"""WITH entity(ref, chars) AS (VALUES {values}),
cut AS (SELECT page_id, string_split_regex(coalesce(html, ''), '&[#0-9a-zA-Z]+;') AS parts,
               regexp_extract_all(coalesce(html, ''), '&[#0-9a-zA-Z]+;') AS refs FROM pages),
piece AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part,
                 unnest(list_concat(refs, [''])) AS ref FROM cut),
decoded AS (SELECT page_id, string_agg(part || coalesce(e.chars, {number}, p.ref), '' ORDER BY i) AS html
            FROM piece p LEFT JOIN entity e USING (ref) GROUP BY page_id)
SELECT page_id, {_strip_sql('html')} AS text FROM decoded"""


def seg_sql(p: str = "price") -> str:
    return (f"CASE WHEN {p} <= 0 THEN NULL WHEN {p} <= 30 THEN 'low' "
            f"WHEN {p} <= 100 THEN 'mid' WHEN {p} > 100 THEN 'high' END")


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v + "'" for v in r) + ")"
                     for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


def caps_sql(profile: C.StoreProfile = C.CAPPED_PROFILE) -> str:
    return _values(sorted(profile.caps.items()), ["source_store", "cap"])


def params_sql() -> str:
    rows = [(seg, *[float(x) for x in C.RATING_PARAMS[seg]], *[float(x) for x in C.STOCK_PARAMS[seg]])
            for seg in ("low", "mid", "high")]
    return _values(rows, ["_ps", "r_mean", "r_std", "rv_mean", "rv_std", "g_shape", "g_scale"])


def scored_ctes(profile: C.StoreProfile = C.DEFAULT_PROFILE) -> str:
    """CTEs raw_products ... scored (everything before the cap)."""
    key = "(product_id || '|' || source_store)"
    brand_fix = "b2"
    for store, default in profile.brand_defaults.items():
        brand_fix = (f"CASE WHEN source_store = '{store}' AND {brand_fix} IN ('unknown', '') "
                     f"THEN '{default}' ELSE {brand_fix} END")
    cat_store = profile.tag_category_store
    parts = ("list_filter([trim(coalesce(name, 'nan')), trim(coalesce(category, 'nan')), "
             "trim(coalesce(brand, 'nan'))], lambda p: p <> '' AND lower(p) NOT IN ('unknown', 'uncategorized', 'nan'))")
    return f"""
raw_products AS ({RAW_PRODUCTS_SQL}),
f AS (SELECT * FROM raw_products WHERE price > 0),
d1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, source_store
        ORDER BY _s1, _s2, _s3, _s4, _s5) AS rn FROM f) WHERE rn = 1),
d2 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name, brand, price
        ORDER BY _s1, _s2, _s3, _s4, _s5) AS rn FROM d1) WHERE rn = 1),
c1 AS (SELECT * REPLACE (CASE WHEN source_store = '{cat_store}' AND (category IS NULL OR category = '')
        THEN '{C.DEFAULT_TAG_CATEGORY}' ELSE category END AS category) FROM d2),
c2 AS (SELECT *, trim(split_part(trim(coalesce(category, 'uncategorized')), '##', 1)) AS cat1,
              trim(split_part(trim(split_part(trim(coalesce(brand, 'unknown')), '|', 1)), '®', 1)) AS b2 FROM c1),
c3 AS (SELECT * EXCLUDE (cat1, b2, category, brand),
              CASE WHEN lower(trim(split_part(cat1, '/', 1))) = '' THEN 'uncategorized'
                   ELSE lower(trim(split_part(cat1, '/', 1))) END AS category,
              CASE WHEN b2 = '' THEN 'unknown' ELSE b2 END AS b2x FROM c2),
c4 AS (SELECT * EXCLUDE (b2x), {brand_fix.replace('b2', 'b2x')} AS brand FROM c3),
c5 AS (SELECT * REPLACE (CASE WHEN {clean_html_sql('description')} <> '' THEN {clean_html_sql('description')}
        WHEN len({parts}) > 0 THEN trim({parts}[1] || ' — ' || array_to_string(list_slice({parts}, 2, 3), ' | '), ' —|')
        ELSE coalesce(name, 'nan') END AS description) FROM c4),
c6 AS (SELECT * REPLACE (CASE WHEN price_original IS NULL OR price_original < price THEN price
        ELSE price_original END AS price_original) FROM c5),
c7 AS (SELECT *, CASE WHEN price_original > price THEN {rnd('(price_original - price) / price_original * 100.0::DOUBLE', 1)}
        ELSE 0.0::DOUBLE END AS discount_pct, {seg_sql()} AS _ps FROM c6),
e1 AS (SELECT c7.*, pr.* EXCLUDE (_ps) FROM c7 LEFT JOIN {params_sql()} pr ON c7._ps = pr._ps),
e2 AS (SELECT * REPLACE (
        CAST(CASE WHEN rating IS NULL THEN least(greatest(floor(exp(rv_mean + rv_std * {z(key, 3)})), 1), {C.REVIEW_CAP})
             ELSE coalesce(review_count, 0) END AS INT) AS review_count,
        {rnd(f"CASE WHEN rating IS NULL THEN {rnd(f'least(greatest(r_mean + r_std * {z(key, 1)}, 1.0::DOUBLE), 5.0::DOUBLE)', 1)} ELSE rating END", 1)} AS rating,
        CAST(coalesce(stock_qty, CASE WHEN coalesce(in_stock, TRUE) THEN greatest(1, floor({gamma(key, 10)} * g_scale))
             ELSE 0 END, 0) AS INT) AS stock_qty) FROM e1),
med AS (SELECT source_store, quantile_cont(days_since_publish::DOUBLE, 0.5) AS _med FROM e2 GROUP BY source_store),
e3 AS (SELECT e2.* REPLACE (CAST(trunc(coalesce(days_since_publish::DOUBLE, med._med, {float(C.DAYS_DEFAULT)}::DOUBLE)) AS INT)
        AS days_since_publish) FROM e2 LEFT JOIN med ON e2.source_store = med.source_store),
scored AS (SELECT * EXCLUDE (_ps, r_mean, r_std, rv_mean, rv_std, g_shape, g_scale, _rank),
        {rnd('rating * 0.4::DOUBLE + ln(1.0::DOUBLE + review_count) * 0.4::DOUBLE + (1.0::DOUBLE / (_rank + 1)) * 0.2::DOUBLE', 3)}
        AS popularity_score
        FROM (SELECT * REPLACE (coalesce(in_stock, TRUE) AS in_stock), discount_pct > 0 AS is_on_promo,
                     {seg_sql()} AS price_segment,
                     rank() OVER (ORDER BY review_count DESC) AS _rank FROM e3) x)
"""


def processed_ctes(profile: C.StoreProfile = C.DEFAULT_PROFILE) -> str:
    """CTEs up to ``products`` (the processed 20-column table)."""
    capped = "SELECT * FROM scored"
    if profile.caps is not None:
        capped = f"""SELECT * EXCLUDE (rn, cap) FROM (SELECT s.*, k.cap, row_number() OVER (PARTITION BY s.source_store
        ORDER BY s.popularity_score DESC, s.product_id) AS rn
        FROM scored s JOIN {caps_sql(profile)} k ON s.source_store = k.source_store) WHERE rn <= cap"""
    return scored_ctes(profile) + f""",
capped AS ({capped}),
thr AS (SELECT quantile_cont(popularity_score, {C.TOPK_QUANTILE}) AS t FROM capped),
products AS (SELECT product_id, source_platform, source_store, name, description, category, brand,
        {rnd('price', 2)} AS price, {rnd('price_original', 2)} AS price_original,
        {rnd('discount_pct', 1)} AS discount_pct, {rnd('rating', 1)} AS rating,
        CAST(review_count AS INT) AS review_count, in_stock, CAST(stock_qty AS INT) AS stock_qty,
        shop_country, CAST(days_since_publish AS INT) AS days_since_publish, is_on_promo, price_segment,
        popularity_score, CAST(popularity_score >= thr.t AS INT) AS topk_label
        FROM capped CROSS JOIN thr)
"""


def with_products(select_sql: str, profile: C.StoreProfile = C.DEFAULT_PROFILE) -> str:
    return "WITH " + processed_ctes(profile) + "\n" + select_sql


def with_scored(select_sql: str, profile: C.StoreProfile = C.DEFAULT_PROFILE) -> str:
    return "WITH " + scored_ctes(profile) + "\n" + select_sql


def with_raw(select_sql: str) -> str:
    return f"WITH raw_products AS ({RAW_PRODUCTS_SQL})\n" + select_sql


def with_raw_ctes(ctes_and_select: str) -> str:
    """``WITH raw_products AS (...), <more ctes> SELECT ...``."""
    return f"WITH raw_products AS ({RAW_PRODUCTS_SQL}),\n" + ctes_and_select


def with_products_ctes(ctes_and_select: str, profile: C.StoreProfile = C.DEFAULT_PROFILE) -> str:
    return "WITH " + processed_ctes(profile) + ",\n" + ctes_and_select


def with_baskets(select_sql: str) -> str:
    return f"WITH order_baskets AS ({ORDER_BASKETS_SQL})\n" + select_sql
