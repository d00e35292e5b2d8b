"""Transactions, frequent itemsets and association rules (section 2.9, 2.7, 2.8).

Itemsets of long baskets come from Spark ML's FP-Growth; short ones are cut down to their frequent items and equal ones
counted once, with all their subsets. FP-Growth's own rules have one-item consequents only, so rules are
generated here from the itemsets: every itemset explodes into its proper non-empty subsets (bitmask
over the sorted items; transactions hold at most 7 items, so at most 126 splits per itemset) and two
equi-joins attach the antecedent and consequent supports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import round_half_up
from ..oracle.catalog import rnd, with_baskets, with_products_ctes
from ..registry import query
from ..session import cached_layer, materialize, new_table
from ..sources.adapters import order_baskets
from ..sources.searchindex import SearchIndex
from .preprocess import processed_products

R = round_half_up
METRIC_DIGITS = 4
#: Transactions that a task of the FP-Growth fit holds (some 400 bytes each), once there are enough for all cores.
FIT_ROWS = 100_000
#: Items of a product's transaction: one of each kind at most.
PRODUCT_ITEMS = 7
#: Subsets of distinct baskets that are counted: this many for any table, and so many a transaction (a fit takes longer).
FEW_SUBSETS = 1 << 22
SUBSETS_PER_ROW = 4


def product_transactions(products: DataFrame) -> DataFrame:
    """One basket per product: category, price segment, store, country, promo, stock, top-k items."""
    cat = F.replace(F.lower(F.trim(F.col("category"))), F.lit(" "), F.lit("_"))
    seg = F.trim(F.col("price_segment"))
    store = F.trim(F.col("source_store"))
    country = F.trim(F.col("shop_country"))
    items = F.array_compact(F.array(
        F.when((cat != "") & (cat != "uncategorized"), F.concat(F.lit("category:"), cat)),
        F.when(seg != "", F.concat(F.lit("price:"), seg)),
        F.when(store != "", F.concat(F.lit("store:"), store)),
        F.when((country != "") & (country != "unknown"), F.concat(F.lit("country:"), country)),
        F.when(F.col("is_on_promo"), F.lit("on_promo:yes")),
        F.when(F.col("in_stock"), F.lit("in_stock:yes")),
        F.when(F.col("topk_label") == 1, F.lit("topk:1")),
    ))
    return products.select("product_id", "source_store", items.alias("items")).filter(F.size("items") >= 2)


TRANSACTIONS_CTE = """tx AS (SELECT product_id, source_store, items FROM (SELECT product_id, source_store, list_filter([
    CASE WHEN replace(lower(trim(category)), ' ', '_') NOT IN ('', 'uncategorized') THEN 'category:' || replace(lower(trim(category)), ' ', '_') END,
    CASE WHEN trim(price_segment) <> '' THEN 'price:' || trim(price_segment) END,
    CASE WHEN trim(source_store) <> '' THEN 'store:' || trim(source_store) END,
    CASE WHEN trim(shop_country) NOT IN ('', 'unknown') THEN 'country:' || trim(shop_country) END,
    CASE WHEN is_on_promo THEN 'on_promo:yes' END,
    CASE WHEN in_stock THEN 'in_stock:yes' END,
    CASE WHEN topk_label = 1 THEN 'topk:1' END], lambda x: x IS NOT NULL) AS items FROM products) t WHERE len(items) >= 2)"""


@query("product_transactions", with_products_ctes(TRANSACTIONS_CTE + "\nSELECT product_id, source_store, items, len(items) AS n_items FROM tx"))
def q_product_transactions(spark: SparkSession, sf: str) -> DataFrame:
    t = product_transactions(processed_products(spark, sf))
    return t.withColumn("n_items", F.size("items"))


def frequent_itemsets(transactions: DataFrame, min_support: float, items: str = "items", max_items: int | None = None) -> DataFrame:
    """(items sorted, freq, support) for every itemset with support >= ``min_support``. Transactions known to hold at
    most ``max_items`` items are counted as baskets (``counted_itemsets``) where that is less work than FP-Growth."""
    if max_items is not None:
        found = counted_itemsets(transactions, min_support, max_items, items)
        if found is not None:
            return found
        transactions = materialize(transactions.select(items), "transactions")
    return fitted_itemsets(transactions, min_support, items)


def _with_support(itemsets: DataFrame, n: int) -> DataFrame:
    return itemsets.select("items", "freq", (F.col("freq") / F.lit(float(n))).alias("support"))


def counted_itemsets(transactions: DataFrame, min_support: float, max_items: int, items: str = "items") -> DataFrame | None:
    """Frequent itemsets of short transactions, exact, from one pass over them: equal baskets are counted once; an
    infrequent item is in no frequent itemset, so baskets are cut down to their frequent items and counted once more;
    every subset of such a basket adds up its count. The driver sees the frequent items, ``max_items / min_support`` at
    most. None when the baskets have many more subsets than there are transactions."""
    count = F.sum("n").alias("n")
    whole = transactions.select(F.array_sort(items).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    whole = materialize(whole, "baskets")
    total, longest = whole.agg(F.sum("n"), F.max(F.size("items"))).first()
    if (longest or 0) > max_items:
        raise ValueError(f"a transaction has more than {max_items} items")
    at_least = F.col("n") >= F.lit(min_support) * F.lit(float(total or 0))
    singles = whole.select(F.explode("items").alias("item"), "n").groupBy("item").agg(count).where(at_least)
    frequent = [r["item"] for r in singles.collect()]
    cut = whole.select(F.filter("items", lambda x: x.isin(frequent)).alias("items"), "n").where(F.size("items") > 0)
    cut = materialize(cut.groupBy("items").agg(count), "frequent-baskets")
    subsets = cut.agg(F.expr("sum(shiftleft(1L, size(items)))")).first()[0]
    if (subsets or 0) > max(SUBSETS_PER_ROW * (total or 0), FEW_SUBSETS):
        return None
    masks = cut.select("items", "n", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 1)")).alias("_m"))
    subset = F.expr("filter(items, (x, i) -> (shiftright(_m, i) & 1) = 1)")
    found = masks.select(subset.alias("items"), "n").groupBy("items").agg(count).where(at_least)
    return _with_support(found.withColumnRenamed("n", "freq"), total or 0)


def fitted_itemsets(transactions: DataFrame, min_support: float, items: str = "items") -> DataFrame:
    """Frequent itemsets of transactions of any length (FP-Growth)."""
    from pyspark.ml.fpm import FPGrowth

    n = transactions.count()
    rows = transactions.select(items)
    if n > FIT_ROWS * rows.sparkSession.sparkContext.defaultParallelism:
        # files of transactions are small, yet their rows are not once the fit holds them
        rows = rows.repartition(-(-n // FIT_ROWS))
    model = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=1.0).fit(rows)
    return _with_support(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), n)


def _itemsets_sql(min_support: float, src: str = "tx") -> str:
    """Brute force: every non-empty subset of every transaction, counted."""
    return f"""n_tx AS (SELECT count(*) AS n FROM {src}),
sub AS (SELECT list_sort(list_filter(list_sort(items), lambda x, i: ((m >> (i - 1)) & 1) = 1)) AS items
        FROM (SELECT items, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS m FROM {src}) t),
fi AS (SELECT items, count(*) AS freq, count(*) / (SELECT CAST(n AS DOUBLE) FROM n_tx) AS support FROM sub GROUP BY items
       HAVING count(*) >= {min_support}::DOUBLE * (SELECT n FROM n_tx))"""


@query("frequent_itemsets", with_products_ctes(TRANSACTIONS_CTE + ",\n" + _itemsets_sql(C.RULES_MIN_SUPPORT)
                                               + f"\nSELECT items, freq, {rnd('support', 6)} AS support FROM fi"))
def q_frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    t = product_transactions(processed_products(spark, sf))
    fi = frequent_itemsets(t, C.RULES_MIN_SUPPORT, max_items=PRODUCT_ITEMS)
    return fi.select("items", "freq", R(F.col("support"), 6).alias("support"))


def association_rules(itemsets: DataFrame, max_items: int = 8) -> DataFrame:
    """Every split antecedent -> consequent of every frequent itemset with mlxtend's metrics."""
    sets = itemsets.filter(F.size("items") >= 2)
    masks = F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)")).alias("_m")
    split = sets.select("items", F.col("support").alias("support"), masks)
    split = split.select(F.expr("filter(items, (x, i) -> (shiftright(_m, i) & 1) = 1)").alias("antecedents"),
                         F.expr("filter(items, (x, i) -> (shiftright(_m, i) & 1) = 0)").alias("consequents"), "support")
    sup = itemsets.select(F.col("items").alias("_k"), F.col("support").alias("_s"))
    r = (split.join(sup.withColumnRenamed("_s", "antecedent_support"), F.col("antecedents") == F.col("_k")).drop("_k")
              .join(sup.withColumnRenamed("_s", "consequent_support"), F.col("consequents") == F.col("_k")).drop("_k"))
    conf = F.col("support") / F.col("antecedent_support")
    r = r.withColumn("confidence", conf).withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    r = r.withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
    r = r.withColumn("conviction", F.when(F.col("confidence") >= 1.0, F.lit(None).cast("double"))
                     .otherwise((F.lit(1.0) - F.col("consequent_support")) / (F.lit(1.0) - F.col("confidence"))))
    den = F.greatest(F.col("support") * (F.lit(1.0) - F.col("antecedent_support")),
                     F.col("antecedent_support") * (F.col("consequent_support") - F.col("support")))
    r = r.withColumn("zhangs_metric", F.when(den == 0, F.lit(None).cast("double")).otherwise(F.col("leverage") / den))
    return r


RULE_COLS = ["antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence", "lift",
             "leverage", "conviction", "zhangs_metric"]


def _rules_sql(src: str = "fi") -> str:
    return f"""sets AS (SELECT items, support FROM {src} WHERE len(items) >= 2),
split AS (SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS antecedents,
                 list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS consequents, support
          FROM (SELECT items, support, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT) - 1)) AS m FROM sets) t),
rl AS (SELECT s.antecedents, s.consequents, a.support AS antecedent_support, c.support AS consequent_support, s.support,
              s.support / a.support AS confidence FROM split s JOIN {src} a ON s.antecedents = a.items JOIN {src} c ON s.consequents = c.items),
rules AS (SELECT *, confidence / consequent_support AS lift, support - antecedent_support * consequent_support AS leverage,
          CASE WHEN confidence >= 1.0 THEN NULL ELSE (1.0::DOUBLE - consequent_support) / (1.0::DOUBLE - confidence) END AS conviction,
          CASE WHEN greatest(support * (1.0::DOUBLE - antecedent_support), antecedent_support * (consequent_support - support)) = 0 THEN NULL
               ELSE (support - antecedent_support * consequent_support) / greatest(support * (1.0::DOUBLE - antecedent_support),
                    antecedent_support * (consequent_support - support)) END AS zhangs_metric FROM rl)"""


def _rounded(cols=RULE_COLS) -> str:
    return ", ".join(c if c in ("antecedents", "consequents") else f"{rnd(c, METRIC_DIGITS)} AS {c}" for c in cols)


def _rounded_spark(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("antecedents", "consequents") else R(F.col(c), METRIC_DIGITS).alias(c)
                       for c in RULE_COLS])


def topk_itemsets(spark: SparkSession, sf: str, min_support: float) -> DataFrame:
    """The itemsets of the products at ``min_support``: one fit at the lowest support per session and input
    version, filtered."""
    from .clustering import _inputs

    def build() -> DataFrame:
        t = product_transactions(processed_products(spark, sf))
        return materialize(frequent_itemsets(t, C.RULES_MIN_SUPPORT_TOPK, max_items=PRODUCT_ITEMS), "itemsets")

    low = cached_layer(spark, "itemsets", _inputs(sf), C.RULES_MIN_SUPPORT_TOPK, build)
    return low.where(F.col("support") >= min_support)


@query("association_rules", with_products_ctes(TRANSACTIONS_CTE + ",\n" + _itemsets_sql(C.RULES_MIN_SUPPORT) + ",\n"
                                               + _rules_sql() + f"\nSELECT {_rounded()} FROM rules"))
def q_association_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the itemsets at support .05 with support, confidence, lift, leverage, conviction, zhang."""
    return _rounded_spark(association_rules(topk_itemsets(spark, sf, C.RULES_MIN_SUPPORT)))


def general_rules(rules: DataFrame) -> DataFrame:
    r = rules.filter((F.col("confidence") >= C.RULES_MIN_CONFIDENCE) & (F.col("lift") >= C.RULES_MIN_LIFT))
    r = r.filter(~F.array_contains("antecedents", "topk:1") & ~F.array_contains("consequents", "topk:1"))
    return r.filter(F.col("lift") <= C.RULES_MAX_LIFT)


def topk_rules(rules: DataFrame) -> DataFrame:
    """lift >= 1.2 and consequent exactly {topk:1}, by lift."""
    r = rules.filter((F.col("lift") >= C.RULES_TOPK_MIN_LIFT) & (F.col("consequents") == F.array(F.lit("topk:1"))))
    return r


GENERAL_WHERE = (f"confidence >= {C.RULES_MIN_CONFIDENCE} AND lift >= {C.RULES_MIN_LIFT} AND NOT list_contains(antecedents, 'topk:1') "
                 f"AND NOT list_contains(consequents, 'topk:1') AND lift <= {C.RULES_MAX_LIFT}")
TOPK_WHERE = f"lift >= {C.RULES_TOPK_MIN_LIFT} AND consequents = ['topk:1']"


@query("general_rules", with_products_ctes(TRANSACTIONS_CTE + ",\n" + _itemsets_sql(C.RULES_MIN_SUPPORT) + ",\n"
                                           + _rules_sql() + f"\nSELECT {_rounded()} FROM rules WHERE {GENERAL_WHERE}"))
def q_general_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_spark(general_rules(association_rules(topk_itemsets(spark, sf, C.RULES_MIN_SUPPORT))))


@query("topk_rules", with_products_ctes(TRANSACTIONS_CTE + ",\n" + _itemsets_sql(C.RULES_MIN_SUPPORT_TOPK) + ",\n"
                                        + _rules_sql() + f"\nSELECT {_rounded()} FROM rules WHERE {TOPK_WHERE}"))
def q_topk_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_spark(topk_rules(association_rules(topk_itemsets(spark, sf, C.RULES_MIN_SUPPORT_TOPK))))


def rules_export(rules: DataFrame) -> DataFrame:
    """inf -> 999, round 4, items as sorted ', '-joined text."""
    out = rules
    for c in RULE_COLS[2:]:
        out = out.withColumn(c, R(F.coalesce(F.col(c), F.lit(C.RULES_INF_LIFT)) if c == "conviction" else F.col(c),
                                  METRIC_DIGITS))
    return out.withColumn("antecedents", F.array_join(F.array_sort("antecedents"), ", ")) \
              .withColumn("consequents", F.array_join(F.array_sort("consequents"), ", "))


def union_rules(spark: SparkSession, sf: str) -> DataFrame:
    """General and top-k rules, exported; built once per session and input version."""
    from .clustering import _inputs

    def build() -> DataFrame:
        g = general_rules(association_rules(topk_itemsets(spark, sf, C.RULES_MIN_SUPPORT)))
        t = topk_rules(association_rules(topk_itemsets(spark, sf, C.RULES_MIN_SUPPORT_TOPK)))
        return materialize(rules_export(g.unionByName(t)).select(*RULE_COLS), "rules")

    return cached_layer(spark, "rules", _inputs(sf), "rules", build)


def _export_cols_sql() -> str:
    parts = ["array_to_string(list_sort(antecedents), ', ') AS antecedents",
             "array_to_string(list_sort(consequents), ', ') AS consequents"]
    for c in RULE_COLS[2:]:
        e = f"coalesce({c}, {C.RULES_INF_LIFT}::DOUBLE)" if c == "conviction" else c
        parts.append(f"{rnd(e, METRIC_DIGITS)} AS {c}")
    return ", ".join(parts)


def _union_sql_ctes() -> str:
    g = _itemsets_sql(C.RULES_MIN_SUPPORT).replace("n_tx", "n_tx1").replace("sub AS", "sub1 AS").replace("FROM sub GROUP", "FROM sub1 GROUP") \
        .replace("fi AS", "fi1 AS")
    t = _itemsets_sql(C.RULES_MIN_SUPPORT_TOPK).replace("n_tx", "n_tx2").replace("sub AS", "sub2 AS") \
        .replace("FROM sub GROUP", "FROM sub2 GROUP").replace("fi AS", "fi2 AS")
    r1 = _rules_sql("fi1").replace("sets AS", "sets1 AS").replace("FROM sets)", "FROM sets1)").replace("split AS", "split1 AS") \
        .replace("FROM split s", "FROM split1 s").replace("rl AS", "rl1 AS").replace("FROM rl)", "FROM rl1)").replace("rules AS", "rules1 AS")
    r2 = _rules_sql("fi2").replace("sets AS", "sets2 AS").replace("FROM sets)", "FROM sets2)").replace("split AS", "split2 AS") \
        .replace("FROM split s", "FROM split2 s").replace("rl AS", "rl2 AS").replace("FROM rl)", "FROM rl2)").replace("rules AS", "rules2 AS")
    return (TRANSACTIONS_CTE + ",\n" + g + ",\n" + t + ",\n" + r1 + ",\n" + r2 + f""",
all_rules AS (SELECT {_export_cols_sql()} FROM rules1 WHERE {GENERAL_WHERE}
              UNION ALL SELECT {_export_cols_sql()} FROM rules2 WHERE {TOPK_WHERE})""")


@query("union_rules", with_products_ctes(_union_sql_ctes() + "\nSELECT * FROM all_rules"))
def q_union_rules(spark: SparkSession, sf: str) -> DataFrame:
    """General rules + top-k rules, UNION ALL (a rule may appear once per pass), exported."""
    return union_rules(spark, sf)


@query("rules_export", with_products_ctes(_union_sql_ctes() + """
SELECT count(*) AS n_rules, count(*) FILTER (WHERE consequents = 'topk:1') AS n_topk_rules,
  count(*) FILTER (WHERE conviction = 999.0) AS n_inf_conviction FROM all_rules"""))
def q_rules_export(spark: SparkSession, sf: str) -> DataFrame:
    r = union_rules(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("consequents") == "topk:1").alias("n_topk_rules"),
                 F.count_if(F.col("conviction") == C.RULES_INF_LIFT).alias("n_inf_conviction"))


TOP_RULES_N = 15


@query("top_rules", with_products_ctes(_union_sql_ctes() + f"""
SELECT antecedents, consequents, support, confidence, lift FROM all_rules WHERE contains(consequents, 'topk:1') AND lift >= 1.2
ORDER BY lift DESC, antecedents, consequents LIMIT {TOP_RULES_N}"""))
def q_top_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Best rules by lift, optional consequent filter (here: top-k consequents) and minimum lift."""
    r = union_rules(spark, sf).filter(F.contains("consequents", F.lit("topk:1")) & (F.col("lift") >= 1.2))
    return r.orderBy(F.col("lift").desc(), "antecedents", "consequents").limit(TOP_RULES_N) \
            .select("antecedents", "consequents", "support", "confidence", "lift")


def rule_index(spark: SparkSession, sf: str) -> SearchIndex:
    """Posting lists of both sides of the exported rules."""
    from .clustering import _inputs

    return cached_layer(spark, "rule_index", _inputs(sf), "rules", lambda: SearchIndex.build(
        union_rules(spark, sf), new_table(spark, "rule-index"), ["antecedents", "consequents"]))


RULE_SEARCH = "price:"


@query("rule_search", with_products_ctes(_union_sql_ctes() + f"""
SELECT antecedents, consequents, confidence, lift FROM all_rules
WHERE contains(lower(antecedents), '{RULE_SEARCH}') OR contains(lower(consequents), '{RULE_SEARCH}')
ORDER BY confidence DESC, antecedents, consequents LIMIT 100"""))
def q_rule_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rules mentioning a term on either side, by the chosen metric (confidence), first 100."""
    return rule_index(spark, sf).search(RULE_SEARCH).orderBy(F.col("confidence").desc(), "antecedents", "consequents").limit(100) \
            .select("antecedents", "consequents", "confidence", "lift")


MAX_TRANSACTIONS = 2000
MAX_ITEMS = 20
CAP_SEED = 42


def cap_transactions(tx: DataFrame, key: F.Column, n: int = MAX_TRANSACTIONS, max_items: int = MAX_ITEMS,
                     seed: int = CAP_SEED) -> DataFrame:
    """At most ``n`` transactions (seeded hash order, TakeOrderedAndProject) with their first
    ``max_items`` items in sorted order."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    capped = tx.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
    return capped.withColumn("items", F.slice(F.array_sort("items"), 1, max_items))


@query("cap_transactions", with_baskets(f"""SELECT basket_id, list_slice(list_sort(items), 1, {MAX_ITEMS}) AS items FROM (
  SELECT basket_id, list(DISTINCT item) AS items FROM order_baskets GROUP BY basket_id) b
ORDER BY md5(CAST(basket_id AS VARCHAR) || '#{CAP_SEED}') LIMIT {MAX_TRANSACTIONS}"""))
def q_cap_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Order baskets (distinct part types per order), capped to 2000 baskets of at most 20 items."""
    tx = order_baskets(spark, sf).groupBy("basket_id").agg(F.collect_set("item").alias("items"))
    return cap_transactions(tx, F.col("basket_id"))


STORE_MIN_SUPPORT = 0.1
STORE_MIN_CONFIDENCE = 0.5


def _store_basket_sql() -> str:
    its = _itemsets_sql(STORE_MIN_SUPPORT, "sb_tx")
    return with_products_ctes(f"""sb AS (SELECT source_platform, source_store, list_sort(list(DISTINCT category)) AS items
      FROM products GROUP BY source_platform, source_store),
sb_tx AS (SELECT list_sort(items) AS items FROM sb),
{its},
{_rules_sql()}
SELECT {_rounded()} FROM rules WHERE confidence >= {STORE_MIN_CONFIDENCE}""")


@query("store_basket_rules", _store_basket_sql())
def q_store_basket_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Variant: baskets = all categories of each store; support .1, confidence .5."""
    p = processed_products(spark, sf)
    tx = p.groupBy("source_platform", "source_store").agg(F.array_sort(F.collect_set("category")).alias("items"))
    tx = materialize(tx, "store_baskets")
    rules = association_rules(frequent_itemsets(tx, STORE_MIN_SUPPORT))
    return _rounded_spark(rules.filter(F.col("confidence") >= STORE_MIN_CONFIDENCE))
