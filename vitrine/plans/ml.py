"""Model training and evaluation (section 2.9): boosted trees, metrics, PR curve, isolation forest.

Metrics are DataFrame aggregates: the confusion matrix is one ``count_if`` pass, ROC-AUC is the rank
sum over *distinct* scores and the PR curve a running sum over distinct scores, both through the
bucketed prefix sums (no window over all rows in one task).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators.boosting import BoostedTrees, boosted_trees
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import prefix_sums
from ..oracle.catalog import rnd, with_products, with_products_ctes
from ..registry import query
from ..session import cached_layer, materialize
from ..sources.tables import read_table, table_path
from .features import ALL_FEATURES, TARGET, class_weight, feature_matrix, stratified_split
from .preprocess import processed_products

R = round_half_up
F1_EPS = 1e-8


# ---------------------------------------------------------------------------------------------
# Scored documents: a deterministic score per document checked against the quality labels.
# ---------------------------------------------------------------------------------------------
def doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(F.col("n_chars").cast("double")) - F.lit(7.5))))
    return docs.join(labels, "doc_id").select("doc_id", "label", R(s, 4).alias("score"))


DOC_SCORES_CTE = f"""scored_docs AS (SELECT d.doc_id, l.quality AS label,
  {rnd('1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(CAST(d.n_chars AS DOUBLE)) - 7.5::DOUBLE)))', 4)} AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                     F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mann-Whitney AUC with tied scores counted half."""
    sc = prefix_sums(score_counts(scored, label, score), score, ["neg"], descending=False)
    return sc.agg((F.sum(F.col("pos") * (F.col("_before_neg") + F.lit(0.5) * F.col("neg")))
                   / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    m = scored.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                   F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))
    auc = roc_auc(scored, label, score).select("roc_auc").scalar()
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ["tp", "fp", "tn", "fn"])
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    prec0 = F.when(tn + fn > 0, tn / (tn + fn)).otherwise(F.lit(0.0))
    rec0 = F.when(tn + fp > 0, tn / (tn + fp)).otherwise(F.lit(0.0))
    return m.select("tp", "fp", "tn", "fn",
                    R((tp + tn) / (tp + fp + tn + fn), 4).alias("accuracy"),
                    R(prec, 4).alias("precision_1"), R(rec, 4).alias("recall_1"), R(f1, 4).alias("f1"),
                    R(prec0, 4).alias("precision_0"), R(rec0, 4).alias("recall_0"),
                    (F.col("tp") + F.col("fn")).alias("support_1"), (F.col("tn") + F.col("fp")).alias("support_0"),
                    R(auc, 4).alias("roc_auc"))


@query("binary_metrics", f"""WITH {DOC_SCORES_CTE},
m AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
      count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn
      FROM scored_docs),
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored_docs GROUP BY score),
a AS (SELECT sum(pos * (coalesce(below, 0) + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg)) AS auc FROM
      (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g) x)
SELECT tp, fp, tn, fn, {rnd('(tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE)', 4)} AS accuracy,
  {rnd('CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END', 4)} AS precision_1,
  {rnd('CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END', 4)} AS recall_1,
  {rnd('CASE WHEN tp > 0 THEN 2.0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / ((tp / CAST(tp + fp AS DOUBLE)) + (tp / CAST(tp + fn AS DOUBLE))) ELSE 0.0 END', 4)} AS f1,
  {rnd('CASE WHEN tn + fn > 0 THEN tn / CAST(tn + fn AS DOUBLE) ELSE 0.0 END', 4)} AS precision_0,
  {rnd('CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0.0 END', 4)} AS recall_0,
  tp + fn AS support_1, tn + fp AS support_0, {rnd('auc', 4)} AS roc_auc FROM m CROSS JOIN a""")
def q_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix, accuracy, F1, per-class precision/recall/support and ROC-AUC of a document score."""
    return binary_metrics(doc_scores(spark, sf))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision / recall / F1 at every distinct score threshold, down to the first full recall.
    ``_f1`` keeps the unrounded F1 for threshold selection."""
    sc = prefix_sums(score_counts(scored, label, score), score, ["pos", "neg"], descending=True, inclusive=True)
    total_pos = scored.select(F.count_if(F.col(label) == 1)).scalar()
    curve = sc.select(F.col(score).alias("threshold"), F.col("_before_pos").alias("tp"), F.col("_before_neg").alias("fp"))
    full = curve.filter(F.col("tp") == total_pos).select(F.max("threshold")).scalar()
    curve = curve.filter(F.col("threshold") >= full)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.col("tp") / total_pos
    f1 = F.lit(2.0) * p * r / (p + r + F.lit(F1_EPS))
    return curve.select("threshold", "tp", "fp", R(p, 6).alias("precision"), R(r, 6).alias("recall"),
                        R(f1, 6).alias("f1"), f1.alias("_f1"))


PR_SQL_CTES = f"""{DOC_SCORES_CTE},
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored_docs GROUP BY score),
c AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
      sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
      sum(pos) OVER () AS p_all FROM g),
curve AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(p_all AS DOUBLE) AS r
      FROM c WHERE threshold >= (SELECT max(threshold) FROM c WHERE tp = p_all))"""


@query("pr_curve", f"""WITH {PR_SQL_CTES}
SELECT threshold, tp, fp, {rnd('p', 6)} AS precision, {rnd('r', 6)} AS recall,
       {rnd(f'2.0::DOUBLE * p * r / (p + r + {F1_EPS}::DOUBLE)', 6)} AS f1 FROM curve""")
def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return pr_curve(doc_scores(spark, sf)).drop("_f1")


def best_threshold(curve: DataFrame) -> DataFrame:
    """Threshold with the highest F1 (eps 1e-8 in the denominator); ties go to the lowest threshold."""
    best = curve.orderBy(F.col("_f1").desc(), F.col("threshold").asc()).limit(1)
    return best.select("threshold", R(F.col("_f1"), 4).alias("f1"))


@query("best_threshold", f"""WITH {PR_SQL_CTES}
SELECT threshold, {rnd('f1', 4)} AS f1 FROM (SELECT threshold, 2.0::DOUBLE * p * r / (p + r + {F1_EPS}::DOUBLE) AS f1 FROM curve) t
ORDER BY f1 DESC, threshold LIMIT 1""")
def q_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return best_threshold(pr_curve(doc_scores(spark, sf)))


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    e = F.col(y) - F.col(yhat)
    m = pred.agg(F.avg(e * e).alias("mse"), F.var_pop(y).alias("_var"))
    return m.select(R(F.col("mse"), 6).alias("mse"), R(F.lit(1.0) - F.col("mse") / F.col("_var"), 6).alias("r2"))


@query("regression_metrics", with_products(f"""SELECT {rnd('avg((price - yhat) * (price - yhat))', 6)} AS mse,
  {rnd('1.0::DOUBLE - avg((price - yhat) * (price - yhat)) / var_pop(price)', 6)} AS r2
FROM (SELECT price, avg(price) OVER (PARTITION BY category) AS yhat FROM products) t"""))
def q_regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """MSE and R2 of a per-category mean-price baseline."""
    p = processed_products(spark, sf)
    means = p.groupBy("category").agg(F.avg("price").alias("yhat"))
    pred = p.join(means, "category").select(F.col("price").alias("y"), "yhat")
    return regression_metrics(pred)


# ---------------------------------------------------------------------------------------------
# Boosted trees
# ---------------------------------------------------------------------------------------------
KEY = ["product_id", "source_store"]
GBT_PARAMS = dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
GBT_REG_PARAMS = dict(maxIter=100, maxDepth=6, stepSize=0.1, seed=42)


def _inputs(sf: str) -> list[str]:
    from .preprocess import RAW_INPUTS

    return [table_path(sf, t) for t in RAW_INPUTS]


def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    return cached_layer(spark, "training_frame", _inputs(sf), ALL_FEATURES, lambda: _training_frame(spark, sf))


def topk_model(spark: SparkSession, sf: str):
    """The boosted-tree model of the training split (fitted once per session and input version)."""
    return cached_layer(spark, "gbt_model", _inputs(sf), GBT_PARAMS,
                        lambda: train_topk_classifier(training_frame(spark, sf).filter(F.col("split") == "train")))


def _training_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Unscaled feature matrix with the stratified split and the class weight column, on files."""
    from pyspark.ml.feature import VectorAssembler

    fm = feature_matrix(processed_products(spark, sf), scale=False)
    fm = stratified_split(fm, F.concat_ws("|", "product_id", "source_store"))
    fm = VectorAssembler(inputCols=ALL_FEATURES, outputCol="features").transform(fm)
    fm = materialize(fm, "training_frame")
    w = class_weight(fm.filter(F.col("split") == "train")).select("scale_pos_weight").scalar()
    return fm.withColumn("weight", F.when(F.col(TARGET) == 1, w).otherwise(F.lit(1.0)))


def train_topk_classifier(train: DataFrame) -> BoostedTrees:
    train = train.withColumn("features", vector_to_array("features"))
    return boosted_trees(train, "features", TARGET, KEY, classify=True, weight="weight", **GBT_PARAMS)


@query("train_topk_classifier")
def q_train_topk_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on the training split; test-split metrics at 0.5 and at the best-F1 threshold."""
    fm = training_frame(spark, sf)
    model = topk_model(spark, sf)
    test = fm.filter(F.col("split") == "test")
    scored = test.select(F.col(TARGET).alias("label"), model.probability(vector_to_array("features")).alias("score"))
    scored = materialize(scored, "classifier_scores")
    best = materialize(best_threshold(pr_curve(scored)), "best_threshold")
    sizes = fm.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    out = binary_metrics(scored)
    for c, source, name in (("n_train", sizes, "n_train"), ("n_test", sizes, "n_test"), ("threshold", best, "best_threshold"), ("f1", best, "best_f1")):
        out = out.withColumn(name, source.select(c).scalar())
    return out


@query("feature_importance")
def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Per-feature importance of the boosted trees, sorted."""
    model = topk_model(spark, sf)
    imp = model.importances.tolist()
    rows = sorted(zip(ALL_FEATURES, imp), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


VARIANT_NUM = ["price", "rating", "review_count"]
VARIANT_CAT = ["category", "brand", "source_platform"]
VARIANT_FEATURES = [f"{c}_enc" for c in VARIANT_CAT] + VARIANT_NUM


def variant_features(spark: SparkSession, sf: str) -> DataFrame:
    """Key, the variant pipeline's encoded columns and its scaled numbers (nulls as 0, 'unknown')."""
    from .features import label_encode, standard_scale

    p = processed_products(spark, sf).select("product_id", "source_store", *VARIANT_NUM, *VARIANT_CAT)
    p = materialize(label_encode(p.fillna("unknown", subset=VARIANT_CAT), VARIANT_CAT), "variant_encoded")
    return standard_scale(p, VARIANT_NUM, fill_zero=True).select("product_id", "source_store", *VARIANT_FEATURES)


@query("train_price_regressor")
def q_train_price_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Variant: boosted-tree price regression (100 trees, depth 6, rate .1) on the scaled numbers and the
    encoded category, brand and platform; MSE and R2 on a random split."""
    from pyspark.ml.feature import VectorAssembler

    from .features import random_split

    p = variant_features(spark, sf).withColumn("target", F.col("price"))
    p = random_split(p, F.concat_ws("|", "product_id", "source_store"))
    p = VectorAssembler(inputCols=VARIANT_FEATURES, outputCol="features").transform(p)
    p = materialize(p, "regression_frame")
    p = p.withColumn("features", vector_to_array("features"))
    model = boosted_trees(p.filter("split = 'train'"), "features", "target", KEY, classify=False, **GBT_REG_PARAMS)
    pred = p.filter("split = 'test'").select(F.col("target").alias("y"), model.margin(F.col("features")).alias("yhat"))
    return regression_metrics(pred)


# ---------------------------------------------------------------------------------------------
# Isolation forest (Liu, Ting, Zhou 2008) whose every choice is an md5 draw, so that SQL can follow it: a tree's
# sample are the rows with the least hashes for that tree, a node's feature and split are drawn by tree and node.
# The forest is a table of nodes (heap order), bounded by trees and depth; rows walk it in all trees at once.
# ---------------------------------------------------------------------------------------------
IF_TREES = 100
IF_SAMPLE = 256
IF_CONTAMINATION = 0.1
#: Hashes are under 2**31, multipliers and shifts of a tree under this prime, so their products fit 64 bits.
IF_PRIME = 2_147_483_647
#: Path lengths are whole billionths, so that their sums are exact.
IF_UNIT = 1_000_000_000


def _draw(text: str) -> float:
    """Uniform in (0, 1) from the first eight hex digits of md5."""
    import hashlib

    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def _tree_hash(tree: int) -> tuple[int, int]:
    """Multiplier and shift that give a tree its own order of the rows' hashes."""
    return 1 + int(_draw(f"tree:{tree}:a") * (IF_PRIME - 1)), int(_draw(f"tree:{tree}:b") * IF_PRIME)


def _rest_path(n: int) -> int:
    """Mean path that ``n`` rows in a leaf would still take, in ``IF_UNIT``."""
    import math

    if n <= 2:
        return IF_UNIT if n == 2 else 0
    return math.floor((2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n) * IF_UNIT + 0.5)


def _grow(tree: int, x, max_depth: int) -> list[tuple[int, int, int, float, int]]:
    """(tree, node, feature, split, rows) of a tree's nodes; feature -1 at leaves."""
    nodes, todo = [], [(1, x)]
    while todo:
        node, own = todo.pop()
        lo, hi = own.min(axis=0), own.max(axis=0)
        usable = (hi > lo).nonzero()[0]
        if node >= 1 << max_depth or len(own) <= 1 or not len(usable):
            nodes.append((tree, node, -1, 0.0, len(own)))
            continue
        f = int(usable[int(_draw(f"{tree}:{node}:f") * len(usable))])
        split = float(lo[f] + _draw(f"{tree}:{node}:s") * (hi[f] - lo[f]))
        nodes.append((tree, node, f, split, len(own)))
        left = own[:, f] < split
        # a draw that rounds to an end leaves a side empty: that side is no node
        todo += [(2 * node + side, own[at]) for side, at in ((0, left), (1, ~left)) if at.any()]
    return nodes


def isolation_forest_scores(df: DataFrame, key: str, cols: list[str], n_trees: int = IF_TREES,
                            sample: int = IF_SAMPLE) -> DataFrame:
    """(key, anomaly_score) from ``n_trees`` trees, each grown on the ``sample`` rows with the least hashes for that
    tree: every task keeps its own least rows per tree, and these meet per tree."""
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    orders = [_tree_hash(t) for t in range(n_trees)]
    names = [f"x{i}" for i in range(len(cols))]
    features = ", ".join(f"{n} double" for n in names)
    max_depth = int(math.ceil(math.log2(max(sample, 2))))
    name = F.col(key).cast("string")
    hashed = df.select(name.alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)],
                       F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long").bitwiseAND(IF_PRIME).alias("h"))

    def least(batch_iter):
        """Of all batches of the task the rows that can be among a tree's least."""
        held: list = [None] * n_trees
        for b in batch_iter:
            base = b.column("h").to_numpy()
            for t, (a, shift) in enumerate(orders):
                own = (base * a + shift) % IF_PRIME
                if len(own) > sample:
                    at = np.flatnonzero(own <= np.partition(own, sample - 1)[sample - 1])
                else:
                    at = np.arange(len(own))
                part = b.take(pa.array(at)).set_column(len(names) + 1, "h", pa.array(own[at]))
                table = pa.Table.from_batches([part] if held[t] is None else [*held[t].to_batches(), part])
                if len(table) > 2 * sample:
                    all_h = table.column("h").to_numpy()
                    table = table.filter(pa.array(all_h <= np.partition(all_h, sample - 1)[sample - 1]))
                held[t] = table
        for t, table in enumerate(held):
            for b in table.to_batches() if table is not None else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, dtype=np.int32)), *b.columns], names=["tree", *b.schema.names])

    candidates = hashed.mapInArrow(least, f"tree int, key string, {features}, h long")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))
    picked = candidates.withColumn("place", place).where(F.col("place") <= sample).drop("place")

    def grow(key_, rows):
        x = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
        nodes = _grow(key_[0].as_py(), x, max_depth)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*nodes), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()))], names=["tree", "node", "feature", "split", "n"])

    # n_trees x 2 * sample nodes at most
    forest = picked.groupBy("tree").applyInArrow(grow, "tree int, node int, feature int, split double, n int").collect()
    width = 2 << max_depth
    feature = np.full(n_trees * width, -1, dtype=np.int64)
    split, leaf = np.zeros(n_trees * width), np.zeros(n_trees * width, dtype=np.int64)
    for r in forest:
        at = r["tree"] * width + r["node"]
        feature[at], split[at] = r["feature"], r["split"]
        leaf[at] = (r["node"].bit_length() - 1) * IF_UNIT + _rest_path(r["n"])
    for t in range(n_trees):  # where a side has no rows, a row stops as it would in an empty leaf
        for node in range(2, width):
            at, up = t * width + node, t * width + node // 2
            if feature[up] >= 0 and not leaf[at]:
                leaf[at] = (node.bit_length() - 1) * IF_UNIT
    roots = [r["n"] for r in forest if r["node"] == 1]
    usual = max(_rest_path(max(roots, default=sample)) / IF_UNIT, 1.0)
    told = df.sparkSession.sparkContext.broadcast((feature, split, leaf))

    def score(batch_iter):
        feature_, split_, leaf_ = told.value
        for b in batch_iter:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(b) else np.zeros((0, len(names)))
            row = np.arange(len(x))[:, None]
            root = np.arange(n_trees) * width
            node = np.ones((len(x), n_trees), dtype=np.int64)
            for _ in range(max_depth):
                f = feature_[root + node]
                further = 2 * node + (x[row, np.maximum(f, 0)] >= split_[root + node])
                node = np.where(f >= 0, further, node)
            mean = leaf_[root + node].sum(axis=1).astype(np.float64) / n_trees / IF_UNIT
            yield pa.record_batch([b.column("key"), pa.array(np.power(2.0, -mean / usual))], names=["key", "anomaly_score"])

    scored = hashed.drop("h").mapInArrow(score, "key string, anomaly_score double")
    return scored.select(F.col("key").cast(dict(df.dtypes)[key]).alias(key), "anomaly_score")


def _forest_sql() -> str:
    """The same draws: samples by hash, levels by recursion, and all rows walking the table of nodes."""
    import math

    from .features import _enc_sql, _scaled_sql

    n, depth = len(VARIANT_FEATURES), int(math.ceil(math.log2(IF_SAMPLE)))
    x = [f"x{i}" for i in range(n)]
    named = ", ".join(f"CAST({c} AS DOUBLE) AS {i}" for c, i in zip(VARIANT_FEATURES, x))
    trees = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in ((t, _tree_hash(t)) for t in range(IF_TREES)))
    draw = lambda what: f"((('0x' || substr(md5(tree || ':' || node || ':{what}'), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    node = "PARTITION BY tree, node"
    ends = ", ".join(f"min({c}) OVER ({node}) AS lo{i}, max({c}) OVER ({node}) AS hi{i}" for i, c in enumerate(x))
    usable = "list_filter([" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(n)) + "], lambda f: f IS NOT NULL)"
    pick = lambda prefix: "[" + ", ".join(f"{prefix}{i}" for i in range(n)) + "][f + 1]"
    split = f"({pick('lo')} + {draw('s')} * ({pick('hi')} - {pick('lo')}))"
    rest = f"CASE WHEN n > 2 THEN floor((2.0::DOUBLE * (ln(n - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2.0::DOUBLE * (n - 1.0::DOUBLE) / n) * {float(IF_UNIT)}::DOUBLE + 0.5::DOUBLE) WHEN n = 2 THEN {IF_UNIT} ELSE 0 END"
    fields = ", ".join(x)
    return f"""v AS (SELECT product_id, source_store, {', '.join(_scaled_sql(c) for c in VARIANT_NUM)}, {', '.join(_enc_sql(c) for c in VARIANT_CAT)}
  FROM (SELECT product_id, source_store, {', '.join(f'coalesce({c}, 0) AS {c}' for c in VARIANT_NUM)}, {', '.join(f"coalesce({c}, 'unknown') AS {c}" for c in VARIANT_CAT)} FROM products)),
points AS MATERIALIZED (SELECT product_id || '|' || source_store AS key, row_number() OVER (ORDER BY product_id, source_store) AS rid,
  (('0x' || substr(md5(product_id || '|' || source_store), 1, 8))::BIGINT & {IF_PRIME}) AS h, {named} FROM v),
trees(tree, a, b) AS (VALUES {trees}),
grown AS (SELECT tree, 1 AS node, {fields} FROM (SELECT tree, key, (h * a + b) % {IF_PRIME} AS th, {fields} FROM points, trees
    QUALIFY row_number() OVER (PARTITION BY tree ORDER BY th, key) <= {IF_SAMPLE})
  UNION ALL
  SELECT tree, 2 * node + CAST({pick('x')} >= {split} AS INT), {fields}
  FROM (SELECT *, {usable}[CAST(floor({draw('f')} * len({usable})) AS INT) + 1] AS f
    FROM (SELECT *, {ends} FROM grown WHERE node < {1 << depth})) WHERE f IS NOT NULL),
sized AS (SELECT tree, node, count(*) AS n, {', '.join(f'min({c}) AS lo{i}, max({c}) AS hi{i}' for i, c in enumerate(x))} FROM grown GROUP BY tree, node),
nodes AS MATERIALIZED (SELECT tree, node, n, f, {split} AS split
  FROM (SELECT *, CASE WHEN node < {1 << depth} THEN {usable}[CAST(floor({draw('f')} * len({usable})) AS INT) + 1] END AS f FROM sized)),
walk AS (SELECT p.rid, t.tree, 1 AS node, 0 AS depth, FALSE AS ended FROM points p, trees t
  UNION ALL
  SELECT w.rid, w.tree, CASE WHEN m.f IS NULL THEN w.node ELSE 2 * w.node + CAST([{', '.join(f'p.{c}' for c in x)}][m.f + 1] >= m.split AS INT) END,
    w.depth + CAST(m.f IS NOT NULL AS INT), m.f IS NULL
  FROM walk w JOIN points p USING (rid) LEFT JOIN nodes m ON m.tree = w.tree AND m.node = w.node WHERE NOT w.ended),
paths AS (SELECT rid, sum(depth * {IF_UNIT}::BIGINT + CAST(coalesce({rest}, 0) AS BIGINT)) AS path
  FROM walk w LEFT JOIN nodes m USING (tree, node) WHERE ended GROUP BY rid),
usual AS (SELECT greatest(max({rest}) / {float(IF_UNIT)}::DOUBLE, 1) AS c FROM nodes WHERE node = 1),
scores AS (SELECT p.key, {rnd(f'pow(2.0::DOUBLE, -(CAST(path AS DOUBLE) / {IF_TREES} / {float(IF_UNIT)}::DOUBLE) / c)', 6)} AS anomaly_score
  FROM paths JOIN points p USING (rid), usual)
SELECT key, anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, {1.0 - IF_CONTAMINATION}) FROM scores) AS is_anomaly FROM scores"""


@query("isolation_forest", with_products_ctes(_forest_sql()).replace("WITH ", "WITH RECURSIVE ", 1))
def q_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Variant anomaly detector on the scaled numbers and encoded columns: the top 10 % scores are anomalies
    (cut at the exact 90 % quantile of the scores)."""
    p = variant_features(spark, sf).withColumn("key", F.concat_ws("|", "product_id", "source_store"))
    p = materialize(p.select("key", *VARIANT_FEATURES), "iforest_input")
    s = isolation_forest_scores(p, "key", VARIANT_FEATURES)
    s = materialize(s.withColumn("anomaly_score", R(F.col("anomaly_score"), 6)), "iforest_scores")
    cut = exact_quantiles(s, "anomaly_score", [1.0 - IF_CONTAMINATION]).select(F.col("quantiles")[0]).scalar()
    return s.withColumn("is_anomaly", F.col("anomaly_score") > cut)
