"""Segmentation and anomaly jobs (section 2.9): grid DBSCAN, dense regions, KMeans segments, PCA,
silhouette, and the joins and profiles built on them (sections 2.4, 2.5, 2.6).

DBSCAN is exact without an all-pairs join: points are cut into square cells of side eps / sqrt(2), so any
two points of one cell are neighbours. A cell holding ``min_samples`` points makes all of them core
with no distance test; only points of sparse cells are tested, against the 5 x 5 surrounding cells:
a cell wholly inside the point's eps-circle is counted from its cell total, a cell wholly outside is
skipped, and only cells crossing the circle are compared point by point.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import round_half_up
from ..oracle.catalog import rnd, with_products_ctes
from ..operators.components import components
from ..operators.lloyd import lloyd, nearest, silhouettes, whole_silhouettes
from ..operators.moments import SQUARINGS, principal_components, projected
from ..registry import query
from ..session import cached_layer, materialize
from ..sources.tables import table_path
from .features import ALL_FEATURES, SCALE_DIGITS, feature_matrix, standard_scale
from .preprocess import RAW_INPUTS, processed_products


def _inputs(sf: str) -> list[str]:
    return [table_path(sf, t) for t in RAW_INPUTS]

R = round_half_up
KEY = ["product_id", "source_store"]


# ---------------------------------------------------------------------------------------------
# DBSCAN on the grid
# ---------------------------------------------------------------------------------------------
def _cells(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / side)).withColumn("_cy", F.floor(F.col(y) / side))


OFFSETS_5X5 = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
# Box tests use a margin so that rounding at a cell edge never decides a distance: a cell counts
# wholesale only when it is inside the circle by more than the margin, and is skipped only when it is
# outside by more than the margin; everything in between is compared point by point.
BOX_MARGIN = 1e-9


def _probe_cells(points: DataFrame, px: str, py: str, side: float) -> DataFrame:
    """Every (point, neighbouring cell) pair of the 5 x 5 block, with the squared nearest and farthest
    distance from the point to the cell's box."""
    off = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS_5X5]))
    pr = points.select("*", off.alias("_o"))
    pr = pr.withColumn("_ncx", F.col("_pcx") + F.col("_o.dx")).withColumn("_ncy", F.col("_pcy") + F.col("_o.dy")).drop("_o")
    x0, x1 = F.col("_ncx") * side, (F.col("_ncx") + 1) * side
    y0, y1 = F.col("_ncy") * side, (F.col("_ncy") + 1) * side
    X, Y = F.col(px), F.col(py)
    zero = F.lit(0.0)
    nx = F.greatest(x0 - X, X - x1, zero)
    ny = F.greatest(y0 - Y, Y - y1, zero)
    fx = F.greatest(F.abs(X - x0), F.abs(X - x1))
    fy = F.greatest(F.abs(Y - y0), F.abs(Y - y1))
    return pr.withColumn("_near2", nx * nx + ny * ny).withColumn("_far2", fx * fx + fy * fy)


def dbscan_core(points: DataFrame, x: str = "x", y: str = "y", eps: float = C.DBSCAN_EPS,
                min_samples: int = C.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Distinct points (x, y, n = multiplicity) with ``is_core`` (neighbours within eps, self included)."""
    side = eps / math.sqrt(2.0)
    e2 = eps * eps
    pts = _cells(points.groupBy(x, y).agg(F.count(F.lit(1)).alias("n")), x, y, side)
    cell_n = pts.groupBy("_cx", "_cy").agg(F.sum("n").alias("_cell_n"))
    pts = pts.join(cell_n, ["_cx", "_cy"])
    dense = pts.filter(F.col("_cell_n") >= min_samples).select(x, y, "n", "_cx", "_cy", F.lit(True).alias("is_core"))
    sparse = pts.filter(F.col("_cell_n") < min_samples).select(
        F.col(x).alias("_px"), F.col(y).alias("_py"), F.col("n").alias("_pn"), F.col("_cx").alias("_pcx"),
        F.col("_cy").alias("_pcy"))
    pc = _probe_cells(sparse, "_px", "_py", side)
    pc = pc.filter(F.col("_near2") <= F.lit(e2 + BOX_MARGIN))
    pc = pc.join(cell_n.select(F.col("_cx").alias("_ncx"), F.col("_cy").alias("_ncy"), "_cell_n"), ["_ncx", "_ncy"])
    inside = F.col("_far2") <= F.lit(e2 - BOX_MARGIN)
    keys = ["_px", "_py", "_pn", "_pcx", "_pcy"]
    # cells wholly inside the circle count without looking at their points
    whole = pc.filter(inside).groupBy(*keys).agg(F.sum("_cell_n").alias("_nb"))
    # cells crossing the circle: point-by-point distances
    part = pc.filter(~inside).select(*keys, "_ncx", "_ncy") \
        .join(pts.select(F.col(x).alias("_qx"), F.col(y).alias("_qy"), F.col("n").alias("_qn"),
                         F.col("_cx").alias("_ncx"), F.col("_cy").alias("_ncy")), ["_ncx", "_ncy"])
    dx = F.col("_px") - F.col("_qx")
    dy = F.col("_py") - F.col("_qy")
    part = part.filter(dx * dx + dy * dy <= F.lit(e2)).groupBy(*keys).agg(F.sum("_qn").alias("_nb"))
    cnt = whole.unionByName(part).groupBy(*keys).agg(F.sum("_nb").alias("_nb"))
    sparse_core = cnt.select(F.col("_px").alias(x), F.col("_py").alias(y), F.col("_pn").alias("n"),
                             F.col("_pcx").alias("_cx"), F.col("_pcy").alias("_cy"),
                             (F.col("_nb") >= min_samples).alias("is_core"))
    return dense.unionByName(sparse_core)


def dbscan_noise(points: DataFrame, x: str = "x", y: str = "y", eps: float = C.DBSCAN_EPS,
                 min_samples: int = C.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Distinct points with ``is_core`` and ``is_noise`` (not core and no core point within eps)."""
    side = eps / math.sqrt(2.0)
    e2 = eps * eps
    core = materialize(dbscan_core(points, x, y, eps, min_samples), "dbscan_core")
    # per cell: number of core points and whether every point of the cell is core (dense cells)
    core_cells = core.groupBy("_cx", "_cy").agg(F.count_if("is_core").alias("_ncore"),
                                                 F.bool_and("is_core").alias("_allcore"))
    non_core = core.filter(~F.col("is_core")).select(F.col(x).alias("_px"), F.col(y).alias("_py"),
                                                      F.col("_cx").alias("_pcx"), F.col("_cy").alias("_pcy"))
    pc = _probe_cells(non_core, "_px", "_py", side).filter(F.col("_near2") <= F.lit(e2 + BOX_MARGIN))
    pc = pc.join(core_cells.select(F.col("_cx").alias("_ncx"), F.col("_cy").alias("_ncy"), "_ncore", "_allcore")
                 .filter(F.col("_ncore") > 0), ["_ncx", "_ncy"])
    inside = (F.col("_far2") <= F.lit(e2 - BOX_MARGIN)) & F.col("_allcore")
    keys = ["_px", "_py"]
    hit_whole = pc.filter(inside).select(*keys)
    cores = core.filter("is_core").select(F.col(x).alias("_qx"), F.col(y).alias("_qy"), F.col("_cx").alias("_ncx"),
                                          F.col("_cy").alias("_ncy"))
    part = pc.filter(~inside).select(*keys, "_ncx", "_ncy").join(cores, ["_ncx", "_ncy"])
    dx = F.col("_px") - F.col("_qx")
    dy = F.col("_py") - F.col("_qy")
    hit_part = part.filter(dx * dx + dy * dy <= F.lit(e2)).select(*keys)
    border = hit_whole.unionByName(hit_part).distinct() \
        .select(F.col("_px").alias(x), F.col("_py").alias(y), F.lit(True).alias("_border"))
    out = core.join(border, [x, y], "left")
    return out.withColumn("is_noise", ~F.col("is_core") & F.col("_border").isNull()).drop("_border")


def anomaly_points(spark: SparkSession, sf: str) -> DataFrame:
    """Products with scaled (price, discount) and the DBSCAN noise flag (an output layer)."""
    return cached_layer(spark, "anomalies", _inputs(sf), (C.DBSCAN_EPS, C.DBSCAN_MIN_SAMPLES),
                        lambda: _anomaly_points(spark, sf))


def _anomaly_points(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    sc = standard_scale(p.select(*KEY, "price", "discount_pct"), ["price", "discount_pct"])
    sc = materialize(sc.select(*KEY, F.col("price").alias("x"), F.col("discount_pct").alias("y")), "dbscan_points")
    flags = dbscan_noise(sc).select("x", "y", "is_core", "is_noise")
    return materialize(sc.join(flags, ["x", "y"]).select(*KEY, "x", "y", "is_core", "is_noise"), "anomaly_points")


def _scaled(c):
    return rnd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", SCALE_DIGITS)


DBSCAN_CTES = f"""pts AS (SELECT product_id, source_store, {_scaled('price')} AS x, {_scaled('discount_pct')} AS y FROM products),
dp AS (SELECT x, y, count(*) AS n FROM pts GROUP BY x, y),
nb AS (SELECT a.x, a.y, sum(b.n) AS nb FROM dp a JOIN dp b
       ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {C.DBSCAN_EPS * C.DBSCAN_EPS}::DOUBLE GROUP BY a.x, a.y),
core AS (SELECT x, y, nb >= {C.DBSCAN_MIN_SAMPLES} AS is_core FROM nb),
flags AS (SELECT c.x, c.y, c.is_core, NOT c.is_core AND NOT EXISTS (SELECT 1 FROM core q WHERE q.is_core
          AND (c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) <= {C.DBSCAN_EPS * C.DBSCAN_EPS}::DOUBLE) AS is_noise FROM core c),
anom AS (SELECT p.product_id, p.source_store, p.x, p.y, f.is_core, f.is_noise FROM pts p JOIN flags f ON p.x = f.x AND p.y = f.y)"""


@query("dbscan_anomalies", with_products_ctes(DBSCAN_CTES + "\nSELECT * FROM anom"))
def q_dbscan_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Core / noise flags for every product (eps .8, min 5 with itself, scaled price and discount)."""
    return anomaly_points(spark, sf)


@query("eps_neighbour_join", with_products_ctes(DBSCAN_CTES + """
SELECT count(*) AS n_points, count(*) FILTER (WHERE is_core) AS n_core, count(*) FILTER (WHERE is_noise) AS n_noise,
  count(*) FILTER (WHERE NOT is_core AND NOT is_noise) AS n_border FROM anom"""))
def q_eps_neighbour_join(spark: SparkSession, sf: str) -> DataFrame:
    """Counts from the grid eps-join (core, border, noise points)."""
    a = anomaly_points(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("n_points"), F.count_if("is_core").alias("n_core"),
                 F.count_if("is_noise").alias("n_noise"),
                 F.count_if(~F.col("is_core") & ~F.col("is_noise")).alias("n_border"))


ANOMALY_COLS = ["product_id", "name", "price", "discount_pct", "price_original", "brand", "category", "source_store"]


def anomalies_table(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    a = anomaly_points(spark, sf).filter("is_noise").select(*KEY)
    return p.join(a, KEY, "left_semi").select(*ANOMALY_COLS)


@query("anomaly_summary", with_products_ctes(DBSCAN_CTES + f""",
an AS (SELECT p.* FROM products p JOIN anom a ON p.product_id = a.product_id AND p.source_store = a.source_store WHERE a.is_noise)
SELECT 'count' AS item, CAST(count(*) AS DOUBLE) AS value, NULL AS name, NULL AS source_store FROM an
UNION ALL SELECT 'avg_price', {rnd('avg(price)', 2)}, NULL, NULL FROM an
UNION ALL (SELECT 'sample', price, name, source_store FROM an ORDER BY product_id, source_store LIMIT 5)"""))
def q_anomaly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Anomaly count, their average price and five samples (first by key)."""
    an = materialize(anomalies_table(spark, sf), "anomalies")
    head = an.agg(F.count(F.lit(1)).cast("double").alias("count"), R(F.avg("price"), 2).alias("avg_price"))
    rows = head.selectExpr("stack(2, 'count', count, 'avg_price', avg_price) AS (item, value)") \
               .select("item", "value", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("source_store"))
    samples = an.orderBy("product_id", "source_store").limit(5).select(
        F.lit("sample").alias("item"), F.col("price").alias("value"), "name", "source_store")
    return rows.unionByName(samples)


def _boxes(pts: DataFrame, t: float, name: str) -> DataFrame:
    """Bounding boxes of the points of each cell in squares of side ``t``."""
    ux, uy = F.floor(F.col("x") / t).alias("ux"), F.floor(F.col("y") / t).alias("uy")
    return materialize(pts.groupBy("node", ux, uy).agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                                       F.min("y").alias("y0"), F.max("y").alias("y1")), name)


def _box_pairs(pairs: DataFrame, e2: float) -> tuple[DataFrame, DataFrame]:
    """(cell pairs that some pair of boxes links for certain, pairs of boxes that are still open)."""
    zero = F.lit(0.0)
    far_x = F.greatest(F.abs(F.col("ax1") - F.col("bx0")), F.abs(F.col("bx1") - F.col("ax0")))
    far_y = F.greatest(F.abs(F.col("ay1") - F.col("by0")), F.abs(F.col("by1") - F.col("ay0")))
    near_x = F.greatest(F.col("bx0") - F.col("ax1"), F.col("ax0") - F.col("bx1"), zero)
    near_y = F.greatest(F.col("by0") - F.col("ay1"), F.col("ay0") - F.col("by1"), zero)
    close = pairs.withColumn("_far2", far_x * far_x + far_y * far_y).filter(near_x * near_x + near_y * near_y <= F.lit(e2))
    close = materialize(close.select("src", "aux", "auy", "dst", "bux", "buy", "_far2"), "region_pairs")
    linked = close.filter(F.col("_far2") <= F.lit(e2)).select("src", "dst").distinct()
    return linked, close.filter(F.col("_far2") > F.lit(e2)).join(linked, ["src", "dst"], "left_anti").drop("_far2")


def _side(boxes: DataFrame, p: str, cell: str) -> DataFrame:
    return boxes.select(F.col("node").alias(cell), F.col("ux").alias(f"{p}ux"), F.col("uy").alias(f"{p}uy"),
                        *[F.col(c).alias(f"{p}{c}") for c in ("x0", "x1", "y0", "y1")])


def region_edges(core: DataFrame, eps: float = C.DBSCAN_EPS) -> DataFrame:
    """Links between cells holding core points: (src, dst) when some core point of one is within eps of
    some core point of the other.

    Points are summarised by the bounding boxes of squares. Two boxes within eps at their farthest link
    their cells, two farther than eps at their nearest are dropped; the rest are cut in four each and
    tested again, until every pair of cells is linked or has no open boxes. Only boxes across the
    eps-circle stay open, and a linked pair of cells stops, so no list of point pairs is built. Points
    of one place are one box, which the tests always decide.
    """
    t = eps / math.sqrt(2.0) / 2
    e2 = eps * eps
    reach = int(math.ceil(eps / t)) + 1
    node = F.concat_ws(":", F.col("_cx").cast("string"), F.col("_cy").cast("string"))
    pts = core.select("x", "y", node.alias("node"))
    boxes = _boxes(pts, t, "region_boxes")
    off = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                              for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]))
    a = _side(boxes, "a", "src").select("*", off.alias("_o"))
    a = a.select("*", (F.col("aux") + F.col("_o.dx")).alias("bux"), (F.col("auy") + F.col("_o.dy")).alias("buy")).drop("_o")
    pairs = a.join(_side(boxes, "b", "dst"), ["bux", "buy"]).filter(F.col("src") != F.col("dst"))
    linked, open_ = _box_pairs(pairs, e2)
    links = linked
    while not open_.isEmpty():
        t /= 2  # halving is exact, so a box's number halves to that of the box it is cut from
        boxes = _boxes(pts, t, "region_boxes")
        finer_a = _side(boxes, "a", "src").select("*", F.floor(F.col("aux") / 2).alias("pax"), F.floor(F.col("auy") / 2).alias("pay"))
        finer_b = _side(boxes, "b", "dst").select("*", F.floor(F.col("bux") / 2).alias("pbx"), F.floor(F.col("buy") / 2).alias("pby"))
        kept = open_.select("src", "dst", F.col("aux").alias("pax"), F.col("auy").alias("pay"), F.col("bux").alias("pbx"), F.col("buy").alias("pby"))
        pairs = kept.join(finer_a, ["src", "pax", "pay"]).join(finer_b, ["dst", "pbx", "pby"])
        linked, open_ = _box_pairs(pairs, e2)
        links = links.unionByName(linked)
    return links.distinct()


def dense_regions(points: DataFrame, eps: float = C.DBSCAN_EPS, min_samples: int = C.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """(node, label): connected components of core points (DBSCAN clusters without borders). Cells holding
    core points are nodes (a cell's points are mutual neighbours), edges come from ``region_edges``."""
    core = dbscan_core(points, "x", "y", eps, min_samples).filter("is_core")
    core = materialize(core.select("x", "y", "_cx", "_cy"), "region_core")
    cell = F.concat_ws(":", F.col("_cx").cast("string"), F.col("_cy").cast("string"))
    nodes = core.select(cell.alias("node")).distinct()
    found = components(region_edges(core, eps).select(F.col("src").alias("a"), F.col("dst").alias("b")), "region_links")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def _regions_sql() -> str:
    from ..oracle.catalog import processed_ctes

    side = repr(C.DBSCAN_EPS / math.sqrt(2.0))
    e2 = C.DBSCAN_EPS * C.DBSCAN_EPS
    # brute force: every pair of core points within eps links their cells; closure by recursion
    return "WITH RECURSIVE " + processed_ctes() + ",\n" + DBSCAN_CTES + f""",
cp AS (SELECT x, y, CAST(floor(x / {side}::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / {side}::DOUBLE) AS BIGINT) AS cy
       FROM core WHERE is_core),
cell AS (SELECT DISTINCT cx, cy FROM cp),
cedge AS (SELECT DISTINCT a.cx AS acx, a.cy AS acy, b.cx AS bcx, b.cy AS bcy FROM cp a JOIN cp b
          ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {e2}::DOUBLE),
reach(cx, cy, rx, ry) AS (SELECT cx, cy, cx, cy FROM cell
          UNION SELECT r.cx, r.cy, e.bcx, e.bcy FROM reach r JOIN cedge e ON r.rx = e.acx AND r.ry = e.acy),
lab AS (SELECT cx, cy, min(rx * 4294967296 + ry) AS label FROM reach GROUP BY cx, cy)
SELECT count(DISTINCT label) AS n_regions, CAST(count(*) AS BIGINT) AS n_core_cells FROM lab"""


@query("dbscan_regions", _regions_sql())
def q_dbscan_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Number of dense regions (DBSCAN clusters) and the core points in each."""
    pts = anomaly_points(spark, sf).select("x", "y")
    labels = dense_regions(pts)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells")) \
                 .agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n_cells").alias("n_core_cells"))


# ---------------------------------------------------------------------------------------------
# KMeans segments, PCA, silhouette
# ---------------------------------------------------------------------------------------------
K = 3
K_RANGE = [2, 3, 4, 5, 6]
N_INIT = 10
ROUNDS = 20
SEED = 42
SEGMENT_NAMES = ["budget", "mid_range", "premium"]
SILHOUETTE_SAMPLE = 1000


def clustering_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Product key, the features as columns and as a vector."""
    return cached_layer(spark, "clustering_frame", _inputs(sf), ALL_FEATURES, lambda: _clustering_frame(spark, sf))


def _clustering_frame(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    fm = feature_matrix(processed_products(spark, sf))
    fm = VectorAssembler(inputCols=ALL_FEATURES, outputCol="features").transform(fm)
    return materialize(fm.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ALL_FEATURES], "features"), "clustering_frame")


def row_key() -> F.Column:
    return F.concat_ws("|", *KEY)


def kmeans_best(spark: SparkSession, sf: str, ks: list[int] = K_RANGE) -> dict:
    """k -> its least-cost clustering over ``N_INIT`` seeds, for all of ``ks`` in the same scans."""
    return cached_layer(spark, "kmeans_runs", _inputs(sf), (ks, N_INIT, SEED, ROUNDS), lambda: lloyd(
        clustering_frame(spark, sf), row_key(), ALL_FEATURES, ks, [SEED + i for i in range(N_INIT)], ROUNDS))


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(product key, cluster_id, segment): segments named by rank of the cluster's mean price."""
    return cached_layer(spark, "clusters", _inputs(sf), (K, N_INIT, SEED, ROUNDS), lambda: _kmeans_clusters(spark, sf))


def _kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    assigned = clustering_frame(spark, sf).select(*KEY, nearest(ALL_FEATURES, kmeans_best(spark, sf, [K])[K]).alias("cluster_id"))
    p = processed_products(spark, sf)
    prof = p.join(assigned, KEY).groupBy("cluster_id").agg(F.avg("price").alias("mean_price"))
    # a row per cluster
    return materialize(assigned.join(F.broadcast(price_rank_segments(prof)), "cluster_id"), "clusters")


def price_rank_segments(profiles: DataFrame) -> DataFrame:
    """Name clusters by the rank of their mean price (ties by id); k rows, a single small window."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col("mean_price").asc(), F.col("cluster_id").asc())
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    r = F.row_number().over(w)
    return profiles.select("cluster_id", F.coalesce(F.element_at(names, r), F.concat(F.lit("segment_"), r.cast("string")))
                           .alias("segment"))


def cluster_profiles(products: DataFrame, clusters: DataFrame, by: str = "cluster_id") -> DataFrame:
    j = products.join(clusters, KEY)
    return j.groupBy(by).agg(R(F.avg("price"), 2).alias("mean_price"), R(F.avg("rating"), 2).alias("mean_rating"),
                             R(F.avg("review_count"), 2).alias("mean_reviews"),
                             R(F.avg("discount_pct"), 2).alias("mean_discount"),
                             F.count(F.lit(1)).alias("count"), R(F.avg(F.col("topk_label").cast("double")), 2).alias("topk_rate"))


# SQL of the same rounds: points, starting rows by md5, rounds as recursion, the least-cost run of each k.
_F = [f"f{i}" for i in range(len(ALL_FEATURES))]


def _features_sql() -> str:
    from .features import BOOL_FEATURES, CAT_FEATURES, NUM_FEATURES, _enc_sql, _scaled_sql

    parts = [_scaled_sql(c) for c in NUM_FEATURES] + [_enc_sql(c) for c in CAT_FEATURES] + [f"CAST({c} AS INT) AS {c}" for c in BOOL_FEATURES]
    named = ", ".join(f"CAST({c} AS DOUBLE) AS {f}, CAST(round({c} * 1000000) AS BIGINT) AS w{i}" for i, (f, c) in enumerate(zip(_F, ALL_FEATURES)))
    return f"""fm AS (SELECT product_id, source_store, {', '.join(parts)} FROM products),
points AS MATERIALIZED (SELECT product_id, source_store, product_id || '|' || source_store AS key,
  row_number() OVER (ORDER BY product_id, source_store) AS rid, {named} FROM fm)"""


def _far_sql(a: str, b: str) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in _F)


def _kmeans_sql(ks: list[int]) -> str:
    f = ", ".join(_F)
    mean = ", ".join(f"floor(CAST(sum(p.w{i}) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS {c}" for i, c in enumerate(_F))
    near = f"min({{'d': {_far_sql('p', 'l')}, 'c': l.c}}) AS m"
    return f"""{_features_sql()},
start AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY md5(key || '#' || seed), key) - 1 AS c, {f}
  FROM points, range({SEED}, {SEED + N_INIT}) s(seed) QUALIFY c < {max(ks)}),
lloyd AS (SELECT 0 AS it, k, seed, c, {f} FROM start, (SELECT unnest({ks}) AS k) WHERE c < k
  UNION ALL
  SELECT a.it + 1, a.k, a.seed, a.m.c, {mean}
  FROM (SELECT l.it, l.k, l.seed, p.rid, {near} FROM lloyd l, points p WHERE l.it < {ROUNDS} GROUP BY l.it, l.k, l.seed, p.rid) a
  JOIN points p ON p.rid = a.rid GROUP BY a.it, a.k, a.seed, a.m.c),
placed AS MATERIALIZED (SELECT l.k, l.seed, p.rid, {near} FROM lloyd l, points p WHERE l.it = {ROUNDS} GROUP BY l.k, l.seed, p.rid),
best AS (SELECT k, seed FROM (SELECT k, seed, {rnd('sum(m.d)', 3)} AS cost FROM placed GROUP BY k, seed)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, seed) = 1),
labels AS MATERIALIZED (SELECT k, rid, m.c AS c FROM placed JOIN best USING (k, seed))"""


def _silhouette_sql(ks: list[int]) -> str:
    return f"""{_kmeans_sql(ks)},
picked AS (SELECT * FROM points ORDER BY md5(key || '#{SEED}'), key LIMIT {SILHOUETTE_SAMPLE}),
pairs AS MATERIALIZED (SELECT s.rid AS sid, p.rid, sqrt({_far_sql('p', 's')}) AS d FROM picked s, points p),
sums AS (SELECT sid, k, c, sum(d) AS far, count(*) AS n FROM pairs JOIN labels USING (rid) GROUP BY sid, k, c),
ab AS (SELECT s.sid, s.k, max(s.n) FILTER (WHERE s.c = o.c) AS n, max(s.far) FILTER (WHERE s.c = o.c) AS far,
  min(s.far / s.n) FILTER (WHERE s.c <> o.c) AS b FROM sums s JOIN labels o ON o.rid = s.sid AND o.k = s.k GROUP BY s.sid, s.k),
own AS (SELECT k, CASE WHEN n > 1 AND b IS NOT NULL AND greatest(far / (n - 1), b) > 0
  THEN (b - far / (n - 1)) / greatest(far / (n - 1), b) ELSE 0 END AS s FROM ab),
sil AS (SELECT k, {rnd('avg(s)', 4)} AS silhouette,
  {rnd('coalesce(stddev_samp(s), 0) / sqrt(count(*)) * sqrt(greatest(0, 1 - count(*) / (SELECT count(*) FROM points)))', 4)} AS std_error,
  count(*) AS n_sample FROM own GROUP BY k)"""


def _whole_silhouette_sql(ks: list[int]) -> str:
    """Of all pairs of points; the distances of a point add up once for those that lie in the same clusters for every k."""
    return f"""{_kmeans_sql(ks)},
held AS (SELECT rid, list(k ORDER BY k) AS ks, list(c ORDER BY k) AS cs FROM labels GROUP BY rid),
grouped AS MATERIALIZED (SELECT ks, cs, row_number() OVER () AS g FROM (SELECT DISTINCT ks, cs FROM held)),
member AS MATERIALIZED (SELECT p.rid, g, {', '.join(f'p.{f}' for f in _F)} FROM points p JOIN held h USING (rid) JOIN grouped d ON d.cs = h.cs),
pairs AS MATERIALIZED (SELECT s.rid AS sid, p.g, sum(sqrt({_far_sql('p', 's')})) AS far, count(*) AS n FROM member s, member p GROUP BY s.rid, p.g),
sums AS (SELECT sid, k, c, sum(far) AS far, CAST(sum(n) AS DOUBLE) AS n FROM pairs JOIN (SELECT g, unnest(ks) AS k, unnest(cs) AS c FROM grouped) USING (g) GROUP BY sid, k, c),
ab AS (SELECT s.sid, s.k, max(s.n) FILTER (WHERE s.c = o.c) AS n, max(s.far) FILTER (WHERE s.c = o.c) AS far,
  min(s.far / s.n) FILTER (WHERE s.c <> o.c) AS b FROM sums s JOIN labels o ON o.rid = s.sid AND o.k = s.k GROUP BY s.sid, s.k),
own AS (SELECT k, CASE WHEN n > 1 AND b IS NOT NULL AND greatest(far / (n - 1), b) > 0
  THEN (b - far / (n - 1)) / greatest(far / (n - 1), b) ELSE 0 END AS s FROM ab),
sil AS (SELECT k, {rnd('avg(s)', 4)} AS silhouette FROM own GROUP BY k)"""


def _recursive(sql: str) -> str:
    return with_products_ctes(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("kmeans_segments", _recursive(_kmeans_sql([K]) + f""",
seg AS (SELECT l.c, [{', '.join(f"'{n}'" for n in SEGMENT_NAMES)}][CAST(row_number() OVER (ORDER BY avg(p.price), l.c) AS INT)] AS segment
  FROM labels l JOIN points USING (rid) JOIN products p ON p.product_id = points.product_id AND p.source_store = points.source_store GROUP BY l.c)
SELECT product_id, source_store, CAST(l.c AS INT) AS cluster_id, segment FROM labels l JOIN points USING (rid) JOIN seg ON seg.c = l.c"""))
def q_kmeans_segments(spark: SparkSession, sf: str) -> DataFrame:
    """KMeans K=3 (10 seeds, least cost) on the feature matrix; clusters named budget / mid_range / premium."""
    return kmeans_clusters(spark, sf)


# The join and profile jobs work on any cluster table. Their queries take a deterministic one, the nearest
# of three fixed price centroids, so that SQL can follow them; KMeans has its own query.
FIXED_CENTROIDS = (100.0, 400.0, 900.0)


def nearest_centroid(products: DataFrame, centroids=FIXED_CENTROIDS) -> DataFrame:
    """(product key, cluster_id, segment): the nearest centroid by price, the first of equally near ones."""
    far = [F.abs(F.col("price") - F.lit(c)) for c in centroids]
    least = F.least(*far)
    nearest = F.coalesce(*[F.when(d == least, F.lit(i)) for i, d in enumerate(far)])
    assigned = products.select(*KEY, "price", nearest.alias("cluster_id"))
    # a row per centroid
    named = price_rank_segments(assigned.groupBy("cluster_id").agg(F.avg("price").alias("mean_price")))
    return assigned.select(*KEY, "cluster_id").join(F.broadcast(named), "cluster_id").select(*KEY, "cluster_id", "segment")


def _fixed_ctes() -> str:
    d = [f"abs(price - {c}::DOUBLE)" for c in FIXED_CENTROIDS]
    names = "[" + ", ".join(f"'{n}'" for n in SEGMENT_NAMES) + "]"
    return f"""fc AS (SELECT product_id, source_store, price, CASE WHEN {d[0]} <= least({d[1]}, {d[2]}) THEN 0
  WHEN {d[1]} <= {d[2]} THEN 1 ELSE 2 END AS cluster_id FROM products),
seg AS (SELECT cluster_id, {names}[CAST(row_number() OVER (ORDER BY avg(price), cluster_id) AS INT)] AS segment FROM fc GROUP BY cluster_id),
cl AS (SELECT fc.product_id, fc.source_store, fc.cluster_id, seg.segment FROM fc JOIN seg ON fc.cluster_id = seg.cluster_id)"""


def join_clusters(products: DataFrame, clusters: DataFrame, anomalies: DataFrame) -> DataFrame:
    """products left-join (segment, is_anomaly) on the full product key."""
    c = clusters.select(*KEY, "segment").join(anomalies.select(*KEY, F.col("is_noise").cast("int").alias("is_anomaly")),
                                              KEY, "left")
    return products.join(c, KEY, "left")


def _means(cols) -> str:
    return ", ".join(f"{rnd(f'avg({e})', n)} AS {name}" for e, n, name in cols)


PROFILE_MEANS = _means([("price", 2, "mean_price"), ("rating", 2, "mean_rating"), ("review_count", 2, "mean_reviews"),
                        ("discount_pct", 2, "mean_discount")])
J = "p.product_id = c.product_id AND p.source_store = c.source_store"


@query("cluster_profiles", with_products_ctes(_fixed_ctes() + f"""
SELECT c.cluster_id, c.segment, {PROFILE_MEANS.replace('avg(price)', 'avg(p.price)')}, count(*) AS count,
  {rnd('avg(topk_label::DOUBLE)', 2)} AS topk_rate FROM products p JOIN cl c ON {J} GROUP BY c.cluster_id, c.segment"""))
def q_cluster_profiles(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    c = nearest_centroid(p)
    return cluster_profiles(p, c).join(F.broadcast(c.select("cluster_id", "segment").distinct()), "cluster_id")


@query("price_rank_segments", with_products_ctes(_fixed_ctes() + "\nSELECT cluster_id, segment FROM seg"))
def q_price_rank_segments(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_centroid(processed_products(spark, sf)).select("cluster_id", "segment").distinct()


@query("join_clusters", with_products_ctes(DBSCAN_CTES + ",\n" + _fixed_ctes() + f"""
SELECT p.product_id, p.source_store, p.popularity_score, c.segment, CAST(a.is_noise AS INT) AS is_anomaly
FROM products p LEFT JOIN cl c ON {J}
LEFT JOIN anom a ON p.product_id = a.product_id AND p.source_store = a.source_store"""))
def q_join_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    return join_clusters(p, nearest_centroid(p), anomaly_points(spark, sf)).select(
        *KEY, "popularity_score", "segment", "is_anomaly")


def _rate(x: str) -> str:
    return rnd(f"{rnd(f'avg({x}::DOUBLE)', 2)} * 100.0::DOUBLE", 1)


@query("join_cluster_profile", with_products_ctes(_fixed_ctes() + f"""
SELECT c.segment, count(p.product_id) AS count, {_means([('p.price', 2, 'avg_price'), ('rating', 2, 'avg_rating'), ('review_count', 2, 'avg_reviews')])},
  {_rate('topk_label')} AS topk_rate_pct, {_rate('CAST(is_on_promo AS INT)')} AS on_promo_rate_pct
FROM products p LEFT JOIN cl c ON {J} GROUP BY c.segment"""))
def q_join_cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Segment summary: products left-joined to their segment, then grouped (rates in %)."""
    p = processed_products(spark, sf)
    j = p.join(nearest_centroid(p).select(*KEY, "segment"), KEY, "left")
    return j.groupBy("segment").agg(
        F.count("product_id").alias("count"), R(F.avg("price"), 2).alias("avg_price"), R(F.avg("rating"), 2).alias("avg_rating"),
        R(F.avg("review_count"), 2).alias("avg_reviews"),
        R(R(F.avg(F.col("topk_label").cast("double")), 2) * F.lit(100.0), 1).alias("topk_rate_pct"),
        R(R(F.avg(F.col("is_on_promo").cast("double")), 2) * F.lit(100.0), 1).alias("on_promo_rate_pct"))


def _segment_summary_sql() -> str:
    from .preprocess_queries import TOPK_SQL

    return with_products_ctes(_fixed_ctes() + f""",
t AS ({TOPK_SQL})
SELECT c.segment, count(*) AS count, {_means([('p.price', 2, 'avg_price'), ('p.rating', 2, 'avg_rating')])},
  {rnd('avg(CAST(p.is_on_promo AS INT)::DOUBLE) * 100.0::DOUBLE', 1)} AS on_promo_pct
FROM t p LEFT JOIN cl c ON {J} GROUP BY c.segment""")


@query("segment_summary", _segment_summary_sql())
def q_segment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per segment of the top-k table: count, averages, top-k and promo rates in %."""
    from .preprocess_queries import topk_products

    p = processed_products(spark, sf)
    t = topk_products(p).join(nearest_centroid(p).select(*KEY, "segment"), KEY, "left")
    return t.groupBy("segment").agg(F.count(F.lit(1)).alias("count"), R(F.avg("price"), 2).alias("avg_price"),
                                    R(F.avg("rating"), 2).alias("avg_rating"),
                                    R(F.avg(F.col("is_on_promo").cast("double")) * F.lit(100.0), 1).alias("on_promo_pct"))


def silhouettes_of(spark: SparkSession, sf: str, ks: list[int] = K_RANGE) -> dict[int, tuple[float, float, int]]:
    """k -> (Euclidean silhouette of its clustering, standard error, sampled rows), for all of ``ks`` in one scan."""
    def measure():
        best = kmeans_best(spark, sf, ks)
        frame = clustering_frame(spark, sf)
        labelled = frame.select(*KEY, *ALL_FEATURES, *[nearest(ALL_FEATURES, c).alias(f"k{k}") for k, c in best.items()])
        labelled = materialize(labelled, "silhouette-labels")  # read twice: for the sample and for all rows
        found = silhouettes(labelled, row_key(), ALL_FEATURES, [f"k{k}" for k in best], SILHOUETTE_SAMPLE, SEED)
        digits = lambda v: math.floor(v * 10000 + 0.5) / 10000
        return {k: (digits(found[f"k{k}"][0]), digits(found[f"k{k}"][1]), found[f"k{k}"][2]) for k in best}

    return cached_layer(spark, "silhouettes", _inputs(sf), (ks, N_INIT, SEED, ROUNDS, SILHOUETTE_SAMPLE), measure)


@query("silhouette", _recursive(_silhouette_sql([K]) + "\nSELECT CAST(k AS INT) AS k, silhouette, std_error, CAST(n_sample AS INT) AS n_sample FROM sil"))
def q_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Mean Euclidean silhouette of the K=3 segments, with its standard error over the sampled rows."""
    return spark.createDataFrame([(K, *silhouettes_of(spark, sf, [K])[K])], "k int, silhouette double, std_error double, n_sample int")


def whole_silhouettes_of(spark: SparkSession, sf: str, ks: list[int] = K_RANGE) -> dict[int, float]:
    """k -> Euclidean silhouette of all rows under its clustering."""
    def measure():
        best = kmeans_best(spark, sf, ks)
        frame = clustering_frame(spark, sf)
        labelled = frame.select(*ALL_FEATURES, *[nearest(ALL_FEATURES, c).alias(f"k{k}") for k, c in best.items()])
        found = whole_silhouettes(labelled, ALL_FEATURES, [f"k{k}" for k in best])
        return {k: math.floor(found[f"k{k}"] * 10000 + 0.5) / 10000 for k in best}

    return cached_layer(spark, "whole_silhouettes", _inputs(sf), (ks, N_INIT, SEED, ROUNDS), measure)


@query("k_selection", _recursive(_whole_silhouette_sql(K_RANGE) + """
SELECT CAST(k AS INT) AS k, silhouette, k = (SELECT k FROM sil ORDER BY silhouette DESC, k LIMIT 1) AS is_best FROM sil"""))
def q_k_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette of all rows for K = 2..6 and the best K by it (K = 3 is used regardless)."""
    rows = whole_silhouettes_of(spark, sf)
    best = max(sorted(rows), key=lambda k: rows[k])
    return spark.createDataFrame([(k, rows[k], k == best) for k in sorted(rows)], "k int, silhouette double, is_best boolean")


def pca_2d(frame: DataFrame, cols: list[str] = ALL_FEATURES) -> tuple[DataFrame, list[float]]:
    """Centred PCA to 2 components, sign fixed so each component's largest loading is positive,
    explained-variance ratios against the total variance."""
    means, loadings, variances, total = principal_components(frame, cols)
    out = frame
    for i, loading in enumerate(loadings):
        out = out.withColumn(f"PC{i + 1}", R(projected(cols, means, loading), 4))
    return out, [round(v / total, 4) if total else 0.0 for v in variances] + [round(total, 4)]


def _pca_sql() -> str:
    """The same matrix, squared as often, as lists."""
    d = len(_F)
    at = lambda m, i, j: f"{m}[({i}) * {d} + ({j}) + 1]"
    cov = ", ".join(rnd(f"covar_samp({_F[min(i, j)]}, {_F[max(i, j)]})", 6) for i in range(d) for j in range(d))
    means = ", ".join(rnd(f"avg({f})", 9) for f in _F)
    size = "sqrt(list_sum(list_transform(m, lambda v: v * v)))"
    product = f"list_sum(list_transform(range({d}), lambda k: {at('m', f'x // {d}', 'k')} / {size} * ({at('m', 'k', f'x % {d}')} / {size})))"
    diagonal = f"list_transform(range({d}), lambda i: {at('m', 'i', 'i')})"
    column = f"list_transform(range({d}), lambda i: {at('m', 'i', 'top - 1')})"
    largest = "col[list_position(list_transform(col, lambda v: abs(v)), list_max(list_transform(col, lambda v: abs(v))))]"
    value = f"list_sum(list_transform(range({d * d}), lambda x: v[x // {d} + 1] * c[x + 1] * v[x % {d} + 1]))"

    def component(n: int, source: str) -> str:
        return f"""sq{n} AS (SELECT 0 AS it, c AS m FROM {source}
  UNION ALL SELECT it + 1, list_transform(range({d * d}), lambda x: {product}) FROM sq{n} WHERE it < {SQUARINGS}),
col{n} AS (SELECT {column} AS col FROM (SELECT m, list_position({diagonal}, list_max({diagonal})) AS top FROM sq{n} WHERE it = {SQUARINGS})),
vec{n} AS (SELECT c, list_transform(col, lambda v: v / sqrt(list_sum(list_transform(col, lambda y: y * y))) * sign({largest})) AS v FROM col{n}, {source}),
pc{n} AS (SELECT v, {value} AS value, list_transform(range({d * d}), lambda x: c[x + 1] - {value} * v[x // {d} + 1] * v[x % {d} + 1]) AS c,
  list_transform(v, lambda y: floor(y * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE) AS w FROM vec{n})"""

    along = lambda n: rnd(" + ".join(f"({f} - mu[{i + 1}]) * pc{n}.w[{i + 1}]" for i, f in enumerate(_F)), 4)
    share = lambda n: f"round(pc{n}.value / list_sum(list_transform(range({d}), lambda i: {at('cov.c', 'i', 'i')})), 4)"
    return f"""{_features_sql()},
cov AS MATERIALIZED (SELECT [{cov}] AS c, [{means}] AS mu FROM points),
{component(1, 'cov')},
{component(2, 'pc1')},
coords AS (SELECT product_id, source_store, {along(1)} AS PC1, {along(2)} AS PC2, {share(1)} AS explained_1, {share(2)} AS explained_2
  FROM points, cov, pc1, pc2)"""


@query("pca_2d", _recursive(_pca_sql() + "\nSELECT * FROM coords"))
def q_pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates on the first two components, with the share of variance that each explains."""
    frame = clustering_frame(spark, sf)
    out, ratios = pca_2d(frame)
    return out.select(*KEY, "PC1", "PC2", F.lit(ratios[0]).alias("explained_1"), F.lit(ratios[1]).alias("explained_2"))


@query("align_predictions", _recursive(_pca_sql() + ",\n" + DBSCAN_CTES + ",\n" + _fixed_ctes() + f"""
SELECT p.product_id, p.source_store, x.PC1, x.PC2, c.cluster_id, c.segment, CAST(a.is_noise AS INT) AS is_anomaly,
  p.name, p.price, p.rating, p.topk_label, p.category
FROM products p JOIN coords x ON p.product_id = x.product_id AND p.source_store = x.source_store
JOIN cl c ON {J} JOIN anom a ON p.product_id = a.product_id AND p.source_store = a.source_store"""))
def q_align_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PCA coordinates, cluster, segment, anomaly flag and product attributes, joined on the product key."""
    out, _ = pca_2d(clustering_frame(spark, sf))
    c = nearest_centroid(processed_products(spark, sf))
    a = anomaly_points(spark, sf).select(*KEY, F.col("is_noise").cast("int").alias("is_anomaly"))
    p = processed_products(spark, sf).select(*KEY, "name", "price", "rating", "topk_label", "category")
    return out.select(*KEY, "PC1", "PC2").join(c, KEY).join(a, KEY).join(p, KEY)
