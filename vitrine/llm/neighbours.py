"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, searched until a
chi-square test holds.

Every vector is projected to ``DIMENSIONS`` Gaussian directions. For two vectors at distance ``d`` the squared
projected distance over ``d**2`` follows a chi-square law, so a neighbour at most as far as the k-th one found
so far, ``d_k``, lies within ``d_k * sqrt(quantile(SURE))`` of the query's projection with probability ``SURE``
or more. A search therefore takes points by increasing projected distance, computes their true distances
(verifies them), and stops when the next projected distance exceeds that radius, which shrinks with ``d_k``.
Recall is thus ``SURE`` or more in expectation, for whatever data; ``SURE`` near 1 verifies nearly all.

The kd-tree has two parts. Its top, median cuts of the widest projected direction, is fitted on the
``SAMPLE`` vectors of least hash and deals every vector to one of ``MAX_CELLS`` cells at most; a cell of more
than ``BLOCK`` vectors is dealt on to blocks by hash. A block goes on cutting down to leaves of ``LEAF`` points and
is stored as one row, its points in leaf order. Queries first search the block ``HOME`` of their own cell,
which bounds ``d_k``; then those cells whose box the radius reaches, each block with each pack of queries.

Vectors that are equal are one point with its smallest ids: beyond the ``k + 1`` smallest none can be among
any query's nearest, its own row left out. A vector is searched once however many queries hold it.

Defined cases: rows whose id or vector is null, and vectors that are empty, zero or hold a null or non-finite
component take no part, as query or candidate; nor do those of another length than the most frequent one (the
shortest of such); repeated rows count once; two vectors under one id are two rows, and as queries
two with the same id, each of which can find the other; ties go to the smaller id; with fewer than ``k`` others all
are returned; an empty table gives no rows. Other columns are not read.

Scale: vectors are shuffled twice (equal ones together, blocks). Blocks and packs are bounded rows, so a unit of
search is bounded; the boxes of at most ``MAX_CELLS`` cells are what tasks get to route queries. How many
cells a query reaches depends on the data: few where they lie near a low-dimensional shape, most of them for
vectors with 64 independent components, as no index of this kind escapes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.runtime import materialize, parallelism

DIMENSIONS = 12
SURE = 0.97
SEED = 20
SAMPLE = 16_384
MAX_CELLS = 1_024
BLOCK = 4_096
LEAF = 64
PACK = 1_024
HOME = 0


def chi_square_quantile(p: float, k: int) -> float:
    """``x`` below which a chi-square variable with ``k`` degrees of freedom falls with probability ``p``."""

    def below(x: float) -> float:
        a, half = k / 2, x / 2
        term = total = 1 / a
        i = 0
        while term > 1e-17 * total:
            i += 1
            term *= half / (a + i)
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    lo, hi = 1e-12, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, dimensions))


def kd_order(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Point numbers by leaf of a kd-tree of median cuts along the widest direction."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        part = stack.pop()
        own = points[part]
        width = np.ptp(own, axis=0) if len(part) else np.zeros(1)
        if len(part) <= leaf or not width.max() > 0:
            out.append(part)
            continue
        half = len(part) // 2
        by = np.argpartition(own[:, width.argmax()], half)
        stack += [part[by[half:]], part[by[:half]]]
    return out


class Cells:
    """Top of the kd-tree: inner nodes as arrays in heap order, their leaves as cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(1 << depth, dtype=np.int64)
        self.at = np.zeros(1 << depth)
        parts = {1: np.arange(len(points))}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part):
                own = points[part]
                self.axis[node] = np.ptp(own, axis=0).argmax()
                self.at[node] = np.median(own[:, self.axis[node]])
            right = points[part, self.axis[node]] > self.at[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


def _gap(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of a point to boxes."""
    out = np.maximum(lo - q, 0) + np.maximum(q - hi, 0)
    return np.einsum("ij,ij->i", out, out)


class Block:
    """A stored block: points in leaf order with their vectors, projections and ids."""

    def __init__(self, row: dict, length: int, dimensions: int):
        self.vec = np.frombuffer(row["vec"]).reshape(-1, length)
        self.proj = np.frombuffer(row["proj"]).reshape(-1, dimensions)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.id_at = np.frombuffer(row["id_at"], dtype=np.int64)
        self.leaf_at = np.frombuffer(row["leaf_at"], dtype=np.int64)
        self.lo = np.minimum.reduceat(self.proj, self.leaf_at[:-1], axis=0)
        self.hi = np.maximum.reduceat(self.proj, self.leaf_at[:-1], axis=0)

    def search(self, vec: np.ndarray, proj: np.ndarray, wanted: int, limit: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, ids) of the nearest ``wanted`` found that are within ``limit`` (squared).

        Leaves are opened by the distance of their box, in steps that double; points are verified once no
        unopened leaf can hold a nearer projection.
        """
        near = _gap(self.lo, self.hi, proj)
        order = np.argsort(near, kind="stable")
        best, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        wait_at, wait_by = np.zeros(0, dtype=np.int64), np.zeros(0)
        opened, step = 0, 1
        while True:
            radius = limit * factor
            take = order[opened : opened + step]
            take = take[near[take] <= radius]
            if len(take):
                opened, step = opened + len(take), 2 * step
                at = np.concatenate([np.arange(self.leaf_at[x], self.leaf_at[x + 1]) for x in take])
                away = self.proj[at] - proj
                wait_at, wait_by = np.append(wait_at, at), np.append(wait_by, np.einsum("ij,ij->i", away, away))
            frontier = near[order[opened]] if opened < len(order) else math.inf
            now = wait_by <= min(frontier, radius)
            at, wait_at, wait_by = wait_at[now], wait_at[~now], wait_by[~now]
            if len(at):
                away = self.vec[at] - vec
                d = np.einsum("ij,ij->i", away, away)
                at, d = at[d <= limit], d[d <= limit]
                n = self.id_at[at + 1] - self.id_at[at]
                own = np.concatenate([self.ids[self.id_at[x] : self.id_at[x + 1]] for x in at]) if len(at) else ids[:0]
                best, ids = np.append(best, np.repeat(d, n)), np.append(ids, own)
                by = np.lexsort((ids, best))[:wanted]
                best, ids = best[by], ids[by]
                if len(best) == wanted:
                    limit = min(limit, float(best[-1]))
            radius = limit * factor
            if frontier > radius and not (wait_by <= radius).any() or frontier == math.inf and not len(wait_by):
                return best, ids


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _valid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))


def nearest(table: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row for whose id ``is_query`` (a
    function of a column) holds."""
    spark = table.sparkSession
    valid = _valid(table, id_col, vector_col)
    usual = valid.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    length, wanted = usual.length, k + 1
    valid = valid.where(F.size("vec") == length)
    toward, factor = directions(length, dimensions), chi_square_quantile(sure, dimensions)

    # equal vectors are one point with the ids that can matter
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    points = valid.withColumn("place", place).where(F.col("place") <= wanted).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def project(batch_iter):
        for b in batch_iter:
            proj = _rows(b.column(0), length) @ toward
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(proj) + 1) * dimensions, pa.int32()), pa.array(proj.ravel()))
            yield pa.record_batch([b.column(0), b.column(1), lists], names=["vec", "ids", "proj"])

    points = materialize(points.mapInArrow(project, "vec array<double>, ids array<long>, proj array<double>").withColumn("hash", F.xxhash64("vec")), "ann-points")
    count = points.count()
    depth = min(math.ceil(math.log2(max(count / BLOCK, 1))), int(math.log2(MAX_CELLS)))
    fitted = points.orderBy("hash", "ids").select("proj").limit(SAMPLE).collect() if depth else []
    cells = Cells(np.array([r.proj for r in fitted]).reshape(-1, dimensions), depth)

    def deal(batch_iter):
        for b in batch_iter:
            cell = cells.of(_rows(b.column("proj"), dimensions)) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    dealt = points.mapInArrow(deal, "vec array<double>, ids array<long>, proj array<double>, hash long, cell int")
    blocks = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # MAX_CELLS rows

    def store(key, rows):
        proj, vec = _rows(rows.column("proj").combine_chunks(), dimensions), _rows(rows.column("vec").combine_chunks(), length)
        leaves = kd_order(proj, LEAF)
        by = np.concatenate(leaves)
        ids = rows.column("ids").to_pylist()
        ids = [ids[i] for i in by]
        at = lambda parts: np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        flat = np.array([x for own in ids for x in own], dtype=np.int64)
        binary = [x.tobytes() for x in (np.ascontiguousarray(vec[by]), np.ascontiguousarray(proj[by]), flat, at(ids), at(leaves))]
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
            **{n: pa.array([x], pa.binary()) for n, x in zip(("vec", "proj", "ids", "id_at", "leaf_at"), binary)},
            "lo": pa.array([proj.min(axis=0).tolist()], pa.list_(pa.float64())), "hi": pa.array([proj.max(axis=0).tolist()], pa.list_(pa.float64())),
        })

    kinds = "cell int, block int, vec binary, proj binary, ids binary, id_at binary, leaf_at binary, lo array<double>, hi array<double>"
    spread = dealt.join(blocks, "cell").withColumn("block", F.pmod("hash", "blocks").cast("int")).drop("blocks", "hash")
    index = materialize(spread.groupBy("cell", "block").applyInArrow(store, kinds), "ann-index", codec="none")
    box = [F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(dimensions)] + [F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(dimensions)]
    reach = index.groupBy("cell").agg(F.collect_set("block").alias("held"), *box).orderBy("cell").collect()  # MAX_CELLS rows
    numbers = [r.cell for r in reach]
    held = [sorted(r.held) for r in reach]
    lo = np.array([[r[f"lo{i}"] for i in range(dimensions)] for r in reach])
    hi = np.array([[r[f"hi{i}"] for i in range(dimensions)] for r in reach])
    first = {c: own[0] for c, own in zip(numbers, held)}
    tasks = max(parallelism(spark), min(10_000, sum(map(len, held))))

    asked = valid.where(is_query(F.col("id")))
    asked_points = materialize(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "ann-queries")

    packed = "cell int, block int, pack int, query binary, vec binary, limits binary"

    def pack(rows: dict[tuple[int, int], list], n_pack: list[int]):
        """Full packs leave as rows; ``rows`` holds (query, vec, limit) by unit."""
        out = []
        for (cell, block), own in rows.items():
            for i in range(0, len(own), PACK):
                part = own[i : i + PACK]
                n_pack[0] += 1
                out.append((cell, block, n_pack[0], np.array([x[0] for x in part], dtype=np.int64).tobytes(), np.array([x[1] for x in part]).tobytes(), np.array([x[2] for x in part], dtype=np.float64).tobytes()))
        rows.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["cell", "block", "pack", "query", "vec", "limits"])

    def to_home(batch_iter):
        n_pack = [0]
        for b in batch_iter:
            vec = _rows(b.column(0), length)
            if not len(vec):
                continue
            own = cells.of(vec @ toward)
            rows: dict[tuple[int, int], list] = {}
            for q, v, c in zip(b.column(1).to_pylist(), vec, own.tolist()):
                rows.setdefault((c, first.get(c, HOME)), []).append((q, v, math.inf))
            yield pack(rows, n_pack)

    def onward(batch_iter):
        """Queries with the bound of their home block, to all other blocks that the radius reaches."""
        n_pack = [0]
        for b in batch_iter:
            vec, limit = _rows(b.column("vec"), length), b.column("limit").to_numpy(zero_copy_only=False)
            if not len(vec):
                continue
            proj = vec @ toward
            own = cells.of(proj)
            rows: dict[tuple[int, int], list] = {}
            for i, q in enumerate(b.column("query").to_pylist()):
                for c in np.flatnonzero(_gap(lo, hi, proj[i]) <= limit[i] * factor):
                    for block in held[c]:
                        if numbers[c] != own[i] or block != first[numbers[c]]:
                            rows.setdefault((numbers[c], block), []).append((q, vec[i], limit[i]))
            if rows:
                yield pack(rows, n_pack)

    def searched(batch_iter):
        for b in batch_iter:
            for row in b.to_pylist():
                block = Block({n: row[f"b_{n}"] for n in ("vec", "proj", "ids", "id_at", "leaf_at")}, length, dimensions)
                vec, out = np.frombuffer(row["vec"]).reshape(-1, length), []
                for q, v, limit in zip(np.frombuffer(row["query"], dtype=np.int64).tolist(), vec, np.frombuffer(row["limits"]).tolist()):
                    d, ids = block.search(v, v @ toward, wanted, limit, factor)
                    # a home search tells its bound also when it has fewer than the wanted points
                    out.append((q, d.tolist(), ids.tolist()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["query", "d", "ids"])

    stored = index.select("cell", "block", *[F.col(n).alias(f"b_{n}") for n in ("vec", "proj", "ids", "id_at", "leaf_at")])

    def units(packs: DataFrame, blocks_: DataFrame) -> DataFrame:
        """Each pack of queries with its block, searched."""
        met = blocks_.repartition(tasks, "cell", "block").join(packs.repartition(tasks, "cell", "block"), ["cell", "block"])
        return met.mapInArrow(searched, "query long, d array<double>, ids array<long>")

    home = materialize(units(asked_points.select("vec", "query").mapInArrow(to_home, packed), stored), "ann-home")
    bound = home.select("query", F.when(F.size("d") >= wanted, F.element_at("d", -1)).otherwise(F.lit(math.inf)).alias("limit"))
    known = asked_points.join(bound, "query").select("vec", "query", "limit")
    other = units(known.mapInArrow(onward, packed), stored)
    found = home.unionByName(other).select("query", F.explode(F.arrays_zip("d", "ids")).alias("x")).select("query", F.col("x.d").alias("d"), F.col("x.ids").alias("id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    best = found.distinct().withColumn("nth", nth).where(F.col("nth") <= wanted)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("best"))
    answers = materialize(asked_points.join(best, "query").select("vec", "best"), "ann-answers")
    others = F.slice(F.filter("best", lambda x: (x["id"] != F.col("id")) | (x["d"] > 0)), 1, k)
    rows = asked.distinct().join(answers, "vec").select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.sqrt("x.d").alias("score"))
