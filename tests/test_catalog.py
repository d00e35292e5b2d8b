"""The catalog built from narrow offers: the rows of the plain join, nothing wide before keep-first, no row shuffled for its rank."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vitrine.operators.ranking import rank_min
from vitrine.plans import preprocess as P
from vitrine.sources.adapters import raw_products


def _tables(folder):
    """Lines of 12 parts and 9 suppliers: repeated offers, missing prices, parts, suppliers and nations, parts and
    suppliers that come twice."""
    lines = [{"l_orderkey": i * 7 % 400, "l_partkey": None if i % 41 == 0 else i % 13, "l_suppkey": None if i % 43 == 0 else i * 5 % 11,
              "l_linenumber": i % 5, "l_quantity": float(1 + i % 9), "l_extendedprice": 1000.0 + i * 37 % 900, "l_discount": i % 10 / 100,
              "l_returnflag": "NAR"[i % 3], "l_linestatus": "OF"[i % 2], "l_shipdate": datetime.datetime(1995, 1, 1 + i % 28)} for i in range(400)]
    parts = [{"p_partkey": i, "p_name": f"part {i % 7}" if i != 3 else None, "p_type": f"TYPE {i % 3}", "p_brand": f"Brand#{i % 2}"} for i in [*range(12), 5, 5]]
    suppliers = [{"s_suppkey": i, "s_nationkey": i if i != 4 else 99} for i in [*range(9), 2]]
    nations = [{"n_nationkey": i, "n_name": f"NATION {i}"} for i in range(10)]
    for name, rows in (("lineitem", lines), ("part", parts), ("supplier", suppliers), ("nation", nations)):
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return _tables(tmp_path_factory.mktemp("catalog"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_offers_give_the_rows_of_the_plain_join(spark, folder):
    from vitrine.sources.adapters import described

    plain = P.dedup_products(P.filter_valid_price(raw_products(spark, folder)))
    found = described(P.kept_offers(spark, folder))
    assert _rows(found.select(*plain.columns)) == _rows(plain) and plain.count() > 20


def test_keep_first_sends_no_text(spark, folder):
    plan = P.kept_offers(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "shop_country" not in plan


def test_simple_dedup_keeps_rows_of_parts_that_are_there(spark, folder):
    from vitrine.operators.dedup import dedup_keep_first
    from vitrine.plans.preprocess_queries import q_dedup_simple
    from vitrine.sources.adapters import SEQ_COLS

    plain = P.filter_valid_price(dedup_keep_first(raw_products(spark, folder), ["product_id"], SEQ_COLS))
    found = q_dedup_simple(spark, folder)
    assert _rows(found) == _rows(plain.select(*found.columns))


def test_rank_joins_without_a_shuffle_of_the_rows(spark):
    df = spark.createDataFrame([(i, i % 7 if i % 10 else None) for i in range(100)], "id int, v int").repartition(3)
    ranked = rank_min(df, "v", "r")
    assert "BroadcastHashJoin" in ranked._jdf.queryExecution().executedPlan().toString()
    values = sorted((r.v for r in ranked.collect() if r.v is not None), reverse=True)
    assert all(r.r == (None if r.v is None else 1 + values.index(r.v)) for r in ranked.collect()) and ranked.count() == 100


def test_texts_are_joined_last(spark):
    from vitrine.plans.bi import apply_enrichment

    products = spark.createDataFrame([("a", "s", "old a"), ("b", "s", "old b"), ("c", "s", "old c"), ("d", "s", None)], "product_id string, source_store string, description string")
    numbers = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3)], "product_id string, source_store string, doc_id long")
    texts = spark.createDataFrame([(1, "new"), (2, None), (9, "other"), (1, "again")], "doc_id long, text string")
    out = apply_enrichment(products, numbers, texts)
    got = _rows(out.select("product_id", "description_enriched", "is_enriched"))
    assert got == [("a", "again", True), ("a", "new", True), ("b", "old b", False), ("c", "old c", False), ("d", None, False)]
    plain = apply_enrichment(products, numbers.join(texts, "doc_id").drop("doc_id"))
    assert _rows(plain.select("product_id", "description_enriched", "is_enriched")) == got
    # equal texts lie together in the result: the rows come sorted by number from a merge join
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_keep_first_sends_narrow_lines(spark, folder):
    """No key, price or rating is made before the last keep-first, and no nation is joined."""
    plan = P.kept_offers(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(grouped) == 3 and "product_id" in plan
    assert not any(c in line for c in ("product_id", "source_store", "price_original", "rating", "n_name") for line in grouped)


def test_repeated_lines_keep_the_least_by_their_columns(spark, tmp_path):
    """Lines of one key that differ in quantity, discount and flags alone: the row of the plain join, which compares prices first."""
    line = {"l_orderkey": 8, "l_partkey": 1, "l_suppkey": 2, "l_linenumber": 1, "l_quantity": 4.0, "l_extendedprice": 1000.0, "l_discount": 0.1,
            "l_returnflag": "A", "l_linestatus": "O", "l_shipdate": datetime.datetime(1995, 1, 1)}
    changes = [{"l_quantity": 3.0}, {"l_quantity": 4.0001, "l_returnflag": "N"}, {"l_discount": 0.0}, {"l_returnflag": None}, {"l_linestatus": None},
               {"l_orderkey": None, "l_returnflag": "N"}, {"l_orderkey": None, "l_linenumber": None}, {"l_partkey": 2, "l_quantity": 2.5}, {}]
    pq.write_table(pa.Table.from_pylist([{**line, **c} for c in changes]), f"{tmp_path}/lineitem.parquet")
    pq.write_table(pa.Table.from_pylist([{"p_partkey": i, "p_name": f"part {i}", "p_type": "T", "p_brand": "B"} for i in (1, 2)]), f"{tmp_path}/part.parquet")
    pq.write_table(pa.Table.from_pylist([{"s_suppkey": 2, "s_nationkey": 1}]), f"{tmp_path}/supplier.parquet")
    pq.write_table(pa.Table.from_pylist([{"n_nationkey": 1, "n_name": "N"}]), f"{tmp_path}/nation.parquet")
    from vitrine.sources.adapters import described

    plain = P.dedup_products(P.filter_valid_price(raw_products(spark, str(tmp_path))))
    assert _rows(described(P.kept_offers(spark, str(tmp_path))).select(*plain.columns)) == _rows(plain)


def test_store_item_sets_build_no_list_per_product(spark, monkeypatch):
    from vitrine.plans import bi

    rows = [("p", f"s{i % 2}", [None, "b", "a", "b"][i % 4]) for i in range(40)] + [("q", "s0", None)]
    monkeypatch.setattr(bi, "processed_products", lambda *a: spark.createDataFrame(rows, "source_platform string, source_store string, category string"))
    out = bi.q_store_item_sets(spark, "")
    assert _rows(out) == [("p", "s0", ["a"], 1), ("p", "s1", ["b"], 1), ("q", "s0", [], 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "collect_set" not in plan
