"""Searches by posting lists give the rows of the plain scan and read only what they need."""

import tempfile

import pytest
from pyspark.sql import functions as F

from vitrine.functions.text import text_search
from vitrine.sources.searchindex import SearchIndex, _part, grams_of

TEXTS = ["Steel Bolt", "bolt", "BOLTED joint", "bo lt", "Bol", "b.lt", "Übergröße", "übergrößen", "a\nb\nc", "😀😀😀x", "x" * 5000 + "bolt", "", None, "tolb", "abcabcabd"]
TERMS = ["bolt", "BOLT", "Steel B", "b.l", "größe", "a\nb", "😀😀😀", "😀😀x", "abcabd", "xxxb", "zzz", "bo", "b", "", "%", "lt "]


def root():
    return tempfile.mkdtemp(prefix="vitrine-index-", dir="/tmp") + "/index"


def table(spark, times=1):
    rows = [(f"id-{i % 20}", t, u, i) for i, (t, u) in enumerate([(t, u) for t in TEXTS for u in TEXTS[::4]] * times)]
    return spark.createDataFrame(rows, "id string, `a.b` string, block string, n int").repartition(5)


@pytest.fixture(scope="module")
def indexed(spark):
    df = table(spark)
    return df, SearchIndex.build(df, root(), ["a.b", "block"], ["id"], block=7, parts=16, shards=4)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_the_scan(indexed, term):
    df, index = indexed
    got = index.search(term)
    assert got.columns == df.columns
    assert rows_of(got) == rows_of(df.where(text_search(term, "`a.b`", "block")))


def test_lists_are_bounded_and_only_the_folders_of_the_term_are_read(indexed):
    _, index = indexed
    lists = index.spark.read.parquet(f"{index.root}/lists")
    assert lists.select(F.max(F.size("places"))).first()[0] <= 7
    tokens = grams_of("bolt")
    read = index.lists(tokens)
    files = {r[0] for r in read.select(F.col("_metadata.file_path")).distinct().collect()}
    assert files and all(any(f"part={_part(t, 16)}/" in f for t in tokens) for f in files)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(token" in plan


def test_rows_are_opened_by_shard(spark):
    df = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("part number "), F.col("id").cast("string")).alias("name"))
    index = SearchIndex.build(df, root(), ["name"], block=100, shards=8)
    found = index.search("number 3999")
    assert [r.name for r in found.collect()] == ["part number 3999"]
    assert "shard#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert index.candidates(grams_of("number 3999")).select("shard").distinct().count() == 1


def test_lookup_of_whole_values(indexed):
    df, index = indexed
    for value in ("id-1", "id-19", "id-", "id", "none"):
        assert rows_of(index.lookup("id", value)) == rows_of(df.where(F.col("id") == value))
    assert index.lookup("id", None).count() == 0
    with pytest.raises(ValueError):
        index.lookup("n", 1)


def test_empty_table(spark):
    index = SearchIndex.build(table(spark).limit(0), root(), ["a.b"], ["id"])
    assert index.search("bolt").count() == index.search("b").count() == index.lookup("id", "x").count() == 0
