"""Search that doesn't scan: posting lists of character trigrams, written with a table.

The table's rows are written once more, numbered by block and place. A posting list holds, for one trigram and one
block, the places of the block's rows that contain it in any searched column (lower-cased); the values of key columns
have lists as well. Lists lie in folders by the CRC of their token. A search reads the folders of its term's
trigrams, intersects lists block by block, opens the row folders that hold a candidate and verifies the text there.
Trigrams only select: the result is that of the plain scan. A term of fewer than three characters has no trigram and
is scanned for.

Defined cases: a null text holds nothing; an empty term is in every text that isn't null; equal rows all come
back; an empty table finds nothing; columns may have any name.

Scale: a list has at most ``block`` places, so a trigram that is in every row is many lists, not one group. Numbers are taken
from the rows as they were written, so lists built after a lost executor still fit. The driver sees folder numbers
(at most ``SHARDS``).
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import text_search
from ..session import materialize

#: Rows a block, thus places a list.
BLOCK = 1 << 15
#: Folders of posting lists and of rows.
PARTS = 64
SHARDS = 64
GRAM = 3


def grams_of(term: str) -> list[str]:
    """Distinct trigrams (of code points) of a lower-cased term."""
    return sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})


def _grams(text: Column) -> Column:
    # one pass over the text: an array of its characters, then three neighbours each
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    return F.transform(F.array(chars), lambda c: F.transform(
        F.slice(c, 1, F.greatest(F.size(c) - (GRAM - 1), F.lit(0))),
        lambda x, i: F.concat(x, *[F.get(c, i + j) for j in range(1, GRAM)])))[0]


def key_token(column: str, value) -> str:
    """Token of a whole value: longer than a trigram, so it equals none."""
    return f"\x00{column}\x00={value}"


def _part(token: str, parts: int) -> int:
    return zlib.crc32(token.encode()) % parts


class SearchIndex:
    """An index under ``root`` of a table with ``schema``; ``build`` writes one."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, columns: list[str], keys: list[str] = (), parts: int = PARTS):
        self.spark, self.root, self.schema, self.columns, self.keys, self.parts = spark, root, schema, list(columns), list(keys), parts

    @classmethod
    def build(cls, df: DataFrame, root: str, columns: list[str], keys: list[str] = (), block: int = BLOCK,
              parts: int = PARTS, shards: int = SHARDS) -> SearchIndex:
        n, task = F.monotonically_increasing_id(), F.spark_partition_id()
        place = n.bitwiseAND(F.lit((1 << 33) - 1))
        numbered = df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
            # a task has 2^33 rows at most, so its block numbers never meet the next task's
            (F.shiftright(n, 33) * (1 << 33) + F.floor(place / block)).alias("block"), (place % block).cast("int").alias("place"),
            F.pmod(task, F.lit(shards)).alias("shard"))
        numbered.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{root}/rows")
        out = cls(df.sparkSession, root, df.schema, columns, keys, parts)
        field = lambda c: F.col("row").getField(c)
        texts = [F.coalesce(_grams(field(c).cast("string")), F.array().cast("array<string>")) for c in columns]
        values = [F.concat(F.lit(key_token(k, "")), field(k).cast("string")) for k in keys]
        tokens = F.filter(F.array_distinct(F.concat(*texts, F.array(*values).cast("array<string>"))), lambda x: x.isNotNull())
        lists = out.rows().select("shard", "block", "place", F.explode(tokens).alias("token")).groupBy("token", "shard", "block").agg(F.collect_list("place").alias("places"))
        lists = lists.withColumn("part", F.pmod(F.crc32(F.encode("token", "UTF-8")), F.lit(parts)).cast("int"))
        # a task holds whole lists, of tokens by hash: a file a task and folder, sorted, without a second shuffle
        lists.sortWithinPartitions("part", "token", "block") \
             .write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{root}/lists")
        return out

    def rows(self) -> DataFrame:
        schema = StructType().add("row", self.schema).add("block", "long").add("place", "integer").add("shard", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def lists(self, tokens: list[str]) -> DataFrame:
        """Posting lists of the tokens; only their folders are read."""
        read = self.spark.read.schema("token string, shard int, block long, places array<int>, part int").parquet(f"{self.root}/lists")
        return read.where(F.col("part").isin(sorted({_part(t, self.parts) for t in tokens})) & F.col("token").isin(tokens))

    def candidates(self, tokens: list[str]) -> DataFrame:
        """(shard, block, place) of the rows that hold all tokens."""
        by_size = F.array_sort(F.collect_list(F.struct(F.size("places").alias("n"), "places")))
        blocks = self.lists(tokens).groupBy("shard", "block").agg(by_size.alias("found")).where(F.size("found") == len(tokens))
        first, rest = F.col("found")[0]["places"], F.slice("found", 2, max(len(tokens) - 1, 1))
        both = F.aggregate(rest, first, lambda a, x: F.array_intersect(a, x["places"]))
        return blocks.select("shard", "block", F.explode(both).alias("place"))

    def _opened(self, tokens: list[str]) -> DataFrame:
        found = materialize(self.candidates(tokens), "search-candidates")
        shards = [r.shard for r in found.select("shard").distinct().collect()]
        rows = self.rows().where(F.col("shard").isin(shards)) if shards else self.rows().limit(0)
        return rows.join(found.select("block", "place"), ["block", "place"], "left_semi")

    def search(self, term: str) -> DataFrame:
        """Rows that hold ``term`` in any searched column, case-insensitively: those of ``text_search``."""
        tokens = grams_of(term.lower())
        rows = self._opened(tokens) if tokens else self.rows()
        hit = text_search(term, *[F.col("row").getField(c) for c in self.columns])
        return rows.where(hit).select("row.*")

    def lookup(self, column: str, value) -> DataFrame:
        """Rows whose key column equals ``value`` (none for None)."""
        if column not in self.keys:
            raise ValueError(f"{column} is no key of this index")
        if value is None:
            return self.rows().limit(0).select("row.*")
        return self._opened([key_token(column, value)]).where(F.col("row").getField(column) == F.lit(value)).select("row.*")
