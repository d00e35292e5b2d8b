"""Which keys a table holds, without reading the table.

Keys lie in hash buckets. Every write adds a file for each bucket that it touches, and a Bloom filter for each such
file. A look-up reads the filters, then only the files that may hold one of its keys, and compares whole keys.
Once a bucket has ``fan`` files of one level they become one of the next, so a bucket keeps under ``fan`` files a
level and a key is rewritten once a level. Files become visible through the table's manifest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.commits import CommitLog

#: Bits a key and probes a key of a Bloom filter: about one false hit in a thousand.
BITS = 16
PROBES = 6


def _bits_of(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers, a row per key, from two hashes; ``size`` is a power of two."""
    step = np.arange(PROBES, dtype=np.uint64)
    return (a.view(np.uint64)[:, None] + step * (b.view(np.uint64)[:, None] | np.uint64(1))) & np.uint64(size - 1)


def bloom(a: np.ndarray, b: np.ndarray) -> bytes:
    size = 64
    while size < BITS * len(a):
        size *= 2
    bits = np.zeros(size, dtype=np.uint8)
    bits[_bits_of(a, b, size).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filter_: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filter_, dtype=np.uint8)
    at = _bits_of(a, b, len(data) * 8).astype(np.int64)
    return ((data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class KeyIndex:
    """Index of ``keys`` (column names) in a table with a manifest. ``buckets`` is fixed for a table's life: a bucket's
    keys are merged in one task, so some ten million keys a bucket are fit."""

    def __init__(self, log: CommitLog, keys: list[str], name: str = "keys", buckets: int = 16, fan: int = 4):
        self.log, self.keys, self.name, self.buckets, self.fan = log, keys, name, buckets, fan
        #: Files that the last look-up opened.
        self.opened: list[str] = []

    def _hashed(self, df: DataFrame) -> DataFrame:
        a = F.xxhash64(*self.keys)
        return df.select(*self.keys, a.alias("_a"), F.xxhash64(*self.keys, F.lit(1)).alias("_b"), F.pmod(a, F.lit(self.buckets)).cast("int").alias("bucket"))

    def _read(self, files: list[str]) -> DataFrame:
        spark = self.log.spark
        return spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.log.root}/{p}" for p in files])

    def held(self, batch: DataFrame) -> DataFrame | None:
        """Distinct keys of ``batch`` that the index holds; None if it holds nothing that could match."""
        self.opened = []
        live = self.log.live(self.name)
        if not live:
            return None
        spark = self.log.spark
        units = spark.createDataFrame(sorted({(f["unit"], f["bucket"]) for f in live.values()}), "unit string, bucket int")
        filters = self._read(sorted({p for f in live.values() for p in f["filters"]})).select("unit", "bucket", "bits").join(F.broadcast(units), ["unit", "bucket"], "left_semi")
        wanted = self._hashed(batch.select(*self.keys).distinct())

        def test(keys, filters_):
            a, b = (keys.column(n).to_numpy().astype(np.int64) for n in ("_a", "_b"))
            parts = []
            for unit, bits in zip(filters_.column("unit").to_pylist(), filters_.column("bits").to_pylist()):
                hit = keys.filter(pa.array(may_hold(bits, a, b)))
                parts.append(hit.append_column("unit", pa.array([unit] * len(hit), pa.string())))
            none = keys.slice(0, 0).append_column("unit", pa.array([], pa.string()))
            return pa.concat_tables([none, *parts])

        found = wanted.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, wanted.withColumn("unit", F.lit("")).schema)
        hits = materialize(found, f"{self.name}-hits")
        met = {(r.unit, r.bucket) for r in hits.select("unit", "bucket").distinct().collect()}  # no more than live files
        self.opened = sorted(p for p, f in live.items() if (f["unit"], f["bucket"]) in met)
        if not self.opened:
            return None
        candidates, rows = hits.select(*self.keys).distinct().alias("c"), self._read(self.opened).select(*self.keys).alias("r")
        same = [F.col(f"c.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in self.keys]
        return candidates.join(rows, same, "left_semi")

    def write(self, keys: DataFrame, level: int = 0) -> list[dict]:
        """Write new keys, distinct and not yet held, as files of ``level``; returns what to commit of them."""
        folder = self.log.new_folder(self.name)
        unit = folder.rsplit("/", 1)[1]
        rows = self._hashed(keys).repartition(self.buckets, "bucket")
        rows.withColumn("of", F.col("bucket")).write.partitionBy("of").parquet(f"{self.log.root}/{folder}/rows")

        def build(key, table):
            bits = bloom(*(table.column(n).to_numpy().astype(np.int64) for n in ("_a", "_b")))
            return pa.table({"unit": pa.array([unit], pa.string()), "bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

        written = self.log.files_under(f"{folder}/rows")
        if not written:
            return []
        hashes = self._read(written).select("bucket", "_a", "_b")
        hashes.groupBy("bucket").applyInArrow(build, "unit string, bucket int, bits binary").coalesce(1).write.parquet(f"{self.log.root}/{folder}/filters")
        filters = self.log.files_under(f"{folder}/filters")
        bucket = lambda p: int(p.rsplit("of=", 1)[1].split("/")[0])
        return [{"path": p, "kind": self.name, "unit": unit, "bucket": bucket(p), "level": level, "filters": filters} for p in written]

    def compact(self) -> None:
        """Merge files until no bucket has ``fan`` units of a level. A crash in between leaves the table as it was."""
        while True:
            groups: dict[tuple[int, int], dict[str, dict]] = {}
            for path, f in self.log.live(self.name).items():
                groups.setdefault((f["level"], f["bucket"]), {})[path] = f
            full = {k: g for k, g in groups.items() if len({f["unit"] for f in g.values()}) >= self.fan}
            if not full:
                return
            level = min(k[0] for k in full)
            old = sorted(p for k, g in full.items() if k[0] == level for p in g)
            self.log.commit(self.write(self._read(old), level + 1), old)
