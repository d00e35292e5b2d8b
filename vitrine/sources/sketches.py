"""Distinct counts that are stored, by group and batch, and merged for any selection.

Each batch of a table with a manifest adds one row a group: its row count and an HLL sketch for each column. Sketches become
visible by the same manifest entry as the batch's rows, so both always tell of the same rows. A selection of groups merges
its sketches and reads no rows. Once ``fan`` files are live they are merged into one.

Estimates: with ``lg`` = 12 a sketch has 4096 registers (4 KB) and a standard error of about 1.6 %; up to a few
hundred distinct values it holds the values' hashes and the estimate is the count. For exact numbers see
``operators.dedup.distinct_values``.

Defined cases: nulls aren't counted, an empty string is a value; a null group is a group; no rows, or a selection without groups, give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commits import CommitLog

LG = 12


class DistinctSketches:
    """Sketches of ``columns`` by the columns ``by``, kept in the table of ``log``."""

    def __init__(self, log: CommitLog, columns: list[str], by: list[str], lg: int = LG, kind: str = "sketches", fan: int = 16):
        self.log, self.columns, self.by, self.lg, self.kind, self.fan = log, list(columns), list(by), lg, kind, fan

    def _merged(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
            F.sum("_n").alias("_n"), *[F.hll_union_agg(f"_s{i}").alias(f"_s{i}") for i in range(len(self.columns))])

    def _store(self, sketches: DataFrame) -> list[dict]:
        folder = self.log.new_folder(self.kind)
        sketches.coalesce(1).write.parquet(f"{self.log.root}/{folder}")  # a row a group
        return [{"path": p, "kind": self.kind} for p in self.log.files_under(folder)]

    def write(self, rows: DataFrame) -> list[dict]:
        """Sketch a batch's rows; returns what to commit with them."""
        # a sketch passes over empty strings, so every value gets a mark in front
        each = [F.hll_sketch_agg(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), self.lg).alias(f"_s{i}") for i, c in enumerate(self.columns)]
        return self._store(rows.groupBy(*[F.col(f"`{b}`") for b in self.by]).agg(F.count(F.lit(1)).alias("_n"), *each))

    def _read(self, files: list[str]) -> DataFrame:
        return self.log.spark.read.parquet(*[f"{self.log.root}/{p}" for p in files])

    def compact(self) -> None:
        """One file for ``fan`` and more; a crash in between leaves the table as it was."""
        old = sorted(self.log.live(self.kind))
        if len(old) >= self.fan:
            self.log.commit(self._store(self._merged(self._read(old), self.by)), old)

    def counts(self, by: list[str] = (), where: Column | None = None) -> DataFrame:
        """``by`` (some of the sketched groups' columns), n_rows and n_<column> for each column: rows exactly, distinct
        values as estimated, over the groups that ``where`` selects. Without ``by`` always one row."""
        files = sorted(self.log.live(self.kind))
        if not files:
            names = ", ".join(f"0L AS {n}" for n in ["n_rows", *[f"`n_{c}`" for c in self.columns]])
            return self.log.spark.sql(f"SELECT {', '.join([*[f'CAST(NULL AS STRING) AS `{b}`' for b in by], names])}").limit(0 if by else 1)
        rows = self._read(files)
        merged = self._merged(rows if where is None else rows.where(where), list(by))
        none = F.lit(0).cast("long")
        return merged.select(*[F.col(f"`{b}`") for b in by], F.coalesce("_n", none).alias("n_rows"), *[
            F.coalesce(F.hll_sketch_estimate(f"_s{i}"), none).alias(f"n_{c}") for i, c in enumerate(self.columns)])
