"""vitrine: product-catalog analytics as Spark DataFrame / SQL / ML / Structured Streaming jobs.

Layout
------
- ``sources``   table readers, adapter views, layered read/write, payload landing
- ``functions`` pure ``Column -> Column`` helpers (text cleaning, rounding, hash-seeded draws)
- ``operators`` DataFrame -> DataFrame building blocks (dedup, ranking, quality, rules, clustering)
- ``plans``     composed jobs (preprocessing, BI aggregates, reports, models, routing)
- ``streaming`` Structured Streaming ingest and dedup
- ``oracle``    DuckDB SQL text used to check the Spark results
"""

__version__ = "0.1.0"
