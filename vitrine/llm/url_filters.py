"""URL filters: dated list entries become validity intervals; each capture meets those of its fetch day.

An entry is (list, pattern, action, day): ``add`` opens, ``remove`` closes a validity interval [from, to). On one
day ``add`` beats ``remove``, repeats change nothing. A pattern without a slash is a host and covers its
subdomains; one with a slash is a host and a path prefix and ends at a path segment. Case does not count in
either part, nor do doubled slashes or one at the end (``host/`` is the host). The as-of join
looks up the host suffixes and path prefixes of a capture and keeps those of whose intervals one holds
its fetch day.

Defined cases: a null, empty or schemeless URL has no host and matches nothing; entries with a null in
any column are no entries; a null fetch day matches nothing; rows repeated in the captures come out
repeated; an empty list or table gives unblocked or no rows; extra columns are ignored by ``evaluate``.

Scale: entries fold by map-side sums to one row per pattern and day and then to one row per pattern, whose
interval array is bounded by the days of the calendar; a capture's keys (no more than its longest
pattern can have) join that one row, so a hot host is split by adaptive execution and nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")


def normal(pattern: Column) -> Column:
    """The form in which patterns and keys meet: small letters, single slashes, none at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(pattern, "/+", "/"), "/$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): when each pattern is on each list; valid_to null = still."""
    daily = entries.where("list is not null and pattern is not null and action in ('add', 'remove') and day is not null")
    daily = daily.groupBy("list", normal(F.col("pattern")).alias("pattern"), "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("on", 1, 0).over(w)).where(F.col("on") != F.col("before"))
    return changes.withColumn("valid_to", F.lead("day").over(w)).where("on = 1").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def _keys(url: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to ``labels`` labels and path prefixes of up to ``depth`` segments."""
    parts = F.split(host(url), "\\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda k: F.when(k <= n, F.array_join(F.slice(parts, n - k + 1, k), ".")))
    path = F.slice(segments(url), 1, depth) if depth else F.array().cast("array<string>")
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda k: F.when(k <= F.size(path), normal(F.concat(host(url), F.lit("/"), F.array_join(F.slice(path, 1, k), "/")))))
    return F.when(host(url) != "", F.array_distinct(F.filter(F.concat(suffixes, prefixes), lambda x: x.isNotNull() & (x != "")))).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """id, fetch_day, blocked, lists (sorted names), patterns (sorted) of every capture."""
    valid = intervals(entries)
    by_pattern = valid.groupBy("pattern").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans"))
    shape = valid.agg(F.max(F.size(F.split(F.split("pattern", "/")[0], "\\."))), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    labels, depth = shape[0] or 1, shape[1] or 0
    seen = captures.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.col(f"`{day_col}`").cast("date").alias("fetch_day"))
    # equal rows are one capture here and are counted back below
    seen = seen.groupBy("id", "url", "fetch_day").agg(F.count("*").alias("copies"))
    keyed = seen.select("id", "url", "fetch_day", "copies", F.explode_outer(_keys(F.col("url"), labels, depth)).alias("pattern"))
    day = F.col("fetch_day")
    active = F.filter("spans", lambda s: (s["valid_from"] <= day) & (s["valid_to"].isNull() | (day < s["valid_to"])))
    met = keyed.join(by_pattern, "pattern", "left").select("id", "url", "fetch_day", "copies", "pattern", F.coalesce(F.transform(active, lambda s: s["list"]), F.array().cast("array<string>")).alias("hit"))
    found = met.groupBy("id", "url", "fetch_day", "copies").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("lists"),
        F.sort_array(F.collect_set(F.when(F.size("hit") > 0, F.col("pattern")))).alias("patterns"),
    )
    out = found.select(F.col("id").alias(id_col), "fetch_day", (F.size("lists") > 0).alias("blocked"), "lists", "patterns", F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("c"))
    return out.select(id_col, "fetch_day", "blocked", "lists", "patterns", F.explode("c").alias("c")).drop("c")


# The tables have neither lists nor fetch times: both are derived from the pages, by the same rules in
# Spark and in SQL. ``n`` is the first four hex digits of the MD5 of a pattern.

START = "DATE '2024-01-01'"
DAYS = 366


def _number(pattern: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(pattern).cast("binary")), 1, 4), 16, 10).cast("int")


def derived_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, fetch_day."""
    return pages.select("page_id", "url", F.expr(f"date_add({START}, cast(page_id * 37 % {DAYS} as int))").alias("fetch_day"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """list, pattern, action, day: a host in four is listed, half of these leave after 60 days and half of
    these come back after 120; a parent domain in eight and a first path segment in four are listed."""
    p = pages.where("url is not null").select(host(F.col("url")).alias("host"), segments(F.col("url")).alias("seg")).where("host <> ''")
    hosts = p.select(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), F.lit(4).alias("m"))
    domains = p.where("instr(host, '.') > 0").select(F.lit("domains"), F.expr("substring(host, instr(host, '.') + 1)"), F.lit(8))
    paths = p.where("size(seg) > 0").select(F.lit("paths"), F.expr("concat(host, '/', lower(seg[0]))"), F.lit(4))
    listed = hosts.union(domains).union(paths).distinct().withColumn("n", _number("pattern")).where("n % m = 0")

    def after(days: int) -> Column:
        return F.expr(f"date_add({START}, n % {DAYS} + {days})")

    added = listed.select("list", "pattern", F.lit("add").alias("action"), after(0).alias("day"))
    removed = listed.where("n % (2 * m) = 0").select("list", "pattern", F.lit("remove"), after(60))
    back = listed.where("n % (4 * m) = 0").select("list", "pattern", F.lit("add"), after(120))
    return added.union(removed).union(back)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetch_day
  FROM pages
), listed AS (
  SELECT DISTINCT list, pattern, m, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS n FROM (
    SELECT 'hosts' AS list, host AS pattern, 4 AS m FROM p WHERE host <> ''
    UNION ALL SELECT 'domains', substr(host, instr(host, '.') + 1), 8 FROM p WHERE instr(host, '.') > 0
    UNION ALL SELECT 'paths', host || '/' || lower(seg[1]), 4 FROM p WHERE host <> '' AND len(seg) > 0
  )
), spans AS (
  SELECT list, pattern, DATE '2024-01-01' + n % 366 AS a, CASE WHEN n % (2 * m) = 0 THEN DATE '2024-01-01' + (n % 366 + 60) END AS b
  FROM listed WHERE n % m = 0
  UNION ALL SELECT list, pattern, DATE '2024-01-01' + (n % 366 + 120), NULL FROM listed WHERE n % (4 * m) = 0
), keys AS (
  SELECT page_id, fetch_day, array_to_string(string_split(host, '.')[k:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p WHERE host <> '')
  UNION SELECT page_id, fetch_day, host || '/' || seg[1] FROM p WHERE host <> '' AND len(seg) > 0
), hits AS (
  SELECT page_id, list, pattern FROM keys JOIN spans USING (pattern) WHERE a <= fetch_day AND (b IS NULL OR fetch_day < b)
)
SELECT p.page_id, p.fetch_day, count(h.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists,
       coalesce(string_agg(DISTINCT h.pattern, ',' ORDER BY h.pattern), '') AS patterns
FROM p LEFT JOIN hits h USING (page_id) GROUP BY 1, 2
"""
