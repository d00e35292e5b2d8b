"""One query per training-data operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import chat_format, decontamination, importance, licence_scan, line_dedup, merkle, neighbours, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, url_filters
from vitrine.llm.runtime import materialize, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_quality_rules")
def _op1(table):
    """Base counts, ratio and verdict of every document."""
    return quality_rules.score(table("documents"), quality_rules.trusted(table("labels")))


@query("op8_ngram_jaccard")
def _op8(table):
    """Shingle-set size and component of every document."""
    return ngram_join.near_duplicates(table("documents"))


@query("op2_quality_classifier")
def _op2(table):
    """Quality score of every document."""
    return quality_classifier.classify(table("documents"), table("labels"))


@query("op3_url_filters", url_filters.SQL)
def _op3(table):
    """Verdict of every page capture by the lists valid on its fetch day."""
    pages = table("pages")
    found = url_filters.evaluate(url_filters.derived_captures(pages), url_filters.derived_entries(pages))
    return found.select("page_id", "fetch_day", "blocked", F.array_join("lists", ",").alias("lists"), F.array_join("patterns", ",").alias("patterns"))


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), r AS (
  SELECT doc_id, p, line AS l1, lead(line) OVER d AS l2, lead(line, 2) OVER d AS l3
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), f AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, p) AS place
  FROM r WHERE l3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM f, (VALUES (0), (1), (2)) AS v(k) WHERE place > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN w USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p
  WHERE g.p IS NULL GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1) g USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""


@query("op4_line_dedup", LINES_SQL)
def _op4(table):
    """Lines, deleted lines and hash of what is kept of every document."""
    found = line_dedup.dedup(table("documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_substring_dedup")
def _op5(table):
    """Word counts and hash of what is kept of every document."""
    found = substring_dedup.dedup(table("documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_chat_format")
def _op6(table):
    """Role and canonical message of every turn found in every transcript."""
    lines = materialize(chat_format.derived_transcripts(table("conversations")), "transcripts")
    scores = chat_format.fit(chat_format.labelled(lines.where(~chat_format.held_out(F.col("conv_id")))))
    return chat_format.render(chat_format.decode(lines, scores))


@query("op7_best_fit_packing")
def _op7(table):
    """Place of every piece of every document."""
    return packing.pack_documents(table("documents"))


@query("op9_licence_scan", licence_scan.oracle())
def _op9(table):
    """Licence sentences and licences of every document, as comma lists."""
    found = licence_scan.scan(table("documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


@query("op10_decontamination")
def _op10(table):
    """Benchmark items found in every document."""
    return decontamination.report(table("documents"), table("benchmark"))


#: CRC-32 in SQL: the table of one byte's remainders, and the register taken over a list of bytes.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text expression's UTF-8 bytes, where ``crc_table`` is joined."""
    data = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of ternary trees, each as a list of nodes."""
    return f"""{name} AS (
  {leaves}
  UNION ALL
  SELECT g, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(list_slice(nodes, 3 * i + 1, 3 * i + 3), '')))
  FROM {name} WHERE len(nodes) > 1)"""


def _steps_sql(tree: str, of: str, at: str, first: int) -> str:
    index = f"(f.{at} // CAST(pow(3, t.level) AS BIGINT))"
    run = f"3 * ({index} // 3)"
    return f"""SELECT f.g, f.place, {first} + t.level AS step, array_to_string(list_slice(t.nodes, {run} + 1, {index}), '') AS l,
         array_to_string(list_slice(t.nodes, {index} + 2, {run} + 3), '') AS r
  FROM {of} f JOIN {tree} t ON {"f.g IS NOT DISTINCT FROM t.g AND " if tree == "tree" else ""}len(t.nodes) > 1"""


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, hashed AS (
  SELECT doc_id, source AS g, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS other
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
), {_tree_sql("tree", "SELECT g, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY g")},
subroots AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS nth FROM tree WHERE len(nodes) = 1
), {_tree_sql("top", "SELECT CAST(NULL AS VARCHAR) AS g, 0 AS level, list(subroot ORDER BY nth) AS nodes FROM subroots")},
placed AS (
  SELECT l.*, s.subroot, s.nth FROM leaves l JOIN subroots s ON l.g IS NOT DISTINCT FROM s.g
), steps AS (
  {_steps_sql("tree", "placed", "place", 0)}
  UNION ALL
  {_steps_sql("top", "placed", "nth", 1000)}
), proofs AS (
  SELECT g, place, string_agg(l || r, '' ORDER BY step) AS proof, list(l || '.' || r ORDER BY step) AS runs FROM steps GROUP BY g, place
)
SELECT p.doc_id, p.leaf, p.subroot, x.nodes[1] AS root, sha256(coalesce(f.proof, '')) AS proof_sha256,
       list_reduce(list_prepend(p.other, coalesce(f.runs, [])), lambda a, e: sha256(split_part(e, '.', 1) || a || split_part(e, '.', 2))) AS folded_root,
       list_reduce(list_prepend(p.other, coalesce(f.runs, [])), lambda a, e: sha256(split_part(e, '.', 1) || a || split_part(e, '.', 2))) = x.nodes[1] AS verified,
       CAST(list_sum(list_transform(range(30), lambda j: p.place // CAST(pow(3, j) AS BIGINT))) AS BIGINT) AS position
FROM placed p LEFT JOIN proofs f ON p.g IS NOT DISTINCT FROM f.g AND p.place = f.place, top x WHERE len(x.nodes) = 1
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def _op11(table):
    """Leaf, subroot, root, proof and its verdict on the tampered row of every document."""
    return merkle.verify(table("documents"), tampered=merkle.without_line_feeds())


@query("op12_nearest_neighbours")
def _op12(table):
    """Ten nearest vectors found for every hundredth one."""
    return neighbours.nearest(table("embeddings"), lambda vec_id: vec_id % 100 == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features_sql(table: str, key: str) -> str:
    words = f"SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return f"SELECT id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM ({words})"


IMPORTANCE_SQL = f"""
WITH {CRC_TABLE_SQL}, d AS ({_features_sql("documents", "doc_id")}), b AS ({_features_sql("benchmark", "item_id")}),
df AS (SELECT id, feature, count(*) AS n FROM (SELECT id, unnest(f) AS feature FROM d) GROUP BY 1, 2),
bf AS (SELECT feature, count(*) AS n FROM (SELECT unnest(f) AS feature FROM b) GROUP BY 1),
known AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT feature FROM df UNION SELECT feature FROM bf), crc_table),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN known USING (feature) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN known USING (feature) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST((SELECT sum(n) FROM s) AS DOUBLE) + 10000)
    / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (coalesce(CAST((SELECT sum(n) FROM t) AS DOUBLE), 0) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), w AS (SELECT id, sum(n * gain) AS total, sum(n) AS n FROM df JOIN known USING (feature) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT d.id AS doc_id, d.n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(w.total AS DOUBLE) / w.n), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (id)
), placed AS (
  SELECT *, weight + noise AS score, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM placed
"""


@query("op13_importance_resampling", IMPORTANCE_SQL)
def _op13(table):
    """Feature count, weight, score and rank of every document."""
    return importance.resample(table("documents"), table("benchmark"))
