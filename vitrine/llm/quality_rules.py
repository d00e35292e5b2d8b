"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, DataFrame functions only.

Every text is scored by the multinomial log-likelihood ratio of its hashed word 1- and 2-grams between
a trusted target corpus and the raw corpus, divided by the number of n-grams; a document is kept when
it passes the base rules and its ratio reaches a fixed threshold. No draw, sample or rank is involved,
so a document's verdict depends on the two corpora and its own text alone.

Defined cases: a null text counts as an empty one (all counts 0, rejected by the base rules); a text
with fewer than five words has no window; the same rows given twice give the same verdict twice (the
corpus counts see both); an empty corpus gives an empty result; without trusted documents every ratio
is 0 and the base rules decide alone. Extra columns of the input are ignored by ``score`` and kept by
``keep`` whatever their names are.

Scale: two scans of the texts; the only shuffles are the n-gram counts (``buckets`` rows after
map-side sums), one row per document (repeated rows meet there) and, beyond ``BROADCAST_ROWS`` trusted ids, the join
that finds the trusted texts. A text's n-grams stay an array: each looks its bucket up in one array of ``buckets``
weights, so the scoring pass makes no row per n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import free_name, let, materialize

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 16
#: Pseudo-counts that draw each bucket's ratio towards 1 (rare n-grams say little).
SMOOTHING = 8.0
#: Least length-normalised ratio (nats per n-gram) of a kept document.
THRESHOLD = -0.12
#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Trusted ids are broadcast up to this many (8 bytes each), beyond it joined by a shuffle.
BROADCAST_ROWS = 2_000_000

WHITE = "\t\n\x0b\x0c\r "


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]"), F.split(F.btrim(text, F.lit(WHITE)), "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _word_chars(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def grams(w: Column, k: int) -> Column:
    """Hashes of the ``k``-word windows of a word array."""
    # the hash of several values is that of an array of them; so no array is cut out for each window
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))


def _covered(hashes: Column) -> Column:
    """Number of words in 5-word windows whose hash occurs twice or more among ``hashes``."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(F.get(p, i + 1) - x, F.lit(5))).otherwise(5))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(pairs, positions), total)


def _repeat_words(w: Column) -> Column:
    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))

    return let(grams(w, 5), count)


def _gram_hashes(w: Column) -> Column:
    return F.concat(F.transform(w, lambda x: F.xxhash64(x)), grams(w, 2))


def _bucket(buckets: int) -> Column:
    return F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, t, r): n-grams of the trusted and of all texts, summed map-side before the shuffle."""
    grams_of = texts.select("t", words(F.col("text")).alias("w")).select("t", F.explode(let(F.col("w"), _gram_hashes)).alias("h")).select("t", _bucket(buckets))
    return grams_of.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("r"))


def weights(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, w): the log ratio of each bucket, ``buckets`` rows at most (those that occur).

    ``trusted_ids`` has one column of ids. Both multinomials are counted over whole corpora.
    """
    texts = _texts(docs, id_col, text_col)
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct().withColumn("t", F.lit(1).cast("long"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = texts.join(ids, "doc_id", "left").select("text", F.coalesce("t", F.lit(0).cast("long")).alias("t"))
    both = materialize(_counts(marked, buckets), "ngram-counts")
    sums = both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    n_t, n_r = sums.select("t").scalar(), sums.select("r").scalar()

    expected = F.col("r") * n_t / n_r
    return both.select("bucket", F.when(n_t == 0, F.lit(0.0)).otherwise(F.log((F.col("t") + smoothing) / (expected + smoothing))).alias("w"))


def weight_array(table: DataFrame, buckets: int = BUCKETS) -> Column:
    """The log ratios of buckets 0, 1, 2... as one constant array; a bucket that never occurs has 0. ``buckets`` numbers
    pass through the driver, as many as ever; they travel as text, which the optimizer folds to an array once."""
    w = [0.0] * buckets
    for r in table.collect():
        w[r.bucket] = r.w
    return F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")


def _ratio(hashes: Column, table: Column, buckets: int) -> Column:
    """Mean weight of the n-grams, summed in their order; 0 without any."""
    total = F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))
    return total / F.greatest(F.size(hashes), F.lit(1))


def score(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    A row repeated with the same id and text comes out once. The weights are a constant: ``buckets`` numbers.
    """
    table = weight_array(weights(docs, trusted_ids, id_col, text_col, buckets), buckets)
    text = F.col("text")
    counted = _texts(docs, id_col, text_col).select(
        "doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"), _word_chars(text).alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), _dup_lines(text).alias("n_dup_lines"),
    )
    scored = counted.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        let(F.col("w"), _repeat_words).alias("n_repeat_words"), let(let(F.col("w"), _gram_hashes), lambda h: _ratio(h, table, buckets)).alias("ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    once = scored.dropDuplicates(["doc_id", "text_hash"])
    return once.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good."""
    return labels.where("quality = 1").select("doc_id")


def keep(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept. The few rejected ids are the other side
    of an anti-join; ids are unique in a document table (a repeated id is kept or dropped as a whole when
    any of its rows is rejected; a null id is always kept)."""
    name = free_name(docs, "__rejected")
    rejected = materialize(score(docs, trusted_ids, **options).where(~F.col("kept")).select(F.col("doc_id").alias(name)), "rejected").distinct()
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, docs[options.get("id_col", "doc_id")] == F.col(name), "left_anti")
