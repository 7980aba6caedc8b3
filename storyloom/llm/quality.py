"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Two multinomials over hashed words and word pairs are counted: one over the documents labelled as good (the trusted
target), one over the whole corpus. A document's score is the mean over its words and word pairs of the log of the two
likelihoods' ratio; every document is held against one fixed threshold, so equal texts get equal verdicts and nothing
is drawn at random.

All of it is column expressions. The counts are aggregated on the map side into at most 2 * BUCKETS rows per task; the
finished model is one array of that length, read by every task as a scalar subquery, so scoring shuffles nothing. The
target's documents are found by a broadcast of at most TARGET_DOCS labelled ids, the documented bound of the sample.

Defined results: a null, empty or blank text has no words, zero counts and score 0, and fails the base rule; with no
labelled documents the ratio is 0 for all and the base rules alone decide; repeated rows are scored alike; labels for
ids that do not occur are ignored; `assess` replaces columns called like its results (n_words, kept, ...) and keeps all
others, `keep_good` keeps every column as it was. Buckets collide where a corpus has more words and pairs than BUCKETS: a
bucket then holds the sum of its grams in target and corpus alike, so its ratio is their mean, and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import cut, table

BUCKETS = 1 << 16  # for words, and as many for word pairs
TARGET_DOCS = 50_000
PRIOR = 1.0  # added to a bucket's count, shared out by the raw corpus's own distribution
THRESHOLD = -0.2
LEAST_WORDS = 50
_SPACE = r"[ \t-\r]+"
_INK = r"[^ \t-\r]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once: a lambda's variable names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(a: Column, b: Column, ahead: int) -> Column:
    """Hashes of (a[i], b[i + ahead])."""
    left = F.greatest(F.size(b) - ahead, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(1 + ahead), left), lambda x, y: F.xxhash64(x, y))


def _repeated_words(triples: Column) -> Column:
    """How many words stand in a three-word window that occurs at least twice."""

    def places(s: Column) -> Column:
        same = lambda e, j: e["h"] == F.get(s, j)["h"]
        marked = F.transform(s, lambda e, j: F.when(F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)), e["i"]))
        covered = F.flatten(F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))
        return F.size(F.array_distinct(covered))

    ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(triples) == F.size(F.array_distinct(triples)), F.lit(0)).otherwise(_let(ordered, places))


def base(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the helper columns
    __words (word hashes) and __pairs (word-pair hashes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_INK))
    out = docs.withColumn("__w", words_of(text)).withColumn("__l", lines)
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__words": F.transform("__w", lambda w: F.xxhash64(w)),
        }
    ).drop("__w", "__l")
    out = out.withColumn("__pairs", _paired(F.col("__words"), F.col("__words"), 1))
    out = out.withColumn("__triples", _paired(F.col("__pairs"), F.col("__words"), 2))
    out = out.withColumn("n_repeat_words", _repeated_words(F.col("__triples")).cast("long")).drop("__triples")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(h: Column, shift: int) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int") + shift


def _buckets() -> Column:
    return F.concat(F.transform("__words", lambda h: _bucket(h, 0)), F.transform("__pairs", lambda h: _bucket(h, BUCKETS)))


def ratio_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one array: the log-likelihood ratio of each bucket, words first, then word pairs."""
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("__id"), "__id").limit(TARGET_DOCS).withColumn("__target", F.lit(1))
    hashed = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.transform(words_of(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.xxhash64(w)).alias("__words"))
    hashed = hashed.join(F.broadcast(trusted), F.col("__doc") == F.col("__id"), "left").select("__words", F.coalesce("__target", F.lit(0)).alias("__target"))
    hashed = hashed.withColumn("__pairs", _paired(F.col("__words"), F.col("__words"), 1))
    grams = hashed.select("__target", F.explode(_buckets()).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__target").alias("target")))  # used twice below
    order = (F.col("bucket") >= BUCKETS).cast("int")
    totals = counts.groupBy(order.alias("order")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = F.col("raw") / F.col("all_raw")
    # The target's share, smoothed towards the raw one: a bucket the target has not seen is judged by what was expected there.
    seen = (F.col("target") + PRIOR * (1 + share * BUCKETS) / 2) / (F.col("all_target") + PRIOR * BUCKETS)
    raw = (F.col("raw") + PRIOR * (1 + share * BUCKETS) / 2) / (F.col("all_raw") + PRIOR * BUCKETS)
    ratio = F.when(F.col("all_target") > 0, F.log(seen) - F.log(raw)).otherwise(F.lit(0.0))
    held = counts.withColumn("order", order).join(F.broadcast(totals), "order").select("bucket", ratio.alias("ratio"))
    every = spark.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio")))).alias("m")).select(F.col("m.ratio").alias("model"))


def with_ratio(docs: DataFrame, model: DataFrame) -> DataFrame:
    """`docs` with `ratio`: the mean log-likelihood ratio over words and word pairs; 0 without any.

    The model stands in a column that one expression reads, so the optimizer puts it into that expression and no row
    carries it."""
    total = _let(F.col("__model"), lambda m: F.aggregate(_buckets(), F.lit(0.0), lambda a, b: a + F.get(m, b)))
    grams = F.greatest(F.size("__words") + F.size("__pairs"), F.lit(1))
    return docs.withColumn("__model", model.scalar()).withColumn("ratio", total / grams).drop("__model")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the base columns, `ratio` and `kept`."""
    out = with_ratio(base(docs), ratio_model(docs, labels)).drop("__words", "__pairs")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, with their columns as they were, whatever these are called."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    # A condition that is not deterministic stays above the projection, so that no count is worked out a second time.
    chosen = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return assess(packed, labels, threshold).select("__row", chosen.alias("__chosen")).where("__chosen").select("__row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))
