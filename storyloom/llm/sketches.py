"""Document fingerprints: the k least hashes of a document's distinct word shingles.

A bottom-k sketch is a uniform sample of the shingle set that does not depend on how the set was gathered: the sketch
of a union is the k least of the sketches' union, so parts of a document, or documents of a source, merge exactly. The
share of the merged sketch that both sides hold estimates resemblance, the share of one side's hashes below the other's
reach estimates containment, and the k-th least hash the number of distinct shingles. Sketches of sets smaller than k
are the sets, and every estimate from them is exact.

All of it is column expressions; no Python runs on the executors. The document after a given one in doc_id order comes
from a window within ranges of doc_id of bounded size; the first document of each range is sent to the range before,
too, so no range's last document lacks its neighbour and no text passes through a single task.

Defined results: null and empty texts have the empty sketch, whose string is empty and whose likeness to another empty
sketch is 1 and to any other 0; a text of one to four words is one shingle; rows of equal doc_id are ordered by text; a
single row is its own next; an empty table gives no rows. Rows with a null doc_id come before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table

K = 128
WORDS = 5
RANGE_DOCS = 500  # documents aimed at in a range
RANGES = 1 << 16  # ranges at most, so that the table of first documents stays small


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of all word shingles of a text, repeats included; lower case, split at ASCII white space."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda x: x != "")
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def joined(a: Column, b: Column, ahead: int, left: Column) -> Column:
        return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(1 + ahead), left), lambda x, y: F.xxhash64(x, y))

    def of(h: Column) -> Column:
        n = F.size(h)
        left = lambda k: F.greatest(n - k, F.lit(0))
        two = joined(h, h, 1, left(1))
        four = joined(two, two, 2, left(3))
        five = joined(four, h, 4, left(4))
        whole = F.when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= words, five).otherwise(whole)

    assert words == 5, "shingles are composed of two, four and five words"
    return F.element_at(F.transform(F.array(hashed), of), 1)  # the lambda names `hashed`, so that it is computed once


def sketch(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets; 1 for two empty ones."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that lies in b's: among a's hashes that b's sketch would hold if b had them."""
    reach = F.when(F.size(b) >= k, F.array_max(b))
    seen = F.when(reach.isNull(), a).otherwise(F.filter(a, lambda x: x <= reach))
    return F.when(F.size(seen) == 0, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.size(F.array_intersect(seen, b)).cast("double") / F.size(seen))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a share of all."""
    share = (F.array_max(a).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_sketches(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its rows, combined before the shuffle: a group's parts meet as at most
    k hashes per task that had some, counted distinct."""
    hashes = df.select(*keys, F.explode(column).alias("__h")).distinct()
    best = Window.partitionBy(*keys).orderBy("__h")
    return hashes.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def _numbers(values: list) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id: looked up among every hundredth or so, then within that part."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    inner = F.transform(F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";"), lambda x: F.split(x, ",").cast("array<bigint>"))
    part = F.size(F.filter(_numbers([p[0] for p in parts]), lambda b: b <= doc_id)) - 1
    within = F.size(F.filter(F.get(inner, part), lambda b: b <= doc_id))
    return F.when(part < 0, F.lit(0)).otherwise(part * step + within)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) of each row, where next is the row that follows in order of doc_id
    (then of the text's hash), the first after the last; for rows with a null doc_id both are null."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    numbered = own.where("doc_id is not null")
    n = numbered.count()
    ranges = max(1, min(RANGES, n // RANGE_DOCS))
    bounds: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(numbered.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges))).first()[0]))
    placed = numbered.withColumn("range", _range_of(F.col("doc_id"), bounds))
    # The first document of each range, and the range before it (the last, before the first): at most RANGES rows.
    order = Window.orderBy("range")
    heads = numbered.select("doc_id").withColumn("range", _range_of(F.col("doc_id"), bounds)).groupBy("range").agg(F.min("doc_id").alias("head"))
    ends = heads.agg(F.max("range").alias("last"))
    heads = heads.select(F.col("range").alias("own_range"), "head", F.lag("range").over(order).alias("earlier"))
    heads = heads.select("own_range", "head", F.coalesce("earlier", ends.scalar()).alias("earlier"))
    sent = placed.join(F.broadcast(heads), (placed.range == F.col("own_range")) & (placed.doc_id == F.col("head")), "left")
    here = F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))
    there = F.struct(F.col("earlier").alias("at"), F.lit(True).alias("guest"))
    dealt = sent.select("doc_id", "text", F.explode(F.when(F.col("head").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to")).select("doc_id", "text", "to.at", "to.guest")
    dealt = dealt.repartition("at").withColumn("sketch", sketch(shingle_hashes(F.col("text"))))
    after = Window.partitionBy("at").orderBy("guest", "doc_id", F.xxhash64("text"))
    paired = dealt.select("doc_id", "text", "sketch", "guest", F.lead("text").over(after).alias("next_text"), F.lead("sketch").over(after).alias("next_sketch"))
    loose = own.where("doc_id is null").select("doc_id", "text", sketch(shingle_hashes(F.col("text"))).alias("sketch"), F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    return paired.where("not guest").drop("guest").unionByName(loose)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    follow = F.coalesce(F.col("next_text"), F.lit(""))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(follow, F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited"))))
    none = F.array().cast("array<bigint>")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce(F.col("next_sketch"), none)).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
    )
