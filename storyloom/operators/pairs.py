"""Pairs without all-pairs joins: band joins, posting lists and token joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import vector as V

HOUR = 3_600_000_000


def band_pairs(df: DataFrame, id_: str, at: str, width: int, keys: list[str] = ()) -> DataFrame:
    """Pairs (a_*, b_*) of rows with equal keys, a's id below b's, whose `at` (a long) differ by at most `width`.

    The axis is cut into cells of the width; one side stays in its cell, the other goes to three, so each pair meets
    exactly once in an equi-join that the optimizer can split where a cell is crowded."""
    cell = F.expr(f"{at} div {width}")
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns], cell.alias("__cell"))
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns], F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    on = [a["__cell"] == b["__cell"], *[a[f"a_{k}"] == b[f"b_{k}"] for k in keys]]
    near = F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width
    return a.join(b, on).where(near & (F.col(f"a_{id_}") < F.col(f"b_{id_}"))).drop("__cell")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def shortlist(a: str, b: str) -> Column:
    """Why two events may belong together, as an array of reasons; empty if nothing says so or they share an article.
    Columns of each side (prefix + name): article, family, people, clubs, relations, salient (arrays but for the first two)."""
    col = lambda side, name: F.col(f"{side}{name}")
    people, clubs = shared(col(a, "people"), col(b, "people")), shared(col(a, "clubs"), col(b, "clubs"))
    relation = shared(col(a, "relations"), col(b, "relations")) + shared(col(a, "relations"), col(b, "clubs")) + shared(col(b, "relations"), col(a, "clubs"))
    salient = shared(col(a, "salient"), col(b, "salient"))
    fa, fb = F.coalesce(col(a, "family"), F.lit("unknown")), F.coalesce(col(b, "family"), F.lit("unknown"))
    kin = (fa == fb) & (fa != "unknown")
    counted = lambda name, n: F.concat(F.lit(f"{name}:"), n.cast("string"))
    reasons = F.array(
        F.when(people > 0, counted("person", people)),
        F.when(relation > 0, counted("from_to", relation)),
        F.when(clubs >= 2, counted("clubs", clubs)),
        F.when(kin & (clubs > 0) & (salient >= 2), F.lit("family+club+salient2")),
        F.when(kin & (salient >= 3), F.lit("family+salient3")),
        F.when(salient >= 4, F.lit("salient4")),
    )
    apart = col(a, "article") != col(b, "article")
    return F.when(apart, F.filter(reasons, lambda r: r.isNotNull())).otherwise(F.array().cast("array<string>"))


def rule_posts(people: Column, clubs: Column, relations: Column, salient: Column) -> tuple[Column, Column]:
    """Under which keys an event is posted, and under which it looks others up, so that any two that `shortlist` keeps
    meet under some key: a person, two clubs, two salient tokens (each rule that counts tokens asks for two or more), or a
    club that is the one's relation and the other's relation or club. Two clubs or tokens make one key, so a common club
    or token alone brings nobody together."""
    sides = [F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))) for c in (people, clubs, relations, salient)]
    people, clubs, relations, salient = sides
    one = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(f"{kind}|"), x))

    def two(kind: str, values: Column) -> Column:
        after = lambda i: F.slice(values, i + 2, F.greatest(F.size(values) - i - 1, F.lit(0)))
        return F.flatten(F.transform(values, lambda x, i: F.transform(after(i), lambda y: F.concat(F.lit(f"{kind}|"), x, F.lit("|"), y))))

    both = [one("person", people), two("clubs", clubs), two("salient", salient)]
    return F.concat(*both, one("relation", F.array_union(relations, clubs))), F.concat(*both, one("relation", relations))


def shortlisted(records: DataFrame, id_: str) -> DataFrame:
    """(a, b, reasons): every pair of events that `shortlist` keeps, once, a's id below b's; a and b are structs of the
    columns of `records`: the id, article, family, people, clubs, relations, salient, and others.

    A pair that meets under several keys is taken under the least of them, so nothing is shuffled to be made distinct.
    A crowded key is one side's many rows against the other's, which adaptive execution splits."""
    posted, looked = rule_posts(*[F.col(c) for c in ("people", "clubs", "relations", "salient")])
    rows = records.select(F.struct(*records.columns).alias("r"), posted.alias("posted"), looked.alias("looked"))
    x = rows.select(F.col("r").alias("x"), F.col("looked").alias("xl"), F.col("posted").alias("xp"), F.explode("looked").alias("key"))
    y = rows.select(F.col("r").alias("y"), F.col("looked").alias("yl"), F.col("posted").alias("yp"), F.explode("posted").alias("key"))
    met = x.join(y, "key").where((F.col(f"x.{id_}") != F.col(f"y.{id_}")) & (F.col("x.article") != F.col("y.article")))
    met = met.where(F.col("key") == F.array_min(F.array_intersect("xl", "yp")))
    up = F.col(f"x.{id_}") < F.col(f"y.{id_}")
    met = met.where(up | (F.size(F.array_intersect("yl", "xp")) == 0))  # else the pair is taken the other way round
    pairs = met.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b"))
    return pairs.withColumn("reasons", shortlist("a.", "b.")).where(F.size("reasons") > 0)


def index_keys(people: Column, clubs: Column, relation_from: Column, relation_to: Column, competition: Column, opponents: Column, salient: Column) -> Column:
    """Distinct, sorted (key_type, key_value) structs of an event, for posting lists."""
    none = F.array().cast("array<string>")
    one = lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(none)
    many = lambda v: F.filter(F.coalesce(v, none), lambda x: F.coalesce(x, F.lit("")) != "")
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("key_type"), v.alias("key_value")))
    parts = [typed("person", many(people)), typed("club", many(clubs)), typed("relation_from", one(relation_from)), typed("relation_to", one(relation_to)),
             typed("competition", one(competition)), typed("opponent", many(opponents)), typed("salient", many(salient))]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _keys(parts: list[tuple[str, Column, str]], extra: str) -> Column:
    """Structs (key_type, key_value, `extra`) of non-empty values, the first of each (type, value) kept, sorted."""
    none = F.array().cast("array<string>")
    made = [F.transform(F.filter(F.coalesce(v, none), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.struct(F.lit(t).alias("key_type"), x.alias("key_value"), F.lit(e).alias(extra))) for t, v, e in parts]
    every = F.concat(*made)
    first = F.filter(every, lambda k, i: ~F.exists(F.slice(every, F.lit(1), i), lambda o: (o["key_type"] == k["key_type"]) & (o["key_value"] == k["key_value"])))
    return F.array_sort(first)


def lookup_keys(people: Column, clubs: Column, relations: Column, competition: Column, opponents: Column, salient: Column) -> Column:
    """What an event looks stories up by, and why: a club is also looked for as another event's relation, and the other
    way round."""
    return _keys(
        [("person", people, "person"), ("club", clubs, "club"), ("relation_from", relations, "relation"), ("relation_to", relations, "relation"), ("club", relations, "relation_cross"),
         ("relation_from", clubs, "relation_cross"), ("relation_to", clubs, "relation_cross"), ("competition", F.array(competition), "competition"), ("opponent", opponents, "opponent"), ("salient", salient, "salient")],
        "lookup_reason",
    )


def rule_keys(people: Column, clubs: Column, relations: Column, salient: Column) -> Column:
    """(rule_type, key_type, key_value) by which members of a story are found for the shortlist's rules."""
    parts = [("person", "person", people), ("club", "club", clubs), ("relation", "relation_from", clubs), ("relation", "relation_to", clubs), ("relation", "club", relations),
             ("relation", "relation_from", relations), ("relation", "relation_to", relations), ("salient", "salient", salient)]
    none = F.array().cast("array<string>")
    made = [F.transform(F.filter(F.coalesce(v, none), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.struct(F.lit(r).alias("rule_type"), F.lit(t).alias("key_type"), x.alias("key_value"))) for r, t, v in parts]
    return F.array_distinct(F.concat(*made))


def probe(queries: DataFrame, postings: DataFrame, id_: str, most: int = 16) -> DataFrame:
    """For each query the stories with most matching keys: (id, story_id, matched_key_count, place). `queries` is
    (id, key_type, key_value), `postings` is (key_type, key_value, story_id), distinct.

    Queries with the same keys are one. The longest list of a query is not read in full: a story that is found there alone
    matches one key, and so do the first `most` of that list, or more; any other story is found under a shorter list, and
    only whether it stands in the longest one is looked up."""
    key = ["key_type", "key_value"]
    lists = postings.groupBy(*key).agg(F.count("*").alias("n"))
    asked = queries.join(lists, key).groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("n", *key)), asc=False).alias("keys"))
    asked = asked.withColumn("q", F.min(id_).over(Window.partitionBy("keys")))  # one of those that ask the same
    known = asked.where(F.col("q") == F.col(id_)).select("q", "keys", F.col("keys")[0]["key_type"].alias("lt"), F.col("keys")[0]["key_value"].alias("lv"))
    short = known.where(F.size("keys") > 1).select("q", "lt", "lv", F.explode(F.slice("keys", F.lit(2), F.size("keys") - 1)).alias("k")).select("q", "lt", "lv", "k.key_type", "k.key_value")
    longest = postings.select(F.col("key_type").alias("lt"), F.col("key_value").alias("lv"), "story_id", F.lit(1).alias("also"))
    found = short.join(postings, key).join(longest, ["lt", "lv", "story_id"], "left").select("q", "story_id", F.lit(1).alias("hit"), F.coalesce("also", F.lit(0)).alias("also"))
    first = postings.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("story_id"))).where(F.col("at") <= most)
    alone = known.select("q", F.col("lt").alias("key_type"), F.col("lv").alias("key_value")).join(first, key).select("q", "story_id", F.lit(0).alias("hit"), F.lit(1).alias("also"))
    hits = found.unionByName(alone).repartition("q").groupBy("q", "story_id").agg((F.sum("hit") + F.max("also")).alias("matched_key_count"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("matched_key_count"), "story_id"))
    best = hits.withColumn("place", place).where(F.col("place") <= most)
    return asked.select(id_, "q").join(best, "q").select(id_, "story_id", "matched_key_count", "place")


def token_pairs(tokens: DataFrame, doc: str, weight: str, least: float, keys: list[str] = ()) -> DataFrame:
    """(a, b, score) of documents of equal `keys` whose weighted common tokens add up to at least `least`; `tokens` is
    (keys, doc, token, weight, df) with vectors of length one, `df` how many documents a token is in.

    Tokens are ordered by rarity. The commonest of a document, as long as their own length stays below `least`, cannot
    reach it alone whatever the other document holds, so both documents of a pair hold its rarest common token among the
    others: candidates meet under rare tokens only, and under the rarest of them once. Scores are summed over all tokens."""
    rarity = F.struct("df", "token")
    suffix = F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(*keys, doc).orderBy(F.desc("df"), F.desc("token")))
    rows = tokens.withColumn("__rare", F.sqrt(suffix) >= least)
    packed = rows.groupBy(*keys, doc).agg(
        F.array_sort(F.collect_list(F.when(F.col("__rare"), rarity))).alias("rare"), F.map_from_entries(F.collect_list(F.struct("token", weight))).alias("vector")
    )
    side = lambda s: packed.select(*keys, F.col(doc).alias(s), F.explode("rare").alias("key"), F.col("rare").alias(f"r{s}"), F.col("vector").alias(f"v{s}"))
    met = side("a").join(side("b"), [*keys, "key"]).where("a < b").where(F.col("key") == F.array_min(F.array_intersect("ra", "rb")))
    shared = F.map_filter("va", lambda t, _: F.map_contains_key("vb", t))
    score = F.aggregate(F.map_entries(shared), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at("vb", e["key"]))
    return met.select(*keys, "a", "b", score.alias("score")).where(F.col("score") >= least)


def pair_class(score: Column, title: Column, context: Column, salient: Column, hours: Column, window: float = 48) -> Column:
    """strong, candidate or none, from the score and how many tokens are shared."""
    soon = hours.isNull() | (hours <= 12)
    strong = ((score >= 0.62) & (context >= 2)) | ((score >= 0.54) & (title >= 2)) | ((score >= 0.48) & (title >= 1) & (context >= 3))
    candidate = (
        ((score >= 0.38) & (salient >= 2))
        | ((title >= 2) & (salient >= 2) & (score >= 0.26))
        | ((title >= 1) & (salient >= 2) & (context >= 3) & soon)
        | ((salient >= 3) & (context >= 4) & soon)
    )
    return F.when(hours.isNotNull() & (hours > window), "none").when(strong, "strong").when(candidate, "candidate").otherwise("none")


def decide_story(scored: DataFrame, event: str, low: float = V.LOW, high: float = V.HIGH) -> DataFrame:
    """(event, decision, reason, story_id, hybrid) from scored candidates (event, story_id, shortlist_pass, hybrid,
    family_compatible, members_truncated): the best of those compatible, else the best of all; ties by id."""
    ready = F.col("shortlist_pass") & F.col("hybrid").isNotNull()
    key = F.struct((-F.col("hybrid")).alias("minus"), F.col("story_id"))
    g = scored.groupBy(event).agg(
        F.min(F.when(ready & F.col("family_compatible"), key)).alias("fit"),
        F.min(F.when(ready, key)).alias("any"),
        F.max(ready & F.col("members_truncated")).alias("cut"),
        F.max(F.col("shortlist_pass") & F.col("hybrid").isNull()).alias("broken"),
    )
    best, fits = F.coalesce("fit", "any"), F.col("fit").isNotNull()
    score = -best["minus"]
    ladder = [
        (best.isNull() & F.col("broken"), "AMBIGUOUS_AI", "candidate_centroid_invalid"),
        (best.isNull(), "AUTO_NEW_STORY", "no_pairwise_candidate"),
        (~fits & (score >= low), "AMBIGUOUS_AI", "family_gate"),
        (~fits, "AUTO_NEW_STORY", "family_gate_below_low"),
        (F.coalesce(F.col("cut"), F.lit(False)), "AMBIGUOUS_AI", "bounded_membership_lower_bound"),
        (score >= high, "AUTO_ATTACH", "high_score"),
        (score >= low, "AMBIGUOUS_AI", "score_ambiguous"),
    ]
    decision, reason = F.lit("AUTO_NEW_STORY"), F.lit("below_low")
    for condition, d, r in reversed(ladder):
        decision, reason = F.when(condition, d).otherwise(decision), F.when(condition, r).otherwise(reason)
    return g.select(event, decision.alias("decision"), reason.alias("reason"), best["story_id"].alias("story_id"), score.alias("hybrid"))
