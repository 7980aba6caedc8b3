"""Whether an article concerns a topic, from where the topic's aliases occur in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T

LEAD = 900  # characters of the body that count as its lead


def evidence(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per article, topic and alias: how often the alias occurs in each field. `aliases` (topic, alias, strength)
    is a dictionary kept by hand, a fixed number of rows, and is broadcast."""
    clean = articles.select(
        "id",
        T.compact(F.col("title")).alias("title"),
        T.compact(F.col("excerpt")).alias("excerpt"),
        T.compact(F.col("content")).alias("body"),
    )
    # One pass over a text for each alias: the dictionary rides along as an array, so texts are not multiplied by a join.
    packed = aliases.groupBy().agg(F.array_sort(F.collect_list(F.struct("topic", "strength", "alias"))).alias("dictionary"))
    joined = clean.join(F.broadcast(packed))
    # Most aliases are in few texts: a plain search in the lowered text comes before any pattern. The two letters whose
    # lower case the pattern folds further are folded here, too. The lambda names the lowered texts, so each is made once.
    lowered = lambda c: F.translate(F.lower(c), "\u017f\u212a", "sk")
    lead, after = F.substring("body", 1, LEAD), F.substring("body", LEAD + 1, 1 << 30)
    low = F.struct(lowered(F.col("title")).alias("title"), lowered(F.col("excerpt")).alias("excerpt"), lowered(F.col("body")).alias("body"))

    def counts(low, a):
        pattern, plain = T.alias_pattern_column(a["alias"]), F.lower(a["alias"])
        count = lambda field, within: F.when(low[within].contains(plain), F.regexp_count(field, pattern)).otherwise(0)
        return F.struct(
            a["topic"].alias("topic"), a["strength"].alias("strength"), a["alias"].alias("alias"),
            count(F.col("title"), "title").alias("title"), count(F.col("excerpt"), "excerpt").alias("excerpt"), count(lead, "body").alias("lead"),
            count(F.col("body"), "body").alias("body"), count(after, "body").alias("after"),
        )

    found = F.element_at(F.transform(F.array(low), lambda x: F.transform("dictionary", lambda a: counts(x, a))), 1)
    return joined.select("id", F.inline(found))


def first(condition: Column, *what: str) -> Column:
    """The alias that decides: of those that meet the condition the longest, then the first by name."""
    key = F.struct(-F.length("alias"), "alias", *what)
    return F.min(F.when(condition, key))


def decide(found: DataFrame, direct_topics: list[str] | None = None) -> DataFrame:
    """(id, topic, decision, reason_code, alias): the first rule that holds, strong aliases before weak ones."""
    strong = F.col("strength") == "strong"
    rules = found.groupBy("id", "topic").agg(
        first(strong & (F.col("title") > 0)).alias("s_title"),
        first(strong & (F.col("excerpt") > 0)).alias("s_excerpt"),
        first(strong & (F.col("lead") > 0)).alias("s_lead"),
        first(strong & (F.col("after") > 0), "body").alias("s_body"),
        first(~strong & (F.col("title") > 0)).alias("w_title"),
        first(~strong & (F.col("excerpt") > 0)).alias("w_excerpt"),
        first(~strong & (F.col("lead") > 0) & (F.col("after") == 0)).alias("w_lead"),
    )
    ladder = [
        ("s_title", "relevant", F.lit("strong_alias_title")),
        ("s_excerpt", "needs_review", F.lit("strong_alias_excerpt_role_review")),
        ("s_lead", "needs_review", F.lit("strong_alias_lead_role_review")),
        ("s_body", "needs_review", F.when(F.col("s_body.body") > 1, "strong_alias_body_repeated").otherwise("strong_alias_body_only")),
        ("w_title", "needs_review", F.lit("weak_alias_title")),
        ("w_excerpt", "needs_review", F.lit("weak_alias_excerpt")),
        ("w_lead", "needs_review", F.lit("weak_alias_lead")),
    ]
    decision, reason = F.lit("rejected"), F.lit("club_not_relevant")
    for name, verdict, code in reversed(ladder):
        decision = F.when(F.col(name).isNotNull(), verdict).otherwise(decision)
        reason = F.when(F.col(name).isNotNull(), code).otherwise(reason)
    direct = F.col("topic").isin(*(direct_topics or ["\x00"]))
    return rules.select(
        "id", "topic",
        F.when(direct, "relevant").otherwise(decision).alias("decision"),
        F.when(direct, "direct_club_source").otherwise(reason).alias("reason_code"),
        F.when(~direct, F.coalesce(*[F.col(f"{n}.alias") for n, _, _ in ladder])).alias("alias"),
    )


NAVIGATION_URL = r"(?iu)/(?:login|connexion|compte|account|abonnement|newsletter|contact|mentions-legales|privacy|cookies?|classement|calendrier|resultats?|effectif|billetterie|boutique)(?:/|$)"
NAVIGATION_TITLE = r"(?iu)^(?:se connecter|se déconnecter|connexion|accueil|calendrier|classement|résultats?|effectif|billetterie|boutique|newsletter|contact|refuser\s*&\s*s'abonner)(?:$|[^a-z0-9_])"


def technical_status(url: Column, title: Column, excerpt: Column, body: Column) -> tuple[Column, Column]:
    """(status, reason) of a page before anything is read out of it."""
    title, excerpt, body = T.compact(title), T.compact(excerpt), T.compact(body)
    navigation = url.rlike(NAVIGATION_URL) | url.rlike(r"(?i)%7burl_(?:tunnel|logout)%7d") | title.rlike(NAVIGATION_TITLE)
    short, empty = F.char_length(title) < 12, (excerpt == "") & (F.char_length(body) < 120)
    status = F.when(navigation | short, "rejected").when(empty, "needs_content").otherwise("usable")
    return status, F.when(navigation, "navigation_page").when(short, "insufficient_title").when(empty, "insufficient_content")


ARTICLE_NAVIGATION = r"(?i)/(?:login|connexion|connecter|compte|account|abonnement|newsletter|contact|mentions-legales|politique-de-confidentialite|privacy|cookies?|classement|calendrier|resultats?|equipe|effectif|billetterie|boutique)(?:/|$)"


def looks_like_article_url(url: Column, pattern: Column | None = None) -> Column:
    """A source's own pattern decides where there is one; else the last part of the path needs an id or a long slug."""
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    slug = F.element_at(F.split(path, "/"), -1)
    has_id = slug.rlike(r"(?i)(?:^|[-_])\d{4,}(?:\.[a-z]+)?$") | slug.rlike(r"\d{5,}")
    long_slug = (F.char_length(slug) >= 24) & (F.regexp_count(slug, F.lit("-")) >= 3)
    general = (path != "") & ~path.rlike(ARTICLE_NAVIGATION) & (has_id | long_slug)
    return general if pattern is None else F.when(pattern.isNotNull(), F.regexp_like(path, pattern)).otherwise(general)


def looks_like_article_title(title: Column) -> Column:
    t = F.trim(title)
    return (F.char_length(t) >= 18) & ~t.rlike(r"(?iu)^(?:se connecter|connexion|accueil|calendrier|classement|résultats?|effectif|équipe|billetterie|boutique|newsletter|contact)(?:$|[^a-z0-9_])")


def is_other_sport(title: Column, url: Column) -> Column:
    """Another sport by the section of the address or the beginning of the title."""
    section = F.lower(url).rlike(r"/(?:rugby|cyclisme|basket(?:ball)?|handball|tennis|athletisme|ski)(?:/|$)")
    return section | T.compact(title).rlike(r"(?iu)^(?:rugby|top 14|pro d2|ultra-trail|trail|cyclisme|basket-ball|basketball|handball|tennis|athlétisme|lyon urban trail)(?:$|[^a-z0-9_])")


#: Roles that make an article relevant by themselves.
RELEVANT_ROLES = ("subject", "transfer_party", "financial_stakeholder")


def role_decision(role: Column, confidence: Column, threshold: float = 0.7) -> tuple[Column, Column]:
    unsure = role.isNull() | confidence.isNull() | (confidence < threshold)
    decision = F.when(unsure, "needs_review").when(role.isin(*RELEVANT_ROLES), "relevant").when(role == "unclear", "needs_review").otherwise("rejected")
    return decision, F.when(unsure, "role_classifier_low_confidence").otherwise(F.concat(F.lit("role_"), role))


def current_policy(decision: Column, reason: Column) -> tuple[Column, Column]:
    """A stored decision under the current rules: a strong alias in excerpt or lead alone is up for review."""
    moved = (decision == "relevant") & reason.isin("strong_alias_excerpt", "strong_alias_lead")
    return F.when(moved, "needs_review").otherwise(decision), F.when(moved, F.concat(reason, F.lit("_role_review"))).otherwise(reason)
