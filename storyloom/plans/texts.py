"""Text, relevance and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import relevance as R
from storyloom.plans.registry import query
from storyloom.sources import pages as P
from storyloom.sources.tables import ARTICLES_SQL, articles, load, spread

#: A small dictionary over the invented languages: topic, alias, strength.
ALIASES = [
    ("lyon", "Thntblere of then", "strong"),
    ("lyon", "onanha", "strong"),
    ("lyon", "the anea", "weak"),
    ("paris", "queeau", "strong"),
    ("paris", "pathetic", "weak"),
    ("marseille", "trash", "strong"),
    ("marseille", "keiten", "strong"),
    ("marseille", "idiot", "weak"),
]
_B = r"[^\p{L}\p{N}]"
_COUNT = lambda field, a: f"len(regexp_extract_all({field}, '(?i)(^|{_B}){a}({_B}|$)'))"
_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_COMPACT = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"
_PER_ALIAS = " UNION ALL ".join(
    f"SELECT id, '{t}' AS topic, '{a}' AS alias, '{s}' AS strength, {_COUNT('title', a)} AS title, {_COUNT('excerpt', a)} AS excerpt, {_COUNT('substr(body, 1, 900)', a)} AS lead, {_COUNT('body', a)} AS body, {_COUNT('substr(body, 901)', a)} AS after FROM c"
    for t, a, s in ALIASES
)
_EVIDENCE = f"""{ARTICLES_SQL},
 c AS (SELECT id, {_COMPACT('title')} AS title, {_COMPACT('excerpt')} AS excerpt, {_COMPACT('content')} AS body FROM art),
 e AS ({_PER_ALIAS}),
 g AS (SELECT id, topic, bool_or(strength = 'strong' AND title > 0) AS st, bool_or(strength = 'strong' AND excerpt > 0) AS se, bool_or(strength = 'strong' AND lead > 0) AS sl,
   bool_or(strength = 'strong' AND after > 0) AS sb, arg_min(body, struct_pack(a := -length(alias), b := alias)) FILTER (strength = 'strong' AND after > 0) AS sbn,
   bool_or(strength = 'weak' AND title > 0) AS wt, bool_or(strength = 'weak' AND excerpt > 0) AS we, bool_or(strength = 'weak' AND lead > 0 AND after = 0) AS wl FROM e GROUP BY 1, 2),
 d AS (SELECT id, topic, CASE WHEN st THEN 'relevant' WHEN se OR sl OR sb OR wt OR we OR wl THEN 'needs_review' ELSE 'rejected' END AS decision,
   CASE WHEN st THEN 'strong_alias_title' WHEN se THEN 'strong_alias_excerpt_role_review' WHEN sl THEN 'strong_alias_lead_role_review'
   WHEN sb AND sbn > 1 THEN 'strong_alias_body_repeated' WHEN sb THEN 'strong_alias_body_only' WHEN wt THEN 'weak_alias_title'
   WHEN we THEN 'weak_alias_excerpt' WHEN wl THEN 'weak_alias_lead' ELSE 'club_not_relevant' END AS reason_code FROM g)"""


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "topic string, alias string, strength string")


@query(f"WITH {_EVIDENCE} SELECT topic, decision, reason_code, count(*) AS n FROM d GROUP BY 1, 2, 3")
def relevance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = R.decide(R.evidence(articles(spark, sf_dir), dictionary(spark)))
    return decided.groupBy("topic", "decision", "reason_code").agg(F.count("*").alias("n"))


@query(f"WITH {_EVIDENCE} SELECT id, topic, alias, title, excerpt, lead, body, after FROM e WHERE title + excerpt + body > 0")
def alias_evidence(spark, sf_dir):
    return R.evidence(articles(spark, sf_dir), dictionary(spark)).where("title + excerpt + body > 0").select("id", "topic", "alias", "title", "excerpt", "lead", "body", "after")


@query(f"""WITH d AS (SELECT doc_id, {_COMPACT('text')} AS v, strpos(lower({_COMPACT('text')}), 'the anea') AS p FROM documents)
 SELECT doc_id, CASE WHEN p - 1 - 120 > 0 THEN '…' ELSE '' END || trim(substr(v, greatest(p - 121, 0) + 1, least(length(v), p + 127) - greatest(p - 121, 0)))
   || CASE WHEN p + 127 < length(v) THEN '…' ELSE '' END AS context FROM d WHERE p > 0""")
def alias_context(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", T.alias_context(F.col("text"), F.lit("the anea")).alias("context"))
    return d.where("context is not null")


_FOLD = lambda x: f"lower(strip_accents({x}))"
_DECODED = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)&nbsp;|&#160;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&quot;', '\"', 'g'), '(?i)&#39;|&apos;', '''', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&#821[12];|&#x201[34];', '-', 'g')"
_TOPIC = lambda x: f"trim(regexp_replace(regexp_replace({_FOLD(_DECODED(x))}, 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = lambda x: f"list_filter(list_distinct(string_split({_TOPIC(x)}, ' ')), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\\d{{1,2}}$') AND w NOT IN ({_STOP}))"


@query(f"SELECT doc_id, md5({_TOPIC('text')}) AS folded, length({_TOPIC('text')}) AS n FROM documents")
def text_fold(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", T.topic_normal(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("folded"), F.length("t").alias("n"))


@query(f"SELECT doc_id, len({_TOKENS('text')}) AS n_tokens, md5(array_to_string(list_sort({_TOKENS('text')}), ' ')) AS tokens FROM documents")
def tokens_distinct(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.encode(F.array_join(F.array_sort("t"), " "), "UTF-8")).alias("tokens"))


_DF = f"t AS (SELECT doc_id, lang, unnest({_TOKENS('text')}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM t GROUP BY 1)"


@query(f"WITH {_DF} SELECT token, df, round(1 + ln((n + 1) / (df + 1)), 6) AS weight, length(token) >= 4 AND 1 + ln((n + 1) / (df + 1)) >= 1.35 AS salient FROM df, n")
def idf_weights(spark, sf_dir):
    """Document frequency and weight of every token. The corpus size is a one-row aggregate."""
    d = load(spark, sf_dir, "documents")
    df = _texts(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = d.agg(F.count("*").alias("n"))
    weight = F.lit(1.0) + F.log((n.scalar() + 1) / (F.col("df") + 1))
    return df.withColumn("w", weight).select("token", "df", F.round("w", 6).alias("weight"), ((F.length("token") >= 4) & (F.col("w") >= 1.35)).alias("salient"))


@query(f"""WITH {_DF}, l AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1), ldf AS (SELECT lang, token, count(*) AS df FROM t GROUP BY 1, 2)
 SELECT lang, docs + 1 AS event_count, greatest(3, ceil((docs + 1) * 0.03))::BIGINT AS max_df, count(*) FILTER (df + 1 <= greatest(3, ceil((docs + 1) * 0.03))) AS discriminant,
   count(*) FILTER (df + 1 > greatest(3, ceil((docs + 1) * 0.03))) AS common FROM ldf JOIN l USING (lang) GROUP BY lang, docs""")
def df_context(spark, sf_dir):
    """Per language: how many documents a token may be in to tell stories apart, the incoming one counted."""
    d = load(spark, sf_dir, "documents")
    docs = d.groupBy("lang").agg(F.count("*").alias("docs"))
    df = _texts(spark, sf_dir, "lang").select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("df"))
    limit = F.greatest(F.lit(3), F.ceil((F.col("docs") + 1) * F.lit(0.03))).cast("long")
    joined = df.join(F.broadcast(docs), "lang").withColumn("max_df", limit)  # one row per language
    return joined.groupBy("lang", (F.col("docs") + 1).alias("event_count"), "max_df").agg(F.count_if(F.col("df") + 1 <= F.col("max_df")).alias("discriminant"), F.count_if(F.col("df") + 1 > F.col("max_df")).alias("common"))


_NOISE_SQL = " OR ".join(f"contains(html, '{n.replace(chr(39), chr(39) * 2)}')" for n in T.NOISE)


@query(f"""SELECT 'pages' AS source, count(*) FILTER ({_NOISE_SQL}) AS noisy, count(*) AS n FROM pages
 UNION ALL SELECT 'documents', count(*) FILTER ({_NOISE_SQL.replace('html', 'text')}), count(*) FROM documents""")
def noise_scan(spark, sf_dir):
    def one(name, column):
        found = T.contains_any(T.NOISE, F.col(column))
        return load(spark, sf_dir, name).agg(F.count_if(found).alias("noisy"), F.count("*").alias("n")).select(F.lit(name).alias("source"), "noisy", "n")

    return one("pages", "html").unionByName(one("documents", "text"))


@query("""SELECT doc_id, CASE WHEN toxic IS NULL THEN 'needs_review' WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 0 AND toxic = 0 THEN 'needs_review' ELSE 'rejected' END AS decision,
 CASE WHEN toxic IS NULL THEN 'role_classifier_low_confidence' WHEN quality = 1 AND toxic = 0 THEN 'role_subject' WHEN quality = 0 AND toxic = 0 THEN 'role_unclear' ELSE 'role_mention' END AS reason_code
 FROM documents LEFT JOIN labels USING (doc_id)""")
def role_decision(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    role = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "subject").when((F.col("quality") == 0) & (F.col("toxic") == 0), "unclear").when(F.col("toxic").isNotNull(), "mention")
    decision, reason = R.role_decision(role, F.when(F.col("toxic").isNotNull(), F.lit(0.9)).otherwise(F.lit(0.3)))
    return d.select("doc_id", decision.alias("decision"), reason.alias("reason_code"))


@query("""SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus IN ('F', 'O') THEN 'needs_review' ELSE CASE l_returnflag WHEN 'R' THEN 'relevant' WHEN 'N' THEN 'needs_review' ELSE 'rejected' END END AS decision,
 CASE l_linestatus WHEN 'F' THEN 'strong_alias_excerpt' ELSE 'strong_alias_lead' END || CASE WHEN l_returnflag = 'R' THEN '_role_review' ELSE '' END AS reason_code, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def policy_preview(spark, sf_dir):
    stored = F.when(F.col("l_returnflag") == "R", "relevant").when(F.col("l_returnflag") == "N", "needs_review").otherwise("rejected")
    decision, reason = R.current_policy(stored, F.when(F.col("l_linestatus") == "F", "strong_alias_excerpt").otherwise("strong_alias_lead"))
    return load(spark, sf_dir, "lineitem").groupBy(decision.alias("decision"), reason.alias("reason_code")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT id, language, sha256(source_id || '|' || 'https://example.org/' || id) AS article_id, sha256(coalesce(title, '') || '|' || coalesce(excerpt, '') || '|' || published_s::BIGINT) AS content_hash FROM (
 WITH """ + ARTICLES_SQL + """ SELECT * FROM art)) SELECT id, article_id, content_hash, sha256('story:v1' || chr(0) || article_id) AS story_id FROM h""")
def identity_hash(spark, sf_dir):
    a = articles(spark, sf_dir)
    article_id = F.sha2(F.concat_ws("|", "source_id", F.concat(F.lit("https://example.org/"), F.col("id").cast("string"))), 256)
    content = F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit("")), F.unix_timestamp("published_at").cast("string")), 256)
    a = a.select("id", article_id.alias("article_id"), content.alias("content_hash"))
    return a.select("id", "article_id", "content_hash", F.sha2(F.concat(F.lit("story:v1"), F.chr(F.lit(0)), "article_id"), 256).alias("story_id"))


@query("""SELECT event_id, 'family=' || event_type || ' | people=u' || user_id || CASE WHEN value > 50 THEN ' | stage=official' ELSE '' END || ' | lexical=' || event_type || ' k' || json_extract_string(props, '$.k') AS representation,
 sha256('family=' || event_type || ' | people=u' || user_id || CASE WHEN value > 50 THEN ' | stage=official' ELSE '' END || ' | lexical=' || event_type || ' k' || json_extract_string(props, '$.k')) AS representation_hash FROM events""")
def structured_repr(spark, sf_dir):
    """One line per event; absent parts leave no trace because concat_ws skips nulls."""
    part = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{name}="), value))
    e = load(spark, sf_dir, "events")
    line = F.concat_ws(
        " | ",
        part("family", F.coalesce(F.nullif(T.compact(F.col("event_type")), F.lit("")), F.lit("unknown"))),
        part("people", F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        F.when(F.col("value") > 50, F.lit("stage=official")),
        part("lexical", F.concat_ws(" ", "event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))),
    )
    return e.select("event_id", line.alias("representation")).withColumn("representation_hash", F.sha2("representation", 256))


@query(f"""WITH a AS (SELECT DISTINCT item_id, {_TOPIC('s')} AS alias FROM (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark)), m AS (SELECT alias, count(*) AS items, min(item_id) AS item FROM a WHERE alias <> '' GROUP BY 1),
 d AS (SELECT DISTINCT doc_id, {_TOPIC('s')} AS anchor FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents))
 SELECT doc_id, count(*) AS anchors, count(*) FILTER (items = 1) AS linked, count(*) FILTER (items > 1) AS ambiguous, count(*) FILTER (items IS NULL) AS unmatched, min(CASE WHEN items = 1 THEN item END) AS item_id FROM d LEFT JOIN m ON anchor = alias WHERE anchor <> '' GROUP BY 1""")
def dictionary_resolve(spark, sf_dir):
    """The sentences of every whole document looked up among those of the items: one hit links, several are ambiguous, none
    is unmatched. Equal normal forms only, so a lookup is an equi-join; a document's repeated sentence counts once. A
    document is dealt out whole, so its sentences are made distinct, and counted, where it lies."""
    named = lambda name, key: spread(load(spark, sf_dir, name).select(key, "text"), key).select(key, F.explode(F.split("text", r"\.")).alias("s")).select(key, T.topic_normal(F.col("s")).alias("anchor")).where("anchor != ''").distinct()
    m = named("benchmark", "item_id").groupBy("anchor").agg(F.count("*").alias("items"), F.min("item_id").alias("item"))
    d = named("documents", "doc_id").join(m, "anchor", "left")
    one = F.col("items") == 1
    return d.groupBy("doc_id").agg(
        F.count("*").alias("anchors"), F.count_if(one).alias("linked"), F.count_if(F.col("items") > 1).alias("ambiguous"), F.count_if(F.col("items").isNull()).alias("unmatched"), F.min(F.when(one, F.col("item"))).alias("item_id")
    )


# -- pages --------------------------------------------------------------------------------------------------------------
_STRIP = lambda x: f"trim(regexp_replace({_DECODED(f'regexp_replace(regexp_replace(coalesce({x}, {chr(39)*2}), {chr(39)}(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}(?s)<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '{_WS}+', ' ', 'g'))"
_TITLE = _STRIP(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)")
_MAIN = f"""trim(regexp_replace(array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: {_STRIP('p')}), lambda p: length(p) >= 20), chr(10) || chr(10)), '{_WS}+', ' ', 'g'))"""


@query(f"SELECT page_id, {_TITLE} AS title, md5({_MAIN}) AS main, length({_MAIN}) AS n FROM pages")
def html_fields(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", F.coalesce(T.first_tag_text(F.col("html"), "title", "h1"), F.lit("")).alias("title"), T.main_text(F.col("html")).alias("m"))
    return p.select("page_id", "title", F.md5(F.encode("m", "UTF-8")).alias("main"), F.length("m").alias("n"))


@query(f"""WITH p AS (SELECT page_id, lower(url) AS url, {_TITLE} AS title, {_MAIN} AS body FROM pages)
 SELECT page_id, CASE WHEN regexp_matches(url, '/(login|connexion|contact|classement)(/|$)') THEN 'rejected' WHEN length(title) < 12 THEN 'rejected' WHEN length(body) < 120 THEN 'needs_content' ELSE 'usable' END AS status,
 CASE WHEN regexp_matches(url, '/(login|connexion|contact|classement)(/|$)') THEN 'navigation_page' WHEN length(title) < 12 THEN 'insufficient_title' WHEN length(body) < 120 THEN 'insufficient_content' END AS reason_code FROM p""")
def technical_classifier(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", F.lower("url").alias("url"), T.first_tag_text(F.col("html"), "title").alias("title"), T.main_text(F.col("html")).alias("body"))
    status, reason = R.technical_status(F.col("url"), F.col("title"), F.lit(""), F.col("body"))
    return p.select("page_id", status.alias("status"), reason.alias("reason_code"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|fbclid|gclid)(=[^&]*)?', '\1', 'gi'), '[?&]+$', '') AS url FROM pages""")
def url_canonical(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
 r AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link FROM a)
 SELECT page_id, link, min(pos)::INT AS first_pos, count(*) AS times FROM r GROUP BY 1, 2""")
def html_links(spark, sf_dir):
    """Anchors of a page, first place first; relative paths are put under the page's host."""
    return P.anchors(_pages(spark, sf_dir))


@query()
def page_discovery(spark, sf_dir):
    """The gated link listing of the crawl, at most 50 links per page, first wins."""
    return P.discover_links(_pages(spark, sf_dir))


@query()
def page_bodies(spark, sf_dir):
    """Readable body, cut at 40 000 characters, with its status."""
    return P.bodies(_pages(spark, sf_dir))


@query()
def entity_decode(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", P.decode_entities(T.first_tag_text(F.col("html"), "title")).alias("title"))
    return p.withColumn("repaired", P.repair_mojibake(F.col("title")))


@query("""SELECT page_id, regexp_matches(lower(url), '/(rugby|cyclisme|basket(ball)?|handball|tennis|athletisme|ski)(/|$)') AS other_sport,
  lower(url) LIKE '%/login%' OR lower(url) LIKE '%/connexion%' OR lower(url) LIKE '%/calendrier%' OR lower(url) LIKE '%/classement%' AS suspicious FROM pages""")
def page_audit(spark, sf_dir):
    url = F.lower("url")
    suspicious = F.lit(False)
    for part in ("/login", "/connexion", "/calendrier", "/classement"):
        suspicious = suspicious | url.contains(part)
    return load(spark, sf_dir, "pages").select("page_id", R.is_other_sport(F.lit(""), F.col("url")).alias("other_sport"), suspicious.alias("suspicious"))
