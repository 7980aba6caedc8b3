"""Golden cases of the text, relevance and page functions."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import relevance as R
from storyloom.sources import pages as P


def value(spark, column, **data):
    cols = ", ".join(f"{k} string" for k in data) or "x string"
    return spark.createDataFrame([tuple(data.values()) or ("",)], cols).select(column.alias("v")).first().v


@pytest.mark.parametrize("x, want", [("  a  b\n c ", "a b c"), (None, ""), (" x ", "x")])
def test_compact(spark, x, want):
    assert value(spark, T.compact(F.col("x")), x=x) == want


def test_fold(spark):
    assert value(spark, T.topic_normal(F.col("x")), x="L'Équipe &amp; Cœur d’été https://a.b/c Ñandú!") == "l equipe c ur d ete nandu"
    assert value(spark, T.key_normal(F.col("x")), x="Été 2024 – OL") == "ete 2024 ol"


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("x")), x="Le match de Fofana et 12 Fofana 2024 mercato OL") == ["fofana", "2024"]
    assert value(spark, T.fingerprint_tokens(F.col("x")), x="mercato Fofana quitte 2024 le club Fofana") == ["fofana", "quitte", "club"]


@pytest.mark.parametrize("x, alias, n", [("OL OL OL", "OL", 2), ("l’OL gagne, OL!", "ol", 2), ("COLOR", "OL", 0), ("a (b.c) d", "b.c", 1), ("abc", "b.c", 0), ("É est là", "é", 1)])
def test_alias_count(spark, x, alias, n):
    assert value(spark, T.alias_count(F.col("x"), F.col("a")), x=x, a=alias) == n


def test_alias_context(spark):
    got = value(spark, T.alias_context(F.col("x"), F.lit("OL"), 5), x="aaaaaaaaaa bbb ol ccc dddddddddd")
    assert got == "…bbb ol ccc…" or got.startswith("…") and got.endswith("…") and " ol " in got
    assert value(spark, T.alias_context(F.col("x"), F.lit("OL")), x="none") is None


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><meta property='og:title' content='Hello &quot;W&quot;'></head><script>var t='</p>'</script><article><p>short</p><p>A paragraph that is long <b>enough</b>.</p></article>"
    assert value(spark, T.first_tag_text(F.col("x"), "h1", "title"), x=page) == "A & B"
    assert value(spark, T.meta_content(F.col("x"), "^og:title$"), x=page) == 'Hello "W"'
    assert value(spark, T.main_text(F.col("x")), x=page) == "A paragraph that is long enough ."


@pytest.mark.parametrize("x, want", [("https://a.b/c?utm_source=x&id=1#top", "https://a.b/c?id=1"), ("https://a.b/c?id=1&fbclid=z", "https://a.b/c?id=1"), ("https://a.b/c?gclid=1", "https://a.b/c"), ("https://a.b/c?a=1&utm_x=2&b=3", "https://a.b/c?a=1&b=3")])
def test_canonical_url(spark, x, want):
    assert value(spark, T.canonical_url(F.col("x")), x=x) == want


def test_entities_and_mojibake(spark):
    assert value(spark, P.decode_entities(F.col("x")), x="d&amp;#233;j&agrave; &#x2019;") == "déjà ’"
    assert value(spark, P.repair_mojibake(F.col("x")), x="dÃ©jÃ\xa0 vu â€™ok") == "déjà vu ’ok"
    assert value(spark, P.repair_mojibake(F.col("x")), x="Ã©tÃ©") == "été"
    assert value(spark, P.repair_mojibake(F.col("x")), x="Ânerie") == "Ânerie"


def test_editorial_cleanup(spark):
    clean = lambda x, s: value(spark, T.clean_editorial(F.col("x"), F.lit(s)), x=x)
    assert clean("Texte. Lire plus The post Titre first appeared on But! Football Club.", "butfootballclub") == "Texte."
    assert clean("Début… pour lire la suite, rejoignez notre communauté d'abonnés et plus", "leprogres") == "Début"
    assert clean("<p>a</p><script>x</script>", "foot01") == "a"
    assert value(spark, T.has_noise(F.col("x")), x="a &rsquo; b") and not value(spark, T.has_noise(F.col("x")), x="a ’ b")


ALIASES = [("ol", "OL", "strong"), ("ol", "Olympique Lyonnais", "strong"), ("ol", "Lyon", "weak")]


@pytest.mark.parametrize(
    "title, excerpt, content, decision, reason",
    [
        ("OL : Fofana titulaire", "", "", "relevant", "strong_alias_title"),
        ("Mercato", "Selon l'OL, rien.", "", "needs_review", "strong_alias_excerpt_role_review"),
        ("Mercato", "", "Au début, l'OL.", "needs_review", "strong_alias_lead_role_review"),
        ("Mercato", "", "x" * 950 + " OL fin", "needs_review", "strong_alias_body_only"),
        ("Mercato", "", "x" * 950 + " OL puis, OL fin", "needs_review", "strong_alias_body_repeated"),
        ("À Lyon ce soir", "", "", "needs_review", "weak_alias_title"),
        ("Mercato", "Vers Lyon.", "", "needs_review", "weak_alias_excerpt"),
        ("Mercato", "", "Lyon est là.", "needs_review", "weak_alias_lead"),
        ("Mercato", "", "Lyon est là. " + "x" * 950 + " Lyon", "rejected", "club_not_relevant"),
        ("Rien", "rien", "rien", "rejected", "club_not_relevant"),
    ],
)
def test_relevance(spark, title, excerpt, content, decision, reason):
    articles = spark.createDataFrame([(1, title, excerpt, content)], "id long, title string, excerpt string, content string")
    row = R.decide(R.evidence(articles, spark.createDataFrame(ALIASES, "topic string, alias string, strength string"))).first()
    assert (row.decision, row.reason_code) == (decision, reason)


def test_direct_topic(spark):
    articles = spark.createDataFrame([(1, "x", "", "")], "id long, title string, excerpt string, content string")
    row = R.decide(R.evidence(articles, spark.createDataFrame(ALIASES, "topic string, alias string, strength string")), ["ol"]).first()
    assert (row.decision, row.reason_code, row.alias) == ("relevant", "direct_club_source", None)


@pytest.mark.parametrize(
    "url, title, excerpt, body, want",
    [
        ("https://a/login", "A long enough title", "e", "", ("rejected", "navigation_page")),
        ("https://a/x", "Calendrier de la saison", "e", "", ("rejected", "navigation_page")),
        ("https://a/x", "Short", "e", "", ("rejected", "insufficient_title")),
        ("https://a/x", "A long enough title", "", "b" * 119, ("needs_content", "insufficient_content")),
        ("https://a/x", "A long enough title", "", "b" * 120, ("usable", None)),
    ],
)
def test_technical(spark, url, title, excerpt, body, want):
    status, reason = R.technical_status(F.col("u"), F.col("t"), F.col("e"), F.col("b"))
    assert value(spark, F.struct(status.alias("s"), reason.alias("r")), u=url, t=title, e=excerpt, b=body) == want


@pytest.mark.parametrize("role, confidence, want", [("subject", 0.9, ("relevant", "role_subject")), ("subject", 0.69, ("needs_review", "role_classifier_low_confidence")), ("unclear", 0.8, ("needs_review", "role_unclear")), ("opponent", 0.7, ("rejected", "role_opponent")), (None, 0.9, ("needs_review", "role_classifier_low_confidence"))])
def test_roles(spark, role, confidence, want):
    d, r = R.role_decision(F.col("x"), F.lit(confidence))
    assert value(spark, F.struct(d.alias("d"), r.alias("r")), x=role) == want


@pytest.mark.parametrize("url, want", [("https://a.fr/", False), ("https://a.fr/login/12345", False), ("https://a.fr/foot/article-123456", True), ("https://a.fr/foot/un-slug-assez-long-pour-passer", True), ("https://a.fr/foot/court", False)])
def test_article_url(spark, url, want):
    assert value(spark, R.looks_like_article_url(F.col("x")), x=url) is want


def test_other_sport(spark):
    assert value(spark, R.is_other_sport(F.lit("Rugby : le LOU gagne"), F.col("x")), x="https://a/1")
    assert value(spark, R.is_other_sport(F.lit("OL"), F.col("x")), x="https://a/tennis/1")
    assert not value(spark, R.is_other_sport(F.lit("OL : victoire"), F.col("x")), x="https://a/foot/1")


def test_rss(spark):
    item = lambda link, title: f"<item><title><![CDATA[{title}]]></title><link>{link}</link><description>d &amp; e</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0100</pubDate></item>"
    xml = "<rss>" + item("/a-1?utm_source=x", "Un titre suffisamment long") + item("https://sports.fr/a-1", "Un autre titre assez long") + item("https://else.org/z", "Un titre ailleurs aussi long") + item("/b", "court") + "</rss>"
    feeds = spark.createDataFrame([("s", "https://sports.fr/feed", ["sports.fr"], xml)], "source_id string, base_url string, hosts array<string>, xml string")
    rows = P.rss_items(feeds).collect()
    assert [(r.url, r.title, r.excerpt, r.place) for r in rows] == [("https://sports.fr/a-1", "Un titre suffisamment long", "d & e", 1)]
    assert str(rows[0].published_at) == "2026-01-05 09:00:00"


def test_listing(spark):
    html = '<a href="/club/a12345-long-title">Le titre de cet article</a><a href="/club/a12345-long-title#x">x</a><a href="https://else.org/a1">Le titre de cet autre article</a><a href="/club/a9">court</a>'
    pages = spark.createDataFrame([(1, "https://www.footmercato.net/club", html, "footmercato")], "page_id long, url string, html string, source_id string")
    rows = P.discover_links(pages, P.adapters(spark)).collect()
    assert [r.url for r in rows] == ["https://www.footmercato.net/club/a12345-long-title"]
    assert P.adapters(spark).count() == 13


def test_api(spark):
    good, bad = '{"data":[{"slug":"x","title":" T  t ","excerpt":"e","publishedAt":"2026-01-05T10:00:00Z"}]}', "{oops"
    rows = P.api_articles(spark.createDataFrame([("s", "https://a/", good), ("s", "https://a/", bad)], "source_id string, base_url string, json string")).collect()
    assert [(r.url, r.title) for r in rows] == [("https://a/x", "T t")]


def test_bodies(spark):
    long = "<article><nav>menu</nav><p>" + "word " * 60 + "</p><p>two</p></article>"
    pages = spark.createDataFrame([(1, long, 200), (2, "<p>short</p>", 200), (3, long, 503), (4, long, 404), (5, None, 200)], "page_id long, html string, code int")
    got = {r.page_id: r for r in P.bodies(pages, F.col("code")).collect()}
    assert got[1].status == "completed" and "menu" not in got[1].text and got[1].text.endswith("\n\ntwo") and [got[i].status for i in (2, 3, 4, 5)] == ["failed", "retry", "failed", "failed"]


@pytest.mark.parametrize("source, title, want", [("sports_orange", "19:09 Football OL : victoire", "OL : victoire"), ("sports_orange", "02/09 Football OL", "OL"), ("madeingones", "Fofana part OL • 15h45", "Fofana part OL"), ("madeingones", "Mercato • Mercato Fofana", "Mercato Fofana"), ("foot01", "19:09 Football OL", "19:09 Football OL")])
def test_stable_titles(spark, source, title, want):
    assert value(spark, T.stable_title(F.col("x"), F.lit(source)), x=title) == want


def test_page_fields(spark):
    page = "<meta name='author' content='A  B'><meta property='article:published_time' content='2026-01-05'><h1>T</h1>"
    null = F.lit(None).cast("string")
    got = value(spark, F.struct(*[c.alias(n) for n, c in T.page_fields(F.col("x"), F.lit("listed"), F.lit("e"), null, null, F.lit("i")).items()]), x=page)
    assert tuple(got) == ("T", "e", "A B", "2026-01-05", None, "i")


def test_small_helpers(spark):
    assert value(spark, T.error_text(F.col("x")), x=" a\n b ") == "a b" and value(spark, T.error_text(F.col("x")), x="") == "unknown error"
    assert value(spark, T.stable_json(b=F.lit(None).cast("string"), a=F.col("x")), x="1") == '{"a":"1","b":null}'
    assert value(spark, T.pair_key(F.lit("b"), F.col("x")), x="a") == "a:b"
    assert value(spark, T.is_suspicious(F.lit("Calendrier OL"), F.col("x")), x="https://a/") and not value(spark, T.is_suspicious(F.lit("OL"), F.col("x")), x="https://a/b")


def test_embedded_routes(spark):
    html = r'<script>{"u":"\/fr\/actualites\/un-slug-assez-long-de-l-ol-2026"}</script>'
    rows = P.embedded_routes(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://www.ol.fr", "/fr/actualites/").collect()
    assert [(r.url, r.title) for r in rows] == [("https://www.ol.fr/fr/actualites/un-slug-assez-long-de-l-ol-2026", "UN slug assez long DE L OL 2026")]
