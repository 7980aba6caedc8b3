"""Operators on inputs worked out by hand: small tables in the query, what they must give in the SQL.

These stand for operators whose inputs are in no table of the driver's (feeds, payloads, French articles, answers of a
model) or whose outcome hangs on order."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from storyloom.functions import text as T
from storyloom.functions import vector as V
from storyloom.operators import evaluate as E
from storyloom.operators import extraction as X
from storyloom.operators import maintenance as M
from storyloom.operators import relevance as R
from storyloom.operators import review
from storyloom.plans.registry import query
from storyloom.sources import pages as P
from storyloom.streaming import clusterer


@query("""SELECT * FROM (VALUES ('ol_official', 'ol_api', 1, false), ('olympique_et_lyonnais', 'html', 2, false), ('footmercato', 'html', 2, false), ('foot01', 'html', 2, false), ('sport_fr', 'html', 2, false), ('leprogres', 'html', 2, false),
 ('sport365', 'html', 2, true), ('sports_fr', 'rss', 2, false), ('topmercato', 'rss', 2, false), ('butfootballclub', 'rss', 2, false), ('ferveur_lyonnaise', 'html', 2, false), ('madeingones', 'html', 1, false), ('sports_orange', 'html', 1, false)) t(id, mode, hosts, own_pattern)""")
def source_catalogue(spark: SparkSession, sf_dir: str):
    """The sources, how each is listed, and whether it has a pattern of its own for articles."""
    return P.adapters(spark).select("id", "mode", F.size("hosts").alias("hosts"), F.col("article_path").isNotNull().alias("own_pattern"))


_FEED = """<rss><channel><title>feed</title>
<item><title><![CDATA[Un titre assez long &amp; clair]]></title><link>https://a.org/news/1?utm_source=x&amp;id=7#top</link><description><![CDATA[<p>Un <b>chapeau</b></p>]]></description><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate></item>
<item><title>Le m&#234;me article encore une fois</title><guid>https://a.org/news/1?id=7</guid><pubDate>demain</pubDate></item>
<item><title>Un article sans adresse du tout</title></item>
<item><title>Trop court</title><link>https://a.org/news/2</link></item>
<item><title>Un article relatif &#xE0; son h&#244;te</title><guid>/news/3</guid><description>l&#8217;essentiel</description></item>
<item><title>Un article d'un autre site web</title><link>https://b.org/news/4</link></item>
</channel></rss>"""


@query("""SELECT * FROM (VALUES ('s', 1, 'https://a.org/news/1?id=7', 'Un titre assez long & clair', 'Un chapeau', '2024-03-05 09:00:00'), ('s', 2, 'https://a.org/news/3', 'Un article relatif à son hôte', 'l’essentiel', NULL)) t(source_id, place, url, title, excerpt, published_at)""")
def rss_feed(spark, sf_dir):
    """A feed: CDATA and tags unwrapped, link or guid, addresses made whole and canonical, the first of each wins."""
    feeds = spark.createDataFrame([("s", "https://a.org/", ["a.org"], _FEED.replace("&amp;id=7", "&id=7"))], "source_id string, base_url string, hosts array<string>, xml string")
    return P.rss_items(feeds).select("source_id", "place", "url", "title", "excerpt", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("""SELECT * FROM (VALUES ('s', 'https://o.fr/n/un', 'Titre un', 'chapeau', '2024-03-05 10:00:00'), ('s', 'https://o.fr/n/deux', 'Titre deux', NULL, NULL)) t(source_id, url, title, excerpt, published_at)""")
def api_payloads(spark, sf_dir):
    """JSON payloads; one that is broken gives nothing."""
    rows = [("s", "https://o.fr/n/", '{"data": [{"slug": "un", "title": " Titre  un", "excerpt": "chapeau", "publishedAt": "2024-03-05T10:00:00Z"}, {"title": "sans slug"}, {"slug": "deux", "title": "Titre deux"}]}'), ("s", "https://o.fr/n/", "{broken")]
    got = P.api_articles(spark.createDataFrame(rows, "source_id string, base_url string, json string"))
    return got.select("source_id", "url", "title", F.nullif("excerpt", F.lit("")).alias("excerpt"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("""SELECT * FROM (VALUES (1, 1, 'https://o.fr/actualites/le-club-annonce-un-nouvel-entraineur', 'LE club annonce UN nouvel entraineur'), (1, 2, 'https://o.fr/actualites/match-20240', 'match 20240')) t(page_id, place, url, title)""")
def embedded_links(spark, sf_dir):
    """Articles that only a script payload names; menus and short slugs are none."""
    html = r'<script>{"a":"\/actualites\/le-club-annonce-un-nouvel-entraineur","b":"/actualites/match-20240","c":"/actualites/le-club-annonce-un-nouvel-entraineur","d":"/actualites/billetterie","e":"/autres/match-20241"}</script>'
    return P.embedded_routes(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://o.fr/", "actualites")


@query("""SELECT * FROM (VALUES (1, 'é & « ok » …', 'é & « ok » …'), (2, '&amp;', '&amp;'), (3, 'Ã©tÃ©', 'été'), (4, 'L’été', 'L’été'), (5, NULL, NULL), (6, 'a b', 'a b')) t(id, decoded, repaired)""")
def entity_golden(spark, sf_dir):
    """Entities decoded up to three times; text read in the wrong code page read right."""
    rows = [(1, "&eacute; &amp;amp; &laquo; ok &raquo; &hellip;"), (2, "&amp;amp;amp;amp;"), (3, "Ã©tÃ©"), (4, "L&rsquo;&#233;t&#xe9;"), (5, None), (6, "a&nbsp;b")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", P.decode_entities("t").alias("decoded"))
    return d.withColumn("repaired", P.repair_mojibake("decoded"))


@query("""SELECT * FROM (VALUES (1, 'L’OL gagne'), (2, 'Mercato un titre'), (3, '12:30 Football autre source'), (4, 'L’OL gagne')) t(id, title)""")
def stable_titles(spark, sf_dir):
    """Titles without the clock and the rubric that a listing adds."""
    rows = [(1, "12:30 Football L’OL gagne", "sports_orange"), (2, "Mercato • Mercato un titre • 12h30", "madeingones"), (3, "12:30 Football autre source", "foot01"), (4, "05/03 Football L’OL gagne", "sports_orange")]
    return spark.createDataFrame(rows, "id int, t string, s string").select("id", T.stable_title(F.col("t"), F.col("s")).alias("title"))


@query("""SELECT * FROM (VALUES (1, 'Un texte'), (2, 'Un texte. La suite'), (3, 'Un texte. The post X first appeared on But! Football Club.'), (4, 'a b')) t(id, text)""")
def editorial_cleanup(spark, sf_dir):
    """Stock phrases go where their source puts them, and only there."""
    rows = [
        (1, "<p>Un texte</p> … pour lire la suite, rejoignez notre communauté d'abonnés et plus", "leprogres"),
        (2, "Un texte. Ce contenu est bloqué car vous n'avez pas accepté les cookies et autres traceurs. Blabla Gérer mes choix La suite {'skus': ['x']}", "leprogres"),
        (3, "Un texte. The post X first appeared on But! Football Club.", "foot01"),
        (4, "<script>x()</script>a <b>b</b>  The post Y first appeared on But! Football Club.", "butfootballclub"),
    ]
    return spark.createDataFrame(rows, "id int, t string, s string").select("id", T.clean_editorial(F.col("t"), F.col("s")).alias("text"))


@query("""SELECT * FROM (VALUES (1, 'Un texte & fin'), (2, 'a')) t(article_id, text)""")
def text_cleanup(spark, sf_dir):
    """Rows that hold noise, cleaned; rows that stay as they are are not written."""
    rows = [(1, "leprogres", "Un texte &amp; fin"), (2, "butfootballclub", "a The post b first appeared on But! Football Club"), (3, "foot01", "propre"), (4, "foot01", "The postman")]
    return M.clean_texts(spark.createDataFrame(rows, "article_id int, source_id string, text string"), ["text"]).select("article_id", "text")


@query("""SELECT * FROM (VALUES (1, 'L’été', 'a', sha256('L’été|a|2024')), (3, 'x', 'b', sha256('x|b|2024'))) t(id, title, excerpt, content_hash)""")
def entity_rehash(spark, sf_dir):
    """Stored entities decoded and the row hashed anew; rows without any, or hashed so already, are not written."""
    from hashlib import sha256

    h = lambda *x: sha256("|".join(x).encode()).hexdigest()
    rows = [(1, "L&rsquo;&#233;t&eacute;", "a", "2024", h("L&rsquo;&#233;t&eacute;", "a", "2024")), (2, "propre", "b", "2024", "h"), (3, "x", "b&#160;", "2024", "old"), (4, "&#65;", "", "2024", h("A", "", "2024"))]
    return M.normalize_entities(spark.createDataFrame(rows, "id int, title string, excerpt string, published_at string, content_hash string")).select("id", "title", "excerpt", "content_hash")


@query("""SELECT * FROM (VALUES (1, 'Titre & co', 'Un chapeau', 'Jeanne', '2024-03-05', 'https://i/1.jpg', 'Un paragraphe assez long pour compter.'), (2, 'Grand titre', 'liste', 'auteur', 'hier', 'img', NULL), (3, 'listé', 'liste', 'auteur', 'hier', 'img', NULL)) t(id, title, excerpt, author, published_at, image_url, content)""")
def page_field_rules(spark, sf_dir):
    """What a page says of itself: meta tags before headings before the listing."""
    one = """<head><meta property="og:title" content="Titre &amp; co"><meta name='description' content='Un  chapeau'><meta content="Jeanne" name="author"><meta property="article:published_time" content="2024-03-05"><meta property="og:image" content="https://i/1.jpg"></head>
<article><p>court</p><p>Un paragraphe <b>assez</b> long pour compter.</p></article>"""
    rows = [(1, one), (2, "<title>t</title><h1>Grand <i>titre</i></h1><meta name='description' content=''>"), (3, "<p>rien</p>")]
    d = spark.createDataFrame(rows, "id int, html string")
    f = T.page_fields(F.col("html"), F.lit("listé"), F.lit("liste"), F.lit("auteur"), F.lit("hier"), F.lit("img"))
    return d.select("id", *[f[n].alias(n) for n in ("title", "excerpt", "author", "published_at", "image_url", "content")])


@query("""SELECT * FROM (VALUES ('0000803F000000C0', '1.0|-2.0'), ('0000803F0000807F', NULL), ('0000803F', NULL), ('01000000CDCCCC3D', '1.401298464324817E-45|0.10000000149011612')) t(bytes, numbers)""")
def float_codec(spark, sf_dir):
    """Little-endian 32-bit floats: normal, infinite, of the wrong length, tiny."""
    d = spark.createDataFrame([("0000803F000000C0",), ("0000803F0000807F",), ("0000803F",), ("01000000CDCCCC3D",)], "bytes string")
    v = V.decode_float32(F.unhex("bytes"), 2)
    return d.select("bytes", F.when(v.isNotNull(), F.array_join(F.transform(v, lambda x: x.cast("double").cast("string")), "|")).alias("numbers"))


@query("""SELECT * FROM (VALUES (1, 1, 'Une première phrase complète.'), (1, 2, '«Une autre phrase entre guillemets.»'), (2, 1, 'Pas de fin de phrase mais assez longue')) t(id, place, sentence)""")
def sentence_split(spark, sf_dir):
    """Sentences end before a capital, a digit or a quotation; those under eighteen characters are dropped."""

    @F.pandas_udf(S.ArrayType(S.StringType()))
    def split(x):
        return x.map(X.sentences_of)

    d = spark.createDataFrame([(1, "Une première phrase complète. Court. «Une autre phrase entre guillemets.»"), (2, "Pas de fin de phrase mais assez longue"), (3, "")], "id int, t string")
    return d.select("id", F.posexplode(split("t")).alias("p", "sentence")).select("id", (F.col("p") + 1).alias("place"), "sentence")


@query("""SELECT * FROM (VALUES (1, 'subject', 0.877, NULL), (2, NULL, NULL, 'invalid_role'), (3, NULL, NULL, 'invalid_confidence'), (4, NULL, NULL, 'invalid_rationale'), (5, NULL, NULL, 'invalid_json'), (6, NULL, NULL, 'invalid_json'), (7, 'unclear', 1.0, NULL)) t(id, role, confidence, error)""")
def role_answers(spark, sf_dir):
    """Answers about a topic's role, read strictly: what breaks the contract is a code and not a failure."""
    why = '"rationale": "ok"'
    rows = [(1, f'```json\n{{"role": "subject", "confidence": 0.87654, {why}}}\n```'), (2, f'{{"role": "boss", "confidence": 1, {why}}}'), (3, f'{{"role": "unclear", "confidence": 1.2, {why}}}'), (4, '{"role": "unclear", "confidence": 1, "rationale": ""}'), (5, "{oops"), (6, None), (7, f'{{"role": "unclear", "confidence": "1", {why}}}')]
    return spark.createDataFrame(rows, "id int, raw string").select("id", review.parse_roles("raw").alias("p")).select("id", "p.role", "p.confidence", "p.error")


@query("""SELECT * FROM (VALUES (1, 'attach', 's1', 'e,m1', NULL), (2, 'new_story', NULL, '', NULL), (3, NULL, NULL, NULL, 'ai_story_not_in_candidate_set'), (4, NULL, NULL, NULL, 'ai_attach_missing_new_event_evidence'), (5, NULL, NULL, NULL, 'ai_attach_missing_story_evidence'),
 (6, NULL, NULL, NULL, 'ai_non_attach_has_story_id'), (7, NULL, NULL, NULL, 'ai_unknown_evidence_event'), (8, NULL, NULL, NULL, 'invalid_ai_decision'), (9, NULL, NULL, NULL, 'ai_attach_club_pair_mismatch'), (10, NULL, NULL, NULL, 'invalid_json'), (11, NULL, NULL, NULL, 'ai_attach_without_evidence')) t(id, decision, story_id, evidence, error)""")
def arbitration_answers(spark, sf_dir):
    """Answers about a story: to attach, both the event and a member of the story chosen must be cited."""
    import json

    answer = lambda d, s, ev: json.dumps({"decision": d, "story_id": s, "confidence": 0.9, "rationale": "r", "evidence_event_ids": ev})
    cases = [answer("attach", "s1", ["e", "m1"]), answer("new_story", None, []), answer("attach", "s9", ["e"]), answer("attach", "s1", ["m1"]), answer("attach", "s1", ["e", "m2"]), answer("unsure", "s1", []), answer("new_story", None, ["z"]), answer("join", None, []), answer("attach", "s2", ["e", "m2"]), "{", answer("attach", "s1", [])]
    members, clubs = json.dumps({"s1": ["m1"], "s2": ["m2"]}), json.dumps({"e": ["A", "B"], "m1": ["B", "A"], "m2": ["A", "C"]})
    d = spark.createDataFrame([(i + 1, c, "e", members, clubs) for i, c in enumerate(cases)], "id int, raw string, e string, m string, c string")
    return d.select("id", review.parse_arbitrations("raw", "e", "m", "c").alias("p")).select("id", "p.decision", "p.story_id", "p.evidence", "p.error")


#: French articles: (id, title, excerpt, content).
_ARTICLES = [
    (1, "Ibrahim Mbaye quitte le PSG et file à Aston Villa. Officiel.", "", ""),
    (2, "Le rachat avance", "Le rachat de l’OL avance selon Jean Dupont.", ""),
    (3, "Un achat avance", "Un achat de maillots.", ""),
    (4, "OM : gros coup dur pour un cadre", "Paul Durand sera absent.", "Touché à la cuisse, Paul Durand pourrait manquer plusieurs semaines avec l’OM.\n\nLa blessure de Paul Durand attend un diagnostic, son indisponibilité sera précisée."),
    (5, "Le point mercato du jour", "", "Paul Durand est ciblé par Crystal Palace.\n\nJean Dupont quitte le PSG et rejoint Aston Villa.\n\nMarc Petit est en négociations avec Chelsea."),
    (6, "Pronostic OL Auxerre", "L’OL reçoit Auxerre pour un match de Ligue 1.", "L’infirmerie. Paul Durand est blessé et reste forfait avec l’OL."),
    (7, "OM : un accord avec la DNCG", "Jean Dupont parle d’accord avec la DNCG pour l’OM.", ""),
    (8, "OM : un accord pour Jean Dupont", "Jean Dupont présente un budget à l’OM.", ""),
]
_CLUBS = X.Context({"PSG": ["Paris SG"], "OL": ["Olympique Lyonnais"], "OM": ["Olympique de Marseille"]}, ["Ibrahim Mbaye", "Paul Durand", "Jean Dupont", "Marc Petit"])


@query("""SELECT * FROM (VALUES
 ('0.2', 1, 'transfer', 'official', 'Ibrahim Mbaye', 'Aston Villa|PSG', 'lead', 1), ('0.2', 2, 'finance', NULL, 'Jean Dupont', 'OL', 'lead', 1), ('0.2', 4, 'unknown', NULL, 'Paul Durand', 'OM', 'lead', 2), ('0.2', 4, 'injury', 'diagnosis', 'Paul Durand', '', 'paragraph', 1),
 ('0.2', 5, 'transfer', 'unknown', 'Paul Durand', 'Crystal Palace', 'paragraph', 1), ('0.2', 5, 'transfer', 'unknown', 'Jean Dupont', 'Aston Villa|PSG', 'paragraph', 1), ('0.2', 5, 'transfer', 'negotiation', 'Marc Petit', 'Chelsea', 'paragraph', 1),
 ('0.2', 6, 'match', NULL, '', 'AJ Auxerre|OL', 'lead', 1), ('0.2', 6, 'injury', 'unknown', 'Paul Durand|L’infirmerie', 'OL', 'paragraph', 1), ('0.2', 7, 'finance', NULL, 'Jean Dupont', 'OM', 'lead', 1), ('0.2', 8, 'finance', NULL, 'Jean Dupont', 'OM', 'lead', 1),
 ('0.4', 1, 'transfer', 'official', 'Ibrahim Mbaye', 'Aston Villa|PSG', 'lead', 1), ('0.4', 2, 'finance', NULL, 'Jean Dupont', 'OL', 'lead', 1), ('0.4', 4, 'unknown', NULL, 'Paul Durand', 'OM', 'lead', 2), ('0.4', 4, 'injury', 'diagnosis', 'Paul Durand', '', 'paragraph', 1),
 ('0.4', 5, 'transfer', 'unknown', 'Paul Durand', 'Crystal Palace', 'paragraph', 1), ('0.4', 5, 'transfer', 'unknown', 'Jean Dupont', 'Aston Villa|PSG', 'paragraph', 1), ('0.4', 5, 'transfer', 'negotiation', 'Marc Petit', 'Chelsea', 'paragraph', 1),
 ('0.4', 6, 'match', NULL, '', 'AJ Auxerre|OL', 'lead', 1), ('0.4', 7, 'transfer', NULL, 'Jean Dupont', 'OM', 'lead', 1), ('0.4', 8, 'transfer', NULL, 'Jean Dupont', 'OM', 'lead', 1),
 ('0.5', 1, 'transfer', 'official', 'Ibrahim Mbaye', 'Aston Villa|PSG', 'lead', 1), ('0.5', 2, 'finance', NULL, 'Jean Dupont', 'OL', 'lead', 1), ('0.5', 4, 'injury', 'diagnosis', 'Paul Durand', 'OM', 'lead', 3),
 ('0.5', 5, 'transfer', 'unknown', 'Paul Durand', 'Crystal Palace', 'paragraph', 1), ('0.5', 5, 'transfer', 'unknown', 'Jean Dupont', 'Aston Villa|PSG', 'paragraph', 1), ('0.5', 5, 'transfer', 'negotiation', 'Marc Petit', 'Chelsea', 'paragraph', 1),
 ('0.5', 6, 'match', NULL, '', 'AJ Auxerre|OL', 'lead', 1), ('0.5', 7, 'finance', 'unknown', 'Jean Dupont', 'OM', 'lead', 1), ('0.5', 8, 'transfer', NULL, 'Jean Dupont', 'OM', 'lead', 1)
 ) t(version, article_id, family, stage, people, clubs, kind, fragments)""")
def events_golden(spark, sf_dir):
    """Events of eight French articles by each version of the extractor."""
    a = spark.createDataFrame(_ARTICLES, "id long, title string, excerpt string, content string")
    out = None
    for version in X.VERSIONS:
        e = X.extract(a, _CLUBS, version).select(F.lit(version).alias("version"), "article_id", "family", "stage", F.array_join("people", "|").alias("people"), F.array_join(F.array_sort("clubs"), "|").alias("clubs"), "kind", "fragments")
        out = e if out is None else out.unionByName(e)
    return out


_DAY = clusterer.DAY_US
_STREAM = [(1, 0, "transfer", ["x"], [1.0, 0.0]), (2, _DAY, "transfer", ["x"], [1.0, 0.0]), (3, _DAY, "injury", ["x"], [1.0, 0.0]), (4, 2 * _DAY, "transfer", ["y"], [0.0, 1.0]), (5, 60 * _DAY, "transfer", ["x"], [0.0, 1.0])]


def _streamed(spark):
    rows = [("k", i, us, f, t, v) for i, us, f, t, v in _STREAM]
    return spark.createDataFrame(rows, "key string, event_id long, us long, family string, tokens array<string>, vector array<float>")


@query("""SELECT * FROM (VALUES ('k', 1, 1, 'new_no_candidate'), ('k', 2, 1, 'attach'), ('k', 3, 3, 'new_ambiguous'), ('k', 4, 4, 'new_no_candidate'), ('k', 5, 5, 'new_below_low')) t(key, event_id, story_id, decision)""")
def clusters_golden(spark, sf_dir):
    """Five events folded into stories: one joins, one is a family apart, one is too far off in time."""
    return clusterer.cluster(_streamed(spark)).select("key", "event_id", "story_id", "decision")


@query("""SELECT * FROM (VALUES (4, 0.5, 1.0, 1.0, 0.75)) t(n, same_recall, different_separation, co_cluster_precision, pair_accuracy)""")
def cluster_eval_golden(spark, sf_dir):
    """Those stories against four labelled pairs."""
    labels = spark.createDataFrame([(1, 2, True), (1, 5, True), (1, 4, False), (2, 4, False)], "a long, b long, same boolean")
    return E.cluster_evaluation(clusterer.cluster(_streamed(spark)), labels)


@query("""SELECT * FROM (VALUES ('conservative', 0.4, true), ('conservative', NULL, false)) t(mode, anchor, safe)""")
def run_ranking(spark, sf_dir):
    """Which run to take: safe before good, then the higher score; stress runs are never taken. Without the first, the second."""
    rows = [("conservative", None, 0.9, 0.99, 0.95, 0.99, 3, 1.0), ("conservative", 0.4, 0.5, 0.99, 0.98, 0.98, 3, 1.0), ("stress", 0.2, 1.0, 1.0, 1.0, 1.0, 1, 0.0)]
    runs = spark.createDataFrame(rows, "mode string, anchor double, same_recall double, pair_accuracy double, co_cluster_precision double, different_separation double, largest int, longest_days double")
    return review.recommendation(runs).unionByName(review.recommendation(runs.where("anchor is null or anchor != 0.4"))).select("mode", "anchor", "safe")


@query("""SELECT * FROM (VALUES (1, 'completed', 220), (2, 'failed', 5), (3, 'failed', 220), (4, 'retry', 220), (5, 'retry', 0)) t(page_id, status, n)""")
def body_status(spark, sf_dir):
    """Bodies with enough text are done; throttled pages and server errors are tried again, other errors are not."""
    long = "<html><nav>menu</nav><article><p>" + "a" * 220 + "</p><script>x</script></article></html>"
    rows = [(1, long, 200), (2, "<article><p>court</p></article>", 200), (3, long, 404), (4, long, 503), (5, None, 429)]
    return P.bodies(spark.createDataFrame(rows, "page_id int, html string, code int").withColumn("http", F.col("code")).select("page_id", "html", "code"), F.col("code")).select("page_id", "status", F.char_length("text").alias("n"))


@query("""SELECT * FROM (VALUES (1, 1, 'https://foot01.com/ol/un-tres-long-article-sur-le-club', 'Un titre assez long pour un article')) t(page_id, place, url, title)""")
def listing_golden(spark, sf_dir):
    """A listing under its source's rules: host, path, address and title; the first place of an address wins."""
    a = "<a class='x' href='/ol/un-tres-long-article-sur-le-club?utm_source=a'>Un titre <b>assez</b> long pour un article</a>"
    html = a + a.replace("Un titre", "Le second titre") + "<a href='https://autre.com/ol/un-tres-long-article-sur-le-club'>Un titre assez long pour un article</a><a href='/rugby/un-tres-long-article-sur-le-club'>Un titre assez long pour un article</a><a href='/ol/contact'>Un titre assez long pour un article</a><a href='/ol/un-autre-tres-long-article-du-club'>Court</a>"
    d = spark.createDataFrame([(1, "https://foot01.com/ol", "foot01", html)], "page_id int, url string, source_id string, html string")
    return P.discover_links(d, P.adapters(spark))


@query("""SELECT * FROM (VALUES (1, 'usable', NULL), (2, 'rejected', 'navigation_page'), (3, 'rejected', 'insufficient_title'), (4, 'needs_content', 'insufficient_content'), (5, 'rejected', 'navigation_page'), (6, 'usable', NULL)) t(id, status, reason)""")
def technical_golden(spark, sf_dir):
    """Pages before anything is read out of them."""
    long = "x" * 120
    rows = [(1, "https://a/x", "Un titre assez long", "", long), (2, "https://a/boutique/x", "Un titre assez long", "e", long), (3, "https://a/x", "Court", "e", long), (4, "https://a/x", "Un titre assez long", "", "court"), (5, "https://a/x", "Billetterie : tout savoir", "e", long), (6, "https://a/x", "Un titre assez long", "e", "")]
    d = spark.createDataFrame(rows, "id int, url string, title string, excerpt string, body string")
    status, reason = R.technical_status(*[F.col(c) for c in ("url", "title", "excerpt", "body")])
    return d.select("id", status.alias("status"), reason.alias("reason"))
