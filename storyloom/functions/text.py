"""Text expressions: JVM-side columns that never leave whole-stage code generation for Python.

Regular expressions follow three rules so that they mean the same on every engine: white space is an explicit class
that includes the no-break space, case folding is always Unicode-aware, and word boundaries are spelled out as
look-arounds over letters and digits.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers and scripts see it: ASCII, no-break space, BOM, the Unicode spaces and line separators.
WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
NOT_LETTER_OR_DIGIT = r"[^\p{L}\p{N}]"


def compact(x: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), WS + "+", " "))


def _fold_table() -> tuple[str, str]:
    """Composed Latin letters and the base letters they decompose to."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and unicodedata.combining(base[1]) and base[0].isascii():
            source.append(chr(point))
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), r"[\x{0300}-\x{036F}]", "")


def key_normal(x: Column) -> Column:
    """Accent-free lower case, everything else but letters and digits of ASCII a single space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def decode_basic_entities(x: Column) -> Column:
    """A text without an ampersand, as most are, is left alone."""
    out = x
    for pattern, to in (
        ("(?i)&nbsp;|&#160;", " "),
        ("(?i)&amp;", "&"),
        ("(?i)&quot;", '"'),
        ("(?i)&#39;|&apos;", "'"),
        ("(?i)&lt;", "<"),
        ("(?i)&gt;", ">"),
        ("(?i)&#821[12];|&#x201[34];", "-"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.when(x.contains("&"), out).otherwise(x)


def topic_normal(x: Column) -> Column:
    """`key_normal` after basic entities are decoded and web addresses dropped."""
    decoded = F.lower(strip_accents(decode_basic_entities(F.coalesce(x, F.lit("")))))
    bare = F.when(decoded.contains("://"), F.regexp_replace(decoded, r"https?://\S+", " ")).otherwise(decoded)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


#: Words that never tell one story from another.
STOPWORDS = """
a afin ainsi alors apres au aucun aussi autre aux avec avoir car ce ces cet cette chez comme comment dans de des du elle
en encore entre est et etre fait font il ils je la le les leur leurs lui mais mes moins mon ne nos notre nous on ou par
pas plus pour pourquoi quand que quel quelle quelles quels qui sa sans se ses si son sont sur ta te tes ton tous tout
toute toutes tu un une vos votre vous football foot ligue championnat match club equipe joueur joueurs mercato transfert
transferts actualite direct officiel officielle france sport info infos news dossier dossiers fermeture marche ete hiver
avant defenseur milieu attaquant gardien avance anime cible ciblee cibles million millions euros euro saison journee j
c1 c3
""".split()


def tokens(x: Column, ignored: list[str] | None = None) -> Column:
    """Distinct tokens of three letters or more that are neither ignored nor one- or two-digit numbers, in order."""
    ignore = sorted({*STOPWORDS, *(ignored or ())})
    kept = F.filter(words(topic_normal(x)), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d{1,2}$"))
    return F.array_except(F.array_distinct(kept), F.split(F.lit(" ".join(ignore)), " "))


def terms(x: Column) -> Column:
    """Tokens of three letters or more that are not plain numbers, in order, repeats included."""
    return F.filter(words(topic_normal(x)), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))


def fingerprint_tokens(x: Column, most: int = 24, stop: list[str] | None = None) -> Column:
    """The first `most` distinct tokens of four letters or more that are not plain numbers."""
    kept = F.filter(words(topic_normal(x)), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d+$"))
    return F.slice(F.array_except(F.array_distinct(kept), F.array(*[F.lit(s) for s in stop or ("mercato", "football")])), 1, most)


def alias_pattern(alias: str) -> str:
    """An alias between characters that are neither letters nor digits; a boundary character is used up by its match."""
    quoted = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", alias)
    return f"(?iu)(^|{NOT_LETTER_OR_DIGIT}){quoted}({NOT_LETTER_OR_DIGIT}|$)"


def alias_pattern_column(alias: Column) -> Column:
    quoted = F.regexp_replace(alias, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(f"(?iu)(^|{NOT_LETTER_OR_DIGIT})"), quoted, F.lit(f"({NOT_LETTER_OR_DIGIT}|$)"))


def alias_count(x: Column, alias: Column) -> Column:
    return F.regexp_count(compact(x), alias_pattern_column(alias))


def alias_context(x: Column, alias: Column, radius: int = 120) -> Column:
    """The text around the first plain occurrence of the alias, with an ellipsis where it is cut; null without one."""
    value = compact(x)
    at = F.instr(F.lower(value), F.lower(alias))
    begin = F.greatest(at - 1 - radius, F.lit(0))
    end = F.least(F.char_length(value), at - 1 + F.char_length(alias) + radius)
    body = F.trim(F.substring(value, begin + 1, end - begin))
    text = F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(end < F.char_length(value), F.lit("…")).otherwise(F.lit("")))
    return F.when(at > 0, text)


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>", " ")
    return compact(decode_basic_entities(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def first_tag_text(html: Column, *names: str) -> Column:
    """The text of the first tag of the first name that has any; null if none does."""
    return F.coalesce(*[F.nullif(strip_tags(F.regexp_extract(html, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1)), F.lit("")) for n in names])


def meta_content(html: Column, names: str) -> Column:
    """The first non-empty content of a meta tag whose name or property matches `names`; null if none does."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
    named = F.filter(tags, lambda t: F.regexp_extract(t, r"(?i)\b(?:name|property)\s*=\s*[\"']([^\"']+)[\"']", 1).rlike(names))
    contents = F.transform(named, lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"'](.*?)[\"']", 1))
    return compact(decode_basic_entities(F.get(F.filter(contents, lambda c: c != ""), F.lit(0))))


def main_text(html: Column) -> Column:
    """The paragraphs of twenty characters or more of the article (or main) element, joined."""
    body = F.coalesce(
        F.nullif(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")),
        F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main>", 1),
    )
    paragraphs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    return compact(F.array_join(F.filter(paragraphs, lambda p: F.char_length(p) >= 20), "\n\n"))


def canonical_url(url: Column) -> Column:
    """Without fragment and without tracking parameters (utm_*, fbclid, gclid); other parameters keep their order."""
    bare = F.regexp_replace(url, r"#.*$", "")
    without = F.regexp_replace(bare, r"(?i)(?<=[?&])(?:utm_[^=&]*|fbclid|gclid)(?:=[^&]*)?(?:&|$)", "")
    return F.regexp_replace(without, r"[?&]$", "")


#: Fragments that give away stored editorial noise.
NOISE = (
    "&#", "&amp;", "&rsquo;", "&lsquo;", "&rdquo;", "&ldquo;", "&hellip;", "&ndash;", "&mdash;", "&eacute;", "&egrave;",
    "&agrave;", "&ccedil;", "The post", "first appeared on But! Football Club", "pour lire la suite",
    "Ce contenu est bloqué", "{'skus':",
)

#: Entities that stored titles and excerpts may still hold.
STORED_ENTITIES = ("&#", "&rsquo;", "&lsquo;", "&rdquo;", "&ldquo;", "&ndash;", "&mdash;", "&hellip;", "&laquo;", "&raquo;", "&amp;#")


def contains_any(fragments, *columns: Column, fold: bool = False) -> Column:
    """Whether any column contains any fragment; false for nulls."""
    out = F.lit(False)
    for c in columns:
        for n in fragments:
            out = out | F.coalesce((F.lower(c) if fold else c).contains(n), F.lit(False))
    return out


_NOISE_PATTERN = (
    r"(?is)&#(?:x[0-9a-f]+|[0-9]+);?|&(?:amp|rsquo|lsquo|rdquo|ldquo|hellip|ndash|mdash|eacute|egrave|agrave|ccedil);"
    r"|The post\b.*?first appeared on But! Football Club|pour lire la suite, rejoignez notre communauté d'abonnés"
    r"|Ce contenu est bloqué car vous n'avez pas accepté les cookies|\{\s*['\"]skus['\"]\s*:"
)


def has_noise(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(_NOISE_PATTERN)


def clean_editorial(x: Column, source: Column) -> Column:
    """Tags and stock phrases removed; what counts as a stock phrase depends on the source."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    regional = F.regexp_replace(bare, r"(?is)Ce contenu est bloqué car vous n'avez pas accepté les cookies et autres traceurs\..*?Gérer mes choix", " ")
    regional = F.regexp_replace(regional, r"(?is)(?:\.{3}|…)?\s*pour lire la suite, rejoignez notre communauté d'abonnés.*$", "")
    regional = F.regexp_replace(regional, r"(?i)\{\s*['\"]skus['\"]\s*:\s*\[[^\]]*\]\s*\}", " ")
    feed = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*Lire plus\s*(?=The post\b)", " "), r"(?is)\s*The post\s+.*?\s+first appeared on But! Football Club\s*\.?\s*$", "")
    return compact(F.when(F.lower(source) == "leprogres", regional).when(F.lower(source) == "butfootballclub", feed).otherwise(bare))


def stable_title(title: Column, source: Column) -> Column:
    """A title without what a source's listing adds to it and changes as the item ages."""
    value = compact(decode_basic_entities(F.coalesce(title, F.lit(""))))
    clock = F.regexp_replace(value, r"(?i)^(?:(?:[01]?\d|2[0-3]):[0-5]\d|\d{2}/\d{2})\s+Football\s+", "")
    card = F.regexp_replace(value, r"(?i)\s*•\s*(?:(?:[01]?\d|2[0-3])h[0-5]\d|\d{2}/\d{2})\s*$", "")
    card = F.regexp_replace(card, r"(?i)(?<![\p{L}\p{N}_])(Mercato|Ligue 1|Ligue 2|Ligue Europa|Ligue des Champions|Anciens|OL)\s*•\s*\1(?![\p{L}\p{N}_])", "$1")
    return compact(F.when(source == "sports_orange", clock).when(source == "madeingones", card).otherwise(value))


def page_fields(html: Column, title: Column, excerpt: Column, author: Column, published: Column, image: Column) -> dict[str, Column]:
    """What a page says of itself, else what its listing said."""
    some = lambda x: F.nullif(x, F.lit(""))
    pick = lambda names, *rest: F.coalesce(some(meta_content(html, names)), *rest)
    return {
        "title": some(compact(pick("(?i)^(?:og:title|twitter:title)$", first_tag_text(html, "h1", "title"), title))),
        "excerpt": some(compact(pick("(?i)^(?:description|og:description|twitter:description)$", excerpt))),
        "author": some(compact(pick("(?i)^(?:author|article:author)$", author))),
        "published_at": pick("(?i)^(?:article:published_time|date|datepublished)$", published),
        "content": some(main_text(html)),
        "image_url": pick("(?i)^(?:og:image|twitter:image)$", image),
    }


def clip(x: Column, most: int) -> Column:
    return F.substring(compact(x), 1, most)


def error_text(x: Column) -> Column:
    """An error message on one line, 1200 characters at most."""
    return clip(F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown error")), 1200)


def stable_json(**fields: Column) -> Column:
    """JSON of the fields in alphabetical order, nulls written out, so that equal values hash alike."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws(":", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def is_suspicious(title: Column, url: Column) -> Column:
    """Stored rows that look like navigation."""
    t, u = F.lower(title), F.lower(url)
    out = t.isin("se connecter", "connexion", "accueil", "calendrier", "classement") | t.like("calendrier%") | t.like("classement%")
    for part in ("/login", "/connexion", "/calendrier", "/classement"):
        out = out | u.contains(part)
    return F.coalesce(out, F.lit(False))
