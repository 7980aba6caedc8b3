"""From an article to its events, in three layers that can each be asked for by version.

0.2 segments an article (lead, paragraphs, groups of sentences); each segment gives at most one event: its family, the
people and clubs it names, its stage and relations; neighbouring segments on the same matter are one event.
0.4 cleans the people, finds the article's dossier (what its title is about, and who), drops background and page furniture
from the body, gives events about the dossier's people its family, and joins events on one matter.
0.5 takes titles that name their subject outright: events that go on with the lead's dossier are joined to the lead.

One article is one call of pure Python, so articles spread over tasks freely; rows are independent, and a replay gives the
same identities.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from storyloom.operators import vocabulary as V

MOST_SEGMENTS, MOST_PEOPLE, MOST_CLUBS, MOST_TOKENS, MOST_TEXT, MOST_FRAGMENTS = 60, 3, 4, 24, 1800, 8


VERSIONS = ("0.2", "0.4", "0.5")


@lru_cache(maxsize=None)
def rx(pattern: str) -> re.Pattern:
    """Boundaries, word characters and digits are those of ASCII; letters are compared without case, accented ones too."""
    return re.compile(pattern.replace(r"\b", r"(?a:\b)").replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]"), re.I)


def _literals(parsed) -> list[str] | None:
    """Strings of which every match of a parsed pattern holds one, in lower case; None if none are sure. Of the places where
    such strings stand, the one whose shortest string is longest."""
    best, run = None, [""]

    def offer(found):
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in parsed:
        name, letters = str(op), None
        if name == "LITERAL":
            letters = [chr(value)]
        elif name == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
            letters = [chr(v) for _, v in value]
        if letters and len(run) * len(letters) <= 16:
            run = sorted({r + x.lower() for r in run for x in letters})
            continue
        offer(run)
        run = [x.lower() for x in letters] if letters else [""]
        if name == "BRANCH":
            parts = [_literals(branch) for branch in value[1]]
            offer(sorted({x for part in parts for x in part}) if all(parts) else None)
        elif name == "SUBPATTERN":
            offer(_literals(value[-1]))
        elif name == "MAX_REPEAT" and value[0] >= 1:
            offer(_literals(value[2]))
    offer(run)
    return best


@lru_cache(maxsize=None)
def _needles(pattern: str) -> tuple[str, ...]:
    found = _literals(re._parser.parse(rx(pattern).pattern, re.I)) or []
    return tuple(x for x in found if not any(y in x for y in found if y != x))


@lru_cache(maxsize=1024)
def _lowered(text: str) -> str | None:
    """In lower case; None if it holds a letter that patterns take for another one without it being that one's capital."""
    return text.lower() if text.isascii() or not any(c in text for c in "\u0130\u0131\u017f") else None


def has(pattern: str, text: str) -> bool:
    """Whether a pattern is found. Few texts hold any of the strings that its matches must hold; only those are searched."""
    needles, low = _needles(pattern), _lowered(text)
    if needles and low is not None:
        for x in needles:
            if x in low:
                break
        else:
            return False
    return bool(rx(pattern).search(text))


# The few entities that comparisons decode.
_ENTITIES = [
    (r"&nbsp;|&#160;", " "), (r"&amp;", "&"), (r"&quot;", '"'), (r"&#39;|&apos;", "'"), (r"&lt;", "<"), (r"&gt;", ">"), (r"&#8211;|&#x2013;", "-"), (r"&#8212;|&#x2014;", "-"),
]


_MARKS, _ADDRESS, _PLAIN = re.compile("[\u0300-\u036f]+"), re.compile(r"https?://\S+"), re.compile("[a-z0-9]+")


@lru_cache(maxsize=50_000)
def norm(text: str) -> str:
    text = text or ""
    for entity, plain in _ENTITIES if "&" in text else ():
        text = rx(entity).sub(plain, text)
    bare = (text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))).lower()
    return " ".join(_PLAIN.findall(_ADDRESS.sub(" ", bare) if "://" in bare else bare))


def unique(values) -> list[str]:
    """In order, one of each normal form."""
    out = {}
    for v in values:
        if norm(v):
            out.setdefault(norm(v), v)
    return list(out.values())


@dataclass
class Context:
    """The topics' clubs (name -> aliases) and the people known beforehand (names, or name -> aliases)."""

    clubs: dict[str, list[str]] = field(default_factory=dict)
    people: list[str] | dict[str, list[str]] = field(default_factory=list)

    def __post_init__(self):
        known = self.people if isinstance(self.people, dict) else {n: [] for n in self.people}
        self.known = [(n, [a for a in map(norm, unique([n, *aliases])) if len(a) >= 3]) for n, aliases in known.items()]
        named = {n: [n, *a] for n, a in self.clubs.items()}
        self.dictionary = [(n, [norm(a) for a in unique(a)]) for n, a in [*named.items(), *V.OTHER_CLUBS.items()]]
        self.terms = {t for n, a in self.dictionary for t in [norm(n), *a] if t}


@dataclass
class Event:
    family: str
    people: list[str]
    clubs: list[str]
    stage: str | None
    club_from: str | None
    club_to: str | None
    competition: str | None
    anchor: str | None
    opponents: list[str]
    kind: str
    segment: int
    fragments: list[str]
    tokens: list[str]
    discriminator: bool = False  # whether the family gave it a competition, an anchor or opponents of its own

    @property
    def text(self) -> str:
        return "\n".join(self.fragments)[:MOST_TEXT]


_FAMILY = {name: "|".join(patterns) for name, patterns in V.FAMILIES.items()}
_ANY_FAMILY = "|".join(_FAMILY.values())
_STOP, _NOT_PEOPLE = frozenset(V.STOP), frozenset(V.NOT_PEOPLE)


def family_of(text: str) -> str:
    if not has(_ANY_FAMILY, text):
        return "unknown"
    hit = {f: has(p, text) for f, p in _FAMILY.items()}
    for first in ("injury", "contract", "discipline", "institutional"):
        if hit[first]:
            return first
    in_staff = hit["staff"] and has(V.STAFF_ROLE, text)
    if in_staff and has(V.STAFF_ACTION, text):
        return "staff"
    if hit["transfer"] and not (hit["finance"] and has(V.FINANCE_CORE, text) and not has(V.TRANSFER_CORE, text)):
        return "transfer"
    order = (("finance", hit["finance"]), ("staff", in_staff), ("competition", hit["competition"]), ("match", hit["match"]), ("statement", hit["statement"]))
    return next((f for f, yes in order if yes), "unknown")


def clubs_of(text: str, context: Context) -> list[str]:
    padded, found = f" {norm(text)} ", []
    for name, aliases in context.dictionary:
        scores = [a.count(" ") + 1 + (len(a) > 5) for a in aliases if len(a) >= 2 and f" {a} " in padded]
        if scores:
            found.append((-max(scores), len(found), name))
    return [n for _, _, n in sorted(found)][:MOST_CLUBS]


_NAME = re.compile(r"\b([A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ'’-]{2,}(?:\s+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ'’-]{2,}){0,2})\b")


def _is_person(value: str, at: int, text: str, context: Context) -> bool:
    plain = norm(value)
    parts = plain.split()
    if not parts or any(p in _STOP or p in _NOT_PEOPLE for p in parts):
        return False
    if any(plain in t or t in plain for t in context.terms) or has(V.PLACE_IN_NAME, value):
        return False
    if len(parts) > 1:
        return True
    if len(value) < 5:
        return False
    before, after = text[max(0, at - 35) : at], text[at + len(value) : at + len(value) + 55]
    if has(V.DESTINATION_BEFORE, before):
        return False
    opens = at == 0 or bool(re.search(r"[.!?…]\s*$", before))
    return f" {norm(text)} ".count(f" {plain} ") >= 2 or has(V.ROLE_BEFORE, before) or opens and has(V.ACTION_AFTER, after)


def people_of(text: str, context: Context) -> list[str]:
    """Known people by how often they are named, then proper names by score."""
    padded = f" {norm(text)} ".replace(" ", "  ")
    counted = [(sum(padded.count(f" {a.replace(' ', '  ')} ") for a in aliases), name) for name, aliases in context.known]
    known = [name for n, name in sorted(counted, key=lambda c: -c[0]) if n]
    scores: dict[str, int] = {}
    for m in _NAME.finditer(text):
        value = m[1].strip()
        if _is_person(value, m.start(), text, context):
            scores[value] = scores.get(value, 0) + (4 if " " in norm(value) else 1)
    proper = sorted(scores, key=lambda v: -scores[v])[:MOST_PEOPLE]
    return list(dict.fromkeys([*known, *proper]))[:MOST_PEOPLE]


_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[A-ZÀ-ÖØ-Ý0-9«“\"])")


def sentences_of(text: str) -> list[str]:
    return [s for s in map(str.strip, _SENTENCE.split(text.strip())) if len(s) >= 18]


def regroup(block: str, context: Context) -> list[str]:
    """A long block as groups of sentences on one matter: a group ends where person or family changes, or at length."""
    found = sentences_of(block)
    if len(found) < 2:
        return [block]
    groups, now, facts = [], "", None
    for s in found:
        family = family_of(s)
        people = people_of(s, context) if family != "unknown" else []  # only then do they matter
        telling = family != "unknown" and bool(people or clubs_of(s, context))
        if not now:
            now, facts = s, (family, people, telling)
            continue
        turn = telling and facts[2] and (family != facts[0] or people[:1] and facts[1][:1] and norm(people[0]) != norm(facts[1][0]))
        if (turn or len(now) + len(s) > 620) and len(now) >= 45:
            groups.append(now)
            now, facts = s, (family, people, telling)
        else:
            now = f"{now} {s}"
            facts = (family, people, telling) if telling else facts
    return [*groups, now]


_BLOCK = re.compile(r"\n\s*\n+|\n(?=#{1,4}\s|[A-ZÀ-ÖØ-Ý][^\n]{3,80}:\s*$)|\n[-•]\s+", re.M)


def segments_of(title: str, excerpt: str, content: str, context: Context) -> list[tuple[str, str]]:
    title, excerpt, content = ((x or "").replace("\r", "").strip() for x in (title, excerpt, content))
    out = [("lead", ". ".join(x for x in (title, excerpt) if x))] if title or excerpt else []
    blocks = [b for b in map(str.strip, _BLOCK.split(content)) if len(b) >= 18]
    for b in blocks:
        parts = regroup(b, context) if len(b) > 420 or len(sentences_of(b)) >= 3 else [b]
        out += [("sentence_group" if len(parts) > 1 else "paragraph", p) for p in parts]
    if not blocks and content:
        out += [("sentence_group", p) for p in regroup(content, context)]
    return out[:MOST_SEGMENTS]


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in norm(text).split() if len(t) >= 4 and t not in _STOP and not t.isdigit()))[:MOST_TOKENS]


def _relations(text: str, clubs: list[str]) -> tuple[str | None, str | None]:
    plain, out = norm(text), {"from": None, "to": None}
    for c in clubs:
        name = re.escape(norm(c))
        if re.search(rf"(?:vers|rejoint|file a|file vers)\s+(?:le |la |l )?{name}", plain):
            out["to"] = c
        if re.search(rf"(?:quitte|depart de|provenance de)\s+(?:le |la |l )?{name}", plain):
            out["from"] = c
    return out["from"], out["to"]


def event_of(kind: str, index: int, text: str, context: Context) -> Event | None:
    family, clubs = family_of(text), clubs_of(text, context)
    if not clubs and family in ("unknown", "match", "competition"):
        return None
    people = people_of(text, context)
    named = {"unknown": bool(people and clubs and len(text) >= 40), "match": bool(clubs), "competition": bool(clubs)}
    named |= dict.fromkeys(("transfer", "contract", "injury", "staff", "statement"), bool(people))
    if not named.get(family, bool(people or clubs)):
        return None
    stage = next((s for s, p in V.STAGES[family] if has(p, text)), "unknown") if family in V.STAGES else None
    left, to = _relations(text, clubs) if family == "transfer" else (None, None)
    playing = family in ("match", "competition")
    competition = next((c for c, p in V.COMPETITIONS if has(p, text)), None) if playing else None
    m = (rx(V.MATCH_ROUND).search(text) or rx(V.MATCH_DAY).search(text)) if playing else None
    anchor = m[1] if m else " ".join(norm(text).split()[:18]) or None if family in ("discipline", "finance") else None
    return Event(family, people, clubs, stage, left, to, competition, anchor, clubs[:2] if family == "match" else [], kind, index, [text[:MOST_TEXT]], _tokens(text), playing or family in ("discipline", "finance"))


def _matter(e: Event) -> str:
    return "|".join(x for x in map(norm, [e.family, e.people[0] if e.people else "", *sorted(e.clubs), e.club_to or ""]) if x)


# -- 0.2 -----------------------------------------------------------------------------------------------------------------
def segment_events(title: str, excerpt: str, content: str, context: Context) -> list[Event]:
    found: list[Event] = []
    for i, (kind, text) in enumerate(segments_of(title, excerpt, content, context)):
        e = event_of(kind, i, text, context)
        if e and found and _matter(found[-1]) == _matter(e):
            found[-1].fragments += e.fragments
            found[-1].tokens = _tokens(found[-1].text)
        elif e:
            found.append(e)
    return found


# -- 0.4 -----------------------------------------------------------------------------------------------------------------
def _clean_people(e: Event) -> list[str]:
    clubs, out = set(map(norm, e.clubs)), []
    for p in e.people:
        p = re.sub(r"^[«“”\"'`]+|[»“”\"'`,:;.!?]+$", "", " ".join(p.split())).strip()
        p = rx(V.NAME_PREFIX_04).sub("", p).strip()
        if p and norm(p) not in clubs and not any(has(x, p) for x in (V.NO_PERSON_04, V.ORGANISATION_04, V.PRONOUN_04)):
            out.append(p)
    return unique(out)


def _in_title(person: str, title: str) -> bool:
    plain, padded = norm(person), f" {norm(title)} "
    last = plain.split()[-1] if plain else ""
    return bool(plain) and (f" {plain} " in padded or len(last) >= 5 and f" {last} " in padded)


def _kin(table: dict[str, list[str]], dossier: str, family: str) -> bool:
    return family in (dossier, "unknown", "statement") or family in table.get(dossier, ())


#: What a title is about, first hit; the fourth asks whether the lead is about staff.
_TITLE_LADDER = (
    (V.TITLE_INJURY_04, "injury"),
    (V.TITLE_DISCIPLINE_04, "discipline"),
    (V.TITLE_STRONG_TRANSFER_04, "transfer"),
    (V.TITLE_TRANSFER_04, "staff"),
    (V.TITLE_STAFF_04, "staff"),
    (V.TITLE_TRANSFER_04, "transfer"),
    (V.TITLE_CONTRACT_04, "contract"),
    (V.TITLE_FINANCE_04, "finance"),
    (V.TITLE_COMPETITION_04, "competition"),
    (V.TITLE_MATCH_04, "match"),
)


def dossier_of(title: str, lead_family: str) -> str:
    for i, (pattern, family) in enumerate(_TITLE_LADDER):
        if (i != 3 or lead_family == "staff") and has(pattern, title):
            return family
    return lead_family


_TITLE_STOP = frozenset(V.TITLE_STOP_04)


def _telling(text: str) -> set[str]:
    return {t for t in norm(text).split() if len(t) >= 4 and t not in _TITLE_STOP and not t.isdigit()}


def _about(e: Event, heroes: list[str]) -> bool:
    return bool({norm(p) for p in e.people} & {norm(h) for h in heroes})


def _furniture(flat: str) -> bool:
    asks = len(flat) <= 121 and flat.endswith("?") and not has(V.ACTION_04, flat)
    return not flat or has(V.BODY_NOISE, flat) or asks or has(V.BODY_OPENING, flat)


def _central(e: Event, title: str, lead: Event | None, heroes: list[str], dossier: str) -> bool:
    """Whether an event of the body is news of this article and not its background."""
    if _furniture(" ".join(e.text.split())) or has(V.PREVIEW_TITLE, title):
        return False
    news = has(V.ACTION_04, e.text) and not has(V.BACKGROUND, e.text)
    if has(V.ROUNDUP_TITLE, title):
        return e.family != "unknown" and news
    words = len(_telling(title) & _telling(e.text))
    if _about(e, heroes):
        near = _kin(V.KIN_04, dossier, e.family) if dossier != "unknown" else e.family in ("unknown", "statement")
        return near or news and e.family not in (dossier, "unknown", "statement") and (e.family in V.RUPTURES_04 or words >= 2)
    same = lead is not None and e.family == lead.family
    clubs = len(set(map(norm, e.clubs)) & set(map(norm, lead.clubs if lead else [])))
    if same and clubs >= 2:
        return True
    return news and (same and words >= 2 or not heroes and same and clubs >= 1 and words >= 1 or e.family != "unknown" and words >= 3)


def _join_by_matter(events: list[Event], heroes: list[str]) -> list[Event]:
    """Events of one family about one person (or else one set of clubs) are one; what comes later says how far it is."""
    out: dict[str, Event] = {}
    for e in events:
        names = set(map(norm, e.people))
        who = next((norm(h) for h in heroes if norm(h) in names), norm(e.people[0]) if e.people else "")
        first = out.setdefault((e.family, who or sorted(filter(None, map(norm, e.clubs)))[:2]).__repr__(), e)
        if first is e:
            continue
        first.people = unique([*first.people, *e.people])[:MOST_PEOPLE]
        first.clubs = unique([*first.clubs, *e.clubs])[:MOST_CLUBS]
        first.fragments = list(dict.fromkeys([*first.fragments, *e.fragments]))[:MOST_FRAGMENTS]
        first.stage = next((s for s in (e.stage, first.stage) if s and s != "unknown"), first.stage)
        first.club_from, first.club_to = e.club_from or first.club_from, e.club_to or first.club_to
        if not first.discriminator:
            first.competition, first.anchor, first.opponents, first.discriminator = e.competition, e.anchor, e.opponents, e.discriminator
        first.tokens = list(dict.fromkeys([*first.tokens, *e.tokens]))[:MOST_TOKENS]
    return list(out.values())


def central_events(found: list[Event], title: str) -> list[Event]:
    for e in found:
        e.people = _clean_people(e)
    lead = next((e for e in found if e.kind == "lead"), None)
    people = lead.people if lead else []
    heroes = ([p for p in people if _in_title(p, title)] or people[:1])[:MOST_PEOPLE]
    dossier = dossier_of(title, lead.family if lead else "unknown")
    kept = [e for e in found if e.kind == "lead" or _central(e, title, lead, heroes, dossier)]
    if heroes and dossier != "unknown" and not has(V.ROUNDUP_TITLE, title):
        for e in kept:
            if e.kind == "lead" or _about(e, heroes) and _kin(V.KIN_04, dossier, e.family):
                e.family = dossier
    return _join_by_matter(kept, heroes)


# -- 0.5 -----------------------------------------------------------------------------------------------------------------
_OUTRIGHT = (
    (V.TITLE_INJURY_05, "injury"),
    (V.TITLE_GENERIC_INJURY_05, "injury"),
    (V.TITLE_DISCIPLINE_05, "discipline"),
    (V.TITLE_FINANCE_05, "finance"),
    (V.TITLE_STAFF_05, "staff"),
    (V.TITLE_CONTRACT_05, "contract"),
    (V.TITLE_TRANSFER_05, "transfer"),
    (V.TITLE_STATEMENT_05, "statement"),
)


def subject_of(title: str, events: list[Event]) -> str | None:
    """The family that a title names outright; a "hard blow" is an injury if the article tells of one."""
    if not title or has(V.ROUNDUP_TITLE, title):
        return None
    for pattern, family in _OUTRIGHT:
        if has(pattern, title) and (pattern != V.TITLE_GENERIC_INJURY_05 or any(e.family == "injury" for e in events)):
            return family
    return None


def _goes_on(e: Event, lead: Event, hero: str | None, subject: str) -> bool:
    """Whether an event goes on with the lead's dossier."""
    if e is lead or e.kind == "lead":
        return True
    if not _kin(V.KIN_05, subject, e.family):
        return False
    names = set(map(norm, e.people))
    if hero and norm(hero) in names or names & set(map(norm, lead.people)):
        return True
    if not set(map(norm, e.clubs)) & set(map(norm, lead.clubs)):
        return False
    if not e.people:  # "he", "the player": the paragraph says what happened, not to whom
        return e.family == subject or has(V.ACTION_05, e.text)
    return not lead.people and e.family == subject


def targeted_events(events: list[Event], title: str) -> list[Event]:
    for e in events:
        e.people = [p for p in unique(e.people) if not has(V.NO_PERSON_05, p.strip())]
        e.clubs = unique(e.clubs)
    subject = subject_of(title, events)
    if not events or not subject:
        return events
    lead = next((e for e in events if e.kind == "lead"), events[0])
    hero = next((p for p in lead.people if _in_title(p, title)), lead.people[0] if lead.people else None)
    going = {id(e) for e in events if _goes_on(e, lead, hero, subject)}
    for e in events:
        if id(e) in going and _kin(V.KIN_05, subject, e.family):
            if e.family != subject:
                e.family, e.stage, e.club_from, e.club_to = subject, "unknown", None, None
                e.competition, e.anchor, e.opponents, e.discriminator = None, None, [], False
            if e.kind != "lead" and hero and not e.people:
                e.people = [hero]
    if lead.kind != "lead":
        return events
    out = []
    for e in events:
        if e is lead or id(e) not in going or e.family != lead.family:
            out.append(e)
            continue
        lead.people = unique([*lead.people, *e.people])[:MOST_PEOPLE]
        lead.clubs = unique([*lead.clubs, *e.clubs])[:MOST_CLUBS]
        lead.fragments = unique([*lead.fragments, *e.fragments])[:MOST_FRAGMENTS]
        if lead.stage in (None, "unknown") and e.stage not in (None, "unknown"):
            lead.stage = e.stage
        lead.tokens = unique([*lead.tokens, *e.tokens])[:MOST_TOKENS]
    return out


def extract_article(title: str, excerpt: str, content: str, context: Context, version: str = VERSIONS[-1]) -> list[Event]:
    """The events of an article, by one version's layers."""
    if version not in VERSIONS:
        raise ValueError(f"no version {version}")
    title = (title or "").strip()
    found = segment_events(title, excerpt, content, context)
    if version >= "0.4":
        found = central_events(found, title)
    return targeted_events(found, title) if version == "0.5" else found


def identity(article_id, title: str | None, e: Event) -> str:
    """The same for the same event however its people, clubs and tokens are ordered; title and evidence count, the
    dictionary it was found with does not."""
    parts = {
        "title": (title or "").strip(), "family": e.family, "stage": e.stage or "unknown", "people": sorted(map(norm, e.people)), "clubs": sorted(map(norm, e.clubs)),
        "from": norm(e.club_from or ""), "to": norm(e.club_to or ""), "competition": e.competition, "anchor": e.anchor, "opponents": sorted(map(norm, e.opponents)),
        "kind": e.kind, "fragments": e.fragments, "tokens": sorted(e.tokens),
    }
    inner = hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    return hashlib.sha256(f"event:v1\0{article_id}\0{inner}".encode()).hexdigest()


SCHEMA = (
    "article_id long, event_id string, family string, stage string, people array<string>, clubs array<string>, club_from string, club_to string, "
    "competition string, anchor string, opponents array<string>, kind string, segment int, text string, fragments int, tokens array<string>"
)


def extract(articles: DataFrame, context: Context | None = None, version: str = VERSIONS[-1]) -> DataFrame:
    """One row per event of (id, title, excerpt, content); an article that gives none gives no row."""
    context = context or Context()

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t, x, c in zip(pdf.id, pdf.title, pdf.excerpt, pdf.content):
                for e in extract_article(t, x, c, context, version):
                    rows.append((i, identity(i, t, e), e.family, e.stage, e.people, e.clubs, e.club_from, e.club_to, e.competition, e.anchor, e.opponents, e.kind, e.segment, e.text, len(e.fragments), e.tokens))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return articles.select("id", "title", "excerpt", "content").mapInPandas(run, SCHEMA)
