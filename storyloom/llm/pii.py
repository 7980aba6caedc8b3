"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (`email`, `ip`, `card`, `phone`) follow fixed patterns and are kept whatever their score. The scored
proposals add `iban` (mod-97), `ssn`, `secret`, and cards and phones that the base patterns miss because they stand in
a longer run of digits or lack the leading plus.

Defined results: a null or empty text has no spans; every text is read whole; scanners are linear in the text's length
(no pattern restarts inside a run it has rejected), so one very long word costs no more than many short ones. Rows are
independent: repeated rows give repeated results, other columns pass through untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
THRESHOLD = 0.6
REACH = 48  # code points of context looked at on either side

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_WORD = re.compile(r"[a-z]+")

# Context words that speak for, or against, a kind.
FOR = {
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "cvv", "cc", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "contact", "whatsapp"},
    "iban": {"iban", "account", "bank", "bic", "swift", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "secret", "key", "apikey", "api", "password", "passwd", "pwd", "bearer", "auth", "credential"},
}
AGAINST = {"isbn", "order", "invoice", "version", "sku", "serial", "sha", "md", "commit", "checksum", "hash"}
# What the pattern alone is worth, and what a passed checksum adds.
PRIOR = {"card": (0.2, 0.5), "phone": (0.55, 0.0), "iban": (0.2, 0.6), "ssn": (0.45, 0.0), "secret": (0.3, 0.0)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rolled = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in rolled)) % 97 == 1


def _emails(text: str):
    """Leftmost matches of local@domain, found from each @ so that a long run of local characters is read once."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
            at = text.find("@", after)
        else:
            after = max(after, at + 1)
            at = text.find("@", at + 1)


def _ips(text: str):
    """Four numbers joined by dots; of a longer dotted run, each four in turn."""
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        pos, parts = m.start(), run.split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = pos + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in four):
                yield pos, end
            pos = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end()


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), m.end()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed; code points, end exclusive."""
    found = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, e, "ip") for s, e in _ips(text)]
        found += [(s, e, "card") for s, e in _cards(text)]
        found += [(s, e, "phone") for s, e in _phones(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _proposals(text: str):
    """(start, end, kind, a checksum confirms it)"""
    for m in _CARD.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"[0-9]+", m.group())]
        if len(groups) < 2:
            continue
        for i, (s, _) in enumerate(groups):
            n = 0
            for a, e in groups[i:]:
                n += e - a
                if n > 19:
                    break
                if n >= 13 and luhn(re.sub(r"[^0-9]", "", text[s:e])):
                    yield s, e, "card", True
    for m in _IBAN.finditer(text):
        s, e = m.span()
        while e - s >= 15:
            compact = text[s:e].replace(" ", "")
            if len(compact) >= 15 and mod97(compact):
                yield s, e, "iban", True
                break
            e = text.rfind(" ", s, e)
    for kind, pattern in (("ssn", _SSN), ("phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind, False
    for m in _SECRET.finditer(text):
        value = m.group()
        if _DIGIT.search(value) and re.search(r"[A-Za-z]", value):
            yield m.start(), m.end(), "secret", False


def score(text: str, start: int, end: int, kind: str, confirmed: bool) -> float:
    """Prior of the pattern, plus the checksum's worth, moved by the words nearby."""
    prior, check = PRIOR[kind]
    near = set(_WORD.findall(f"{text[max(0, start - REACH) : start]} {text[end : end + REACH // 2]}".lower()))
    return prior + check * confirmed + 0.35 * bool(near & FOR[kind]) - 0.25 * bool(near & AGAINST)


def all_spans(text: str) -> tuple[list, list]:
    """The base spans, and those with the scored ones that overlap no span before them."""
    base = base_spans(text)
    if not _DIGIT.search(text):
        return base, base
    taken, added = _merged(base), []  # disjoint, in order
    ranked = sorted((-score(text, *p), p[0], -p[1], p[2]) for p in _proposals(text))
    for minus, s, e, kind in ranked:
        e, at = -e, bisect.bisect_left(taken, (s, s))
        free = (at == len(taken) or taken[at][0] >= e) and (at == 0 or taken[at - 1][1] <= s)
        if -minus >= THRESHOLD and free:
            taken.insert(at, (s, e))
            added.append((s, e, kind))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str) -> str:
    """`text` with every span replaced by its kind in brackets; overlapping spans are joined under the first's kind."""
    out, at, merged = [], 0, []
    for s, e, k in all_spans(text)[1]:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, of every whole text."""

    def run(blocks):
        for ids, texts in blocks:
            out = {k: [] for k in ("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans")}
            for i, text in zip(ids, texts):
                base, every = all_spans(text or "")
                out["doc_id"].append(i)
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
                out["n_spans"].append(len(every))
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced and `n_chars` brought up to date; a null text stays null."""
    names = docs.columns

    def run(blocks):
        for cols in blocks:
            out = dict(zip(names, cols))
            out["text"] = [None if t is None else redact(t) for t in out["text"]]
            if "n_chars" in out:
                out["n_chars"] = [n if t is None else len(t) for n, t in zip(out["n_chars"], out["text"])]
            yield out

    return arrow_map(docs, run, _ddl(docs))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
