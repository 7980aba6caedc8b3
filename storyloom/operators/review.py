"""Contracts with language models, and the checks around their answers.

No model is called here: prompts are built, answers are parsed strictly, and an answer that breaks the contract becomes
an error code in a row of its own instead of an exception that would stop a batch.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: What a club may be to an article.
ROLES = ("subject", "transfer_party", "financial_stakeholder", "opponent", "historical_reference", "relative_or_personal_link", "incidental", "unclear")
MOST_CANDIDATES, MOST_MEMBERS = 4, 3


def role_request(topic: str, aliases: list[str], title: str, field: str | None, texts: dict[str, str], alias: str | None) -> str:
    """The question about one topic's role, as JSON; texts are cut to what the question needs."""
    return json.dumps({"club_id": topic, "aliases": aliases, "title": (title or "")[:300], "matched_alias": alias, "matched_field": field, "match_context": (texts.get("context") or "")[:500] or None, "matched_text": (texts.get(field) or texts.get("context") or "")[:700], "allowed_roles": ROLES}, ensure_ascii=False)


def _unwrap(raw):
    """An answer's JSON value: out of a response field and of a code fence."""
    if isinstance(raw, dict) and "response" in raw:
        raw = raw["response"]
    if isinstance(raw, str):
        raw = json.loads(re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", raw.strip(), flags=re.I)).strip())
    return raw if isinstance(raw, dict) else {}


def _confidence(value) -> float | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return round(x, 3) if math.isfinite(x) and 0 <= x <= 1 else None


def parse_role(raw) -> dict:
    """{role, confidence, rationale}; ValueError with a code if the answer breaks the contract."""
    value = _unwrap(raw)
    role, confidence, why = str(value.get("role") or "").strip(), _confidence(value.get("confidence")), str(value.get("rationale") or "").strip()
    for bad, code in ((role not in ROLES, "invalid_role"), (confidence is None, "invalid_confidence"), (not 0 < len(why) <= 500, "invalid_rationale")):
        if bad:
            raise ValueError(code)
    return {"role": role, "confidence": confidence, "rationale": why}


def _club_pair(clubs: Iterable[str] | None) -> tuple[str, ...] | None:
    names = {str(c or "").strip() for c in clubs or ()} - {""}
    return tuple(sorted(n.lower() for n in names)) if len(names) == 2 else None


def parse_arbitration(raw, event_id: str, members: dict[str, list[str]], clubs: dict[str, list[str]]) -> dict:
    """An answer about one event's story; `members` are the representative events of each candidate story, `clubs` those
    of every event shown. To attach, the answer has to cite the event and a member of the story chosen, and a fixture of
    two clubs is never attached to cited members that are all fixtures of two others."""
    value = _unwrap(raw)
    decision, story = str(value.get("decision") or "").strip(), value.get("story_id")
    story = None if story is None else str(story).strip()
    confidence, why, cited = _confidence(value.get("confidence")), str(value.get("rationale") or "").strip(), value.get("evidence_event_ids")
    cited = list(dict.fromkeys(x for x in (str(c).strip() for c in cited) if x)) if isinstance(cited, list) else None

    def need(ok: bool, code: str) -> None:
        if not ok:
            raise ValueError(code)

    need(decision in ("attach", "new_story", "unsure"), "invalid_ai_decision")
    need(confidence is not None, "invalid_ai_confidence")
    need(0 < len(why) <= 700, "invalid_ai_rationale")
    need(cited is not None and len(cited) <= 8, "invalid_ai_evidence_ids")
    if decision == "attach":
        need(story in members, "ai_story_not_in_candidate_set")
        need(bool(cited), "ai_attach_without_evidence")
        need(event_id in cited, "ai_attach_missing_new_event_evidence")
        need(bool(members[story]), "ai_attach_without_story_member_evidence")
        shown = [m for m in members[story] if m in cited]
        need(bool(shown), "ai_attach_missing_story_evidence")
        own, others = _club_pair(clubs.get(event_id)), [p for p in (_club_pair(clubs.get(m)) for m in shown) if p]
        need(not own or not others or own in others, "ai_attach_club_pair_mismatch")
    else:
        need(not story, "ai_non_attach_has_story_id")
    need(set(cited) <= {event_id, *(m for ms in members.values() for m in ms)}, "ai_unknown_evidence_event")
    return {"decision": decision, "story_id": story, "confidence": confidence, "rationale": why, "evidence_event_ids": cited}


_PARSED = S.StructType([S.StructField(n, S.DoubleType() if n == "confidence" else S.StringType()) for n in ("role", "confidence", "rationale", "error")])


@F.pandas_udf(_PARSED)
def parse_roles(raw: pd.Series) -> pd.DataFrame:
    """`parse_role` over a column; what breaks the contract has its code in `error`."""

    def one(x):
        try:
            return {**parse_role(x), "error": None}
        except ValueError as e:  # a JSON error is one, too
            return {"role": None, "confidence": None, "rationale": None, "error": str(e) if str(e).startswith("invalid_") else "invalid_json"}

    return pd.DataFrame([one(x or "") for x in raw], columns=["role", "confidence", "rationale", "error"])


_ARBITRATED = S.StructType([S.StructField(n, S.DoubleType() if n == "confidence" else S.StringType()) for n in ("decision", "story_id", "confidence", "evidence", "error")])


@F.pandas_udf(_ARBITRATED)
def parse_arbitrations(raw: pd.Series, event: pd.Series, members: pd.Series, clubs: pd.Series) -> pd.DataFrame:
    """`parse_arbitration` over columns; `members` and `clubs` are JSON objects."""

    def one(x, e, m, c):
        try:
            v = parse_arbitration(x or "", e, json.loads(m), json.loads(c))
        except ValueError as err:
            code = str(err)
            return None, None, None, None, code if code.startswith(("invalid_ai_", "ai_")) else "invalid_json"
        return v["decision"], v["story_id"], v["confidence"], ",".join(v["evidence_event_ids"]), None

    return pd.DataFrame([one(*r) for r in zip(raw, event, members, clubs)], columns=["decision", "story_id", "confidence", "evidence", "error"])


def snapshot_state(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """`candidates` (story_id, member_count, revision) with `state`: valid, candidate_story_inactive or
    candidate_snapshot_changed against `stories` (story_id, status, merged_into, member_count, revision)."""
    now = stories.select("story_id", F.col("status").alias("__status"), F.col("merged_into").alias("__into"), F.col("member_count").alias("__count"), F.col("revision").alias("__revision"))
    j = candidates.join(now, "story_id", "left")
    gone = F.col("__status").isNull() | (F.col("__status") != "active") | F.col("__into").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = (zero("member_count") == zero("__count")) & (zero("revision") == zero("__revision"))
    return j.withColumn("state", F.when(gone, "candidate_story_inactive").when(~same, "candidate_snapshot_changed").otherwise("valid")).drop("__status", "__into", "__count", "__revision")


def representatives(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """The best stories of each event and the first members of each: (event_id, story_id, place, member_id, member_place)
    from (event_id, story_id, hybrid) and (story_id, member_id, rank)."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc_nulls_last("hybrid"), "story_id"))
    best = candidates.withColumn("place", place).where(F.col("place") <= MOST_CANDIDATES)
    first = members.withColumn("member_place", F.row_number().over(Window.partitionBy("story_id").orderBy("rank", "member_id"))).where(F.col("member_place") <= MOST_MEMBERS)
    return best.join(first, "story_id", "left").select("event_id", "story_id", "place", "member_id", "member_place")


# -- gates ---------------------------------------------------------------------------------------------------------------
def gate_features(a: str, b: str) -> dict[str, Column]:
    """What two events (columns prefixed a and b: people, clubs, relations, opponents as normal arrays, anchor, procedure,
    competition, family) have in common or against one another."""
    col = lambda side, name: F.col(f"{side}{name}")
    overlap = lambda n: F.size(F.array_intersect(col(a, n), col(b, n)))
    both = lambda n: (F.coalesce(col(a, n), F.lit("")) != "") & (F.coalesce(col(b, n), F.lit("")) != "")
    out = {f"{n}_overlap": overlap(n) for n in ("people", "clubs", "relations", "opponents")}
    for n in ("anchor", "procedure", "competition"):
        out |= {f"{n}_equal": both(n) & (col(a, n) == col(b, n)), f"{n}_conflict": both(n) & (col(a, n) != col(b, n))}
    first = lambda side, other: F.array_contains(col(other, "people"), F.get(col(side, "people"), F.lit(0)))
    out["subject_cross"] = (F.size(col(a, "people")) > 0) & (F.size(col(b, "people")) > 0) & (F.coalesce(first(a, b), F.lit(False)) | F.coalesce(first(b, a), F.lit(False)))
    out["opponents_conflict"] = (F.size(col(a, "opponents")) > 0) & (F.size(col(b, "opponents")) > 0) & (overlap("opponents") == 0)
    return out


def gates(compatible: Column, family_a: Column, family_b: Column, f: dict[str, Column], lexical: Column) -> dict[str, Column]:
    """The four gates: baseline, family_compat, football_conflicts, football_anchor_v1."""
    among = lambda x, *names: F.coalesce(x, F.lit("unknown")).isin(*names)
    match = ("match", "competition")
    playing = among(family_a, *match) & among(family_b, *match) & (f["competition_conflict"] | f["opponents_conflict"])
    clear = compatible & ~(f["anchor_conflict"] | f["procedure_conflict"] | playing)
    vague = among(family_a, "unknown") | among(family_b, "unknown")
    moving = among(family_a, "transfer", "contract", "discipline") & among(family_b, "transfer", "contract", "discipline")
    subject = f["subject_cross"] & (f["clubs_overlap"] >= 1)
    close = (f["people_overlap"] >= 2) & (lexical >= 0.08)
    anchored = (
        F.when(vague, f["subject_cross"] | (f["clubs_overlap"] >= 2) | f["anchor_equal"] | f["competition_equal"] | f["procedure_equal"] | ((f["people_overlap"] >= 1) & (f["clubs_overlap"] >= 1)))
        .when(moving, subject | (f["relations_overlap"] > 0) | (f["clubs_overlap"] >= 3) | close)
        .when(among(family_a, *match) | among(family_b, *match), (f["clubs_overlap"] >= 2) | f["anchor_equal"] | f["competition_equal"] | (f["opponents_overlap"] > 0) | subject)
        .otherwise(subject | f["procedure_equal"] | close | (f["clubs_overlap"] >= 2))
    )
    return {"baseline": F.lit(True), "family_compat": compatible, "football_conflicts": clear, "football_anchor_v1": clear & anchored}


def sentinels(expected: DataFrame, gated: DataFrame, gate: str) -> DataFrame:
    """`expected` (pair_id, expected_gate: allow or block) with whether `gate` of `gated` (pair_id, gates) does that."""
    return sentinel_state(expected.join(gated.select("pair_id", F.col(gate).alias("allowed")), "pair_id", "left"))


def sentinel_state(j: DataFrame) -> DataFrame:
    """`found` and `pass` of rows that hold both what is expected and what the gate says (`allowed`, null if not gated)."""
    kept = F.coalesce(F.when(F.col("expected_gate") == "allow", F.col("allowed")).otherwise(~F.col("allowed")), F.lit(False))
    return j.withColumn("found", F.col("allowed").isNotNull()).withColumn("pass", kept)


def _safe() -> Column:
    return (F.col("co_cluster_precision") >= 0.97) & (F.col("different_separation") >= 0.97)


def _rank_score() -> Column:
    return F.when(_safe(), 100).otherwise(0) + 20 * F.col("same_recall") + 10 * F.col("pair_accuracy") - 0.25 * F.col("largest") - 0.01 * F.col("longest_days")


def rank_order(runs: DataFrame) -> list[Column]:
    """Runs in order of preference: safe ones first, then by weighted score; ties to the lower anchor threshold."""
    return [F.desc(_safe()), F.desc(_rank_score()), F.coalesce("anchor", F.lit(-1.0))]


def recommendation(runs: DataFrame) -> DataFrame:
    """The conservative run to take, by `rank_order`."""
    ranked = runs.where("mode = 'conservative'").withColumn("safe", _safe()).withColumn("rank_score", _rank_score())
    return ranked.orderBy(*rank_order(ranked)).limit(1)


def mixedness(title: Column, people: Column, clubs: Column, club_from: Column, club_to: Column) -> dict[str, Column]:
    """Signs that one event mixes several."""
    joiner = title.rlike(r"(?iu)(?<![\p{L}\p{N}_])(et|mais|avant|apres|après|puis|tandis que|alors que)(?![\p{L}\p{N}_])|[,;:]")
    return {"people_count": F.size(people), "clubs_count": F.size(clubs), "title_has_joiner": joiner, "has_from_and_to": club_from.isNotNull() & club_to.isNotNull()}
