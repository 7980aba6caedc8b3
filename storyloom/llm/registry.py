"""The queries of this subpackage, by the names the driver runs them under."""

from __future__ import annotations

from storyloom.llm.archive import op2_archive
from storyloom.llm.bpe import op4_bpe
from storyloom.llm.chat import op5_chat
from storyloom.llm.packing import op9_packing
from storyloom.llm.pii import op1_pii
from storyloom.llm.quality import op8_quality
from storyloom.llm.simhash import op3_simhash
from storyloom.llm.sketches import op7_fingerprints
from storyloom.llm.substrings import op10_substrings
from storyloom.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_archive": op2_archive,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
}
ORACLES: dict[str, str] = {}
