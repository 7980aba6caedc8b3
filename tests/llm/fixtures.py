"""Small documents with what tends to break: nulls, empties, long texts, copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, kept string, key long"

WORDS = "the of and onre thion erea ththat oner inea thble ndre hean ated sthe lyer whin oust tise ourh eren".split()


def sentence(rng: random.Random, n: int) -> str:
    return (" ".join(rng.choice(WORDS) + rng.choice(["", "re", "th", "an", "on"]) for _ in range(n)) + ".").capitalize()


def text(rng: random.Random, sentences: int = 12) -> str:
    return " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(sentences))


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [text(rng, rng.randint(4, 30)) for _ in range(n)]
    texts[3] = None
    texts[4] = ""
    texts[5] = " \t\n "
    texts[6] = "one two"
    texts[7] = "a" * 30_000
    texts[8] = "word " * 9000
    texts[9] = "é ü 日本 😀 ΣΑΣ İ <|endoftext|> x\x1cy\xa0z"
    texts[10] = texts[20]
    texts[11] = texts[21].replace(" ", "  ", 1)
    texts[12] = texts[22][:-20] + " changed."
    texts[13] = "Write to a.b@mail.example.com or +1 (476) 555-6291, card 4111 1111 1111 1111, host 10.0.0.1, IBAN GB82 WEST 1234 5698 7654 32."
    texts[14] = "line one here\nline one here\n### $$$ |\nof and the of and the of and the " + texts[30]
    return [(i, t, "en", "src0" if i % 3 else "src1", len(t or ""), "as it was", "kept?", i) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def save(df, folder, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
