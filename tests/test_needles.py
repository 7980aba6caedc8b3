"""Texts that are not searched hold no match: literals taken from patterns against the patterns themselves."""

import random
import re

from storyloom.operators import extraction as X
from storyloom.operators import vocabulary as V


def _patterns(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for x in value.values():
            yield from _patterns(x)
    elif isinstance(value, (list, tuple)):
        for x in value:
            yield from _patterns(x)


EVERY = sorted({p for n, v in vars(V).items() if n.isupper() for p in _patterns(v) if "\\" in p} | {X._ANY_FAMILY, *X._FAMILY.values()})


def _texts():
    rng, words = random.Random(2), sorted({w for p in EVERY for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"\\.", " ", p)))})
    twist = {"i": "ıİiI", "s": "ſsS", "k": "KkK", "e": "eéÉè", "a": "aàÀ"}
    for _ in range(3000):
        text = rng.choice([" ", " ", "-", "'"]).join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        how = rng.randrange(4)
        yield text.upper() if how == 0 else text.title() if how == 1 else "".join(rng.choice(twist.get(c, c)) if rng.random() < 0.2 else c for c in text) if how == 2 else text


def test_what_is_not_searched_holds_no_match():
    texts, hits = list(_texts()), 0
    for p in EVERY:
        for t in texts[:: 1 if p == X._ANY_FAMILY else 7]:
            found = bool(X.rx(p).search(t))
            hits += found
            assert X.has(p, t) == found, (p, t)
    assert len(EVERY) > 100 and hits > 1000


def test_most_texts_are_not_searched(monkeypatch):
    class Never:
        def search(self, text):
            raise AssertionError(text)

    needles = X._needles(X._ANY_FAMILY)
    assert len(needles) > 50 and min(map(len, needles)) >= 3
    monkeypatch.setattr(X, "rx", lambda pattern: Never())
    assert not X.has(X._ANY_FAMILY, "Eau onanha keiten.")


def test_normal_forms_are_as_before():
    for t in _texts():
        import unicodedata

        bare = "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ").lower()
        assert X.norm(t) == " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"https?://\S+", " ", bare)).split())
    assert X.norm("Voir https://exemple.fr/É?a=1 ici") == "voir ici"
