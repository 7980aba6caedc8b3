"""The extractor: every entry of its vocabulary, and its versions against situations worked out by hand."""

import pytest

from storyloom.operators import extraction as X
from storyloom.operators import vocabulary as V

#: One text per pattern, in the vocabulary's order.
TEXTS = {
    "transfer": [
        "le mercato", "un transfert", "il recrute", "un prêt", "une offre", "ils négocient", "un accord", "la visite médicale", "il signe", "sa signature",
        "il quitte", "il file vers", "il rejoint", "il partira", "son départ", "une cible", "ils discutent", "son arrivée", "un joker",
    ],
    "contract": ["il prolonge", "son contrat", "il renouvelle", "jusqu’en 2027"],
    "injury": [
        "il est blessé", "il est forfait", "son infirmerie", "des examens", "un diagnostic", "une lésion", "une entorse", "ses ligaments", "une reprise individuelle", "la reprise collective",
        "le retour à l’entraînement", "le retour a l'entrainement",
    ],
    "discipline": ["il est suspendu", "une sanction", "la discipline", "la commission", "un appel", "il est expulsé", "un carton rouge"],
    "finance": ["la dncg", "ses finances", "une dette", "le budget", "les comptes", "son capital", "un actionnaire", "le propriétaire", "le rachat avance", "une cession"],
    "institutional": ["le président", "le directeur général", "la gouvernance", "le conseil d’administration", "une restructuration"],
    "staff": ["son entraîneur", "le coach", "le staff", "un manager", "le directeur sportif", "un adjoint", "sur le banc", "il est licencié", "il est limogé", "il est démis de"],
    "competition": ["le tirage", "la qualification", "qualifiés hier", "lelimine, eliminer", "un barrage", "la phase de ligue", "les huitièmes", "un quart", "une demi-finale", "la finale"],
    "match": ["un avant-match", "un après-match", "la composition", "la compo", "le coup d’envoi", "un résultat", "le score", "une victoire", "la défaite", "un match"],
    "statement": ["il déclare", "il explique", "il confie", "une interview", "la conférence de presse", "il réagit", "une réponse", "il dénonce"],
}


@pytest.mark.parametrize("family", V.FAMILIES)
def test_every_pattern_of_a_family(family):
    assert len(TEXTS[family]) == len(V.FAMILIES[family])
    for text, pattern in zip(TEXTS[family], V.FAMILIES[family]):
        assert X.has(pattern, text), (text, pattern)
        hit = [f for f in V.FAMILIES if any(X.has(p, text) for p in V.FAMILIES[f])]
        found = X.family_of(text)
        alone = hit == ["staff"] and not X.has(V.STAFF_ROLE, text)  # a dismissal without a role is nobody's
        assert found == "unknown" if alone else found in hit and (len(hit) > 1 or found == family), (text, hit, found)


def test_words_that_only_look_alike():
    assert X.family_of("Le rachat avance") == "finance" and X.family_of("Un achat avance") == "unknown"
    # An accented letter is no word character, so nothing that begins with one has a boundary before it.
    assert not X.has(r"\b[eé]limin", "éliminé hier") and X.has(r"\b[eé]limin", "eliminé hier")
    assert X.has(r"\bqualifi[eé]\b", "qualifiés") and not X.has(r"\bqualifi[eé]\b", "qualifié hier")


def test_what_beats_what():
    assert X.family_of("blessé, il prolonge son contrat") == "injury" and X.family_of("contrat et sanction") == "contract"
    assert X.family_of("le coach sur le départ") == "staff" and X.family_of("le coach parle") == "staff" and X.family_of("le coach rejoint le club") == "transfer"
    assert X.family_of("un accord avec la dncg") == "finance" and X.family_of("la dncg bloque un transfert") == "transfer"
    assert X.family_of("un match, il explique") == "match" and X.family_of("rien de neuf") == "unknown"


@pytest.mark.parametrize(
    "family, text, stage",
    [
        ("transfer", "c’est officiel, il est signé", "official"), ("transfer", "visite médicale ce soir", "medical"), ("transfer", "accord trouvé", "agreement"), ("transfer", "la piste se referme", "failed"),
        ("transfer", "une offre", "negotiation"), ("transfer", "un club pense a lui", "interest"), ("transfer", "rien", None),
        ("injury", "retour dans le groupe", "match_return"), ("injury", "reprise collective", "training_return"), ("injury", "en convalescence", "recovery"), ("injury", "une lésion", "diagnosis"), ("injury", "une douleur", "incident"),
    ],
)
def test_stages(family, text, stage):
    assert next((s for s, p in V.STAGES[family] if X.has(p, text)), None) == stage


@pytest.mark.parametrize("title, lead, family", [
    ("Forfait avant le match", "unknown", "injury"), ("Carton rouge", "unknown", "discipline"), ("Accord avec la DNCG", "finance", "transfer"), ("Il quitte le club", "staff", "staff"),
    ("Il quitte le club", "unknown", "transfer"), ("Le coach bientôt remplacé", "unknown", "staff"), ("Il prolonge", "unknown", "contract"), ("La dette", "unknown", "finance"),
    ("Le tirage", "unknown", "competition"), ("La compo", "unknown", "match"), ("Rien", "statement", "statement"),
])
def test_dossier_of_version_04(title, lead, family):
    assert X.dossier_of(title, lead) == family


@pytest.mark.parametrize("title, family", [
    ("Indisponible deux mois", "injury"), ("Expulsé hier", "discipline"), ("La masse salariale", "finance"), ("Un coach nommé", "staff"), ("Nommé entraîneur", "staff"), ("Jusqu’en 2030", "contract"),
    ("Il signe", "transfer"), ("Un accord trouvé", None), ("Il signale", None), ("Le mensonge", "statement"), ("Le point mercato", None), ("Gros coup dur", None), ("Le tirage", None), ("", None),
])
def test_subject_of_version_05(title, family):
    assert X.subject_of(title, []) == family


def test_a_hard_blow_needs_an_injury():
    hurt = X.Event("injury", [], [], None, None, None, None, None, [], "lead", 0, ["x"], [])
    assert X.subject_of("Coup dur et sanction", [hurt]) == "injury" and X.subject_of("Coup dur et sanction", []) == "discipline"


TEAMS = X.Context({"PSG": ["Paris Saint-Germain"], "OL": ["Olympique Lyonnais"], "OM": ["Olympique de Marseille", "Marseille"]}, {"Geoffrey Kondogbia": ["Kondogbia"], "Emile Hojbjerg": [], "Luis Enrique": []})


def test_layers():
    title = "OM : gros coup dur pour un cadre"
    body = "Touché à la cuisse, Geoffrey Kondogbia pourrait manquer plusieurs semaines avec l’OM.\n\nLa blessure de Kondogbia attend un diagnostic, son indisponibilité sera précisée."
    by = {v: X.extract_article(title, "Geoffrey Kondogbia sera absent.", body, TEAMS, v) for v in X.VERSIONS}
    assert [e.family for e in by["0.2"]] == ["unknown", "injury"] and [len(v) for v in by.values()] == [2, 2, 1]
    assert by["0.5"][0].family == "injury" and by["0.5"][0].people == ["Geoffrey Kondogbia"] and len(by["0.5"][0].fragments) == 3
    with pytest.raises(ValueError):
        X.extract_article("", "", "", TEAMS, "0.3")


def test_a_paragraph_without_a_name_joins_the_titles_person():
    (e,) = X.extract_article("Mercato OM : Hojbjerg dit non à la Roma", "Emile Hojbjerg refuse l’offre de l’AS Roma et reste à l’OM.", "Emile Hojbjerg repousse une offre de l’AS Roma.\n\nL’OM a refusé une offre de l’AS Roma pour le milieu.", TEAMS)
    assert e.family == "transfer" and e.people[0] == "Emile Hojbjerg" and len(e.fragments) >= 2


def test_changed_families_lose_their_details():
    found = X.extract_article("PSG : la réaction de Luis Enrique", "Luis Enrique réagit au match du PSG.", "", TEAMS)
    assert [(e.family, e.stage, e.opponents, e.anchor) for e in found] == [("statement", "unknown", [], None)]
