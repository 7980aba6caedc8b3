"""The words and patterns by which events are told, a table per version of the extractor that uses it.

Patterns are matched without regard to case; word boundaries, word characters and digits are those of ASCII, as in the
language that the values were written for (so a word that begins with an accented letter has no boundary before it)."""

# -- Fixed values of version 0.2: families, stages, clubs and people of a segment --------------------------------------------
FAMILIES = {
    "transfer": [
        r"\bmercato\b", r"\btransfert\b", r"\brecrut", r"\bpr[eê]t\b", r"\boffre\b", r"\bn[eé]goci", r"\baccord\b", r"\bvisite m[eé]dicale\b", r"\bsign", r"\bsignature\b",
        r"\bquitt", r"\bfile (?:à|a|vers)\b", r"\brejoint\b", r"\bpart(?:ir|ira|i|ent)\b", r"\bd[eé]part\b", r"\bcibl", r"\bdiscut", r"\barriv[eé]e?\b", r"\bjoker\b",
    ],
    "contract": [r"\bprolong", r"\bcontrat\b", r"\brenouvel", r"\bjusqu['’]?en 20\d{2}\b"],
    "injury": [
        r"\bbless", r"\bforfait\b", r"\binfirmerie\b", r"\bexamens?\b", r"\bdiagnostic\b", r"\bl[eé]sion\b", r"\bentorse\b", r"\bligament", r"\breprise individuelle\b",
        r"\breprise collective\b", r"\bretour à l['’]entra[iî]nement\b", r"\bretour a l['’]entrainement\b",
    ],
    "discipline": [r"\bsuspend", r"\bsanction", r"\bdisciplin", r"\bcommission\b", r"\bappel\b", r"\bexpuls", r"\bcarton rouge\b"],
    "finance": [r"\bdncg\b", r"\bfinances?\b", r"\bdette\b", r"\bbudget\b", r"\bcomptes?\b", r"\bcapital\b", r"\bactionnaire\b", r"\bpropri[eé]t", r"\brachat\b", r"\bcession\b"],
    "institutional": [r"\bpr[eé]sident\b", r"\bdirecteur g[eé]n[eé]ral\b", r"\bgouvernance\b", r"\bconseil d['’]administration\b", r"\brestructuration\b"],
    "staff": [
        r"\bentra[iî]neur\b", r"\bcoach\b", r"\bstaff\b", r"\bmanager\b", r"\bdirecteur sportif\b", r"\badjoint\b", r"\bsur le banc\b", r"\blicenci", r"\blimog", r"\bd[eé]mis\b",
    ],
    "competition": [
        r"\btirage\b", r"\bqualification\b", r"\bqualifi[eé]\b", r"\b[eé]limin", r"\bbarrages?\b", r"\bphase de ligue\b", r"\bhuiti[eè]mes?\b", r"\bquarts?\b", r"\bdemi-final", r"\bfinale\b",
    ],
    "match": [
        r"\bavant-match\b", r"\bapr[eè]s-match\b", r"\bcomposition\b", r"\bcompo\b", r"\bcoup d['’]envoi\b", r"\br[eé]sultat\b", r"\bscore\b", r"\bvictoire\b", r"\bd[eé]faite\b", r"\bmatch\b",
    ],
    "statement": [r"\bd[eé]clare\b", r"\bexplique\b", r"\bconfie\b", r"\binterview\b", r"\bconf[eé]rence de presse\b", r"\br[eé]agit\b", r"\br[eé]ponse\b", r"\bd[eé]nonce\b"],
}
STAFF_ROLE = r"\b(?:entra[iî]neur|coach|manager|staff|directeur sportif|adjoint|sur le banc)\b"
STAFF_ACTION = r"\b(?:avenir|d[eé]part|quitt|licenci|limog|d[eé]mis|remplac|nomm|arriv|succession)\b"
FINANCE_CORE = r"\b(?:dncg|dette|budget|comptes?|capital|actionnaire|propri[eé]taire|rachat|cession du club)\b"
TRANSFER_CORE = r"\b(?:mercato|transfert|recrut|pr[eê]t|offre|n[eé]goci|visite m[eé]dicale|sign|quitt|rejoint|file (?:à|a|vers)|d[eé]part|cibl|arriv[eé]e|joker)\b"
STAGES = {
    "transfer": [
        ("official", r"\bofficiel(?:le)?\b|\bofficialis|\bsign[eé](?:e|er)?\b|\bsignature\b"),
        ("medical", r"\bvisite m[eé]dicale\b|\bexamens? m[eé]dicaux\b"),
        ("agreement", r"\baccord (?:trouv[eé]|total|de principe)|\baccord entre\b|\baccord avec\b"),
        ("failed", r"\b[eé]chec\b|\bcapote\b|\babandon\b|\brefus[eé]\b|\bpiste .* referm"),
        ("negotiation", r"\bn[eé]goci|\bdiscussions?\b|\bdiscut(?:e|ent)\b|\boffre\b|\bproposition\b"),
        ("interest", r"\bint[eé]r[eê]t\b|\bcibl(?:e|é|ée)\b|\bsur les rangs\b|\bpense à\b|\bpense a\b|\bsouhaite recruter\b"),
    ],
    "injury": [
        ("match_return", r"\bretour (?:dans le groupe|à la comp[eé]tition|a la competition|sur les terrains?)\b"),
        ("training_return", r"\breprise (?:individuelle|collective)|\bretour à l['’]entra[iî]nement|\bretour a l['’]entrainement"),
        ("recovery", r"\br[eé][eé]ducation\b|\br[eé]cup[eé]ration\b|\bconvalescence\b"),
        ("diagnosis", r"\bdiagnostic\b|\bexamens?\b|\bl[eé]sion\b|\bligament"),
        ("incident", r"\bbless[eé]\b|\bdouleur\b|\btorsion\b|\bentorse\b|\bchoc\b"),
    ],
}
OTHER_CLUBS = {
    "Aston Villa": ["aston villa"],
    "Crystal Palace": ["crystal palace"],
    "Chelsea": ["chelsea"],
    "Liverpool": ["liverpool"],
    "AS Monaco": ["as monaco", "monaco"],
    "LOSC": ["losc", "lille"],
    "Real Madrid": ["real madrid"],
    "FC Barcelona": ["fc barcelona", "barcelone", "barça", "barca"],
    "Manchester City": ["manchester city"],
    "Manchester United": ["manchester united"],
    "Arsenal": ["arsenal"],
    "Tottenham": ["tottenham"],
    "Bayern Munich": ["bayern munich", "bayern"],
    "Inter Milan": ["inter milan", "inter"],
    "AC Milan": ["ac milan"],
    "Juventus": ["juventus"],
    "AS Roma": ["as roma", "roma", "rome"],
    "Napoli": ["napoli", "naples"],
    "Atlético Madrid": ["atletico madrid", "atlético madrid"],
    "Sunderland": ["sunderland"],
    "Stade de Reims": ["stade de reims", "reims"],
    "AJ Auxerre": ["aj auxerre", "auxerre"],
    "Stade Rennais": ["stade rennais", "rennes"],
    "OGC Nice": ["ogc nice", "nice"],
    "RC Lens": ["rc lens", "lens"],
    "FC Nantes": ["fc nantes", "nantes"],
    "RC Strasbourg": ["rc strasbourg", "strasbourg"],
}
COMPETITIONS = [
    ("Ligue 1", r"\bligue 1\b"),
    ("Ligue des champions", r"\bligue des champions\b|\bchampions league\b"),
    ("Ligue Europa", r"\bligue europa\b|\beuropa league\b"),
    ("Coupe de France", r"\bcoupe de france\b"),
    ("Trophée des Champions", r"\btroph[eé]e des champions\b"),
]
STOP = [
    "mercato", "football", "match", "club", "equipe", "équipe", "joueur", "joueurs", "officiel", "officielle", "ligue", "championnat", "saison", "direct", "info", "news", "transfert",
]
NOT_PEOPLE = [
    "apres", "avant", "alors", "quelques", "selon", "voici", "encore", "pourtant", "ainsi", "cette", "ceci", "cela", "mais", "donc", "enfin", "desormais", "aujourd", "hier", "demain",
    "journee", "europe", "france", "paris", "lyon", "marseille", "olympique", "princes", "groupama", "stadium", "training", "center", "centre", "ballon", "essentiel", "invit", "invité",
    "mercato", "football", "ligue", "champions", "league", "coupe", "officiel", "officielle", "samedi", "dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "septembre", "octobre",
    "novembre", "decembre", "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout",
]
PLACE_IN_NAME = r"\b(?:stadium|stade|centre|center|training|parc)\b"
ROLE_BEFORE = r"(?:attaquant|ailier|milieu|d[eé]fenseur|gardien|joueur|capitaine|coach|entra[iî]neur|manager|pr[eé]sident|directeur)\s+$"
ACTION_AFTER = r"^\s*(?:quitt|rejoint|file|sign|prolong|bless|forfait|n[eé]goci|discute|explique|d[eé]clare|d[eé]nonce|revient|part|arrive)"
DESTINATION_BEFORE = r"(?:\b(?:à|a|vers|contre|face à|face a|chez)\s*)$"
MATCH_ROUND = r"\b(\d{1,2}(?:e|er)?\s+journ[eé]e|journ[eé]e\s+\d{1,2}|huiti[eè]mes?|quarts?|demi-finales?|finale|barrages?)\b"
MATCH_DAY = r"\b(\d{1,2}\s+(?:janvier|f[eé]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[eé]cembre)(?:\s+20\d{2})?)\b"

# -- Fixed values of version 0.4: what an article as a whole is about, and what of its body is news ---------------------------
PREVIEW_TITLE = r"\b(?:pronostic|avant[- ]match|composition probable|compo probable)\b"
ROUNDUP_TITLE = r"\b(?:jt foot mercato|les infos du jour|le point mercato|point mercato|\d+ transferts?|\d+ joueurs libres)\b"
BODY_NOISE = r"^(?:composition probable|historique\b|classement\b|les cotes\b|notre pronostic\b|pronostic\b|effectif\b|l['’ ]?infirmerie\b|infirmerie\b|les derni[eè]res confrontations\b|face[- ]a[- ]face\b|voir aussi\b|lire aussi\b)"
BODY_OPENING = r"^(?:un feu vert|premier signal faible)\b"
BACKGROUND = r"\b(?:saison derni[eè]re|saison pass[eé]e|l['’ ]an dernier|avait d[eé]j[aà]|avaient d[eé]j[aà]|lors de la premi[eè]re journ[eé]e|la saison pr[eé]c[eé]dente)\b"
ACTION_04 = r"\b(?:officialis\w*|sign(?:e|é|ée|er|ent)?|rejoint|quitt(?:e|é|ée|er|ent)?|transf[eè]r\w*|accord|offre|n[eé]goci\w*|discut\w*|cibl\w*|pr[eê]t|prolong\w*|renouvel\w*|bless\w*|forfait|diagnostic|suspend\w*|sanction\w*|limog\w*|licenci\w*|nomm\w*|d[eé]mis|rachat|cession|dncg|qualifi\w*|[eé]limin\w*|victoire|d[eé]faite|score)\b"
NO_PERSON_04 = r"^(?:c['’ ]?est|pronostic|premier|pourquoi|est[- ]ce|d['’ ]?abord|l['’ ]?information|l['’ ]?autre|l['’ ]?avenir|l['’ ]?ancien|l['’ ]?attaquant|l['’ ]?arbitre|l['’ ]?effectif|l['’ ]?historique|l['’ ]?infirmerie|l['’ ]?arriv[eé]e|l['’ ]?ailier|l['’ ]?an|j['’ ]?ai|s['’ ]?il|celui-ci|celle-ci|bonne|les parisiens|les gones|les marseillais|les eagles|les black cats|les bianconeri)$"
PRONOUN_04 = r"^(?:celui|celle|ceux|celles|lui|elle|eux|elles)$"
ORGANISATION_04 = r"\b(?:city|united|football club|\bfc\b|\bcf\b|\bafc\b|stade|olympique|ajax|slovan|borussia|sporting|palace|black cats|caught offside|actu foot|massilia zone|tunisie num[eé]rique)\b"
NAME_PREFIX_04 = r"^(?:avec|recruter|avantage|pour)\s+"
TITLE_STRONG_TRANSFER_04 = r"\b(?:mercato|transfert|recrut\w*|offre|accord|sign\w*|rejoint|cibl\w*|n[eé]goci\w*|pr[eê]t)\b"
TITLE_TRANSFER_04 = r"\b(?:mercato|transfert|recrut\w*|offre|accord|sign\w*|rejoint|quitt\w*|d[eé]part|cibl\w*|n[eé]goci\w*|pr[eê]t)\b"
TITLE_CONTRACT_04 = r"\b(?:prolong\w*|renouvel\w*|contrat)\b"
TITLE_INJURY_04 = r"\b(?:bless\w*|forfait|infirmerie|diagnostic|l[eé]sion)\b"
TITLE_DISCIPLINE_04 = r"\b(?:suspend\w*|sanction\w*|commission de discipline|carton rouge)\b"
TITLE_FINANCE_04 = r"\b(?:dncg|dette|budget|comptes?|capital|actionnaire|rachat|cession)\b"
TITLE_STAFF_04 = r"\b(?:entra[iî]neur|coach|manager|directeur sportif|staff)\b.*\b(?:avenir|d[eé]part|quitt\w*|limog\w*|licenci\w*|nomm\w*|remplac\w*)\b"
TITLE_COMPETITION_04 = r"\b(?:tirage|qualification|qualifi[eé]|[eé]limin\w*|barrages?|huiti[eè]mes?|quarts?|demi-final\w*|finale)\b"
TITLE_MATCH_04 = r"\b(?:avant[- ]match|apr[eè]s[- ]match|composition|compo|score|victoire|d[eé]faite|match)\b"
RUPTURES_04 = ["injury", "discipline", "institutional"]
TITLE_STOP_04 = [
    "mercato", "football", "match", "club", "equipe", "joueur", "joueurs", "officiel", "officielle", "ligue", "championnat", "saison", "direct", "info", "news", "transfert",
    "pour", "avec", "dans", "sur", "des", "les", "une", "est", "sont", "plus", "apres", "avant", "mais", "aux", "par", "que", "qui", "son", "ses", "leur", "leurs", "du", "de", "la", "le", "un", "et",
]
KIN_04 = {
    "transfer": ["contract", "finance", "staff", "competition", "match"],
    "contract": ["transfer", "finance"],
    "injury": ["match"],
    "discipline": ["match"],
    "staff": ["institutional", "contract"],
    "finance": ["institutional", "transfer"],
    "institutional": ["finance", "staff"],
    "competition": ["match"],
    "match": ["competition"],
}

# -- Fixed values of version 0.5: titles that say outright what an article is about -------------------------------------------
TITLE_INJURY_05 = r"\b(?:bless\w*|forfait|infirmerie|diagnostic|l[eé]sion|indisponib\w*)\b"
TITLE_GENERIC_INJURY_05 = r"\b(?:gros\s+)?coup dur\b"
TITLE_DISCIPLINE_05 = r"\b(?:suspend\w*|sanction\w*|commission de discipline|carton rouge|expuls\w*)\b"
TITLE_FINANCE_05 = r"\b(?:dncg|dette|budget|comptes?|finances?|masse salariale|capital|actionnaire|propri[eé]taire|rachat|cession)\b"
TITLE_STAFF_05 = r"(?:\b(?:entra[iî]neur|coach|manager|directeur sportif|staff)\b.*\b(?:avenir|d[eé]part|quitt\w*|limog\w*|licenci\w*|nomm\w*|remplac\w*|succession)\b)|(?:\b(?:limog\w*|licenci\w*|nomm\w*|remplac\w*)\b.*\b(?:entra[iî]neur|coach|manager|directeur sportif|staff)\b)"
TITLE_CONTRACT_05 = r"\b(?:prolong\w*|renouvel\w*|contrat|jusqu['’ ]?en 20\d{2})\b"
TITLE_TRANSFER_05 = r"\b(?:mercato|transfert|recrut\w*|offre|sign(?:e|é|ée|er|ature)?|rejoint|quitt\w*|d[eé]part|cibl\w*|n[eé]goci\w*|pr[eê]t)\b"
TITLE_STATEMENT_05 = r"\b(?:phrase choc|petite phrase|d[eé]claration|d[eé]clare|r[eé]agit|r[eé]action|d[eé]nonce\w*|accus\w*|critique\w*|r[eé]pond\w*|confidence\w*|interview|conf[eé]rence de presse|se l[aâ]che|mensonge)\b"
ACTION_05 = r"\b(?:officialis\w*|sign\w*|rejoint|quitt\w*|transf[eè]r\w*|accord|offre|n[eé]goci\w*|discut\w*|cibl\w*|pr[eê]t|prolong\w*|renouvel\w*|bless\w*|forfait|diagnostic|indisponib\w*|suspend\w*|sanction\w*|limog\w*|licenci\w*|nomm\w*|d[eé]mis|rachat|cession|dncg|qualifi\w*|[eé]limin\w*|victoire|d[eé]faite|score|reste\w*|refus\w*)\b"
NO_PERSON_05 = r"^(?:l['’ ]?(?:incertitude|h[eé]ritier|absence|inversion)|diable rouge|ch['’ ]?ti|au[- ]del(?:a|à)?|bratislava)$"
KIN_05 = {
    "transfer": ["contract", "finance", "staff"],
    "contract": ["transfer", "staff"],
    "injury": ["transfer", "match"],
    "discipline": ["match", "institutional"],
    "staff": ["transfer", "contract", "institutional"],
    "finance": ["transfer", "institutional"],
    "statement": ["unknown", "institutional", "transfer", "finance", "staff", "contract", "competition", "match"],
}
