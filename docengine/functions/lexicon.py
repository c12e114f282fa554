"""Word lists of the text functions: fixed values, each stated once."""

from __future__ import annotations

#: Requirement, ban and definition phrases, Romanian then English. Fixed values.
OBLIGATION = ("trebuie", "obligatoriu", "obligat", "se va", "se vor", "impune", "prescrie", "este necesar", "must", "shall", "required", "mandatory", "obligation")
PROHIBITION = ("se interzice", "nu este permis", "este interzis", "nu se admite", "nu are voie", "oprit", "strict interzis", "prohibited", "forbidden", "not allowed", "shall not", "must not", "strictly prohibited")
DEFINITION = ("se înțelege", "înțelegându-se", "reprezintă", "este definit", "semnifică", "means", "is defined as", "represents", "signifies")

#: Query intents in the order in which they are tried. Fixed values.
QUERY_INTENTS = (
    ("obligation", ("trebuie", "obligatoriu", "obligat", "se va", "se vor", "impune", "prescrie")),
    ("prohibition", ("interzis", "permis", "oprit", "nu are voie", "nu se admite")),
    ("definition", ("ce inseamna", "ce este", "definitie", "definiția", "semnificație")),
    ("procedure", ("cum se", "cum se face", "procedura", "modul de", "metoda")),
)

#: Intents of the question interface, tried in this order by plain containment. Fixed values.
ROUTE_INTENTS = (
    ("obligation", ("trebuie", "obligat", "obligatoriu")),
    ("prohibition", ("interzis", "nu este permis")),
    ("definition", ("ce este", "definitie")),
    ("procedure", ("cum se face", "procedura")),
)

#: Stop words of queries. Fixed values.
QUERY_STOP = (
    "care ce cum unde cand când de din la si și sau pentru pe cu fara fără sub despre prin "
    "the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "this that these those a an and or but in on at to for of with by from as it its"
).split()

#: Stop words of document keywords, of key terms, and of coverage. Fixed values.
DOCUMENT_STOP = ("the", "and", "or", "in", "on", "de", "si", "și", "sau")
KEY_TERM_STOP = "the a an and or but in on at to for de și sau la în pe cu fără prin pentru".split()
COVERAGE_STOP = ("care", "ceea", "pentru", "despre", "sunt", "este", "trebuie")

#: Words that normalising a citation drops. Fixed values.
DROPPED = ("a", "an", "the", "si", "sau", "de", "la", "in", "pe")

#: Scenario patterns by type, concept patterns and question words. Fixed values.
SCENARIOS = {
    "installation": ("montare", "instalare", "amplasare", "poziționare", "pozitionare", "cum se face", "cum se montează", "cum se monteaza", "procedura"),
    "verification": ("verificare", "control", "măsurătoare", "masuratoare", "testare", "măsurători", "masuratori", "verificări", "verificari"),
    "multiCondition": ("și", "si", "precum și", "precum si", "atât cât și", "atat cat si", "atât...cât și", "atat...cat si", "pe de o parte", "pe de altă parte"),
    "specificContext": ("în cazul", "in cazul", "pentru cazul", "în situația", "in situatia", "la construcțiile", "la constructiile", "în clădirile", "in cladirile", "în încăperile", "in incaperile", "în spațiile", "in spatiile"),
    "comparison": ("comparativ cu", "față de", "fata de", "spre deosebire de", "versus", "vs", "în raport cu", "in raport cu"),
}
CONCEPTS = {
    "ddr": ("ddr", "dispozitiv diferențial", "dispozitiv diferential", "30ma", "300ma"),
    "impamantare": ("împământare", "impamantare", "legare la pământ", "legare la pamant", "priză de pământ", "priza de pamant"),
    "prize": ("priză", "priza", "prize", "prizelor", "circuit de prize", "circuite de prize"),
    "iluminat": ("iluminat", "lampă", "lampa", "lămpi", "lampi", "corpură de iluminat"),
    "conductoare": ("conductor", "conductoare", "cabluri", "cablu", "fire", "fir"),
    "protectie": ("protecție", "protectie", "protecția", "protectia", "protecții", "protectii"),
    "tablou": ("tablou", "tablouri", "tabloul", "tablourilor", "siguranță", "siguranta"),
}
QUESTION_WORDS = ("cum", "cât", "cat", "ce", "când", "cand", "unde", "care")

#: Related concept groups of the relevance score. Fixed values.
RELATED = (
    ("impamantare", "impamantarea", "priza", "priza de pamant", "electrod", "rezistenta", "ohm", "legare la pamant", "priza pamant", "impamantarea priza"),
    ("conductoare", "cabluri", "fire", "conductoare neizolate", "izolatie", "conductoare electrice", "sectiune", "sectiunea", "milimetru", "mmp", "cupru", "aluminiu"),
    ("protectie", "siguranta", "securitate", "dispozitive protectie", "supracurent", "scurtcircuit", "siguranta electrica", "protectie electrica", "sistem protectie", "protejare", "protejat"),
    ("instalatii electrice", "retele electrice", "tablouri", "prize", "intrerupatoare", "tablou electric", "circuit", "circuite", "alimentare", "alimentarea"),
    ("masurare", "verificare", "control", "testare", "monitorizare", "masuratoare", "masura", "verificat", "controlat", "testat"),
    ("montare", "instalare", "montaj", "fixare", "conectare", "executie", "executia", "pozare", "pozarea"),
    ("soc", "soc electric", "electrocutare", "curent electric", "tensiune", "tensiunea", "voltaj", "amperaj", "ampere"),
    ("echipament", "echipamente", "echipament electric", "aparate", "receptoare", "consumator", "consumatori"),
    ("pericol", "pericole", "risc", "riscuri", "periculos", "defect", "defectiune", "avarie"),
)

#: First two synonyms of a word, the ones that query variants use. Fixed values.
SYNONYMS = {
    "priză": ("priza", "prize"),
    "ddr": ("dispozitiv diferențial", "dispozitiv diferential"),
    "cablu": ("cabluri", "conductor"),
    "tablou": ("tablouri", "tablou electric"),
    "montaj": ("montare", "instalare"),
    "curent": ("curent electric", "amperaj"),
    "circuit": ("circuite", "circuit electric"),
    "protectie": ("protecție", "siguranta"),
}

#: Terms that narrow an answer. Fixed values.
RESTRICTIONS = ("numai", "doar", "exclusiv", "strict", "obligatoriu", "interzis", "nu se admite")
