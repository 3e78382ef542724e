import numpy as np
import pytest

from presswell.llm import langid, residue
from presswell.tables import read_table

BAD = [
    ("{{ title }}", None), ("A fine of ${amount} million euros", None), ("News", "[item.description]"), ("News", "Fine text.\n%(teaser)s"), ("__CITY__", ""), ("The council {% block n %} opens", ""),
    ("Insert headline here", None), ("News", "lorem ipsum dolor sit amet"), ("Text text text text", None), ("xxx xxxx xx", None), ("TEST blah asdf", None), ("Irure cillum ut aute.", None),
    ("404 Not Found (ID dd06c1d2)", None), ("[503] Service temporarily unavailable, try again later", None), ("Titel", "Zugriff verweigert: Ihre Anfrage wurde gesperrt."), ("HTTP Error 503. The service is unavailable.", None),
    ("403 Forbidden – request 452fb6ea", None), ("Error 404: 403 Forbidden", None),
    ("Please enable JavaScript to view this page", None), ("Nieuws", "Schakel JavaScript in om deze pagina te bekijken"),
]
GOOD = [
    (None, None), ("", ""), ("The exhibition Lorem Ipsum on the history of lettering opens", ""), ("Advisory 7: unsafe {{ expression }} handling in the portal software X has been fixed", None), ("Project A replaces ${amount} style variables in 7 official letter templates", ""),
    ("Inspectors in X warn of fake access denied screens used for fraud", None), ("Public services in X must remain usable without JavaScript from 2020", None), ("Die Behörden müssen bei Fehler 404 auf eine Suche verweisen", None), ("Statement [sic] of the minister", "Fine words. " * 20000),
]
SCHEMA = "article_id long, title string, summary string, word string, passage string"


def make(spark, values):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, (t, s) in enumerate(values)], SCHEMA)


def test_residue_is_found_and_reports_stay(spark):
    a = make(spark, BAD + GOOD)
    assert sorted(r[0] for r in residue.residue_articles(a).collect()) == list(range(len(BAD)))
    assert residue.without_residue(a).count() == len(GOOD)


def test_residue_of_nothing_and_of_repeated_rows(spark):
    assert residue.residue_articles(make(spark, [])).count() == 0
    a = make(spark, [("{{ title }}", None)]).union(make(spark, [("{{ title }}", None)]))
    assert residue.residue_articles(a).count() == 1


@pytest.fixture(scope="module")
def model(spark, data):
    rows = read_table(spark, data.replace("0.001", "0.01"), "articles")
    return langid.fit(langid.training_rows(rows, 100))


TEXTS = {
    "en": "The ministry presents its annual report on open data with partners from several cities.",
    "de": "Das Ministerium veröffentlicht neue Leitlinien zum Thema Lieferketten gemeinsam mit der Stadt.",
    "fr": "Le ministère publie de nouvelles lignes directrices sur les données ouvertes avec la ville.",
    "es": "El ministerio publica nuevas directrices sobre los datos abiertos junto con la ciudad.",
    "it": "Il ministero pubblica nuove linee guida sui dati aperti insieme alla città e alla regione.",
    "nl": "Het ministerie publiceert nieuwe richtlijnen over open gegevens samen met de gemeente.",
    "pl": "Ministerstwo ogłasza nowe wytyczne na temat otwartych danych razem z gminą i powiatem.",
    "sv": "Departementet publicerar ny vägledning om öppna data tillsammans med kommunen och distriktet.",
}


def test_sentences_outside_the_training_data(model):
    got = model.cosines(list(TEXTS.values())).argmax(axis=1)
    assert [langid.LANGUAGES[k] for k in got] == list(TEXTS)


def test_stretches_labels_and_missing_texts(spark, model):
    values = [
        (1, "en-GB", TEXTS["en"], TEXTS["en"]), (2, "fr", TEXTS["en"], None), (3, "", TEXTS["de"], ""), (4, "de", TEXTS["de"], f"{TEXTS['fr']}\n{TEXTS['fr']} {TEXTS['sv']}"), (5, None, None, None), (6, "pl", "…", "12345"),
        (7, "ENG", TEXTS["en"], None), (8, "und", TEXTS["pl"], None), (8, "und", TEXTS["pl"], None), (9, "nl", None, TEXTS["nl"] + " " + TEXTS["nl"] * 300), (None, "xx", TEXTS["it"], None),
    ]
    a = spark.createDataFrame([(*v, "clash") for v in values], "article_id long, language string, title string, summary string, code string")
    got = sorted(map(tuple, langid.mislabelled(a, model).collect()), key=str)
    assert got == sorted([(2, 1, "en"), (3, 1, "de"), (4, 1, "de"), (4, 2, "fr"), (4, 3, "sv"), (8, 1, "pl"), (None, 1, "it")], key=str)


def test_no_articles_no_languages(spark):
    a = spark.createDataFrame([], "article_id long, language string, title string, summary string")
    assert langid.mislabelled(a).count() == 0


def test_held_out_accuracy(spark, data, model):
    rows = read_table(spark, data, "articles").filter("language in ('en', 'de', 'fr', 'es', 'it', 'nl', 'pl', 'sv') and length(title) > 30").select("language", "title").collect()
    got = model.cosines([r["title"] for r in rows]).argmax(axis=1)
    # some labels are wrong on purpose
    assert np.mean([langid.LANGUAGES[k] == r["language"] for k, r in zip(got, rows, strict=True)]) > 0.88


def test_a_day_number_ends_no_sentence():
    assert langid.split("T", "Am 5. Mai 2020 beginnt es. Dann folgt mehr.") == ["T", "Am 5. Mai 2020 beginnt es.", "Dann folgt mehr."]


def test_recall_with_half_of_the_exemplars(monkeypatch):
    """Passages worded like exemplars that the index has not seen: half of each list is withheld, the other half must find them."""
    lists = {name: [x for x in getattr(residue, name).split("\n") if x] for name in ("FILLER", "ERRORS", "SCRIPTS")}
    for name, lines in lists.items():
        monkeypatch.setattr(residue, name, "\n".join(lines[::2]))
    index: dict[str, list[int]] = {}
    for i, kind, _, cover in residue.exemplars():
        if kind != "report":
            for w in cover:
                index.setdefault(w, []).append(i)
    kept = [residue._covered(residue.tokens(x.partition("|")[0]), index) for lines in lists.values() for x in lines[::2]]
    unseen = [residue._covered(residue.tokens(x.partition("|")[0]), index) for lines in lists.values() for x in lines[1::2]]
    assert all(kept)
    # wording that no exemplar has is mostly missed: the lists decide, as the README says
    assert 0.05 < sum(unseen) / len(unseen) < 0.9
    print("recall on withheld wording", round(sum(unseen) / len(unseen), 2))


def test_marks_of_any_length_and_wrapped_headlines():
    long = "{{ include " + "parameter=value " * 20 + "}}"
    assert residue.tokens(long)[-1] == "mark:mustache" and residue.tokens("[[post.excerpt | upper]]")[-1] == "mark:wiki"
    assert not [t for t in residue.tokens("[[The council extends the deadline]]") if t.startswith("mark:")]
