"""Problem 1: template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.tables import spread, work_table

#: Labelled exemplars. What editors leave, what servers say, what scriptless pages ask for.
FILLER = """
Text text text
Insert headline here
Insert title here
Add a short description of the item
Enter teaser text
Enter text here
Your text goes here
Your title here
Placeholder text
Sample title replace before publishing
Headline goes here
To be written
Hier Überschrift einfügen
Hier steht Ihr Text
Hier Text einfügen
Kurzbeschreibung ergänzen
Mustertitel bitte ersetzen
Blindtext bitte ersetzen
Insérer le titre ici
Votre texte ici
Ajouter un chapeau
Titre provisoire à remplacer
Saisir le texte ici
Inserte aquí el titular
Su texto aquí
Añadir entradilla
Título provisional sustituir antes de publicar
Inserire qui il titolo
Il tuo testo qui
Aggiungere un sommario
Titolo provvisorio da sostituire
Voer hier de titel in
Hier komt uw tekst
Samenvatting toevoegen
Voorbeeldtitel nog vervangen
Tu wpisz tytuł
Miejsce na tekst
Dodaj krótki opis
Tytuł roboczy do zmiany
Skriv rubriken här
Din text här
Lägg till en ingress
Exempelrubrik byt ut före publicering
"""
#: The usual filler text; every few consecutive words of it are an exemplar, and all its words cover a passage.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse "
    "cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
#: Words typed to fill a field; a run of x is one of them.
MASH = "test tests testing blah bla asdf asdfg asdfgh qwertz qwerty azerty foo foobar xyz tbd tba tbc todo tk tktk lorem ipsum dummy xx"
ERRORS = """
404 Not Found
Page not found
403 Forbidden
Access denied your request was blocked
Access denied
500 Internal Server Error
502 Bad Gateway
504 Gateway Time-out
Gateway Timeout
HTTP Error 503
The service is unavailable
Service temporarily unavailable try again later
Service Unavailable
Too many requests 429
An unexpected error occurred while loading this content
An error occurred
The requested resource could not be located on this server
The requested URL was not found on this server
Error establishing a database connection
Fatal error Uncaught Exception in on line|srv portal view php stack trace
Your session has expired
Please sign in again
Just a moment
Checking your browser before you continue
Checking your browser before accessing
Verify that you are human
Seite nicht gefunden
Zugriff verweigert Ihre Anfrage wurde gesperrt
Zugriff verweigert
Der Dienst ist vorübergehend nicht erreichbar
Beim Laden des Inhalts ist ein Fehler aufgetreten
Die angeforderte Ressource ist auf diesem Server nicht vorhanden
Ihre Sitzung ist abgelaufen
Page introuvable
Accès refusé votre requête a été bloquée
Accès refusé
Service momentanément indisponible
Une erreur est survenue lors du chargement du contenu
La ressource demandée n'existe pas sur ce serveur
Votre session a expiré
Página no encontrada
Acceso denegado su solicitud ha sido bloqueada
Acceso denegado
Servicio no disponible temporalmente
Se ha producido un error al cargar el contenido
El recurso solicitado no existe en este servidor
Su sesión ha caducado
Pagina non trovata
Accesso negato la richiesta è stata bloccata
Accesso negato
Servizio momentaneamente non disponibile
Si è verificato un errore durante il caricamento
La risorsa richiesta non esiste su questo server
La sessione è scaduta
Pagina niet gevonden
Toegang geweigerd uw verzoek is geblokkeerd
Toegang geweigerd
De dienst is tijdelijk niet beschikbaar
Er is een fout opgetreden bij het laden van de inhoud
De gevraagde bron bestaat niet op deze server
Uw sessie is verlopen
Nie znaleziono strony
Odmowa dostępu żądanie zostało zablokowane
Odmowa dostępu
Usługa jest chwilowo niedostępna
Podczas wczytywania treści wystąpił błąd
Żądany zasób nie istnieje na tym serwerze
Sesja wygasła
Sidan kunde inte hittas
Åtkomst nekad din begäran har blockerats
Åtkomst nekad
Tjänsten är tillfälligt otillgänglig
Ett fel uppstod när innehållet skulle laddas
Den begärda resursen finns inte på servern
Din session har gått ut
"""
SCRIPTS = """
Please enable JavaScript to view this page
You need to activate JavaScript in your browser settings to continue
This site requires scripts your browser has them turned off
Enable JavaScript and cookies to continue
Bitte aktivieren Sie JavaScript um diese Seite anzuzeigen
Für diese Anwendung müssen Skripte im Browser eingeschaltet sein
Veuillez activer JavaScript pour afficher cette page
Ce site nécessite les scripts désactivés dans votre navigateur
Active JavaScript para ver esta página
Este sitio necesita que los scripts estén habilitados
Abilita JavaScript per visualizzare questa pagina
Per usare il sito occorre attivare gli script nel browser
Schakel JavaScript in om deze pagina te bekijken
Deze website werkt alleen als scripts zijn toegestaan
Włącz obsługę JavaScript aby wyświetlić tę stronę
Do działania serwisu wymagane są skrypty w przeglądarce
Aktivera JavaScript för att visa sidan
Webbplatsen kräver att skript är påslagna i webbläsaren
"""
#: Words that a server adds to any of its messages.
TRAILERS = {"id", "request", "ref", "reference", "error", "http", "code", "status"}
#: What real announcements about marks say around them; a sentence that contains such a passage is news.
REPORTS = """
Project replaces style variables in official letter templates
Advisory unsafe handling in the portal software has been fixed
Avis faille corrigée dans le traitement des du logiciel
Hinweis Schwachstelle bei in der Software behoben
Le projet remplace les variables dans les modèles de lettres officielles
Das Vorhaben ersetzt Variablen in amtlichen Briefvorlagen
Aviso vulnerabilidad corregida en el tratamiento de del programa
Avviso vulnerabilità corretta nella gestione di del software
Waarschuwing kwetsbaarheid verholpen bij de verwerking van in de software
Komunikat usunięto lukę w obsłudze w oprogramowaniu
Meddelande sårbarhet åtgärdad i hanteringen av i programvaran
"""
_NAME = r"[^\W\d][\w.$]*(?: ?\| ?[\w.]+)?"
#: Shapes of template marks, filled or not; fixed values. A headline between double brackets is no mark: a mark holds one name.
SHAPES = {
    "mustache": r"\{\{[^{}\n]*\}\}", "block": r"\{%[^%\n]*%\}", "dollar": r"[$#]\{[^{}\n]*\}", "server": r"<%[^>\n]*%>", "processing": r"<\?[^>\n]*\?>", "wiki": r"\[\[\s*[^\s\[\]|]+(?:\s*\|\s*[^\s\[\]|]+)*\s*\]\]",
    "format": rf"%\({_NAME}\)s", "percent": rf"%%{_NAME}%%", "at": rf"@@{_NAME}@@", "dunder": r"__[^\W\d_][\w.$]*?(?: ?\| ?[\w.]+?)?__", "brace": rf"\{{{_NAME}\}}",
    "bracket": rf"\[(?!(?:sic|pdf|video|audio|live|update|foto|photo|podcast|eng?|de|fr|es|it|nl|pl|sv)\]){_NAME}\]",
}
MARK = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape in SHAPES.items()), re.IGNORECASE)
#: Share of an exemplar's TF-IDF weight that a passage must contain, and share of the passage's words that the exemplar must cover.
CONTAINED = 0.8
COVERED = 0.6
#: Two words of a filler vocabulary, or one that is all there is, make a passage filler if the vocabulary covers so much of it.
FILLED = 0.75
#: The same share for a passage around a mark and a report.
REPORTED = 0.6


_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"x{2,}")
_LINES = re.compile(r"[\n\r]+")
_ENDING = re.compile(r"[.!?…]\]?\s")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…]\])\s+")
#: Passages whose words a task remembers; boilerplate recurs all the time.
REMEMBERED = 20_000


def _words(text: str) -> list[str]:
    """The folded words of text; those with a digit in them (ids, years) are left out, and a run of x is one word."""
    words = [w for w in _WORD.findall(text.upper().lower()) if w.isalpha()]
    return ["xx" if w[0] == "x" and _RUN.fullmatch(w) else w for w in words]


def tokens(text: str) -> list[str]:
    """The words of a passage, and a token for the shape of each of its template marks."""
    if not any(c in text for c in "{<%@[_#"):
        return _words(text)
    shapes = [f"mark:{m.lastgroup}" for m in MARK.finditer(text)]
    return [*_words(MARK.sub(" ", text)), *shapes] if shapes else _words(text)


def exemplars() -> list[tuple[int, str, set[str], set[str]]]:
    """(id, kind, words to contain, words that cover a passage)."""
    lorem = LOREM.split()
    chunks = [{"lorem", "ipsum"}, *({*lorem[i : i + 5]} for i in range(2, len(lorem) - 4, 2))]
    out = [(i, "filler", c, {*lorem}) for i, c in enumerate(chunks)]
    for words in (lorem, MASH.split()):
        out.append((len(out), "words", {w for w in words if len(w) > 3 or words is not lorem}, {*words}))
    for kind, block in (("filler", FILLER), ("error", ERRORS), ("script", SCRIPTS), ("report", REPORTS)):
        for line in filter(None, block.split("\n")):
            core, _, more = line.partition("|")
            added = TRAILERS if kind == "error" else set()
            out.append((len(out), kind, {*_words(core)}, {*_words(core), *_words(more), *added}))
    out += [(len(out) + i, "mark", {f"mark:{shape}"}, {f"mark:{shape}"}) for i, shape in enumerate(SHAPES)]
    return out


def passages(title: str | None, summary: str | None) -> list[str]:
    """The title, its sentences and those of the summary; equal ones once."""
    parts = dict.fromkeys((title,)) if title else {}
    for text in (title, summary):
        for line in _LINES.split(text) if text else ():
            if _ENDING.search(line):
                parts.update(dict.fromkeys(_SENTENCES.split(line)))
            else:
                parts[line] = None
    return [p for p in parts if p and not p.isspace()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, the passage frequencies of the exemplars' words, and the passages that some exemplar may explain.

    A passage is retrieved through the inverted index token -> exemplars: an exemplar of a mark has its token in it, or
    another exemplar covers enough of its words. What no exemplar covers can't be residue whatever the weights, so they are
    not needed yet.
    """
    index: dict[str, list[int]] = {}
    for i, kind, _, cover in exemplars():
        if kind != "report":
            for w in cover:
                index.setdefault(w, []).append(i)
    known = {w for _, _, core, _ in exemplars() for w in core}
    seen: dict[str, tuple[frozenset, bool, bool]] = {}
    for b in batches:
        df: Counter = Counter()
        ids, texts, marks = [], [], []
        for i, title, summary in zip(b.column("article_id").to_pylist(), b.column("title").to_pylist(), b.column("summary").to_pylist(), strict=True):
            for p in passages(title, summary):
                if (found := seen.get(p)) is None:
                    words = tokens(p)
                    marked = words[-1:] != [] and words[-1].startswith("mark:")
                    found = (known.intersection(words), marked, marked or _covered(words, index))
                    if len(seen) < REMEMBERED:
                        seen[p] = found
                df[""] += 1
                for w in found[0]:
                    df[w] += 1
                if found[2]:
                    ids.append(i)
                    texts.append(p)
                    marks.append(found[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([*df, *[None] * len(ids)], pa.string()), pa.array([*df.values(), *[None] * len(ids)], pa.int64()), pa.array([*[None] * len(df), *ids], pa.int64()), pa.array([*[None] * len(df), *texts], pa.string()), pa.array([*[None] * len(df), *marks], pa.bool_())],
            ["word", "n", "article_id", "passage", "marked"],
        )


def _covered(words: list[str], index: dict[str, list[int]]) -> bool:
    met = [index[w] for w in words if w in index]
    if len(met) < COVERED * len(words) or not met:
        return False
    hits = Counter(e for es in met for e in es)
    return max(hits.values()) >= COVERED * len(words)


def weighted(df: dict[str, int], total: int) -> list[tuple]:
    """(exemplar, kind, words, covering words, weights, whole weight), a row per exemplar whatever the corpus."""
    idf = lambda w: math.log(1 + total / (1 + df.get(w, 0)))
    return [(i, kind, sorted(core), sorted(cover), {w: idf(w) for w in core}, sum(map(idf, core))) for i, kind, core, cover in exemplars()]


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _passage_tokens(text: str) -> list[str]:
    return tokens(text)


def residue(articles: DataFrame) -> DataFrame:
    """article_id, passage, reason: passages that are template residue, filler, an error page or a script notice.

    One narrow pass counts the passage frequencies of the exemplars' tokens over all articles and retrieves passages
    through an inverted index of the exemplars. Those are scored: the exemplar's TF-IDF weight a passage contains, and the
    share of the window that the exemplar covers: of the whole passage, or, for an exemplar of a template mark, of the mark
    itself. A mark in a passage that contains a report on such marks is none. Null or empty titles and summaries have no
    passages; a null article_id keeps its rows.
    """
    spark = articles.sparkSession
    scan = work_table(spread(articles.select("article_id", "title", "summary")).mapInArrow(_scan, "word string, n long, article_id long, passage string, marked boolean"), "residue")
    df = {r["word"]: r["n"] for r in scan.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row per word of the exemplars
    found = scan.filter("passage is not null").select("article_id", "passage", "marked", _passage_tokens("passage").alias("words"))
    found = work_table(found, "retrieved")
    table = spark.createDataFrame(weighted(df, df.get("", 0)), "exemplar int, kind string, core array<string>, cover array<string>, weight map<string,double>, whole double")
    index = table.select("exemplar", F.explode(F.array_union("core", "cover")).alias("word"))
    met = found.select("article_id", "passage", "marked", "words", F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(index), "word").drop("word").distinct()
    scored = met.join(F.broadcast(table), "exemplar")
    inside = F.aggregate(F.array_intersect("core", "words"), F.lit(0.0), lambda acc, w: acc + F.element_at("weight", w)) / F.col("whole")
    covered = F.size(F.filter("words", lambda w: F.array_contains(F.col("cover"), w))) / F.size("words")
    hits = F.size(F.filter("words", lambda w: F.array_contains(F.col("core"), w)))
    scored = scored.select("article_id", "passage", "marked", "kind", inside.alias("inside"), covered.alias("covered"), hits.alias("hits"))
    filled = (F.col("kind") == "words") & (F.col("covered") >= FILLED) & ((F.col("hits") >= 2) | (F.col("covered") == 1))
    window = F.when(F.col("kind") == "mark", 1.0).otherwise(F.col("covered"))  # a mark is a window of its own
    said = ~F.col("kind").isin("words", "report") & (F.col("inside") >= CONTAINED - 1e-9) & (window >= COVERED)
    cases = scored.filter(filled | said).select("article_id", "passage", F.when(F.col("kind") == "words", "filler").otherwise(F.col("kind")).alias("reason"))
    news = scored.filter((F.col("kind") == "report") & F.col("marked") & (F.col("inside") >= REPORTED)).select(F.col("article_id").alias("_id"), F.col("passage").alias("_news")).distinct()
    reported = (F.col("reason") == "mark") & F.col("article_id").eqNullSafe(F.col("_id")) & (F.col("passage") == F.col("_news"))
    return cases.join(news, reported, "left_anti").distinct()


def residue_articles(articles: DataFrame) -> DataFrame:
    """article_id of every article with residue in its title or summary, once."""
    return residue(articles).select("article_id").distinct()


def without_residue(articles: DataFrame) -> DataFrame:
    """The articles that have none."""
    return articles.join(residue_articles(articles), "article_id", "left_anti")
