"""Problem 5: the language of each text, and of each stretch where languages mix."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.tables import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pl", "sv")
#: Other spellings of the codes.
SPELLINGS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "español": "es", "ita": "it", "italian": "it", "italiano": "it", "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl",
    "pol": "pl", "polish": "pl", "polski": "pl", "swe": "sv", "swedish": "sv", "svenska": "sv",
}
#: Rows per language that the classifier is fitted on; all other steps read all rows.
SAMPLE = 200
SEED = 23
DIMENSIONS = 1 << 14
CENTROIDS = 2
ROUNDS = 6
#: A piece is left undecided when its best language leads by less than so much, or lies farther from it than this cosine.
LEAD = 0.04
LEAST = 0.08
#: Below this cosine a piece is near no language.
NEAR = 0.04
#: Letters below which a training piece is left out, and below which a sentence decides only where no longer piece does.
LETTERS = 4
SHORT = 25
#: By how much a stretch's language must lie nearer than that beside it, in one of its pieces at least; a piece of fewer
#: letters than FULL counts in proportion, since the cosines of a short piece vary more.
OPEN = 0.1
FULL = 80


def _table() -> np.ndarray:
    """For every sign of the basic plane its small letter, or a blank; 0 stays 0."""
    out = np.full(65536, 32, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    out[0] = 0
    return out


_LOWER: list[np.ndarray] = []


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, hashed feature and count of every letter trigram and every whole word of the pieces, sorted by piece."""
    if not _LOWER:
        _LOWER.append(_table())
    joined = "\0 " + " \0 ".join(p.replace("\0", " ") for p in pieces) + " "
    codes = _LOWER[0][np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)]
    codes = codes[~((codes == 32) & (np.append(0, codes[:-1]) == 32))]
    owner = np.cumsum(codes == 0) - 1
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    whole = (a != 0) & (b != 0) & (c != 0)
    h = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    key = owner[2:][whole].astype(np.int64) * DIMENSIONS + (h[whole] >> np.uint32(18)).astype(np.int64)
    letter = (codes != 0) & (codes != 32)
    first = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    if len(first):
        # a word's hash: its letters, each times a power of its place
        place = np.arange(len(codes)) - np.repeat(np.append(0, first), np.diff(np.append(np.append(0, first), len(codes))))
        value = np.where(letter, codes, 0).astype(np.uint64) * _power(int(place.max()) + 1)[place]
        word = np.add.reduceat(value, first) * np.uint64(0x9E3779B97F4A7C15)
        word = (word ^ (word >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        key = np.append(key, owner[first].astype(np.int64) * DIMENSIONS + (word >> np.uint64(50)).astype(np.int64))
    key, count = np.unique(key, return_counts=True)
    return key // DIMENSIONS, key % DIMENSIONS, count.astype(np.float32)


def _power(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64."""
    out = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Model:
    """Inverse document frequencies and unit centroids: weight has one column per centroid, language its language's number."""

    idf: np.ndarray
    weight: np.ndarray
    language: np.ndarray

    def cosines(self, pieces: list[str]) -> np.ndarray:
        """Cosine of each piece with the nearest centroid of each language."""
        out = np.zeros((len(pieces), len(LANGUAGES)), np.float32)
        if not pieces:
            return out
        piece, gram, count = grams(pieces)
        if not len(piece):
            return out
        value = count * self.idf[gram]
        norm = np.sqrt(np.bincount(piece, value * value, len(pieces))).astype(np.float32)
        sums = np.zeros((len(pieces), len(self.language)), np.float32)
        for i in range(0, len(piece), 1 << 18):  # bounded slices of the gathered weights
            p, g, v = (x[i : i + (1 << 18)] for x in (piece, gram, value))
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sums[p[heads]] += np.add.reduceat(self.weight[g] * v[:, None], heads, axis=0)
        for k in range(len(LANGUAGES)):
            out[:, k] = sums[:, self.language == k].max(axis=1, initial=0)
        return out / np.maximum(norm, 1e-9)[:, None]


def _vectors(pieces: list[str], idf: np.ndarray) -> np.ndarray:
    piece, gram, count = grams(pieces)
    x = np.zeros((len(pieces), DIMENSIONS), np.float32)
    x[piece, gram] = count * idf[gram]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[str, str | None, str | None]]) -> Model:
    """A model from (language, title, summary).

    Labels may be wrong: a piece has the label that more than half of its rows have; a first centroid per language comes
    from these, pieces that lie clearly nearer to another language are dropped until nothing changes, and what is left of
    each language is clustered into a few centroids.
    """
    votes: dict[str, Counter] = {}
    for code, title, summary in rows:
        for p in {p for p in split(title, summary) if len(p) >= LETTERS}:
            votes.setdefault(p, Counter())[LANGUAGES.index(code)] += 1
    labelled = sorted((k, p) for p, v in votes.items() for k, n in v.items() if 2 * n > v.total())
    label, pieces = np.array([k for k, _ in labelled], int), [p for _, p in labelled]
    frequency = np.zeros(DIMENSIONS)
    if pieces:
        np.add.at(frequency, grams(pieces)[1], 1)
    idf = np.log((1 + len(pieces)) / (1 + frequency)).astype(np.float32) + 1
    keep = np.ones(len(pieces), bool)
    for _ in range(ROUNDS):
        centre = np.zeros((DIMENSIONS, len(LANGUAGES)), np.float32)
        for k in range(len(LANGUAGES)):
            own = [pieces[i] for i in np.flatnonzero(keep & (label == k))]
            if own:
                c = _vectors(own, idf).sum(axis=0)
                centre[:, k] = c / max(float(np.linalg.norm(c)), 1e-9)
        scores = Model(idf, centre, np.arange(len(LANGUAGES))).cosines(pieces)
        if (fresh := scores.max(axis=1, initial=0) - scores[np.arange(len(pieces)), label] < LEAD).tolist() == keep.tolist():
            break
        keep = fresh
    weight, language = [], []
    random = np.random.default_rng(SEED)
    for k in range(len(LANGUAGES)):
        own = [pieces[i] for i in np.flatnonzero(keep & (label == k))]
        if not own:
            continue
        x = _vectors(own, idf)
        c = x[random.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        weight.extend(c)
        language.extend([k] * len(c))
    return Model(idf, np.array(weight, np.float32).reshape(-1, DIMENSIONS).T.copy(), np.array(language, int))


_LINES = re.compile(r"[\n\r]+")
_ENDING = re.compile(r"[.!?…]\s")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\W\d_]|[\[\"'«„“(©*»-])")
_ORDINAL = re.compile(r"(?:^|\s)\d{1,2}\.$")


def split(title: str | None, summary: str | None) -> list[str]:
    """The title, then the sentences of the summary; a day's number with a full stop ends none."""
    out = [title] if title and title.strip() else []
    for line in _LINES.split(summary) if summary else ():
        for part in _SENTENCE.split(line) if _ENDING.search(line) else (line,):
            if not part or part.isspace():
                continue
            if len(out) > 1 and out[-1][-1] == "." and out[-1][-2:-1].isdigit() and _ORDINAL.search(out[-1]):
                out[-1] += " " + part
            else:
                out.append(part)
    return out


def letters(pieces: list[str]) -> np.ndarray:
    """How many letters each piece has, wherever they stand."""
    if not _LOWER:
        _LOWER.append(_table())
    codes = _LOWER[0][np.frombuffer("".join(f"{p}\0" for p in (x.replace("\0", " ") for x in pieces)).encode("utf-16-le", "surrogatepass"), np.uint16)]
    return np.bincount(np.cumsum(codes == 0)[codes > 32], minlength=len(pieces) + 1)[: len(pieces)]


@dataclass(slots=True)
class Piece:
    """What one piece says: cosines by language, the nearest language, whether it decides, its share, and how much it counts."""

    cosines: list[float]
    language: int
    sure: bool
    share: float
    weight: float
    long: bool


def judged(pieces: list[str], cosines: np.ndarray) -> list[Piece]:
    """Per piece its nearest language, whether it decides, and that language's share in the sum of the cosines."""
    if not pieces:
        return []
    best = cosines.argmax(axis=1)
    two = np.partition(cosines, -2, axis=1)[:, -2:]
    sure = (two[:, 1] >= LEAST) & (two[:, 1] - two[:, 0] >= LEAD)
    share = np.where(two[:, 1] >= NEAR, two[:, 1] / np.maximum(cosines.sum(axis=1), 1e-9), 0.0)
    n = letters(pieces)
    return list(map(Piece, cosines.tolist(), best.tolist(), sure.tolist(), share.tolist(), np.minimum(1.0, n / FULL).tolist(), (n >= SHORT).tolist()))


def stretches(pieces: list[Piece]) -> list[tuple[int, float]]:
    """(language, confidence) of the maximal stretches of one text.

    Undecided pieces belong to the piece before them, or to the next where none is before; a short one never opens a
    stretch beside longer ones. Neighbouring pieces in one language make a run; as long as there is a run none of whose
    pieces lies nearer to its own language than to a neighbour's by OPEN, the weakest such run joins that neighbour.
    Confidence is the mean share of a stretch's pieces. Where no piece decides, the clearest one speaks for the whole text,
    if it is near any language at all; [] if none is.
    """
    deciding = [p for p in pieces if p.sure]
    if not deciding:
        clearest = max(pieces, key=lambda p: p.share, default=None)
        return [(clearest.language, round(clearest.share, 4))] if clearest and clearest.share > 0 else []
    if any(p.long for p in deciding):
        deciding = [p for p in deciding if p.long]
    runs: list[tuple[int, list[Piece]]] = []
    for p in deciding:
        if runs and runs[-1][0] == p.language:
            runs[-1][1].append(p)
        else:
            runs.append((p.language, [p]))
    while len(runs) > 1:
        by = lambda i, j: max(p.weight * (p.cosines[runs[i][0]] - p.cosines[runs[j][0]]) for p in runs[i][1])
        lead, i, j = min((by(i, j), i, j) for i in range(len(runs)) for j in (i - 1, i + 1) if 0 <= j < len(runs))
        if lead >= OPEN:
            break
        joined = (runs[j][0], runs[min(i, j)][1] + runs[max(i, j)][1])
        runs[min(i, j) : max(i, j) + 1] = [joined]
        # what now meets on both sides in one language is one run
        k = min(i, j)
        for a in (k, k - 1):
            if 0 <= a < len(runs) - 1 and runs[a][0] == runs[a + 1][0]:
                runs[a : a + 2] = [(runs[a][0], runs[a][1] + runs[a + 1][1])]
    return [(k, round(sum(p.share for p in ps) / len(ps), 4)) for k, ps in runs]


def label(code: Column) -> Column:
    """The two-letter code that a language field means, whatever its spelling; null if it means none of LANGUAGES."""
    base = F.lower(F.regexp_extract(F.trim(code), "^([\\p{L}]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in (SPELLINGS | {k: k for k in LANGUAGES}).items() for x in pair])
    return F.when(F.coalesce(F.regexp_replace(F.trim(code), "^[\\p{L}]+", ""), F.lit("")).rlike("^(?:[-_][\\p{L}\\p{N}]+)*$"), F.element_at(known, base))


def training_rows(articles: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str | None, str | None]]:
    """At most per_language labelled rows of each language, chosen by a hash of the id, brought to the driver for the fit."""
    n = articles.count()
    share = min(1.0, 60.0 * per_language / max(1, n))
    drawn = articles.filter(F.pmod(F.xxhash64(F.lit(SEED), "article_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = drawn.select(label(F.col("language")).alias("code"), "title", "summary", F.xxhash64("article_id").alias("h")).filter("code is not null and coalesce(title, summary) is not null")
    ranked = rows.withColumn("rank", F.expr("row_number() over (partition by code order by h, title, summary)")).filter(F.col("rank") <= per_language)
    return [(r["code"], r["title"], r["summary"]) for r in ranked.collect()]


def _classifier(model: Model):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes = b.column("article_id").to_pylist(), b.column("code").to_pylist()
            texts = [split(t, s) for t, s in zip(b.column("title").to_pylist(), b.column("summary").to_pylist(), strict=True)]
            known: dict[str, int] = {}
            at = [[known.setdefault(p, len(known)) for p in ps] for ps in texts]
            pieces = list(known)
            scores = np.zeros((len(pieces), len(LANGUAGES)), np.float32)
            step = 4000
            for i in range(0, len(pieces), step):
                scores[i : i + step] = model.cosines(pieces[i : i + step])
            known_pieces = judged(pieces, scores)
            columns: list[list] = [[], [], [], [], [], []]
            for i, code, where in zip(ids, codes, at, strict=True):
                found = stretches([known_pieces[k] for k in where])
                wrong = len(found) > 1 or (len(found) == 1 and LANGUAGES[found[0][0]] != code)
                for n, (k, sure) in enumerate(found or [(-1, 0.0)], 1):
                    for c, v in zip(columns, (i, n, LANGUAGES[k] if k >= 0 else None, sure, len(found), wrong), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["article_id", "seg_no", "lang_code", "confidence", "segments", "mislabelled"])

    return classify


def languages(articles: DataFrame, model: Model | None = None) -> DataFrame:
    """article_id, seg_no, lang_code, confidence, segments, mislabelled: one row per stretch in one language.

    Cosine to several centroids per language, rejection of pieces that lie far from all or between two. The model, a few
    hundred kilobytes whatever the data, goes to the tasks with the code. A text without letters, or far from every
    language, has one row with a null language and confidence 0; it is never called mislabelled. Repeated rows repeat.
    """
    model = model or fit(training_rows(articles))
    return spread(articles.select("article_id", label(F.col("language")).alias("code"), "title", "summary")).mapInArrow(_classifier(model), "article_id long, seg_no int, lang_code string, confidence double, segments int, mislabelled boolean")


def mislabelled(articles: DataFrame, model: Model | None = None) -> DataFrame:
    """article_id, seg_no, lang_code of articles whose language is missing, wrong or not the only one."""
    return languages(articles, model).filter("mislabelled").select("article_id", "seg_no", "lang_code").distinct()
