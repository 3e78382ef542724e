"""Boolean topic classification and overlays: one projection per text, no join and no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import normalise, normalised
from presswell.operators.lexicon import DEFAULT, TOPICS, Lexicon, Overlay, Term
from presswell.tables import spread

TEXT = "_text"


def contains(text: Column, word: str) -> Column:
    """Whether the normalised text has the word: as a whole word if it is short and of letters, else anywhere."""
    plain = normalise(word)
    if len(plain) <= 4 and plain.isalnum():
        return whole_word(text, plain)
    return F.contains(text, F.lit(plain))


def whole_word(text: Column, plain: str) -> Column:
    """Whether plain stands in the text as a word: most texts fail the plain search, and the pattern begins with the word itself."""
    word = re.escape(plain)
    return F.contains(text, F.lit(plain)) & text.rlike(f"(?U){word}(?!\\w)(?<!\\w{word})")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(normalise(w)))
    return hit


def _ordered(values: list[Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values))) if values else F.array().cast("array<string>")


def confidence(score: Column) -> Column:
    return F.when(score >= 4, "高").when(score >= 2, "中").when(score == 1, "低").otherwise("未命中")


def classify(articles: DataFrame, lexicon: Lexicon = DEFAULT, title: str = "title", summary: str = "summary") -> DataFrame:
    """articles with topics (codes, in rule order), keywords, score and confidence.

    A rule with hits scores its weight and one more for each further hit, two at most; a guarded short form scores only
    where its topic is new. A null title or summary counts as empty. Each keyword is one literal pattern in one
    projection, so the scan stays a single narrow stage; the text is normalised once.
    """
    df = spread(articles).withColumn(TEXT, _whole(title, summary))
    text = F.col(TEXT)
    hits = F.array(*[F.array_compact(F.array(*[F.when(contains(text, k), F.lit(k)) for k in r.keywords])) for r in lexicon.rules])
    signs = [_any(text, x.words) for r in lexicon.rules for x in r.signals]
    met = [contains(text, a.word) & _some([contains(text, c) for c in a.contexts]) for a in lexicon.acronyms]
    df = _computed(df, _hits=hits, _signs=F.array(*signs, F.lit(False)), _met=F.array(*met, F.lit(False)))
    topics = _ordered(_emitted(lexicon, F.col("_hits"), F.col("_signs")))
    df = _computed(df, _topics=topics)
    fresh = lambda i, a: F.col("_met")[i] & ~F.array_contains("_topics", a.topic) & ~_some([F.col("_met")[j] for j, b in enumerate(lexicon.acronyms[:i]) if b.topic == a.topic])
    score: Column = F.lit(0)
    for i, r in enumerate(lexicon.rules):
        n = F.size(F.col("_hits")[i])
        score = score + F.when(n > 0, F.lit(r.weight) + F.least(n - 1, F.lit(2))).otherwise(0)
    for i, a in enumerate(lexicon.acronyms):
        score = score + F.when(fresh(i, a), a.score).otherwise(0)
    short = lambda f: [F.when(F.col("_met")[i], F.lit(f(a))) for i, a in enumerate(lexicon.acronyms)]
    added, shown = (F.array_compact(F.array(*short(f), F.lit(None).cast("string"))) for f in (lambda a: a.topic, lambda a: a.word.upper()))
    df = df.drop("topics", "keywords", "score", "confidence")
    out = _computed(df, topics=F.array_distinct(F.concat("_topics", added)), keywords=F.array_distinct(F.concat(F.flatten("_hits"), shown)), score=score)
    return out.drop("_hits", "_signs", "_met", "_topics", TEXT).withColumn("confidence", confidence(F.col("score")))


def _computed(df: DataFrame, **values: Column) -> DataFrame:
    """df with the columns, computed once per row: a projection would be merged into those above it and repeat the work."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _whole(title: str, summary: str) -> Column:
    return normalised(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit(""))))


def _some(values: list[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v
    return out


def _emitted(lexicon: Lexicon, hits: Column, signs: Column) -> list[Column]:
    """The topics that the rules' hits and the text's signals lead to, in rule order."""
    out, at = [], 0
    for i, r in enumerate(lexicon.rules):
        hit = F.size(hits[i]) > 0
        out += [F.when(hit, F.lit(t)) for t in r.topics]
        out += [F.when(F.arrays_overlap(hits[i], F.array(*map(F.lit, s.words))), F.lit(s.topic)) for s in r.by_hit]
        own = [signs[at + j] for j in range(len(r.signals))]
        out += [F.when(hit & x, F.lit(r.signals[j].topic)) for j, x in enumerate(own)]
        if r.default:
            out.append(F.when(hit & ~_some(own), F.lit(r.default)))
        at += len(own)
    return out


def _met(text: Column, language: Column, t: Term) -> Column:
    hit = whole_word(text, normalise(t.text))
    return hit if t.language == "*" else hit & F.coalesce(language == t.language, F.lit(False))


def overlay(articles: DataFrame, profile: Overlay, title: str = "title", summary: str = "summary") -> DataFrame:
    """Classified articles with topics, keywords, score and confidence as the overlay sees them.

    Per topic, the strongest term of each concept counts, terms of the penalty list take one away, a topic found before
    adds one, and an excluded term silences the topic. Term languages are matched with the article's language column.
    """
    topics = [t for t in profile.topics if t.enabled]
    terms: dict[Term, int] = {}
    for t in topics:
        for term in (*t.keywords, *t.synonyms, *t.penalties, *t.excludes):
            terms.setdefault(term, len(terms))
    df = articles.withColumn(TEXT, _whole(title, summary))
    # every term is tried once; what follows only looks the answers up
    df = _computed(df, _hit=F.array(*[_met(F.col(TEXT), F.col("language"), t) for t in terms], F.lit(False)))

    def found(r: Column) -> Column:
        rows = []
        hit = lambda t: r["_hit"][terms[t]]
        for t in topics:
            concepts: dict[str, list[Column]] = {}
            for term, weight in [*((k, k.weight) for k in t.keywords), *((x, 1.0) for x in t.synonyms)]:
                concepts.setdefault(term.concept or term.text, []).append(F.when(hit(term), F.lit(weight)).otherwise(0.0))
            total: Column = F.lit(0.0)
            for values in concepts.values():
                total = total + (F.greatest(*values) if len(values) > 1 else values[0])
            for p in t.penalties:
                total = total - F.when(hit(p), 1.0).otherwise(0.0)
            origin = t.legacy or t.name
            inherited = F.array_contains(r["topics"], origin) if t.inherit and origin in TOPICS else F.lit(False)
            total = total + F.when(inherited, 1.0).otherwise(0.0)
            words = F.array_compact(F.array(*[F.when(hit(x), F.lit(x.text)) for x in (*t.keywords, *t.synonyms)], F.lit(None).cast("string")))
            rows.append(F.struct(F.lit(t.name).alias("name"), F.when(_some([hit(e) for e in t.excludes]), 0.0).otherwise(total).alias("total"), inherited.alias("kept"), words.alias("words")))
        return F.filter(F.array(*rows), lambda f: f["total"] > 0)

    def outcome(r: Column, f: Column) -> Column:
        some = F.size(f) > 0
        best = F.greatest(F.lit(1.0), F.array_max(F.transform(f, lambda x: x["total"])), F.when(F.exists(f, lambda x: x["kept"]), r["score"].cast("double")).otherwise(0.0))
        words = F.array_distinct(F.concat(r["keywords"], F.flatten(F.transform(f, lambda x: x["words"]))))
        none = F.array().cast("array<string>")
        return F.struct(F.transform(f, lambda x: x["name"]).alias("topics"), F.when(some, best).otherwise(0.0).cast("int").alias("score"), F.when(some, words).otherwise(none).alias("keywords"))

    state = F.struct("topics", "keywords", "score", "_hit")
    df = _computed(df, _o=_let(state, lambda r: _let(found(r), lambda f: outcome(r, f))))
    out = df.withColumns({k: F.col("_o")[k] for k in ("topics", "score", "keywords")})
    return out.drop("_hit", "_o", TEXT).withColumn("confidence", confidence(F.col("score")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Kinds of content and the words that show them, the first match counting.
CONTENT_KINDS = (
    ("執法／裁罰", ("fine", "penalty", "sanction", "enforcement", "amende", "bußgeld")),
    ("法規／指引", ("regulation", "directive", "law", "guideline", "règlement", "loi", "leitlinie", "gesetz")),
    ("公開諮詢", ("consultation", "call for evidence", "konsultation")),
    ("研究／評估", ("study", "report", "research", "evaluation", "étude", "rapport", "forschung", "studie")),
    ("資安公告", ("advisory", "vulnerability", "incident", "alerte", "vulnérabilité", "schwachstelle", "warnung")),
)
OTHER_KIND = "政策／一般新聞"
#: Levels of authority and the parts of an institution type that show them.
AUTHORITY = (
    ("立法機關", ("立法", "議會")),
    ("主管／監理機關", ("監理", "主管機關", "政策主管", "行政機關", "中央政策")),
    ("法定機構／行政法人", ("法定", "聯合事業", "行政法人")),
    ("公私協力／產學平台", ("公私協力", "產學", "產業群聚")),
    ("政策智庫", ("智庫",)),
)
OTHER_AUTHORITY = "研究／支援機構"


def first_match(text: Column, groups: tuple[tuple[str, tuple[str, ...]], ...], other: str) -> Column:
    chain = None
    for name, words in groups:
        hit = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(text, F.lit(w))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(other)


def content_kind(text: Column) -> Column:
    return first_match(F.lower(text), CONTENT_KINDS, OTHER_KIND)


def authority_level(institution_type: Column) -> Column:
    return first_match(F.coalesce(institution_type, F.lit("")), AUTHORITY, OTHER_AUTHORITY)
