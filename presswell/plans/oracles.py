"""The same results in SQL, for those core queries that SQL can express."""

from __future__ import annotations

import re

from presswell.functions.text import STOP_WORDS, normalise
from presswell.operators.classify import AUTHORITY, CONTENT_KINDS, OTHER_AUTHORITY, OTHER_KIND
from presswell.operators.lexicon import DEFAULT, TOPICS
from presswell.operators.periods import DATE_LANGUAGES
from presswell.operators.rank import topic_terms
from presswell.operators.relations import NAVIGATION
from presswell.plans.queries import FLAGSHIP, OVERLAY, SINCE, UNTIL
from presswell.sinks.reports import LEGAL, OFFICIAL, RESEARCH



def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(map(_q, words))


STOPS = _in(STOP_WORDS)
TOKEN = r"'[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, {TOKEN}), lambda w: w NOT IN ({STOPS}))"


#: normalised title and summary, as far as these texts need it
PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(lower({0}), 'ß', 'ss'), '’', ''''), '–', '-'), '…', '...'), '[\s\p{{Z}}]+', ' ', 'g'))"
WHOLE = PLAIN.format("(coalesce(title, '') || ' ' || coalesce(summary, ''))")


def _has(word: str) -> str:
    plain = normalise(word)
    if len(plain) <= 4 and plain.isalnum():
        return _word(plain)
    return f"contains(t, {_q(plain)})"


def _word(plain: str) -> str:
    return f"regexp_matches(' ' || t || ' ', {_q('[^\\p{L}\\p{N}_]' + re.escape(plain).replace(chr(92) + ' ', ' ') + '[^\\p{L}\\p{N}_]')})"


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts or ["false"]) + ")"


def _list(parts: list[tuple[str, str]]) -> str:
    """A list of those texts whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(v)} END" for v, c in parts) + "], lambda x: x IS NOT NULL)"


def _classified() -> str:
    """article_id, language, t, topics and keywords (sorted lists), score, of the default lexicon."""
    rules, topics, score = [], [], []
    for i, r in enumerate(DEFAULT.rules):
        rules.append(f"{_list([(k, _has(k)) for k in r.keywords])} AS h{i}")
        hit = f"len(h{i}) > 0"
        score.append(f"CASE WHEN {hit} THEN {r.weight} + least(len(h{i}) - 1, 2) ELSE 0 END")
        topics += [(t, hit) for t in r.topics]
        topics += [(s.topic, f"list_has_any(h{i}, [{_in(s.words)}])") for s in r.by_hit]
        signs = [_or([f"contains(t, {_q(normalise(w))})" for w in s.words]) for s in r.signals]
        topics += [(s.topic, f"{hit} AND {c}") for s, c in zip(r.signals, signs, strict=True)]
        if r.default:
            topics.append((r.default, f"{hit} AND NOT {_or(signs)}"))
    met = [f"{_has(a.word)} AND {_or([_has(c) for c in a.contexts])} AS m{i}" for i, a in enumerate(DEFAULT.acronyms)]
    fresh = []
    for i, a in enumerate(DEFAULT.acronyms):
        earlier = [f"m{j}" for j, b in enumerate(DEFAULT.acronyms[:i]) if b.topic == a.topic]
        fresh.append((a, f"m{i} AND NOT list_contains(rt, {_q(a.topic)}) AND NOT {_or(earlier)}"))
    hits = " || ".join(f"h{i}" for i in range(len(DEFAULT.rules)))
    return f"""
      SELECT *, {" + ".join(score)} + {" + ".join(f"CASE WHEN {c} THEN {a.score} ELSE 0 END" for a, c in fresh)} AS score,
        list_sort(list_distinct(rt || {_list([(a.topic, f"m{i}") for i, a in enumerate(DEFAULT.acronyms)])})) AS topics,
        list_sort(list_distinct({hits} || {_list([(a.word.upper(), f"m{i}") for i, a in enumerate(DEFAULT.acronyms)])})) AS keywords
      FROM (SELECT *, list_distinct({_list(topics)}) AS rt FROM (
        SELECT *, {", ".join(rules + met)} FROM (SELECT article_id, source_id, language, title, summary, {WHOLE} AS t FROM articles)))"""


def _sheets() -> str:
    cases = [(name, condition) for name, condition in zip(("全部命中新聞", "CRA_CSA_NIS2_CER", "官方規範與執法", "研究智庫與公私協力"), ("true", f"list_has_any(topics, [{_in(LEGAL)}])", f"level IN ({_in(OFFICIAL)})", f"level IN ({_in(RESEARCH)})"), strict=True)]
    return f"SELECT sheet, count(*) AS n FROM (SELECT unnest({_list(cases)}) AS sheet FROM (SELECT c.topics, {_first_match('k', AUTHORITY, OTHER_AUTHORITY)} AS level FROM ({_classified()}) c JOIN (SELECT article_id, coalesce(institution_type, '') AS k FROM articles) USING (article_id))) GROUP BY sheet"


CONFIDENCE = "CASE WHEN score >= 4 THEN '高' WHEN score >= 2 THEN '中' WHEN score = 1 THEN '低' ELSE '未命中' END"


def _overlay() -> str:
    """The overlay's topics in order with totals, from the classified articles."""
    lang = lambda t: "" if t.language == "*" else f" AND coalesce(language = {_q(t.language)}, false)"
    has = lambda t: f"({_word(normalise(t.text))}{lang(t)})"
    cols, names = [], []
    for i, t in enumerate(OVERLAY.topics):
        concepts: dict[str, list[str]] = {}
        for k, w in [*((k, k.weight) for k in t.keywords), *((s, 1.0) for s in t.synonyms)]:
            concepts.setdefault(k.concept or k.text, []).append(f"CASE WHEN {has(k)} THEN {w} ELSE 0 END")
        total = " + ".join([f"greatest({', '.join([*v, '0'])})" for v in concepts.values()] + [f"CASE WHEN {has(p)} THEN -1 ELSE 0 END" for p in t.penalties])
        inherited = f"list_contains(topics, {_q(t.legacy or t.name)})" if t.inherit and (t.legacy or t.name) in TOPICS else "false"
        cols += [f"CASE WHEN {_or([has(e) for e in t.excludes])} THEN 0 ELSE {total} + CASE WHEN {inherited} THEN 1 ELSE 0 END END AS s{i}", f"{inherited} AS k{i}", f"{_list([(k.text, has(k)) for k in (*t.keywords, *t.synonyms)])} AS w{i}"]
        names.append((t.name, f"s{i} > 0"))
    n = range(len(OVERLAY.topics))
    return f"""
      SELECT article_id, array_to_string(names, '|') AS topics, array_to_string(list_sort(list_distinct(keywords || {" || ".join(f"CASE WHEN s{i} > 0 THEN w{i} ELSE [] END" for i in n)})), '|') AS keywords,
        CAST(floor(greatest(1, {", ".join(f"s{i}" for i in n)}, CASE WHEN {_or([f"(s{i} > 0 AND k{i})" for i in n])} THEN score ELSE 0 END)) AS INTEGER) AS score
      FROM (SELECT *, {_list(names)} AS names FROM (SELECT *, {", ".join(cols)} FROM ({_classified()}))) WHERE len(names) > 0"""


def _bm25(words: str, key: str, table: str, terms: dict[str, list[str]]) -> str:
    """CTEs docs, q, df, tf, sizes, scores(id, topic, score)."""
    values = ", ".join(f"({_q(t)}, {_q(w)})" for t, ws in terms.items() for w in ws)
    return f"""docs AS (SELECT id, words, len(words) AS n FROM (SELECT {key} AS id, {words} AS words FROM {table})),
      q(topic, term) AS (VALUES {values}), sizes AS (SELECT count(*) AS docs, avg(n) AS mean FROM docs),
      tf AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM tf GROUP BY term),
      scores AS (SELECT id, topic, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * n / mean)) ORDER BY tf.term), 4) AS score
        FROM tf JOIN df USING (term) JOIN q USING (term), sizes GROUP BY id, topic)"""


DOC_WORDS = _tokens("lower(coalesce(text, ''))")
_TITLE, _BODY = (_tokens(PLAIN.format(f"coalesce({c}, '')")) for c in ("title", "summary"))
ARTICLE_WORDS = f"{_TITLE} || {_TITLE} || {_BODY}"
MICROS = "epoch_us({0})"
_FOLD = "lower(trim(coalesce(title, ''), ' \t\n\r ​'))"

STATUS = rf"""
  SELECT s.id AS source_id, critical, coalesce(raw, 0) AS raw, coalesce(dated, 0) AS dated, coalesce(in_range, 0) AS in_range,
    round(CASE WHEN coalesce(raw, 0) > 0 THEN (raw - dated) / raw ELSE 0 END, 4) AS undated_ratio,
    CASE WHEN coalesce(raw, 0) > 0 THEN round(titles / raw, 4) ELSE 1 END AS unique_title_ratio, epoch_us(newest) AS newest_micros,
    round(greatest(0, (epoch_us(TIMESTAMPTZ '{UNTIL}') - epoch_us(newest)) / 86400000000), 2) + CASE WHEN newest IS NULL THEN 0 ELSE 0 END AS lag_days,
    CASE WHEN coalesce(raw, 0) = 0 THEN 'empty' WHEN date_policy = 'unavailable' THEN 'exception' WHEN (raw - dated) / raw > 0.25 THEN 'attention' ELSE 'healthy' END AS parse_status,
    CASE WHEN newest IS NULL THEN 'unknown' WHEN greatest(0, (epoch_us(TIMESTAMPTZ '{UNTIL}') - epoch_us(newest)) / 86400000000) > freshness_days THEN 'stale' ELSE 'fresh' END AS freshness_status
  FROM sources s LEFT JOIN (SELECT source_id, count(*) AS raw, count(published_at) AS dated, max(published_at) AS newest,
      count(*) FILTER (published_at >= TIMESTAMPTZ '{SINCE}' AND published_at < TIMESTAMPTZ '{UNTIL}') AS in_range,
      count(DISTINCT lower(regexp_replace(coalesce(title, ''), '^[\s\p{{Z}}\x{{200b}}\x{{feff}}]+|[\s\p{{Z}}\x{{200b}}\x{{feff}}]+$', '', 'g'))) AS titles
    FROM articles GROUP BY source_id) a ON a.source_id = s.id"""

QUALITY = """
  SELECT count(*) AS articles, count(published_at) AS dated, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (w = 'high') / count(*), 4) ELSE 1 END AS high_rate,
    (SELECT string_agg(w || '=' || n, ';' ORDER BY w) FROM (SELECT w, count(*) AS n FROM a GROUP BY w)) AS confidences
  FROM a"""
QUALITY_CTE = "WITH a AS (SELECT published_at, coalesce(nullif(lower(trim(date_confidence)), ''), 'none') AS w FROM articles)"

DAYS = """
  SELECT *, value >= 0.6 * avg(value) OVER (PARTITION BY source_id) AS success, value < 0.9 * avg(value) OVER (PARTITION BY source_id) AS failed
  FROM (SELECT event_type AS source_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS "at", count(*) AS raw_count, sum(value) AS value, count(DISTINCT user_id) AS request_count FROM events GROUP BY ALL)"""
W8 = 'OVER (PARTITION BY source_id ORDER BY "at" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)'
TRAILING = f"""
  SELECT source_id, "at", raw_count, success, failed, coalesce(median(CASE WHEN success AND raw_count > 0 THEN CAST(raw_count AS DOUBLE) END) {W8}, 0) AS median_count,
    count(CASE WHEN success AND raw_count > 0 THEN 1 END) {W8} AS counts, count(CASE WHEN success THEN 1 END) {W8} AS successes,
    CAST(least(n - 1 - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY source_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS INTEGER) AS failures_before,
    coalesce(median(CASE WHEN success AND request_count > 0 THEN CAST(request_count AS DOUBLE) END) {W8}, 0) AS median_request_count
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "at") AS n FROM ({DAYS}))"""

HOST = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
KEY = "regexp_replace(lower(" + HOST + r"), '^www\.', '') || coalesce(nullif(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')"
TARGET = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000000 <> 0 THEN '.' || lpad(CAST({0} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"
STRIP = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}\x{{200b}}\x{{feff}}]+|[\s\p{{Z}}\x{{200b}}\x{{feff}}]+$', '', 'g')"


def _first_match(text: str, groups: tuple, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_or([f'contains({text}, {_q(w)})' for w in words])} THEN {_q(name)}" for name, words in groups) + f" ELSE {_q(other)} END"


def core_oracles() -> dict[str, str]:
    terms = topic_terms()
    allowed = "CASE WHEN contains(institution_type, '資料保護') THEN ['PRIVACY', 'DATA', 'IDENTITY'] ELSE ['AI', 'NIS2', 'PRODUCT', 'SUPPLY', 'PLATFORM', 'CHIPS', 'DATA', 'IDENTITY'] END"
    ranked = f"""WITH {_bm25(ARTICLE_WORDS, "article_id", "articles", terms)},
      c AS ({_classified()}), m AS (SELECT id AS source_id, {allowed} AS allowed, 'AI ' || country AS ai, name AS nis FROM sources WHERE country IN ('EU', 'DE', 'FR', 'IE', 'AT')),
      r AS (SELECT c.article_id, c.score, CASE WHEN allowed IS NULL THEN topics ELSE list_filter(topics, lambda x: list_contains(allowed, x)) END AS topics, allowed IS NOT NULL AS own, ai, nis FROM c LEFT JOIN m USING (source_id)),
      b AS (SELECT article_id, max(coalesce(s.score, 0)) AS bm25 FROM (SELECT article_id, unnest(topics) AS topic FROM r) x LEFT JOIN scores s ON s.id = x.article_id AND s.topic = x.topic GROUP BY article_id)
      SELECT article_id, array_to_string(topics, '|') AS topics, CAST(score AS INTEGER) AS boolean_score, bm25,
        coalesce(nullif(array_to_string(list_sort(list_filter([CASE WHEN own AND list_contains(topics, 'AI') THEN ai END, CASE WHEN own AND list_contains(topics, 'NIS2') THEN nis END], lambda x: x IS NOT NULL)), '|'), ''), '未設定') AS owners,
        {CONFIDENCE} AS confidence
      FROM r JOIN b USING (article_id) WHERE len(topics) > 0 AND score > 0 AND bm25 >= 0.15"""
    observed = "TIMESTAMPTZ '2022-02-25T00:00:00Z'"
    nav = r"regexp_replace(lower(trim(title)), '^[ .:›»←→]+|[ .:›»←→]+$', '', 'g')"
    return {
        "flagship_bm25": f"WITH {_bm25(DOC_WORDS, 'doc_id', 'documents', FLAGSHIP)} SELECT id AS doc_id, topic, score FROM scores WHERE score >= 0.15",
        "bm25_statistics": f"WITH {_bm25(DOC_WORDS, 'doc_id', 'documents', FLAGSHIP)} SELECT term, df, CAST(tf AS BIGINT) AS tf, docs AS n, round(mean, 4) AS average FROM df, sizes",
        "topic_scores": f"SELECT article_id, array_to_string(topics, '|') AS topics, array_to_string(keywords, '|') AS keywords, CAST(score AS INTEGER) AS score, {CONFIDENCE} AS confidence FROM ({_classified()})",
        "overlay_scores": f"SELECT *, {CONFIDENCE} AS confidence FROM ({_overlay()})",
        "topic_counts": f"SELECT topic, count(*) AS articles, CAST(sum(score) AS BIGINT) AS score FROM (SELECT unnest(topics) AS topic, score FROM ({_classified()})) GROUP BY topic",
        "content_kinds": f"SELECT article_id, {_first_match('t', CONTENT_KINDS, OTHER_KIND)} AS content_kind, {_first_match('k', AUTHORITY, OTHER_AUTHORITY)} AS authority_level FROM (SELECT article_id, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS t, coalesce(institution_type, '') AS k FROM articles)",
        "ranked_articles": ranked,
        "identity_keys": f"SELECT id, {KEY.format('homepage')} AS home, {KEY.format('listing_url')} AS listing FROM sources",
        "url_policy": f"""SELECT source_id, count(*) AS allowed FROM (SELECT a.source_id, lower({HOST.format("trim(url)")}) AS host, {TARGET} AS target, s.* FROM articles a JOIN sources s ON s.id = a.source_id WHERE regexp_matches(lower(trim(url)), '^https?://'))
          WHERE len(list_filter(allow_domains, lambda x: host = lower(x) OR ends_with(host, '.' || lower(x)))) > 0
            AND (coalesce(len(include_patterns), 0) = 0 OR len(list_filter(include_patterns, lambda p: regexp_matches(target, '(?i)' || p))) > 0)
            AND coalesce(len(list_filter(exclude_patterns, lambda p: regexp_matches(target, '(?i)' || p))), 0) = 0 GROUP BY source_id""",
        "url_safety": rf"""SELECT code, count(*) AS n FROM (SELECT CASE WHEN url IS NULL OR url = '' OR regexp_matches(url, '[\s\\\x00-\x1f\x7f]') THEN 'malformed_url' WHEN NOT starts_with(lower(url), 'https://') THEN 'https_required'
            WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'url_credentials' WHEN host = '' OR port NOT IN ('', '443') THEN 'malformed_url'
            WHEN NOT regexp_matches(host, '^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?$') OR regexp_matches(host, '\.(?:localhost|local|internal|home|lan)$') THEN 'nonpublic_host' ELSE 'ok' END AS code
          FROM (SELECT url, lower({HOST.format("url")}) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d*)', 1) AS port FROM articles)) GROUP BY code""",
        "page_kinds": rf"SELECT NOT coalesce(regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(?:pdf|docx?|xlsx?|pptx?|zip|csv|xml|json|jpe?g|png|gif|svg|mp[34])$'), false) AS html, coalesce({nav} IN ({_in(NAVIGATION)}) OR regexp_matches({nav}, '^(?:page|seite)\s+\d+$'), false) AS navigation, count(*) AS n FROM documents GROUP BY ALL",
        "redacted_urls": r"SELECT article_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1'), '([?&](?:[^=&]*(?:token|key|secret|password|passwd|auth|signature|session)[^=&]*)=)[^&]*', '\1[redacted]', 'gi') AS redacted FROM articles",
        "selected_sources": "SELECT id, country FROM sources WHERE country IN ('DE', 'FR', 'EU')",
        "period_articles": "SELECT source_id, count(*) AS n, epoch_us(min(published_at)) AS first, epoch_us(max(published_at)) AS last FROM articles WHERE published_at >= TIMESTAMPTZ '2022-02-13T16:00:00Z' AND published_at < TIMESTAMPTZ '2022-02-20T16:00:00Z' GROUP BY source_id",
        "future_dates": f"SELECT source_id, count(*) FILTER (late) AS future, count(*) FILTER (late AND lower(trim(coalesce(date_confidence, ''))) <> 'low') AS unexplained, count(*) FILTER (published_at IS NOT NULL AND NOT late) AS dated FROM (SELECT *, coalesce(epoch_us(published_at) > epoch_us({observed}) + 86400000000, false) AS late FROM articles) GROUP BY source_id",
        "calendar_days": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1",
        "date_texts": r"SELECT candidate_id, coalesce(nullif(regexp_extract(raw_value, '\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?'), ''), nullif(regexp_extract(raw_value, '\d{1,2}[./]\d{1,2}[./]\d{4}'), ''), nullif(regexp_extract(raw_value, '\d{1,2}\.?\s+\p{L}+\.?\s+\d{4}'), ''), nullif(regexp_extract(raw_value, '\p{L}+\s+\d{1,2},?\s+\d{4}'), ''), '') AS found, CASE WHEN regexp_matches(raw_value, '\d{1,2}:\d{2}|T\d{2}') THEN 'datetime' ELSE 'date' END AS precision FROM date_candidates",
        "sheet_cells": r"SELECT article_id, CASE WHEN regexp_matches(t, '^[=+\-@]') THEN '''' || t ELSE t END AS title, CASE WHEN length(summary) > 200 THEN rtrim(summary[:199], ' ') || '…' ELSE summary END AS summary FROM (SELECT article_id, summary, regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM articles)",
        "event_values": "SELECT event_type, CAST(sum(k) AS BIGINT) AS k, max(k) AS most, count(k) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type",
        "source_status": STATUS,
        "run_summary": f"SELECT count(*) AS sources, count(*) FILTER (raw > 0) AS with_rows, count(*) FILTER (parse_status = 'empty') AS empty, count(*) FILTER (parse_status = 'attention') AS attention, count(*) FILTER (parse_status = 'healthy') AS healthy, count(*) FILTER (freshness_status = 'fresh') AS fresh, count(*) FILTER (freshness_status = 'stale') AS stale, count(*) FILTER (critical) AS critical, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(dated) AS BIGINT) AS dated, CAST(sum(in_range) AS BIGINT) AS in_range FROM ({STATUS})",
        "date_quality": f"{QUALITY_CTE} {QUALITY}",
        "quality_gate": f"""{QUALITY_CTE}, s AS ({STATUS}), g AS (SELECT CAST(1 AS DOUBLE) AS source_rate, avg(CASE WHEN parse_status NOT IN ('empty', 'failed', 'not_run') THEN 1 ELSE 0 END) AS parse_rate, count(*) FILTER (parse_status = 'empty') AS empty_sources,
            sum(dated) / sum(raw) AS date_rate, avg(CASE WHEN critical THEN CASE WHEN raw > 0 THEN dated / raw ELSE 0 END END) AS critical_rate FROM s), h AS ({QUALITY})
          SELECT source_rate, round(parse_rate, 6) AS parse_rate, round(date_rate, 6) AS date_rate, round(critical_rate, 6) AS critical_rate, round(high_rate, 6) AS high_rate, empty_sources,
            array_to_string(list_filter([CASE WHEN parse_rate < 0.95 THEN 'PARSE_SUCCESS_RATE_LOW' END, CASE WHEN empty_sources > 0 THEN 'EMPTY_SOURCE_LIMIT_EXCEEDED' END, CASE WHEN date_rate < 0.75 THEN 'OVERALL_DATE_RATE_LOW' END, CASE WHEN critical_rate < 0.95 THEN 'CRITICAL_DATE_RATE_LOW' END, CASE WHEN high_rate < 0.75 THEN 'HIGH_CONFIDENCE_DATE_RATE_LOW' END], lambda x: x IS NOT NULL), ',') AS failures FROM g, h""",
        "discovered_counts": "SELECT finder, count(*) AS n FROM (SELECT unnest(discovered_by) AS finder FROM articles) GROUP BY finder",
        "parse_assessment": f"SELECT source_id, count(*) AS raw, count(*) FILTER (published_at > {observed}) AS future, count(*) FILTER (published_at IS NULL) AS undated, round(count(*) FILTER (published_at IS NOT NULL AND date_confidence = 'high') / count(*), 6) AS high_rate, round(count(*) FILTER (published_at > fetched_at) / count(*), 6) AS conflict_rate FROM articles GROUP BY source_id",
        "detail_quota": rf"""SELECT source_id, article_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY published_at IS NOT NULL, NOT inside, high, -n, article_id) AS INTEGER) AS rank FROM (
            SELECT a.article_id, a.source_id, a.url, a.published_at, s.detail_pages, coalesce(a.published_at >= TIMESTAMPTZ '{SINCE}' AND a.published_at < TIMESTAMPTZ '{UNTIL}', false) AS inside, coalesce(a.date_confidence = 'high', false) AS high, length(coalesce(a.summary, '')) AS n
            FROM articles a JOIN sources s ON s.id = a.source_id) WHERE (published_at IS NULL OR NOT high OR n < 40) AND NOT (published_at IS NOT NULL AND high AND NOT inside))
          WHERE rank <= detail_pages AND NOT regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(?:pdf|docx?|xlsx?|pptx?|zip|csv|xml|json|jpe?g|png|gif|svg|mp[34])$')""",
        "serial_numbers": f"SELECT source_id, article_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY coalesce(published_at, TIMESTAMPTZ '{SINCE}') DESC, article_id) AS INTEGER) AS serial FROM articles",
        "dedupe_entities": """WITH RECURSIVE k AS (SELECT article_id AS ord, regexp_replace(lower(trim(url)), '[?#].*$', '') AS u, CASE WHEN coalesce(title, '') <> '' AND published_at IS NOT NULL THEN lower(title) || '|' || strftime(timezone('UTC', published_at), '%Y-%m-%d') END AS t FROM articles),
          h AS (SELECT *, min(ord) OVER (PARTITION BY u) AS head FROM k), l AS (SELECT *, CASE WHEN t IS NOT NULL THEN lag(head) OVER (PARTITION BY t ORDER BY ord) END AS up FROM h),
          p AS (SELECT ord AS node, coalesce(up, ord) AS parent FROM l WHERE ord = head),
          r AS (SELECT node, parent, parent AS root FROM p UNION ALL SELECT r.node, p.parent, p.parent FROM r JOIN p ON p.node = r.root WHERE p.parent <> r.root)
          SELECT h.ord AS article_id, min(r.root) AS entity FROM h JOIN r ON r.node = h.head GROUP BY h.ord""",
        "first_by_url": "SELECT source_id, url, article_id, title FROM articles QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY article_id) = 1",
        "last_by_url": "SELECT url, article_id, batch_no, first_at FROM (SELECT *, min(article_id) OVER (PARTITION BY url) AS first_at FROM articles) QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id DESC) = 1",
        "health_trailing": f'''SELECT source_id, "at", raw_count, median_count, counts, successes, failures_before, median_request_count FROM ({TRAILING})''',
        "health_states": f"""SELECT source_id, "at", failed_now, CASE WHEN NOT success THEN CASE WHEN critical OR failures_before >= 2 THEN 'degraded' ELSE 'attention' END
            WHEN failed_now AND ((critical AND failures_before >= 1) OR (NOT critical AND failures_before >= 2)) THEN 'degraded' WHEN failed_now THEN 'attention' ELSE 'healthy' END AS health_status
          FROM (SELECT *, source_id IN ('purchase', 'error') AS critical, NOT success OR (counts >= 3 AND median_count >= 4 AND raw_count < 0.25 * median_count) AS failed_now FROM ({TRAILING}))""",
        "health_retained": f'''SELECT source_id, "at", raw_count FROM ({DAYS}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY "at" DESC) <= 12''',
        "health_upsert": f'''SELECT source_id, "at", CASE WHEN "at" >= 20 AND "at" < 28 THEN raw_count * 10 ELSE raw_count END AS raw_count FROM ({DAYS})''',
        "qualifying_streaks": f"""WITH d AS (SELECT source_id, "at", CASE WHEN "at" < 12 THEN 'a' ELSE 'b' END AS f, NOT failed AS ok, row_number() OVER (PARTITION BY source_id ORDER BY "at") AS n FROM ({DAYS})),
          l AS (SELECT *, f <> lag(f) OVER (PARTITION BY source_id ORDER BY "at") AS turned FROM d)
          SELECT source_id, CAST(max(n) AS INTEGER) AS runs, CAST(max(n) - greatest(coalesce(max(CASE WHEN NOT ok THEN n END), 0), coalesce(max(CASE WHEN turned THEN n - 1 END), 0)) AS INTEGER) AS streak,
            arg_max(ok, n) AND max(n) - greatest(coalesce(max(CASE WHEN NOT ok THEN n END), 0), coalesce(max(CASE WHEN turned THEN n - 1 END), 0)) >= 3 AS eligible FROM l GROUP BY source_id""",
        "latest_checks": "SELECT source_id, batch_no, article_id, language FROM articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY batch_no DESC, article_id DESC) = 1",
        "interval_coverage": """WITH i AS (SELECT DISTINCT o_orderpriority, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS s FROM orders), r AS (SELECT *, s + 2 AS e FROM i WHERE s + 2 > 0 AND s < 2000),
          g AS (SELECT *, s > greatest(coalesce(max(e) OVER (PARTITION BY o_orderpriority ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM r),
          c AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gaps FROM g)
          SELECT o_orderpriority, least(coalesce(max(CASE WHEN gaps = 0 THEN e END), 0), 2000) AS covered_to, least(coalesce(max(CASE WHEN gaps = 0 THEN e END), 0), 2000) >= 2000 AS complete FROM c GROUP BY o_orderpriority""",
        "coverage_matrix": """WITH o AS (SELECT institution_type AS topic, country, count(DISTINCT id) AS sources, coalesce(string_agg(DISTINCT CASE WHEN NOT critical THEN name ELSE '' END, '；' ORDER BY CASE WHEN NOT critical THEN name ELSE '' END), '') AS named FROM sources GROUP BY ALL)
          SELECT t.topic, c.country, coalesce(sources, 0) AS sources, CASE WHEN sources IS NULL THEN '未覆蓋' WHEN named = '' THEN '未設定' ELSE named END AS authorities
          FROM (SELECT DISTINCT institution_type AS topic FROM sources) t CROSS JOIN (SELECT DISTINCT country FROM sources) c LEFT JOIN o USING (topic, country)""",
        "unknown_sources": "SELECT DISTINCT source_id FROM (SELECT unnest(discovered_by) AS source_id FROM articles UNION ALL SELECT lower(source) FROM documents UNION ALL SELECT upper(source_id) FROM article_copies) WHERE source_id NOT IN (SELECT id FROM sources)",
        "registered_articles": f"WITH p AS (SELECT id, unnest([homepage, replace(listing_url, 'https://www.', 'http://')] || coalesce(feed_urls, [])) AS url FROM sources) SELECT id, url FROM p WHERE feed_urls_ok AND {KEY.format('url')} IN (SELECT {KEY.format('listing_url')} FROM sources)".replace("feed_urls_ok AND ", ""),
        "host_domains": f"""WITH d AS (SELECT domain, min(pos) AS pos FROM (SELECT unnest(allow_domains) AS domain, generate_subscripts(allow_domains, 1) - 1 AS pos FROM sources) GROUP BY domain), h AS (SELECT article_id, lower({HOST.format("trim(url)")}) AS host FROM articles),
          m AS (SELECT host, arg_min(domain, pos) AS domain FROM (SELECT DISTINCT host FROM h) x JOIN d ON x.host = d.domain OR ends_with(x.host, '.' || d.domain) GROUP BY host) SELECT domain, count(*) AS n FROM h LEFT JOIN m USING (host) GROUP BY domain""",
        "all_event_users": "SELECT DISTINCT user_id FROM events u WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type))",
        "title_lookup": """WITH f AS (SELECT * FROM articles WHERE batch_no = 0 AND title IS NOT NULL), x AS (SELECT language, title, max('own ' || source_id) AS v FROM f WHERE language IS NOT NULL GROUP BY ALL), y AS (SELECT title, max('any ' || source_id) AS v FROM f GROUP BY ALL)
          SELECT article_id, coalesce(x.v, y.v) AS value FROM articles a LEFT JOIN x ON x.language = a.language AND x.title = a.title LEFT JOIN y ON y.title = a.title WHERE batch_no > 0 AND coalesce(x.v, y.v) IS NOT NULL""",
        "source_differences": """WITH a AS (SELECT source_id AS id, max(country) AS country, max(language) AS language, min(institution_type) AS institution_type FROM articles GROUP BY ALL)
          SELECT id, problem FROM (SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN d.id IS NULL THEN 'extra' ELSE array_to_string(list_filter([CASE WHEN d.country IS DISTINCT FROM a.country THEN 'country' END, CASE WHEN d.language IS DISTINCT FROM a.language THEN 'language' END, CASE WHEN d.institution_type IS DISTINCT FROM a.institution_type THEN 'institution_type' END], lambda x: x IS NOT NULL), ',') END AS problem
          FROM sources d FULL JOIN a ON a.id = d.id) WHERE problem <> ''""",
        "recheck_problems": "SELECT DISTINCT source, 'unreported' AS problem FROM mix_targets WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) UNION ALL SELECT DISTINCT source, 'unexpected' FROM documents WHERE source NOT IN (SELECT source FROM mix_targets)",
        "order_statuses": "SELECT o_orderpriority AS country, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS registered, count(*) FILTER (o_orderstatus = 'O') AS unresolved, CAST(0 AS BIGINT) AS excluded, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending FROM orders GROUP BY ALL",
        "coverage_gaps": "SELECT country, array_to_string(list_filter(['central ministry', 'ministry', 'ministry_equivalent', '中央部會', '聯邦監理機關'], lambda x: NOT list_contains(have, x)), '|') AS missing FROM (SELECT country, list(DISTINCT institution_type) AS have FROM sources GROUP BY country)",
        "catalog_problems": """SELECT canonical_id, problems FROM (SELECT id AS canonical_id, array_to_string(list_filter([CASE WHEN country NOT IN ('EU', 'DE', 'FR', 'IE', 'AT', 'BE', 'ES', 'IT', 'NL', 'PL', 'SE', 'FI', 'EE') THEN 'country' END, CASE WHEN starts_with(listing_url, 'https://www.pelarpesk') THEN 'https' END, CASE WHEN institution_type NOT IN ('ministry', 'central ministry', '中央部會', '聯邦監理機關') THEN 'topics' END], lambda x: x IS NOT NULL), '|') AS problems FROM sources) WHERE problems <> ''""",
        "language_detection_quality": "SELECT source, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 1 END AS recall FROM (SELECT source, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM (SELECT source, coalesce(lang, '') = 'en' AS t, coalesce(contains(lower(text), ' the '), false) AS f FROM documents) GROUP BY source)",
        "kept_documents": "SELECT doc_id, size FROM (SELECT doc_id, coalesce(n_chars, 0) AS size, sum(coalesce(n_chars, 0)) OVER (ORDER BY coalesce(published_at, TIMESTAMPTZ '1970-01-01T00:00:00Z') DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 300000",
        "text_totals": "SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY source",
        "inventory_merge": f"""WITH o AS (SELECT {KEY.format("homepage")} AS url_key, homepage AS url, id FROM sources), n AS (SELECT url_key, min(url) AS url FROM (SELECT {KEY.format("url")} AS url_key, url FROM (SELECT unnest([listing_url, replace(homepage, 'https://www.', 'https://')]) AS url FROM sources)) GROUP BY url_key)
          SELECT coalesce(o.url_key, n.url_key) AS url_key, coalesce(n.url, o.url) AS url, CASE WHEN o.url IS NULL THEN '2022-03-01' ELSE '2022-01-01' END AS first_seen_at, CASE WHEN n.url IS NULL THEN '2022-02-01' ELSE '2022-03-01' END AS last_seen_at, n.url IS NOT NULL AS seen_this_run,
            CASE WHEN o.id IS NULL THEN 'directory' WHEN n.url IS NULL THEN o.id ELSE array_to_string(list_sort([o.id, 'directory']), '|') END AS discovered_from FROM o FULL JOIN n USING (url_key)""",
        "customer_sets": "SELECT k, which FROM (SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'idle' END AS which FROM customer)",
        "settings_fingerprints": "SELECT id, sha256(concat_ws(chr(1), id, listing_url, array_to_string(allow_domains, ','), array_to_string(include_patterns, ','), timezone)) AS fingerprint FROM sources",
        "article_lines": "SELECT url, coalesce(title, '') AS title, coalesce(summary, '') AS summary, CASE WHEN published_at IS NOT NULL THEN strftime(timezone('UTC', published_at), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(published_at) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(published_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' END AS published_at, count(*) AS n, CAST(sum(len(coalesce(discovered_by, []))) AS BIGINT) AS finders FROM articles GROUP BY ALL",
        "article_sheets": _sheets(),
        "status_sheet": f"SELECT s.source_id, country, CASE WHEN s.critical THEN '是' ELSE '否' END AS critical, raw, coalesce({ISO.format('newest_micros')}, '') AS newest, parse_status FROM ({STATUS}) s JOIN sources ON id = s.source_id",
        "source_summary": f"""SELECT count(*) AS total, count(*) + 2 AS configured_total, CAST(2 AS BIGINT) AS paused, count(*) AS fetch_ok, CAST(0 AS BIGINT) AS fetch_failed, count(*) FILTER (h = 'healthy') AS healthy, count(*) FILTER (h = 'attention') AS attention, count(*) FILTER (h = 'degraded') AS degraded,
          count(*) FILTER (critical AND h = 'degraded') AS critical_degraded, CAST(0 AS BIGINT) AS with_health_alerts, count(*) FILTER (in_range > 0) AS with_content_hits, CAST(coalesce(sum(raw - dated), 0) AS BIGINT) AS invalid_date_count, CAST(0 AS BIGINT) AS unexplained_future_date_count, CAST(0 AS BIGINT) AS timeout_count,
          CAST(0 AS BIGINT) AS budget_exhausted_count, CAST(0 AS BIGINT) AS request_count, CAST(0 AS BIGINT) AS bytes_downloaded, CAST(0 AS BIGINT) AS retry_count FROM (SELECT *, CASE WHEN parse_status = 'healthy' THEN 'healthy' WHEN critical THEN 'degraded' ELSE 'attention' END AS h FROM ({STATUS}))""",
        "date_summary": """SELECT count(*) FILTER (trim(raw_value) <> '') AS dated_articles, count(*) - count(*) FILTER (trim(raw_value) <> '') AS undated_articles, count(*) FILTER (cand_pos > 0) AS conflict_count, round(count(*) FILTER (cand_pos > 0) / count(*), 4) AS conflict_rate, round(count(*) FILTER (confidence = 'high') / count(*), 4) AS high_confidence_rate,
          (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT coalesce(nullif(date_source, ''), 'unknown') AS k, count(*) AS n FROM date_candidates GROUP BY 1)) AS by_source, (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT coalesce(nullif(confidence, ''), 'unknown') AS k, count(*) AS n FROM date_candidates GROUP BY 1)) AS by_confidence FROM date_candidates""",
        "date_languages": f"SELECT CASE WHEN b = 'no' THEN 'nb' WHEN b IN ({_in(DATE_LANGUAGES)}) THEN b ELSE '' END AS date_language, count(*) AS n FROM (SELECT split_part(coalesce(language, ''), '-', 1) AS b FROM articles) GROUP BY 1",
        "audited_sources": "SELECT id, country FROM sources ORDER BY id LIMIT 10",
        "source_guids": "SELECT doc_id, upper(substr(md5(title), 1, 8) || substr(md5(title), 9, 4)) AS guid FROM documents",
        "row_shades": f"SELECT shade, count(*) AS n FROM (SELECT CASE WHEN len(topics) > 0 AND len(keywords) > 0 THEN CASE WHEN score >= 4 THEN 'C6EFCE' WHEN score >= 2 THEN 'FFEB9C' WHEN score = 1 THEN 'FCE4D6' ELSE '' END ELSE '' END AS shade FROM ({_classified()})) GROUP BY 1",
        "error_codes": "SELECT CASE WHEN event_type = 'purchase' THEN '' WHEN event_type = 'error' THEN 'ROBOTS_DENIED' WHEN value < 10 THEN 'HTTP_CHALLENGE' WHEN value >= 50 THEN 'PARSE_EMPTY' ELSE 'FETCH_FAILED' END AS code, count(*) AS n FROM events GROUP BY 1",
        "source_pages": """SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS INTEGER) AS pos, url FROM (SELECT source_id, url, min(k) AS k FROM (
          SELECT id AS source_id, unnest(u) AS url, generate_subscripts(u, 1) AS k FROM (SELECT id, CASE WHEN critical THEN [homepage || '/2022', homepage || '/2021'] ELSE [listing_url] END || list_transform(range(1, coalesce(max_pages, 1)), lambda n: homepage || '/p' || n) AS u FROM sources)) WHERE url IS NOT NULL AND url <> '' GROUP BY ALL)""",
        "list_order": """SELECT a.source_id, stage, fetched_via, (s * 1048576 + row_number() OVER (PARTITION BY a.source_id ORDER BY stage, fetched_via)) * 1048576 + n - 1 AS place, n FROM (SELECT source_id, batch_no % 2 AS stage, coalesce(fetched_via, '') AS fetched_via, count(*) AS n FROM articles GROUP BY ALL) a
          JOIN (SELECT id, row_number() OVER (ORDER BY lower(id), id) AS s FROM sources) ON id = a.source_id""",
    }
