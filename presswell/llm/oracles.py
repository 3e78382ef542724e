"""SQL of those training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from presswell.llm.history import HOSTS, INDEX, TRACKING, VIEW_CHOICE, VIEW_KEYS, VIEW_VALUES

BLANKS = r"[\s\p{Z}\x{200b}\x{feff}]"
FOLD = "replace(lower({0}), 'ß', 'ss')"
STRIP = f"regexp_replace({{0}}, '^{BLANKS.replace('{', '{{').replace('}', '}}')}+|{BLANKS.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
TITLE = r"regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}]+', '', 'g')"
LETTERS = r"regexp_replace(" + FOLD + r", '[^\p{{L}}]+', '', 'g')"


def _forms() -> str:
    """CTE c: article_id and the parts of url and title that decide whether two articles are copies."""
    u = FOLD.format(STRIP.format("url"))
    return rf"""WITH a AS (SELECT article_id, {TITLE.format("title")} AS t, {u} AS u FROM articles),
      b AS (SELECT article_id, t, regexp_extract(u, '^[^#]*') AS body, regexp_extract(u, '#(.*)$', 1) AS frag FROM a WHERE t <> '' AND u <> ''),
      c AS (SELECT article_id, t, frag, regexp_extract(body, '^([a-z][a-z0-9+.-]*:)?') AS scheme, regexp_replace(regexp_extract(body, '^[^?]*'), '^([a-z][a-z0-9+.-]*:)?//', '') AS rest,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(body, '\?(.*)$', 1), '&'), lambda p: p <> '')), '&') AS q FROM b)"""


PATH = "regexp_replace(regexp_replace(rest, '/{2,}', '/', 'g'), '/+$', '')"


def _copies() -> str:
    return f"""{_forms()}, k AS (SELECT article_id, min(article_id) OVER (PARTITION BY t, scheme, {PATH}, q, frag) AS kept_id FROM c)
      SELECT DISTINCT kept_id, article_id FROM k WHERE article_id > kept_id"""


def _counts() -> str:
    return f"""{_forms()} SELECT min(article_id) AS kept_id, count(*) AS copies FROM c GROUP BY t, scheme, {PATH}, q, frag UNION ALL SELECT article_id, 1 FROM articles WHERE article_id NOT IN (SELECT article_id FROM c)"""


def _pages() -> str:
    """article_id, batch_no, source_id and the parts that decide whether two addresses mean one page."""
    idle = f"^(?:(?:{TRACKING})(?:=.*)?|(?:{VIEW_KEYS})(?:=.*)?|(?:{VIEW_CHOICE})=(?:{VIEW_VALUES}))?$"
    hosts = HOSTS.replace(r"(?=[^.]+\.)", "")
    index = INDEX
    decoded = lambda c: f"CASE WHEN contains({c}, '%') THEN url_decode({c}) ELSE {c} END"
    path = FOLD.format(decoded("p0"))
    for pattern, to in ((";[^/]*", ""), (r"[\s\p{Z}]+", ""), (f"/(?:{VIEW_KEYS})(/|$)", r"\1"), ("/{2,}", "/"), ("[/?&#]+$", ""), (index, ""), ("/+$", "")):
        path = f"regexp_replace({path}, '{pattern}', '{to}', 'g')"
    return rf"""
      u AS (SELECT article_id, batch_no, source_id, regexp_replace(regexp_replace({STRIP.format("url")}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '//') AS u FROM articles WHERE url IS NOT NULL AND source_id IS NOT NULL AND batch_no IS NOT NULL),
      x AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?://)?([^/?]*)', 1)), '^.*@|:(?:80|443)?$', '', 'g'), '{hosts}', '') AS host, regexp_extract(u, '^(?://)?[^/?]*([^?]*)', 1) AS p0, regexp_extract(u, '\?(.*)$', 1) AS q0 FROM u WHERE u <> ''),
      y AS (SELECT article_id, batch_no, source_id, host, {path} AS path,
        array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(q0, '[&?]'), lambda p: {FOLD.format(decoded("p"))}), lambda p: NOT regexp_matches(p, '{idle}')))), '&') AS query FROM x),
      z AS (SELECT *, regexp_replace(path, '\p{{L}}', '', 'g') AS signs, array_to_string(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^[a-z]{{2}}(?:-[a-z]{{2}})?$')), '/') AS tongue FROM y)"""


def _history() -> str:
    return f"""WITH RECURSIVE {_pages()},
      k AS (SELECT source_id, host, path, query, signs, tongue, min({{'b': batch_no, 'i': article_id}}) AS first FROM z GROUP BY ALL),
      e AS (SELECT a.first AS u, b.first AS v FROM k a JOIN k b ON a.source_id = b.source_id AND a.host = b.host AND a.query = b.query AND a.signs = b.signs AND a.tongue = b.tongue
        WHERE a.path <> b.path AND abs(length(a.path) - length(b.path)) <= 2 AND levenshtein(a.path, b.path) <= 2),
      r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
      n AS (SELECT k.source_id, host, path, query, least(k.first, coalesce(m.v, k.first)) AS first FROM k LEFT JOIN (SELECT u, min(v) AS v FROM r GROUP BY u) m ON m.u = k.first)
      SELECT DISTINCT n.first.i AS accepted_id, article_id FROM z JOIN n USING (source_id, host, path, query) WHERE z.batch_no > n.first.b"""


LINES = f"""WITH l AS (SELECT article_id, source_id, {TITLE.format("coalesce(title, '')")} AS t, unnest(string_split(summary, chr(10))) AS line, generate_subscripts(string_split(summary, chr(10)), 1) AS line_no, row_number() OVER () AS r FROM articles),
  k AS (SELECT article_id, source_id, t, r, line_no, {LETTERS.format("line")} AS k FROM l), n AS (SELECT source_id, count(*) AS n FROM articles GROUP BY source_id),
  f AS (SELECT source_id, k FROM (SELECT source_id, k, count(DISTINCT rid) AS m, count(DISTINCT t) AS titles FROM (SELECT source_id, k, t, dense_rank() OVER (ORDER BY article_id) AS rid FROM k WHERE k <> '') GROUP BY source_id, k) JOIN n USING (source_id) WHERE m >= 0.05 * n - 1e-9 AND titles >= 5)
  SELECT article_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (source_id, k)"""


def _best() -> str:
    text = f"trim(regexp_replace(summary, '{BLANKS}+', ' ', 'g'))"
    part = "regexp_extract(u, '{0}', 1)"
    scheme, host, path, query = (part.format(p) for p in ("^([^:/?#]+):", "^[^:/?#]+://([^/?#]*)", "^[^:/?#]+://[^/?#]*([^?#]*)", r"^[^?#]*\?([^#]*)"))
    keep = f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(?:=|$)'))"
    canonical = f"lower({scheme}) || '://' || lower({host}) || coalesce(nullif(regexp_replace(regexp_replace({path}, '/{{2,}}', '/', 'g'), '/+$', ''), ''), '/') || CASE WHEN len({keep}) > 0 THEN '?' || array_to_string({keep}, '&') ELSE '' END"
    tie = "fetched_at DESC NULLS LAST, copy_id"
    return rf"""WITH c AS (SELECT *, {text} AS s FROM article_copies),
      w AS (SELECT group_id, copy_id FROM c WHERE coalesce(s, '') <> '' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY NOT regexp_matches(s, '(…|\.\.\.)\s*[)\]}}>»]?$') DESC, length(s) DESC, {tie}) = 1),
      d AS (SELECT group_id, copy_id FROM c WHERE published_at >= TIMESTAMPTZ '2000-01-01T00:00:00Z' AND coalesce(epoch_us(published_at) - epoch_us(fetched_at) <= 86400000000, true)
        QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY CASE lower({STRIP.format("coalesce(date_confidence, '')")}) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, {tie}) = 1),
      r AS (SELECT group_id, copy_id AS own, url AS v FROM c UNION ALL SELECT group_id, NULL, unnest(alternate_urls) FROM c),
      e AS (SELECT group_id, own, {canonical} AS v FROM (SELECT group_id, own, {STRIP.format("v")} AS u FROM r) WHERE u <> ''),
      m AS (SELECT group_id, arg_min(v, own) FILTER (own IS NOT NULL) AS survivor FROM e GROUP BY group_id),
      b AS (SELECT group_id, lower({STRIP.format("v")}) AS v FROM (SELECT group_id, source_id AS v FROM c UNION ALL SELECT group_id, unnest(discovered_by) FROM c))
      SELECT group_id, 'summary' AS field_name, CAST(copy_id AS VARCHAR) AS chosen FROM w UNION ALL SELECT group_id, 'published_at', CAST(copy_id AS VARCHAR) FROM d
      UNION ALL SELECT DISTINCT group_id, 'discovered_by', v FROM b WHERE v <> '' UNION ALL SELECT DISTINCT group_id, 'alternate_urls', v FROM e JOIN m USING (group_id) WHERE survivor IS NULL OR v <> survivor"""


SPANS = """WITH w AS (SELECT DISTINCT doc_id, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
  s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), v AS (SELECT w.* FROM w JOIN s USING (h))
  SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id"""


#: Documents with their class of equal texts, its size, and the number of other texts that share a stretch.
CLASSES = f"""WITH p AS ({SPANS}), k AS (SELECT DISTINCT doc_id, text, min(doc_id) OVER (PARTITION BY CASE WHEN length(text) >= 200 THEN text ELSE CAST(doc_id AS VARCHAR) END, length(text) >= 200) AS class_id FROM documents),
  l AS (SELECT class_id, count(DISTINCT other) AS links FROM (SELECT a.class_id, b.class_id AS other FROM p JOIN k a ON a.doc_id = doc_a JOIN k b ON b.doc_id = doc_b UNION ALL SELECT b.class_id, a.class_id FROM p JOIN k a ON a.doc_id = doc_a JOIN k b ON b.doc_id = doc_b) WHERE class_id <> other GROUP BY class_id)
  SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS members, coalesce(links, 0) AS links FROM k LEFT JOIN l USING (class_id)"""


def llm_oracles() -> dict[str, str]:
    return {"p2_found": _history(), "p4_found": _copies(), "p4_counts": _counts(), "p10_classes": CLASSES, "p6_found": LINES, "p7_found": _best(), "p10_found": SPANS}
