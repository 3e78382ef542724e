from datetime import datetime, timedelta, timezone

from presswell.llm import best, lines
from presswell.tables import read_table

T0 = datetime(2022, 3, 1, tzinfo=timezone.utc)


def rows(df):
    return sorted(map(tuple, df.collect()))


def articles(spark, values):
    return spark.createDataFrame([(*v, "x", 1) for v in values], "article_id long, source_id string, title string, summary string, line_key string, n long")


def test_lines_over_the_share_and_under_enough_titles(spark):
    many = [(i, "s", f"title {i}", f"own text {'abcdefghij'[i % 10] * (i + 1)}\nShare this page {i}\n\n1234") for i in range(10)]
    few = [(i, "t", "one title", "Share this page\nother") for i in range(20, 30)]
    assert rows(lines.repeated_lines(articles(spark, many + few))) == [(i, 2) for i in range(10)]


def test_a_missing_title_is_one_title_and_repeated_rows_count(spark):
    values = [(i, "s", f"t{i}" if i < 4 else None, "Alle Rechte!") for i in range(8)] + [(7, "s", None, "ALLE RECHTE")] + [(99, "s", "z", None), (98, None, "z", "Alle Rechte")]
    assert rows(lines.repeated_lines(articles(spark, values))) == sorted([(i, 1) for i in range(8)] + [(7, 1)])


def test_no_articles_no_lines(spark):
    assert lines.repeated_lines(articles(spark, [])).count() == 0


def test_counts_merge_and_crossings(spark):
    a = articles(spark, [(i, "s", f"t{i}", "same line" if i == 0 else f"line {'x' * i}") for i in range(30)])
    b = articles(spark, [(i, "s", f"t{i}", "same line") for i in range(30, 36)])
    before, both = lines.line_delta(a), lines.line_delta(a.unionByName(b))
    merged = lines.merge_counts(before, lines.line_delta(b))
    assert rows(merged.na.fill(0)) == rows(both.na.fill(0))
    up, down = lines.crossed(before, merged)
    assert up.count() == 1 and down.count() == 0
    found = lines.folded(lines.folded(None, a)[0], b)[1]
    assert [r["summary"] for r in lines.without_lines(b, found).collect()] == [""] * 6


def test_lines_against_brute_force(spark, data):
    import re

    a = read_table(spark, data, "articles")
    key = lambda x: "".join(re.findall(r"[^\W\d_]", x.upper().lower()))
    title = lambda x: re.sub(r"[\W_]", "", (x or "").upper().lower())
    per, titles, total = {}, {}, {}
    data_rows = a.select("article_id", "source_id", "title", "summary").collect()
    for r in data_rows:
        total[r["source_id"]] = total.get(r["source_id"], 0) + 1
        for k in {key(x) for x in (r["summary"] or "").split("\n")} - {""}:
            per[r["source_id"], k] = per.get((r["source_id"], k), 0) + 1
            titles.setdefault((r["source_id"], k), set()).add(title(r["title"]))
    hit = {k for k, n in per.items() if n * 20 >= total[k[0]] and len(titles[k]) >= 5}
    want = sorted((r["article_id"], n) for r in data_rows for n, x in enumerate((r["summary"] or "").split("\n"), 1) if (r["source_id"], key(x)) in hit)
    assert rows(lines.repeated_lines(a)) == want


COPY = "copy_id long, group_id long, source_id string, title string, url string, summary string, published_at timestamp, date_confidence string, fetched_at timestamp, alternate_urls array<string>, discovered_by array<string>, own string"


def copies(spark, values):
    return spark.createDataFrame([(*v, "clash") for v in values], COPY)


def test_best_fields_of_a_group(spark):
    day = T0 - timedelta(days=3)
    c = copies(spark, [
        (1, 7, " SRC_A ", "t", "  ", "short text", day, "medium", T0, None, ["B", " b ", None, ""]),
        (2, 7, "src_a", "t", "HTTPS://X.example//a/?utm_x=1", "a  much   longer text […]", day, " HIGH ", T0, ["https://x.example/b#f", "https://x.example/a"], None),
        (3, 7, "src_a", "t", "https://x.example/b/", "the longest whole text", datetime(1999, 1, 1, tzinfo=timezone.utc), "high", T0 + timedelta(days=1), [], []),
        (4, 7, "src_a", "t", None, "the  longest whole text", T0 + timedelta(days=9), "high", T0, [None], []),
        (5, 8, None, "t", None, " \n", None, None, None, None, None),
        (6, 9, "s", "t", "https://x.example/z", "cut one...", day, "odd", T0, None, None),
        (7, 9, "s", "t", "https://x.example/z?a=1", "cut one…", day, None, T0, None, None),
        (7, 9, "s", "t", "https://x.example/z?a=1", "cut one…", day, None, T0, None, None),
        (8, None, "s", "t", None, "x", None, None, T0, ["https://x.example/only"], None),
    ])
    assert rows(best.best_records(c).na.fill(-1)) == sorted([
        (7, "summary", "3"), (7, "published_at", "2"), (7, "discovered_by", "src_a"), (7, "discovered_by", "b"), (7, "alternate_urls", "https://x.example/b"),
        (9, "summary", "6"), (9, "published_at", "6"), (9, "discovered_by", "s"), (9, "alternate_urls", "https://x.example/z?a=1"),
        (-1, "summary", "8"), (-1, "discovered_by", "s"), (-1, "alternate_urls", "https://x.example/only"),
    ])


def test_best_of_nothing(spark):
    assert best.best_records(copies(spark, [])).count() == 0
