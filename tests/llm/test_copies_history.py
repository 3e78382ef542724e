import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from presswell.llm import copies, history
from presswell.tables import read_table

ARTICLES = "article_id long, batch_no int, source_id string, title string, url string, url_form string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def make(spark, values):
    return spark.createDataFrame([(i, b, s, t, u, "clash", 1) for i, b, s, t, u in values], ARTICLES)


def test_copies_that_differ_only_in_form(spark):
    a = make(spark, [
        (1, 0, "s", "Straße – Eins", "https://A.example//x/?b=1&a=2&"),
        (2, 0, "t", "STRASSE EINS!", " https://a.example/x?a=2&b=1#"),
        (2, 0, "t", "STRASSE EINS!", " https://a.example/x?a=2&b=1#"),
        (3, 1, "s", "strasse eins", "https://a.example/x/?a=2&b=1"),
        (4, 1, "s", "strasse zwei", "https://a.example/x/?a=2&b=1"),
        (5, 1, "s", "strasse eins", "http://a.example/x/?a=2&b=1"),
        (6, 1, "s", None, "https://a.example/x"),
        (7, 1, "s", "", "https://a.example/x"),
        (8, 1, "s", "…", "https://a.example/x"),
        (9, 1, "s", "x", None),
        (10, 1, "s", "x", None),
    ])
    assert rows(copies.copy_members(a)) == [(1, 2), (1, 3)]
    assert dict(rows(copies.collapsed(a)))[1] == 4


def test_copies_of_an_empty_table(spark):
    assert copies.copy_members(make(spark, [])).count() == 0


def test_copies_against_brute_force(spark, data):
    a = read_table(spark, data, "articles")
    import re

    def key(r):
        t = re.sub(r"[\W_]", "", (r["title"] or "").upper().lower())
        u = r["url"].strip().lower()
        body, _, frag = u.partition("#")
        path, _, query = body.partition("?")
        path = re.sub("(?<!:)/{2,}", "/", path).rstrip("/")
        return (t, path, tuple(sorted(filter(None, query.split("&")))), frag) if t else None

    groups = {}
    for r in a.select("article_id", "title", "url").collect():
        if (k := key(r)) is not None:
            groups.setdefault(k, set()).add(r["article_id"])
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert rows(copies.copy_members(a)) == want


SAME = [
    ("https://www.a.example/news/2022/one-two-three-1001", "HTTP://A.EXAMPLE:80/News//2022/one-two-three-1001/?utm_source=x#top"),
    ("https://www.a.example/index.php?id=7&view=article", "https://m.a.example/INDEX.PHP/?view=article&PHPSESSID=ab12&id=7"),
    ("https://www.a.example/presse/f%C3%BCr-alle-1", "https://www.a.example/presse/für-alle-1?print=1"),
    ("https://www.a.example/a/b/index.html", "https://a.example/a/b;jsessionid=77AA"),
    ("https://www.a.example/news/the-working-group-1002", "https://www.a.example/news/te-workking-group-1002"),
    ("https://www.a.example/news/about-us-all", "https://www.a.example/news/abuot-us-all"),
    ("https://www.a.example/impressum", "https://www.a.example/imprexsum?"),
]
OTHER = [
    ("https://www.a.example/news/one-two-three-1001", "https://www.a.example/news/one-two-three-1002"),
    ("https://www.a.example/news/one-two-1001", "https://www.a.example/news/one-two-1001?page=2"),
    ("https://www.a.example/index.php?id=7&lang=de", "https://www.a.example/index.php?id=7&lang=fr"),
    ("https://www.a.example/de/news/detail?id=7", "https://www.a.example/fr/news/detail?id=7"),
    ("https://www.a.example/news/one-two-1001", "https://www.b.example/news/one-two-1001"),
    ("https://www.a.example/news/one-two-three-1001", "https://www.a.example/news/xne-txo-txree-1001"),
]


def test_pages_that_are_the_same_and_pages_that_are_not(spark):
    values = [(100 * k + i, i, f"s{k}", None, u) for k, pair in enumerate(SAME + OTHER) for i, u in enumerate(pair)]
    found = rows(history.seen_before(make(spark, values)))
    assert found == [(100 * k, 100 * k + 1) for k in range(len(SAME))]


def test_history_takes_the_earliest_batch_and_smallest_id(spark):
    u = "https://a.example/news/page-number-1001"
    a = make(spark, [(9, 1, "s", "t", u), (5, 2, "s", "t", u), (4, 2, "s", "t", u + "/"), (3, 0, "other", "t", u), (7, 1, "s", "t", u), (8, 3, "s", "t", None), (2, 3, None, "t", u), (6, None, "s", "t", u), (5, 2, "s", "t", u)])
    assert rows(history.seen_before(a)) == [(7, 4), (7, 5)]
    assert history.seen_before(make(spark, [])).count() == 0


def test_a_batch_against_the_appended_tables(spark):
    old = make(spark, [(1, 0, "s", "t", "https://a.example/news/first-page-here-1001"), (2, 0, "s", "t", "https://a.example/x-1")])
    new = make(spark, [(3, 1, "s", "t", "https://a.example/news/first-pagee-here-1001"), (4, 1, "s", "t", "https://a.example/y-2"), (5, 1, "s", "t", "https://a.example/x-1")])
    past = history.History(spark, "page_history", 4)
    assert history.accept(past, history.page_rows(old)).count() == 0
    assert rows(history.accept(past, history.page_rows(new))) == [(1, 3), (2, 5)]
    assert past.read("pages").count() == past.read("parts").count() == 4  # only fresh pages are appended
    # the same through the public function, with the history of what came before
    last = make(spark, [(9, 2, "s", "t", "https://a.example/y-2"), (8, 2, "s", "t", "https://a.example/news/irst-pagee-here-1001")])
    assert rows(history.seen_before(last, past)) == [(1, 8), (4, 9)]
    past.drop()
    assert past.read("pages") is None


def test_spellings_that_later_pages_join(spark):
    word = "https://a.example/news/competent-committee-1001"
    one, other = word.replace("compet", "xompex"), word.replace("committee", "kommittex")  # two letters from word, four from each other
    values = [(1, 0, "s", "t", one), (2, 1, "s", "t", other), (3, 2, "s", "t", word), (4, 3, "s", "t", other), (5, 3, "s", "t", other.replace("news", "newz")), (6, 4, "s", "t", word)]
    # in one delivery the chain is whole; batch by batch, article 2 comes before the spelling that links it to 1
    assert rows(history.seen_before(make(spark, values))) == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)]
    past, found = history.History(spark), []
    for batch in range(5):
        found += rows(history.accept(past, history.page_rows(make(spark, [v for v in values if v[1] == batch]))))
    past.drop()
    assert found == [(1, 3), (1, 4), (1, 5), (1, 6)]


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, e in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
    return row[-1]


@pytest.mark.parametrize("few", [1, 4, 1000])
def test_near_pages_lose_no_pair_and_meet_few(spark, few):
    words = ["alpha", "beta", "gamma", "delta"]
    paths = ["/".join(["", *words])] + ["/".join(["", *words[:i], words[i][1:], *words[i + 1 :]]) for i in range(4)] + ["/xlpha/bxta/gamma/delta", "/alpha/beta/gaxma/dexta"]
    paths += [f"/news/{a}{b}rk/{b}{a}st" for a in "aeiou" for b in "bcdfg"] + ["/a", "/b", "/abc", "/abcd"]
    table = spark.createDataFrame([(i, i % 3 > 0, "s", "h", p, "") for i, p in enumerate(paths)], "page long, fresh boolean, source_id string, host string, path string, query string")
    table = table.withColumn("skeleton", F.xxhash64("source_id", "host", "query", history._skeleton(F.col("path"))))
    got = {tuple(sorted(r)) for r in history.near_pages(table, few).collect()}
    signs = [re.sub(r"[a-z]", "", p) for p in paths]
    assert got == {(i, j) for i, j in combinations(range(len(paths)), 2) if signs[i] == signs[j] and (i % 3 or j % 3) and distance(paths[i], paths[j]) <= 2}


def test_a_hot_site_without_numbers_has_no_quadratic_block(spark):
    # pages that share host, first word and signs: without finer keys all pairs of them would be candidates
    table = spark.range(3000).select(F.col("id").alias("page"), F.lit(True).alias("fresh"), F.lit("s").alias("source_id"), F.lit("h").alias("host"), F.lit("").alias("query"), F.concat(F.lit("/news/"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 9), "0123456789", "ghijklmnop"), F.lit("/"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 12, 9), "0123456789", "qrstuvwxyz")).alias("path"))
    keys = history._deleted(F.regexp_replace("path", "[^a-z]", ""))
    table = table.withColumn("skeleton", F.lit(1).cast("long"))
    block = table.select("page", F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert block.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] < 3000
    assert history.near_pages(table).count() == 0
