"""Batches folded one by one find what one count over all of them finds."""

from collections import Counter

from presswell.llm import lines
from presswell.tables import read_table

ARTICLES = "article_id long, source_id string, title string, summary string"


def found(df):
    return Counter(map(tuple, df.collect()))


def test_titles_of_earlier_batches_count_and_older_articles_are_found(spark):
    old = [(i, "s", f"title {i}", "rare line" if i < 4 else f"own {'x' * i}") for i in range(100)]
    new = [(200, "s", "title new", "RARE line!"), (201, "s", "title new", "own text\nrare line")]
    state, add, take = lines.folded(None, spark.createDataFrame(old, ARTICLES))
    assert not found(add) and not found(take)
    state, add, take = lines.folded(state, spark.createDataFrame(new, ARTICLES))
    assert found(add) == Counter([(i, 1) for i in range(4)] + [(200, 1), (201, 2)]) and not found(take)
    state, add, take = lines.folded(state, spark.createDataFrame([(i, "s", f"t {i}", None) for i in range(300, 330)], ARTICLES))
    assert not found(add) and found(take) == Counter([(i, 1) for i in range(4)] + [(200, 1), (201, 2)])


def test_folding_equals_one_count_after_every_batch(spark, data):
    articles = read_table(spark, data, "articles")
    state, have = None, Counter()
    for upto, batch in (("batch_no = 0", "batch_no = 0"), ("batch_no <= 1", "batch_no = 1"), ("true", "batch_no > 1")):
        state, add, take = lines.folded(state, articles.filter(batch))
        have = have + found(add) - found(take)
        assert have == found(lines.repeated_lines(articles.filter(upto)))
