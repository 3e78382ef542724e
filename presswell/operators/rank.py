"""BM25 over documents and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import normalise, normalised, tokens
from presswell.operators.lexicon import DEFAULT, TOPICS, Lexicon
from presswell.tables import spread, work_table

#: Fixed values.
K1, B, MINIMUM = 1.2, 0.75, 0.15
TITLE_TIMES = 2


def document_tokens(title: Column, summary: Column) -> Column:
    """The words of a document; those of the title count twice."""
    head, body = tokens(normalised(F.coalesce(title, F.lit("")))), tokens(normalised(F.coalesce(summary, F.lit(""))))
    return F.concat(*[head] * TITLE_TIMES, body)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def corpus_size(docs: DataFrame) -> DataFrame:
    """n, average: one row over every document, whatever is filtered later."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def term_frequencies(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """id, length, term, tf of the documents' words, or of the wanted ones only, counted before any shuffle."""
    words = F.col("words") if wanted is None else F.array_intersect("words", F.array(*map(F.lit, wanted)))
    tf = lambda t: F.size(F.filter("words", lambda w: w == t))
    return docs.select("id", "length", "words", F.explode(F.array_distinct(words)).alias("term")).select("id", "length", "term", tf(F.col("term")).alias("tf"))


def bm25(docs: DataFrame, query: DataFrame, terms: list[str]) -> DataFrame:
    """id, topic, score: for each document and topic the sum over the topic's terms, added in term order, rounded to 4.

    docs: id, words, length. query: topic, term, a small table whose terms are `terms`. Words outside the query never leave
    the scan, which runs once; frequencies and sizes are taken over all documents. An empty corpus gives no rows.
    """
    wanted = F.array_union(F.array_intersect("words", F.array(*map(F.lit, terms))), F.array(F.lit("")))
    count = F.size(F.filter("words", lambda w: w == F.col("term")))
    # every document has a row under the empty term, which carries its length
    tf = work_table(docs.select("id", "length", "words", F.explode(wanted).alias("term")).select("id", "length", "term", count.alias("tf")), "tf")
    sizes = tf.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    tf = tf.filter("term != ''")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = tf.join(F.broadcast(df), "term").join(F.broadcast(query), "term").join(F.broadcast(sizes))
    part = idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("average"))
    ordered = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
    return parts.groupBy("id", "topic").agg(ordered.alias("parts")).select("id", "topic", F.round(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"]), 4).alias("score"))


def topic_terms(lexicon: Lexicon = DEFAULT, stop: bool = True) -> dict[str, list[str]]:
    """The words a topic is ranked by: those of its name and of every keyword that leads to it."""
    import re

    from presswell.functions.text import STOP_WORDS

    words = lambda t: [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", normalise(t)) if w not in STOP_WORDS]
    out = {t: {*words(name)} for t, name in TOPICS.items()}
    for r in lexicon.rules:
        for k in r.keywords:
            text = normalise(k)
            own = [s.topic for s in r.signals if any(normalise(x) in text for x in s.words)]
            for t in (*r.topics, *(own or ([r.default] if r.default else []))):
                out.setdefault(t, set()).update(words(k))
    return {t: sorted(v) for t, v in out.items()}


def rank(articles: DataFrame, modules: DataFrame | None = None, lexicon: Lexicon = DEFAULT, minimum: float = MINIMUM) -> DataFrame:
    """Classified articles with topics allowed for their source, boolean_score, bm25 (best topic), bm25_topics and owners.

    modules: source_id, allowed (topic codes), owners (map from topic to owner); a source without a module allows all
    topics and has no owner. Confidence falls to 未命中 below the minimum; the score stays. Corpus sizes come from all rows
    given, so give the rows that the statistics should cover, and filter afterwards.
    """
    spark = articles.sparkSession
    rows = articles
    if modules is not None:
        few = modules.select(F.col("source_id").alias("_module"), "allowed", "owners").dropDuplicates(["_module"])
        rows = rows.join(few, F.col("source_id") == F.col("_module"), "left").drop("_module")
        rows = rows.withColumn("topics", F.when(F.col("allowed").isNull(), F.col("topics")).otherwise(F.array_intersect("topics", "allowed")))
    else:
        rows = rows.withColumn("owners", F.lit(None).cast("map<string,string>"))
    # the rows are needed twice, and what classified them should run once
    rows = work_table(rows.withColumn("boolean_score", F.when(F.size("topics") > 0, F.col("score")).otherwise(0)), "rows")
    docs = spread(rows.select("article_id", "title", "summary")).select(F.col("article_id").alias("id"), document_tokens(F.col("title"), F.col("summary")).alias("words")).withColumn("length", F.size("words"))
    by_topic = topic_terms(lexicon)
    query = spark.createDataFrame([(t, w) for t, ws in by_topic.items() for w in ws], "topic string, term string")
    scores = bm25(docs, query, sorted({w for ws in by_topic.values() for w in ws}))
    wanted = rows.select(F.col("article_id").alias("id"), F.explode("topics").alias("topic")).distinct()
    best = wanted.join(scores, ["id", "topic"], "left").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.coalesce("score", F.lit(0.0)).alias("score"))))).alias("bm25_topics"), F.max(F.coalesce("score", F.lit(0.0))).alias("bm25"))
    out = rows.join(best, F.col("article_id") == F.col("id"), "left").drop("id").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    owned = F.array_distinct(F.array_compact(F.transform("topics", lambda t: F.element_at("owners", t))))
    owned = F.when(F.col("owners").isNull(), F.array().cast("array<string>")).otherwise(owned)
    owners = F.when((F.size("topics") > 0) & (F.size(owned) == 0), F.array(F.lit("未設定"))).otherwise(owned)
    return out.withColumn("responsibility_owner", owners).withColumn("confidence", F.when(F.col("bm25") < minimum, "未命中").otherwise(F.col("confidence"))).drop("allowed", "owners")


def relevant(ranked: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    return ranked.filter((F.col("boolean_score") > 0) & (F.col("bm25") >= minimum))
