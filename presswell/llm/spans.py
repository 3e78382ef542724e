"""Problem 10: stretches of at least a given length that several documents share verbatim."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.llm import recompress as rc
from presswell.tables import spread, work_table

LENGTH = 4 * rc.HALF
#: Keys that more occurrences share are refined to keys of the whole length before any pair is formed.
HOT = 200
#: Two anchors of one diagonal that are at most so far apart have touching keys, so what lies between is equal too.
STEP = 2 * rc.HALF
#: Characters beyond an anchor's key that the exact check reads on either side: enough to decide on LENGTH, or to find
#: where a stretch ends (between two anchors of one text lie fewer).
DECIDE = LENGTH - 2 * rc.HALF
REACH = 4 * LENGTH


def _text_hash(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g"), F.length(c).alias("n"))


def text_classes(documents: DataFrame) -> DataFrame:
    """rep, doc_id: members of the classes of equal texts that have more than one member, by 128 bits of hash and length."""
    hashed = documents.filter(F.length("text") >= LENGTH).select(_text_hash(F.col("text")).alias("t"), "doc_id")
    twice = hashed.groupBy("t").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n")).filter("n > 1").select("t", "rep")
    return hashed.join(twice, "t").select("rep", "doc_id").distinct()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for a, b in rc.slices(texts):
            which, place, key = rc.anchors(texts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[a:b][which]), pa.array(place.astype(np.int32))], ["key", "doc", "pos"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for every window of LENGTH characters around a hot anchor."""
    for batch in batches:
        key, doc, pos = [], [], []
        for d, places, text in zip(batch.column("doc").to_pylist(), batch.column("places").to_pylist(), batch.column("text").to_pylist(), strict=True):
            s = rc.prefix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
            p = np.asarray(places)[:, None] + np.arange(rc.HALF - LENGTH, 1 - rc.HALF)[None, :]
            starts = np.unique(p[(p >= 0) & (p + LENGTH <= len(text))])
            if len(starts):
                key.append(rc.stretch_hash(s, starts, starts + LENGTH).view(np.int64))
                doc.append(np.full(len(starts), d))
                pos.append(starts + LENGTH // 2)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32))], ["key", "doc", "pos"])


def _meetings(rows: DataFrame) -> DataFrame:
    """a, b, diagonal and place in a of every two occurrences of a key in different documents."""
    x, y = rows.select("key", F.col("doc").alias("a"), F.col("pos").alias("pa")), rows.select("key", F.col("doc").alias("b"), F.col("pos").alias("pb"))
    return x.join(y, "key").filter("a < b").select("a", "b", (F.col("pa") - F.col("pb")).alias("diagonal"), "pa")


def _edge_rows(reach: int):
    """The `reach` characters before and after each stretch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for d, ranges, text in zip(batch.column("doc").to_pylist(), batch.column("ranges").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for r in ranges:
                    f, t = r["f"], r["t"]
                    for c, v in zip(columns, (d, f, t, text[max(0, f - reach) : f], text[t : t + reach]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc", "f", "t", "before", "after"])

    return cut


def _common(x: list[str], y: list[str], backwards: bool) -> np.ndarray:
    """How many characters each two texts have in common from their start, or from their end."""
    out = np.empty(len(x), np.int32)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if backwards:
            a, b = a[::-1], b[::-1]
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:  # the longest equal beginning, by halving
            mid = (lo + hi + 1) // 2
            if a[:mid] == b[:mid]:
                lo = mid
            else:
                hi = mid - 1
        out[i] = lo
    return out


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        c = {n: t.column(n) for n in t.schema.names}
        left = _common(c["a_before"].to_pylist(), c["b_before"].to_pylist(), True)
        right = _common(c["a_after"].to_pylist(), c["b_after"].to_pylist(), False)
        f, e, g = (c[n].to_numpy() for n in ("f", "t", "diagonal"))
        yield pa.RecordBatch.from_arrays([c["a"], c["b"], pa.array(f - left), pa.array(f - g - left), pa.array(e - f + left + right)], ["a", "b", "a_start", "b_start", "length"])


@dataclass(frozen=True)
class Shared:
    """What two different texts share: verified stretches (a, b, a_start, b_start, length), and, where very many places
    share a key, the windows (key, doc, pos of the middle) of LENGTH characters that hold it."""

    stretches: DataFrame
    windows: DataFrame | None


def shared_stretches(documents: DataFrame, hot: int = HOT, reach: int = REACH) -> Shared:
    """Stretches of LENGTH characters or more that two different texts share, a < b.

    Texts are named by recompression, round by round, in one narrow pass; anchors carry the hash of the 100 characters
    around them. Only keys that occur in several places go on. Keys that very many places share are replaced by keys of
    every whole window around them, so that a group holds true pairs only; nothing is capped. Anchors of one diagonal whose
    keys touch form a chain, and up to `reach` characters beyond its ends are compared exactly. Of equal texts, the one of
    lowest id stands for all (text_classes). Null, empty and short texts share nothing; a repeated doc_id with the same text
    is one document. Places count characters from 0.
    """
    texts = documents.filter((F.length("text") >= LENGTH) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    classes = work_table(text_classes(texts), "classes")
    single = texts.join(classes.filter("rep != doc_id").select("doc_id"), "doc_id", "left_anti")
    rows = work_table(spread(single).mapInArrow(_anchor_rows, "key long, doc long, pos int"), "anchors")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = work_table(rows.join(counts, "key"), "met")
    usual = _meetings(met.filter(F.col("n") <= hot).select("key", "doc", "pos"))
    windows = None
    if not met.filter(F.col("n") > hot).isEmpty():
        places = met.filter(F.col("n") > hot).groupBy("doc").agg(F.collect_set("pos").alias("places"))
        whole = places.join(single, F.col("doc") == F.col("doc_id")).select("doc", "places", "text").mapInArrow(_window_rows, "key long, doc long, pos int")
        windows = work_table(whole.distinct(), "windows")
        several = windows.groupBy("key").agg(F.min("doc").alias("d"), F.max("doc").alias("e")).filter("d < e").select("key")
        windows = windows.join(several, "key", "left_semi")
    return Shared(_verified(usual.distinct(), single, reach), windows)


def _verified(meetings: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    line = "partition by a, b, diagonal order by pa"
    broken = meetings.withColumn("new", F.expr(f"case when pa - lag(pa) over ({line}) <= {STEP} then 0 else 1 end"))
    chained = broken.withColumn("chain", F.expr(f"sum(new) over ({line})")).groupBy("a", "b", "diagonal", "chain")
    chains = work_table(chained.agg((F.min("pa") - rc.HALF).alias("f"), (F.max("pa") + rc.HALF).alias("t")).drop("chain"), "chains")
    ends = chains.select(F.inline(F.array(F.struct(F.col("a").alias("doc"), "f", "t"), F.struct(F.col("b").alias("doc"), (F.col("f") - F.col("diagonal")).alias("f"), (F.col("t") - F.col("diagonal")).alias("t")))))
    ranges = ends.distinct().groupBy("doc").agg(F.collect_list(F.struct("f", "t")).alias("ranges"))
    edges = work_table(ranges.join(texts, F.col("doc") == F.col("doc_id")).select("doc", "ranges", "text").mapInArrow(_edge_rows(reach), "doc long, f int, t int, before string, after string"), "edges")
    a = edges.select(*[F.col(c).alias(f"a_{c}") for c in edges.columns])
    b = edges.select(*[F.col(c).alias(f"b_{c}") for c in edges.columns])
    both = chains.join(a, (F.col("a") == F.col("a_doc")) & (F.col("f") == F.col("a_f")) & (F.col("t") == F.col("a_t"))).join(b, (F.col("b") == F.col("b_doc")) & (F.col("f") - F.col("diagonal") == F.col("b_f")) & (F.col("t") - F.col("diagonal") == F.col("b_t")))
    grown = both.select("a", "b", "f", "t", "diagonal", "a_before", "b_before", "a_after", "b_after").mapInArrow(_grown, "a long, b long, a_start int, b_start int, length int")
    return grown.filter(F.col("length") >= LENGTH).distinct()


def _linked(documents: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts (rep, doc_id), and the pairs (a, b) of different texts, by representative, that share a stretch."""
    docs = documents.filter(F.col("doc_id").isNotNull())
    classes = work_table(text_classes(docs), "classes")
    shared = shared_stretches(docs, hot, DECIDE)
    pairs = shared.stretches.select("a", "b")
    if shared.windows is not None:
        once = shared.windows.select("key", "doc").distinct()
        pairs = pairs.unionByName(once.alias("x").join(once.alias("y"), "key").filter("x.doc < y.doc").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")))
    return classes, pairs.distinct()


def shared_pairs(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_a, doc_b of all documents that share a stretch, equal texts included; doc_a < doc_b.

    The pairs of a class of equal texts, and of two such classes, are written out because that is the result's form;
    shared_classes gives the same without expanding copies.
    """
    classes, pairs = _linked(documents, hot)
    # a class of one member is its own representative
    of = lambda side: classes.select(F.col("rep").alias(side), F.col("doc_id").alias(f"{side}_member"))
    wide = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_member", "a").alias("x"), F.coalesce("b_member", "b").alias("y"))
    equal = classes.alias("x").join(classes.alias("y"), "rep").filter("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"))
    return wide.filter("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(equal).distinct()


def shared_classes(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, class_id, members, links: of every document the lowest doc_id with its text, how many have that text, and how
    many other texts share a stretch with it. Copies are not expanded into pairs. A null doc_id has no row.
    """
    classes, pairs = _linked(documents, hot)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = classes.groupBy(F.col("rep").alias("class_id")).agg(F.count(F.lit(1)).alias("members"))
    own = documents.filter("doc_id is not null").select("doc_id").distinct().join(classes, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))
    return own.join(sizes, "class_id", "left").join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_coverage(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_chars, shared_chars, share: how much of each document stands in other documents too.

    Every document has a row; an empty or null text has share 0. Overlapping stretches count once.
    """
    docs = documents.filter(F.col("doc_id").isNotNull())
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    classes = work_table(text_classes(docs), "classes")
    shared = shared_stretches(docs, hot)
    spans = shared.stretches.select(F.inline(F.array(F.struct(F.col("a").alias("doc"), F.col("a_start").alias("s"), F.col("length").alias("n")), F.struct(F.col("b").alias("doc"), F.col("b_start").alias("s"), F.col("length").alias("n")))))
    if shared.windows is not None:
        spans = spans.unionByName(shared.windows.select("doc", (F.col("pos") - LENGTH // 2).alias("s"), F.lit(LENGTH).alias("n")))
    spans = spans.distinct().withColumn("e", F.col("s") + F.col("n"))
    reached = spans.withColumn("to", F.expr("max(e) over (partition by doc order by s, e rows between unbounded preceding and 1 preceding)"))
    covered = reached.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("to", F.lit(0))))).alias("c"))
    copied = covered.join(classes.filter("rep != doc_id").withColumnRenamed("rep", "doc"), "doc").select(F.col("doc_id").alias("doc"), "c").unionByName(covered)
    whole = classes.select(F.col("doc_id").alias("doc"), F.lit(True).alias("whole"))
    out = sizes.join(copied, F.col("doc_id") == F.col("doc"), "left").drop("doc").join(whole, F.col("doc_id") == F.col("doc"), "left")
    shared = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce(F.col("c"), F.lit(0))).cast("long")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
