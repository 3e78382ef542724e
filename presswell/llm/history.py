"""Problem 2: new batches against everything accepted before, page by page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.functions.text import casefold, strip
from presswell.tables import shared_dir, spread, work_table

#: Parameters that only track a visitor or a session.
TRACKING = "utm_[^=]*|(?:mc|pk|piwik|mtm|wt|hsa|ga|vero|oly)_[^=]*|_?hs(?:enc|mi|ctatracking)|fbclid|gclid|gclsrc|dclid|msclkid|yclid|twclid|igshid|_ga|_gl|ref|referrer|referer|source|src|s?cid|sid|sessionid|session_id|phpsessid|jsessionid|aspsessionid[^=]*|cfid|cftoken|trk|xtor|at_[^=]*|ns_[^=]*"
#: Parameters and path parts that only choose a print or mobile view.
VIEW_KEYS = "print|printable|print_view|printview|drucken|imprimer|mobile|mobil|amp"
VIEW_VALUES = "print|printable|printview|printer|mobile|mobil|amp"
VIEW_CHOICE = "view|format|output|layout|mode|display|version|style|tmpl|device|outputtype"
HOSTS = "^(?:(?:www\\d?|m|mobile|mobil|amp|wap)\\.)+(?=[^.]+\\.)"
INDEX = "/(?:index|default)\\.(?:html?|php\\d?|aspx?|jsp|cfm|shtml)$"
#: Letters that may differ within a path.
MAX_LETTERS = 2
#: A block of at most so many pages is compared pair by pair; a larger one is split by finer keys.
FEW = 32
ROOT = "batch_no: int, article_id: bigint, page: bigint"


def _decoded(c: Column) -> Column:
    """Without percent-encoding; a broken escape leaves the text as it is."""
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def page_parts(url: Column) -> Column:
    """struct(host, path, query) of the page behind url, or null for a null or blank url."""
    u = strip(url)
    u = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", "")
    authority = F.lower(F.regexp_extract(u, "^(?://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@|:(?:80|443)?$", ""), HOSTS, "")
    path = casefold(_decoded(F.regexp_extract(u, "^(?://)?[^/?]*([^?]*)", 1)))
    path = F.regexp_replace(path, ";[^/]*", "")
    path = F.regexp_replace(path, "[\\s\\p{Z}]+", "")
    path = F.regexp_replace(path, f"/(?:{VIEW_KEYS})(?=/|$)", "")
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "[/?&#]+$", "")
    path = F.regexp_replace(F.regexp_replace(path, INDEX, ""), "/+$", "")
    params = F.transform(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "[&?]|;(?=[A-Za-z])"), lambda p: casefold(_decoded(strip(p))))
    idle = f"^(?:(?:{TRACKING})(?:=.*)?|(?:{VIEW_KEYS})(?:=.*)?|(?:{VIEW_CHOICE})=(?:{VIEW_VALUES}))?$"
    query = F.array_join(F.array_sort(F.array_distinct(F.filter(params, lambda p: ~p.rlike(idle)))), "&")
    return F.when(u != "", F.struct(host.alias("host"), path.alias("path"), query.alias("query")))


def _skeleton(path: Column) -> Column:
    """What the paths of one page never differ in, beside source, host and query: the signs that are no letters, and two-letter (language) parts."""
    tongue = F.array_join(F.regexp_extract_all(path, F.lit("(?<=/)([a-z]{2}(?:-[a-z]{2})?)(?=/|$)"), F.lit(1)), "/")
    return F.struct(F.regexp_replace(path, "\\p{L}", "").alias("signs"), tongue.alias("tongue"))


def page_rows(articles: DataFrame) -> DataFrame:
    """article_id, batch_no, page, skeleton and source_id, host, path, query, for rows with url, source and batch.

    page is a 64-bit hash of source and canonical address; skeleton one of the part of it that a changed letter leaves alone.
    """
    rows = articles.filter("url is not null and source_id is not null and batch_no is not null").select("article_id", "batch_no", "source_id", page_parts(F.col("url")).alias("p")).filter("p is not null")
    rows = rows.select("article_id", F.col("batch_no").cast("int").alias("batch_no"), "source_id", F.inline(F.array("p")))
    return rows.withColumns({"page": F.xxhash64("source_id", "host", "path", "query"), "skeleton": F.xxhash64("source_id", "host", "query", _skeleton(F.col("path")))})


class History:
    """What has been accepted so far, in three tables bucketed in the shared folder that every batch is appended to.

    pages: page, root, by page. parts: skeleton, page, root and the parts of the address, by skeleton. merged: skeleton, page
    and root of those roots that a later page has joined to an earlier one. A root is the first delivery (batch_no,
    article_id, page) of a page under any spelling.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"presswell_history_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(self, table: str) -> DataFrame | None:
        full = f"{self.name}_{table}"
        return self.spark.table(full) if self.spark.catalog.tableExists(full) else None

    def append(self, table: str, rows: DataFrame, key: str) -> None:
        """One file per bucket and batch; later joins on the key read their buckets where they lie."""
        full = f"{self.name}_{table}"
        path = f"{shared_dir(self.spark)}/presswell-work/{full}"
        rows.repartition(self.buckets, key).write.mode("append").bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(full)

    def drop(self) -> None:
        """Forget the tables; their files stay until drop_work_tables."""
        for table in ("pages", "parts", "merged"):
            self.spark.sql(f"drop table if exists {self.name}_{table}")


def _thirds(path: Column) -> Column:
    """The words at places 0, 3, 6 …, 1, 4, 7 … and 2, 5, 8 … of a path: two changed letters leave one of them untouched."""
    words = F.transform(F.split(path, "[^\\p{L}]"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    third = lambda k: F.array_join(F.transform(F.filter(words, lambda s: s["i"] % 3 == k), lambda s: s["w"]), " ")
    return F.array(*[F.concat(F.lit(f"{k}:"), third(k)) for k in range(3)])


def _deleted(letters: Column) -> Column:
    """What is left of the letters after taking out up to MAX_LETTERS of them: two texts within that distance share one such rest."""
    without = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: without(s, i))).otherwise(F.array().cast("array<string>"))
    found = layer = F.array(letters)
    for _ in range(MAX_LETTERS):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        found = F.concat(found, layer)
    return F.array_distinct(found)


def near_pages(rows: DataFrame, few: int = FEW) -> DataFrame:
    """a, b: pairs of pages within MAX_LETTERS letters in the path and equal in all else, at least one of them fresh.

    rows: page, fresh, skeleton, source_id, host, path, query, a page once. Pages of one skeleton are compared where there
    are few. A larger skeleton is split by thirds of the words, and what is still large by all rests after deleting letters,
    in which only pages within twice the distance meet; so a hot site whose addresses have no numbers costs a bounded number
    of keys a page and no quadratic block. Candidates are 16-byte rows; the exact check then fetches both addresses.
    """
    letters = F.regexp_replace("path", "[^\\p{L}]", "")
    lettered = rows.filter(F.col("path").rlike("\\p{L}"))
    keyed = lettered.select("page", "fresh", "path", F.col("skeleton").alias("key"))
    pairs = None
    for finer in (lambda: F.explode(_thirds(F.col("path"))), lambda: F.explode(_deleted(letters)), None):
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).filter("n > 1 and any").select("key", "n")
        met = work_table(keyed.join(sizes, "key"), "met")
        small = met.filter(F.col("n") <= few) if finer else met
        b = small.select("key", F.col("page").alias("b"), "fresh")
        a = small.filter("fresh").select("key", F.col("page").alias("a"))
        found = a.join(b, "key").filter("a != b and (a < b or not fresh)").select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if finer is None or met.filter(F.col("n") > few).isEmpty():
            break
        keyed = met.filter(F.col("n") > few).withColumn("finer", finer()).select("page", "fresh", "path", F.xxhash64("key", "finer").alias("key")).distinct()
    side = lambda x: lettered.select(F.col("page").alias(x), F.struct("source_id", "host", "query", _skeleton(F.col("path")).alias("rest")).alias(f"{x}_is"), F.col("path").alias(f"{x}_path"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return near.filter(F.col("a_is") == F.col("b_is")).filter(F.levenshtein("a_path", "b_path", MAX_LETTERS) >= 0).select("a", "b")


def _joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """page, root: each node with the smallest root of its component. nodes: page, root; edges: a, b.

    Every round takes the smallest root beside a node and then that root's own; it ends when nothing changes.
    """
    both = work_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = nodes
    while True:
        beside = both.join(label.select(F.col("page").alias("b"), "root"), "b").select(F.col("a").alias("page"), "root")
        least = label.select("page", "root").unionByName(beside).groupBy("page").agg(F.min("root").alias("root"))
        jump = least.select(F.col("page").alias("at"), F.col("root").alias("up"))
        jumped = least.join(jump, F.col("root.page") == F.col("at"), "left").select("page", F.least("root", F.coalesce("up", "root")).alias("root"))
        after = work_table(jumped, "roots")
        if after.join(label.withColumnRenamed("root", "before"), "page").filter("root != before").isEmpty():
            return after
        label = after


def accept(history: History, batch: DataFrame) -> DataFrame:
    """accepted_id, article_id of the delivery's articles whose page an earlier batch had; the delivery is then part of the history.

    batch: page_rows of one batch, or of several that arrive together. Pages seen before are found by a join within the buckets of `pages`. For the rest, only
    skeletons of the batch are read from `parts`, within its buckets; pages near to each other get one root, whichever came
    first, and roots that a new page brings together are noted in `merged`. Only fresh pages are appended.
    """
    first = F.min(F.struct("batch_no", "article_id"))
    new = batch.groupBy("page").agg(F.struct(first["batch_no"].alias("batch_no"), first["article_id"].alias("article_id"), F.col("page")).alias("first"), *[F.first(c).alias(c) for c in ("skeleton", "source_id", "host", "path", "query")])
    pages, parts, merged = (history.read(t) for t in ("pages", "parts", "merged"))
    none = F.lit(None).cast(f"struct<{ROOT}>")
    new = work_table(new.withColumn("known", none) if pages is None else new.join(pages.withColumnRenamed("root", "known"), "page", "left"), "batch")
    fresh = new.filter("known is null")
    address = ["page", "skeleton", "source_id", "host", "path", "query"]
    rows = fresh.select(*address, F.lit(True).alias("fresh"), F.col("first").alias("root"))
    if parts is not None:
        rows = rows.unionByName(parts.join(fresh.select("skeleton").distinct(), "skeleton", "left_semi").select(*address, F.lit(False).alias("fresh"), "root"))
    rows = work_table(rows, "beside")
    near = near_pages(rows).join(rows.select(F.col("page").alias("b"), "skeleton", "fresh", F.col("root").alias("b_root")), "b")
    if merged is not None:
        later = merged.select("skeleton", F.col("page").alias("was"), F.col("root").alias("now"))
        near = near.join(later, (near["skeleton"] == later["skeleton"]) & (F.col("b_root.page") == F.col("was")), "left").select("a", "b", near["skeleton"], "fresh", F.least("b_root", F.coalesce("now", "b_root")).alias("b_root"))
    # an old page stands for its root
    near = work_table(near.select("a", F.when(F.col("fresh"), F.col("b")).otherwise(F.col("b_root.page")).alias("b"), "skeleton", "fresh", "b_root"), "near")
    roots = fresh.select("page", F.col("first").alias("root"))
    if not near.isEmpty():
        nodes = roots.unionByName(near.filter("not fresh").select(F.col("b").alias("page"), F.col("b_root").alias("root")).distinct())
        touched = near.select(F.col("a").alias("page")).unionByName(near.select(F.col("b").alias("page"))).distinct()
        found = _joined(nodes.join(touched, "page", "left_semi"), near.select("a", "b"))
        old = near.filter("not fresh").select(F.col("b").alias("page"), "skeleton").distinct().join(found, "page").filter("page != root.page").select("skeleton", "page", "root")
        if not old.isEmpty():
            old = work_table(old, "merged")
            if merged is not None:  # what had been joined to a root that now moves, moves too
                moved = old.select("skeleton", F.col("page").alias("was"), F.col("root").alias("now"))
                old = old.unionByName(merged.join(moved, (merged["skeleton"] == moved["skeleton"]) & (F.col("root.page") == F.col("was"))).select(merged["skeleton"], "page", F.col("now").alias("root")))
            history.append("merged", old, "skeleton")
        roots = roots.join(found.withColumnRenamed("root", "least"), "page", "left").select("page", F.coalesce("least", "root").alias("root"))
    known = new.filter("known is not null")
    if merged is not None:
        later = history.read("merged").select("skeleton", F.col("page").alias("was"), F.col("root").alias("now"))
        known = known.join(later, (known["skeleton"] == later["skeleton"]) & (F.col("known.page") == F.col("was")), "left").groupBy("page").agg(F.min(F.least("known", F.coalesce("now", "known"))).alias("root"))
    else:
        known = known.select("page", F.col("known").alias("root"))
    roots = work_table(roots, "fresh")
    rooted = fresh.select(*address).join(roots, "page")
    history.append("pages", roots, "page")
    history.append("parts", rooted, "skeleton")
    answer = roots.unionByName(known.select("page", "root"))
    return batch.select("article_id", "batch_no", "page").join(answer, "page").filter("batch_no > root.batch_no").select(F.col("root.article_id").alias("accepted_id"), "article_id").distinct()


def seen_before(articles: DataFrame, history: History | None = None) -> DataFrame:
    """accepted_id, article_id: articles whose source delivered the same page in an earlier batch_no, and as which article.

    history: what came before these articles, which are then one delivery. Without one, the lowest batch_no is loaded as
    the initial history, and all that came after it is one delivery against it. Pages are the same if a chain of spellings,
    each within MAX_LETTERS letters of the next, joins them. Null or blank urls, null sources and null batches match nothing;
    repeated article rows give one row. Equal pages collapse map-side; the join back runs on page hashes, where a page that
    many rows share is split by the adaptive skew join.
    """
    past = history or History(articles.sparkSession)
    rows = work_table(page_rows(spread(articles.select("article_id", "batch_no", "source_id", "url"))), "pages")
    initial = None if history else rows.agg(F.min("batch_no")).first()[0]
    if initial is not None:
        accept(past, rows.filter(F.col("batch_no") == initial))  # the first load repeats nothing
    found = work_table(accept(past, rows if initial is None else rows.filter(F.col("batch_no") > initial)), "found")
    if history is None:
        past.drop()
    return found
