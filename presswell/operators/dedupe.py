"""Entity de-duplication in list order, and the merge of what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import normalised
from presswell.functions.urls import canonical_url
from presswell.tables import work_table

#: Pointer jumping halves the way to the root in each round; 40 rounds reach over 10^12 links.
ROUNDS = 40
#: List positions that one window walks at most.
RUN = 1 << 20


def utc_day(ts: Column) -> Column:
    """The calendar day of an instant in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def title_key(title: Column, published_at: Column, local_date: Column | None = None) -> Column:
    """Normalised title and local day; null without title or date."""
    day = utc_day(published_at).cast("string")
    if local_date is not None:
        day = F.coalesce(F.nullif(local_date, F.lit("")), day)
    return F.when((F.coalesce(title, F.lit("")) != "") & published_at.isNotNull(), F.concat_ws("\u0001", normalised(title), day))


def entities(keyed: DataFrame) -> DataFrame:
    """ord, entity: which row each row is merged into, the entity being the ord of its first row.

    keyed: ord (unique, list order), url_key, title_key. In list order a row joins the entity that its url points to, else
    the one its title points to, else it founds one; then both keys point to its entity. So all rows of one url share an
    entity, and the first row of a url joins the entity of the latest row before it with its title. That gives every url one
    parent at most, earlier in the list, and the entity is the root of its tree: windows over runs of the list and a
    logarithm of joins, no loop over rows. A null or empty url_key makes the row a url of its own; null titles match nothing.
    """
    own = F.concat(F.lit("\u0000"), F.col("ord").cast("string"))
    rows = keyed.select("ord", F.coalesce(F.nullif("url_key", F.lit("")), own).alias("u"), F.nullif("title_key", F.lit("")).alias("t"))
    heads = rows.groupBy("u").agg(F.min("ord").alias("head"))
    rows = work_table(rows.join(heads, "u"), "heads")
    before = _latest_before(rows.filter("t is not null").select("ord", "head", "t"))
    parents = rows.filter("ord = head").select("ord").join(before.filter("ord = head and up is not null").select("ord", "up"), "ord", "left")
    # a url's node is the ord of its first row; its parent is the node of the row before it
    tree = work_table(parents.select(F.col("ord").alias("node"), F.coalesce("up", "ord").alias("root")), "tree")
    for _ in range(ROUNDS):
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = work_table(tree.join(up, "root").select("node", F.col("further").alias("root"), (F.col("root") != F.col("further")).alias("moved")), "tree")
        tree = new.select("node", "root")
        if new.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"entities are not settled after {ROUNDS} rounds")
    return rows.join(tree, F.col("head") == F.col("node")).select("ord", F.col("root").alias("entity"))


def _latest_before(rows: DataFrame) -> DataFrame:
    """rows (ord, head, t) with up, the head of the row before it with the same t, null for the first.

    Titles that very many rows share are walked in runs of list positions: within a run by a window, across runs by the
    last head of each run, of which there are few.
    """
    spread = rows.withColumn("run", F.floor(F.col("ord") / RUN))
    ends = spread.groupBy("t", "run").agg(F.max_by("head", "ord").alias("end"))
    ends = ends.withColumn("carried", F.expr("lag(end) over (partition by t order by run)")).select("t", "run", "carried")
    inside = spread.withColumn("up", F.expr("lag(head) over (partition by t, run order by ord)"))
    return inside.join(ends, ["t", "run"]).select("ord", "head", F.coalesce("up", "carried").alias("up"))


def _ordered_union(rows: DataFrame, values: Column, name: str, texts: bool = True) -> DataFrame:
    """entity and the distinct values in order of first appearance; equal values collapse before they are gathered."""
    each = rows.select("entity", "ord", F.posexplode(values).alias("pos", "v")).filter("v is not null and v != ''" if texts else "v is not null")
    first = each.groupBy("entity", "v").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(name))


#: What identifies a date candidate.
CANDIDATE = ("raw_value", "utc_micros", "date_source", "timezone")


def merged(articles: DataFrame, order: str = "article_id") -> DataFrame:
    """One row per entity: its first row's source, url and language, the first known date, the longest title and summary,
    and the ordered unions of finders and other addresses. Null lists count as empty; ties go to the earlier row.

    Where the articles have them: the highest score, the ordered unions of topics and keywords, and the date candidates
    (an array of structs with the fields of CANDIDATE), each once, `selected` where it is the chosen date. Only ids and keys
    go through the search for entities; whole rows are joined and written once.
    """
    ord_ = F.col(order).alias("ord")
    keyed = work_table(articles.select(ord_, canonical_url("url").alias("_canonical"), title_key(F.col("title"), F.col("published_at")).alias("title_key")), "keyed")
    groups = entities(keyed.select("ord", F.col("_canonical").alias("url_key"), "title_key"))
    rows = work_table(articles.withColumn("ord", F.col(order)).join(groups.join(keyed.drop("title_key"), "ord"), "ord"), "grouped")
    longest = lambda c: F.max(F.struct(F.length(F.coalesce(c, F.lit(""))).alias("n"), (-F.col("ord")).alias("o"), F.coalesce(c, F.lit("")).alias("v")))["v"].alias(c)
    first = lambda c: F.min_by(c, "ord").alias(c)
    known = [c for c in ("date_source", "raw_value") if c in articles.columns]
    dated = F.min(F.when(F.col("published_at").isNotNull(), F.struct("ord", "published_at", "date_confidence", *known)))
    best = [F.max("score").alias("score")] if "score" in articles.columns else []
    out = rows.groupBy("entity").agg(*map(first, ("source_id", "country", "language", "url", "_canonical")), longest("title"), longest("summary"), dated.alias("_date"), F.count(F.lit(1)).alias("rows"), *best)
    finders = _ordered_union(rows, F.when(F.coalesce(F.size("discovered_by"), F.lit(0)) > 0, F.col("discovered_by")).otherwise(F.array("source_id")), "discovered_by")
    head = out.select(F.col("entity").alias("_e"), F.col("url").alias("_url"), F.col("_canonical").alias("_head"))
    none = F.array().cast("array<string>")
    others = rows.join(head, F.col("entity") == F.col("_e")).withColumn("_all", F.concat(F.coalesce("alternate_urls", none), F.when(F.col("_canonical") != F.col("_head"), F.array("url")).otherwise(none)))
    others = _ordered_union(others, F.array_remove(F.array_compact("_all"), F.coalesce(F.col("_url"), F.lit(""))), "alternate_urls")
    out = out.join(finders, "entity", "left").join(others, "entity", "left")
    lists = [c for c in ("topics", "keywords") if c in articles.columns]
    for c in lists:
        out = out.join(_ordered_union(rows, F.col(c), c), "entity", "left")
    more = [F.coalesce(c, none).alias(c) for c in lists] + [F.col(f"_date.{c}").alias(c) for c in known] + [F.col("score") for _ in best]
    if "date_candidates" in articles.columns:
        fields = lambda c: F.struct(*[c[f].alias(f) for f in CANDIDATE])
        out = out.join(_ordered_union(rows, F.transform("date_candidates", fields), "_candidates", texts=False), "entity", "left")
        chosen = lambda c: F.coalesce(c["utc_micros"] == F.unix_micros("_date.published_at"), F.lit(False)) & (F.coalesce(c["date_source"] == F.col("_date.date_source"), F.lit(False)) if "date_source" in known else F.lit(True)) & (F.coalesce(c["raw_value"] == F.col("_date.raw_value"), F.lit(False)) if "raw_value" in known else F.lit(True))
        more.append(F.transform("_candidates", lambda c: F.struct(*[c[f].alias(f) for f in CANDIDATE], chosen(c).alias("selected"))).alias("date_candidates"))
    return out.select("entity", "rows", "source_id", "country", "language", "title", "url", F.col("_date.published_at").alias("published_at"), F.col("_date.date_confidence").alias("date_confidence"), "summary", F.coalesce("discovered_by", none).alias("discovered_by"), F.coalesce("alternate_urls", none).alias("alternate_urls"), *more)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _one(rows, key, order, "asc")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, and where the key first stood (first_at)."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("first_at"))
    return _one(rows, key, order, "desc").join(first, key)


def _one(rows: DataFrame, key: list[str], order: list[str], way: str) -> DataFrame:
    pick = (F.min_by if way == "asc" else F.max_by)(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order))
    return rows.groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*")
