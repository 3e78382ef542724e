"""Problem 9: sources mixed to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.llm.tokens import token_counts
from presswell.tables import work_table

#: Sources that together have at most this target weight may fall short of it, rather than hold down all the others.
GIVE_UP = 0.05
BUCKETS = 1024
SEED = 17


def budget(sources: dict[str, tuple[float, int]], give_up: float = GIVE_UP) -> float:
    """The largest total at which only sources of at most `give_up` weight are clamped. sources: (weight, most tokens)."""
    live = sorted(((cap / w, w, cap) for w, cap in sources.values() if w > 0 and cap > 0))
    whole, lost, fixed = sum(w for _, w, _ in live), 0.0, 0.0
    for i, (_, w, cap) in enumerate(live):
        rest = whole - lost
        total = fixed + min(c * rest / v for _, v, c in live[i:])
        if lost + w > give_up * whole or i == len(live) - 1:
            return total
        lost, fixed = lost + w, fixed + cap
    return 0.0


def water_fill(sources: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens per source: in proportion to the weights, clamped at the caps, the excess shared out until all fits."""
    quota: dict[str, float] = {s: 0.0 for s in sources}
    live = {s for s, (w, cap) in sources.items() if w > 0 and cap > 0}
    left = total
    while live:
        weight = sum(sources[s][0] for s in live)
        over = {s for s in live if sources[s][0] / weight * left >= sources[s][1]}
        if not over:
            quota |= {s: sources[s][0] / weight * left for s in live}
            break
        quota |= {s: float(sources[s][1]) for s in over}
        left -= sum(sources[s][1] for s in over)
        live -= over
        if left <= 0:
            break
    return quota


def _sized(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    # one row per source; the targets are a small table by their nature
    wanted = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.join(wanted.select("source"), "source", "left_semi")
    sizes = work_table(token_counts(docs, ["doc_id", "source"]).filter("tokens > 0").withColumn("u", F.xxhash64(F.lit(SEED), "doc_id")), "sizes")
    return wanted, sizes


def _quotas(wanted: DataFrame, sizes: DataFrame, total: float | None) -> DataFrame:
    pool = {r["source"]: r for r in wanted.join(sizes.groupBy("source").agg(F.sum("tokens").alias("pool")), "source", "left").collect()}
    caps = {s: (float(r["target_share"] or 0), int(r["pool"] or 0) * max(0, r["max_repeats"] or 0)) for s, r in pool.items()}
    fill = water_fill(caps, budget(caps) if total is None else total)
    rows = []
    for s, q in fill.items():
        have = int(pool[s]["pool"] or 0)
        whole = int(q // have) if have else 0
        rows.append((s, have, q, whole, q - whole * have if have else 0.0))
    return wanted.sparkSession.createDataFrame(rows, "source string, pool long, quota double, whole int, rest double")


def _prefix(rows: DataFrame) -> DataFrame:
    """The rows that fit within `rest` tokens of their source, in seeded order.

    The order is by hash bucket, then by hash: token sums per bucket, a table of sources x BUCKETS rows, say in which bucket
    the rest of the quota ends, and only that bucket's rows are summed one by one.
    """
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "bucket", "n", F.expr("coalesce(sum(n) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    placed = rows.join(before, ["source", "bucket"]).filter(F.col("before") < F.col("rest"))
    whole = F.col("before") + F.col("n") <= F.col("rest")
    last = placed.filter(~whole).withColumn("run", F.col("before") + F.expr("sum(tokens) over (partition by source, bucket order by u, doc_id rows unbounded preceding)"))
    return placed.filter(whole).select(*rows.columns).unionByName(last.filter(F.col("run") <= F.col("rest")).select(*rows.columns))


def _drawn(wanted: DataFrame, sizes: DataFrame, total: float | None) -> tuple[DataFrame, DataFrame]:
    quotas = _quotas(wanted, sizes, total)
    bucket = F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * BUCKETS).cast("int")
    rows = sizes.join(F.broadcast(quotas.select("source", "whole", "rest")), "source").withColumn("bucket", bucket)
    first = work_table(_prefix(rows).select("source", "doc_id", "tokens"), "drawn")
    # a long document that crosses the end is passed over; shorter ones fill what it leaves
    left = quotas.join(first.groupBy("source").agg(F.sum("tokens").alias("got")), "source", "left").select("source", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("rest"))
    others = rows.drop("rest").join(first.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(left), "source").filter(F.col("tokens") <= F.col("rest"))
    once = first.select("doc_id").unionByName(_prefix(others).select("doc_id")).distinct().withColumn("extra", F.lit(1))
    drawn = rows.join(once, "doc_id", "left").select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("repeats"))
    return quotas, drawn.filter("repeats > 0")


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, tokens, repeats of the chosen documents.

    total: tokens of the whole mixture; by default the largest at which only sources of GIVE_UP weight fall short. Every
    document of a source is taken its whole number of epochs, and a seeded part of them once more; a source whose quota is
    its cap has no such part, so max_repeats holds. Sources without
    documents or targets, null sources and empty texts give no rows; a target listed twice counts with the sum of its
    shares.
    """
    wanted, sizes = _sized(documents, targets)
    return _drawn(wanted, sizes, total)[1]


def mixture_report(documents: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source: documents and tokens at hand, documents and tokens used, target and reached share."""
    wanted, sizes = _sized(documents, targets)
    quotas, drawn = _drawn(wanted, sizes, total)
    used = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = wanted.join(quotas.select("source", "pool"), "source").join(used, "source", "left").select("source", "target_share", "max_repeats", F.col("pool").alias("tokens_at_hand"), zero("documents_used"), zero("tokens_used"), zero("most_repeats"))
    whole = rows.agg(F.sum("tokens_used").alias("_whole"))
    return rows.join(F.broadcast(whole)).withColumn("reached_share", F.round(F.col("tokens_used") / F.greatest(F.lit(1), F.col("_whole")), 6)).drop("_whole")
