"""Problem 8: items of varying length in containers of fixed capacity."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.llm.tokens import token_counts
from presswell.tables import work_table

CAPACITY = 2048
#: Items of one length are ranked in so many hash buckets, so that no task sees a whole length.
BUCKETS = 128


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first rank, items, first container, items per container).

    Containers of equal free space are handled as ranges, so the work depends on the number of lengths, at most the
    capacity, and not on the number of items. Each length first takes the tightest containers that are open, then opens new
    ones and puts as many of its items in each as fit.
    """
    spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, opened = [], 0

    def fill(length: int, rank: int, n: int, first: int, each: int, space: int) -> None:
        slots.append((length, rank, n * each, first, each))
        if (left := space - each * length) > 0:
            spaces[left].append((first, n))

    for length in sorted((x for x, n in counts.items() if n > 0 and 0 < x <= capacity), reverse=True):
        rank, todo = 0, counts[length]
        for space in sorted(s for s in spaces if s >= length):
            while todo and spaces[space]:
                first, n = spaces[space].pop()
                each = min(space // length, todo)
                take = min(n, todo // each)
                if take < n:
                    spaces[space].append((first + take, n - take))
                fill(length, rank, take, first, each, space)
                rank, todo = rank + take * each, todo - take * each
            if not spaces[space]:
                del spaces[space]
        while todo:
            each = min(capacity // length, todo)
            n = todo // each
            fill(length, rank, n, opened, each, capacity)
            rank, todo, opened = rank + n * each, todo - n * each, opened + n
    return slots


def ranked(items: DataFrame, by: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """items with `rank`, 0 … n-1 within each value of `by`, without any task that holds all rows of a value.

    Rows are numbered within (value, hash bucket); the buckets' sizes, a table of at most values x buckets rows, give
    each bucket its first rank.
    """
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.expr(f"coalesce(sum(_n) over (partition by `{by}` order by _bucket rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    place = F.expr(f"row_number() over (partition by `{by}`, _bucket order by {', '.join(order)}) - 1")
    return spread.withColumn("_place", place).join(starts, [by, "_bucket"]).withColumn("rank", F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")


def packed(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, doc_id, piece_no, first_token, tokens: every token of every text in exactly one container.

    Only a text longer than the capacity is split: into pieces of the whole capacity and a rest. Null and empty texts take
    no place. Rows with a repeated doc_id are items of their own. The histogram has at most `capacity` lengths, so the
    driver plans over counts; documents then take the planned places by their rank within a length.
    """
    sizes = token_counts(documents, ["doc_id"]).filter("tokens > 0")
    piece = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int")))
    items = sizes.select("doc_id", "tokens", piece.alias("piece_no")).select("doc_id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("int").alias("tokens"))
    items = work_table(items, "items")
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = documents.sparkSession.createDataFrame(plan(histogram, capacity), "length int, from_rank long, n long, from_container long, each long")
    at = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n"))
    # the slots are at most a few for each length
    placed = ranked(items, "tokens", ["doc_id", "piece_no"]).join(F.broadcast(slots), (F.col("tokens") == F.col("length")) & at)
    container = F.col("from_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))
    return placed.select(container.cast("long").alias("container_id"), "doc_id", "piece_no", "first_token", "tokens")


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, items, tokens, fill (share of the space used) and least_containers (what no packing can beat)."""
    return containers.agg(F.count_distinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).select(
        "*", F.round(F.col("tokens") / F.greatest(F.lit(1), F.col("containers") * capacity), 6).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("least_containers")
    )
