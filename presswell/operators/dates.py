"""Problem 3: mixed notations and zones of publication dates, brought to one UTC instant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.functions.dates import instant, readings, zone_of
from presswell.tables import work_table

READ = T.StructType([T.StructField("signature", T.StringType()), T.StructField("readings", T.MapType(T.StringType(), T.LongType()))])
MIXTURE = "source_key string, signature string, notation string, posterior double, ambiguous boolean"
#: Columns that normalised_dates makes; columns of the input with these names give way.
RESERVED = ("source_key", "signature", "readings", "notation", "posterior", "ambiguous", "utc_micros", "_id", "_home", "_formats", "_order", "_read")
#: Rounds of expectation-maximisation, and the count that every notation of a source starts with.
ROUNDS = 10
PRIOR = 0.5
#: A sign before a notation that the source's declarations speak against: its likelihood is `doubt` instead of 1.
AGAINST = "!"


def _found(raw: str | None, zone: str | None, home: str | None, formats: tuple[str, ...], order: str | None) -> tuple[dict, set]:
    """The instant of every reading of a value by notation (None if the clock or a missing zone leaves none), and the declared notations."""
    tz = zone_of(zone) or zone_of(home)
    found = {n: instant(wall, off, tz) for n, wall, off in readings(raw, formats)}
    wanted = (order or "").strip().upper() or "DMY"
    # what decides first is declared; every other reading is against a declaration
    tiers = ({"iso", "epoch"}, {n for n in found if n.startswith("fmt:")}, {"text"}, {wanted})
    return found, next((t & found.keys() for t in tiers if t & found.keys()), set())


def _one(*value) -> tuple[str, dict]:
    found, declared = _found(*value)
    valid = {n if n in declared else AGAINST + n: at for n, at in found.items()}
    groups: dict = {}
    for n, at in sorted(valid.items()):
        groups.setdefault(at, []).append(n)
    return " | ".join(sorted(" = ".join(g) for g in groups.values())), valid


def _declared(*value) -> int | None:
    """The instant that all declared readings of a value give; None if they differ or there is none."""
    found, declared = _found(*value)
    instants = {found[n] for n in declared}
    return instants.pop() if len(instants) == 1 else None


def _values(raw: pd.Series, zone: pd.Series, home: pd.Series, formats: pd.Series, order: pd.Series) -> Iterator[tuple]:
    for r, z, h, f, o in zip(raw, zone, home, formats, order, strict=True):
        yield r, z, h, tuple(x for x in f if x) if f is not None else (), o


@F.pandas_udf(READ)
def read_dates(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """signature: the notations a value has a reading in, joined by = where they give one instant and by | where not."""
    for batch in batches:
        yield pd.DataFrame([_one(*v) for v in _values(*batch)], columns=["signature", "readings"])


@F.pandas_udf(T.LongType())
def read_declared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The instant of a value where its source's declarations are certain."""
    for batch in batches:
        yield pd.Series([_declared(*v) for v in _values(*batch)], dtype="Int64")


# a filter on the instant would otherwise read every value a second time
read_declared = read_declared.asNondeterministic()


def _with_settings(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """candidates with what their source declares, in the columns _id, _home, _formats and _order."""
    home = sources.select(F.col("id").alias("_id"), F.col("timezone").alias("_home"), F.col("date_formats").alias("_formats"), F.col("date_order").alias("_order")).dropDuplicates(["_id"])
    return candidates.select(*[c for c in candidates.columns if c not in RESERVED]).join(home, F.col("source_id") == F.col("_id"), "left")


def declared_dates(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """candidates with utc_micros, where declarations are certain: the instant that all declared readings give.

    Each value decides for itself, in one narrow pass without a fit. The instants are those of normalised_dates with no
    doubt, where posteriors have nothing to choose; but its signatures split a format that holds " | " or " = ".
    """
    read = _with_settings(candidates, sources)
    return read.withColumn("utc_micros", read_declared("raw_value", "timezone", "_home", "_formats", "_order")).drop("_id", "_home", "_formats", "_order")


def mixture(stats: pd.DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, decide_above: float = 1.0, doubt: float = 0.0) -> pd.DataFrame:
    """Expectation-maximisation over the notations of one source.

    stats: source_key, signature, n. The likelihood of a valid reading is 1 where the source's declarations ask for its
    notation and `doubt` where they speak against it. Each value spreads its count over its readings in proportion to
    weight times likelihood; the weights of the notations follow from the counts. An instant is chosen if its posterior
    reaches decide_above. At 1, with no doubt, that means: all readings that may be true give this instant. Everything else
    is ambiguous; a signature without any likely reading is unread.
    """
    plain = lambda n: n.removeprefix(AGAINST)
    likely = lambda n: doubt if n.startswith(AGAINST) else 1.0
    sides = {s: [g.split(" = ") for g in s.split(" | ")] for s in stats["signature"]}
    names = sorted({plain(n) for gs in sides.values() for g in gs for n in g})
    weight = dict.fromkeys(names, 1.0 / max(1, len(names)))
    counts = dict(zip(stats["signature"], stats["n"], strict=True))
    for _ in range(rounds):
        mass = dict.fromkeys(names, prior)
        for s, gs in sides.items():
            share = {n: weight[plain(n)] * likely(n) for g in gs for n in g}
            total = sum(share.values())
            for n, w in share.items():
                mass[plain(n)] += counts[s] * w / total if total else 0.0
        whole = sum(mass.values())
        weight = {n: m / whole for n, m in mass.items()}
    out = []
    for s, gs in sides.items():
        share = [(sum(weight[plain(n)] * likely(n) for n in g), g) for g in gs]
        total = sum(w for w, _ in share)
        w, best = max(share)
        notation = max(best, key=lambda n: (likely(n) > 0, weight[plain(n)])) if total else None
        p = w / total if total else None
        out.append((stats["source_key"].iloc[0], s, notation, p, bool(total) and p < decide_above - 1e-12))
    return pd.DataFrame(out, columns=["source_key", "signature", "notation", "posterior", "ambiguous"]).astype({"notation": object, "posterior": "float64", "ambiguous": bool})


def normalised_dates(candidates: DataFrame, sources: DataFrame, decide_above: float = 1.0, doubt: float = 0.0) -> DataFrame:
    """candidates with utc_micros, notation, posterior and ambiguous.

    An instant is the posterior's choice (mixture). By default a declaration is certain and an instant must be, too; a
    source whose declarations are missing or wrong takes doubt above 0 and decide_above below 1.

    Values are parsed once, in Arrow batches; only (source, signature, count) reaches the mixture fit, a table bounded by
    the formats of a source and not by its rows. utc_micros is null for a null, blank or unreadable value, an unresolved
    ambiguity, a skipped local time, or a value without any zone; posterior and notation are null where nothing can be
    read. A candidate of an unknown source is read with its own zone and day-month-year. Repeated rows stay repeated.
    """
    key = F.coalesce(F.col("source_id"), F.lit("")).alias("source_key")
    columns = [c for c in candidates.columns if c not in RESERVED]
    read = _with_settings(candidates, sources).withColumn("_read", read_dates("raw_value", "timezone", "_home", "_formats", "_order"))
    read = work_table(read.select(*columns, key, "_read.signature", "_read.readings"), "dates")
    stats = read.filter("signature != ''").groupBy("source_key", "signature").agg(F.count(F.lit(1)).alias("n"))
    fit = stats.groupBy("source_key").applyInPandas(lambda g: mixture(g, decide_above=decide_above, doubt=doubt), MIXTURE)
    chosen = F.when(~F.col("ambiguous"), F.element_at("readings", F.col("notation")))
    return read.join(fit, ["source_key", "signature"], "left").withColumn("utc_micros", chosen).withColumn("notation", F.regexp_replace("notation", f"^{AGAINST}", "")).drop("source_key", "signature", "readings")


def format_mixture(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and notation, how many values were read in it, and how many were left ambiguous or unread."""
    d = normalised_dates(candidates, sources)
    return d.groupBy("source_id", F.coalesce("notation", F.lit("none")).alias("notation")).agg(F.count("utc_micros").alias("read"), F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("utc_micros").isNull()).alias("unread"))
