from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswell.functions.dates import instant, readings, zone_of
from presswell.operators.dates import declared_dates, format_mixture, mixture, normalised_dates
from presswell.operators.periods import calendar_day, calendar_day_column, resolve_period
from presswell.plans.queries import p3_found
from presswell.tables import read_table


def micros(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("raw", "wall"),
    [
        ("Publié le 1er mai 2021", (2021, 5, 1)), ("20 février 2022 à 09h28", (2022, 2, 20, 9, 28)), ("February 19, 2022 at 4:14 p.m.", (2022, 2, 19, 16, 14)), ("22 lutego 2022 r., godz. 13:16", (2022, 2, 22, 13, 16)),
        ("den 21 april 2020 kl. 13.47", (2020, 4, 21, 13, 47)), ("16 de febrero de 2022 a las 09:11 h", (2022, 2, 16, 9, 11)), ("PRESSEMITTEILUNG VOM 17. FEBRUAR 2022", (2022, 2, 17)), ("2021. 06. 30.", (2021, 6, 30)), ("24. Februar 2022, 10.50 Uhr", (2022, 2, 24, 10, 50)),
    ],
)
def test_notations(raw, wall):
    assert [w for _, w, _ in readings(raw)] == [datetime(*wall)]


@pytest.mark.parametrize("raw", [None, "", " ", "-", "n/a", "12:45", "heute, 14:05 Uhr", "2 hours ago", "Spring 2023", "March 2022", "30 février 2022", "2024-13-05", "0000-00-00", "{{ pubDate }}", "x" * 100_000])
def test_what_is_no_date(raw):
    assert readings(raw) == []


def test_zones():
    assert zone_of(" EUROPE/berlin ").key == "Europe/Berlin"
    assert zone_of("GMT+3").utcoffset(None).total_seconds() == 10800 and zone_of("-01:00").utcoffset(None).total_seconds() == -3600
    assert [zone_of(z) for z in (None, "", " ", "server time", "local", "Europe/Atlantis", "n/a")] == [None] * 7
    berlin = zone_of("Europe/Berlin")
    assert instant(datetime(2021, 10, 31, 2, 30), None, berlin) == micros(2021, 10, 31, 0, 30)
    assert instant(datetime(2021, 3, 28, 2, 30), None, berlin) is None
    assert instant(datetime(2021, 3, 28, 2, 30), 7200, berlin) == micros(2021, 3, 28, 0, 30)
    assert instant(datetime(2021, 3, 28), None, None) is None


SOURCES = [("dmy", "Europe/Berlin", "dmy", None), ("mdy", "Europe/Berlin", "MDY", ["%d/%m/%Y", "%m/%d/%Y"]), ("fmt", "UTC", "DMY", ["%m/%d/%Y", "%Y-%m-%d", None, "%q"]), ("none", "UTC", None, [])]
ROWS = [
    (1, "dmy", "03/04/2021", None, micros(2021, 4, 2, 22)), (2, "mdy", "03/04/2021", None, None), (3, "mdy", "05/05/2021", None, micros(2021, 5, 4, 22)), (4, "mdy", "25/12/2021", None, micros(2021, 12, 24, 23)), (5, "mdy", "03.04.2021", "UTC", micros(2021, 3, 4)),
    (6, "fmt", "03/04/2021", " ", micros(2021, 3, 4)), (7, "fmt", "03/04/2021 10:00", "utc+02:00", micros(2021, 4, 3, 8)), (8, "none", "03/04/2021", "Europe/Paris", micros(2021, 4, 2, 22)), (9, "dmy", "1427581440", "Europe/Paris", micros(2015, 3, 28, 22, 24)),
    (10, "dmy", "Sat, 28 Mar 2015 22:24:00 CET", "UTC", micros(2015, 3, 28, 21, 24)), (11, "dmy", "2015-03-29 02:30", None, None), (12, "dmy", None, None, None), (13, "dmy", "13/13/2021", None, None), (14, "unknown", "03/04/2021", "UTC", micros(2021, 4, 3)), (15, None, "2021-01-01", "UTC", micros(2021, 1, 1)),
    (16, "unknown", "2021-01-01", None, None), (1, "dmy", "03/04/2021", None, micros(2021, 4, 2, 22)),
]


def frames(spark):
    s = spark.createDataFrame(SOURCES, "id string, timezone string, date_order string, date_formats array<string>").withColumn("language", F.lit("en"))
    c = spark.createDataFrame([(i, k, r, z, "clash") for i, k, r, z, _ in ROWS], "candidate_id long, source_id string, raw_value string, timezone string, notation string")
    return c, s


def test_dates_by_source_settings(spark):
    got = sorted((r["candidate_id"], r["utc_micros"] or 0) for r in normalised_dates(*frames(spark)).collect())
    assert got == sorted((i, want or 0) for i, _, _, _, want in ROWS)
    kinds = {r["candidate_id"]: r["ambiguous"] for r in normalised_dates(*frames(spark)).filter("ambiguous").collect()}
    assert kinds == {2: True}
    assert format_mixture(*frames(spark)).agg(F.sum("ambiguous")).first()[0] == 1


def test_no_candidates(spark):
    c, s = frames(spark)
    assert normalised_dates(c.limit(0), s).count() == 0
    assert normalised_dates(c, s.limit(0)).filter("utc_micros is not null").count() == 7


def test_the_mixture_leans_to_the_commoner_notation():
    stats = pd.DataFrame({"source_key": "s", "signature": ["DMY", "DMY | MDY", "MDY"], "n": [90, 40, 2]})
    out = mixture(stats, decide_above=0.9).set_index("signature")
    assert out.loc["DMY | MDY", "notation"] == "DMY" and not out.loc["DMY | MDY", "ambiguous"] and out.loc["DMY | MDY", "posterior"] > 0.9
    assert mixture(stats).set_index("signature").loc["DMY | MDY", "ambiguous"]


def test_calendar_days_and_periods(spark):
    assert calendar_day("1130405")[0].isoformat() == calendar_day("民國113/4/5")[0].isoformat() == calendar_day("2024-04-05")[0].isoformat() == "2024-04-05"
    for bad in ("", "113045", "2024/4-5", "99-1-1", "20240230"):
        with pytest.raises(ValueError):
            calendar_day(bad)
    p = resolve_period(now=datetime(2026, 7, 14, 0, tzinfo=timezone.utc), days=14)
    assert (p.first.isoformat(), p.last.isoformat(), p.since.isoformat()) == ("2026-06-30", "2026-07-14", "2026-06-29T16:00:00+00:00")
    for bad in ({"since": "20240101"}, {"since": "20240102", "until": "20240101"}, {"since": "20240101", "until": "20240102", "days": 1}, {"days": -1}):
        with pytest.raises(ValueError):
            resolve_period(**bad)
    rows = spark.createDataFrame([("1130405",), ("20240405",), ("2024/4/5",), ("113-4-5",), ("2024-13-01",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in rows.select(calendar_day_column(F.col("d"))).collect()] == ["2024-04-05"] * 4 + ["None"] * 3


def test_hidden_formats_are_recovered_from_the_mixture(spark):
    """Sources whose order of day and month is declared wrongly: the days above twelve give it away."""
    rows, truth = [], {}
    for k, (source, pattern) in enumerate((("dmy", "{d:02d}/{m:02d}/2022"), ("mdy", "{m:02d}/{d:02d}/2022"))):
        for i in range(120):
            d, m = 1 + i % 28, 1 + i % 12
            rows.append((1000 * k + i, source, pattern.format(d=d, m=m), "UTC"))
            truth[1000 * k + i] = (d, m)
    candidates = spark.createDataFrame(rows, "candidate_id long, source_id string, raw_value string, timezone string")
    wrong = spark.createDataFrame([("dmy", "UTC", [], "MDY"), ("mdy", "UTC", [], "DMY")], "id string, timezone string, date_formats array<string>, date_order string")
    strict = normalised_dates(candidates, wrong).filter("utc_micros is not null")
    got = normalised_dates(candidates, wrong, decide_above=0.8, doubt=0.6).select("candidate_id", F.from_unixtime(F.col("utc_micros") / 1_000_000, "d").cast("int").alias("d"), F.from_unixtime(F.col("utc_micros") / 1_000_000, "M").cast("int").alias("m")).collect()
    right = sum((r["d"], r["m"]) == truth[r["candidate_id"]] for r in got) / len(truth)
    trusted = strict.select("candidate_id", F.from_unixtime(F.col("utc_micros") / 1_000_000, "d").cast("int").alias("d")).collect()
    assert right > 0.95 > sum(r["d"] == truth[r["candidate_id"]][0] for r in trusted) / len(truth)


def test_p3_found_decides_each_value_by_itself(spark, tmp_path):
    """Declarations are certain there: no fit is run whose posteriors choose nothing, and each value is read once."""
    candidates, sources = frames(spark)
    signs = [(20, "signs", "03 | 04 | 2021", None), (21, "signs", "03 = 04 = 2021", None), (22, "signs", "05/06/2021", None)]
    candidates = candidates.drop("notation").unionByName(spark.createDataFrame(signs, candidates.drop("notation").schema))
    sources = sources.drop("language").unionByName(spark.createDataFrame([("signs", "UTC", "MDY", ["%d | %m | %Y", "%d = %m = %Y"])], sources.drop("language").schema))
    candidates.write.parquet(str(tmp_path / "date_candidates.parquet"))
    sources.write.parquet(str(tmp_path / "sources.parquet"))
    found = p3_found(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("ArrowEvalPython") == 1
    want = {(i, at) for i, _, _, _, at in ROWS if at is not None} | {(20, micros(2021, 4, 3)), (21, micros(2021, 4, 3)), (22, micros(2021, 5, 6))}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_declared_dates_are_those_of_a_fit_without_doubt(spark, data):
    candidates, sources = read_table(spark, data, "date_candidates"), read_table(spark, data, "sources")
    fitted = normalised_dates(candidates, sources).select(*candidates.columns, "utc_micros")
    declared = declared_dates(candidates, sources)
    assert declared.columns == fitted.columns and declared.filter("utc_micros is not null").count() > 0
    assert declared.exceptAll(fitted).isEmpty() and fitted.exceptAll(declared).isEmpty()
