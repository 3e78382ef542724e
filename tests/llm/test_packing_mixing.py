import random

from hypothesis import given, settings
from hypothesis import strategies as st

from presswell.llm import mixing, packing
from presswell.llm.tokens import VOCABULARY, encoder
from presswell.tables import public_tokenizer, read_table


def unfolded(counts, capacity):
    """container -> lengths, from the planned slots."""
    bins, taken = {}, {}
    for length, rank, n, first, each in packing.plan(counts, capacity):
        assert rank == taken.get(length, 0)
        taken[length] = rank + n
        for i in range(n):
            bins.setdefault(first + i // each, []).append(length)
    assert taken == {k: v for k, v in counts.items() if v > 0}
    return bins


def best_fit(counts, capacity):
    spaces = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [s for s in spaces if s >= x]
        if fit:
            spaces.remove(min(fit))
            spaces.append(min(fit) - x)
        else:
            spaces.append(capacity - x)
    return len(spaces)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_the_plan_holds_every_item_and_is_as_tight_as_best_fit(counts):
    bins = unfolded(counts, 40)
    assert all(sum(b) <= 40 for b in bins.values())
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= best_fit(counts, 40) + 1


def test_every_token_is_in_one_container(spark, data):
    docs = read_table(spark, data, "documents").select("doc_id", "text")
    long = spark.createDataFrame([(-1, "word " * 9000), (-2, ""), (-3, None), (-4, "x"), (-4, "x")], "doc_id long, text string")
    docs = docs.union(long).withColumn("tokens", docs["doc_id"] * 0).withColumn("rank", docs["doc_id"])
    got = packing.packed(docs).collect()
    encode = encoder(public_tokenizer(VOCABULARY)).encode_ordinary
    want = {}
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(encode(r["text"] or ""))
    have, fill, pieces = {}, {}, {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["tokens"]
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
    assert have == {k: v for k, v in want.items() if v}
    assert max(fill.values()) <= packing.CAPACITY
    at = 0
    for first, n in sorted(pieces[-1]):
        assert first == at
        at += n
    report = packing.fill_report(packing.packed(docs)).first()
    assert report["containers"] == len(fill) and report["containers"] <= 1.02 * report["least_containers"] + 1


def test_ranks_within_a_hot_length(spark):
    items = spark.range(5000).selectExpr("id as doc_id", "0 as piece_no", "if(id < 4000, 7, cast(id % 5 as int)) as tokens")
    rows = packing.ranked(items, "tokens", ["doc_id", "piece_no"], 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["tokens"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 5000


def test_nothing_to_pack(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs).count() == 0
    assert packing.fill_report(packing.packed(docs)).first()["containers"] == 0


def test_water_filling():
    s = {"a": (0.5, 100), "b": (0.3, 1000), "c": (0.2, 1000), "d": (0.1, 0)}
    q = mixing.water_fill(s, 500)
    assert q["a"] == 100 and q["d"] == 0 and abs(q["b"] - 240) < 1e-9 and abs(q["c"] - 160) < 1e-9
    q = mixing.water_fill(s, 10**6)
    assert (q["a"], q["b"], q["c"]) == (100, 1000, 1000)
    assert mixing.water_fill({}, 10) == {} and mixing.budget({}) == 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 10**6)), min_size=1, max_size=8))
def test_the_budget_is_fillable_and_gives_up_little(values):
    s = {str(i): v for i, v in enumerate(values)}
    total = mixing.budget(s)
    q = mixing.water_fill(s, total)
    live = {k: v for k, v in s.items() if v[1] > 0}
    if live:
        assert abs(sum(q.values()) - total) <= 1e-6 * max(1, total)
        weight = sum(w for w, _ in live.values())
        short = [k for k, (w, cap) in live.items() if q[k] < w / weight * total * (1 - 1e-9)]
        assert sum(live[k][0] for k in short) <= mixing.GIVE_UP * weight + 1e-9


def test_a_mixture_reaches_its_shares(spark):
    random.seed(1)
    docs = [(i, "word " * random.randint(5, 60), "abc"[i % 3], 1) for i in range(900)] + [(1000, "word " * 20, "tiny", 1), (1001, None, "a", 1), (1002, "", "b", 1), (1003, "word", None, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.26, 4), ("tiny", 0.02, 2), ("none", 0.02, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mixture_report(docs, targets).collect()}
    assert set(report) == {"a", "b", "c", "tiny", "none"}
    for s in "abc":
        assert abs(report[s]["reached_share"] - report[s]["target_share"] / 0.96) < 0.02
        assert report[s]["most_repeats"] <= report[s]["max_repeats"]
    assert report["none"]["tokens_used"] == 0 and report["tiny"]["most_repeats"] == 2
    rows = mixing.mixed(docs, targets).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} & {1001, 1002, 1003} == set()
    again = mixing.mixed(docs, targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_no_documents_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(docs, targets).count() == 0
    assert mixing.mixture_report(docs, targets).first()["reached_share"] == 0
