import random
from itertools import combinations

import numpy as np
import pytest

from presswell.llm import recompress as rc
from presswell.llm import spans
from presswell.tables import read_table

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=random.Random(i).randint(2, 9))) for i in range(800)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def windows(t):
    return {t[i : i + spans.LENGTH] for i in range(len(t) - spans.LENGTH + 1)}


def brute(docs):
    w = {i: windows(t) for i, t in docs if t}
    return sorted((a, b) for a, b in combinations(sorted(w), 2) if w[a] & w[b])


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    docs = [(i, text(rng, rng.randint(0, 200))) for i in range(60)]
    for k in range(60):
        a, b = rng.sample(range(60), 2)
        s = docs[a][1]
        n = rng.choice([150, 190, 199, 200, 201, 210, 260, 600])
        if len(s) >= n:
            at = rng.randint(0, len(s) - n)
            t = docs[b][1]
            cut = rng.randint(0, len(t))
            docs[b] = (b, t[:cut] + s[at : at + n] + t[cut:])
    docs += [(100, docs[3][1] + " end " * 60), (101, docs[3][1] + " end " * 60), (102, None), (103, ""), (104, "ab" * 400), (105, "x" + "ab" * 300), (106, "a" * 900), (107, "b" + "a" * 500), (108, "na\0ive " * 80), (109, "é😀" * 200), (110, "é😀" * 150)]
    return docs


@pytest.mark.parametrize("hot", [spans.HOT, 1])
def test_pairs_equal_brute_force(spark, planted, hot):
    docs = spark.createDataFrame([(*d, 1, "c") for d in planted], "doc_id long, text string, pos int, key string")
    assert sorted(map(tuple, spans.shared_pairs(docs, hot).collect())) == brute(planted)


def test_pairs_of_the_test_data_equal_brute_force(spark, data):
    docs = read_table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spans.shared_pairs(docs).collect())) == brute(rows)


def test_coverage_equals_brute_force(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_coverage(docs).collect()}
    seen = {}
    for i, t in planted:
        for w in windows(t or ""):
            seen.setdefault(w, set()).add(i)
    for i, t in planted:
        marks = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - spans.LENGTH + 1):
            if len(seen[t[k : k + spans.LENGTH]]) > 1:
                marks[k : k + spans.LENGTH] = True
        assert got[i] == marks.sum() if i not in (104, 105, 106, 107, 109, 110) else got[i] > 0, i


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(docs).count() == 0
    assert spans.shared_coverage(docs).count() == 0


def test_a_repeated_row_is_one_document(spark):
    t = text(random.Random(1), 100)
    docs = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert spans.shared_pairs(docs).count() == 0


def test_names_do_not_depend_on_the_surroundings():
    rng = random.Random(2)
    shared = text(rng, 60)
    sets = []
    for _ in range(2):
        t = text(rng, 30) + shared + text(rng, 30)
        _, place, key = rc.anchors([t])
        sets.append({k for p, k in zip(place, key, strict=True)})
    assert len(sets[0] & sets[1]) >= 5


def test_classes_do_not_expand_copies(spark):
    part = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(260))
    docs = [(1, part + " first ending"), (2, part + " first ending"), (3, "another beginning " + part), (4, "nothing shared here " * 12), (5, None), (6, ""), (None, part)]
    got = sorted(tuple(r) for r in spans.shared_classes(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id", "members", "links").collect())
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0), (5, 5, 1, 0), (6, 6, 1, 0)]
