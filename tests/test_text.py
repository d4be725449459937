import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as sim
from kinlink.functions import text as tx

NAMES = [
    ("Acme & Sons, Inc.", "acme and sons", "acme and sons inc", "acme and sons", "acmeandsons"),
    ("Société Générale S.A.", "société générale s a", "société générale s a", "a générale s société", "sociétégénéralesa"),
    ("Wal-Mart Stores Pvt. Ltd.", "wal mart stores", "wal mart stores pvt ltd", "mart stores wal", "walmartstores"),
    ("LLC", "", "llc", "", ""),
    ("  Foo   FOO co ", "foo foo", "foo foo co", "foo foo", "foofoo"),
    ("नमस्ते Traders", "नमस त traders", "नमस त traders", "traders त नमस", "नमसतtraders"),
    (None, "", "", "", ""),
]


def test_names(spark):
    df = spark.createDataFrame([(f"S1-{i}", n[0], "5 Main Street", None) for i, n in enumerate(NAMES)], "entity_id string, business_name string, business_address string, country string")
    got = tx.prepare(df).orderBy("entity_id").collect()
    assert [(r.nn, r.nnf, r.sn, r.cn) for r in got] == [n[1:] for n in NAMES]
    assert {(r.na, r.cl, r.source) for r in got} == {("5 main street", "", "S1")}


def test_variant(spark):
    rows = [("S2-1", "Société Générale Holdings", "12 North Main Street, Karnataka 560001", " India "), ("S2-2", None, None, None)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    a, b = tx.prepare_variant(df).orderBy("entity_id").collect()
    assert (a.nn, a.na, a.cl) == ("societe generale", "12 n main st ka 560001", "india")
    assert sorted(a.numbers) == ["12", "560001"] and sorted(a.tokens) == ["generale", "societe"]
    assert (b.nn, b.na, b.tokens, b.numbers) == ("", "", [], [])


def test_ngrams(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",)], "c string")
    assert [sorted(r[0]) for r in df.select(tx.char_ngrams(F.col("c"))).collect()] == [["abc", "bca", "cab"], [], []]


PAIRS = [
    ("acme trading", "acme traders", 9, 0.75, 0.75, 0.75, 0.333333, 0.5, 1.0),
    ("royal tea house", "tea royal", 5, 0.416667, 0.75, 1.0, 0.666667, 1.0, 0.6),
    ("alpha beta", "gamma delta", 6, 0.571429, 0.380952, 0.380952, 0, 0, 0.909091),
    ("state bank india", "sbi", 3, 0.315789, 0.210526, 0.210526, 0, 0, 0.1875),
    ("", "x", 0, 0, 0, 0, 0, 0, 0),
]


def test_similarity(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "a string, b string")
    a, b = F.col("a"), F.col("b")
    x, y = tx.words(a), tx.words(b)
    got = df.select(sim.lcs_len(a, b), sim.ratio(a, b), sim.token_sort_ratio(a, b), sim.token_set_ratio(a, b), sim.jaccard(x, y), sim.overlap(x, y), sim.length_ratio(a, b)).collect()
    for r, p in zip(got, PAIRS, strict=True):
        assert list(r) == pytest.approx(list(p[2:]), abs=1e-6)


def test_known_ratios(spark):
    df = spark.createDataFrame([("this is a test", "this is a test!"), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), ("fuzzy was a bear", "fuzzy fuzzy was a bear")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(sim.ratio(a, b), sim.token_sort_ratio(a, b), sim.token_set_ratio(a, b)).collect()
    assert got[0][0] == pytest.approx(28 / 29) and got[1][1] == 1.0 and got[2][2] == 1.0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_and_windows():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert sim.lcs(a, b) == slow_lcs(a, b)
        if a and b:
            s, t = sorted((a, b), key=len)
            windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
            assert sim.best_window(a, b) == pytest.approx(max(2 * slow_lcs(s, w) / (len(s) + len(w)) for w in windows))
    assert sim.best_window("tea", "royal tea house") == 1.0
    assert sim.best_window("", "x") == 0.0
