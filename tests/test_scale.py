"""What the variant's steps pass on, where one name or number is everywhere: rows counted in the plans that ran."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinlink import fixtures
from kinlink.functions import similarity as sim
from kinlink.functions.text import prepare_variant
from kinlink.operators import blocking
from kinlink.plans.params import Params
from kinlink.queries import QUERIES

COLUMNS = "entity_id string, business_name string, business_address string, country string"


def entities(spark, rows):
    return prepare_variant(spark.createDataFrame([(*r, "US")[:4] for r in rows], COLUMNS)).persist()


def passed(df, name, metric):
    """The most rows that any node of the name had in ``metric``, of a DataFrame that was collected."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if re.search(name, kind) and node.metrics().contains(metric):
            found.append(node.metrics().apply(metric).value())
        inner = node.children()
        todo += [inner.apply(i) for i in range(inner.size())]
        if kind.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in kind or kind.startswith("ResultQueryStage"):
            todo.append(node.plan())
    return max(found)


def test_address_numbers_shuffle_records_not_pairs(spark):
    left, right = (entities(spark, [(f"{s}-{i:03d}", "x", f"77 road {i % 7}") for i in range(n)]) for s, n in (("S1", 60), ("S2", 90)))
    df = blocking.block_addr_numbers(left, right, least=1)
    got = df.collect()
    assert len(got) == len({tuple(r) for r in got}) == 60 * 90  # each shares 77, some share another number too
    assert 0 < passed(df, "^Exchange", "shuffleRecordsWritten") <= 2 * 90


def test_hot_names_cost_rows_times_cap(spark):
    """Every record of one name and number: 150 x 450 pairs by each key, of which five a record stay."""
    left, right = (entities(spark, [(f"{s}-{i:03d}", ("alpha beta", "beta alpha")[i % 2], f"road 12345 {i % 3}") for i in range(n)]) for s, n in (("S1", 150), ("S2", 450)))
    df = blocking.candidates_variant(left, right, Params(variant_cap=5))
    got = {(r.entity_id_s1, r.entity_id_s2s3): (r.methods, r.n_methods) for r in df.collect()}
    assert got == {(f"S1-{i:03d}", f"S2-{j:03d}"): ("addr_number,exact,prefix,sorted,token", 5) for i in range(150) for j in range(i % 2, 10, 2)}
    assert 0 < passed(df, "Join", "numOutputRows") <= 150 * 5


@pytest.mark.parametrize(("cap", "freq", "twice"), [(1, 1000, 0), (3, 40, 0), (7, 25, 0), (3, 1000, 6)])
def test_variant_candidates_against_all_pairs(spark, cap, freq, twice):
    """With random names and numbers, and with ids that stand several times."""
    r = random.Random(cap)
    some = lambda words, n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))

    def rows(source, n):
        out = [(f"{source}-{i:03d}", some(["ab", "abc", "q", "foo", "fooba", "rbaz", "bar"], 4), some(["12", "1234", "5678", "main"], 2), r.choice(["US", "US", "IN"])) for i in range(n)]
        return out + [(r.choice(out)[0], *r.choice(out)[1:]) for _ in range(twice)]

    a, b = rows("S1", 80), rows("S2", 100)
    left, right = entities(spark, a), entities(spark, b + ([("S1-003", "foo", "1234", "US")] if twice else []))
    params = Params(variant_cap=cap, token_freq_cap=freq)
    blocks = [
        blocking.key_block(left, right, F.col("nn"), "exact"), blocking.key_block(left, right, F.col("sn"), "sorted"), blocking.block_prefix(left, right),
        blocking.block_token_sets(left, right, freq), blocking.block_addr_numbers(left, right),
    ]
    pairs = blocking.union_blocks(blocks).filter("entity_id_s1 <> entity_id_s2s3").withColumnsRenamed({"block": "methods", "n_blocks": "n_methods"})
    want = sorted(map(tuple, blocking.cap_candidates(pairs, cap, "n_methods").collect()))
    assert want and sorted(map(tuple, blocking.candidates_variant(left, right, params).collect())) == want


def test_similarities_in_batches():
    """Many pairs together against one by one: words of 64 bits and their borders, other scripts, empty and very long strings; called once for each distinct pair."""
    r = random.Random(2)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    kinds = (("ab", 9), ("abcd ", 70), ("abcdéन😀", 140), ("".join(map(chr, range(0x4E00, 0x5E00))), 80))
    pairs = [(some(*k), some(*k)) for k in kinds for _ in range(60)] + [(None, "x"), ("", ""), ("a" * 64, "b" + "a" * 64), ("a" * 63 + "b", "ab" * 32), ("a" * 256, "ba" * 257), ("ab" * 700, "b" * 600)]
    x, y, which = sim._distinct(*(pd.Series([p[i] for p in pairs * 2]) for i in (0, 1)))
    assert len(x) == len(set(pairs))
    for f, one in ((sim.lcs_lengths, sim.lcs), (sim.best_windows, sim.best_window)):
        assert list(f(x, y)[which]) == [one(a or "", b or "") for a, b in pairs * 2]


def test_features_of_a_pair_meet_python_in_batches(spark, monkeypatch):
    """No string similarity of the variant goes through the loop over single pairs."""
    monkeypatch.setattr(sim, "best_window", None)
    monkeypatch.setattr(sim, "lcs", None)
    a, b = pd.Series(["royal tea house", "state bank"]), pd.Series(["tea royal", "bank of state"])
    assert list(sim.lcs_len.func(a, b)) == [5, 5] and list(sim.partial_ratio.func(a, b).round(6)) == [0.714286, 0.666667]


def test_feat_mod_of_a_hot_name(spark, tmp_path):
    """feat_mod itself, over documents of one name: five rows for each record of the first source, no step with more pairs."""
    words = "acme trading house of tea main road 12345 north side of town by the old river"
    spark.createDataFrame([(i, words, "en") for i in range(300)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["feat_mod"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == 100 * 5 and {r.name_ratio for r in got} == {1.0} and {r.n_blocking_methods for r in got} == {5.0}
    assert 0 < passed(df, "Join", "numOutputRows") <= 100 * 5


def test_words_of_long_texts(spark, tmp_path):
    """Blanks go at both ends alone, also before a last line separator, as in SQL; words behind the 25th change nothing."""
    rows = [(0, "one two \x85"), (1, " \n\t a  b\r\n"), (2, " ".join(f"w{i}" for i in range(400))), (3, " \n"), (4, None)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.business_name, r.business_address, r.truth_key) for r in fixtures.document_entities(spark, str(tmp_path)).orderBy(F.substring("entity_id", 4, 9)).collect()]
    w = [f"w{i}" for i in range(25)]
    assert got == [("one two \x85", "", ""), ("a b", "", ""), (" ".join(w[:5]), " ".join(w[5:15]), " ".join(w[5:])), ("", "", ""), ("", "", "")]
