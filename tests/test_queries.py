import glob
import os

import duckdb
import pytest

import __spark_entry__
from kinlink.oracle import ORACLE_SQL
from kinlink.queries import QUERIES


@pytest.fixture(scope="module")
def second(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, second, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) or name.startswith(("gt_", "validate_"))
    if name in ORACLE_SQL:
        want = second.sql(ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        rows = [df[columns].astype(str).sort_values(columns).values.tolist() for df in (got, want)]
        assert rows[0] == rows[1]


def test_variant_features_by_brute_force(spark, sf_dir):
    """Every feature that strings decide, against plain Python."""
    from kinlink.functions.similarity import best_window, lcs
    from kinlink.queries import TOP, _variant
    from kinlink.operators import blocking, features

    a, b = _variant(spark, sf_dir)
    feats = features.pair_features_variant(blocking.candidates_variant(a, b, TOP), a, b).collect()
    records = {r.entity_id: r for r in a.union(b).collect()}
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0
    for f in feats:
        x, y = records[f.entity_id_s1], records[f.entity_id_s2s3]
        s, t = set(x.nn.split()), set(y.nn.split())
        assert f.name_ratio == pytest.approx(ratio(x.nn, y.nn)) and f.name_partial_ratio == pytest.approx(best_window(x.nn, y.nn))
        assert f.name_jaccard == pytest.approx(len(s & t) / len(s | t) if s and t else 0.0)
        assert f.addr_token_sort == pytest.approx(ratio(" ".join(sorted(x.na.split())), " ".join(sorted(y.na.split()))))
        assert f.name_first_token == float(bool(s and t) and min(s) == min(t))
