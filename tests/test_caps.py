"""Candidates and features of the variant at the caps of production, against those at the cap of five."""

import collections

from kinlink.queries import QUERIES


def test_whole_holds_the_capped(spark, sf_dir):
    key = lambda r: (r.entity_id_s1, r.entity_id_s2s3)
    whole, capped, feats = ({key(r) for r in QUERIES[n](spark, sf_dir).collect()} for n in ("cand_mod_whole", "cand_mod", "feat_mod_whole"))
    most = lambda pairs: max(collections.Counter(a for a, _ in pairs).values())
    assert capped < whole == feats and most(capped) == 5 and 5 < most(whole) <= 200
    lists = {r[0]: r[1].split(",") for r in QUERIES["cand_list_whole"](spark, sf_dir).collect() if r[1]}
    short = {r[0]: r[1].split(",") for r in QUERIES["cand_list"](spark, sf_dir).collect() if r[1]}
    assert lists.keys() == short.keys() and max(map(len, lists.values())) > 5 and all(set(v) <= set(lists[k]) for k, v in short.items())
