"""Candidate pairs by shared keys. Country is a part of every key, so all countries are one plan.

A record keeps the candidates with the smallest ids, at most ``cap``. Such a pair is among the ``cap`` smallest of each block
that has it, so the exact keys rank their targets by id before the join: a name that everyone has costs
rows * cap, not rows squared, and the result is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.params import DEFAULT, Params, TokenPass

PAIR = ["country", "entity_id_s1", "entity_id_s2s3"]


def _left(df: DataFrame, key: Column) -> DataFrame:
    return df.select("country", key.alias("key"), F.col("entity_id").alias("entity_id_s1")).filter("key <> ''")


def _right(df: DataFrame, key: Column, cap: int | None) -> DataFrame:
    out = df.select("country", key.alias("key"), F.col("entity_id").alias("entity_id_s2s3")).filter("key <> ''")
    if cap is None:
        return out
    rank = F.row_number().over(Window.partitionBy("country", "key").orderBy("entity_id_s2s3"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def key_block(s1: DataFrame, s23: DataFrame, key: Column, tag: str, cap: int | None = None) -> DataFrame:
    """Pairs with an equal key that isn't empty."""
    pairs = _left(s1, key).join(_right(s23, key, cap), ["country", "key"])
    return pairs.select(*PAIR, F.lit(tag).alias("block"))


def block_exact(s1: DataFrame, s23: DataFrame, cap: int | None = None) -> DataFrame:
    return key_block(s1, s23, F.col("nn"), "E", cap)


def block_sorted(s1: DataFrame, s23: DataFrame, cap: int | None = None) -> DataFrame:
    return key_block(s1, s23, F.col("sn"), "S", cap)


def block_compact(s1: DataFrame, s23: DataFrame, cap: int | None = None, least: int = 5) -> DataFrame:
    return key_block(s1, s23, F.when(F.length("cn") >= least, F.col("cn")).otherwise(""), "C", cap)


def token_rows(df: DataFrame, least: int) -> DataFrame:
    """(country, tok, entity_id, m): every token of at least ``least`` characters, with how often the name has it."""
    rows = df.select("country", "entity_id", F.explode(words(F.col("nn"))).alias("tok")).filter(F.length("tok") >= least)
    return rows.groupBy("country", "tok", "entity_id").agg(F.count("*").alias("m"))


def token_freq(s23: DataFrame, least: int = 3) -> DataFrame:
    """Occurrences of each token in a country's targets."""
    return token_rows(s23, least).groupBy("country", "tok").agg(F.sum("m").alias("freq"))


def block_tokens(s1: DataFrame, s23: DataFrame, limits: TokenPass, tag: str) -> DataFrame:
    """Pairs by shared tokens that aren't too frequent; a token counts as often as both names have it.

    Records with fewer such tokens than ``min_shared`` are left out, and of each the ``cap`` candidates with most matches stay,
    smaller ids first among equals.
    """
    right = token_rows(s23, limits.min_len)
    kept = right.groupBy("country", "tok").agg(F.sum("m").alias("freq")).filter(F.col("freq") <= limits.max_freq).select("country", "tok")
    right = right.join(kept, ["country", "tok"]).select("country", "tok", F.col("entity_id").alias("entity_id_s2s3"), F.col("m").alias("m2"))
    left = token_rows(s1, limits.min_len).join(kept, ["country", "tok"])
    able = F.sum("m").over(Window.partitionBy("country", "entity_id"))
    left = left.withColumn("able", able).filter(F.col("able") >= limits.min_shared).select("country", "tok", F.col("entity_id").alias("entity_id_s1"), F.col("m").alias("m1"))
    counts = left.join(right, ["country", "tok"]).groupBy(*PAIR).agg(F.sum(F.col("m1") * F.col("m2")).alias("n"))
    order = Window.partitionBy("country", "entity_id_s1").orderBy(F.desc("n"), "entity_id_s2s3")
    top = counts.filter(F.col("n") >= limits.min_shared).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limits.cap)
    return top.select(*PAIR, F.lit(tag).alias("block"), "n")


def union_blocks(blocks: list[DataFrame]) -> DataFrame:
    """Each pair once, with its blocks' letters in order and their number."""
    rows = reduce(DataFrame.unionByName, [b.select(*PAIR, "block") for b in blocks])
    return rows.groupBy(*PAIR).agg(F.array_sort(F.collect_set("block")).alias("blocks")).select(*PAIR, F.concat_ws(",", "blocks").alias("block"), F.size("blocks").cast("bigint").alias("n_blocks"))


def cap_candidates(pairs: DataFrame, cap: int, by: str | None = None) -> DataFrame:
    """Of each record the ``cap`` candidates with the smallest ids; with ``by``, those with the largest value of it."""
    order = ([F.desc(by)] if by else []) + [F.col("entity_id_s2s3")]
    rank = F.row_number().over(Window.partitionBy("entity_id_s1").orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def candidates(s1: DataFrame, s23: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(country, entity_id_s1, entity_id_s2s3, block, n_blocks) from all five keys, capped."""
    cap = params.candidate_cap
    blocks = [
        block_exact(s1, s23, cap),
        block_sorted(s1, s23, cap),
        block_compact(s1, s23, cap, params.compact_min),
        block_tokens(s1, s23, params.tokens, "T"),
        block_tokens(s1, s23, params.rare_tokens, "L"),
    ]
    return cap_candidates(union_blocks(blocks), cap)


# The variant with provenance: sets of tokens, prefixes and address numbers; every pair knows the methods that found it.


def block_prefix(s1: DataFrame, s23: DataFrame, length: int = 5, cap: int | None = None) -> DataFrame:
    """Pairs whose compact names begin alike."""
    return key_block(s1, s23, F.when(F.length("cn") >= length, F.substring("cn", 1, length)).otherwise(""), "prefix", cap)


def block_addr_numbers(s1: DataFrame, s23: DataFrame, least: int = 4, cap: int | None = None) -> DataFrame:
    """Pairs that share a run of digits in their addresses.

    Without a cap each pair comes from the smallest run that it shares, so no pairs have to be made distinct.
    """

    def runs(df: DataFrame) -> DataFrame:
        return df.select("country", "entity_id", F.explode("numbers").alias("run")).filter(F.length("run") >= least)

    if cap is not None:
        return key_block(runs(s1), runs(s23), F.col("run"), "addr_number", cap).distinct()

    def ordered(df: DataFrame, name: str, before: str) -> DataFrame:
        rows = runs(df).groupBy("country", "entity_id").agg(F.array_sort(F.collect_set("run")).alias("all"))
        return rows.select("country", F.col("entity_id").alias(name), "all", F.posexplode("all").alias("pos", "run")).select("country", name, "run", F.slice("all", F.lit(1), F.col("pos")).alias(before))

    pairs = ordered(s1, "entity_id_s1", "before1").join(ordered(s23, "entity_id_s2s3", "before2"), ["country", "run"])
    first = (F.size("before1") == 0) | (F.size("before2") == 0) | ~F.arrays_overlap("before1", "before2")
    return pairs.filter(first).select(*PAIR, F.lit("addr_number").alias("block"))


def useful_tokens(s23: DataFrame, freq_cap: int) -> DataFrame:
    """(country, tok) of the targets' tokens that fewer than freq_cap of them have."""
    return s23.select("country", F.explode("tokens").alias("tok")).groupBy("country", "tok").count().filter(F.col("count") < freq_cap).select("country", "tok")


def block_token_sets(s1: DataFrame, s23: DataFrame, freq_cap: int = 1000, min_shared: int = 1, kept: DataFrame | None = None) -> DataFrame:
    """Pairs by distinct shared tokens: at least min_shared, and two where the record has two that are useful (kept: of which targets' tokens)."""
    right = s23.select("country", F.explode("tokens").alias("tok"), F.col("entity_id").alias("entity_id_s2s3"))
    kept = useful_tokens(s23, freq_cap) if kept is None else kept
    left = s1.select("country", F.explode("tokens").alias("tok"), F.col("entity_id").alias("entity_id_s1")).filter(F.length("tok") > 1).join(kept, ["country", "tok"])
    useful = F.count("*").over(Window.partitionBy("country", "entity_id_s1"))
    left = left.withColumn("need", F.greatest(F.lit(min_shared), F.least(F.lit(2), useful)))
    counts = left.join(right.join(kept, ["country", "tok"]), ["country", "tok"]).groupBy(*PAIR).agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return counts.filter("n >= need").select(*PAIR, F.lit("token").alias("block"), "n")


def _every_pair(s1: DataFrame, s23: DataFrame, kept: DataFrame, params: Params) -> DataFrame:
    """The variant's pairs by all five keys, without a cap."""
    blocks = [
        key_block(s1, s23, F.col("nn"), "exact"),
        key_block(s1, s23, F.col("sn"), "sorted"),
        block_prefix(s1, s23, params.name_prefix_len),
        block_token_sets(s1, s23, params.token_freq_cap, params.min_shared, kept),
        block_addr_numbers(s1, s23, params.addr_number_len),
    ]
    return union_blocks(blocks).filter("entity_id_s1 <> entity_id_s2s3").withColumnsRenamed({"block": "methods", "n_blocks": "n_methods"})


#: The variant's methods in the order of their names; a pair's set of them is a number with a bit for each.
_METHODS = ["addr_number", "exact", "prefix", "sorted", "token"]
_ADDR, _EXACT, _PREFIX, _SORTED, _TOKEN = (1 << i for i in range(5))
_ALIKE = ["country", "nn", "sn", "prefix", "tokens", "runs"]


def _first_pairs(s1: DataFrame, s23: DataFrame, kept: DataFrame, params: Params) -> DataFrame:
    """The variant's pairs, of each record the variant_cap first; an id must stand once in both tables together.

    Methods depend on name and long numbers alone. So records of s1 that agree in them are one, and a pair among the first has
    one of the smallest ids in a group of targets that all share with the record what the pair shares; groups are ranked before
    they are joined, and a name that everyone has costs rows * cap.
    """
    cap, length = params.variant_cap, params.name_prefix_len
    prefix = F.when(F.length("cn") >= length, F.substring("cn", 1, length)).otherwise("")
    runs = F.array_sort(F.filter("numbers", lambda x: F.length(x) >= params.addr_number_len))
    plain = lambda df: df.filter("country is not null and entity_id is not null").select("entity_id", "country", "nn", "sn", prefix.alias("prefix"), "tokens", runs.alias("runs"))
    records = plain(s1)
    left = records.groupBy(*_ALIKE).agg(F.min("entity_id").alias("one"))
    right = plain(s23).select("country", *(F.col(c).alias(f"{c}2") for c in ("nn", "sn", "prefix", "runs")), F.col("entity_id").alias("entity_id_s2s3"))

    def ranked(rows: DataFrame, *key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("country", *key).orderBy("entity_id_s2s3"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")

    same = lambda c, bit: F.when((F.col(c) == F.col(f"{c}2")) & (F.col(c) != ""), bit).otherwise(0)
    shared = same("nn", _EXACT) + same("prefix", _PREFIX) + same("sn", _SORTED) + F.when(F.arrays_overlap("runs", "runs2"), _ADDR).otherwise(0)

    def found(a: DataFrame, b: DataFrame, on: list[str], more: int = 0) -> DataFrame:
        """Pairs of a and b that agree in the columns ``on`` of a, which are ``on`` and a 2 in b."""
        keys = [c if c in ("country", "run") else f"{c}2" for c in on]
        b = b.select(*(F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in b.columns))
        both = a.join(b, [a[c] == b[f"__{k}"] for c, k in zip(on, keys, strict=True)])
        for k in keys:
            both = both.withColumnRenamed(f"__{k}", k) if k not in on else both.drop(f"__{k}")
        return both.select("one", "entity_id_s2s3", (shared + more).alias("bits"))

    named, begun = right.filter("nn2 <> ''"), right.filter("prefix2 <> ''")
    out = [
        found(left, ranked(named, "nn2"), ["country", "nn"]),
        found(left, ranked(named, "sn2", "prefix2"), ["country", "sn"]),
        found(left, ranked(begun, "prefix2"), ["country", "prefix"]),
    ]
    # by numbers: pairs that share nothing else, and those that share a prefix, sorted tokens or the name
    numbered, lines = left.withColumn("run", F.explode("runs")), right.withColumn("run", F.explode("runs2"))
    for on, key in (([], []), (["prefix"], ["prefix2"]), (["sn"], ["sn2", "prefix2"]), (["nn"], ["nn2"])):
        rows = lines.filter(f"{key[0]} <> ''") if key else lines
        out.append(found(numbered, ranked(rows, "run", *key), ["country", "run", *on]))
    # by tokens: names first, then of each name and numbers the smallest ids
    use = left.select("country", "nn", F.explode("tokens").alias("tok")).distinct().filter(F.length("tok") > 1).join(kept, ["country", "tok"])
    useful = F.count("*").over(Window.partitionBy("country", "nn"))
    use = use.withColumn("need", F.greatest(F.lit(params.min_shared), F.least(F.lit(2), useful)))
    have = s23.select("country", F.col("nn").alias("nn2"), F.explode("tokens").alias("tok")).distinct().join(kept, ["country", "tok"])
    names = use.join(have, ["country", "tok"]).groupBy("country", "nn", "nn2").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("country", "nn", "nn2")
    pairs = names.join(left, ["country", "nn"]).withColumnRenamed("nn2", "nn3")
    ids = ranked(named, "nn2", "runs2")
    out.append(pairs.join(ids.withColumnRenamed("country", "country2"), (F.col("country") == F.col("country2")) & (F.col("nn3") == F.col("nn2"))).select("one", "entity_id_s2s3", (shared + _TOKEN).alias("bits")))

    rows = reduce(DataFrame.unionByName, out).groupBy("one", "entity_id_s2s3").agg(F.bit_or("bits").alias("bits"))
    order = Window.partitionBy("one").orderBy(F.desc(F.bit_count("bits")), "entity_id_s2s3")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    members = records.join(left, _ALIKE).select("country", F.col("entity_id").alias("entity_id_s1"), "one")
    methods = F.concat_ws(",", *(F.when(F.col("bits").bitwiseAND(1 << i) != 0, m) for i, m in enumerate(_METHODS)))
    return members.join(top, "one").select(*PAIR, methods.alias("methods"), F.bit_count("bits").cast("bigint").alias("n_methods"))


def candidates_variant(s1: DataFrame, s23: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(country, entity_id_s1, entity_id_s2s3, methods, n_methods): of each record those that most methods found, at most variant_cap.

    Ids that stand several times, in one table or both, take part with all their pairs.
    """
    kept = useful_tokens(s23, params.token_freq_cap)
    again = s1.select("entity_id").unionAll(s23.select("entity_id")).groupBy("entity_id").count().filter("count > 1").select("entity_id")
    if again.isEmpty():
        return _first_pairs(s1, s23, kept, params)
    left, right = (df.join(again, "entity_id", "left_anti") for df in (s1, s23))
    pairs = [_first_pairs(left, right, kept, params), _every_pair(s1.join(again, "entity_id", "left_semi"), s23, kept, params), _every_pair(left, s23.join(again, "entity_id", "left_semi"), kept, params)]
    return cap_candidates(reduce(DataFrame.unionByName, pairs), params.variant_cap, "n_methods")
