"""Features of candidate pairs: column expressions over both records' prepared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import words

#: Columns of the features, in the order of the model. Fixed values.
NAMES = [
    "name_exact", "name_sorted_exact", "name_ratio", "name_tsort", "name_tset", "name_jaccard", "name_overlap", "name_lr", "compact_ratio",
    "name_full_ratio", "addr_exact", "addr_ratio", "addr_tsort", "addr_jaccard", "addr_overlap", "addr_lr", "addr_miss", "country_eq", "nx_addr",
    "is_s2", "n_blocks", "blk_E", "blk_S", "blk_C", "blk_T", "blk_L",
]
#: Those of the variant. Fixed values.
NAMES_VARIANT = [
    "name_exact", "name_sorted_exact", "name_ratio", "name_partial_ratio", "name_token_sort", "name_token_set", "name_jaccard", "name_overlap",
    "name_len_ratio", "name_full_ratio", "name_first_token", "compact_name_ratio", "addr_exact", "addr_ratio", "addr_token_sort", "addr_jaccard",
    "addr_overlap", "addr_len_ratio", "addr_num_jaccard", "addr_num_overlap", "addr_missing_any", "addr_missing_both", "country_match", "name_x_addr",
    "name_x_addr_jaccard", "is_s2", "n_blocking_methods", "has_exact_block", "has_sorted_block", "has_token_block", "has_prefix_block",
]
_USED = ["nn", "nnf", "sn", "cn", "na", "sa", "cl"]


def with_records(pairs: DataFrame, s1: DataFrame, s23: DataFrame, extra: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """Pairs with both records' columns under a_ and b_."""
    used = [*_USED, *extra]
    a = s1.select(F.col("entity_id").alias("entity_id_s1"), *(F.col(c).alias(f"a_{c}") for c in used))
    b = s23.select(F.col("entity_id").alias("entity_id_s2s3"), *(F.col(c).alias(f"b_{c}") for c in used))
    return pairs.join(a, "entity_id_s1", how).join(b, "entity_id_s2s3", how)


def _flag(c: Column) -> Column:
    return c.cast("double")


def _sides(c: str) -> tuple[Column, Column]:
    return F.col(f"a_{c}"), F.col(f"b_{c}")


def set_features() -> dict[str, Column]:
    """Those that need no common subsequence."""
    nn, na = _sides("nn"), _sides("na")
    name, addr = [words(c) for c in nn], [words(c) for c in na]
    block = lambda t: _flag(F.array_contains(F.split("block", ","), t))
    return {
        "name_exact": sim.both_equal(*nn),
        "name_sorted_exact": sim.both_equal(*_sides("sn")),
        "name_jaccard": sim.jaccard(*name),
        "name_overlap": sim.overlap(*name),
        "name_lr": sim.length_ratio(*nn),
        "addr_exact": sim.both_equal(*na),
        "addr_jaccard": sim.jaccard(*addr),
        "addr_overlap": sim.overlap(*addr),
        "addr_lr": sim.length_ratio(*na),
        "addr_miss": _flag((na[0] == "") | (na[1] == "")),
        "country_eq": sim.both_equal(*_sides("cl")),
        "is_s2": _flag(F.col("entity_id_s2s3").startswith("S2")),
        "n_blocks": _flag(F.col("n_blocks")),
        **{f"blk_{t}": block(t) for t in "ESCTL"},
    }


def _rounded(df: DataFrame, values: dict[str, Column], names: list[str], keys: list[str]) -> DataFrame:
    """A pair without both records has zeros."""
    known = F.col("a_nn").isNotNull() & F.col("b_nn").isNotNull()
    return df.select(*keys, *(F.when(known, values[c]).otherwise(0.0).alias(c) for c in names))


def pair_features(pairs: DataFrame, s1: DataFrame, s23: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 26 features of each pair (entity_id_s1, entity_id_s2s3, block, n_blocks), in the order of NAMES, as doubles."""
    df = with_records(pairs, s1, s23)
    df = df.withColumns({"__tsort": sim.ratio(*_sides("sn")), "__asort": sim.ratio(*_sides("sa"))})
    values = set_features() | {
        "name_ratio": sim.ratio(*_sides("nn")),
        "name_tsort": F.col("__tsort"),
        "name_tset": sim.token_set_ratio(*_sides("nn")),
        "compact_ratio": sim.ratio(*_sides("cn")),
        "name_full_ratio": sim.ratio(*_sides("nnf")),
        "addr_ratio": sim.ratio(*_sides("na")),
        "addr_tsort": F.col("__asort"),
        "nx_addr": F.col("__tsort") * F.col("__asort"),
    }
    return _rounded(df, values, NAMES, ["entity_id_s1", "entity_id_s2s3", *keep])


def pair_features_variant(pairs: DataFrame, s1: DataFrame, s23: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The variant's 31 features; ``methods`` may be empty, then the block features are 0. Pairs without both records are dropped."""
    sets = {"tokens": F.array_distinct("tokens"), "numbers": F.array_distinct("numbers"), "parts": F.array_distinct(words(F.col("na")))}  # once for each record, not each pair
    df = with_records(pairs, s1.withColumns(sets), s23.withColumns(sets), tuple(sets), "inner")
    nn, na, tokens, numbers, parts = (_sides(c) for c in ("nn", "na", "tokens", "numbers", "parts"))
    shared = {f"__{k}": F.size(F.array_intersect(*_sides(k))) for k in sets}
    df = df.withColumns({"__tsort": sim.ratio(*_sides("sn")), "__asort": sim.ratio(*_sides("sa")), **shared})
    df = df.withColumns({"__njac": sim.jaccard_of(F.col("__tokens"), *tokens), "__ajac": sim.jaccard_of(F.col("__parts"), *parts)})
    method = lambda m: _flag(F.array_contains(F.split("methods", ","), m))
    values = {
        "name_exact": sim.both_equal(*nn),
        "name_sorted_exact": sim.both_equal(*_sides("sn")),
        "name_ratio": sim.ratio(*nn),
        "name_partial_ratio": sim.partial_ratio(*nn),
        "name_token_sort": F.col("__tsort"),
        "name_token_set": sim.token_set_ratio_of(*tokens),
        "name_jaccard": F.col("__njac"),
        "name_overlap": sim.overlap_of(F.col("__tokens"), *tokens),
        "name_len_ratio": sim.length_ratio(*nn),
        "name_full_ratio": sim.ratio(*_sides("nnf")),
        "name_first_token": F.coalesce(_flag(F.array_min(tokens[0]) == F.array_min(tokens[1])), F.lit(0.0)),
        "compact_name_ratio": sim.ratio(*_sides("cn")),
        "addr_exact": sim.both_equal(*na),
        "addr_ratio": sim.ratio(*na),
        "addr_token_sort": F.col("__asort"),
        "addr_jaccard": F.col("__ajac"),
        "addr_overlap": sim.overlap_of(F.col("__parts"), *parts),
        "addr_len_ratio": sim.length_ratio(*na),
        "addr_num_jaccard": sim.jaccard_of(F.col("__numbers"), *numbers),
        "addr_num_overlap": sim.overlap_of(F.col("__numbers"), *numbers),
        "addr_missing_any": _flag((na[0] == "") | (na[1] == "")),
        "addr_missing_both": _flag((na[0] == "") & (na[1] == "")),
        "country_match": sim.both_equal(*_sides("cl")),
        "name_x_addr": F.col("__tsort") * F.col("__asort"),
        "name_x_addr_jaccard": F.col("__njac") * F.col("__ajac"),
        "is_s2": _flag(F.col("entity_id_s2s3").startswith("S2")),
        "n_blocking_methods": _flag(F.col("n_methods")),
        "has_exact_block": method("exact"),
        "has_sorted_block": method("sorted"),
        "has_token_block": method("token"),
        "has_prefix_block": method("prefix"),
    }
    return _rounded(df, values, NAMES_VARIANT, ["entity_id_s1", "entity_id_s2s3", *keep])
