"""Paths, limits and model settings, in one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

#: Thresholds that a sweep tries. Fixed values.
THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.94, 0.96, 0.98)


@dataclass(frozen=True)
class TokenPass:
    """One token-overlap pass: matches needed, largest token frequency, shortest token, candidates kept for each record."""

    min_shared: int
    max_freq: int
    min_len: int
    cap: int


#: The defaults are the settings of the original run. Fixed values.
@dataclass(frozen=True)
class Params:
    seed: int = 42
    validation_share: float = 0.2
    sample_per_country: int = 30_000
    compact_min: int = 5
    tokens: TokenPass = TokenPass(2, 1000, 3, 150)
    rare_tokens: TokenPass = TokenPass(1, 500, 5, 30)
    candidate_cap: int = 200
    # the variant with provenance
    token_freq_cap: int = 1000
    min_shared: int = 1
    name_prefix_len: int = 5
    addr_number_len: int = 4
    variant_cap: int = 200
    # boosted trees
    trees: int = 400
    rate: float = 0.08
    depth: int = 7
    min_leaf: int = 50
    feature_share: float = 0.8
    thresholds: tuple[float, ...] = THRESHOLDS


DEFAULT = Params()
