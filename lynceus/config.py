"""Knobs of scoring. Similarity operators take them as a parameter; nothing is read from a global."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Similarity:
    """Jaro-Winkler knobs. The last five are accepted and reported but have no effect on scores."""

    prefix: int = 4
    length_penalty: float = 0.3
    length_cutoff: float = 0.9
    letter_penalty: float = 0.9
    phonetic_filter: bool = True
    boost_threshold: float = 0.7
    exact_favoritism: float = 0.0
    unmatched_weight: float = 0.15
    keep_stopwords: bool = False
    log_stopwords: bool = False


@dataclass(frozen=True)
class Weights:
    name: float = 35.0
    address: float = 25.0
    critical_id: float = 50.0
    supporting: float = 15.0
    min_match: float = 0.88
    exact: float = 0.99
    use_name: bool = True
    use_alt_names: bool = True
    use_address: bool = True
    use_gov_id: bool = True
    use_crypto: bool = True
    use_contact: bool = True
    use_date: bool = True


DEFAULT = Similarity()
#: All nought: no prefix boost, no length penalty, and a differing first letter scores nothing.
ZERO = Similarity(0, 0.0, 0.0, 0.0, True, 0.0, 0.0, 0.0)
WEIGHTS = Weights()
BATCH_MOST, BATCH_LEAST_MATCH, BATCH_LIMIT = 1000, 0.88, 10


class BadRequest(ValueError):
    """A request that an HTTP layer would answer with 400."""


def updated(config: Similarity | Weights, **changes) -> Similarity | Weights:
    """A changed copy. Thresholds must be in [0, 1], the prefix and weights not negative; unknown names are refused."""
    known = {f.name for f in fields(config)}
    for k, v in changes.items():
        if k not in known:
            raise BadRequest(f"no such parameter: {k}")
        if k in ("boost_threshold", "min_match", "exact") and not 0 <= v <= 1:
            raise BadRequest(f"{k} must be between 0 and 1")
        if k in ("prefix", "name", "address", "critical_id", "supporting") and v < 0:
            raise BadRequest(f"{k} must not be negative")
    return replace(config, **changes)
