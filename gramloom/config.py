"""Settings of models and of the builder. `dataclasses.replace` makes a changed copy."""

from __future__ import annotations

import dataclasses

from gramloom.errors import ConfigError

#: Fixed values of the model format: the special words with their ids, and the highest order.
UNK, BOS, EOS = "<unk>", "<s>", "</s>"
SPECIALS = {UNK: 0, BOS: 1, EOS: 2}
MAX_ORDER = 6

SEMANTICS = ("reference", "corrected")
POSITIVE_POLICIES = ("throw", "complain", "silent")
VARIANTS = ("probing", "rest_probing", "trie", "quant_trie", "array_trie", "quant_array_trie")


@dataclasses.dataclass(frozen=True)
class ModelConfig:
    """How a model is loaded and read.

    semantics "reference" keeps the observable answers of the public build and score path (an unknown word without
    <unk> row scores 0, a blank scores 0); "corrected" gives unknown words `unknown_missing_logprob` and blanks the
    lower-order probability plus backoff. Settings of memory maps, hash sizes and temporary folders have no counterpart
    on a cluster, where Spark's own configuration holds.
    """

    semantics: str = "reference"
    unknown_missing_logprob: float = -100.0
    sentence_marker_missing: str = "complain"
    positive_log_probability: str = "complain"
    variant: str = "probing"
    prob_bits: int = 8
    backoff_bits: int = 8
    probing_multiplier: float = 1.5
    include_vocab: bool = True
    strict_words: bool = False

    def __post_init__(self):
        for value, allowed, name in ((self.semantics, SEMANTICS, "semantics"), (self.positive_log_probability, POSITIVE_POLICIES, "positive_log_probability"), (self.sentence_marker_missing, POSITIVE_POLICIES, "sentence_marker_missing"), (self.variant, VARIANTS, "variant")):
            if value not in allowed:
                raise ConfigError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
        for name in ("prob_bits", "backoff_bits"):
            if not 1 <= getattr(self, name) <= 25:
                raise ConfigError(f"{name} must be 1 to 25")

    @property
    def quantised(self) -> bool:
        return self.variant.startswith("quant")


@dataclasses.dataclass(frozen=True)
class BuildConfig:
    """How a model is built. discounts: by order, (D1, D2, D3+); None: the fixed discount at every order."""

    order: int = 3
    semantics: str = "reference"
    discount: float = 0.75
    discounts: tuple[tuple[float, float, float], ...] | None = None
    prune_thresholds: tuple[int, ...] = ()

    def __post_init__(self):
        check_order(self.order)
        if self.semantics not in SEMANTICS:
            raise ConfigError(f"semantics must be one of {', '.join(SEMANTICS)}")
        if any(b < a for a, b in zip(self.prune_thresholds, self.prune_thresholds[1:], strict=False)):
            raise ConfigError("pruning thresholds must not fall with the order")


def check_order(order: int) -> int:
    if not 1 <= order <= MAX_ORDER:
        raise ConfigError(f"the order must be 1 to {MAX_ORDER}, not {order}")
    return order


def parse_prune_thresholds(text: str, order: int) -> list[int]:
    """White-space separated whole numbers, padded with 0 or cut to the order; what isn't a number is skipped."""
    found = [int(t) for t in text.split() if t.isdigit()]
    return (found + [0] * order)[:order]


def parse_discounts(text: str) -> list[float]:
    """Comma-separated discounts of the counts 0, 1, 2 and 3 or more; the i-th is held within 0 and i + 1."""
    found: list[float] = []
    for part in text.split(","):
        try:
            found.append(float(part))
        except ValueError:
            continue
    held = [min(max(x, 0.0), i + 1.0) for i, x in enumerate(found[:4])]
    return held + [0.0] * (4 - len(held))
