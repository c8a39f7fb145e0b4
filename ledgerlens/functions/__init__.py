"""Column functions used across operators."""

from ..operators.benchmarks import count_true, ratio
from ..operators.payments import growth, share
from ..operators.scoring import col_or
from ..operators.texts import cosine, is_refusal, stable_id, words

__all__ = ["col_or", "cosine", "count_true", "growth", "is_refusal", "ratio", "share", "stable_id", "words"]
