"""Words of whole chunks of texts, joined by one space."""

from __future__ import annotations

import numpy as np

from .common import is_word, spans

_WORD = is_word()


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk joined by one space each; their starts and ends there, and each row's first word."""
    inside = _WORD[data]
    starts, ends, first = spans(inside, offsets)
    ends_to = np.cumsum(ends - starts + 1) - 1
    out = np.full(int(ends_to[-1]) + 1 if len(ends_to) else 0, 0x20, np.uint8)
    letters = np.ones(len(out), bool)
    letters[ends_to] = False
    out[letters] = data[inside]
    return out.tobytes(), ends_to - (ends - starts), ends_to, first
