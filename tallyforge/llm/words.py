"""Distinct words of a chunk of texts, as a compact byte buffer, for models that score each distinct word once."""

from __future__ import annotations

import numpy as np

from . import tokens as tk

#: Letters for the word models: a-z, A-Z and every byte of a multi-byte character.
NOT_LETTER = tk.separators([(0, 64), (91, 96), (123, 127)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of rows: doc offsets `at`, and `inverse` from words to distinct ones, whose bytes lie in buf[start:start+length]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
        starts, ends, self.at = tk.word_spans(buf, offsets, NOT_LETTER)
        hashes = tk.word_hashes(buf, starts, ends, lower=lower)
        self.hashes, first, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.length = (ends - starts)[first]
        self.start = np.cumsum(self.length) - self.length
        source = np.repeat(starts[first], self.length) + tk.ramp(self.length)
        self.buf = (_LOWER[buf[source]] if lower else buf[source]) if len(source) else np.zeros(0, np.uint8)

    def doc_sums(self, values: np.ndarray) -> np.ndarray:
        """Per row, the sum over its words of values (by distinct word; one column or several)."""
        every = values[self.inverse]
        sums = np.concatenate([np.zeros((1, *every.shape[1:])), np.cumsum(every, axis=0)])
        return sums[self.at[1:]] - sums[self.at[:-1]]
