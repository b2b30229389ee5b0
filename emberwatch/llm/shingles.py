"""Sets of word shingles as sorted 64-bit hashes, computed for whole batches of texts."""

from __future__ import annotations

import numpy as np

from emberwatch.llm.texts import ASCII_LOWER, NOT_SPACE, Substrings, mix, runs

WORDS = 5
_STEP = np.uint64(0xD1342543DE82EF95)
_SHORT = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles of ``width`` words, sorted, and the n + 1 bounds of the texts' sets.

    A text of fewer words has its whole sequence as one shingle; without a word, none.
    """
    raw = ASCII_LOWER[raw]
    starts, stops = runs(NOT_SPACE[raw], offsets)
    words = Substrings(raw).hash(starts, stops)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n_texts = len(offsets) - 1
    sizes = np.bincount(text, minlength=n_texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    one_text = text[: len(rolled)] == text[width - 1 :] if len(rolled) else np.zeros(0, bool)
    hashes, owner = mix(rolled[one_text]), text[: len(rolled)][one_text]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        first = np.cumsum(sizes) - sizes
        whole = []
        for t in short:
            with np.errstate(over="ignore"):
                h = np.uint64(sizes[t]) * _SHORT
                for w in words[first[t] : first[t] + sizes[t]]:
                    h = h * _STEP + w
            whole.append(h)
        hashes, owner = np.concatenate([hashes, mix(np.array(whole, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))]).astype(np.int64)


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set (0 for an empty one)."""
    out = []
    for values in (mix(hashes + _SHORT), mix(hashes ^ _STEP)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]
