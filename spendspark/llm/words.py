"""Words of many texts at once, as 64-bit hashes computed over their UTF-8 bytes.

Numpy helpers that run inside tasks on one Arrow batch. A batch is worked off in blocks of
about BLOCK bytes cut between words, so memory follows the batch and the longest word, not
the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def byte_table(inside: str) -> np.ndarray:
    """True for the bytes of a word. inside: 'not_space' (all but space and 09-0D) or
    'letters_digits' (ASCII letters and digits, and every byte of a non-ASCII character)."""
    table = np.ones(256, bool)
    if inside == "not_space":
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[:128] = False
        for first, last in ((48, 57), (65, 90), (97, 122)):
            table[first:last + 1] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least n of each."""
    if len(_powers["up"]) < n:
        for key, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n+1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a text's end also ends its last word."""
    inside = table[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if len(data):
        inner = offsets[:-1][offsets[:-1] < len(data)]
        starts[inner] |= inside[inner]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] |= inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, A-Z lower-cased. Depends on the word's bytes alone."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        first, end = int(starts[i]), int(ends[j - 1])
        up, down = powers(end - first + 1)
        sums = np.zeros(end - first + 1, np.uint64)
        np.cumsum((LOWER[data[first:end]].astype(np.uint64) + np.uint64(1)) * up[:end - first], out=sums[1:])
        s = starts[i:j] - first
        out[i:j] = mix((sums[ends[i:j] - first] - sums[s]) * down[s])
        i = j
    return out


def batch_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of a batch; edges[k]:edges[k+1] are the
    words of text k; the bytes."""
    data, offsets = text_buffers(texts)
    starts, ends = find_words(data, offsets, table)
    return word_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data


def spelled_words(texts: pa.Array, table: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch as one array of strings, with A-Z lower-cased if asked;
    edges[k]:edges[k+1] are the words of text k."""
    data, offsets = text_buffers(texts)
    starts, ends = find_words(data, offsets, table)
    letters = data[table[data]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts),
                                  [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[letters] if lower else letters)])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, edges: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; a text of fewer words,
    but not none, has its whole sequence as its one shingle."""
    spread = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    whole = max(0, len(words) - n + 1)
    all_of_n = np.zeros(whole, np.uint64)
    for k in range(n):
        all_of_n += words[k:k + whole] * spread[k]
    all_of_n = mix(all_of_n)
    sets = []
    for first, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if end - first >= n:
            found = np.sort(all_of_n[first:end - n + 1])
            if len(found) > 1:
                found = found[np.append(True, found[1:] != found[:-1])]
        elif end > first:
            found = mix((words[first:end] * spread[:end - first]).sum(dtype=np.uint64, keepdims=True) + np.uint64(end - first))
        else:
            found = np.zeros(0, np.uint64)
        sets.append(found)
    return sets
