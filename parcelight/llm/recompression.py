"""Kernels on batches of texts: words as numbers, recompression rounds, content-defined blocks of windows.

Recompression names maximal runs of a token, then, round by round, pairs of neighbours of which the first falls into the
left and the second into the right half of the alphabet. A name is a hash of what it stands for, so all tasks give equal
substrings equal names without asking each other. Runs longer than 3 words and pairs longer than a round's cap stay
apart. Whether two neighbours merge depends on them alone (on 3 words to either side for runs), so inside two
occurrences of one substring the symbols agree but for a margin of 3 (runs) + 3 + 4 (rounds 1 and 2) words at each end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RUN, CAPS = 3, (4, 7)
MARGIN = RUN + RUN + CAPS[0]
#: The shortest window that always holds a whole symbol between its margins.
SHORTEST = 2 * MARGIN + 2 * CAPS[-1] - 1

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A Mersenne prime. Sums modulo a power of two cancel for some regular sequences whatever the base; modulo a prime, two
#: sequences of n values agree for at most n bases.
PRIME = (1 << 61) - 1


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    low, half = _U((1 << 31) - 1), _U(31)
    middle = (a >> half) * (b & low) + (a & low) * (b >> half)
    high = ((a >> half) * (b >> half)) << _U(1)
    return modulo(modulo(high + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << half)) + modulo((a & low) * (b & low)))


class Powers:
    """Powers of a base and of its inverse modulo the prime, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = _U(base), _U(pow(base, -1, PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up, self.down = (np.concatenate([x, times(x, np.full(size, pow(int(b), size, PRIME), np.uint64))]) for x, b in ((self.up, self.base), (self.down, self.inverse)))
        return self.up[:n], self.down[:n]


_POWERS = tuple(Powers(b % PRIME) for b in _BASES)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, from prefix sums of a polynomial modulo the prime."""
    up, down = _POWERS[which].upto(len(values) + 1)
    terms = times(modulo(values), up[: len(values)])
    # Halves are summed apart, so that the sums of four billion values fit.
    high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms >> _U(31), terms & _U((1 << 31) - 1)))
    prefix = modulo(times(modulo(high), np.full(1, 1 << 31, np.uint64)) + modulo(low))
    between = modulo(prefix[end] + _U(PRIME) - prefix[start])
    return mix(times(between, down[start]) + ((end - start).astype(np.uint64) * _U(_BASES[1 - which])))


def word_hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run letters[start:end] (one after the other): sums of a mixed number for every letter and its place."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = end - start
    offset = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(offset, size)
    code = (place.astype(np.uint64) << _U(8)) + letters[place + np.repeat(start, size)].astype(np.uint64) + _U(1)
    return tuple(mix(np.add.reduceat(mix(code * _U(b) + _U(b >> 7)), offset) + size.astype(np.uint64)) for b in _BASES)


@dataclass(frozen=True)
class Words:
    """All words of a batch of texts: two independent hashes each, their text's number, and where each text's words begin."""

    one: np.ndarray
    two: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[buffer]
    change = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = change[::2], change[1::2]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    return Words(*word_hashes(buffer, start, end), text, first)


def recompress(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, number of words) of the symbols after all rounds."""
    name, text = words.one, words.text
    n = len(name)
    at = np.arange(n)
    if not n:
        return name, at, at
    begins = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    heads = np.flatnonzero(begins)
    size = np.diff(np.concatenate([heads, [n]]))
    long = size > RUN
    keep = begins | np.repeat(long, size)
    length = np.where(begins, np.repeat(np.where(long, 1, size), size), 1)
    name, at, length, text = name[keep], at[keep], length[keep], text[keep]
    name = np.where(length > 1, mix(name + _U(_BASES[0]) * length.astype(np.uint64)), name)
    for k, cap in enumerate(CAPS, 1):
        right = (mix(name + mix(np.full(1, k, np.uint64))) & _U(1)).astype(bool)
        joins = ~right[:-1] & right[1:] & (text[:-1] == text[1:]) & (length[:-1] + length[1:] <= cap)
        at_pair = np.flatnonzero(joins)
        name, length = name.copy(), length.copy()
        name[at_pair] = mix(name[at_pair] * _U(_BASES[0]) + mix(name[at_pair + 1] + _U(k)))
        length[at_pair] += length[at_pair + 1]
        keep = np.ones(len(name), bool)
        keep[at_pair + 1] = False
        name, at, length, text = name[keep], at[keep], length[keep], text[keep]
    return name, at, length


@dataclass(frozen=True)
class Blocks:
    """Runs of windows that choose one symbol: its name, a hash of all words of the windows, the number of the first
    window (counted from the start of the batch) and how many."""

    anchor: np.ndarray
    content: np.ndarray
    first: np.ndarray
    count: np.ndarray


def window_blocks(words: Words, window: int) -> Blocks:
    """Every window of the batch in a block. A window chooses, of the symbols that lie wholly between its margins, the
    longest, then the one of the largest hash, then the first; equal windows choose equally wherever they occur."""
    name, at, length = recompress(words)
    n, reach = len(words.one), window - 2 * MARGIN - CAPS[-1] + 1
    none = np.zeros(0, np.int64)
    last = words.first[words.text + 1] if n else none  # where the word's text ends
    valid = np.arange(n) + window <= last
    if not valid.any():
        return Blocks(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none)
    rank = np.zeros(n + window, np.uint64)
    rank[at] = length.astype(np.uint64) << _U(59) | (mix(name) >> _U(37)) << _U(32) | _U(0xFFFFFFFF) - at.astype(np.uint64)
    best, width = rank, 1
    while 2 * width <= reach:
        best = np.maximum(best[:-width], best[width:])
        width *= 2
    if reach > width:
        best = np.maximum(best[: len(best) - (reach - width)], best[reach - width :])
    first = np.flatnonzero(valid)
    chosen = (_U(0xFFFFFFFF) - (best[first + MARGIN] & _U(0xFFFFFFFF))).astype(np.int64)
    cut = np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(first) != 1)])
    head = np.flatnonzero(cut)
    count = np.diff(np.concatenate([head, [len(first)]]))
    start = first[head]
    symbol = np.zeros(n, np.uint64)
    symbol[at] = name
    return Blocks(symbol[chosen[head]], range_hashes(words.two, start, start + count + window - 1, 1), start, count)
