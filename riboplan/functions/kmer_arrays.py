"""K-mer codes and window minima of many sequences at once, over numpy arrays.

Sequences lie in one byte array, each followed by a line feed, so that a k-mer that spans two of them has a
letter other than ACGT. The functions take Arrow batches' texts and give arrays; ``operators`` ships them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

#: Letters of one vectorized run (a longer sequence makes a run of its own).
RUN_LETTERS = 1_000_000
#: What stands for a k-mer without a code.
NO_CODE = np.iinfo(np.int64).max

_DIGIT = np.full(256, 9, np.uint8)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_FIFTH = np.full(256, 9, np.uint8)
_FIFTH[np.frombuffer(b"ACGTN", np.uint8)] = range(5)
_TURN = bytes.maketrans(b"ACGTNacgtn", b"TGCANtgcan")


class Run(NamedTuple):
    first: int  # row of its first sequence
    letters: np.ndarray
    starts: np.ndarray  # of each sequence among the letters
    sizes: np.ndarray


def turned(seq: bytes) -> bytes:
    """Reverse complement, as ``seq.revcomp``."""
    return seq.translate(_TURN)[::-1]


def runs(seqs: Sequence[bytes]) -> Iterator[Run]:
    part: list[bytes] = []
    held = first = 0
    for i, s in enumerate(seqs, 1):
        part.append(s)
        held += len(s) + 1
        if held >= RUN_LETTERS or i == len(seqs):
            sizes = np.array([len(x) for x in part], np.int64)
            yield Run(first, np.frombuffer(b"\n".join([*part, b""]), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
            part, held, first = [], 0, i


def _spoilt(digits: np.ndarray, k: int) -> np.ndarray:
    """Whether each k-mer has a letter without a digit."""
    seen = np.concatenate([[0], np.cumsum(digits > 8)])
    return seen[k:] != seen[:-k]


def codes(letters: np.ndarray, k: int) -> np.ndarray:
    """Canonical two-bit code of the k-mer at every place; NO_CODE where another letter than ACGT stands in it."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    digits = _DIGIT[letters]
    spoilt = _spoilt(digits, k)
    digits = (digits & 3).astype(np.int64)
    ahead, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        ahead <<= 2
        ahead |= digits[j : j + n]
        back |= (3 - digits[j : j + n]) << (2 * j)
    np.minimum(ahead, back, out=ahead)
    ahead[spoilt] = NO_CODE
    return ahead


def fifths(letters: np.ndarray, k: int) -> np.ndarray:
    """Code of the k-mer as it stands, over ACGTN (k up to 27); NO_CODE where another letter stands in it."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    digits = _FIFTH[letters]
    spoilt = _spoilt(digits, k)
    digits = digits.astype(np.int64)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out *= 5
        out += digits[j : j + n]
    out[spoilt] = NO_CODE
    return out


def last_least(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value of each window of w; the last one among equals."""
    at = np.arange(len(values))
    step = 1

    def joined(shift: int) -> None:
        nonlocal values, at
        later = values[shift:] <= values[:-shift]
        values = np.where(later, values[shift:], values[:-shift])
        at = np.where(later, at[shift:], at[:-shift])

    if len(values) < w:
        return at[:0]
    while 2 * step <= w:
        joined(step)
        step *= 2
    if w > step:
        joined(w - step)
    return at


def _first_of_each(at: np.ndarray) -> np.ndarray:
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    return new


def _within(owner: np.ndarray, n: int) -> np.ndarray:
    """Number of each place among those of its owner; owners ascend and are below ``n``."""
    counts = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def reference_minima(run: Run, k: int, w: int, led: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code, place of the distinct least k-mers of all windows of w places.

    Where ``led``, the first window belongs to what came before, and its least k-mer is left out.
    """
    code = codes(run.letters, k)
    best = last_least(code, w)
    owner = np.repeat(np.arange(len(run.sizes)), run.sizes + 1)[: len(best)]
    place = np.arange(len(best)) - run.starts[owner]
    inside = (place + k + w - 1 <= run.sizes[owner]) & (code[best] != NO_CODE)
    heads = run.starts[led & (run.sizes >= k + w - 1)]
    skipped = np.full(len(run.sizes), -1)
    skipped[owner[heads]] = best[heads]
    inside &= best != skipped[owner]
    best, owner = best[inside], owner[inside]
    new = _first_of_each(best)
    best, owner = best[new], owner[new]
    return owner, code[best], best - run.starts[owner]


def read_minima(run: Run, k: int, w: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, number within the row, code, place: windows run over the k-mers that have a code, every ``step``-th counts."""
    code = codes(run.letters, k)
    owner = np.repeat(np.arange(len(run.sizes)), run.sizes + 1)[: len(code)]
    at = np.flatnonzero((code != NO_CODE) & (run.sizes[owner] >= k + w - 1))
    code, owner = code[at], owner[at]
    best = last_least(code, w)
    turn = _within(owner, len(run.sizes))
    counts = (owner[: len(best)] == owner[w - 1 :]) & (turn[: len(best)] % step == 0) if len(best) else np.zeros(0, bool)
    best = best[counts]
    best = best[_first_of_each(best)]
    row = owner[best]
    return row, _within(row, len(run.sizes)), code[best], at[best] - run.starts[row]
