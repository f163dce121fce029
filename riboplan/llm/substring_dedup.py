"""Substring dedup over words by recompression.

Names. A word's name is a 64-bit hash of its bytes. A round first names runs, then pairs: a run of two
equal tokens becomes one symbol; then of two neighbours x, y, with x on the left side and y on the right
(sides are drawn by a hash of the name and the round), the pair becomes one symbol. A new name is a hash
of the round and the two names, so all tasks give the same name to the same run or pair without a
dictionary; longer runs stay as they are, for sides never part two equal symbols.

What equal substrings share. Whether a border between two symbols survives a round depends only on the
symbols beside it. If symbols hold at most M words, a round blurs at most M words at either end of an
equal stretch. With lengths capped at 2, 2, 4 and 8 words, after the run round and three pair rounds all
borders from 10 words inside each end of a 50-word window are set by the window alone. A phrase is the
row of symbols from a border to the first border at least 6 words on; phrases that begin 10 to 27 words
into a window lie in that part, and at least one does. The anchor of a window is the least of them by
hash. Shared phrases reveal repeats; the windows around them are then verified, by the phrase's name
and a hash of their 50 names, 128 bits together.

Defined results: null text has no words; null ids are neither compared nor changed; rows of one id never
remove each other's words; repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, mix, word_names
from .repeats import LENGTH, Unit, kept_symbols, with_spans

CAPS = (2, 4, 8)
PHRASE = 6
_K1, _K2, _R = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _join(names: np.ndarray, sizes: np.ndarray, merge: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge each symbol marked in ``merge`` with the next one; (names, sizes, kept places)."""
    left = np.flatnonzero(merge)
    new = mix(names[left] * _K1 + names[left + 1] * _K2 + np.uint64(level))
    names, sizes = names.copy(), sizes.copy()
    names[left] = new
    sizes[left] += sizes[left + 1]
    keep = np.ones(len(names), bool)
    keep[left + 1] = False
    return names[keep], sizes[keep], keep


def recompress(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the word at which each begins; texts never mix."""
    sizes = np.ones(len(names), np.int64)
    same = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    alone = same.copy()
    alone[1:] &= ~same[:-1]
    alone[:-1] &= ~same[1:]
    names, sizes, keep = _join(names, sizes, alone, 1)
    owner = owner[keep]
    for level, cap in enumerate(CAPS, 2):
        side = mix(names + np.uint64(level) * _R) >> np.uint64(63)
        pair = (side[:-1] == 0) & (side[1:] == 1) & (sizes[:-1] + sizes[1:] <= cap) & (owner[1:] == owner[:-1])
        names, sizes, keep = _join(names, sizes, pair, level)
        owner = owner[keep]
    return names, np.cumsum(sizes) - sizes


class Words(Unit):
    lo, hi = 10, 27

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_names(texts)

    def keys(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, begins = recompress(symbols, owner)
        end = np.searchsorted(begins, begins + PHRASE)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(names), _R)]).astype(np.uint64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(names), pow(int(_R), -1, 1 << 64), np.uint64)]).astype(np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(names) * power[:-1])])
        phrase = mix((total[end] - total[:-1]) * back[:-1])
        return begins, phrase

    def material(self, symbols: np.ndarray) -> tuple[np.ndarray, int]:
        """The hash of the window at each place; windows that cross texts are never asked for."""
        return window_hash(mix(symbols), LENGTH, _K1), 1

    def classes(self, stretches: list[np.ndarray], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows are equal if their anchor's key and their own hash are, 128 bits together."""
        n = np.array([len(s) for s in stretches], np.int64)
        owner = np.repeat(np.arange(len(stretches)), n)
        key = np.searchsorted(groups, owner, side="right")
        h = np.concatenate(stretches)
        order = np.lexsort((h, key))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        classes = np.empty(len(order), np.int64)
        classes[order] = np.cumsum(new) - 1
        yield owner, classes


def window_hash(x: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``width`` symbols, from those of their powers of two."""
    out, size, part, step, factor = None, 0, x, 1, base
    while width:
        if width & 1:
            if out is None:
                out, size = part, step
            else:
                n = len(x) - size - step + 1
                out = out[:n] * factor + part[size : size + n]
                size += step
        width >>= 1
        if width:
            part = part[:-step] * factor + part[step:]
            factor, step = factor * factor, 2 * step
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8) of every row: words covered by repeated windows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for k, text in enumerate(b["_text"]):
                words = text.as_py().split()
                total.append(len(words))
                if b["spans"][k].is_valid:
                    words = [words[i] for i in np.flatnonzero(kept_symbols(b["spans"], k, len(words)))]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    out = with_spans(docs, Words()).select("doc_id", "_text", "spans")
    return map_batches(out, run, "doc_id long, n_words long, n_removed long, kept binary")
