"""Substring dedup over bytes by a column-wise multi-document suffix order.

Stretches of text that share an anchor (see ``repeats``; here the least 16-gram by hash among those of a
50-byte window) form a collection. Its Burrows-Wheeler transform is built column by column: each round
inserts, for every string at once, the suffix that is one symbol longer, at the place which the symbols
so far imply, and updates the common prefixes with both neighbours from range minima. After as many
rounds as the longest string has symbols, neighbours with a common prefix of 50 bytes hold equal windows.

The columns are read and written front to back, chunk by chunk. A collection within MEMORY symbols keeps
them in memory; a larger one keeps them in files of a scratch folder of the task, removed with it.

Defined results: null text is empty; matches never cross texts, nor stretches; null ids are neither
compared nor changed; rows of one id never remove each other's bytes; repeated rows give repeated
results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, mix
from .repeats import LENGTH, Unit, kept_symbols, with_spans
from .substring_dedup import window_hash

GRAM = 16
#: Strings that are ordered together (keys are never parted), and symbols beyond which columns go to files.
BLOCK = 4_000
MEMORY = 16_000_000
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Columns:
    """Two columns in suffix order: the symbol before each suffix (0: none), and its prefix, length and string.

    The second packs the common prefix with the suffix above (8 bits), the length (8) and the string. A new
    generation is written from the old one, front to back.
    """

    def __init__(self, strings: int, folder: str | None) -> None:
        self.kind = np.uint32 if strings < 1 << 16 else np.uint64
        self.folder, self.turn = folder, 0

    def packed(self, prefix: np.ndarray, size: int, string: np.ndarray) -> np.ndarray:
        return (prefix | size << 8 | string << 16).astype(self.kind)

    def fresh(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.folder is None:
            return np.empty(n, np.uint8), np.empty(n, self.kind)
        self.turn ^= 1
        at = lambda name: os.path.join(self.folder, f"{name}-{self.turn}")
        return np.memmap(at("symbols"), np.uint8, "w+", shape=(n,)), np.memmap(at("rest"), self.kind, "w+", shape=(n,))

    def insert(self, places: np.ndarray, symbols: np.ndarray, rest: np.ndarray) -> None:
        """Put new rows at ``places`` (ascending, counted in the result)."""
        n = len(self.symbols) + len(places)
        out = self.fresh(n)
        for a in range(0, n, CHUNK):
            b = min(a + CHUNK, n)
            i, j = np.searchsorted(places, (a, b))
            old = np.ones(b - a, bool)
            old[places[i:j] - a] = False
            for to, held, new in zip(out, (self.symbols, self.rest), (symbols, rest), strict=True):
                part = to[a:b]
                part[old] = held[a - i : b - j]
                part[places[i:j] - a] = new[i:j]
        self.symbols, self.rest = out


def _minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo + 1 .. hi]) for many ranges, by minima of powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo).astype(np.float32))[1] - 1
    by = np.argsort(level.astype(np.uint8), kind="stable")
    cuts = np.cumsum(np.bincount(level, minlength=1))
    table, step, done = x, 1, 0
    for upto in cuts.tolist():
        if upto > done:
            at = by[done:upto]
            out[at] = np.minimum(table[lo[at] + 1], table[hi[at] + 1 - step])
            done = upto
        if done == len(by):
            break
        table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


def suffix_order(strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, common prefix with the one above, at most LENGTH) of all suffixes in order."""
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    if sizes.max(initial=0) > 255:
        raise ValueError("strings of at most 255 bytes, as one anchor's windows are")
    raw = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    if len(used) == 256:
        raise ValueError("UTF-8 has no use of all 256 bytes")
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    text = np.concatenate([code[raw], np.zeros(1, np.uint8)])
    ends = np.cumsum(sizes)
    columns = Columns(m, folder)
    ids = np.arange(m)
    columns.symbols = np.where(sizes > 0, text[np.maximum(ends - 1, 0)], 0).astype(np.uint8)
    columns.rest = columns.packed(np.zeros(m, np.int64), 0, ids)
    place = ids.copy()  # of each live string's longest suffix
    for size in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[ids] >= size
        ids, place = ids[live], place[live]
        symbol = np.asarray(columns.symbols)
        prefix = np.asarray(columns.rest).astype(np.uint8)  # the low eight bits
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")  # places by the symbol before, which is the order of the extensions
        first = int(np.searchsorted(symbol, 1, sorter=order))
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        loc = rank[place].astype(np.int64)
        by = np.argsort(loc)
        ids, place, loc = ids[by], place[by], loc[by]
        new_place = m + loc - first
        # A new suffix's neighbours with the same first symbol extend its neighbours in the order of extensions.
        own = symbol[place]
        up, down = np.maximum(loc - 1, 0), np.minimum(loc + 1, n - 1)
        above, below = order[up], order[down]
        has_up, has_down = (loc > first) & (symbol[above] == own), (loc + 1 < n) & (symbol[below] == own)
        least = _minima(prefix, np.concatenate([above[has_up], place[has_down]]), np.concatenate([place[has_up], below[has_down]]))
        least = np.minimum(least.astype(np.int64) + 1, LENGTH)
        value, under_value = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        value[has_up], under_value[has_down] = least[: has_up.sum()], least[has_up.sum() :]
        before = np.where(sizes[ids] > size, text[ends[ids] - size - 1], 0).astype(np.uint8)
        columns.insert(new_place, before, columns.packed(value, size, ids))
        # the suffix under a new one has a new upper neighbour; if it is new itself, its value is right already
        under = new_place + 1
        old = under < len(columns.rest)
        old[:-1] &= under[:-1] != new_place[1:]
        u = under[old]
        columns.rest[u] = (columns.rest[u] & ~columns.kind(255)) | under_value[old].astype(columns.kind)
        place = new_place
    rest = np.asarray(columns.rest).astype(np.int64)
    return rest >> 16, (rest >> 8) & 255, rest & 255


class Bytes(Unit):
    lo, hi = 0, LENGTH - GRAM

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)

    def keys(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[slice, np.ndarray]:
        key = mix(window_hash(symbols.astype(np.uint64) + np.uint64(1), GRAM, _BASE))
        return slice(0, len(key)), key

    def material(self, symbols: np.ndarray) -> tuple[np.ndarray, int]:
        return symbols, LENGTH

    def classes(self, stretches: list[np.ndarray], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo = 0
        while lo < len(groups) - 1:
            hi = max(lo + 1, int(np.searchsorted(groups, groups[lo] + BLOCK, side="right")) - 1)
            part = [x.tobytes() for x in stretches[groups[lo] : groups[hi]]]
            owner, classes = self._ordered(part)
            yield owner + groups[lo], classes
            lo = hi

    def _ordered(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if sum(map(len, part)) > MEMORY:
            with tempfile.TemporaryDirectory() as folder:
                string, size, prefix = suffix_order(part, folder)
        else:
            string, size, prefix = suffix_order(part)
        label = np.cumsum(prefix < LENGTH)
        whole = size >= LENGTH
        string, size, label = string[whole], size[whole], label[whole]
        order = np.lexsort((-size, string))  # the longest suffix is the first window
        return string[order], label[order] - label.min(initial=0)


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row: bytes covered by repeated windows are gone.

    The ``keep`` columns are passed through. ``as_text`` gives ``kept`` as a string, without the characters
    that a cut has broken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone, spans = [], [], [], []
            for k, text in enumerate(b["_text"]):
                raw = text.as_py()
                total.append(len(raw))
                spans.append(0)
                if b["spans"][k].is_valid:
                    stay = kept_symbols(b["spans"], k, len(raw))
                    spans[-1] = int((~stay & np.concatenate([[True], stay[:-1]])).sum())
                    raw = np.frombuffer(raw, np.uint8)[stay].tobytes()
                gone.append(total[-1] - len(raw))
                kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
            numbers = [pa.array(x, pa.int64()) for x in (total, gone, spans)]
            names = ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[c] for c in keep), *numbers, pa.array(kept, pa.string() if as_text else pa.binary())], names)

    passed = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    out = with_spans(docs, Bytes(), keep).select("doc_id", "_text", "spans", *keep)
    return map_batches(out, run, f"doc_id long, {passed}n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
