"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Tokens: a tokenizer that lowers case and drops white space, as its JSON file tells, gives a text the ids of its chunks
between ASCII white space in order; chunks are tokenized once and looked up after that. With any other
file whole texts are tokenized. An end id follows each document. Documents longer than a sequence are cut into full pieces and a remainder.

Packing, over all documents at once: a sequence is filled greedily with the longest piece that fits. If a
gap remains, its smallest piece is replaced by the two unpacked pieces that fit the expanded gap most
tightly, if they fill it further. Only the number of pieces of each length matters for that, so the driver
packs a table of at most ``capacity`` counts, a repeated filling in one step. A piece then finds its
sequence from its length and its number among the pieces of that length: the counts of each length in each
partition are summed up, and no piece is moved.

Defined results: a null text is empty and yields the end id alone; null ids pass through; repeated rows
are packed as often as they occur; a text's special strings count as the tokenizer counts them;
sequences are numbered from 0 without gaps, and pieces are numbered in a durable table, once.
"""

from __future__ import annotations

import json
import os
import string
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_batches, small_side

CAPACITY = 2048
END_ID = 0


#: The byte-level alphabet: each byte as the character that the vocabulary spells it with.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: ASCII marks but the apostrophe, which may begin a piece of its own.
_MARKS = string.punctuation.replace("'", "")

# The normalizer and the splitter (of a tokenizer file) that chunks are right for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Chunks(dict):
    """Chunk (UTF-8) -> its ids as little-endian 32-bit bytes, for files with NORMALIZER and SPLITTER.

    Plain chunks, which are Latin letters with marks before and behind them, are what the normalizer and
    splitter leave as one word and a run of marks on each side; those go straight to the model, which spares the
    bookkeeping of offsets. All others take the whole tokenizer. The tokenizer lowers case, so chunks are
    looked up in lower case, but not where a text may spell a special string.

    When GENERATION_BYTES are held, they become the old generation and the one before is dropped; chunks
    that are met again are taken over from the old one, so what is frequent stays.
    """

    GENERATION_BYTES = 36_000_000
    #: A key, a value and their place in the dictionary, besides their own bytes.
    ENTRY_BYTES = 170

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _model_ids(self, piece: str) -> list[int]:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(spelled)]

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        front = text.lstrip(_MARKS)
        word = front.rstrip(_MARKS)
        plain = "<|" not in text and word.isalpha() and (word.isascii() or (max(word) < "\u0250" and unicodedata.is_normalized("NFC", word) and word.lower().isalpha()))
        if plain:
            ids = self._model_ids(word.lower())
            if len(front) < len(text):
                ids = self._model_ids(text[: len(text) - len(front)]) + ids
            if len(word) < len(front):
                ids += self._model_ids(front[len(word) :])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
        self[chunk] = ids
        self.held += len(chunk) + len(ids) + self.ENTRY_BYTES
        return ids

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        for t in texts:
            if self.held > self.GENERATION_BYTES:
                self.old = self.copy()
                self.clear()
                self.held = 0
            yield b"".join(map(self.__getitem__, (t if b"<|" in t else t.lower()).split()))


class Whole:
    """The ids of whole texts, for a file of another kind."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for t in texts:
            ids = self.tokenizer.encode(t.decode(), add_special_tokens=False).ids
            yield struct.pack(f"<{len(ids)}I", *ids)


def worker_chunks(tokenizer_json: str) -> Chunks | Whole:
    """The chunks that this Python worker knows already: Spark runs many tasks in one worker process."""
    state = sys.modules.setdefault("riboplan_worker_state", ModuleType("riboplan_worker_state")).__dict__
    name = f"chunks {zlib.crc32(tokenizer_json.encode())}"
    if name not in state:
        from tokenizers import Tokenizer

        file = json.loads(tokenizer_json)
        by_chunks = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == SPLITTER and file["model"]["type"] == "BPE"
        state[name] = (Chunks if by_chunks else Whole)(Tokenizer.from_str(tokenizer_json))
    return state[name]


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences), by best-two-fit."""
    left = {n: c for n, c in counts.items() if c > 0}
    mask = sum(1 << n for n in left)  # bit n: an unpacked piece of length n exists
    out = []

    def use(n: int, times: int) -> None:
        nonlocal mask
        left[n] -= times
        if not left[n]:
            mask &= ~(1 << n)

    def longest(most: int) -> int:
        return (mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    while mask:
        bin_, gap = {}, capacity
        while (n := longest(gap)) > 0:
            use(n, 1)
            bin_[n] = bin_.get(n, 0) + 1
            gap -= n
        touched, small, pair = dict(bin_), min(bin_), None
        if gap and mask:
            room, best = gap + small, small
            a = longest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = longest(min(a, room - a))
                if b == a and left[a] < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
        for n in pair or ():
            use(n, 1)
            bin_[n] = bin_.get(n, 0) + 1
            touched[n] = touched.get(n, 0) + 1
        more = min(left[n] // k for n, k in touched.items())  # so often are all choices the same
        if pair:
            bin_[small] -= 1
            left[small] += 1
            mask |= 1 << small
        bin_ = {n: k for n, k in bin_.items() if k}
        for n, k in bin_.items() if more else ():
            use(n, more * k)
        out.append((bin_, 1 + more))
    return out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``, by best-two-fit."""
    free: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        free.setdefault(n, []).append(i)
    found = fillings({n: len(v) for n, v in free.items()}, capacity)
    return [[free[n].pop() for n, k in bin_.items() for _ in range(k)] for bin_, times in found for _ in range(times)]


#: Bits of a piece's number among those of its length.
NUMBER_BITS = 40


def layout(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (key, pieces in a sequence, first sequence, first offset): where the pieces of a length go from a number on.

    key: length << NUMBER_BITS | number, ascending. Pieces of one length stand side by side in a sequence.
    """
    rows, upto, sequence = [], dict.fromkeys(counts, 0), 0
    for bin_, times in fillings(counts, capacity):
        at = 0
        for n, k in bin_.items():
            rows.append((n << NUMBER_BITS | upto[n], k, sequence, at))
            upto[n] += k * times
            at += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces_of(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and each piece's number among its partition's of that length."""
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: its size doesn't follow the data
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = worker_chunks(sent.value)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            ids = b["doc_id"].to_pylist()
            doc, piece, start, length, crc, number = [], [], [], [], [], []
            for doc_id, raw in zip(ids, chunks.of(b["_text"].cast(pa.binary()).to_pylist()), strict=True):
                raw += end
                for k in range(0, len(raw), 4 * capacity):
                    cut = raw[k : k + 4 * capacity]
                    n = len(cut) // 4
                    doc.append(doc_id)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(cut))
                    number.append(seen[n])
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_number"]
            columns = [doc, pa.array(piece, pa.int32()), start, length, crc, pa.array([part] * len(doc), pa.int32()), number]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _number long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("_text")), run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = durable(pieces_of(docs, tokenizer_file, capacity))
    counts = durable(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")))  # at most capacity rows a partition
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")
    base = counts.select("_part", "length", before.alias("_base"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    sent = docs.sparkSession.sparkContext.broadcast(layout(total, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, k, sequence, at = sent.value.T
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            n = b["length"].to_numpy()
            key = (n << NUMBER_BITS) + b["_base"].to_numpy() + b["_number"].to_numpy()
            row = np.searchsorted(keys, key, "right") - 1
            turn, place = np.divmod(key - keys[row], k[row])
            new = [pa.array(sequence[row] + turn), pa.array(at[row] + place * n)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *new], [*keep, "sequence_id", "offset"])

    rows = pieces.join(small_side(base, counts.count()), ["_part", "length"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(rows.select("doc_id", "piece", "start", "length", "ids_crc32", "_base", "_number"), run, schema)
