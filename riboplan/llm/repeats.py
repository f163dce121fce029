"""Windows that also start in a document with a smaller id: the frame of the two substring operators.

A unit (words or bytes) gives, for each window of LENGTH symbols, one anchor: a place inside the window,
with a key, both set by the window's content alone. So equal windows have equal keys, and:

0. Whole copies of a text with a smaller id lose everything; only the least id of a text goes on.
1. Keys that two texts hold are found. Up to FILTER_BYTES of text they are kept as a bit map of fixed size
   (a cell that two keys share only sends more than needed), broadcast to a second scan, so that no text
   is shuffled. Beyond it keys are shuffled with their ids, and texts meet their shared keys by join; a
   task first combines its own rows, so a key of very many documents goes out once a batch.
2. For each shared key a text sends its stretch: what tells the windows of that anchor.
3. All stretches of a key meet. Equal ones become one; where a key has several, the unit's ``classes``
   finds the equal windows among them. A window goes wherever the id is above the least id of its class.

Nothing goes through the driver but counts and the bit map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_batches, mix, small_side, written_side

LENGTH = 50
PLACE_BITS = 28
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Text of one vectorized run, in bytes (one longer text makes a run of its own).
RUN_BYTES = 250_000
#: Text up to which shared keys are a bit map of 2 ** CELL_BITS cells (16 MB), made in BUCKETS parts.
FILTER_BYTES = 16_000_000_000
CELL_BITS = 27
BUCKETS = 1024
#: Stretches that a task holds before it packs and sends them.
SEND_BYTES = 12_000_000
#: Text that sends its stretches to one reducer task.
REDUCER_BYTES = 16_000_000
#: Spans up to which the last join sends the spans to the texts (32 MB), not both to a shuffle.
SPAN_ROWS = 2_000_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


class Unit:
    """What a kind of symbol supplies. ``lo`` and ``hi`` bound an anchor's place within a window."""

    lo: int
    hi: int

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, and the number in each text."""
        raise NotImplementedError

    def keys(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
        """Places that may be anchors, ascending, and the key of each."""
        raise NotImplementedError

    def material(self, symbols: np.ndarray) -> tuple[np.ndarray, int]:
        """An array by place, and how many entries from a window's place on tell that window."""
        raise NotImplementedError

    def classes(self, stretches: list[np.ndarray], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (stretch, class) of every window, in the order of stretches and windows.

        ``groups`` has the first stretch of each key, and at last their number; windows of two keys differ.
        """
        raise NotImplementedError

    def anchors(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first window, last window (as places among all symbols), key of each anchor."""
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        none = np.zeros(0, np.int64)
        if len(symbols) < LENGTH:
            return none, none, none, none.astype(np.uint64)
        places, keys = self.keys(symbols, owner)
        rank = np.full(len(symbols), np.iinfo(np.uint64).max, np.uint64)
        at = np.arange(len(keys), dtype=np.uint64) if isinstance(places, slice) else places.astype(np.uint64)
        rank[places] = (keys * np.uint64(0x9FB21C651E98DF25) & ~PLACE) | at
        starts = len(symbols) - LENGTH + 1
        best = sliding_min(rank[self.lo : self.lo + starts + self.hi - self.lo], self.hi - self.lo + 1)[:starts] & PLACE
        inside = owner[:starts] == owner[LENGTH - 1 :]
        begins = inside.copy()
        begins[1:] &= (best[1:] != best[:-1]) | ~inside[:-1]
        left = np.flatnonzero(begins)
        ends = inside
        ends[:-1] &= begins[1:] | ~inside[1:]
        right = np.flatnonzero(ends)
        which = best[left].astype(np.int64)
        text = owner[left]
        return text, left, right, keys[which] if isinstance(places, slice) else keys[np.searchsorted(places, which)]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) of runs of about RUN_BYTES."""
    part, size, first = [], 0, 0
    for k, t in enumerate(batch["_text"]):
        part.append(t.as_py())
        size += len(part[-1])
        if size >= RUN_BYTES:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def _texts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _fp, _text as UTF-8, and the ``keep`` columns. ``_fp`` tells rows of one id apart; it is 0 if no id has two texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("_fp"))
    twice = ids.groupBy("doc_id").agg(F.min("_fp").alias("a"), F.max("_fp").alias("b")).filter("a != b")
    fp = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(text)
    return docs.select(F.col("doc_id").cast("long"), fp.alias("_fp"), F.encode(text, "UTF-8").alias("_text"), *keep)


def _send_keys(rows: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, _fp, _route, key: a key's row (key null) goes to the key; what the batch knows goes elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            ids, fps = b["doc_id"].to_numpy(), b["_fp"].to_numpy()
            rows_, keys_ = [], []
            for first, texts in _runs(b):
                text, _, _, key = unit.anchors(*unit.symbols(texts))
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                rows_.append(text[new] + first)
                keys_.append(key[new])
            if not rows_:
                continue
            row, key = np.concatenate(rows_), np.concatenate(keys_)
            order = np.lexsort((ids[row], key))
            row, key = row[order], key[order]
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(lead)
            last = np.concatenate([at[1:], [len(key)]]) - 1 if len(at) else at
            many = np.repeat(ids[row[at]] != ids[row[last]], np.diff(np.concatenate([at, [len(key)]]))) if len(at) else lead
            sent = lead | (~many)  # one row of a key that several documents of the batch hold, all others once
            known = many
            who = np.concatenate([row[sent], row[known]])
            elsewhere = mix(key[known] + ids[row[known]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            route = np.concatenate([key[sent], elsewhere]).astype(np.int64)
            told = pa.array(np.concatenate([key[sent], key[known]]).astype(np.int64), mask=np.arange(len(who)) < sent.sum())
            for i in range(0, len(who), 100_000):
                w = who[i : i + 100_000]
                cols = [pa.array(ids[w]), pa.array(fps[w]), pa.array(route[i : i + 100_000]), told.slice(i, 100_000)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_fp", "_route", "key"])

    return map_batches(rows, run, "doc_id long, _fp long, _route long, key long")


def _send_cells(rows: DataFrame, unit: Unit) -> DataFrame:
    """bucket, keys: the distinct keys of a batch, by bucket; the lowest bit tells that two texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            row, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, texts in _runs(b):
                text, _, _, k = unit.anchors(*unit.symbols(texts))
                row.append(text + first)
                key.append(k | np.uint64(1))
            row, key = np.concatenate(row), np.concatenate(key)
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            other = np.concatenate([[0], np.cumsum(np.concatenate([(key[1:] == key[:-1]) & (row[1:] != row[:-1]), [False]]))])
            many = other[np.concatenate([head[1:], [len(key)]])[: len(head)]] > other[head]
            key = key[head] - np.uint64(1) + many.astype(np.uint64)
            edges = np.searchsorted(key, np.arange(BUCKETS + 1, dtype=np.uint64)[:-1] << np.uint64(54))
            edges = np.concatenate([edges, [len(key)]])
            some = np.flatnonzero(np.diff(edges))
            blobs = [key[edges[i] : edges[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "keys"])

    return map_batches(rows, run, "bucket int, keys binary")


def _bit_map(cells: DataFrame) -> np.ndarray:
    """Cells of the keys that two texts hold, as packed bits; its size is fixed, and so is what is collected."""
    width = 1 << (CELL_BITS - BUCKETS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, blob in zip(b["bucket"].to_pylist(), b["keys"].to_pylist(), strict=True):
                held.setdefault(bucket, []).append(np.frombuffer(blob, np.uint64))
        for bucket, parts in held.items():
            key = np.sort(np.concatenate(parts))
            bare = key | np.uint64(1)
            shared = (key & np.uint64(1)) > 0
            twice = bare[1:] == bare[:-1]
            shared[1:] |= twice
            bits = np.zeros(width, np.uint8)
            bits[cell_of(bare[shared]) & (width - 1)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

    out = np.zeros((BUCKETS, width // 8), np.uint8)
    for r in map_batches(cells.repartition("bucket"), run, "bucket int, bits binary").toLocalIterator(prefetchPartitions=True):
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def cell_of(key: np.ndarray) -> np.ndarray:
    return ((key | np.uint64(1)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


_ARRAYS = (("keys", np.uint64), ("sizes", np.int32), ("docs", np.int64), ("fps", np.int64), ("starts", np.int32))


def _packed(arrays: list[np.ndarray], material: np.ndarray) -> bytes:
    head = np.array([len(arrays[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays) + material.tobytes())


def _unpacked(blob: bytes, kind: np.dtype) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _, t in _ARRAYS:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return [*out, np.frombuffer(raw, kind, -1, at)]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _send_stretches(rows: DataFrame, unit: Unit, parts: int, bit_map: np.ndarray | None) -> DataFrame:
    """part, blob: the stretches of a batch for the keys of a part, sorted by key and packed."""
    sent = None if bit_map is None else rows.sparkSession.sparkContext.broadcast(bit_map)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        salt = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            ids, fps = b["doc_id"].to_numpy(), b["_fp"].to_numpy()
            found, material, held = [], [], 0
            for first, texts in _runs(b):
                symbols, sizes = unit.symbols(texts)
                text, left, right, key = unit.anchors(symbols, sizes)
                if sent is not None:
                    cell = cell_of(key)
                    shared = (sent.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
                else:
                    offsets = b["keys"].offsets.to_numpy().astype(np.int64)[first : first + len(texts) + 1]
                    values = b["keys"].values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint64)
                    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                    shared = np.isin(mix(key + text.astype(np.uint64) * salt), mix(values + owner.astype(np.uint64) * salt))
                text, left, right, key = text[shared], left[shared], right[shared], key[shared]
                if not len(key):
                    continue
                values, more = unit.material(symbols)
                size = right - left + more
                begin = (np.cumsum(sizes) - sizes)[text]
                found.append([key, size.astype(np.int32), ids[text + first], fps[text + first], (left - begin).astype(np.int32)])
                material.append(values[ranges(left, size)])
                held += material[-1].nbytes
                if held >= SEND_BYTES:
                    yield from pack_parts(found, material)
                    found, material, held = [], [], 0
            if found:
                yield from pack_parts(found, material)

    def pack_parts(found: list, material: list) -> Iterator[pa.RecordBatch]:
        arrays, values = [np.concatenate(x) for x in zip(*found, strict=True)], np.concatenate(material)
        order = np.argsort(arrays[0], kind="stable")
        begin = (np.cumsum(arrays[1]) - arrays[1])[order]
        arrays = [a[order] for a in arrays]
        edges = np.searchsorted(arrays[0], (np.arange(parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64))
        edges = np.concatenate([edges, [len(order)]])
        for i in np.flatnonzero(np.diff(edges)):
            of = slice(edges[i], edges[i + 1])
            blob = _packed([a[of] for a in arrays], values[ranges(begin[of], arrays[1][of])])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    return map_batches(rows, run, "part int, blob binary")


def _content_hashes(material: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each stretch; stretches lie one after the other."""
    powers = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        power = np.full(int(size.max(initial=1)), base, np.uint64)
        power[0] = 1
        powers.append(np.cumprod(power))
    out = [np.empty(len(size), np.uint64) for _ in powers]
    table = mix(np.arange(1, 257, dtype=np.uint64)) if material.dtype == np.uint8 else None
    step = 1000  # stretches at a time, which bounds the scratch arrays
    for i in range(0, len(size), step):
        n, at = size[i : i + step], begin[i : i + step]
        part = material[at[0] : at[-1] + n[-1]]
        part = mix(part + np.uint64(1)) if table is None else table[part]
        place = ranges(np.zeros(len(n), np.int64), n)
        for h, power in zip(out, powers, strict=True):
            h[i : i + step] = np.add.reduceat(part * power[place], at - at[0])
    return [mix(h) for h in out]


def _spans(stretches: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, _fp, s, e: runs of symbols to remove, from all stretches of the keys of a partition."""

    def part_spans(blobs: list[bytes]) -> list[np.ndarray]:
        kind, more = (x if k else x.dtype for k, x in enumerate(unit.material(np.zeros(LENGTH, unit.symbols([])[0].dtype))))
        key, size, docs, fps, starts, material = (np.concatenate(x) for x in zip(*(_unpacked(x, kind) for x in blobs), strict=True))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        h1, h2 = _content_hashes(material, begin, size)
        order = np.lexsort((h2, h1, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1  # equal stretches have one number, ascending with their key
        one = order[new]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        windows = size[one] - more + 1
        above = docs > least[at]  # an id above the least of its stretch loses all of it
        out = [[docs[above], fps[above], starts[above], starts[above] + windows[at[above]] - 1 + LENGTH]]
        # only keys with several stretches can hold windows that the least id of a stretch loses, too
        head = np.flatnonzero(np.concatenate([[True], key[one][1:] != key[one][:-1]]))
        several = np.repeat(np.diff(np.concatenate([head, [len(one)]])) > 1, np.diff(np.concatenate([head, [len(one)]])))
        chosen = np.flatnonzero(several)
        if not len(chosen):
            return out[0]
        k = key[one][chosen]
        groups = np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(chosen)]])
        runs: list[list[np.ndarray]] = []
        strings = [material[a : a + n] for a, n in zip(begin[one][chosen].tolist(), size[one][chosen].tolist(), strict=True)]
        for owner, classes in unit.classes(strings, groups):
            mine = least[chosen[owner]]
            lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, classes, mine)
            flag = np.concatenate([[False], lowest[classes] < mine, [False]])
            other = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
            first = np.flatnonzero(flag[1:-1] & (~flag[:-2] | other[:-1]))
            last = np.flatnonzero(flag[1:-1] & (~flag[2:] | other[1:]))
            zero = np.maximum.accumulate(np.where(other[:-1], np.arange(len(owner)), 0))
            runs.append([chosen[owner[first]], first - zero[first], last - zero[last]])
        who, first, last = (np.concatenate(x) for x in zip(*runs, strict=True))
        own = np.flatnonzero(~above)
        own = own[np.argsort(at[own], kind="stable")]
        lo, hi = np.searchsorted(at[own], who), np.searchsorted(at[own], who, side="right")
        occ = own[ranges(lo, hi - lo)]
        out.append([docs[occ], fps[occ], starts[occ] + np.repeat(first, hi - lo), starts[occ] + np.repeat(last, hi - lo) + LENGTH])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist(), strict=True):
                held.setdefault(part, []).append(blob)
        while held:
            columns = part_spans(held.popitem()[1])
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in columns], ["doc_id", "_fp", "s", "e"])

    return map_batches(stretches, run, "doc_id long, _fp long, s long, e long")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, _fp, spans: the maximal runs, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = b["spans"].offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(b)), np.diff(offsets))
            s, e = (b["spans"].values.field(c).to_numpy()[offsets[0] : offsets[-1]] for c in ("s", "e"))
            far = row << 32  # texts have less than 2**31 symbols
            order = np.argsort(far + s, kind="stable")
            s, e, row = (far + s)[order], np.maximum.accumulate((far + e)[order]), row[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, np.int64)
            tail = np.concatenate([head[1:], [len(s)]])[: len(head)] - 1
            at = row[head]
            size = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(b)))]).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array(s[head] - (at << 32)), pa.array(e[tail] - (at << 32))], ["s", "e"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["_fp"], pa.ListArray.from_arrays(size, pair)], ["doc_id", "_fp", "spans"])

    return map_batches(spans, run, "doc_id long, _fp long, spans array<struct<s: long, e: long>>")


def kept_symbols(spans: pa.ListArray, row: int, n: int) -> np.ndarray:
    """Which of the n symbols of a row stay."""
    stay = np.ones(n, bool)
    if n >= LENGTH:
        lo, hi = spans.offsets[row].as_py(), spans.offsets[row + 1].as_py()
        for s, e in zip(spans.values.field("s")[lo:hi].to_pylist(), spans.values.field("e")[lo:hi].to_pylist(), strict=True):
            stay[s:e] = False
    return stay


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id, _fp of the rows whose whole text some row with a smaller id has."""
    ids = rows.select("doc_id", "_fp", F.length("_text").alias("n"), F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(7), "_text").alias("h2"))
    same = ["n", "h1", "h2"]
    least = written_side(ids.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"))
    return durable(ids.join(least, same).filter("doc_id > least").select("doc_id", "_fp").distinct())


def repeated_spans(docs: DataFrame, unit: Unit, keep: tuple[str, ...] = (), filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, _fp, _text, keep) of all rows; (doc_id, _fp, spans) of those that lose symbols; the number of spans."""
    rows = _texts(docs, keep)
    live = rows.select("doc_id", "_fp", "_text").filter(F.col("doc_id").isNotNull() & (F.length("_text") >= LENGTH))
    copies = _copies(live)
    n_copies = copies.count()
    live = live.join(small_side(copies, n_copies), ["doc_id", "_fp"], "left_anti")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // REDUCER_BYTES))
    if size <= filter_bytes:
        found = _send_stretches(live, unit, parts, _bit_map(_send_cells(live, unit)))
    else:
        w = Window.partitionBy("_route")
        seen = _send_keys(live, unit).withColumns({"a": F.min("doc_id").over(w), "b": F.max("doc_id").over(w)})
        shared = seen.filter(F.col("key").isNotNull() | (F.col("a") != F.col("b")))
        by_doc = durable(shared.groupBy("doc_id", "_fp").agg(F.collect_list(F.coalesce("key", "_route")).alias("keys")))
        found = _send_stretches(live.join(by_doc, ["doc_id", "_fp"]), unit, parts, None)
    spans = _spans(found.repartitionById(parts, F.col("part")), unit)
    merged = _merged(spans.groupBy("doc_id", "_fp").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(2**31).cast("long").alias("e")))
    merged = durable(merged.unionByName(copies.withColumn("spans", whole)))
    return rows, merged, merged.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]


def with_spans(docs: DataFrame, unit: Unit, keep: tuple[str, ...] = (), filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, _text, the ``keep`` columns and spans (maximal runs; null where nothing goes) of every row."""
    rows, merged, n = repeated_spans(docs, unit, keep, filter_bytes)
    return rows.join(small_side(merged, n, SPAN_ROWS), ["doc_id", "_fp"], "left").drop("_fp")
