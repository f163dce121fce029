"""Language identification with a convolutional network over bytes, trained in numpy.

A text is its UTF-8 bytes, cut into windows of fixed length (the last one padded). The network embeds
bytes, applies filters of several widths, takes each filter's maximum over a window, and ends in a
softmax over the learned languages. A document's probabilities are the mean over all its windows,
weighted by their bytes.

For prediction the embedding and a filter of width w are one linear map of w bytes, so each filter is a
sum of lookups by byte pair (and a last single byte); no matrix product is left in the long loop.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; labels that
are null or blank are not learned; with no labelled row every prediction is ``und``; rows are predicted
one by one, so repeated rows and ids give repeated results, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, under
from .nn import Adam, PooledConvolutions, softmax

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
#: Bound of the training sample: rows of each language, and bytes taken from one text.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_BYTES = 8 * WINDOW

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most ``per_language`` texts of each language, those of the least hash of the id, never held-out ones.

    Languages are counted first, so that hardly more rows than wanted are shuffled, however many there are.
    """
    rows = (
        docs.select("doc_id", "lang", "text")
        .filter(F.col("lang").isNotNull() & (F.trim("lang") != "") & (F.col("lang") != UNKNOWN))
        .filter(F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    )
    sizes = [(r["lang"], under(per_language, r["count"])) for r in rows.groupBy("lang").count().collect()]
    bound = docs.sparkSession.createDataFrame(sizes, "lang string, _under long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", F.xxhash64("text")))
    chosen = (
        rows.withColumn("_hash", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")))
        .join(F.broadcast(bound), "lang")  # a row a language
        .filter("_hash <= _under")
        .select("lang", F.substring(F.encode("text", "UTF-8"), 1, SAMPLE_BYTES).alias("text"), "_hash")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= per_language)
    )
    return sorted((r["lang"], bytes(r["text"])) for r in chosen.collect())


def windows(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, (number, length), padded with byte 0."""
    n = max(1, -(-len(raw) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


def train(rows: list[tuple[str, bytes]], epochs: int = 4, batch: int = 64, seed: int = 7) -> dict:
    """A model as plain arrays: ``langs`` and the network's parameters."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return {"langs": []}
    x, y = [], []
    rng = np.random.default_rng(seed)
    for lang, raw in rows:
        w = windows(raw)
        x.append(w)
        y += [langs.index(lang)] * len(w)
        short = w[rng.integers(len(w))].copy()
        short[int(rng.integers(12, WINDOW)) :] = 0  # short texts occur, too
        x.append(short[None])
        y.append(langs.index(lang))
    ids, labels = np.concatenate(x).astype(np.int64), np.array(y)
    balance = (len(labels) / len(langs) / np.bincount(labels, minlength=len(langs))).astype(np.float32)
    net = PooledConvolutions(256, DIM, WIDTHS, FILTERS, len(langs), seed)
    steps = epochs * (-(-len(ids) // batch))
    epochs = epochs if steps >= 300 else -(-300 * batch // len(ids))
    opt = Adam(net.p, 0.004)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            opt.update(net.gradients(ids[k], labels[k], balance[labels[k]])[1])
    return {"langs": langs, **net.p}


def tables(model: dict) -> list[list[np.ndarray]]:
    """For each width the lookups whose sum is the filters' output: by byte pair, and by the last byte if odd."""
    out = []
    for w in WIDTHS:
        taps = model[f"W{w}"].reshape(w, DIM, -1)
        by = [model["E"] @ taps[k] for k in range(w)]
        by[0] = by[0] + model[f"b{w}"]
        pairs = [(by[k][:, None] + by[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
        out.append([*pairs, by[-1]] if w % 2 else pairs)
    return out


def pooled(ids: np.ndarray, lookups: list[list[np.ndarray]]) -> np.ndarray:
    """Maximum of every filter over each window; ids is (places, windows)."""
    two = ids[:-1].astype(np.int32) * 256 + ids[1:]
    out = []
    for w, tabs in zip(WIDTHS, lookups, strict=True):
        places = len(ids) - w + 1
        z = None
        for k, t in enumerate(tabs):
            at = (two if len(t) == 65536 else ids)[2 * k : 2 * k + places]
            z = t[at] if z is None else np.add(z, t[at], out=z)
        out.append(z.max(axis=0))
    return np.maximum(np.concatenate(out, 1), 0)


def probabilities(model: dict, texts: list[bytes], lookups: list[list[np.ndarray]], block: int = 96) -> np.ndarray:
    """(texts, languages)."""
    total = np.zeros((len(texts), len(model["langs"])))
    kept: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if kept:
            ids, own = np.concatenate(kept), np.concatenate(owner)
            for i in range(0, len(ids), block):
                part = ids[i : i + block]
                p = softmax(pooled(np.ascontiguousarray(part.T), lookups) @ model["V"] + model["c"])
                weight = np.maximum((part != 0).sum(1), 1)
                np.add.at(total, own[i : i + block], p * weight[:, None])
        kept.clear()
        owner.clear()
        count = 0

    for k, raw in enumerate(texts):
        w = windows(raw)
        kept.append(w)
        owner.append(np.full(len(w), k))
        count += len(w)
        if count >= 32 * block:
            flush()
    flush()
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row, from the whole text alone."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m["langs"], UNKNOWN], dtype=object)
        lookups = tables(m) if m["langs"] else []
        for b in batches:
            best = np.full(len(b), len(names) - 1)
            score = np.zeros(len(b))
            live = np.flatnonzero(b["_letter"].to_numpy(zero_copy_only=False))
            if lookups and len(live):
                p = probabilities(m, b["_text"].take(pa.array(live)).cast(pa.binary()).to_pylist(), lookups)
                best[live], score[live] = p.argmax(1), p.max(1)
            new = [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *new], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_letter", F.col("_text").rlike(r"\p{L}"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double"
    return map_batches(rows, run, schema)


def fit(docs: DataFrame) -> dict:
    return train(sample(docs))
