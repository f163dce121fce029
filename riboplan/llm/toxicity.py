"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are lower-cased and stripped of punctuation; the word and its first four and five letters (so that
inflected forms share what they learn) are hashed into buckets. A word's embedding is the sum of its
buckets'. A model has filters of several widths over the words of the whole text, the maximum of each filter
and a logistic output. One embedding coordinate starts at the bucket's smoothed log odds in the
training rows, the others at random, and all are trained.

Thresholds are calibrated by language: all labelled training rows, of which at least a quarter is kept out
of the fit, are scored with their whole texts and counted by guessed language, class and bin of the score.
The cut that parts the classes best is found for each language, and the score is shifted on the logit scale
so that this cut lies at 0.7. Only a language with fewer than five rows of a class takes the common cut. The
fit takes whole texts of a sample in which every language of a class has its share. The language is guessed from the text by word counts per bucket; the ``lang``
column of a row is never an input of its score.

Defined results: null and empty texts get the score of a text without words; with no labelled row every
score is 0; null labels are not learned, and of several labels of one id the larger counts; repeated
rows get repeated results; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, map_batches, small_side, under
from .nn import Adam, PooledConvolutions

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
CUT = 0.7
#: Bound of the fitting sample: rows of each class.
SAMPLE_PER_CLASS = 4000
#: Rows of a class that a language needs for a cut of its own.
OWN_CUT = 5
#: Score bins a unit of the logit, and the largest logit that is told apart.
BINS, TOP = 64, 30
#: Letters of a word that are hashed: four, five, all (as far as that matters).
STEMS = (4, 5, 40)
#: Words of a training window.
SPAN = 64

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Buckets(dict):
    """Word -> place in a table of its buckets (1 .. BUCKETS - 1; 0 pads); emptied at a fixed size."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.table = np.zeros((self.LIMIT + 2, len(STEMS)), np.int32)

    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        k = len(self) + 1
        if k > len(self.table) - 1:  # one text may hold more words than LIMIT
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if bare:
            self.table[k] = [1 + zlib.crc32(f"{n}:{bare[:n]}".encode()) % (BUCKETS - 1) for n in STEMS]
        self[word] = k
        return k

    def of(self, text: str) -> np.ndarray:
        """(words, buckets of each)."""
        if len(self) > self.LIMIT:
            self.clear()
            self.table = np.zeros((self.LIMIT + 2, len(STEMS)), np.int32)
        words = text.lower().split()
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return self.table[at]


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row for each id with a label that is not held out."""
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def quotas(sizes: dict[tuple[int, str], int], per_class: int) -> dict[tuple[int, str], int]:
    """Rows of each (class, language): equal shares of the class, and what small languages leave goes to the others."""
    out = {}
    for c in {k[0] for k in sizes}:
        mine = sorted((n, k) for k, n in sizes.items() if k[0] == c)
        rest = per_class
        for i, (n, k) in enumerate(mine):
            out[k] = min(n, max(1, rest // (len(mine) - i)))
            rest -= out[k]
    return out


def sample(docs: DataFrame, one: DataFrame, rows: int, per_class: int = SAMPLE_PER_CLASS) -> list[tuple]:
    """(toxic, lang, whole text, kept out of the fit) of about ``per_class`` of the ``rows`` rows of ``one`` a class, by language."""
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    found = durable(docs.select("doc_id", lang).join(small_side(one, rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("lang").alias("lang")))
    sizes = {(r["toxic"], r["lang"]): r["count"] for r in found.groupBy("toxic", "lang").count().collect()}
    share = quotas(sizes, per_class)
    if not share:
        return []
    rank = F.row_number().over(Window.partitionBy("toxic", "lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    limit = docs.sparkSession.createDataFrame([(*k, n, under(n, sizes[k])) for k, n in share.items()], "toxic int, lang string, _most int, _under long")
    near = found.join(F.broadcast(limit), ["toxic", "lang"]).filter(F.xxhash64("doc_id") <= F.col("_under"))  # hardly more than wanted is shuffled
    chosen = near.withColumn("_rank", rank).filter("_rank <= _most")
    chosen = chosen.select("doc_id", "toxic", (F.col("_rank") % 4 == 0).alias("cal"))
    got = docs.select("doc_id", lang, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # about 2 * per_class rows
    return sorted({tuple(r) for r in got.select("toxic", "lang", "text", "cal").collect()})


def _log_odds(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of a bucket's presence in toxic and in other texts, the more shrunk the rarer it is."""
    n = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for x, c in zip(ids, y, strict=True):
        n[c][np.unique(x)] += 1
    a, b = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    prior = 0.5 + a / 400  # so many texts of either class are added, in proportion to the classes
    return np.log((n[1] + prior) / (a + 2 * prior)) - np.log((n[0] + prior * b / a) / (b + 2 * prior * b / a))


def train(rows: list[tuple], epochs: int = 6, batch: int = 64, seed: int = 11) -> dict:
    """The model, its thresholds not calibrated."""
    if len({r[0] for r in rows}) < 2:
        return {}
    to = Buckets()
    ids = [to.of(r[2]) for r in rows]
    y = np.array([r[0] for r in rows])
    cal = np.array([r[3] for r in rows])
    if len(set(y[~cal])) < 2:
        cal[:] = False
    odds = _log_odds([x for x, c in zip(ids, cal, strict=True) if not c], y[~cal])
    net = PooledConvolutions(BUCKETS, DIM, WIDTHS, FILTERS, 2, seed)
    net.p["E"] *= 0.1
    net.p["E"][:, 0] = np.clip(odds, -3, 3)
    net.p["E"][0] = 0
    for w in WIDTHS:  # half of the filters begin as detectors of telling words
        net.p[f"W{w}"][0::DIM, : FILTERS // 2] = np.abs(net.p[f"W{w}"][0::DIM, : FILTERS // 2])

    # A toxic text's windows are labelled by their most telling word: only the most telling window is positive.
    x, lab = [], []
    for k, (words, c) in enumerate(zip(ids, y, strict=True)):
        if cal[k]:
            continue
        n = max(1, -(-len(words) // SPAN))
        w = np.zeros((n * SPAN, len(STEMS)), np.int64)
        w[: len(words)] = words
        w = w.reshape(n, SPAN, len(STEMS))
        top = net.p["E"][:, 0][w].sum(2).max(1)
        order = np.argsort(-top, kind="stable")
        take = order[:1] if c else order[:3]
        x.append(w[take])
        lab += [c] * len(take)
    x, lab = np.concatenate(x), np.array(lab)
    share = np.bincount(lab, minlength=2) / len(lab)
    weight = np.clip(0.5 / share, 0.2, 5).astype(np.float32)
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-200 * batch // len(x)))
    opt = Adam(net.p, 0.003, decay=1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            opt.update(net.gradients(x[k], lab[k], weight[lab[k]])[1])

    langs = sorted({r[1] for r in rows if r[1]})
    guess = np.full((BUCKETS, max(1, len(langs))), 0.5, np.float32)
    for words, r in zip(ids, rows, strict=True):
        if r[1]:
            np.add.at(guess[:, langs.index(r[1])], words.ravel(), 1)
    guess[0] = 1
    guess = np.log(guess / guess.sum(0))
    return {**net.p, "guess": (guess - guess.mean(1, keepdims=True)).astype(np.float32), "shift": np.zeros(guess.shape[1])}


def calibrate(model: dict, counts: list[tuple[int, int, int, int]]) -> dict:
    """The model with each language's cut, from (guessed language, class, bin, rows)."""
    lang, y, z, n = np.array(counts, np.float64).reshape(-1, 4).T
    z = (z + 0.5) / BINS
    if len(set(y)) < 2:
        return model
    whole, shift = _best_cut(z, y, n), np.zeros(len(model["shift"]))
    for c in range(len(shift)):
        own = lang == c
        few = min(n[own & (y == v)].sum() for v in (0, 1)) < OWN_CUT
        shift[c] = whole if few else _best_cut(z[own], y[own], n[own])
    return {**model, "shift": shift}


def histogram(docs: DataFrame, one: DataFrame, rows: int, model: dict) -> list[tuple[int, int, int, int]]:
    """(guessed language, class, bin, rows) over the whole texts of all rows of ``one``; at most a row a bin."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Buckets()
        for b in batches:
            logit, lang = whole_scores(sent.value, to, b["_text"].to_pylist())
            bins = np.floor(np.clip(logit, -TOP, TOP) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang.astype(np.int32)), pa.array(bins)], ["doc_id", "guess", "bin"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    if rows <= BROADCAST_ROWS:  # beyond it all texts are scored, as only the scores can be shuffled cheaply
        texts = texts.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi")
    scored = map_batches(texts, run, f"doc_id {dict(docs.dtypes)['doc_id']}, guess int, bin int")
    counts = scored.join(small_side(one, rows), "doc_id").groupBy("guess", "toxic", "bin").count()
    return [tuple(r) for r in counts.collect()]


def _best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the least weight of errors, in the widest gap among equals."""
    z, at = np.unique(logit, return_inverse=True)
    toxic, clean = (np.bincount(at, weight * (y == v), len(z)) for v in (1, 0))
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    errors = np.round(errors, 6)
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = edges[1:] - edges[:-1]
    k = max(range(len(errors)), key=lambda i: (-errors[i], gap[i]))
    return float(edges[k] + gap[k] / 2)


def raw_scores(model: dict, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of the toxic class and guessed language of each text; all words of all texts in one run."""
    widest = max(WIDTHS)
    gap = np.zeros((widest, len(STEMS)), np.int32)  # padding parts texts and gives the empty one a place
    lens = np.array([len(x) + widest for x in ids])
    flat = np.concatenate([part for x in ids for part in (x, gap)])
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    x, tongue = model["E"][flat[:, 0]], model["guess"][flat[:, 0]]
    for k in range(1, len(STEMS)):
        x += model["E"][flat[:, k]]
        tongue += model["guess"][flat[:, k]]
    hidden = []
    for w in WIDTHS:
        taps = model[f"W{w}"].reshape(w, DIM, -1)
        z = x @ taps[0] + model[f"b{w}"]
        for k in range(1, w):
            z[:-k] += x[k:] @ taps[k]
        hidden.append(np.maximum.reduceat(z, begin, axis=0))
    h = np.maximum(np.concatenate(hidden, 1), 0)
    out = h @ model["V"] + model["c"]
    lang = np.add.reduceat(tongue, begin, axis=0).argmax(1)
    return (out[:, 1] - out[:, 0]).astype(np.float64), lang


def whole_scores(model: dict, to: Buckets, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``raw_scores`` of whole texts, some 100,000 words at a time."""
    logit, lang, i = np.zeros(len(texts)), np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        ids, count, first = [], 0, i
        while i < len(texts) and count < 100_000:
            ids.append(to.of(texts[i]))
            count += len(ids[-1])
            i += 1
        logit[first:i], lang[first:i] = raw_scores(model, ids)
    return logit, lang


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score and predicted, from the whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, to = sent.value, Buckets()
        for b in batches:
            score = np.zeros(len(b))
            texts = b["_text"].to_pylist()
            if m:
                logit, lang = whole_scores(m, to, texts)
                z = logit - m["shift"][lang] + np.log(CUT / (1 - CUT))
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            new = [pa.array(score), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *new], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", score double, predicted int"
    return map_batches(rows, run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    one = durable(labelled(labels))
    rows = one.count()
    model = train(sample(docs, one, rows))
    return calibrate(model, histogram(docs, one, rows, model)) if model else model
