"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct windows of k words (ASCII lower case). Equal
sets form a class, linked at once; all that follows is between classes.

Order: a count-min sketch of two rows gathers, over all documents, how often hashes occur. Windows are
ordered by that count, then by hash: one order for all sets, the rare first. Two sets whose similarity
is at least p percent share one of the first n - ceil(p n / 100) + 1 windows of each, whatever the order;
the sketch decides only how seldom unrelated sets meet there. It has a fixed size.

Candidates meet in the rows of a prefix window and pass the length and positional filters. Each pair then
passes a suffix filter before any set is sent: a class carries a signature, the parity of its hashes in each of
2^b ranges, about one range for two windows. As many parities as two signatures differ in, so many windows at least
are in one of the sets only, which bounds their similarity from above. What is left is verified once, on
the texts themselves.

Links are wanted as components, so not all pairs of a group are made. Each set that meets LONG_ROW others or
more is first compared with one pivot, the set that heads most of its windows' rows, if their signatures have
something in common; what links is one component. Two sets
compared with the same pivot then meet no more by what both share with it, but by how they differ from it: if
x and y are similar, the difference of their difference sets is as small as theirs, so difference sets larger
than that bound share a window, and prefix and positional filters hold for them as for sets. A group of
copies costs one comparison a member, and variants of it meet only if they vary alike. Pairs of different
pivots, sets near the bound and sets unlike their pivot meet by their own windows; in a row where few pivots have
many sets, pivots are paired first, so that sets of one pivot are not compared there. No link between two components is lost.

No key is worked on by one task alone: windows of very many sets, which the sketch tells, are salted, and
what a row's sets have in common is found by aggregates that combine before the shuffle.

Defined results: without words or text the set is empty and linked with nothing; a null id is linked with
nothing and gets a null component; each row is judged by its own text, so repeated rows get equal results;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_batches, mix, small_side, word_names, written_side

SKETCH_BITS = 16
#: Links up to which one task finds their components (32 MB of them).
ONE_TASK_LINKS = 2_000_000
#: Ranges of a signature: at least 2 ** SIGNATURE_BITS[0], at most 2 ** SIGNATURE_BITS[1] (8 kB).
SIGNATURE_BITS = (6, 16)
#: Windows that more sets hold than this, and than one in HOT_SHARE of all windows, are salted with SALTS values.
HOT_ROWS = 10_000
HOT_SHARE = 100_000
SALTS = 256
#: Sets in one window's row from which on they are compared with a pivot, not each with each.
LONG_ROW = 12
_K = np.uint64(0xD6E8FEB86659FD93)


#: Text whose sets are made in one vectorized run, in bytes.
RUN_BYTES = 250_000


def sets_of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its windows of k words; a shorter text is one window."""
    part: list[bytes] = []
    held = 0
    for last, t in enumerate(texts, 1):
        part.append(t)
        held += len(t)
        if held >= RUN_BYTES or last == len(texts):
            yield from _run_sets(part, k)
            part, held = [], 0


def _run_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    names, sizes = word_names(texts, lower=True)
    x = mix(names)
    full = np.zeros(0, np.uint64)
    if len(x) >= k:
        full = x[: len(x) - k + 1]
        for j in range(1, k):
            full = full * _K + x[j : len(x) - k + 1 + j]
        full = mix(full + np.uint64(k))
    at = 0
    for n in sizes.tolist():
        if n >= k:
            s = np.sort(full[at : at + n - k + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        elif n:
            h = x[at : at + 1]
            for j in range(1, n):
                h = h * _K + x[at + j : at + j + 1]
            yield mix(h + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in ranges by their low bits; half as many ranges as windows, in powers of two."""
    bits = min(max((len(s) // 2).bit_length(), SIGNATURE_BITS[0]), SIGNATURE_BITS[1])
    counts = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def unlike(x: bytes, y: bytes) -> tuple[int, int]:
    """(parities that differ, ranges) of two signatures; the longer one is folded to the ranges of the shorter."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()), 8 * len(a)


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (s & mask).astype(np.int64), ((s >> np.uint64(SKETCH_BITS)) & mask).astype(np.int64)


def _count(counts: np.ndarray, some: list[np.ndarray]) -> None:
    if some:
        for row, cell in zip(counts, _cells(np.concatenate(some)), strict=True):
            row += np.bincount(cell, minlength=len(row))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.encode(text, "UTF-8").alias("_text"), F.xxhash64(text).alias("text_hash"))


def _facts(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, cls, sig of each row (cell null); and of each task its part of the sketch (n: count, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        names = ["doc_id", "text_hash", "n", "cls", "sig", "cell"]
        for b in batches:
            n, cls, sig, held, some = [], [], [], 0, []
            for s in sets_of(b["_text"].to_pylist(), k):
                n.append(len(s))
                cls.append(class_of(s))
                sig.append(signature(s))
                some.append(s)
                held += len(s)
                if held > 500_000:
                    _count(counts, some)
                    some, held = [], 0
            _count(counts, some)
            none = pa.nulls(len(b), pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), none], names)
        cell = np.flatnonzero(counts)
        none = pa.nulls(len(cell), pa.int64())
        columns = [none, none, pa.array(counts.ravel()[cell]), none, pa.nulls(len(cell), pa.binary()), pa.array(cell.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(rows, run, "doc_id long, text_hash long, n long, cls long, sig binary, cell int")


def _prefixes(rows: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """token, cls, n, pos, salt: the windows by which a set can meet others; only those of very many sets have a salt."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)  # fixed size
    hot = max(HOT_ROWS, int(sketch[0].sum()) // HOT_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        counts = sent.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in sets_of(b["_text"].to_pylist(), k):
                n = len(s)
                size = n - -(-percent * n // 100) + 1
                one, two = _cells(s)
                often = np.minimum(counts[0][one], counts[1][two])
                first = np.lexsort((s, often))[:size]
                cls = class_of(s)
                salt = np.where(often[first] > hot, 1 + cls % SALTS, 0).astype(np.int32)
                new = (s[first].astype(np.int64), np.full(len(first), cls), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32), salt)
                for x, y in zip(out, new, strict=True):
                    x.append(y)
            columns = [np.concatenate(x) for x in out]
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], ["token", "cls", "n", "pos", "salt"])

    return map_batches(rows, run, "token long, cls long, n int, pos int, salt int")


def _may_link(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length filter; positional filter, which holds at the first window that two similar sets share."""
    length = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    most = 1 + F.least(n1 - p1, n2 - p2) - 1
    return length & (most * (100 + percent) >= percent * (n1 + n2))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test, on sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def widest(n: int, percent: int) -> int:
    """Largest difference (symmetric) that a set of n windows can have from a similar set."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def _difference(x: np.ndarray, pivot: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """Size of the difference set, and its prefix: what only x has comes first, then what only the pivot has."""
    mine, lacks = np.setdiff1d(x, pivot, assume_unique=True), np.setdiff1d(pivot, x, assume_unique=True)
    size = len(mine) + len(lacks)
    return size, np.concatenate([mine, lacks])[: widest(len(x), percent) + 1]


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int, pivots: bool = False) -> DataFrame:
    """cls, other of the pairs whose signatures let them be similar; for ``pivots`` also of those that differ in about n / 2 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for x, y, n, m in zip(b["_x"].to_pylist(), b["_y"].to_pylist(), b["n"].to_pylist(), b["m"].to_pylist(), strict=True):
                apart, ranges = unlike(x, y)
                may = 100 * min(n, m) >= percent * max(n, m) and apart * (100 + percent) <= (100 - percent) * (n + m)
                # as many differ on average if the sets differ in n / 2 windows
                stay.append(may or (pivots and 2 * abs(n - m) <= n and 2 * apart <= ranges * (1 - np.exp(-n / ranges))))
            yield b.select(["cls", "other"]).filter(pa.array(stay, pa.bool_()))

    one = classes.select("cls", F.col("sig").alias("_x"), "n")
    two = classes.select(F.col("cls").alias("other"), F.col("sig").alias("_y"), F.col("n").alias("m"))
    both = pairs.join(one, "cls").join(two, "other").select("cls", "other", "n", "m", "_x", "_y")
    return map_batches(both, run, "cls long, other long")


def _compared(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, differences: bool = False) -> DataFrame:
    """cls, other, linked, n, nd, tokens of every pair, compared once; the last two only if ``differences``.

    Sets are made again from the texts, which take a third of their bytes, and only for pairs that are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            linked, n, nd, tokens = [], [], [], []
            last, y = None, None
            mine = sets_of(b["_mine"].to_pylist(), k)
            for x, other, theirs in zip(mine, b["other"].to_pylist(), b["_theirs"], strict=True):
                if other != last:
                    last, y = other, next(sets_of([theirs.as_py()], k))
                size, prefix = _difference(x, y, percent) if differences else (0, x[:0])
                linked.append(similar(x, y, percent))
                n.append(len(x))
                nd.append(size)
                tokens.append(prefix.astype(np.int64))
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
            columns = [b["cls"], b["other"], pa.array(linked, pa.bool_()), pa.array(n, pa.int32()), pa.array(nd, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "other", "linked", "n", "nd", "tokens"])

    asked = pairs.select("cls").union(pairs.select("other")).distinct()
    asked = durable(asked.join(classes.select("cls", F.col("least").alias("doc_id"), "text_hash"), "cls"))
    texts = rows.join(small_side(asked, asked.count()), ["doc_id", "text_hash"]).select("cls", "_text")
    texts = durable(texts)  # one row a class but where a row repeats
    mine = pairs.join(texts.withColumnRenamed("_text", "_mine"), "cls")
    both = mine.join(texts.select(F.col("cls").alias("other"), F.col("_text").alias("_theirs")), "other")
    schema = "cls long, other long, linked boolean, n int, nd int, tokens array<long>"
    return map_batches(both.select("cls", "other", "_mine", "_theirs"), run, schema).dropDuplicates(["cls", "other"])


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, label: the least node reachable. Up to ``one_task`` links one task unites them; beyond, by rounds."""
    links = links.select("cls", "other").distinct()
    if links.limit(one_task + 1).count() <= one_task:
        return map_batches(links.coalesce(1), _united, "node long, label long")
    return _spread(links)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by the least node, over arrays: labels fall along all links until they rest."""
    got = [(b["cls"].to_numpy(), b["other"].to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        # roots of both ends meet, too, so that long chains shrink fast
        np.minimum.at(label, before[a], label[b])
        np.minimum.at(label, before[b], label[a])
        label = label[label]
        if (label == before).all():
            break
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], ["node", "label"])


def _spread(links: DataFrame) -> DataFrame:
    """Labels by rounds of hooking and jumping: the least grandparent seen goes to a node and to its parent.

    Roots of both ends of a link meet, so that a long path shrinks as fast as a broad group. A round that changes no
    grandparent ends it. Minima combine before they are shuffled.
    """
    one = links.select(F.col("cls").alias("node"), F.col("other").alias("to"))
    edges = durable(one.union(one.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())
    trees = durable(edges.groupBy("node").agg(F.min("to").alias("_m")).select("node", F.least("node", "_m").alias("up"), F.col("node").alias("top")))
    while True:
        seen = edges.join(trees.select(F.col("node").alias("to"), F.col("top").alias("_far")), "to")
        near = seen.groupBy("node").agg(F.min("_far").alias("_far"))
        met = trees.join(near, "node").select("node", "up", "top", F.least("_far", "top").alias("_far"))
        told = met.select("node", F.least("_far", "up").alias("up")).union(met.select(F.col("up").alias("node"), F.col("_far").alias("up")))
        hooked = durable(told.groupBy("node").agg(F.min("up").alias("up")).join(trees.select("node", F.col("top").alias("_was")), "node"))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        trees = durable(hooked.join(above, "up").select("node", "up", "top", "_was"))
        if trees.filter("top != _was or up != top").isEmpty():
            return trees.select("node", F.col("top").alias("label"))
        trees = trees.drop("_was")


def _with_comp(df: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).select(F.col("node").alias("cls"), F.col("label").alias("comp"))
    return df.join(durable(labels), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _several(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Rows whose ``keys`` have more than one value of ``what``."""
    keyed = df.groupBy(*keys).agg(F.min(what).alias("_a"), F.max(what).alias("_b")).filter("_a != _b")
    return df.join(written_side(keyed.select(*keys)), keys, "left_semi")


def _links(rows: DataFrame, classes: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """cls, other: links enough to make the components; ``met`` has token, cls, n, pos of windows that c sets share."""
    # pivots of long rows: the set of the most documents, then of the most such rows, heads one (what is varied
    # is often copied, too), and a set takes the head of most of its rows
    long_rows = met.filter(F.col("c") >= LONG_ROW).select("token", "cls")
    shared = long_rows.groupBy("cls").agg((-F.count("*")).alias("_few"))
    shared = shared.join(classes.select("cls", (-F.col("copies")).alias("_rare")), "cls")
    ranked = long_rows.join(durable(shared), "cls")
    heads = ranked.groupBy("token").agg(F.min(F.struct("_rare", "_few", "cls"))["cls"].alias("_head"))
    votes = long_rows.join(written_side(heads), "token").groupBy("cls", "_head").agg(F.count("*").alias("_n"))
    top = durable(votes.groupBy("cls").agg(F.max(F.struct("_n", "_head"))["_head"].alias("other")))
    for _ in range(3):  # a head that follows another one hands its sets on, so that a group has one pivot
        up = top.select(F.col("cls").alias("other"), F.col("other").alias("_up"))
        top = durable(top.join(up, "other", "left").select("cls", F.coalesce("_up", "other").alias("other")))
    pairs = durable(_suffix_filtered(top.filter("cls != other"), classes, percent, pivots=True))
    first = durable(_compared(rows, classes, pairs, k, percent, differences=True))
    near = first.filter("linked").select("cls", "other")

    bound = F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent))
    # no pivot for sets near the bound, and for those that have little to do with theirs
    apart = (F.col("nd") > bound) & (F.col("nd") <= F.col("n"))
    pivot = first.withColumn("pivot", F.when(F.col("linked") | apart, F.col("other")))
    # by difference from one pivot
    d = _with_comp(pivot.filter("pivot is not null").select("pivot", "cls", "n", "nd", F.posexplode("tokens").alias("pos", "token")), near)
    d = durable(_several(durable(d), ["pivot", "token"], "comp"))
    x, y = d.alias("x"), d.alias("y")
    most = 1 + F.least(F.col("x.nd") - F.col("x.pos"), F.col("y.nd") - F.col("y.pos")) - 1
    ok = (F.col("x.nd") + F.col("y.nd") - 2 * most) * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("x.cls") < F.col("y.cls"))
    same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token"))
    length = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    alike = x.join(y, same & apart & length & ok).select("x.cls", F.col("y.cls").alias("other"))

    # by their own windows, unless one pivot has parted them or one is the other's pivot: then both have one team
    m = _with_comp(met.join(pivot.select("cls", "pivot"), "cls", "left"), near)
    m = durable(m.select("token", "cls", "n", "pos", "comp", F.coalesce("pivot", "cls").alias("team")))
    teams = m.groupBy("token").agg(F.count("*").alias("_c"), F.countDistinct("team").alias("_teams"), F.min("comp").alias("_a"), F.max("comp").alias("_b"))
    teams = teams.filter("_a != _b and _teams > 1")
    m = durable(m.join(written_side(teams.select("token", (F.col("_c") > 2 * F.col("_teams")).alias("crowded"))), "token"))
    x, y = m.alias("x"), m.alias("y")
    settled = F.col("x.team") == F.col("y.team")
    ok = _may_link(percent, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    plain = (F.col("x.token") == F.col("y.token")) & apart & ok & ~settled & ~F.col("x.crowded") & ~F.col("y.crowded")
    other = x.join(y, plain).select("x.cls", F.col("y.cls").alias("other"))
    # few teams with many sets: a set meets teams, by their least and largest lengths, before it meets their sets
    crowd = m.filter("crowded")
    bounds = (F.max(F.col("n") - F.col("pos")).alias("room"), F.min("n").alias("small"), F.max("n").alias("large"))
    rival = crowd.groupBy("token", F.col("team").alias("rival")).agg(*bounds).alias("r")
    x = crowd.alias("x")
    length = 100 * F.least("x.n", "r.large") >= percent * F.greatest("x.n", "r.small")
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("r.room"))
    fits = length & (most * (100 + percent) >= percent * (F.col("x.n") + F.col("r.small")))
    duels = x.join(rival, (F.col("x.token") == F.col("r.token")) & (F.col("team") < F.col("rival")) & fits).select("x.*", "rival").alias("x")
    apart = (F.col("x.comp") != F.col("y.comp")) & _may_link(percent, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    rivals = duels.join(crowd.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rival") == F.col("y.team")) & apart)
    rivals = rivals.select(F.least("x.cls", "y.cls").alias("cls"), F.greatest("x.cls", "y.cls").alias("other"))
    done = first.select(F.least("cls", "other").alias("cls"), F.greatest("cls", "other").alias("other"))
    rest = alike.union(other).union(rivals).distinct().join(done, ["cls", "other"], "left_anti")
    rest = durable(_suffix_filtered(rest, classes, percent))
    if rest.isEmpty():
        return near
    more = _compared(rows, classes, rest, k, percent).filter("linked").select("cls", "other")
    return durable(near.union(more))


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64, to tell rows of one id apart) of every row."""
    rows = _texts(docs)
    facts = durable(_facts(rows, k))
    sketch = np.zeros(2 << SKETCH_BITS, np.int64)
    cells = facts.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    facts = facts.filter("cell is null").drop("cell")
    linkable = facts.filter("doc_id is not null and n > 0")
    one = F.min(F.struct("doc_id", "text_hash", "sig"))
    classes = linkable.groupBy("cls").agg(one.alias("_one"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = durable(classes.select("cls", F.col("_one.doc_id").alias("least"), "_one.text_hash", "_one.sig", "n", "copies"))
    first = classes.select(F.col("least").alias("doc_id"), "text_hash")
    n_classes = classes.count()
    live = rows.join(small_side(first, n_classes), ["doc_id", "text_hash"], "left_semi")
    row = Window.partitionBy("token", "salt")  # bounded: what very many sets hold is salted, and shared for sure
    found = _prefixes(live, k, percent, sketch.reshape(2, -1))
    met = found.withColumns({"a": F.min("cls").over(row), "b": F.max("cls").over(row), "c": F.count("*").over(row)})
    met = met.filter("a != b or salt > 0").withColumn("c", F.when(F.col("salt") > 0, F.lit(LONG_ROW)).otherwise(F.col("c")))
    met = durable(met.drop("a", "b", "salt"))
    groups = classes.select("cls", F.col("least").alias("component_id"))
    if not met.isEmpty():
        labels = durable(components(_links(rows, classes, met, k, percent))).select(F.col("node").alias("cls"), "label")
        named = durable(classes.select("cls", "least").join(labels, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label")))
        groups = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("cls", "component_id")
    out = facts.join(small_side(groups, n_classes), "cls", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_hash")
