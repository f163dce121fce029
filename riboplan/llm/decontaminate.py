"""Benchmark decontamination: containment search by size-partitioned MinHash, in Spark expressions only.

Words are the runs of letters and digits, in lower case; a set is the distinct windows of five words.
An item of m windows is contained in a document if the document has at least 0.8 m of them, wherever
they stand; so short items are found inside long documents, whose own size does not matter.

Sketch: an item keeps its k smallest window hashes, its MinHash values. A document that holds 0.8 m
windows lacks at most floor(m / 5), so with k = floor(m / 5) + 1 it meets at least one kept value: no
contained item is missed. Items are partitioned by size (powers of two); each partition fixes the least
number of windows a document needs to hold any of its items, and smaller documents skip it. Candidate
pairs are verified by the exact windows as strings.

Defined results: null and empty texts have no windows; an item with fewer than five words has none and
is contained in nothing; null ids match nothing; of several rows with one (doc_id, item_id) the largest
containment is reported; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small_side

WINDOW = 5
SHARE = 0.8


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def _each_window(words: Column, of) -> Column:
    """``of`` (a function of a list of columns) over every window of WINDOW words.

    The words are bound to a lambda's variable: they are made once, however the optimizer moves this.
    """

    def windows(ws: Column) -> Column:
        n = F.size(ws) - WINDOW
        places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: of([F.get(ws, i + k) for k in range(WINDOW)]))

    return F.get(F.transform(F.array(words), windows), 0)


def hashed(words: Column) -> Column:
    return _each_window(words, lambda ws: F.xxhash64(*ws))


def spelled(words: Column) -> Column:
    return F.array_distinct(_each_window(words, lambda ws: F.concat_ws(" ", *ws)))


#: Bytes of all items' windows up to which they are sent to all tasks; beyond it they meet the documents in a shuffle.
BROADCAST_BYTES = 64_000_000


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, windows (strings), m, need (least count), size_class."""
    m = F.size("windows")
    return (
        benchmark.filter("item_id is not null")
        .select("item_id", tokens(F.col("text")).alias("_words"))
        .select("item_id", spelled(F.col("_words")).alias("windows"), F.array_distinct(hashed(F.col("_words"))).alias("_hashes"))
        .withColumns({"m": m, "need": F.ceil(m * 4 / 5).cast("int"), "size_class": F.floor(F.log2(m.cast("double"))).cast("int")})
        .filter("m > 0")
    )


def sketch(items: DataFrame) -> DataFrame:
    """h, item_id, least: the MinHash values of every item and the least windows its size class asks for."""
    k = F.floor(F.size("_hashes") / 5).cast("int") + 1
    kept = F.slice(F.sort_array("_hashes"), F.lit(1), k)
    least = F.ceil(F.pow(F.lit(2), F.col("size_class")) * 4 / 5).cast("int")
    return items.select("item_id", least.alias("least"), F.explode(kept).alias("h"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above the share."""
    items = durable(_items(benchmark))
    sk = sketch(items)
    sides = sk.count()
    texts = docs.filter("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("_words"))
    # explode_outer, for explode would infer a filter on the size and make the windows twice
    seen = texts.select("doc_id", hashed(F.col("_words")).alias("_hashes")).select(
        "doc_id", F.size("_hashes").alias("_n"), F.explode_outer("_hashes").alias("h")
    )
    pairs = durable(
        seen.join(small_side(sk, sides), "h").filter(F.col("_n") >= F.col("least")).select("doc_id", "item_id").distinct()
    )
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("_items"))
    windows = items.select("item_id", "windows", "m", "need")
    size = items.agg(F.coalesce(F.sum(F.length(F.concat_ws("", "windows")) + 16 * F.size("windows")), F.lit(0))).first()[0]
    windows = F.broadcast(windows) if size <= BROADCAST_BYTES else windows
    rows = (
        texts.join(small_side(by_doc, pairs.count(), 200_000), "doc_id")
        .select("doc_id", "_items", spelled(F.col("_words")).alias("_mine"))
        .select("doc_id", "_mine", F.explode("_items").alias("item_id"))
    )
    shared = F.size(F.array_intersect("_mine", "windows"))
    return (
        rows.join(windows, "item_id")
        .select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.col("m").cast("long").alias("n_item"), "need")
        .filter(F.col("n_shared") >= F.col("need"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("_best"))
        .select("doc_id", "item_id", "_best.n_shared", "_best.n_item", "_best.containment")
    )
