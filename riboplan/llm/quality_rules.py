"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

The base counts are columns of the document; every rule compares one ratio of them with a bound. The
table is data (``Rule`` rows), so another table compiles into another projection.

Defined results: null text has no words; a document without words has all counts 0 and fails the base;
null ``doc_id`` is passed through; repeated rows and equal ids are judged row by row; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, words_of

# Function words by which running prose is told from lists and noise.
STOP_WORDS = {
    "en": "the of and to in is that for on with as at by it be are this was".split(),
    "de": "der die das und ist von mit den ein im zu auf für sich dem des".split(),
    "fr": "le la les de des du et est un une que qui dans pour par au en sur".split(),
    "es": "el la los las de del en una un y es por con se que para su al".split(),
}


class Rule(NamedTuple):
    """The document is kept only if ``low <= metric <= high`` (None: no bound)."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The default table.
RULES = (
    Rule("length", "n_words", 10, None),
    Rule("mean_word_length", "word_chars / n_words", 2.5, 10.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.03, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
)


def _with_words(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select("doc_id", text.alias("_text"), words_of(F.col("text")).alias("_words"))


def _windows(n: int) -> Column:
    """64-bit name of each window of n consecutive words (chained over the words, so word borders count)."""
    w = F.col("_words")
    size = F.size(w)
    names = F.transform(
        F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
    )
    return F.when(size >= n, names).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(n: int) -> Column:
    """Words covered by windows of n words that occur twice or more.

    Only texts with some repeated window take the second branch: (name, place) pairs are sorted, a place
    repeats if a neighbour has its name, and sorted places add min(n, distance to the next) words each.
    """
    names = F.col("_names")
    pairs = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    at = lambda a, i: F.get(a, i)["x"]
    same = lambda a: F.filter(a, lambda p, k: (p["x"] == at(a, k - 1)) | (p["x"] == at(a, k + 1)))
    places = F.array_sort(F.transform(same(F.col("_pairs")), lambda p: p["i"]))
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-(2**30)).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return pairs, places, covered, F.size(F.array_distinct(names)) < F.size(names)


def base_counts(df: DataFrame, window: int = 5, symbols: str = "#*$%&|<>") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words.

    ``n_repeat_words`` counts the words inside windows of ``window`` words that occur twice or more.
    """
    pairs, places, covered, some = _repeated_words(window)
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    return (
        _with_words(df)
        .withColumns({"_names": _windows(window), "_lines": lines})
        .withColumn("_pairs", F.when(some, pairs).otherwise(none))
        .withColumn("_places", F.when(F.size("_pairs") > 0, places).otherwise(F.array().cast("array<int>")))
        .select(
            "doc_id",
            F.size("_words").cast("bigint").alias("n_words"),
            F.length(F.regexp_replace("_text", WHITE, "")).cast("bigint").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", symbols, ""))).cast("bigint").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.size(F.filter("_words", lambda x: F.lower(x).isin(stop))).cast("bigint").alias("n_stop_words"),
        )
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """A boolean column per rule; a ratio over zero passes, for the length rule judges that case."""
    out = {}
    for r in rules:
        top, _, below = (x.strip() for x in r.metric.partition("/"))
        over = F.col(below) if below else F.lit(1)
        value = F.when(over > 0, F.col(top) / over)
        bounds = [value >= r.low] * (r.low is not None) + [value <= r.high] * (r.high is not None)
        ok = F.lit(True)
        for b in bounds:
            ok = ok & F.coalesce(b, F.lit(True))
        out[f"ok_{r.name}"] = ok
    return out


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base counts, ``base_failed``, one verdict per rule, and ``kept``."""
    verdicts = compile_rules(rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    all_ok = F.lit(True)
    for name in verdicts:
        all_ok = all_ok & F.col(name)
    return (
        base_counts(df)
        .withColumns({"base_failed": failed, **verdicts})
        .withColumn("kept", ~F.col("base_failed") & all_ok)
    )
