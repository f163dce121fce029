"""Columns over nucleotide strings: complements, k-mer codes, names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest k-mer whose two-bit code fits a BIGINT.
MAX_K = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a column to a lambda's variable, so that it is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGTN (either case) stay as they are."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def read_name(name: Column) -> Column:
    """The part before the first space."""
    return F.substring_index(name, " ", 1)


def strip_mate(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")


def encode_kmer(kmer: Column) -> Column:
    """Two bits a base, A 0 to T 3; null if another letter occurs."""
    digits = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")
    return F.when(kmer.rlike("^[ACGT]+$"), digits)


def canonical_code(kmer: Column) -> Column:
    """The lesser of the codes of a k-mer and its reverse complement."""
    return F.least(encode_kmer(kmer), encode_kmer(revcomp(kmer)))


def canonical_kmer(kmer: Column) -> Column:
    return F.when(kmer.rlike("^[ACGT]+$"), F.least(kmer, revcomp(kmer)))


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """All k-mers at every ``step``-th place, as structs (pos, kmer)."""
    last = F.length(seq) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))


def sample_name(path: Column, any_case: bool = False) -> Column:
    """File name without .bam or .sorted.bam."""
    flag = "(?i)" if any_case else ""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), flag + r"(\.sorted)?\.bam$", "")


def chunked(items: Iterable, n: int) -> Iterator[list]:
    """Lists of n items; the last may be shorter."""
    if n <= 0:
        raise ValueError("chunk size must be positive")
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part
