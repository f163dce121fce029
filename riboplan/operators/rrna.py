"""Anti-filter of reads that share many k-mers with a set of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riboplan.functions import kmer_arrays as ka
from riboplan.functions.seq import kmers
from riboplan.session import within

#: k-mers up to which the set is sent to all tasks.
BROADCAST_KMERS = 2_000_000
#: Longest k-mer over ACGTN with a 64-bit code.
CODED_K = 27


def _dna(seq: str):
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def kmer_set(seqs: DataFrame, k: int = 18) -> DataFrame:
    """kmer: the distinct k-mers, upper case, U read as T; an empty source raises instead of filtering nothing."""
    return seqs.select(F.explode(F.transform(kmers(_dna("seq"), k), lambda x: x["kmer"])).alias("kmer")).distinct()


def kmer_hits(reads: DataFrame, kmer_source: DataFrame, k: int = 18) -> DataFrame:
    """ordinal, hits: places of a read (forward strand only) whose k-mer is in the set; reads without one are left out.

    A set of at most BROADCAST_KMERS goes to all tasks, and a read's places are counted where it lies; a larger
    one, or longer k-mers, meet the reads' k-mers in a shuffled join.
    """
    rows = reads.select("ordinal", _dna("seq").alias("seq"))
    if k > CODED_K or not within(kmer_source, BROADCAST_KMERS):
        own = rows.select("ordinal", F.explode(F.transform(kmers(F.col("seq"), k), lambda x: x["kmer"])).alias("kmer"))
        return own.join(kmer_source, "kmer").groupBy("ordinal").agg(F.count("*").alias("hits"))
    source = [x.encode() for x in kmer_source.select("kmer").toArrow()["kmer"].to_pylist()]
    code = ka.fifths(np.frombuffer(b"\n".join([*source, b""]), np.uint8), k)[:: k + 1] if source else np.zeros(0, np.int64)
    coded = np.unique(code[code != ka.NO_CODE])
    others = frozenset(x for x, c in zip(source, code.tolist(), strict=True) if c == ka.NO_CODE)
    sent = reads.sparkSession.sparkContext.broadcast((coded, others))  # at most BROADCAST_KMERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, others = sent.value
        for b in batches:
            seqs = [s or b"" for s in b["seq"].cast(pa.binary()).to_pylist()]
            hits = np.zeros(len(seqs), np.int64)
            for r in ka.runs(seqs) if len(coded) else ():
                code = ka.fifths(r.letters, k)
                at = np.minimum(np.searchsorted(coded, code), len(coded) - 1)
                row = np.repeat(np.arange(len(r.sizes)), r.sizes + 1)[: len(code)]
                hits[r.first : r.first + len(r.sizes)] += np.bincount(row[coded[at] == code], minlength=len(r.sizes))
            for i, s in enumerate(seqs) if others else ():
                hits[i] += sum(s[j : j + k] in others for j in range(len(s) - k + 1))
            some = pa.array(hits > 0)
            yield pa.RecordBatch.from_arrays([b["ordinal"], pa.array(hits)], ["ordinal", "hits"]).filter(some)

    return rows.mapInArrow(run, T.StructType([rows.schema["ordinal"], T.StructField("hits", T.LongType())]))


def keep_reads(reads: DataFrame, kmer_source: DataFrame, k: int = 18, min_hits: int = 50) -> DataFrame:
    """Reads with fewer than ``min_hits`` places in the set."""
    hit = kmer_hits(reads, kmer_source, k).filter(F.col("hits") >= min_hits).select("ordinal")
    return reads.join(hit, "ordinal", "left_anti")


def keep_pairs(pairs: DataFrame, kmer_source: DataFrame, k: int = 18, min_hits: int = 50) -> DataFrame:
    """Pairs (ordinal, seq1, seq2) of which neither mate reaches ``min_hits``."""
    mates = pairs.select("ordinal", F.explode(F.array(F.struct(F.lit(1).alias("m"), F.col("seq1").alias("seq")), F.struct(F.lit(2).alias("m"), F.col("seq2").alias("seq")))).alias("x"))
    mates = mates.select(F.struct("ordinal", "x.m").alias("ordinal"), "x.seq")
    hit = kmer_hits(mates, kmer_source, k).filter(F.col("hits") >= min_hits).select(F.col("ordinal.ordinal").alias("ordinal")).distinct()
    return pairs.join(hit, "ordinal", "left_anti")


def report(examined: DataFrame, kept: DataFrame) -> DataFrame:
    """examined, filtered, retained, percent_filtered."""
    a = examined.agg(F.count("*").alias("examined")).crossJoin(kept.agg(F.count("*").alias("retained")))
    gone = F.col("examined") - F.col("retained")
    percent = F.when(F.col("examined") > 0, 100.0 * gone / F.col("examined")).otherwise(F.lit(0.0))
    return a.select("examined", gone.alias("filtered"), "retained", percent.alias("percent_filtered"))
