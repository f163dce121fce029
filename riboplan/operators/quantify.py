"""Fragments, their assignment to features, counts and normalised expression.

Alignments come as rows (sample, qname, arrival, is_secondary, is_supplementary, is_unmapped, contig) and
their blocks as rows (..., start, end); several samples go through one plan, keyed by sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riboplan.session import within

from .intervals import BROADCAST_FEATURES, merge_intervals, overlap_join

STATUSES = ("assigned", "unmapped", "no_feature", "ambiguous", "insufficient_overlap")


def record_class(secondary: Column, supplementary: Column) -> Column:
    """secondary, supplementary or primary; the secondary flag wins."""
    return F.when(secondary, "secondary").when(supplementary, "supplementary").otherwise("primary")


def pair_mates(primary: DataFrame, keys: Sequence[str] = ("qname",), order: Sequence[str] = ("arrival",)) -> DataFrame:
    """Adds ``frag`` and ``mate``: records of one name pair up in their order, a third one opens a new fragment."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return primary.withColumn("_rn", rn).withColumns({"frag": F.floor((F.col("_rn") - 1) / 2), "mate": (F.col("_rn") - 1) % 2 + 1}).drop("_rn")


def strict_fragments(primary: DataFrame, keys: Sequence[str] = ("qname",)) -> DataFrame:
    """Mates by their labels: one row a name with read1 and read2 structs; two primary records of one mate raise."""
    slot = F.when(F.col("mate_number") == 2, 2).otherwise(1)
    rest = F.struct(*[c for c in primary.columns if c not in keys])
    g = primary.withColumns({"_slot": slot, "_row": rest}).groupBy(*keys)
    of = lambda k: F.max(F.when(F.col("_slot") == k, F.col("_row")))
    twice = F.greatest(F.sum((F.col("_slot") == 1).cast("int")), F.sum((F.col("_slot") == 2).cast("int"))) > 1
    out = g.agg(of(1).alias("read1"), of(2).alias("read2"), twice.alias("_twice"))
    checked = F.when(F.col("_twice"), F.raise_error(F.lit("duplicate primary record of one mate"))).otherwise(F.col("read1"))
    return out.withColumn("read1", checked).drop("_twice")


def fragments(mates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a fragment: n_mates, n_mapped, n_contigs (over mapped mates)."""
    mapped = ~F.col("is_unmapped")
    return mates.groupBy(*keys).agg(
        F.count("*").alias("n_mates"),
        F.sum(mapped.cast("int")).alias("n_mapped"),
        F.count_distinct(F.when(mapped, F.col("contig"))).alias("n_contigs"),
    )


def fragment_stats(records: DataFrame, frags: DataFrame) -> DataFrame:
    """One row of counters over records and fragments."""
    kind = record_class(F.col("is_secondary"), F.col("is_supplementary"))
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    a = records.agg(
        F.count("*").alias("records"), n(kind == "secondary", "secondary"), n(kind == "supplementary", "supplementary"),
        n(kind == "primary", "primary_records"),
    )
    paired = F.col("n_mates") == 2
    b = frags.agg(
        F.count("*").alias("fragments"), n(paired, "paired"), n(~paired, "orphans"),
        n(paired & (F.col("n_mapped") == 2), "fully_mapped"), n(paired & (F.col("n_mapped") == 1), "partially_mapped"),
        n(F.col("n_mapped") == 0, "unmapped"), n((F.col("n_mapped") == 2) & (F.col("n_contigs") > 1), "discordant_contig"),
    )
    return a.crossJoin(b)  # one row each


Home = tuple[int, Sequence[str]]


def _overlapping(blocks: DataFrame, f: DataFrame, home: Home | None) -> DataFrame:
    """Overlaps, brought home (number of partitions and columns by which the fragments lie) if the join took them elsewhere."""
    if home is None:
        return overlap_join(blocks, f, ["contig"])
    small = within(f, BROADCAST_FEATURES)
    rows = overlap_join(blocks, f, ["contig"], broadcast_rows=BROADCAST_FEATURES if small else -1, parts=home[0])
    return rows if small else rows.repartition(home[0], *home[1])


def mate_overlaps(blocks: DataFrame, features: DataFrame, keys: Sequence[str], home: Home | None = None) -> DataFrame:
    """keys, mate, gene_id, overlap: bases of a mate's blocks within a feature's blocks."""
    f = features.select("gene_id", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return _overlapping(blocks, f, home).groupBy(*keys, "mate", "gene_id").agg(F.sum("overlap").alias("overlap"))


def mate_detail(overlaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gene_id, read1_overlap, read2_overlap, total_overlap, supporting_reads."""
    of = lambda m: F.coalesce(F.sum(F.when(F.col("mate") == m, F.col("overlap"))), F.lit(0))
    return overlaps.groupBy(*keys, "gene_id").agg(
        of(1).alias("read1_overlap"), of(2).alias("read2_overlap"),
        F.sum("overlap").alias("total_overlap"), F.count_distinct("mate").alias("supporting_reads"),
    )


def union_overlaps(blocks: DataFrame, features: DataFrame, keys: Sequence[str], home: Home | None = None) -> DataFrame:
    """keys, gene_id, overlap of the union of both mates' blocks, so that bases under both count once."""
    merged = merge_intervals(blocks, [*keys, "contig"])
    f = features.select("gene_id", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return _overlapping(merged, f, home).groupBy(*keys, "gene_id").agg(F.sum("overlap").alias("overlap"))


def assign(frags: DataFrame, overlaps: DataFrame, keys: Sequence[str], min_overlap: int = 1, largest: bool = False, parts: int | None = None) -> DataFrame:
    """keys, status, gene_id: features that more mates support come first; then the least overlap decides.

    With ``largest`` the single largest overlap wins and a tie is ambiguous; otherwise two eligible
    features are ambiguous. The per-gene aggregate and both windows share one partitioning. Fragments and
    verdicts meet in ``parts`` partitions where the caller knows how many hold them: Spark joins only sides that
    lie by all keys and takes others to the session's number of partitions; it moves the fragments to the verdicts.
    """
    if min_overlap < 1:
        raise ValueError("min_overlap must be at least 1")
    w = Window.partitionBy(*keys)
    genes = overlaps.groupBy(*keys, "gene_id").agg(F.sum("overlap").alias("ov"), F.count_distinct("mate").alias("nm"))
    genes = genes.withColumn("_most", F.max("nm").over(w)).filter("nm = _most")
    ok = F.col("ov") >= min_overlap
    genes = genes.withColumn("_best", F.max(F.when(ok, F.col("ov"))).over(w))
    wins = ok & (F.col("ov") == F.col("_best")) if largest else ok
    verdict = genes.groupBy(*keys).agg(
        F.sum(ok.cast("int")).alias("_ok"), F.sum(F.coalesce(wins, F.lit(False)).cast("int")).alias("_n"),
        F.max(F.when(wins, F.col("gene_id"))).alias("_gene"),
    )
    status = (
        F.when(F.col("n_mapped") == 0, "unmapped")
        .when(F.col("_ok").isNull(), "no_feature")
        .when(F.col("_ok") == 0, "insufficient_overlap")
        .when(F.col("_n") == 1, "assigned")
        .otherwise("ambiguous")
    )
    if parts:
        verdict = verdict.repartition(parts, *keys)
    out = frags.join(verdict, list(keys), "left").withColumn("status", status)
    return out.select(*keys, "status", F.when(F.col("status") == "assigned", F.col("_gene")).alias("gene_id"))


def summary(assigned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = [F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).alias(s) for s in STATUSES]
    out = assigned.groupBy(*by).agg(*n, F.count("*").alias("total_fragments"))
    rate = F.when(F.col("total_fragments") > 0, F.col("assigned") / F.col("total_fragments")).otherwise(F.lit(0.0))
    return out.withColumn("assignment_rate", rate)


def feature_lengths(features: DataFrame) -> DataFrame:
    """gene_id, contig, strand, n_blocks, length after merging a feature's blocks; mixed contigs or strands raise."""
    one = features.groupBy("gene_id").agg(F.count_distinct("contig").alias("a"), F.count_distinct("strand").alias("b"))
    bad = F.when((F.col("a") > 1) | (F.col("b") > 1), F.raise_error(F.lit("a feature lies on several contigs or strands"))).otherwise(F.lit(True))
    merged = merge_intervals(features.select("gene_id", "contig", "strand", "start", "end"), ["gene_id", "contig", "strand"])
    length = F.sum(F.col("end") - F.col("start")).alias("length")
    out = merged.groupBy("gene_id", "contig", "strand").agg(F.count("*").alias("n_blocks"), length)
    return out.join(one.select("gene_id", bad.alias("_ok")), "gene_id").filter("_ok").drop("_ok")


def gene_counts(assigned: DataFrame, lengths: DataFrame, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """by, gene_id, length, count, with a zero for every feature (and sample) without a fragment.

    Fragments are counted where they lie before they move; then counts and features meet in ``parts`` partitions.
    """
    n = assigned.filter("status = 'assigned'").groupBy(*by, "gene_id").agg(F.count("*").alias("count"))
    every = lengths.select("gene_id", "length")
    if by:
        every = F.broadcast(assigned.select(*by).distinct()).crossJoin(every)  # a row a sample
    if parts:
        n = n.repartition(parts, *by, "gene_id")  # the features follow
    return every.join(n, [*by, "gene_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def normalise(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds rpkm and tpm; totals are aggregated first and joined back, one row a sample."""
    rpk = F.col("count") / (F.col("length") / 1000)
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_total"), F.sum(rpk).alias("_rpk"))
    rows = counts.join(F.broadcast(totals), list(by)) if by else counts.crossJoin(F.broadcast(totals))
    rpkm = F.when((F.col("_total") > 0) & (F.col("length") > 0), 1e9 * F.col("count") / (F.col("_total") * F.col("length"))).otherwise(F.lit(0.0))
    tpm = F.when(F.col("_rpk") > 0, rpk / F.col("_rpk") * 1e6).otherwise(F.lit(0.0))
    return rows.withColumns({"rpkm": rpkm, "tpm": tpm}).drop("_total", "_rpk")


def expression_matrix(values: DataFrame, samples: Sequence[str], measures: Sequence[str] = ("count", "rpkm", "tpm")) -> DataFrame:
    """gene_id, length_bp, then <sample>_<measure>, with zeros where a sample lacks a feature."""
    aggs = [F.coalesce(F.first(m), F.lit(0)).alias(m) for m in measures]
    wide = values.groupBy("gene_id", F.col("length").alias("length_bp")).pivot("sample", list(samples)).agg(*aggs)
    return wide.fillna(0) if len(measures) > 1 else wide.toDF("gene_id", "length_bp", *[f"{s}_{measures[0]}" for s in samples]).fillna(0)


def invariants(assigned: DataFrame, counts: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """invariant, got, want: what a finished run must agree on, a row each.

    counts: gene_id, count, one row a feature; lengths: the features; stats: the row of ``fragment_stats``.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    a = assigned.agg(n(F.col("status") == "assigned").alias("assigned"), n(F.col("status") == "unmapped").alias("none"), F.count("*").alias("total"))
    b = counts.agg(n(F.col("count")).alias("sum"), n(F.col("count") < 0).alias("negative"), (F.count("*") - F.count_distinct("gene_id")).alias("twice"))
    sides = lengths.select("gene_id", F.lit(True).alias("_f")).distinct().join(counts.select("gene_id", F.lit(True).alias("_c")).distinct(), "gene_id", "full")
    c = sides.agg(n(F.col("_c").isNull()).alias("missing"), n(F.col("_f").isNull()).alias("unknown"))
    rows = a.crossJoin(b).crossJoin(c).crossJoin(stats.select("fragments", F.col("unmapped").alias("unmapped_fragments")))  # one row each
    checks = {
        "counts sum to the assigned fragments": ("sum", "assigned"), "no count is negative": ("negative", None), "each feature has one count": ("twice", None),
        "each feature is counted": ("missing", None), "each count has a feature": ("unknown", None),
        "each fragment has a status": ("total", "fragments"), "fragments without a mapped mate are unmapped": ("none", "unmapped_fragments"),
    }
    row = lambda name, got, want: F.struct(F.lit(name).alias("invariant"), F.col(got).cast("bigint").alias("got"), (F.col(want) if want else F.lit(0)).cast("bigint").alias("want"))
    return rows.select(F.inline(F.array(*[row(name, *sides) for name, sides in checks.items()])))


def violations(assigned: DataFrame, counts: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """Names of the invariants that do not hold: no row means that all hold."""
    return invariants(assigned, counts, lengths, stats).filter("got <> want").select(F.col("invariant").alias("violation"))
