"""Chains of neighbouring co-expressed features: coverage, adjacency, merging, scores, consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riboplan.functions.scoring import clamp, confidence, coverage_ratio

from .intervals import overlap_join


def gene_coverage(spans: DataFrame, genes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, gene_id, coverage: bases of the reads' reference spans within a gene over its length.

    Genes have 1-based inclusive ``start`` and ``end``; spans are half-open. Summed per gene, so that a hot
    gene is combined before the shuffle; no depth cap applies.
    """
    g = genes.select("gene_id", "chrom", (F.col("start") - 1).cast("bigint").alias("r_start"), F.col("end").cast("bigint").alias("r_end"))
    bases = overlap_join(spans.withColumnRenamed("contig", "chrom"), g, ["chrom"]).groupBy(*by, "gene_id").agg(F.sum("overlap").alias("bases"))
    every = genes.select("gene_id", F.greatest(F.lit(1), F.col("end") - F.col("start") + 1).alias("_len"))
    if by:
        every = F.broadcast(spans.select(*by).distinct()).crossJoin(every)  # a row a sample
    mean = F.coalesce(F.col("bases") / F.col("_len"), F.lit(0.0))
    return every.join(bases, [*by, "gene_id"], "left").select(*by, "gene_id", mean.alias("coverage"))


def directon_order(genes: DataFrame) -> DataFrame:
    """Adds ``rank`` along each (chrom, strand): ascending starts on +, descending ends on -; ties by ``ord``."""
    along = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end"))
    w = Window.partitionBy("chrom", "strand").orderBy("_along", "ord")
    return genes.withColumn("_along", along).withColumn("rank", F.row_number().over(w)).drop("_along")


def _previous(name: str, by: Sequence[str]) -> Column:
    return F.lag(name).over(Window.partitionBy(*by, "chrom", "strand").orderBy("rank"))


def adjacent(genes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranked genes with prev_id, igd (bases between neighbours, negative if they overlap) and prev_coverage."""
    igd = F.when(F.col("strand") == "+", F.col("start") - _previous("end", by) - 1).otherwise(_previous("start", by) - F.col("end") - 1)
    more = {"prev_coverage": _previous("coverage", by)} if "coverage" in genes.columns else {}
    return genes.withColumns({"prev_id": _previous("gene_id", by), "igd": igd, **more})


def same_operon(max_igd: int = 70, min_coverage: float = 0.5, min_ratio: float = 0.25) -> Column:
    """Whether a gene continues the chain of the one before it."""
    both = (F.col("coverage") >= min_coverage) & (F.col("prev_coverage") >= min_coverage)
    return F.coalesce((F.col("igd") <= max_igd) & both & (coverage_ratio(F.col("coverage"), F.col("prev_coverage")) >= min_ratio), F.lit(False))


def chains(linked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``chain``: a new one starts wherever ``linked`` is false."""
    w = Window.partitionBy(*by, "chrom", "strand").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return linked.withColumn("chain", F.sum((~F.col("linked")).cast("int")).over(w))


def operon_rows(chained: DataFrame, by: Sequence[str] = (), max_igd: int = 70) -> DataFrame:
    """One row a chain: bounds, genes in order, distances, coverage statistics, score and confidence."""
    gene = F.struct("rank", "gene_id", F.when(F.col("linked"), F.col("igd")).alias("igd"))
    out = chained.groupBy(*by, "chrom", "strand", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_genes"),
        F.array_sort(F.collect_list(gene)).alias("_g"),
        F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"),
        F.stddev_pop("coverage").alias("_sd"), F.avg(F.when(F.col("linked"), F.col("igd"))).alias("_igd"),
        F.min(F.struct("rank", "start")).alias("_first"),
    )
    mean = F.col("mean_coverage")
    cv = F.when(mean > 0, F.col("_sd") / mean).otherwise(F.lit(0.0))
    raw = (1 - F.col("_igd") / max_igd) * (F.col("min_coverage") / mean) / (1 + F.col("coverage_cv"))
    score = F.when(F.col("_igd").isNull() | (mean <= 0), F.lit(0.0)).otherwise(clamp(raw, 0.0, 1.0))
    igds = F.transform(F.filter("_g", lambda x: x["igd"].isNotNull()), lambda x: x["igd"].cast("string"))
    return (
        out.withColumn("coverage_cv", cv)
        .withColumn("score", score)
        .withColumns({
            "confidence": confidence(F.col("score")),
            "gene_ids": F.array_join(F.transform("_g", lambda x: x["gene_id"]), ","),
            "igds": F.array_join(igds, ","),
            "first_start": F.col("_first.start"),
        })
        .drop("_g", "_sd", "_igd", "_first")
    )


def numbered(operons: DataFrame, by: Sequence[str] = (), min_score: float = 0.0) -> DataFrame:
    """Operons at or above ``min_score`` with ``operon_id``, numbered in directon order after the filter.

    One sample's operons are numbered in one order, which takes one task a sample; they are as few as genes.
    """
    kept = operons.filter(F.col("score") >= min_score)
    directon = F.min("first_start").over(Window.partitionBy(*by, "chrom", "strand"))
    lead = kept.withColumn("_lead", directon)
    w = Window.partitionBy(*by).orderBy("chrom", "_lead", "strand", "chain")
    return lead.withColumn("operon_id", F.concat(F.lit("operon_"), F.row_number().over(w).cast("string"))).drop("_lead", "first_start", "chain")


def infer(genes: DataFrame, coverage: DataFrame, by: Sequence[str] = (), max_igd: int = 70, min_coverage: float = 0.5, min_ratio: float = 0.25) -> DataFrame:
    """All chains of every sample, not yet filtered or numbered."""
    rows = directon_order(genes).join(coverage, "gene_id")
    linked = adjacent(rows, by).withColumn("linked", same_operon(max_igd, min_coverage, min_ratio))
    return operon_rows(chains(linked, by), by, max_igd)


def pair_support(genes: DataFrame, coverage: DataFrame, sample: str = "sample", max_igd: int = 70, min_coverage: float = 0.5, min_ratio: float = 0.25) -> DataFrame:
    """prev_id, gene_id, support: the share of samples in which a neighbouring pair passes."""
    rows = adjacent(directon_order(genes).join(coverage, "gene_id"), [sample])
    passed = same_operon(max_igd, min_coverage, min_ratio).cast("int")
    return rows.filter("prev_id is not null").groupBy("prev_id", "gene_id").agg((F.sum(passed) / F.count("*")).alias("support"))


def consensus(genes: DataFrame, coverage: DataFrame, sample: str = "sample", min_support: float = 0.6, **rules) -> DataFrame:
    """Chains of pairs that enough samples support, scored on the mean coverage over samples."""
    if not 0 <= min_support <= 1:
        raise ValueError("min_support must be between 0 and 1")
    mean = coverage.groupBy("gene_id").agg(F.avg("coverage").alias("coverage"))
    rows = adjacent(directon_order(genes).join(mean, "gene_id"))
    support = pair_support(genes, coverage, sample, **rules)
    linked = rows.join(support, ["prev_id", "gene_id"], "left")
    ok = F.col("prev_id").isNotNull() & (F.coalesce("support", F.lit(0.0)) >= min_support)
    return operon_rows(chains(linked.withColumn("linked", ok)), max_igd=rules.get("max_igd", 70))
