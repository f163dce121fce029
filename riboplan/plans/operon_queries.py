"""Named queries of coverage, adjacency, chains and consensus, with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riboplan.operators import operons as op

from .views import spark_view, with_views


def genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes with 1-based inclusive bounds."""
    f = spark_view(spark, d, "features")
    return f.select("gene_id", F.col("contig").alias("chrom"), "strand", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"), "ord")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Reference spans of the mapped primary and supplementary records."""
    r = spark_view(spark, d, "alignments").filter("not is_secondary and not is_unmapped")
    return r.select("sample", "contig", F.col("start0").alias("start"), (F.col("start0") + 100 + F.col("gap")).alias("end"))


def _coverage(spark, d, by=()):
    return op.gene_coverage(spans(spark, d), genes(spark, d), by)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def gene_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_coverage(spark, d), "coverage")


def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_coverage(spark, d, ("sample",)), "coverage")


def directon_order(spark: SparkSession, d: str) -> DataFrame:
    return op.directon_order(genes(spark, d)).select("gene_id", "chrom", "strand", "rank")


def intergenic_distance(spark: SparkSession, d: str) -> DataFrame:
    return op.adjacent(op.directon_order(genes(spark, d))).filter("prev_id is not null").select("prev_id", "gene_id", "igd")


def _chained(spark, d):
    rows = op.adjacent(op.directon_order(genes(spark, d)).join(_coverage(spark, d), "gene_id"))
    return op.chains(rows.withColumn("linked", op.same_operon()))


def operon_chains(spark: SparkSession, d: str) -> DataFrame:
    return _chained(spark, d).select("gene_id", "chrom", "strand", "rank", "linked", "chain")


_ROUND = ("mean_coverage", "min_coverage", "coverage_cv", "score")


def operon_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(op.operon_rows(_chained(spark, d)), *_ROUND)


def operons_numbered(spark: SparkSession, d: str) -> DataFrame:
    out = op.numbered(op.infer(genes(spark, d), _coverage(spark, d)), min_score=0.1)
    return _rounded(out, *_ROUND)


def operons_by_sample(spark: SparkSession, d: str) -> DataFrame:
    out = op.numbered(op.infer(genes(spark, d), _coverage(spark, d, ("sample",)), ("sample",)), ("sample",))
    return _rounded(out, *_ROUND)


def pair_support(spark: SparkSession, d: str) -> DataFrame:
    return op.pair_support(genes(spark, d), _coverage(spark, d, ("sample",)))


def consensus_operons(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(op.consensus(genes(spark, d), _coverage(spark, d, ("sample",))), *_ROUND)


QUERIES = {
    f.__name__: f
    for f in (
        gene_coverage, sample_coverage, directon_order, intergenic_distance, operon_chains, operon_scores, operons_numbered,
        operons_by_sample, pair_support, consensus_operons,
    )
}

_GENES = "SELECT gene_id, contig chrom, strand, start0+1 s, end0 e, ord FROM v_features"
_SPANS = "SELECT sample, contig chrom, start0 s, start0+100+gap e FROM v_alignments WHERE NOT is_secondary AND NOT is_unmapped"
_RANKED = """SELECT *, row_number() OVER (PARTITION BY chrom, strand ORDER BY CASE WHEN strand='+' THEN s ELSE -e END, ord) AS rank FROM genes"""


def _cov(by: str = "") -> str:
    if by:
        return """SELECT x.sample, g.gene_id, coalesce(sum(least(p.e,g.e)-greatest(p.s,g.s-1)),0)/greatest(1,g.e-g.s+1) coverage
 FROM genes g CROSS JOIN (SELECT DISTINCT sample FROM spans) x LEFT JOIN spans p ON p.sample=x.sample AND p.chrom=g.chrom AND p.s<g.e AND g.s-1<p.e
 GROUP BY x.sample, g.gene_id, g.s, g.e"""
    return """SELECT g.gene_id, coalesce(sum(least(p.e,g.e)-greatest(p.s,g.s-1)),0)/greatest(1,g.e-g.s+1) coverage
 FROM genes g LEFT JOIN spans p ON p.chrom=g.chrom AND p.s<g.e AND g.s-1<p.e GROUP BY g.gene_id, g.s, g.e"""


def _adjacent(by: str = "") -> str:
    w = f"OVER (PARTITION BY {by}chrom, strand ORDER BY rank)"
    return f"""SELECT *, lag(gene_id) {w} prev_id, lag(coverage) {w} pc,
 CASE WHEN strand='+' THEN s-lag(e) {w}-1 ELSE lag(s) {w}-e-1 END igd FROM ranked JOIN cov USING (gene_id)"""


_LINK = """coalesce(igd<=70 AND coverage>=0.5 AND pc>=0.5 AND
 CASE WHEN greatest(coverage,pc)>0 THEN least(coverage,pc)/greatest(coverage,pc) ELSE 0 END>=0.25, false)"""


def _chain(by: str = "", link: str = _LINK) -> str:
    return f"""SELECT *, CAST(sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY {by}chrom, strand ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain
 FROM (SELECT *, {link} linked FROM adj)"""


def _rows(by: str = "") -> str:
    return f"""SELECT *, CASE WHEN score0>=0.8 THEN 'HIGH' WHEN score0>=0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM
 (SELECT *, CASE WHEN mi IS NULL OR mean<=0 THEN 0.0 ELSE greatest(0.0,least(1.0,(1-mi/70)*(mn/mean)/(1+cv))) END score0 FROM
 (SELECT {by}chrom, strand, chain, min(s) AS "start", max(e) AS "end", count(*) AS n_genes, avg(coverage) mean, min(coverage) mn,
 CASE WHEN avg(coverage)>0 THEN stddev_pop(coverage)/avg(coverage) ELSE 0.0 END cv, avg(igd) FILTER (linked) mi, arg_min(s, rank) AS first_start,
 string_agg(gene_id, ',' ORDER BY rank) AS gene_ids, coalesce(string_agg(CAST(igd AS STRING), ',' ORDER BY rank) FILTER (linked),'') AS igds
 FROM chained GROUP BY {by}chrom, strand, chain))"""


_SHOWN = """"start", "end", n_genes, gene_ids, igds, confidence, round(mean,9) AS mean_coverage, round(mn,9) AS min_coverage,
 round(cv,9) AS coverage_cv, round(score0,9) AS score"""


def _numbered(by: str = "", least: float = 0.0) -> str:
    part = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    return f"""SELECT {by}concat('operon_',CAST(row_number() OVER ({part}ORDER BY chrom, lead0, strand, chain) AS STRING)) AS operon_id,
 chrom, strand, {_SHOWN} FROM (SELECT *, min(first_start) OVER (PARTITION BY {by}chrom, strand) lead0 FROM rws WHERE score0>={least})"""


def _sql(final: str, **ctes: str) -> str:
    return with_views("features", "alignments", genes=_GENES, spans=_SPANS, ranked=_RANKED, **ctes) + final


_ALL = {"cov": _cov(), "adj": _adjacent(), "chained": _chain()}
_SAMPLED = {"cov": _cov("s"), "adj": _adjacent("sample, "), "chained": _chain("sample, ")}
_SUPPORT = f"SELECT prev_id, gene_id, sum(CASE WHEN {_LINK} THEN 1 ELSE 0 END)/count(*) AS support FROM adj WHERE prev_id IS NOT NULL GROUP BY ALL"
_CONSENSUS = {
    "cov": _cov("s"), "adj": _adjacent("sample, "), "sup": _SUPPORT,
    "cov2": "SELECT gene_id, avg(coverage) coverage FROM cov GROUP BY ALL",
    "adj2": _adjacent().replace("JOIN cov", "JOIN cov2"),
    "chained": _chain(link="(prev_id IS NOT NULL AND coalesce(support,0)>=0.6)").replace("FROM adj", "FROM (SELECT a.*, support FROM adj2 a LEFT JOIN sup USING (prev_id, gene_id))"),
}

ORACLES = {
    "gene_coverage": _sql("SELECT gene_id, round(coverage,9) AS coverage FROM cov", cov=_cov()),
    "sample_coverage": _sql("SELECT sample, gene_id, round(coverage,9) AS coverage FROM cov", cov=_cov("s")),
    "directon_order": _sql("SELECT gene_id, chrom, strand, rank FROM ranked"),
    "intergenic_distance": _sql("SELECT prev_id, gene_id, igd FROM adj WHERE prev_id IS NOT NULL", cov=_cov(), adj=_adjacent()),
    "operon_chains": _sql("SELECT gene_id, chrom, strand, rank, linked, chain FROM chained", **_ALL),
    "operon_scores": _sql(f"SELECT chrom, strand, chain, first_start, {_SHOWN} FROM rws", **_ALL, rws=_rows()),
    "operons_numbered": _sql(_numbered(least=0.1), **_ALL, rws=_rows()),
    "operons_by_sample": _sql(_numbered("sample, "), **_SAMPLED, rws=_rows("sample, ")),
    "pair_support": _sql(_SUPPORT, cov=_cov("s"), adj=_adjacent("sample, ")),
    "consensus_operons": _sql(f"SELECT chrom, strand, chain, first_start, {_SHOWN} FROM rws", **_CONSENSUS, rws=_rows()),
}
