"""Named queries of fragments, assignment and expression, with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riboplan.operators import intervals as iv
from riboplan.operators import quantify as q

from .views import record_parts, spark_view, with_views

KEYS = ("qname", "frag")
SAMPLE_KEYS = ("sample", "qname", "frag")

#: Order of a name's records: first that of ``arrival``, which needs no further sort, then what else fragments or blocks read. So
#: both come from one shuffle of lineitem, and records that ``arrival`` leaves equal lie in the same order in both.
RECORD_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")


def features(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "features").withColumnsRenamed({"start0": "start", "end0": "end"})


def records(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "alignments", {"lineitem": (record_parts(spark, d), RECORD_ORDER)})


def _home(spark: SparkSession, d: str) -> q.Home:
    """Where the records of a name lie: one shuffle serves pairs, fragments and their features."""
    return record_parts(spark, d), ("qname",)


def mates(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    r = records(spark, d)
    primary = r.filter(q.record_class(F.col("is_secondary"), F.col("is_supplementary")) == "primary")
    return q.pair_mates(primary, (*by, "qname"))


def blocks(m: DataFrame) -> DataFrame:
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    s, g = F.col("start0"), F.col("gap")
    both = F.explode(F.array(one(s, s + 50), one(s + 50 + g, s + 100 + g)))
    return m.filter("not is_unmapped").select(*[c for c in SAMPLE_KEYS if c in m.columns], "mate", "contig", both.alias("b")).select("*", "b.*").drop("b")


def _assigned(spark, d, min_overlap=1, largest=False, by=()):
    keys = (*by, *KEYS)
    m, home = mates(spark, d, by), _home(spark, d)
    return q.assign(q.fragments(m, keys), q.mate_overlaps(blocks(m), features(spark, d), keys, home), keys, min_overlap, largest, home[0])


def fragment_pairing(spark: SparkSession, d: str) -> DataFrame:
    return mates(spark, d).select("qname", "frag", "mate", "contig", "start0")


def fragment_stats(spark: SparkSession, d: str) -> DataFrame:
    return q.fragment_stats(records(spark, d), q.fragments(mates(spark, d), KEYS))


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return q.mate_overlaps(blocks(mates(spark, d)), features(spark, d), KEYS, _home(spark, d))


def mate_overlap_detail(spark: SparkSession, d: str) -> DataFrame:
    return q.mate_detail(interval_overlap_join(spark, d), KEYS)


def union_mate_overlap(spark: SparkSession, d: str) -> DataFrame:
    return q.union_overlaps(blocks(mates(spark, d)), features(spark, d), KEYS, _home(spark, d))


def fragment_assignment_default(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


def fragment_assignment_largest(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, largest=True)


def fragment_assignment_min60(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, min_overlap=60)


def fragment_assignment_min60_largest(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, min_overlap=60, largest=True)


def assignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return q.summary(_assigned(spark, d)).withColumn("assignment_rate", F.round("assignment_rate", 9))


def feature_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Features of two records each: neighbours on a contig that share a strand become one."""
    f = features(spark, d).withColumn("gene_id", F.concat(F.lit("m"), (F.floor(F.col("ord") / 28)).cast("string"), F.lit("_"), (F.col("ord") % 4).cast("string")))
    return q.feature_lengths(f)


def _lengths(spark, d):
    return features(spark, d).select("gene_id", (F.col("end") - F.col("start")).alias("length"))


def gene_counts_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return q.gene_counts(_assigned(spark, d), _lengths(spark, d), parts=record_parts(spark, d))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def rpkm_tpm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(q.normalise(gene_counts_zero_filled(spark, d)), "rpkm", "tpm")


def _by_sample(spark, d):
    counts = q.gene_counts(_assigned(spark, d, by=("sample",)), _lengths(spark, d), ("sample",), record_parts(spark, d))
    return q.normalise(counts, ("sample",))


def multi_sample_expression(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_by_sample(spark, d), "rpkm", "tpm")


def expression_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = q.expression_matrix(_by_sample(spark, d), ["F", "O"])
    return _rounded(wide, *[f"{s}_{m}" for s in "FO" for m in ("rpkm", "tpm")])


def count_matrix(spark: SparkSession, d: str) -> DataFrame:
    return q.expression_matrix(_by_sample(spark, d), ["F", "O"], ["count"])


def _run(spark, d):
    return _assigned(spark, d), gene_counts_zero_filled(spark, d), _lengths(spark, d), fragment_stats(spark, d)


def invariant_values(spark: SparkSession, d: str) -> DataFrame:
    return q.invariants(*_run(spark, d))


def result_invariants(spark: SparkSession, d: str) -> DataFrame:
    return q.violations(*_run(spark, d))


def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge_intervals(features(spark, d), ["contig", "strand"])


def merge_intervals_gap(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge_intervals(features(spark, d), ["contig"], slack=50, aggs=[F.count("*").alias("members")])


def interval_intersection(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    side = lambda s: iv.merge_intervals(f.filter(F.col("strand") == s), ["contig"])
    return iv.intersection_length(side("+"), side("-").withColumnsRenamed({"start": "r_start", "end": "r_end"}), ["contig"])


QUERIES = {
    f.__name__: f
    for f in (
        fragment_pairing, fragment_stats, interval_overlap_join, mate_overlap_detail, union_mate_overlap,
        fragment_assignment_default, fragment_assignment_largest, fragment_assignment_min60, fragment_assignment_min60_largest,
        assignment_summary, feature_lengths, gene_counts_zero_filled, rpkm_tpm, multi_sample_expression, expression_matrix,
        count_matrix, invariant_values, result_invariants, merge_intervals, merge_intervals_gap, interval_intersection,
    )
}


def _mates_sql(by: str = "") -> str:
    return f"""SELECT *, CAST(floor((rn-1)/2) AS BIGINT) frag, (rn-1)%2+1 mate FROM (SELECT *, row_number() OVER
 (PARTITION BY {by}qname ORDER BY arrival) rn FROM v_alignments WHERE NOT is_secondary AND NOT is_supplementary)"""


_BLOCKS = """SELECT *, start0 bs, start0+50 be FROM mates WHERE NOT is_unmapped
 UNION ALL SELECT *, start0+50+gap, start0+100+gap FROM mates WHERE NOT is_unmapped"""


def _overlaps_sql(by: str = "") -> str:
    return f"""SELECT {by}qname, frag, mate, gene_id, CAST(sum(least(be,f.end0)-greatest(bs,f.start0)) AS BIGINT) overlap
 FROM blocks b JOIN v_features f ON f.contig=b.contig AND b.bs<f.end0 AND f.start0<b.be GROUP BY ALL"""


def _assigned_sql(min_overlap: int = 1, largest: bool = False, by: str = "") -> dict[str, str]:
    k = f"{by}qname, frag"
    wins = "ok AND ov=best" if largest else "ok"
    return {
        "mates": _mates_sql(by), "blocks": _BLOCKS, "ovl": _overlaps_sql(by),
        "frags": f"SELECT {k}, count(*) n_mates, count(*) FILTER (NOT is_unmapped) n_mapped FROM mates GROUP BY ALL",
        "genes": f"""SELECT * EXCLUDE(ok), coalesce(ok,false) ok, max(CASE WHEN ok THEN ov END) OVER (PARTITION BY {k}) best FROM
 (SELECT *, ov>={min_overlap} ok, max(nm) OVER (PARTITION BY {k}) mx FROM
 (SELECT {k}, gene_id, sum(overlap) ov, count(DISTINCT mate) nm FROM ovl GROUP BY ALL)) WHERE nm=mx""",
        "verdict": f"SELECT {k}, count(*) FILTER (ok) n_ok, count(*) FILTER ({wins}) n, max(CASE WHEN {wins} THEN gene_id END) g FROM genes GROUP BY ALL",
        "assigned": f"""SELECT {k}, CASE WHEN n_mapped=0 THEN 'unmapped' WHEN n_ok IS NULL THEN 'no_feature'
 WHEN n_ok=0 THEN 'insufficient_overlap' WHEN n=1 THEN 'assigned' ELSE 'ambiguous' END status,
 CASE WHEN n_mapped>0 AND n_ok>0 AND n=1 THEN g END gene_id FROM frags LEFT JOIN verdict USING ({k})""",
    }


def _sql(final: str, **ctes: str) -> str:
    return with_views("features", "alignments", **ctes) + final


_COUNTS = """SELECT f.gene_id, f.end0-f.start0 AS length, count(a.gene_id) AS "count" FROM v_features f
 LEFT JOIN assigned a ON a.gene_id=f.gene_id AND a.status='assigned' GROUP BY ALL"""
_SAMPLE_COUNTS = """SELECT s.sample, f.gene_id, f.end0-f.start0 AS length, count(a.gene_id) AS "count" FROM v_features f
 CROSS JOIN (SELECT DISTINCT sample FROM assigned) s LEFT JOIN assigned a ON a.gene_id=f.gene_id AND a.sample=s.sample GROUP BY ALL"""
_RPKM = 'CASE WHEN sum("count") OVER w>0 THEN 1e9*"count"/(sum("count") OVER w*length) ELSE 0.0 END'
_TPM = 'CASE WHEN sum("count"/(length/1000)) OVER w>0 THEN "count"/(length/1000)/sum("count"/(length/1000)) OVER w*1e6 ELSE 0.0 END'
_NORM = f'SELECT *, round({_RPKM},6) rpkm, round({_TPM},6) tpm FROM counts WINDOW w AS ()'
_SAMPLE_NORM = f'SELECT *, round({_RPKM},6) rpkm, round({_TPM},6) tpm FROM counts WINDOW w AS (PARTITION BY sample)'
_PICK = ", ".join(f"max(CASE WHEN sample='{s}' THEN {c} END) \"{s}_{m}\"" for s in "FO" for m, c in (("count", '"count"'), ("rpkm", "rpkm"), ("tpm", "tpm")))
_PICK_COUNT = ", ".join(f"max(CASE WHEN sample='{s}' THEN \"count\" END) \"{s}_count\"" for s in "FO")


def _merge_sql(source: str, keys: str, slack: int = 0, more: str = "") -> str:
    return f"""SELECT {keys}, min(s) AS "start", max(e) AS "end"{more} FROM (SELECT *, sum(o) OVER (PARTITION BY {keys} ORDER BY s, e
 ROWS UNBOUNDED PRECEDING) isl FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING)+{slack}>=s THEN 0 ELSE 1 END o FROM ({source}))) GROUP BY {keys}, isl"""


_FEATS = "SELECT contig, strand, start0 s, end0 e FROM v_features"
_STATS = """SELECT r.*, f.* FROM (SELECT count(*) AS records, count(*) FILTER (is_secondary) AS secondary,
 count(*) FILTER (NOT is_secondary AND is_supplementary) AS supplementary, count(*) FILTER (NOT is_secondary AND NOT is_supplementary) AS primary_records
 FROM v_alignments) r, (SELECT count(*) AS fragments, count(*) FILTER (n=2) AS paired, count(*) FILTER (n<>2) AS orphans,
 count(*) FILTER (n=2 AND m=2) AS fully_mapped, count(*) FILTER (n=2 AND m=1) AS partially_mapped, count(*) FILTER (m=0) AS unmapped,
 count(*) FILTER (m=2 AND c>1) AS discordant_contig FROM (SELECT qname, frag, count(*) n, count(*) FILTER (NOT is_unmapped) m,
 count(DISTINCT CASE WHEN NOT is_unmapped THEN contig END) c FROM mates GROUP BY ALL)) f"""
_INVARIANTS = """SELECT invariant, CAST(got AS BIGINT) AS got, CAST(want AS BIGINT) AS want FROM (
 SELECT 'counts sum to the assigned fragments' invariant, (SELECT coalesce(sum("count"),0) FROM counts) got, (SELECT count(*) FROM assigned WHERE status='assigned') want
 UNION ALL SELECT 'no count is negative', (SELECT count(*) FROM counts WHERE "count"<0), 0
 UNION ALL SELECT 'each feature has one count', (SELECT count(*)-count(DISTINCT gene_id) FROM counts), 0
 UNION ALL SELECT 'each feature is counted', (SELECT count(*) FROM (SELECT gene_id FROM v_features EXCEPT SELECT gene_id FROM counts)), 0
 UNION ALL SELECT 'each count has a feature', (SELECT count(*) FROM (SELECT gene_id FROM counts EXCEPT SELECT gene_id FROM v_features)), 0
 UNION ALL SELECT 'each fragment has a status', (SELECT count(*) FROM assigned), (SELECT fragments FROM stats)
 UNION ALL SELECT 'fragments without a mapped mate are unmapped', (SELECT count(*) FROM assigned WHERE status='unmapped'), (SELECT unmapped FROM stats))"""
_STRANDS = {f"s{i}": _merge_sql(f"{_FEATS} WHERE strand='{s}'", "contig") for i, s in enumerate("+-")}
_MERGED_BLOCKS = _merge_sql("SELECT qname, frag, contig, bs s, be e FROM blocks", "qname, frag, contig")

ORACLES = {
    "fragment_pairing": _sql("SELECT qname, frag, mate, contig, start0 FROM mates", mates=_mates_sql()),
    "fragment_stats": _sql(_STATS, mates=_mates_sql()),
    "interval_overlap_join": _sql("SELECT * FROM ovl", mates=_mates_sql(), blocks=_BLOCKS, ovl=_overlaps_sql()),
    "mate_overlap_detail": _sql(
        """SELECT qname, frag, gene_id, CAST(coalesce(sum(overlap) FILTER (mate=1),0) AS BIGINT) AS read1_overlap,
 CAST(coalesce(sum(overlap) FILTER (mate=2),0) AS BIGINT) AS read2_overlap, CAST(sum(overlap) AS BIGINT) AS total_overlap,
 count(DISTINCT mate) AS supporting_reads FROM ovl GROUP BY ALL""",
        mates=_mates_sql(), blocks=_BLOCKS, ovl=_overlaps_sql(),
    ),
    "union_mate_overlap": _sql(
        """SELECT qname, frag, gene_id, CAST(sum(least(m."end",f.end0)-greatest(m."start",f.start0)) AS BIGINT) AS overlap FROM merged m
 JOIN v_features f ON f.contig=m.contig AND m."start"<f.end0 AND f.start0<m."end" GROUP BY ALL""",
        mates=_mates_sql(), blocks=_BLOCKS, merged=_MERGED_BLOCKS,
    ),
    "fragment_assignment_default": _sql("SELECT * FROM assigned", **_assigned_sql()),
    "fragment_assignment_largest": _sql("SELECT * FROM assigned", **_assigned_sql(largest=True)),
    "fragment_assignment_min60": _sql("SELECT * FROM assigned", **_assigned_sql(60)),
    "fragment_assignment_min60_largest": _sql("SELECT * FROM assigned", **_assigned_sql(60, True)),
    "assignment_summary": _sql(
        "SELECT " + ", ".join(f"count(*) FILTER (status='{s}') AS {s}" for s in q.STATUSES)
        + ", count(*) AS total_fragments, round(count(*) FILTER (status='assigned')/count(*),9) AS assignment_rate FROM assigned",
        **_assigned_sql(),
    ),
    "feature_lengths": _sql(
        """SELECT gene_id, contig, strand, count(*) AS n_blocks, CAST(sum("end"-"start") AS BIGINT) AS length FROM m GROUP BY ALL""",
        m=_merge_sql("SELECT concat('m',CAST(CAST(floor(ord/28) AS BIGINT) AS STRING),'_',CAST(ord%4 AS STRING)) gene_id, contig, strand, start0 s, end0 e FROM v_features", "gene_id, contig, strand"),
    ),
    "gene_counts_zero_filled": _sql(_COUNTS, **_assigned_sql()),
    "rpkm_tpm": _sql(_NORM, **_assigned_sql(), counts=_COUNTS),
    "multi_sample_expression": _sql(_SAMPLE_NORM, **_assigned_sql(by="sample, "), counts=_SAMPLE_COUNTS),
    "expression_matrix": _sql(f"SELECT gene_id, length AS length_bp, {_PICK} FROM n GROUP BY ALL", **_assigned_sql(by="sample, "), counts=_SAMPLE_COUNTS, n=_SAMPLE_NORM),
    "count_matrix": _sql(f"SELECT gene_id, length AS length_bp, {_PICK_COUNT} FROM counts GROUP BY ALL", **_assigned_sql(by="sample, "), counts=_SAMPLE_COUNTS),
    "invariant_values": _sql("SELECT * FROM checks", **_assigned_sql(), counts=_COUNTS, stats=_STATS, checks=_INVARIANTS),
    "result_invariants": _sql("SELECT invariant AS violation FROM checks WHERE got<>want", **_assigned_sql(), counts=_COUNTS, stats=_STATS, checks=_INVARIANTS),
    "merge_intervals": _sql(_merge_sql(_FEATS, "contig, strand")),
    "merge_intervals_gap": _sql(_merge_sql(_FEATS, "contig", 50, ", count(*) AS members")),
    "interval_intersection": _sql(
        """SELECT a.contig, CAST(sum(least(a."end",b."end")-greatest(a."start",b."start")) AS BIGINT) AS overlap FROM s0 a JOIN s1 b
 ON a.contig=b.contig AND a."start"<b."end" AND b."start"<a."end" GROUP BY ALL""", **_STRANDS,
    ),
}
