"""Sequencing-like views over the driver's tables, as SQL that Spark and DuckDB both read.

The text has {table} where a table stands; Spark fills in DataFrames, DuckDB the names. ``G`` is what
DuckDB's regexp_replace needs as a fourth argument to replace every match, and Spark must not have.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riboplan.session import parts_of

_BASES = "translate(upper(regexp_replace(text,'[^A-Za-z]',''<G>)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTNCGTACGTAC')"

#: Ordinals a document has: windows every 110 letters of the longest string that there can be (2 GB) are fewer.
ORDINALS = 1 << 25

VIEWS = {
    "features": """
SELECT concat('g',CAST(p_partkey AS STRING)) gene_id, concat('chr',CAST(p_partkey%4 AS STRING)) contig,
 CASE WHEN CAST(floor(p_partkey/28) AS BIGINT)%2=0 THEN '+' ELSE '-' END strand,
 CAST(floor(p_partkey/4) AS BIGINT)*700+(p_size*7)%150 start0,
 CAST(floor(p_partkey/4) AS BIGINT)*700+(p_size*7)%150+400+(p_size*13)%350 end0, p_partkey ord FROM {part}""",
    "alignments": """
SELECT l_linestatus sample, l_orderkey qname,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) arrival,
 (l_linenumber=7) is_secondary, (l_linenumber=6 AND l_discount>0.09) is_supplementary,
 (l_returnflag='R' AND l_linenumber%3=0) is_unmapped, concat('chr',CAST((l_orderkey*7)%4 AS STRING)) contig,
 CAST(floor(((l_orderkey*7)%(SELECT count(*) FROM {part}))/4) AS BIGINT)*700+(l_orderkey*13)%600+(l_linenumber*60)%400 start0,
 CAST(l_quantity AS BIGINT)%2*40 gap FROM {lineitem}""",
    "contigs": f"SELECT concat('c',CAST(doc_id AS STRING)) contig, doc_id ord, {_BASES} seq FROM {{documents}}",
    "reads": f"""
SELECT doc_id*{ORDINALS}+w.j ordinal, concat('r',CAST(doc_id AS STRING),'_',CAST(w.j AS STRING)) name, w.seq seq FROM (
 SELECT doc_id, explode(get(transform(array({_BASES}), s -> CASE WHEN length(s)>0 THEN transform(sequence(0,CAST(greatest(ceil((length(s)-150)/110),0) AS INT)),
 i -> struct(CAST(i AS BIGINT) j, substr(s,1+i*110,150) seq)) ELSE array() END),0)) w FROM {{documents}})""",
    "probes": f"SELECT item_id ord, {_BASES} seq FROM {{benchmark}} WHERE text IS NOT NULL",
    "cigars": """
SELECT l_orderkey*10+l_linenumber id, max(CAST(l_partkey AS BIGINT)) pos0,
 max(concat(CASE WHEN l_linenumber%3=0 THEN concat(CAST(l_linenumber AS STRING),'S') ELSE '' END,
 CASE WHEN l_linenumber%4=0 THEN concat(CAST(1+l_suppkey%5 AS STRING),'D') ELSE '' END,
 CAST(CAST(l_quantity AS BIGINT)+10 AS STRING),CASE WHEN l_returnflag='R' THEN 'M' ELSE '=' END,
 CASE WHEN l_linestatus='O' THEN concat(CAST(1+l_partkey%7 AS STRING),'N',CAST(20+l_linenumber AS STRING),'X') ELSE '' END,
 CASE WHEN l_returnflag='A' THEN '3I5M' ELSE '' END)) cigar FROM {lineitem} GROUP BY l_orderkey*10+l_linenumber""",
    "hits": """
SELECT l_orderkey*10+l_linenumber id, (l_partkey*37)%1000 pos1, (l_suppkey*53)%1000 pos2,
 CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END strand1, CASE WHEN l_linestatus='O' THEN '-' ELSE '+' END strand2,
 CAST(100 AS BIGINT) read_len, CAST(1000 AS BIGINT) len, -CAST(l_quantity AS BIGINT)%20 ascore1, -CAST(l_orderkey%25 AS BIGINT) ascore2,
 (l_linenumber<>5) mapped1, (l_linenumber<>6) mapped2 FROM {lineitem}""",
    "attributes": """
SELECT p_partkey id, concat(CASE WHEN p_partkey%3=0 THEN concat('ID=g',CAST(p_partkey AS STRING),';') ELSE '' END,
 CASE WHEN p_partkey%2=0 THEN concat('locus_tag=L',CAST(p_partkey AS STRING),';') ELSE '' END,
 'Name=',replace(p_name,' ','%20'),'+x;note=a;note=b',CAST(p_size AS STRING),CASE WHEN p_partkey%5=0 THEN ';' ELSE '' END) text FROM {part}""",
}

#: What DuckDB reads instead, where it has other functions.
DUCK = {
    "reads": f"""
SELECT doc_id*{ORDINALS}+j ordinal, concat('r',CAST(doc_id AS STRING),'_',CAST(j AS STRING)) name, substr(seq,CAST(1+j*110 AS INT),150) seq
FROM (SELECT doc_id, {_BASES} seq FROM {{documents}}), generate_series(0,CAST(greatest(ceil((length(seq)-150)/110.0),0) AS BIGINT)) g(j) WHERE length(seq)>0""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str, spread: dict[str, tuple[int, Sequence[str]]] | None = None) -> DataFrame:
    """``spread``: into how many partitions a table goes by its first column named, each sorted by all of them, before anything else.

    All that is named travels, whatever a reader of the view needs, so readers that differ in less share the shuffle.
    """
    sql = VIEWS[name].replace("<G>", "")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    for t, (parts, columns) in (spread or {}).items():
        tables[t] = tables[t].repartition(parts, columns[0]).sortWithinPartitions(*columns)
    return spark.sql(sql, **tables)


def record_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the records and the features, by the rows of their tables' files."""
    return parts_of(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")])


def duck_view(name: str) -> str:
    sql = DUCK.get(name, VIEWS[name]).replace("<G>", ",'g'")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def with_views(*names: str, **ctes: str) -> str:
    """A WITH clause of views (as v_name) and further named queries, in order."""
    parts = [f"v_{n} AS ({duck_view(n)})" for n in names] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n"
