"""FASTA, FASTQ pairs, GFF3 and the saved index as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riboplan.functions import attributes
from riboplan.functions.circular import overhang, padded
from riboplan.functions.seq import strip_mate

from . import files

INDEX_FORMAT = "riboplan-index-1"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, seq (upper case, lines joined); gzip by suffix; text before the first header raises."""
    rows = spark.read.text(path, lineSep="\n>").withColumn("_at", F.monotonically_increasing_id())
    body = F.regexp_replace("value", "\r", "")
    first = F.col("_at") == 0
    lead = F.when(first, F.regexp_replace(body, r"^\s+", "")).otherwise(F.concat(F.lit(">"), body))
    rows = rows.select("_at", lead.alias("_r")).filter("trim(_r) != ''")
    bad = F.when(~F.startswith("_r", F.lit(">")), F.raise_error(F.lit("sequence before the first header"))).otherwise(F.substring_index("_r", "\n", 1))
    head = F.substring(bad, F.lit(2), F.length("_r"))
    name = F.regexp_extract(head, r"^\s*(\S*)", 1)
    seq = F.upper(F.regexp_replace(F.when(F.instr("_r", "\n") > 0, F.substring("_r", F.instr(F.col("_r"), "\n") + 1, F.length("_r"))).otherwise(""), r"\s", ""))
    return rows.select(F.col("_at").alias("ord"), name.alias("name"), seq.alias("seq"))


def load_references(spark: SparkSession, path: str, circular: bool = False, circular_contigs: list[str] | None = None, percent: int = 100) -> DataFrame:
    """contig, ord, seq (padded where circular), circular, orig_len, overhang; empty or repeated contigs raise."""
    if not 0 <= percent <= 100:
        raise ValueError("overhang percent must be between 0 and 100")
    rows = read_fasta(spark, path)
    if rows.isEmpty():
        raise ValueError(f"no sequences in {path}")
    twice = F.count("*").over(Window.partitionBy("name"))
    ok = F.when(F.length("seq") == 0, F.raise_error(F.concat(F.lit("empty contig "), "name")))
    ok = ok.when(twice > 1, F.raise_error(F.concat(F.lit("repeated contig "), "name"))).otherwise(F.col("name"))
    named = F.col("name").isin(circular_contigs) if circular_contigs else F.lit(True)
    rows = rows.withColumn("_c", F.lit(circular or bool(circular_contigs)) & named)
    over = F.when(F.col("_c"), overhang(F.length("seq"), F.lit(percent))).otherwise(0)
    seq = F.when(F.col("_c"), padded(F.col("seq"), F.lit(percent))).otherwise(F.col("seq"))
    return rows.select(ok.alias("contig"), "ord", seq.alias("seq"), F.col("_c").alias("circular"), F.length("seq").alias("orig_len"), over.alias("overhang"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    files.listed({"path": path})
    files.register(spark)
    return spark.read.format("fastq").load(path)


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """ordinal, name, seq1, qual1, seq2, qual2; files of unequal length or with unlike names raise."""
    a, b = (read_fastq(spark, p).select("ordinal", strip_mate(F.col("name")).alias(f"n{i}"), F.col("seq").alias(f"seq{i}"), F.col("qual").alias(f"qual{i}")) for i, p in ((1, first), (2, second)))
    rows = a.join(b, "ordinal", "full")
    name = F.when(F.col("n1").isNull() | F.col("n2").isNull(), F.raise_error(F.lit("the files have different numbers of reads")))
    name = name.when(F.col("n1") != F.col("n2"), F.raise_error(F.concat(F.lit("read names differ: "), "n1", F.lit(", "), "n2")))
    return rows.select("ordinal", name.otherwise(F.col("n1")).alias("name"), "seq1", "qual1", "seq2", "qual2")


def _gff_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return rows.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select("ord", F.split("value", "\t", -1).alias("c"))


def _positive(text: Column) -> Column:
    return F.coalesce(F.try_to_number(text, F.lit("999999999999")).cast("bigint"), F.raise_error(F.concat(F.lit("not a coordinate: "), text)).cast("bigint"))


def read_gff_strict(spark: SparkSession, path: str, feature_types: tuple[str, ...] = ("gene",), id_attribute: str = "locus_tag") -> DataFrame:
    """gene_id, contig, strand, start, end (half-open), ord: any malformed line raises; rows without the id go."""
    c = F.col("c")
    rows = _gff_rows(spark, path).filter(F.when(F.size(c) != 9, F.raise_error(F.concat(F.lit("not nine columns: "), F.array_join(c, " "))).cast("boolean")).otherwise(F.get(c, F.lit(2)).isin([t.strip() for t in feature_types])))
    c = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(F.col("c"), i))
    strand = F.when(c[6].isin("+", "-"), c[6]).otherwise(F.raise_error(F.concat(F.lit("no strand: "), c[6])))
    rows = rows.select("ord", attributes.strict(c[8]).alias("a"), c[0].alias("contig"), strand.alias("strand"), _positive(c[3]).alias("s"), _positive(c[4]).alias("e"))
    start = F.when((F.col("s") < 1) | (F.col("e") < F.col("s")), F.raise_error(F.lit("bad coordinates")).cast("bigint")).otherwise(F.col("s") - 1)
    out = rows.select(F.col("a")[id_attribute].alias("gene_id"), "contig", "strand", start.alias("start"), F.col("e").alias("end"), "ord")
    return out.filter("gene_id is not null and gene_id != ''")


def read_gff_lenient(spark: SparkSession, path: str, feature_types: tuple[str, ...] = ("gene",)) -> DataFrame:
    """gene_id, chrom, start, end (1-based, inclusive), strand, ord: lines without nine columns are skipped."""
    c = F.col("c")
    c = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(c, i))  # Spark may test the type before the size
    rows = _gff_rows(spark, path).filter((F.size("c") == 9) & F.get("c", F.lit(2)).isin(list(feature_types)))
    return rows.select(
        attributes.lenient_id(attributes.lenient(c[8])).alias("gene_id"), c[0].alias("chrom"), c[3].cast("bigint").alias("start"),
        c[4].cast("bigint").alias("end"), c[6].alias("strand"), "ord",
    )


def read_bam(spark: SparkSession, *paths: str, require_order: bool = False) -> DataFrame:
    files.listed({"path": ",".join(paths)})
    files.register(spark)
    return spark.read.format("bam").option("requireCoordinateOrder", str(require_order).lower()).load(",".join(paths))


def save_index(index: DataFrame, contigs: DataFrame, path: str, k: int, w: int) -> None:
    """Entries clustered by seed, the contigs, and one row that says what this is."""
    index.repartition("seed").sortWithinPartitions("seed").write.mode("overwrite").parquet(f"{path}/entries")
    contigs.write.mode("overwrite").parquet(f"{path}/contigs")
    meta = json.dumps({"format": INDEX_FORMAT, "k": k, "w": w})
    index.sparkSession.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(entries, contigs, about); another format raises."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about.get("format") != INDEX_FORMAT:
        raise ValueError(f"{path} is not an index of this version")
    return spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/contigs"), about
