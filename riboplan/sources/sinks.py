"""SAM projections, text tables and the files around a run."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riboplan.functions import scoring as sc
from riboplan.functions.cigar import reference_length
from riboplan.functions.scoring import clamp
from riboplan.functions.seq import revcomp

from . import files

GENE_COUNTS = ("gene_id", "length_bp", "count", "RPKM", "TPM")
OPERON_COUNTS = ("operon_id", "contig", "start", "end", "strand", "genes", "length_bp", "count", "RPKM", "TPM")
OPERONS = ("operon_id", "chrom", "strand", "start", "end", "n_genes", "gene_ids", "igds", "mean_coverage", "min_coverage", "coverage_cv", "score", "confidence")
OPERON_METRICS = OPERONS[8:]


def _tags(ascore: Column, junction: Column) -> Column:
    base = F.create_map(F.lit("NM"), F.concat(F.lit("i:"), -ascore), F.lit("AS"), F.concat(F.lit("i:"), ascore))
    extra = F.when(junction, F.create_map(F.lit("XC"), F.lit("Z:JUNCTION"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.when(ascore.isNotNull(), F.map_concat(base, extra))


def _oriented(seq: Column, qual: Column, strand: Column, as_read: bool) -> tuple[Column, Column]:
    """Sequence and qualities in the direction of the reference, or as read."""
    if as_read:
        return seq, qual
    back = strand == "-"
    return F.when(back, revcomp(seq)).otherwise(seq), F.when(back, F.reverse(qual)).otherwise(qual)


def single_records(reads: DataFrame, hits: DataFrame, as_read: bool = False) -> DataFrame:
    """SAM columns of single-end reads; those without a hit have the unmapped flag."""
    rows = reads.select("ordinal", "name", "seq", "qual").join(hits, "ordinal", "left")
    mapped = F.col("contig").isNotNull()
    seq, qual = _oriented(F.col("seq"), F.col("qual"), F.col("strand"), as_read)
    flag = F.when(~mapped, sc.UNMAPPED).when(F.col("strand") == "-", sc.REVERSE).otherwise(0)
    return rows.select(
        "ordinal", F.col("name").alias("qname"), flag.alias("flag"), F.col("contig").alias("rname"), F.col("pos0").cast("int").alias("pos0"),
        F.when(mapped, clamp(F.col("mapq"), 0, 60)).otherwise(0).cast("int").alias("mapq"), "cigar", F.lit(None).cast("string").alias("rnext"),
        F.lit(None).cast("int").alias("pnext0"), F.lit(0).alias("tlen"), seq.alias("seq"), qual.alias("qual"), _tags(F.col("ascore"), F.col("junction")).alias("tags"),
    )


def pair_records(pairs: DataFrame, aligned: DataFrame, as_read: bool = False) -> DataFrame:
    """SAM columns of both mates of every pair."""
    rows = pairs.join(aligned.drop("read_len"), "ordinal", "left")
    out = []
    for m, o in ((1, 2), (2, 1)):
        me, mate = F.col(f"h{m}"), F.col(f"h{o}")
        mapped, mate_mapped = me.isNotNull(), mate.isNotNull()
        end = F.col(f"h{m}.pos0") + reference_length(F.col(f"h{m}.cigar"))
        mate_end = F.col(f"h{o}.pos0") + reference_length(F.col(f"h{o}.cigar"))
        seq, qual = _oriented(F.col(f"seq{m}"), F.col(f"qual{m}"), F.col(f"h{m}.strand"), as_read)
        flag = sc.pair_flag(m == 1, mapped, F.col(f"h{m}.strand"), mate_mapped, F.col(f"h{o}.strand"), F.col("proper"))
        tlen = F.when(mapped & mate_mapped, sc.template_length(F.col(f"h{m}.pos0"), end, F.col(f"h{o}.pos0"), mate_end)).otherwise(0)
        out.append(rows.select(
            "ordinal", F.lit(m).alias("mate"), F.col("name").alias("qname"), flag.alias("flag"), F.when(mapped, F.col("contig")).alias("rname"),
            F.col(f"h{m}.pos0").cast("int").alias("pos0"), F.when(mapped, clamp(F.col(f"h{m}.mapq"), 0, 60)).otherwise(0).cast("int").alias("mapq"),
            F.col(f"h{m}.cigar").alias("cigar"), F.when(mate_mapped, F.when(mapped, "=").otherwise(F.col("contig"))).alias("rnext"),
            F.col(f"h{o}.pos0").cast("int").alias("pnext0"), tlen.cast("int").alias("tlen"), seq.alias("seq"), qual.alias("qual"),
            _tags(F.col(f"h{m}.ascore"), F.col(f"h{m}.junction")).alias("tags"),
        ))
    return out[0].unionByName(out[1])


_RECORD = ["qname", "flag", "rname", "pos0", "mapq", "cigar", "rnext", "pnext0", "tlen", "seq", "qual", "tags"]


def write_bam(records: DataFrame, references: Sequence[tuple[str, int]], path: str, sort: bool = False) -> None:
    """One BAM file, streamed through the driver a partition at a time; ``sort`` orders by reference and place."""
    if sort:
        place = F.create_map(*[x for i, (n, _) in enumerate(references) for x in (F.lit(n), F.lit(i))]) if references else F.lit(None)
        rank = F.coalesce(place[F.col("rname")], F.lit(2**31 - 1)) if references else F.lit(0)
        records = records.withColumn("_r", rank).orderBy("_r", F.coalesce("pos0", F.lit(2**31 - 1)), "qname", "flag")
    elif "ordinal" in records.columns:
        records = records.orderBy("ordinal", "flag")
    rows = (r.asDict() for r in records.select(*_RECORD).toLocalIterator(prefetchPartitions=True))
    with open(path, "wb") as f:
        files.write_records(f, list(references), rows, "coordinate" if sort else "unsorted")


def write_bam_parts(records: DataFrame, references: Sequence[tuple[str, int]], folder: str) -> None:
    """A BAM file a partition, written by the executors."""
    files.register(records.sparkSession)
    refs = ",".join(f"{n}:{length}" for n, length in references)
    shaped = records.select(F.lit("").alias("sample"), F.lit(0).cast("long").alias("file_ordinal"), *_RECORD)
    shaped.write.format("bam").option("references", refs).mode("append").save(folder)


def _text(value: Any, digits: int) -> str:
    if value is None:
        return ""
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def write_tsv(df: DataFrame, path: str, header: Sequence[str], order: Sequence[str], digits: int = 6, as_float: Iterable[str] = ()) -> int:
    """Rows in order, floats with fixed digits rounded half to even, streamed; the number of rows."""
    numbers = set(as_float)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(header) + "\n")
        for r in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            d = r.asDict()
            f.write("\t".join(_text(float(d[c]) if c in numbers and d[c] is not None else d[c], digits) for c in df.columns) + "\n")
            n += 1
    return n


def write_gene_counts(values: DataFrame, path: str) -> int:
    rows = values.select("gene_id", "length", "count", "rpkm", "tpm")
    return write_tsv(rows, path, GENE_COUNTS, ["gene_id"], as_float=("count", "rpkm", "tpm"))


def write_matrix(values: DataFrame, samples: Sequence[str], path: str, measures: Sequence[str] = ("count", "rpkm", "tpm"), meta: DataFrame | None = None) -> int:
    """Features by samples: ``<sample>.count`` and so on; with ``meta`` the operon columns stand first."""
    from riboplan.operators.quantify import expression_matrix

    wide = expression_matrix(values, samples, measures)
    shown = {"count": "count", "rpkm": "RPKM", "tpm": "TPM"}
    numbers = [c for c in wide.columns if c not in ("gene_id", "length_bp")]
    names = [f"{s}.{shown[m]}" if len(measures) > 1 else s for s in samples for m in measures]
    first = ["gene_id", "length_bp"]
    if meta is not None:
        wide = _with_operon_meta(wide.withColumnRenamed("gene_id", "operon_id"), meta)
        first = list(OPERON_COUNTS[:7])
        wide = wide.select(*first, *numbers)
    return write_tsv(wide, path, [*first, *names], [first[0]], as_float=numbers)


def _with_operon_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    out = rows.join(meta.select("operon_id", "contig", "start", "end", "strand", "genes"), "operon_id", "left")
    return out.fillna({"contig": "", "start": -1, "end": -1, "strand": ".", "genes": ""})


def write_operon_counts(values: DataFrame, meta: DataFrame, path: str) -> int:
    rows = _with_operon_meta(values.select(F.col("gene_id").alias("operon_id"), F.col("length").alias("length_bp"), "count", "rpkm", "tpm"), meta)
    return write_tsv(rows.select(*OPERON_COUNTS[:8], "rpkm", "tpm"), path, OPERON_COUNTS, ["operon_id"], as_float=("count", "rpkm", "tpm"))


def write_operons(operons: DataFrame, path: str, consensus: bool = False) -> int:
    """The operon table; ``consensus`` marks the columns that come from means over samples."""
    header = [f"consensus_{c}" if consensus and c in OPERON_METRICS else c for c in OPERONS]
    number = F.regexp_extract("operon_id", r"(\d+)$", 1).cast("bigint")
    rows = operons.select(*OPERONS)
    return write_tsv(rows, path, header, [number], digits=3)


def write_operon_gff(operons: DataFrame, path: str, source: str = "riboplan") -> int:
    number = F.regexp_extract("operon_id", r"(\d+)$", 1).cast("bigint")
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("##gff-version 3\n")
        for r in operons.orderBy(number).toLocalIterator():
            attrs = f"ID={r['operon_id']};n_genes={r['n_genes']};genes={r['gene_ids']};mean_cov={r['mean_coverage']:.3f};score={r['score']:.3f};confidence={r['confidence']}"
            f.write(f"{r['chrom']}\t{source}\toperon\t{r['start']}\t{r['end']}\t{r['score']:.3f}\t{r['strand']}\t.\t{attrs}\n")
            n += 1
    return n


def init_workdir(root: str) -> Path:
    """root with logs, tmp, results and a note on them."""
    base = Path(root)
    for name in ("logs", "tmp", "results"):
        (base / name).mkdir(parents=True, exist_ok=True)
    (base / "README.txt").write_text("logs: messages of a run\ntmp: scratch files\nresults: tables and alignments\n")
    return base


def update_manifest(base: Path, **entries: Any) -> Path:
    """Merge entries into run_manifest.json."""
    path = base / "run_manifest.json"
    old = json.loads(path.read_text()) if path.exists() else {}
    path.write_text(json.dumps(old | entries, indent=2, sort_keys=True, default=str))
    return path


def default_workdir(verb: str) -> str:
    return f"riboplan_{verb}_{datetime.now():%Y%m%d_%H%M%S}"


def with_suffix(name: str, suffix: str) -> str:
    return name if name.endswith(suffix) else name + suffix


def default_alignment_name(fastq: str) -> str:
    """Name of the alignment file of a read file: without its suffixes and mate mark."""
    import re

    base = re.sub(r"\.(fastq|fq)(\.gz)?$", "", Path(fastq).name)
    return re.sub(r"[._-]R?1$", "", base) + ".bam"
