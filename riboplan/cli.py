"""Command line: ``index``, ``align``, ``quantify`` and ``getOperons``. Exit code 2 for usage errors, 130 on Ctrl-C."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riboplan.functions.cigar import blocks, reference_length
from riboplan.functions.scoring import SECONDARY, SUPPLEMENTARY, UNMAPPED
from riboplan.operators import align as al
from riboplan.operators import minimizers as mz
from riboplan.operators import operons as op
from riboplan.operators import quantify as q
from riboplan.operators import rrna
from riboplan.session import durable, session
from riboplan.sources import files, sinks, tables

VERSION = "0.1.0"
log = logging.getLogger("riboplan")


class UsageError(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riboplan", description="Alignment, counting and operon inference as Spark plans.")
    p.add_argument("-d", "-dir", dest="dir", help="working directory")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    verbs = p.add_subparsers(dest="verb", required=True)

    i = verbs.add_parser("index", help="minimizer index of a FASTA file")
    i.add_argument("-r", "--ref", required=True)
    i.add_argument("-o", "--out")
    i.add_argument("-k", "--kmer", type=int, default=15)
    i.add_argument("-w", "--window", type=int, default=10)
    i.add_argument("-c", "--circular", action="store_true")
    i.add_argument("-n", "--circular-contigs", default="")
    i.add_argument("--circular-overhang-percent", type=int, default=5)

    a = verbs.add_parser("align", help="align reads")
    a.add_argument("-r", "--ref")
    a.add_argument("-x", "--index")
    a.add_argument("-o", "--out")
    a.add_argument("--fq")
    a.add_argument("-1", "--fq1")
    a.add_argument("-2", "--fq2")
    a.add_argument("-c", "--circular", action="store_true")
    a.add_argument("--circular-contigs", default="")
    a.add_argument("--circular-overhang-percent", type=int, default=5)
    for flag, kind, default in (
        ("--step", int, 5), ("--pad", int, 250), ("--max-windows", int, 50), ("--min-seed-hits", int, 1), ("--max-insert", int, 1200),
        ("--expected-insert", int, 300), ("--rescue-pad", int, 200), ("--debug-pairs", int, 0), ("--chunk-size", int, 10_000),
        ("--sort-threads", int, 1), ("--rrna-k", int, 18), ("--rrna-min-hits", int, 50),
    ):
        a.add_argument(flag, type=kind, default=default)
    a.add_argument("-k", "--kmer", type=int, default=15)
    a.add_argument("-t", "--threads", type=int, default=1)
    for flag in ("--no-rescue", "--sensitive", "--pool", "--sort-bam", "--filter-rrna", "--as-read"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--rrna-db")
    a.add_argument("--log", default="INFO")

    t = verbs.add_parser("quantify", help="count fragments per feature")
    t.add_argument("-b", "--bam", nargs="+", required=True)
    t.add_argument("-g", "--gff", required=True)
    t.add_argument("-o", "--out")
    t.add_argument("--feature-type", choices=("gene", "operon"), default="gene")
    t.add_argument("--id-attribute")
    t.add_argument("--min-overlap", type=int, default=1)
    t.add_argument("--largest-overlap", action="store_true")
    t.add_argument("--log", default="INFO")

    g = verbs.add_parser("getOperons", help="chains of co-expressed neighbours")
    g.add_argument("-b", "--bam", nargs="+", required=True)
    g.add_argument("-g", "--gff", required=True)
    g.add_argument("-o", "--out")
    g.add_argument("-t", "--threads", type=int, default=1)
    g.add_argument("--max-igd", type=int, default=70)
    g.add_argument("--min-coverage", type=float, default=0.5)
    g.add_argument("--min-cov-ratio", type=float, default=0.25)
    g.add_argument("--consensus", action="store_true")
    g.add_argument("--min-support", type=float, default=0.6)
    g.add_argument("--min-score", type=float, default=0.0)
    g.add_argument("--write-gff", action="store_true")
    g.add_argument("--prefix", default="operons")
    return p


def _files(*paths: str | None) -> None:
    for p in paths:
        if p is not None and not Path(p).exists():
            raise FileNotFoundError(f"no such file: {p}")


def _names(text: str) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] or None


def _references(spark: SparkSession, args) -> DataFrame:
    return durable(tables.load_references(spark, args.ref, args.circular, _names(args.circular_contigs), args.circular_overhang_percent))


def run_index(spark: SparkSession, args, results: Path) -> dict:
    _files(args.ref)
    out = str(results / sinks.with_suffix(args.out or Path(args.ref).stem, ".idx"))
    contigs = _references(spark, args)
    tables.save_index(mz.build_index(contigs, args.kmer, args.window), contigs, out, args.kmer, args.window)
    entries, contigs, _ = tables.load_index(spark, out)
    return {"index": out, **mz.index_stats(entries, contigs).first().asDict()}


def run_align(spark: SparkSession, args, results: Path) -> dict:
    paired = bool(args.fq1 or args.fq2)
    if paired == bool(args.fq) or paired and not (args.fq1 and args.fq2):
        raise UsageError("give either --fq, or both -1 and -2")
    if bool(args.ref) == bool(args.index):
        raise UsageError("give either --ref or --index")
    if args.filter_rrna and not args.rrna_db:
        raise UsageError("--filter-rrna needs --rrna-db")
    _files(args.ref, args.index, args.fq, args.fq1, args.fq2, args.rrna_db)
    o = al.Options(
        k=args.kmer, step=args.step, pad=args.pad, max_windows=args.max_windows, min_seed_hits=args.min_seed_hits, max_insert=args.max_insert,
        expected_insert=args.expected_insert, rescue_pad=args.rescue_pad, rescue=not args.no_rescue,
    )
    o = o.sensitive() if args.sensitive else o
    if args.index:
        index, contigs, about = tables.load_index(spark, args.index)
        o = al.replace(o, k=about["k"], w=about["w"])
    else:
        contigs = _references(spark, args)
        index = durable(mz.build_index(contigs, o.k, o.w))
    refs = [(r["contig"], r["orig_len"]) for r in contigs.orderBy("ord").select("contig", "orig_len").toLocalIterator()]
    out = results / (sinks.with_suffix(args.out, ".bam") if args.out else sinks.default_alignment_name(args.fq1 or args.fq))
    told: dict = {}
    if paired:
        reads = tables.read_fastq_pairs(spark, args.fq1, args.fq2)
    else:
        reads = tables.read_fastq(spark, args.fq)
    if args.filter_rrna:
        source = durable(rrna.kmer_set(tables.read_fasta(spark, args.rrna_db), args.rrna_k))
        if source.isEmpty():
            raise UsageError("the rRNA file holds no k-mer")
        keep = rrna.keep_pairs if paired else rrna.keep_reads
        kept = durable(keep(reads, source, args.rrna_k, args.rrna_min_hits))
        told = rrna.report(reads, kept).first().asDict()
        reads = kept
    if paired:
        hits = durable(al.align_pairs(reads.select("ordinal", "seq1", "seq2"), contigs, index, o))
        if args.debug_pairs:
            hits.filter(F.col("ordinal") < args.debug_pairs).show(args.debug_pairs, False)
        records = sinks.pair_records(reads, hits, args.as_read)
    else:
        hits = durable(al.align_single(reads.select("ordinal", "seq"), contigs, index, o))
        records = sinks.single_records(reads, hits, args.as_read)
    sinks.write_bam(records, refs, str(out))
    told |= {"bam": str(out), **al.mapping_stats(reads, hits).first().asDict()}
    if args.sort_bam:
        told["sorted"] = str(out).removesuffix(".bam") + ".sorted.bam"
        sinks.write_bam(records, refs, told["sorted"], sort=True)
    return told


def _alignments(spark: SparkSession, bams: list[str]) -> DataFrame:
    _files(*bams)
    files.probe_bam(*bams)
    rows = tables.read_bam(spark, *bams)
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) > 0
    return rows.withColumns({
        "arrival": F.col("file_ordinal"), "contig": F.col("rname"), "is_secondary": has(SECONDARY), "is_supplementary": has(SUPPLEMENTARY),
        "is_unmapped": has(UNMAPPED) | F.col("rname").isNull(),
    })


def _sample_names(bams: list[str]) -> list[str]:
    names = [Path(b).name.removesuffix(".bam").removesuffix(".sorted") for b in bams]
    if len(set(names)) != len(names):
        raise ValueError("sample names repeat: " + ", ".join(names))
    return names


def run_quantify(spark: SparkSession, args, results: Path) -> dict:
    _files(args.gff)
    names = _sample_names(args.bam)
    operon = args.feature_type == "operon"
    features = durable(tables.read_gff_strict(spark, args.gff, (args.feature_type,), args.id_attribute or ("ID" if operon else "locus_tag")))
    if features.isEmpty():
        raise ValueError(f"no {args.feature_type} with an id in {args.gff}")
    keys = ("sample", "qname", "frag")
    rows = _alignments(spark, args.bam)
    mates = durable(q.pair_mates(rows.filter("not is_secondary and not is_supplementary"), ("sample", "qname")).drop("seq", "qual", "tags"))
    cut = mates.filter("not is_unmapped").select(*keys, "mate", "contig", F.explode(blocks(F.col("pos0"), F.col("cigar"))).alias("b")).select("*", "b.*")
    lengths = durable(q.feature_lengths(features))
    merged = q.merge_intervals(features, ["gene_id", "contig", "strand"])
    assigned = durable(q.assign(q.fragments(mates, keys), q.mate_overlaps(cut, merged, keys), keys, args.min_overlap, args.largest_overlap))
    counts = q.gene_counts(assigned, lengths, ("sample",))
    stats = q.fragment_stats(mates, q.fragments(mates, keys))  # its counts of fragments need no second scan
    broken = q.violations(assigned, counts.groupBy("gene_id").agg(F.sum("count").alias("count")), lengths, stats).collect()
    if broken:
        raise RuntimeError("; ".join(r["violation"] for r in broken))
    values = durable(q.normalise(counts, ("sample",)))
    single = len(names) == 1
    kind = f"{args.feature_type}_{'counts' if single else 'expression_matrix'}"
    out = str(results / sinks.with_suffix(args.out or kind, ".tsv"))
    meta = None
    if operon:
        lenient = tables.read_gff_lenient(spark, args.gff, ("operon",))
        meta = lenient.select(F.col("gene_id").alias("operon_id"), F.col("chrom").alias("contig"), "start", "end", "strand")
        meta = meta.join(_operon_genes(spark, args.gff), "operon_id", "left")
    if operon and single:
        sinks.write_operon_counts(values, meta, out)
    elif single:
        sinks.write_gene_counts(values, out)
    else:
        sinks.write_matrix(values, names, out, meta=meta)
    told = {r["sample"]: {k: r[k] for k in q.STATUSES} for r in q.summary(assigned, ("sample",)).collect()}
    return {"table": out, "samples": told}


def _operon_genes(spark: SparkSession, gff: str) -> DataFrame:
    from riboplan.functions import attributes

    rows = spark.read.text(gff).select(F.split("value", "\t", -1).alias("c")).filter((F.size("c") == 9) & (F.get("c", F.lit(2)) == "operon"))
    return rows.select(attributes.strict(F.get("c", F.lit(8))).alias("a")).select(F.col("a")["ID"].alias("operon_id"), F.col("a")["genes"].alias("genes"))


def run_operons(spark: SparkSession, args, results: Path) -> dict:
    if args.threads < 1:
        raise UsageError("--threads must be at least 1")
    if not 0 <= args.min_support <= 1:
        raise UsageError("--min-support must be between 0 and 1")
    if args.out and len(args.bam) > 1 and not args.consensus:
        raise UsageError("--out with several files needs --consensus")
    _files(args.gff)
    names = _sample_names(args.bam)
    genes = durable(tables.read_gff_lenient(spark, args.gff))
    if genes.isEmpty():
        raise ValueError(f"no genes in {args.gff}")
    if genes.groupBy("gene_id").count().filter("count > 1").limit(1).count():
        raise ValueError("gene ids repeat")
    rows = _alignments(spark, args.bam).filter("not is_secondary and not is_unmapped and (flag & 1536) = 0")
    spans = rows.select("sample", "contig", F.col("pos0").cast("bigint").alias("start"), (F.col("pos0") + reference_length(F.col("cigar"))).cast("bigint").alias("end"))
    coverage = op.gene_coverage(spans, genes, ("sample",))
    # a file without a mapped record still is a sample
    every = F.broadcast(spark.createDataFrame([(n,) for n in names], "sample string")).crossJoin(genes.select("gene_id"))
    coverage = durable(every.join(coverage, ["sample", "gene_id"], "left").fillna(0.0, ["coverage"]))
    rules = {"max_igd": args.max_igd, "min_coverage": args.min_coverage, "min_ratio": args.min_cov_ratio}
    told = {}
    if args.consensus:
        jobs = [("consensus", op.consensus(genes, coverage, "sample", args.min_support, **rules))]
    else:
        found = durable(op.infer(genes, coverage, ("sample",), **rules))
        jobs = [(n, found.filter(F.col("sample") == n).drop("sample")) for n in names]
    for name, rows_ in jobs:
        kept = durable(op.numbered(rows_, min_score=args.min_score))
        path = str(results / sinks.with_suffix(args.out or f"{name}.{args.prefix}", ".tsv"))
        told[name] = {"table": path, "operons": sinks.write_operons(kept, path, args.consensus)}
        if args.write_gff:
            sinks.write_operon_gff(kept, path.removesuffix(".tsv") + ".gff")
    return told


VERBS = {"index": run_index, "align": run_align, "quantify": run_quantify, "getOperons": run_operons}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=getattr(args, "log", "INFO"), format="%(levelname)s %(message)s")
    base = sinks.init_workdir(args.dir or sinks.default_workdir(args.verb))
    sinks.update_manifest(base, verb=args.verb, arguments=vars(args))
    try:
        told = VERBS[args.verb](spark or session(str(getattr(args, "threads", 1) or 1) if getattr(args, "threads", 1) > 1 else "*"), args, base / "results")
    except UsageError as e:
        print(f"riboplan {args.verb}: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    sinks.update_manifest(base, results=told)
    log.info("%s", told)
    return 0


if __name__ == "__main__":
    sys.exit(main())
