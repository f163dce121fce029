"""Formats, the command line from reads to operons, and the streaming form."""

import gzip
import json
import random

import pytest

from riboplan import cli
from riboplan.sources import bgzf, files, sinks, tables
from riboplan.streaming import mates


def test_fasta_and_references(spark, tmp_path):
    text = ">c1 first\nacg\n\nTNA\r\n>c2\nGGGGCCCCAA\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    for name in ("a.fa", "b.fa.gz"):
        assert [(r["name"], r["seq"]) for r in tables.read_fasta(spark, str(tmp_path / name)).orderBy("ord").collect()] == [("c1", "ACGTNA"), ("c2", "GGGGCCCCAA")]
    refs = tables.load_references(spark, str(tmp_path / "a.fa"), circular_contigs=["c2"], percent=5).orderBy("ord").collect()
    assert [(r["contig"], r["seq"], r["circular"], r["orig_len"], r["overhang"]) for r in refs] == [("c1", "ACGTNA", False, 6, 0), ("c2", "AGGGGCCCCAAG", True, 10, 1)]
    with pytest.raises(ValueError):
        tables.load_references(spark, str(tmp_path / "a.fa"), percent=101)
    for bad, said in ((">x\nA\n>x\nC\n", "repeated contig"), (">x\n>y\nC\n", "empty contig"), ("ACG\n>x\nA\n", "before the first header")):
        (tmp_path / "bad.fa").write_text(bad)
        with pytest.raises(Exception, match=said):
            tables.load_references(spark, str(tmp_path / "bad.fa")).collect()


def test_fastq(spark, tmp_path):
    one = "@r1/1 x\nACGT\n+\nIIII\n@r2/1\nGGGG\n+\nJJJJ\n"
    (tmp_path / "1.fq").write_text(one)
    with gzip.open(tmp_path / "2.fq.gz", "wt") as f:
        f.write(one.replace("/1", "/2"))
    pairs = tables.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq.gz")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], r["seq1"], r["qual2"]) for r in pairs] == [(0, "r1", "ACGT", "IIII"), (1, "r2", "GGGG", "JJJJ")]
    (tmp_path / "3.fq").write_text(one.split("@r2")[0])
    with pytest.raises(Exception, match="different numbers"):
        tables.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "3.fq")).collect()
    (tmp_path / "4.fq").write_text(one.replace("r2", "q2"))
    with pytest.raises(Exception, match="names differ"):
        tables.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "4.fq")).collect()
    (tmp_path / "5.fq").write_text("r1\nA\n+\nI\n")
    with pytest.raises(Exception, match="does not begin"):
        tables.read_fastq(spark, str(tmp_path / "5.fq")).collect()


def test_gff(spark, tmp_path):
    good = "##gff\nc1\ts\tgene\t1\t100\t.\t+\t.\tID=x;locus_tag=a%20b\nc1\ts\tCDS\t1\t9\t.\t+\t.\tID=y\nc1\ts\tgene\t5\t9\t.\t-\t.\tName=n\n"
    (tmp_path / "a.gff").write_text(good)
    rows = tables.read_gff_strict(spark, str(tmp_path / "a.gff")).collect()
    assert [(r["gene_id"], r["start"], r["end"], r["strand"]) for r in rows] == [("a b", 0, 100, "+")]
    (tmp_path / "b.gff").write_text(good + "one\ttwo\n")
    lenient = tables.read_gff_lenient(spark, str(tmp_path / "b.gff")).orderBy("ord").collect()
    assert [(r["gene_id"], r["start"], r["end"]) for r in lenient] == [("x", 1, 100), ("n", 5, 9)]
    for line, said in (("one\ttwo", "nine columns"), ("c\ts\tgene\t9\t5\t.\t+\t.\tlocus_tag=a", "bad coordinates"), ("c\ts\tgene\tx\t5\t.\t+\t.\tlocus_tag=a", "not a coordinate"), ("c\ts\tgene\t1\t5\t.\t.\t.\tlocus_tag=a", "no strand")):
        (tmp_path / "c.gff").write_text(good + line + "\n")
        with pytest.raises(Exception, match=said):
            tables.read_gff_strict(spark, str(tmp_path / "c.gff")).collect()


RECORDS = [
    ("r1", 99, "c1", 10, 60, "4=1X", "=", 40, 50, "ACGTN", "IIIII", {"NM": "i:1", "AS": "i:-1", "XC": "Z:JUNCTION"}),
    ("r1", 147, "c2", 3, 0, "2I3M", "c1", 10, -50, "ACGTA", "*", {}),
    ("r2", 4, None, None, 0, None, None, None, 0, "A", "I", None),
    ("r3", 0, "c1", 2, 60, "1=", None, None, 0, "", "", {}),
]
SCHEMA = "qname string, flag int, rname string, pos0 int, mapq int, cigar string, rnext string, pnext0 int, tlen int, seq string, qual string, tags map<string,string>"
REFS = [("c1", 1000), ("c2", 70_000)]


def test_bam_round_trip(spark, tmp_path):
    df = spark.createDataFrame(RECORDS, SCHEMA)
    sinks.write_bam(df, REFS, str(tmp_path / "x.sorted.bam"), sort=True)
    got = tables.read_bam(spark, str(tmp_path / "x.sorted.bam"), require_order=True).orderBy("file_ordinal").collect()
    assert [r["qname"] for r in got] == ["r3", "r1", "r1", "r2"] and {r["sample"] for r in got} == {"x"}
    sinks.write_bam_parts(df.repartition(2), REFS, str(tmp_path / "parts"))
    back = tables.read_bam(spark, str(tmp_path / "parts")).collect()
    for r in RECORDS:
        (b,) = [x for x in back if x["qname"] == r[0] and x["flag"] == r[1]]
        assert (b["rname"], b["pos0"], b["mapq"], b["cigar"], b["tlen"], b["seq"]) == (r[2], r[3], r[4], r[5], r[8], r[9])
        assert b["rnext"] == (r[2] if r[6] == "=" else r[6]) and (b["tags"] or {}) == (r[11] or {})
    with pytest.raises(Exception, match="not sorted"):
        tables.read_bam(spark, str(tmp_path / "parts"), require_order=True).collect()
    raw = (tmp_path / "x.sorted.bam").read_bytes()
    assert raw.endswith(bgzf.END_OF_FILE) and gzip.decompress(raw)[:4] == b"BAM\1"
    with pytest.raises(FileNotFoundError):
        tables.read_bam(spark, str(tmp_path / "none.bam")).collect()
    files.probe_bam(str(tmp_path / "x.sorted.bam"), str(tmp_path / "parts"))
    for n, bad in enumerate((b"", b"no BAM", raw[: len(raw) // 3])):
        (tmp_path / f"bad{n}.bam").write_bytes(bad)
        with pytest.raises(ValueError, match=f"bad{n}.bam"):
            files.probe_bam(str(tmp_path / f"bad{n}.bam"))


def test_number_format(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0000125, 3), ("b", None, 1)], "k string, x double, n int")
    sinks.write_tsv(df, str(tmp_path / "t"), ["k", "x", "n"], ["k"], digits=6, as_float=("x", "n"))
    assert (tmp_path / "t").read_text() == "k\tx\tn\na\t0.000013\t3.000000\nb\t\t1.000000\n"
    assert sinks.default_alignment_name("/x/s_R1.fastq.gz") == "s.bam"


COMP = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rnd = random.Random(1)
    folder = tmp_path_factory.mktemp("genome")
    seqs = {"chr": "".join(rnd.choices("ACGT", k=6000)), "plasmid": "".join(rnd.choices("ACGT", k=1500))}
    (folder / "ref.fa").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
    f1, f2, truth = [], [], []
    for i in range(60):
        name = "plasmid" if i % 4 == 0 else "chr"
        s = seqs[name] * (2 if name == "plasmid" else 1)
        at = rnd.randrange(1500 if name == "plasmid" else 6000 - 300)
        frag = s[at : at + 300]
        r1, r2 = list(frag[:100]), list(frag[-100:].translate(COMP)[::-1])
        r1[50] = "A" if r1[50] != "A" else "C"
        f1.append(f"@q{i}/1\n{''.join(r1)}\n+\n{'I' * 100}\n")
        f2.append(f"@q{i}/2\n{''.join(r2)}\n+\n{'I' * 100}\n")
        truth.append((name, at, (at + 200) % len(seqs[name])))
    f1.append(f"@q60/1\n{'ACGT' * 25}\n+\n{'I' * 100}\n")
    f2.append(f"@q60/2\n{'TTGA' * 25}\n+\n{'I' * 100}\n")
    (folder / "s_R1.fq").write_text("".join(f1))
    (folder / "s_R2.fq").write_text("".join(f2))
    genes = [f"chr\tx\tgene\t{a + 1}\t{a + 900}\t.\t+\t.\tID=g{a};locus_tag=g{a}\n" for a in range(0, 6000, 950)]
    (folder / "genes.gff").write_text("##gff-version 3\n" + "".join(genes))
    return folder, truth


def test_command_line_from_reads_to_operons(spark, genome, tmp_path):
    folder, truth = genome
    run = lambda *a: cli.main(["-d", str(tmp_path), *map(str, a)], spark)
    assert run("index", "-r", folder / "ref.fa", "-n", "plasmid", "-o", "ref") == 0
    assert run("align", "-x", tmp_path / "results/ref.idx", "-1", folder / "s_R1.fq", "-2", folder / "s_R2.fq", "--sort-bam") == 0
    told = json.loads((tmp_path / "run_manifest.json").read_text())["results"]
    assert told["total"] == 61 and told["mapped"] == 60
    rows = tables.read_bam(spark, told["bam"]).collect()
    assert len(rows) == 122
    by = {(r["qname"], bool(r["flag"] & 64)): r for r in rows}
    right = 0
    for i, (name, a, b) in enumerate(truth):
        one, two = by[f"q{i}", True], by[f"q{i}", False]
        right += (one["rname"], one["pos0"], two["pos0"]) == (name, a, b) and bool(one["flag"] & 2) and not one["flag"] & 16 and bool(two["flag"] & 16)
        if one["pos0"] == a:
            assert one["tags"]["NM"] == "i:1" and one["cigar"] == "50=1X49="
    assert right >= 58
    assert by["q60", True]["flag"] == 64 + 1 + 4 + 8
    bam, gff = told["sorted"], folder / "genes.gff"
    assert run("quantify", "-b", bam, "-g", gff, "-o", "counts") == 0
    lines = (tmp_path / "results/counts.tsv").read_text().splitlines()
    assert lines[0].split("\t") == list(sinks.GENE_COUNTS) and len(lines) == 8
    assert sum(float(x.split("\t")[2]) for x in lines[1:]) == json.loads((tmp_path / "run_manifest.json").read_text())["results"]["samples"]["s"]["assigned"]
    assert run("getOperons", "-b", bam, "-g", gff, "-o", "ops", "--consensus", "--write-gff") == 0
    assert (tmp_path / "results/ops.tsv").read_text().startswith("operon_id\tchrom") and "consensus_score" in (tmp_path / "results/ops.tsv").read_text()
    assert run("quantify", "-b", bam, "-g", tmp_path / "results/ops.gff", "--feature-type", "operon", "-o", "opcounts") == 0
    assert (tmp_path / "results/opcounts.tsv").read_text().startswith("operon_id\tcontig\tstart")
    other = tmp_path / "other.bam"
    other.write_bytes((tmp_path / "results/s.bam").read_bytes())
    assert run("quantify", "-b", bam, other, "-g", gff, "-o", "matrix") == 0
    assert (tmp_path / "results/matrix.tsv").read_text().splitlines()[0].split("\t")[2:] == [f"{s}.{m}" for s in ("s", "other") for m in ("count", "RPKM", "TPM")]


def test_single_end_and_usage_errors(spark, genome, tmp_path):
    folder, truth = genome
    run = lambda *a: cli.main(["-d", str(tmp_path), *map(str, a)], spark)
    assert run("align", "-r", folder / "ref.fa", "--fq", folder / "s_R1.fq", "--filter-rrna", "--rrna-db", folder / "ref.fa", "--rrna-min-hits", 1000) == 0
    rows = {r["qname"]: r for r in tables.read_bam(spark, str(tmp_path / "results/s.bam")).collect()}
    linear = [(i, t) for i, t in enumerate(truth) if t[0] == "chr"]
    assert sum(rows[f"q{i}/1"]["pos0"] == a for i, (_, a, _) in linear) >= len(linear) - 1
    assert rows["q60/1"]["flag"] == 4
    assert run("align", "-r", folder / "ref.fa") == 2
    assert run("align", "-r", folder / "ref.fa", "--fq", folder / "s_R1.fq", "--filter-rrna") == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
    with pytest.raises(FileNotFoundError):
        run("quantify", "-b", "none.bam", "-g", folder / "genes.gff")


def test_streaming_pairs(spark, tmp_path, monkeypatch):
    schema = "qname string, arrival long"
    for n, rows in enumerate(([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5), ("d", 6), ("d", 7)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = mates.pair_stream(mates.reads_stream(spark, f"{tmp_path}/in", schema))
    query = stream.writeStream.format("memory").queryName("paired").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
        got = sorted((r["qname"], r["first_arrival"], r["second_arrival"], r["orphan"]) for r in spark.sql("select * from paired").collect())
    finally:
        query.stop()
    assert got == [("a", 1, 3, False), ("b", 2, 4, False), ("d", 6, 7, False)]


def test_streaming_orphans(spark, tmp_path):
    import datetime as dt

    schema = "qname string, arrival long, ts timestamp"
    day = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    folder, found = f"{tmp_path}/in", []

    def drained(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = mates.pair_stream(mates.reads_stream(spark, folder, schema), "ts", late_ms=300_000)
        keep = lambda df, _: found.extend(tuple(r) for r in df.collect())
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()

    drained([("a", 1, day(0)), ("b", 2, day(0)), ("c", 3, day(0))])
    assert found == []  # all still wait
    drained([("b", 4, day(0)), ("d", 5, day(9))])
    drained([("e", 6, day(9)), ("d", 7, day(9))])
    assert sorted(found, key=str) == [("a", 1, None, True), ("b", 2, 4, False), ("c", 3, None, True), ("d", 5, 7, False)]


def test_index_format_is_checked(spark, tmp_path):
    spark.createDataFrame([('{"format": "other"}',)], "value string").coalesce(1).write.text(f"{tmp_path}/i/about")
    with pytest.raises(ValueError, match="not an index"):
        tables.load_index(spark, f"{tmp_path}/i")
