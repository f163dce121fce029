"""Hand-computed cases of the rules, and properties against plain versions."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riboplan.functions import attributes, cigar, circular, scoring
from riboplan.functions.edit_distance import locate
from riboplan.functions.seq import canonical_code, chunked, check_k, revcomp, sample_name, strip_mate
from riboplan.operators import intervals, minimizers, operons, quantify, rrna

FEATURES = [("gA", "c1", "+", 0, 100), ("gB", "c1", "+", 80, 200), ("gC", "c1", "+", 300, 400)]
FRAGMENTS = {
    "f1": [(10, 60), (40, 90)], "f2": [(85, 95), (82, 92)], "f3": [(70, 120), None], "f4": [(10, 60), (310, 330)],
    "f5": [(220, 260), (230, 270)], "f6": [None, None], "f7": [(98, 110), (90, 100)], "f8": [(390, 420)],
}
EXPECTED = {
    (1, False): ["gA", "ambiguous", "ambiguous", "ambiguous", "no_feature", "unmapped", "ambiguous", "gC"],
    (1, True): ["gA", "ambiguous", "gB", "gA", "no_feature", "unmapped", "gB", "gC"],
    (20, False): ["gA", "ambiguous", "ambiguous", "ambiguous", "no_feature", "unmapped", "gB", "insufficient_overlap"],
}


@pytest.fixture(scope="module")
def mates(spark):
    rows = [(f, i, b is None, "c1", *(b or (0, 0))) for f, bs in FRAGMENTS.items() for i, b in enumerate(bs, 1)]
    return quantify.pair_mates(spark.createDataFrame(rows, "qname string, arrival long, is_unmapped boolean, contig string, start long, end long"))


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(FEATURES, "gene_id string, contig string, strand string, start long, end long")


def assigned(mates, features, *rule):
    keys = ("qname", "frag")
    over = quantify.mate_overlaps(mates.filter("not is_unmapped"), features, keys)
    return quantify.assign(quantify.fragments(mates, keys), over, keys, *rule)


@pytest.mark.parametrize("rule", list(EXPECTED))
def test_assignment(mates, features, rule):
    got = {r["qname"]: r["gene_id"] or r["status"] for r in assigned(mates, features, *rule).collect()}
    assert [got[f] for f in sorted(got)] == EXPECTED[rule]


def test_counts_and_normalisation(mates, features):
    a = assigned(mates, features)
    lengths = quantify.feature_lengths(features)
    rows = {r["gene_id"]: r for r in quantify.normalise(quantify.gene_counts(a, lengths)).collect()}
    assert {g: r["count"] for g, r in rows.items()} == {"gA": 1, "gB": 0, "gC": 1}
    assert rows["gA"]["rpkm"] == rows["gC"]["rpkm"] == 5_000_000 and rows["gA"]["tpm"] == 500_000
    s = quantify.summary(a).first()
    assert (s["assigned"], s["ambiguous"], s["no_feature"], s["unmapped"], s["insufficient_overlap"]) == (2, 4, 1, 1, 0)
    counts = quantify.gene_counts(a, lengths)
    stats = quantify.fragment_stats(mates.withColumns({"is_secondary": F.lit(False), "is_supplementary": F.lit(False)}), quantify.fragments(mates, ["qname", "frag"]))
    broken = lambda a=a, c=counts, f=lengths, s=stats: {r["violation"] for r in quantify.violations(a, c, f, s).collect()}
    assert broken() == set()
    assert broken(c=counts.withColumn("count", F.lit(-1))) == {"no count is negative", "counts sum to the assigned fragments"}
    assert broken(c=counts.unionAll(counts.filter("gene_id = 'gB'"))) == {"each feature has one count"}
    assert broken(c=counts.filter("gene_id != 'gB'")) == {"each feature is counted"}
    assert broken(f=lengths.filter("gene_id != 'gB'")) == {"each count has a feature"}
    assert broken(a=a.filter("status != 'unmapped'")) == {"each fragment has a status", "fragments without a mapped mate are unmapped"}
    none = quantify.normalise(counts.withColumn("count", F.lit(0))).collect()
    assert {(r["rpkm"], r["tpm"]) for r in none} == {(0.0, 0.0)}


def test_assignment_does_not_depend_on_the_order_of_mates(spark, features):
    rng = np.random.default_rng(0)
    rows, swapped = [], []
    for i in range(80):
        pair = [(int(a), int(a) + int(n)) for a, n in zip(rng.integers(0, 400, 2), rng.integers(1, 90, 2), strict=True)]
        for out, p in ((rows, pair), (swapped, pair[::-1])):
            out += [(f"r{i}", k, False, "c1", *b) for k, b in enumerate(p)]
    schema = "qname string, arrival long, is_unmapped boolean, contig string, start long, end long"
    for rule in ((1, False), (1, True), (30, True)):
        one, two = (sorted(map(str, assigned(quantify.pair_mates(spark.createDataFrame(r, schema)), features, *rule).collect())) for r in (rows, swapped))
        assert one == two


def test_third_record_opens_a_fragment_and_strict_pairs_raise(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("b", 1, 0)], "qname string, arrival long, mate_number int")
    assert sorted((r["qname"], r["frag"], r["mate"]) for r in quantify.pair_mates(rows).collect()) == [("a", 0, 1), ("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
    with pytest.raises(Exception, match="duplicate primary"):
        quantify.strict_fragments(rows).collect()
    ok = {r["qname"]: (r["read1"] is not None, r["read2"] is not None) for r in quantify.strict_fragments(rows.filter("arrival < 3")).collect()}
    assert ok == {"a": (True, True), "b": (True, False)}


def test_operons(spark):
    genes = [("a", "+", 1, 100, 10.0), ("b", "+", 150, 250, 8.0), ("c", "+", 400, 500, 9.0), ("d", "+", 480, 600, 1.0), ("e", "-", 700, 800, 5.0), ("f", "-", 820, 900, 5.0)]
    g = spark.createDataFrame([(n, "c1", s, a, b, i) for i, (n, s, a, b, _) in enumerate(genes)], "gene_id string, chrom string, strand string, start long, end long, ord long")
    cov = spark.createDataFrame([(n, c) for n, *_, c in genes], "gene_id string, coverage double")
    got = operons.numbered(operons.infer(g, cov)).orderBy("operon_id").collect()
    assert [(r["operon_id"], r["gene_ids"], r["igds"], round(r["score"], 3), r["confidence"]) for r in got] == [
        ("operon_1", "a,b", "49", 0.240, "LOW"), ("operon_2", "c", "", 0.0, "LOW"), ("operon_3", "d", "", 0.0, "LOW"), ("operon_4", "f,e", "19", 0.729, "MEDIUM"),
    ]
    assert [r["gene_ids"] for r in operons.numbered(operons.infer(g, cov), min_score=0.5).collect()] == ["f,e"]
    two = cov.withColumn("sample", F.lit("x")).unionByName(cov.withColumn("coverage", F.lit(0.0)).withColumn("sample", F.lit("y")))
    assert {(r["prev_id"], r["gene_id"]): r["support"] for r in operons.pair_support(g, two).collect()}[("a", "b")] == 0.5
    assert sorted(r["n_genes"] for r in operons.consensus(g, two, min_support=0.0).collect()) == [2, 4]
    assert max(r["n_genes"] for r in operons.consensus(g, two, min_support=0.6).collect()) == 1


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    L = F.lit
    assert val(circular.insert_size(L(900), L("+"), L(50), L("-"), L(100), L(1000))) == 250
    assert val(circular.expected_mate_start(L(900), L("+"), L("-"), L(300), L(100), L(1000))) == 100
    assert val(circular.expected_mate_start(L(900), L("+"), L("+"), L(300), L(100), L(1000))) is None
    assert val(circular.original_pos(L(20), L(50), L(1000))) == 970 and val(circular.crosses_origin(L(20), L(100), L(50), L(1000)))
    assert not val(circular.crosses_origin(L(50), L(100), L(50), L(1000)))
    assert [val(scoring.single_mapq(L(-2), s)) for s in (L(-10), L(None).cast("int"), L(-2))] == [18, 60, 10]
    yes = L(True)
    assert val(scoring.pair_flag(True, yes, L("+"), yes, L("-"), yes)) == 99 and val(scoring.pair_flag(False, yes, L("-"), yes, L("+"), yes)) == 147
    assert (val(circular.overhang(L(10), L(5))), len(val(circular.padded(L("ACGTACGTAC"), L(5))))) == (1, 12)
    assert val(circular.padded(L("ACG"), L(100))) == "ACGACG" and val(circular.overhang(L(3), L(100))) == 0 and val(circular.padded(L("ACG"), L(0))) == "ACG"
    assert val(circular.proper_linear(L(10), L("+"), L(200), L("-"), L(100), L(300))) and not val(circular.proper_linear(L(10), L("+"), L(200), L("+"), L(100), L(300)))
    assert val(scoring.score_mapq(L(-3), L(100), L(5))) == 0 and val(scoring.rescue_mapq(L(4))) == 56
    assert val(scoring.template_length(L(10), L(60), L(100), L(150))) == 140 and val(scoring.template_length(L(100), L(150), L(10), L(60))) == -140
    assert (val(strip_mate(L("r/1"))), val(sample_name(L("/a/x.sorted.bam"))), val(sample_name(L("Y.BAM"))), val(sample_name(L("Y.BAM"), True))) == ("r", "x", "Y.BAM", "Y")
    with pytest.raises(Exception, match="positive"):
        val(circular.norm_pos(L(1), L(0)))
    assert list(chunked(range(5), 2)) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        list(chunked([], 0))
    with pytest.raises(ValueError):
        check_k(32)
    m = spark.createDataFrame([(990,), (10,)], "p long").agg(circular.circular_mean(F.col("p"), L(1000)).alias("m")).first()["m"]
    assert min(m, 1000 - m) < 1e-6


def test_cigars(spark):
    rows = spark.createDataFrame([("5S3D10=2N4X3I5M", 100), (None, 0), ("*", 0), ("10=", 7)], "c string, p long")
    got = [tuple(r) for r in rows.select(cigar.reference_length(F.col("c")), cigar.leading_gap(F.col("c"))).collect()]
    assert got == [(24, 3), (0, 0), (0, 0), (10, 0)]
    b = rows.select(cigar.blocks(F.col("p"), F.col("c")).alias("b")).first()["b"]
    assert [(x["start"], x["end"]) for x in b] == [(103, 113), (115, 119), (119, 124)]
    trim = lambda c, a, z: spark.range(1).select(cigar.trim_pads(F.lit(c), F.lit(a), F.lit(z)).alias("x")).first()["x"]
    assert [trim("10=", 3, 2), trim("2=3I8=", 2, 0), trim("5=", 3, 3), trim("4=2D4=", 5, 0)] == ["5=", "3I8=", "", "1D4="]


def test_attributes(spark):
    rows = spark.createDataFrame([(" ID=a%20b;x= y +z ;bad;=e;ID=c;Name=%zz;",), ("gene=g;ID=",), ("",)], "t string")
    got = rows.select(attributes.strict(F.col("t")).alias("s"), attributes.lenient(F.col("t")).alias("l"), attributes.lenient_id(attributes.lenient(F.col("t"))).alias("i")).collect()
    assert got[0]["s"] == {"x": "y +z", "ID": "c", "Name": "%zz"} and [r["i"] for r in got] == ["c", "g", "unknown"]


def union(xs):
    out = []
    for s, e in sorted(x for x in xs if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


pairs = st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 3000)).map(lambda x: (x[0], x[0] + x[1])), max_size=25)


@settings(max_examples=8, deadline=None)
@given(pairs, pairs)
def test_intervals_against_plain_loops(spark, a, b):
    left = spark.createDataFrame([(1, *x) for x in a], "k int, start long, end long")
    right = spark.createDataFrame([(1, i, *x) for i, x in enumerate(b)], "k int, id int, r_start long, r_end long")
    got = sorted((r["start"], r["end"], r["id"], r["overlap"]) for r in intervals.overlap_join(left, right, ["k"]).collect())
    assert got == sorted((s, e, i, min(e, f) - max(s, t)) for s, e in a for i, (t, f) in enumerate(b) if s < f and t < e and e > s and f > t)
    shuffled = intervals.overlap_join(left, right, ["k"], broadcast_rows=0)
    assert sorted((r["start"], r["end"], r["id"], r["overlap"]) for r in shuffled.collect()) == got
    merged = intervals.merge_intervals(left, ["k"])
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == union(a)


def plain_minimizers(seq, k, w):
    comp = str.maketrans("ACGT", "TGCA")
    code = {}
    for i in range(len(seq) - k + 1):
        x = seq[i : i + k]
        if set(x) <= set("ACGT"):
            n = min(x, x.translate(comp)[::-1])
            code[i] = int(n.translate(str.maketrans("ACGT", "0123")), 4)
    out = set()
    for i in range(len(seq) - k - w + 2):
        best = min(((code[j], -j) for j in range(i, i + w) if j in code), default=None)
        if best:
            out.add((best[0], -best[1]))
    return out


def test_minimizers(spark, monkeypatch):
    one = spark.createDataFrame([("c", "ACGTA")], "contig string, seq string")
    assert [(r["seed"], r["pos"]) for r in minimizers.reference_minimizers(one, 3, 2).collect()] == [(6, 1)]
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGTN"), int(rng.integers(0, 120)), p=[0.24] * 4 + [0.04])) for _ in range(40)] + ["A" * 60]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "contig string, seq string")
    monkeypatch.setattr(minimizers, "TILE", 7)
    rows = [(r["contig"], r["seed"], r["pos"]) for r in minimizers.reference_minimizers(df, 5, 4).collect()]
    got = set(rows)
    assert len(got) == len(rows)
    assert got == {(str(i), c, p) for i, s in enumerate(seqs) for c, p in plain_minimizers(s, 5, 4)}
    codes = spark.createDataFrame([("ACG",), ("ANG",), ("TTT",)], "s string").select(canonical_code(F.col("s")).alias("c"), revcomp(F.col("s")).alias("r")).collect()
    assert [tuple(r) for r in codes] == [(6, "CGT"), (None, "CNT"), (0, "AAA")]


def test_rrna_filter(spark):
    source = rrna.kmer_set(spark.createDataFrame([("acguacgu",)], "seq string"), 4)
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTTTTTT"), (3, "ACG")], "ordinal long, seq string")
    assert sorted(r["ordinal"] for r in rrna.keep_reads(reads, source, 4, 3).collect()) == [2, 3]
    two = spark.createDataFrame([(1, "TTTT", "ACGTACGT"), (2, "TTTT", "GGGG")], "ordinal long, seq1 string, seq2 string")
    assert [r["ordinal"] for r in rrna.keep_pairs(two, source, 4, 3).collect()] == [2]


def plain_distance(q, r):
    last = [0] * (len(r) + 1)
    for i, a in enumerate(q, 1):
        row = [i]
        for j, b in enumerate(r, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[-1] + 1))
        last = row
    return min(last[1:])


def test_edit_distance_kernel():
    rng = np.random.default_rng(6)
    qs = ["".join(rng.choice(list("ACGT"), int(rng.integers(1, 40)))) for _ in range(120)] + ["", "A", "ACGT"]
    rs = ["".join(rng.choice(list("ACGT"), int(rng.integers(1, 90)))) for _ in range(120)] + ["A", "", "TTACGTTT"]
    for q, r, hit, bare in zip(qs, rs, locate(qs, rs), locate(qs, rs, path=False), strict=True):
        if not q or not r:
            assert hit is None
            continue
        assert hit.edits == bare.edits == plain_distance(q, r) and bare.end == hit.end
        n, i, j, cost = "", 0, hit.beg, 0
        for c in hit.cigar:  # the path replays query, span and cost
            if c.isdigit():
                n += c
                continue
            for _ in range(int(n)):
                if c in "=X":
                    assert (q[i] == r[j]) == (c == "=")
                    i, j = i + 1, j + 1
                else:
                    i, j = i + (c == "I"), j + (c == "D")
                cost += c != "="
            n = ""
        assert (i, j, cost) == (len(q), hit.end + 1, hit.edits)


def test_reads_over_the_origin(spark):
    """A read over the origin of a circle is found on the padded sequence, on a linear contig it is not there."""
    import random

    from riboplan.functions.circular import overhang, padded
    from riboplan.operators import align, minimizers

    rng = random.Random(5)
    one, two = ("".join(rng.choice("ACGT") for _ in range(1200)) for _ in "ab")
    v = spark.createDataFrame([("c", 0, one, True), ("l", 1, two, False)], "contig string, ord long, seq string, circular boolean")
    n, five = F.length("seq"), F.lit(5)
    over = F.when(F.col("circular"), overhang(n, five)).otherwise(0)
    contigs = v.select("contig", "ord", "circular", n.alias("orig_len"), over.alias("overhang"), F.when(F.col("circular"), padded(F.col("seq"), five)).otherwise(F.col("seq")).alias("seq"))
    reads = [one[-50:] + one[:50], one[300:400], two[700:800]]
    rows = spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string")
    index = minimizers.build_index(contigs)
    got = {r["ordinal"]: (r["contig"], r["pos0"], r["cigar"], r["junction"]) for r in align.align_single(rows, contigs, index).collect()}
    assert got == {0: ("c", 1150, "100=", True), 1: ("c", 300, "100=", False), 2: ("l", 700, "100=", False)}


def test_a_gene_without_a_read_is_not_covered(spark):
    genes = spark.createDataFrame([("a", "c", "+", 1, 100), ("b", "c", "+", 201, 300)], "gene_id string, chrom string, strand string, start long, end long")
    spans = spark.createDataFrame([("s", "c", 0, 50), ("t", "c", 200, 300)], "sample string, contig string, start long, end long")
    assert {tuple(r) for r in operons.gene_coverage(spans, genes, ["sample"]).collect()} == {("s", "a", 0.5), ("s", "b", 0.0), ("t", "a", 0.0), ("t", "b", 1.0)}


def test_equal_blocks_of_both_mates_count_once(spark):
    blocks = spark.createDataFrame([("q", m, "c", s, s + 50) for m in (1, 2) for s in (0, 90)], "qname string, mate int, contig string, start long, end long")
    features = spark.createDataFrame([("g", "c", 0, 500)], "gene_id string, contig string, start long, end long")
    assert [tuple(r) for r in quantify.union_overlaps(blocks, features, ["qname"]).collect()] == [("q", "g", 100)]


def test_shuffled_overlaps_come_home(spark, mates, features, monkeypatch):
    keys = ("qname", "frag")
    mapped = mates.filter("not is_unmapped")
    want = sorted(map(tuple, quantify.mate_overlaps(mapped, features, keys).collect()))
    monkeypatch.setattr(quantify, "BROADCAST_FEATURES", -1)
    rows = quantify.mate_overlaps(mapped, features, keys, (7, ("qname",)))
    assert sorted(map(tuple, rows.collect())) == want
    assert "hashpartitioning(qname#" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    from riboplan import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.parts_of(spark.range(300), spark.range(1)) == 31 and session.parts_of(spark.range(5)) == least


def test_kmers_are_counted_before_they_are_rows(spark):
    seqs = ["ACGTNACGT", "ACG", None, "", "ACGTA" * 3]
    want = {}
    for s in seqs:
        for i in range(len(s or "") - 3):
            want[s[i : i + 4]] = want.get(s[i : i + 4], 0) + 1
    rows = minimizers.kmer_counts(spark.createDataFrame(list(enumerate(seqs)), "ordinal long, seq string"), 4)
    assert {r["kmer"]: r["n"] for r in rows.collect()} == want
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_fragments_and_genes_meet_in_partitions_that_grow(spark, data, monkeypatch):
    from riboplan import session
    from riboplan.plans import quantify_queries

    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = quantify_queries.record_parts(spark, data)
        assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name, keys in (("fragment_assignment_default", r"qname#\d+L?, frag#\d+L?"), ("gene_counts_zero_filled", r"gene_id#\d+"), ("multi_sample_expression", r"sample#\d+, gene_id#\d+")):
            plan = quantify_queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
            sides = re.findall(rf"hashpartitioning\({keys}, (\d+)\)", plan)
            assert sides.count(str(parts)) >= 2, name
            if name == "fragment_assignment_default":  # counts by gene are summed in the session's number before they move
                assert set(sides) == {str(parts)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["mate_overlap_detail", "fragment_assignment_default", "fragment_assignment_largest"])
@pytest.mark.parametrize("features", [500_000, -1])
def test_every_shuffle_of_records_grows(spark, data, monkeypatch, name, features):
    from riboplan import session
    from riboplan.plans import quantify_queries

    query = quantify_queries.QUERIES[name]
    want = sorted(map(str, query(spark, data).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    monkeypatch.setattr(quantify, "BROADCAST_FEATURES", features)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = query(spark, data)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        sides = set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan))
        assert sides == {str(quantify_queries.record_parts(spark, data))} != {spark.conf.get("spark.sql.shuffle.partitions")}
        assert ("_bin#" in "".join(re.findall(r"hashpartitioning\(.*?\)", plan))) == (features < 0)
        assert sorted(map(str, rows.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _nodes(plan):
    """Names and texts of the nodes of an executed plan; what a reused exchange repeats is left out."""
    name = plan.nodeName()
    yield name, plan.simpleString(25)
    if name == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from _nodes(plan.plan())
    elif name != "ReusedExchange":
        for i in range(plan.children().size()):
            yield from _nodes(plan.children().apply(i))


@pytest.mark.parametrize("name", ["fragment_assignment_default", "fragment_assignment_largest"])
def test_fragments_and_blocks_share_one_shuffle_of_records(spark, data, name):
    from riboplan.plans import quantify_queries

    rows = quantify_queries.QUERIES[name](spark, data)
    rows.collect()
    nodes = list(_nodes(rows._jdf.queryExecution().executedPlan()))
    assert sum("Scan" in n and "l_orderkey" in text for n, text in nodes) == 1
    assert sum(n == "ReusedExchange" and "l_orderkey" in text for n, text in nodes) == 1
    assert not any(n == "Sort" and "l_extendedprice" in text and "l_quantity" not in text for n, text in nodes)  # the window takes the order as it comes


def test_records_that_arrival_leaves_equal_lie_in_one_order(spark, tmp_path):
    from riboplan.plans import quantify_queries

    spark.createDataFrame([(i, 1) for i in range(8)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
    equal = [(k, 1, 1, 3, float(n), 5.0, 0.0, flag, "F") for k in range(20) for n, flag in ((4, "A"), (3, "R"), (2, "A"), (1, "R"))]
    got = []
    for i, lines in enumerate((equal, equal[::-1])):
        spark.createDataFrame(lines, line).write.parquet(str(tmp_path / f"{i}.parquet"))
        (tmp_path / f"{i}.parquet").rename(tmp_path / "lineitem.parquet")
        m = quantify_queries.mates(spark, str(tmp_path))
        got.append(sorted(map(str, m.select("qname", "frag", "mate", "is_unmapped", "gap").collect())))
        (tmp_path / "lineitem.parquet").rename(tmp_path / f"{i}.parquet")
    assert got[0] == got[1] and len(got[0]) == 80
