"""The sequence queries read every document: held against SQL over views written in other words, and against plain loops."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riboplan import catalog
from riboplan.plans import views
from tests.test_queries import normal

BASES = views._BASES.replace("<G>", ",'g'")
#: The views in other words: as many windows as any of the texts here has.
UNCUT = {
    "contigs": f"SELECT concat('c',CAST(doc_id AS STRING)) contig, doc_id ord, {BASES} seq FROM documents",
    "reads": f"""SELECT doc_id*{views.ORDINALS}+j ordinal, concat('r',CAST(doc_id AS STRING),'_',CAST(j AS STRING)) name, substr({BASES},CAST(1+j*110 AS INT),150) seq
 FROM documents, generate_series(0,20) g(j) WHERE length({BASES})>j*110+CASE WHEN j=0 THEN 0 ELSE 40 END""",
}


def letters(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnop " * 4 + "q") for _ in range(n))


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Few documents: of no letter, one read, an odd number of reads and many, with copies far behind."""
    folder, long = tmp_path_factory.mktemp("whole"), letters(1, 1500)
    texts = [None, "12 .", letters(2, 90), letters(3, 300), long, letters(4, 700) + long[900:1300], letters(5, 420)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": [long[1000:1300]]}), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def uncut(sql):
    for name, text in UNCUT.items():
        assert "v_" + name not in sql or views.duck_view(name) in sql
        sql = sql.replace(f"({views.duck_view(name)})", f"({text})")
    return sql


def same(df, found):
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = normal([tuple(r) for r in df.collect()], df.columns), normal(found.fetchall(), columns)
    assert got == want and got


def test_every_document_is_a_contig(spark, con, data):
    same(views.spark_view(spark, data, "contigs"), con.execute(UNCUT["contigs"]))


@pytest.mark.parametrize("name", ["minimizer_index", "posting_lists", "index_stats"])
def test_contig_queries(spark, con, data, name):
    same(catalog.queries()[name](spark, data), con.execute(uncut(catalog.oracle_sql()[name])))


def test_reads_cover_every_letter(spark, con, data):
    same(views.spark_view(spark, data, "reads"), con.execute(UNCUT["reads"]))
    got = {}
    for r in views.spark_view(spark, data, "reads").orderBy("ordinal").collect():
        doc, j = divmod(r["ordinal"], views.ORDINALS)
        assert len(got.get(doc, "")) in (0, j * 110 + 40) and r["name"] == f"r{doc}_{j}"
        got[doc] = got.get(doc, "")[: j * 110] + r["seq"]
    assert got == {d: s for d, s in con.execute(f"select doc_id, {BASES} from documents").fetchall() if s}


@pytest.mark.parametrize("name", ["revcomp_reads", "kmer_counts", "read_minimizers", "seed_hits", "top_contigs", "window_votes", "rrna_filter", "rrna_report"])
def test_read_queries(spark, con, data, name):
    same(catalog.queries()[name](spark, data), con.execute(uncut(catalog.oracle_sql()[name])))


def test_candidate_windows(spark, con, data):
    same(catalog.queries()["candidate_windows"](spark, data), con.execute(uncut(catalog.oracle_sql()["candidate_windows"])))


def all_pairs(con):
    """Pair -> (name, first read, reverse complement of the second or None)."""
    reads = {o: (n, s) for o, n, s in con.execute(UNCUT["reads"]).fetchall()}
    turn = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    return {o // 2: (n, s, turn(reads[o + 1][1]) if o + 1 in reads else None) for o, (n, s) in reads.items() if o % 2 == 0}


def test_every_read_is_in_a_pair(spark, con, data):
    from riboplan.plans.sequence_queries import _pairs

    want = all_pairs(con)
    assert {r["ordinal"]: (r["name"], r["seq1"], r["seq2"]) for r in _pairs(spark, data).collect()} == want
    assert sum(1 + (x[2] is not None) for x in want.values()) == len(con.execute(UNCUT["reads"]).fetchall())


def test_rrna_filter_pairs(spark, con, data):
    probe = con.execute(f"select {BASES} from benchmark").fetchone()[0]
    source = {probe[i : i + 11] for i in range(len(probe) - 10)}
    few = lambda s: sum(s[i : i + 11] in source for i in range(len(s) - 10)) < 20
    pairs = all_pairs(con)
    want = {(o, n) for o, (n, a, b) in pairs.items() if few(a) and few(b or "")}
    assert {tuple(r) for r in catalog.queries()["rrna_filter_pairs"](spark, data).collect()} == want and len(want) < len(pairs)


def test_align_pairs_places_every_pair(spark, con, data):
    got = {r["ordinal"]: r for r in catalog.queries()["align_pairs"](spark, data).collect()}
    want = all_pairs(con)
    assert set(got) == set(want)
    for o, (_, a, b) in want.items():
        if o // (views.ORDINALS // 2) not in (4, 5):  # those share a part, and a proper pair on an earlier contig ends the search
            assert got[o]["cigar1"] == f"{len(a)}="
        assert b is not None or got[o]["cigar2"] is None and not got[o]["proper"]


def test_every_kmer_is_encoded(spark, con, data):
    def code(s):
        return None if "N" in s else min(int("".join("0123"["ACGT".index(c)] for c in x), 4) for x in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))))

    want = [(o, code(s[i : i + 15])) for o, _, s in con.execute(UNCUT["reads"]).fetchall() for i in range(len(s) - 14)]
    assert sorted((tuple(r) for r in catalog.queries()["kmer_encode"](spark, data).collect()), key=str) == sorted(want, key=str)


def test_whole_reads_are_located_in_whole_documents(spark, con, data):
    seqs = dict(con.execute(f"select doc_id, {BASES} from documents").fetchall())
    want = set()
    for o, _, s in con.execute(UNCUT["reads"]).fetchall():  # a read lies in its document without an edit
        at = seqs[o // views.ORDINALS].find(s)
        want.add((o, 0, f"{len(s)}=", at, at + len(s) - 1))
    got = catalog.queries()["edit_distance_hw"](spark, data)
    assert got.columns == ["ordinal", "edits", "cigar", "beg", "end"]
    assert {tuple(r) for r in got.collect()} == want
