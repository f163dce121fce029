import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riboplan.llm import language_id, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_accuracy_on_held_out_rows(spark, docs):
    from riboplan.llm.queries import op2_language_id

    got = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs):
    model = language_id.fit(docs.select("doc_id", "lang", "text"))
    rows = [(1, None), (2, ""), (3, "123 ... !"), (None, "the and of to in the"), (5, "x"), (6, "der die das und " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] == "de" and got[5][0] in model["langs"]
    nothing = language_id.fit(df.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"))
    assert {r["lang_pred"] for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).collect() == []


def test_lookups_equal_the_network():
    rng = np.random.default_rng(0)
    model = language_id.train([(lang, bytes(rng.integers(97 + 5 * k, 105 + 5 * k, 500).astype(np.uint8))) for k, lang in enumerate("ab") for _ in range(4)])
    net = language_id.PooledConvolutions(256, language_id.DIM, language_id.WIDTHS, language_id.FILTERS, 2, 0)
    net.p = {k: v for k, v in model.items() if k != "langs"}
    ids = rng.integers(1, 255, (6, language_id.WINDOW))
    slow, _ = net.forward(ids)
    fast = language_id.pooled(np.ascontiguousarray(ids.T.astype(np.uint8)), language_id.tables(model)) @ model["V"] + model["c"]
    assert np.allclose(slow, fast, atol=1e-3)


def test_gradients_match_finite_differences():
    net = language_id.PooledConvolutions(9, 3, (1, 2), 4, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, y = np.random.default_rng(1).integers(1, 9, (5, 7)), np.array([0, 1, 1, 0, 1])
    _, g = net.gradients(ids, y)
    for name, at in (("V", (2, 1)), ("W2", (3, 1)), ("b1", (0,)), ("c", (1,)), ("E", (int(ids[0, 0]), 1))):
        old, step = net.p[name][at], 1e-5
        net.p[name][at] = old + step
        up = net.gradients(ids, y)[0]
        net.p[name][at] = old - step
        down = net.gradients(ids, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4


def test_toxicity_on_held_out_rows(spark):
    from riboplan.llm.queries import op10_toxicity

    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = op10_toxicity(spark, d).join(labels, "doc_id", "left").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = collections.Counter((r["toxic"], r["predicted"]) for r in rows if r["held_out"] and r["toxic"] is not None)
    # some 300 toxic rows to learn from here; with 1,400 of them nothing is missed
    assert held[1, 1] / (held[1, 1] + held[1, 0]) >= 0.85
    assert held[0, 0] / (held[0, 0] + held[0, 1]) >= 0.98


def test_toxicity_edges(spark):
    rows = [(i, "en", "good day " * 5 + ("idiot" if i % 2 else "friend")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you IDIOT!"), (4, "a " * 200_000 + "idiot")], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(odd, model).collect()}
    assert got == {1: 0, 2: 0, None: 1, 4: 1}
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.predict(odd, none).collect()} == {0.0}
    assert toxicity.predict(odd.limit(0), model).collect() == []


def test_toxicity_learns_from_whole_texts(spark):
    rows = [(i, "en", "good day " * 2500 + ("idiot" if i % 2 else "friend")) for i in range(60)]  # the word stands at letter 22,500
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))
    new = spark.createDataFrame([(1, "good day idiot"), (2, "good day friend")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.predict(new, model).collect()} == {1: 1, 2: 0}


def test_every_language_has_its_cut_and_share(spark):
    rows = [(i, "aa", "good day " * 5 + ("idiot" if i % 2 else "friend")) for i in range(400)]
    rows += [(1000 + i, "bb", "guten tag " * 9 + ("du depp idiot" if i % 2 else "mein freund")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    one = toxicity.labelled(df.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")).cache()
    few = toxicity.sample(df, one, one.count(), 40)
    trained = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    sizes = collections.Counter((i % 2, "bb" if i >= 1000 else "aa") for i in trained)
    assert toxicity.quotas(sizes, 40) == {k: n if k[1] == "bb" else 40 - sizes[k[0], "bb"] for k, n in sizes.items()}
    assert {(r[0], r[1]) for r in few} == set(sizes)
    model = toxicity.fit(df, one)
    counts = toxicity.histogram(df, one, one.count(), model)
    assert sum(r[3] for r in counts) == len(trained)  # every labelled training row counts
    assert {(r[0], r[1]) for r in counts} == {(c, v) for c in (0, 1) for v in (0, 1)}
    assert model["shift"][0] != model["shift"][1]  # some ten toxic rows are enough for a cut
    # a language with too few rows takes the common cut, and each other one its own
    cut = toxicity.calibrate({"shift": np.zeros(3)}, [(0, 0, -64, 50), (0, 1, 64, 50), (1, 0, 320, 9), (1, 1, 448, 9), (2, 1, 0, 4)])["shift"]
    assert cut[0] == pytest.approx(0.5 / 64) and cut[1] == pytest.approx(6 + 0.5 / 64) and cut[2] not in (cut[1], 0)


@pytest.mark.parametrize("bad", [float("nan")])
def test_best_cut_prefers_the_widest_gap(bad):
    cut = toxicity._best_cut(np.array([-4.0, -3, 2, 3]), np.array([0, 0, 1, 1]), np.ones(4))
    assert cut == -0.5
