import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riboplan.llm import substring_dedup, suffix_dedup
from riboplan.llm import repeats

L = 50


def brute(rows, words):
    first, docs = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        docs.append((d, raw.split() if words else raw))
    gram = lambda s, i: b" ".join(s[i : i + L]) if words else s[i : i + L]
    for d, s in docs:
        for i in range(len(s) - L + 1):
            if d is not None:
                first[gram(s, i)] = min(d, first.get(gram(s, i), d))
    out = []
    for d, s in docs:
        stay = [True] * len(s)
        for i in range(len(s) - L + 1):
            if d is not None and first[gram(s, i)] < d:
                stay[i : i + L] = [False] * L
        kept = [s[i] for i in range(len(s)) if stay[i]]
        spans = sum(not stay[i] and (i == 0 or stay[i - 1]) for i in range(len(s)))
        text = b" ".join(kept) if words else bytes(kept)
        out.append((d, len(s), len(s) - len(kept)) + (() if words else (spans,)) + (hashlib.sha256(text).hexdigest(),))
    return sorted(out, key=str)


def planted():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    prose = lambda n: [word() for _ in range(n)]
    shared = prose(120)
    rows = [(i, " ".join(prose(int(rng.integers(0, 300))))) for i in range(40)]
    for i in range(40, 60):
        a = int(rng.integers(0, 60))
        rows.append((i, " ".join(prose(20) + shared[a : a + int(rng.integers(45, 60))] + prose(30))))
    near = prose(200)
    for i in range(60, 75):
        copy = list(near)
        copy[int(rng.integers(200))] = "changed"
        rows.append((i, "  ".join(copy)))
    run = "a " * 120
    rows += [(80, " ".join(shared)), (81, " ".join(shared)), (82, run), (83, run + "b"), (84, "q " + run), (85, "ab " * 90)]
    rows += [(86, "ab " * 70 + "zz"), (85, "ab " * 90), (85, " ".join(shared)), (87, None), (88, ""), (None, " ".join(shared)), (89, "é" * 60), (90, "x" + "é" * 61)]
    return rows


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("filter_bytes", [10**12, 0])
def test_against_brute_force(spark, monkeypatch, words, filter_bytes):
    rows = planted()
    module = substring_dedup if words else suffix_dedup
    plain = repeats.with_spans
    monkeypatch.setattr(module, "with_spans", lambda d, u, *k: plain(d, u, *k, filter_bytes=filter_bytes))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(5)
    columns = ["doc_id", "n_words" if words else "n_bytes", "n_removed"] + ([] if words else ["n_spans"])
    got = module.dedup(df).select(*columns, F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty_table(spark, module):
    assert module.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(5)
    unit = substring_dedup.Words()
    core = [f"w{k}".encode() for k in rng.integers(0, 30, 50)]
    np.seterr(over="ignore")
    keys = set()
    for _ in range(30):
        left, right = ([f"w{k}".encode() for k in rng.integers(0, 5, int(rng.integers(0, 40)))] for _ in range(2))
        text, first, last, key = unit.anchors(*unit.symbols([b" ".join([*left, *core, *right])]))
        at = len(left)
        (hit,) = key[(first <= at) & (at <= last)]
        keys.add(int(hit))
    assert len(keys) == 1


def test_recompression_halves_symbols_and_names_are_consistent():
    np.seterr(over="ignore")
    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    both = np.concatenate([x, x])
    names, begins = substring_dedup.recompress(both, np.repeat([0, 1], 1000))
    cut = int(np.searchsorted(begins, 1000))
    assert begins[cut] == 1000 and (names[:cut] == names[cut:]).all()
    assert cut < 600


@pytest.mark.parametrize("folder", [False, True])
def test_suffix_order(tmp_path, folder):
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(60)] + [b"abc" * 20] * 3
    string, size, prefix = suffix_dedup.suffix_order(strings, str(tmp_path) if folder else None)
    want = sorted((s[len(s) - n :], n, i) for i, s in enumerate(strings) for n in range(len(s) + 1))
    got = [strings[i][len(strings[i]) - n :] for i, n in zip(string, size, strict=True)]
    assert got == [w[0] for w in want]
    assert sorted(zip(string.tolist(), size.tolist(), strict=True)) == sorted((i, n) for _, n, i in want)
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert prefix[k] == min(n, L)
