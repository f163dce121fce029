import collections

import numpy as np
import pytest

from riboplan.llm import ngram_join as nj


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = np.random.default_rng(9)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    rows = [(i, " ".join(prose(int(rng.integers(0, 80))))) for i in range(30)]
    base = prose(120)
    for i in range(100, 150):  # a family at and around the threshold
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            copy[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(copy)))
    chain = prose(60)
    for i in range(200, 220):  # each near the next, the ends far apart
        chain[(i * 7) % 60] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(300, "A b"), (301, "a B"), (302, None), (303, ""), (304, "a b c"), (None, "a b"), (305, " \t\n"), (306, "a b"), (306, "a b")]
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = nj.join(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, percent)


def test_empty_table(spark):
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 105), (7, 60), (200, 200)]
    got = {r["node"]: r["label"] for r in nj.components(spark.createDataFrame(edges, "cls long, other long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 0, 100: 100, 101: 100, 105: 100, 200: 200}


def test_similar_matches_the_exact_ratio():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 80)))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert nj.similar(a, b, 85) == (100 * shared >= 85 * (len(a) + len(b) - shared))


def test_long_paths_take_few_rounds(spark, monkeypatch):
    n, calls, durable = 600, [], nj.durable
    monkeypatch.setattr(nj, "durable", lambda df: calls.append(1) or durable(df))
    order = [0, *range(n - 1, 0, -1)]  # the least label is next to the largest
    shuffled = np.random.default_rng(3).permutation(np.arange(1000, 1000 + n)).tolist()
    edges = [*zip(order, order[1:]), *zip(shuffled, shuffled[1:])]
    got = {r["node"]: r["label"] for r in nj.components(spark.createDataFrame(edges, "cls long, other long"), 0).collect()}
    assert got == {**dict.fromkeys(order, 0), **dict.fromkeys(shuffled, 1000)}
    assert (len(calls) - 2) // 2 <= 25


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 900)))) for _ in range(2))
        assert nj.unlike(nj.signature(a), nj.signature(b))[0] <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_groups_of_variants_and_hot_windows(spark, monkeypatch, k, percent):
    """Few pivots with many sets, other families that share their windows, and salted windows."""
    monkeypatch.setattr(nj, "HOT_ROWS", 3)
    monkeypatch.setattr(nj, "HOT_SHARE", 10**9)
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 60, 90)]
    rows = []
    for family in range(6):
        base = list(words)
        for at in rng.integers(0, 90, 4 * family):
            base[at] = f"f{family}{at}"
        for i in range(14):
            copy = list(base)
            for at in rng.integers(0, 90, int(rng.integers(0, 5))):
                copy[at] = f"x{rng.integers(30)}"
            rows.append((100 * family + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nj.join(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, percent)
