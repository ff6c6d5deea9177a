from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import ann_forest, exact_topk, vectors

ODD = [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 14), (9004, [float("nan")] + [0.0] * 15), (9005, [float("inf")] + [0.0] * 15), (9006, [1.0, 2.0]), (9007, [0.0] * 16), (None, [1.0] * 16)]


@pytest.fixture(scope="module")
def table(spark):
    """Clusters, repeats of one vector, repeated rows, and odd vectors."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + ODD + rows[:5], "vec_id long, embedding array<float>").withColumn("vector", F.lit("clash")).repartition(4)
    return {i: np.array(v, np.float64) for i, v in rows}, df


def test_top_k_is_exact(table, monkeypatch):
    monkeypatch.setattr(exact_topk, "PART_ROWS", 64)
    monkeypatch.setattr(exact_topk, "GROUP_ROWS", 200)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 16)
    held, df = table
    held = held | {9007: np.zeros(16)}
    whole = {i: np.floor(256 * v).astype(int) for i, v in held.items()}
    got = {}
    for r in exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, rows in got.items():
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(rows) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_sums_beyond_doubles_are_exact():
    x = np.array([[3e8, 3e8], [3e8, 3e8 + 1], [1.0, 2.0]])
    got = exact_topk.search_tile(np.array([1, 2, 3]), x, np.array([9]), np.array([[3e8, 3e8]]), 2)
    assert got == ([9, 9], [2, 1], [3 * 10**8 * 3 * 10**8 + 3 * 10**8 * (3 * 10**8 + 1), 2 * 9 * 10**16])


def test_large_components(spark):
    """Products beyond 64 bits, and components that overflow a double when scaled."""
    big = {0: [1e30, 1.0], 1: [1e30, 2.0], 2: [1e30, -3.0], 3: [-1e30, 5.0], 4: [1e307, 0.5], 5: [-1e307, 0.5], 6: [0.0, -1e17], 7: [0.0, 0.25], 50: [2.0, 1e308]}
    df = spark.createDataFrame(list(big.items()), "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [floor(256 * Fraction(x)) for x in v] for i, v in big.items()}
    got = {}
    for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(want, 1)]


def test_fewer_candidates_than_asked_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = exact_topk.top_k(few, F.col("vec_id") == 0, 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in rows) == [(1, 1), (2, 2)]
    near = ann_forest.nearest(few, F.col("vec_id") == 0, 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in near) == [(1, 1), (2, 2)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(none, F.col("vec_id") == 0).collect() == [] and ann_forest.nearest(none, F.col("vec_id") == 0).collect() == []


def test_usable_vectors(table):
    held, df = table
    assert vectors.usable(df, "vec_id", "embedding", False).count() == len(held)
    assert vectors.usable(df, "vec_id", "embedding", True).count() == len(held) + 1


def test_forest_finds_most_neighbours(table, monkeypatch):
    for name, value in {"GROUP_ROWS": 50, "QUERY_ROWS": 8, "LEAF_ROWS": 60, "SAMPLE_LEAST": 300, "LOCAL_ROWS": 10}.items():
        monkeypatch.setattr(ann_forest, name, value)
    held, df = table
    got = {}
    for r in ann_forest.nearest(df, F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in held if i % 10 == 0}
    ids, x = np.array(list(held)), np.array(list(held.values()))
    hits = []
    for q, rows in got.items():
        rows.sort()
        far = np.sqrt(np.square(x - held[q]).sum(axis=1))
        far[ids == q] = np.inf
        last = np.sort(far)[9]
        assert [n for n, *_ in rows] == list(range(1, 11)) and q not in [i for _, i, _ in rows]
        assert all(s == far[i] for _, i, s in rows)
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hits.append(np.mean([s <= last for *_, s in rows]))
    assert np.mean(hits) >= 0.95


def test_recall_on_the_table(spark):
    from storyloom.llm.queries import op2_ann_forest

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in op2_ann_forest(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q, near in found.items():
        far = np.square(x - x[ids == q]).sum(axis=1)
        far[ids == q] = np.inf
        recall.append(len(near & set(ids[np.argsort(far, kind="stable")[:10]].tolist())) / 10)
    assert len(recall) == (ids % 100 == 0).sum() and np.mean(recall) >= 0.9


def clustered(n, rng, width=32):
    """Vectors around as many centres as grow with their number."""
    centres = rng.normal(size=(max(8, n // 50), width))
    return centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, width))


def test_candidates_grow_slower_than_clustered_vectors():
    """Leaves get deeper with the number of vectors: the candidates of a query don't grow in proportion."""
    looked = {}
    for n in (4000, 32_000):
        x = clustered(n, np.random.default_rng(4))
        forest = ann_forest.Forest(x, 125, 4)
        forest.calibrate(x, 10, 0.97, np.random.default_rng(1))
        rows = [len(set(np.concatenate([forest.held[t][i] for t, i in forest.probe(x[q])]).tolist())) for q in range(0, n, n // 40)]
        hits = []
        for q in range(0, n, n // 40):
            far = np.square(x - x[q]).sum(axis=1)
            far[q] = np.inf
            got = set(np.concatenate([forest.held[t][i] for t, i in forest.probe(x[q])]).tolist())
            hits.append(len(got & set(np.argsort(far)[:10].tolist())) / 10)
        looked[n] = np.mean(rows)
        assert np.mean(hits) >= 0.9 and looked[n] < 0.25 * n
    assert looked[32_000] < 4 * looked[4000]


def test_a_tile_s_own_tree_and_the_matrix_product(monkeypatch):
    """Large offsets, where products are rounded most, and rows that another tree gives."""
    x = clustered(6000, np.random.default_rng(6)) + 100.0
    ids, names = np.arange(6000) * 3, np.arange(0, 6000, 200) * 3
    free = np.random.default_rng(2).random((len(names), 6000)) < 0.8
    for local in (False, True):
        got = ann_forest.rank_tile(ids, x, names, x[::200], lambda a, b: free[a:b], 5, local, 0.97)
        hits = 0
        for n, name in enumerate(names):
            far = np.sqrt(np.square(x - x[name // 3]).sum(axis=1))
            want = [i for i in np.lexsort((ids, far)).tolist() if free[n][i] and ids[i] != name][:5]
            mine = [(s, i // 3) for q, i, s in zip(*got, strict=True) if q == name]
            assert all(s == far[i] for s, i in mine) and (local or [i for _, i in mine] == want)
            hits += len({i for _, i in mine} & set(want))
        assert hits >= 0.9 * 5 * len(names)


def test_trees_part_all_vectors():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 8)), np.ones((300, 8))])
    tree = ann_forest.grow(x, rng, 20)
    leaves = tree.leaves(x)
    assert len(leaves) == 500 and leaves.max() <= len(tree.left) and len(set(leaves[200:].tolist())) == 1
