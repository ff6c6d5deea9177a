import math
import random

import numpy as np
import pytest

from storyloom.llm import near_dedup as nd

from .conftest import words


def brute(rows, k, percent):
    """Component and set size of each identifier, by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.fixture(scope="module")
def copies():
    """Chains of edits, a large group around one text, pairs near the threshold, texts alone."""
    rng, rows = random.Random(9), []
    for g in range(12):
        text = words(rng.choice([12, 60, 150]), 100 + g)
        for _ in range(6):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(1000)}"
    base = words(80, 77)
    for _ in range(60):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(len(t))] = f"other{rng.randrange(1000)}"
        rows.append(" ".join(t))
    rows += [" ".join(words(50, 900 + i)) for i in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_components_are_those_of_all_pairs(spark, copies, k):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert result(nd.near_duplicates(docs, k, 80)) == brute(copies, k, 80)


def test_large_clusters_take_the_other_way_to_the_same_result(spark, copies, monkeypatch):
    monkeypatch.setattr(nd, "CLUSTER_TEXTS", 3)
    monkeypatch.setattr(nd, "TILE_ROWS", 8)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert result(nd.near_duplicates(docs, 4, 80)) == brute(copies, 4, 80)


def test_odd_rows(documents, odd_texts):
    got = result(nd.near_duplicates(documents, 4, 80))
    assert got == brute(odd_texts, 4, 80)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[1] == (117, 0, False) and got[15] == (1, 7, False)


def test_an_identifier_with_two_texts(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b)], "doc_id long, text string")
    got = result(nd.near_duplicates(docs, 4, 80))
    assert set(got) == {1, 2, 3} and sum(c != i for i, (_, c, _) in got.items()) == 1


def test_empty_table(no_documents):
    assert nd.near_duplicates(no_documents).collect() == []


def test_keep_first_keeps_columns_and_rows_without_identifier(documents):
    out = nd.keep_first(documents, 4, 80)
    assert out.columns == documents.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14] and ids.count(None) == 1


def test_hashes_tell_words_apart():
    texts = ["a b c d", "a b c e", "ab c d", "A B C D", "a  b\tc\nd", "é è", "É è"]
    sets = [tuple(s.tolist()) for s in nd.shingle_sets(texts, 4)]
    assert sets[0] == sets[3] == sets[4] and len({sets[i] for i in (0, 1, 2, 5, 6)}) == 5


def test_a_long_region_is_cut_by_depth(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nd, "REGION_ROWS", 10)
    n = 45
    order = np.zeros((n, nd.DEPTH), ">u4")
    order[:, 1] = np.arange(n) // 4
    marks = np.repeat((np.arange(n) // 4).astype(np.uint8)[:, None], nd.MINIMA, axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([o.tobytes() for o in order]), pa.array([m.tobytes() for m in marks]), pa.array(range(n), pa.int64())], names=["tree", "order", "marks", "doc_id"])
    parts = [batch.slice(i, 7) for i in range(0, n, 7)]
    pairs = {(a, b) for b_ in nd._region_rows(0.6)(iter(parts)) for a, b in zip(*(c.to_pylist() for c in b_.columns), strict=True)}
    above = list(range(n))
    for a, b in sorted(pairs):
        if a // 4 == b // 4:
            above[b] = min(above[a], above[b])
    assert all(above[i] // 4 == i // 4 for i in range(n)) and len(pairs) < 4 * n
    joined = {b for a, b in pairs if a // 4 == b // 4} | {a for a, b in pairs if a // 4 == b // 4}
    assert joined == {i for i in range(n) if n - i > 1 or i % 4}


def test_rows_of_a_long_region_meet_by_their_other_minima(spark, monkeypatch):
    """All share each tree's first minimum; 3 and 33 share all but the first two, and are far apart in every tree."""
    monkeypatch.setattr(nd, "REGION_ROWS", 8)
    rng, n = np.random.default_rng(3), 40
    orders = rng.integers(1 << 20, 1 << 30, (n, nd.TREES, nd.DEPTH)).astype(">u4")
    marks = rng.integers(0, 256, (n, nd.MINIMA)).astype(np.uint8)
    orders[33], marks[33] = orders[3], marks[3]
    orders[:, :, 0] = 7
    orders[3, :, 1], orders[33, :, 1] = 1, (1 << 32) - 1
    rows = [(i, bytearray(orders[i].tobytes()), bytearray(marks[i].tobytes())) for i in range(n)]
    firsts = spark.createDataFrame(rows, "doc_id long, orders binary, marks binary")
    assert (3, 33) in {(r.a, r.b) for r in nd.candidates(firsts, 0.6).collect()}


def test_pairs_at_the_threshold_seldom_fall_below_the_margin():
    least = math.ceil(nd.MINIMA * nd.margin(0.8))
    assert sum(math.comb(nd.MINIMA, i) * 0.8**i * 0.2 ** (nd.MINIMA - i) for i in range(least)) < 2e-6


def test_keep_first_with_clashing_columns(spark):
    text = " ".join(words(60, 3))
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d"), (2, text, "e", "f", "g", "h"), (3, "own words", *"ijkl")], "doc_id long, text string, _part string, _words string, _maybe string, _gone string")
    out = nd.keep_first(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(1, text, *"abcd"), (3, "own words", *"ijkl")]


def _rows_of_one_region(n, pairs, rng):
    """Rows that share their first minimum; some have a partner whose marks are alike in 85 %, and other minima at random."""
    ids = list(range(n))
    rng.shuffle(ids)
    marks = {i: np.array([rng.randrange(256) for _ in range(nd.MINIMA)], np.uint8) for i in ids}
    order = {i: [7] + [rng.randrange(1 << 20) for _ in range(nd.DEPTH - 1)] for i in ids}
    mates = [(ids[2 * k], ids[2 * k + 1]) for k in range(pairs)]
    for a, b in mates:
        marks[b] = np.where([rng.random() < 0.85 for _ in range(nd.MINIMA)], marks[a], marks[b]).astype(np.uint8)
        if rng.random() < 0.8:
            order[b][1] = order[a][1] + 2500  # two or three rows further
    return sorted((0, *order[i], i) for i in ids), marks, {(min(p), max(p)) for p in mates if order[p[0]][1] + 2500 == order[p[1]][1]}


def test_neighbours_across_cuts_and_borders_meet(monkeypatch):
    """A region of 20 times the rows that are compared at once, in two partitions: with one way of cutting, pairs on both
    sides are lost; with the other, too, but not the same."""
    import pyarrow as pa

    monkeypatch.setattr(nd, "REGION_ROWS", 48)
    rng = random.Random(8)
    rows, marks, mates = _rows_of_one_region(960, 400, rng)

    def found(shifted, borders):
        out = set()
        for a, b in zip([0, *borders], [*borders, len(rows)], strict=True):
            part = rows[a:b]
            order = [np.array(r[1:-1], ">u4").tobytes() for r in part]
            batch = pa.RecordBatch.from_arrays([pa.array([0] * len(part), pa.int32()), pa.array(order, pa.binary()), pa.array([marks[r[-1]].tobytes() for r in part], pa.binary()), pa.array([r[-1] for r in part], pa.int64())], names=["tree", "order", "marks", "doc_id"])
            for got in nd._region_rows(nd.margin(0.8), shifted)(iter([batch])):
                out |= set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        return out

    one, two = found(False, [500]), found(True, [333, 700])
    assert len(mates - one) > 0 and len(mates - two) > 0
    assert len(mates - one - two) <= 0.01 * len(mates)
