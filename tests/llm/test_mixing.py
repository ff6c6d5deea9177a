import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.llm import mixing

from .conftest import words

WEIGHTS = (3, 1, 2)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, full, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            free.discard(s)
    return full | {s: level * weight[s] for s in free}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else [None, "b", "c", "tiny", "e"][i % 5]
        rows.append((i, " ".join(words(3 if source == "tiny" else 20 + i % 200, i)), source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_targets_and_taken_words(corpus):
    rows, docs = corpus
    got = mixing.shares(docs, WEIGHTS).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, source, taken = brute_targets(sizes), {i: s for i, _, s in rows}, defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_agree_whatever_the_partitions(corpus):
    rows, docs = corpus
    one = {tuple(r) for r in mixing.shares(docs, WEIGHTS).collect()}
    assert one == {tuple(r) for r in mixing.shares(docs.repartition(7, "doc_id"), WEIGHTS).collect()}


def test_the_schedule_spreads_each_source(corpus):
    _, docs = corpus
    sized = docs.select("source", mixing.size_of(F.col("text")).alias("size"))
    slots = mixing.schedule(mixing.targets(sized, WEIGHTS)).orderBy("slot").collect()
    whole = Counter(r.source_no for r in slots)
    seen = Counter()
    for n, r in enumerate(slots, 1):
        seen[r.source_no] += 1
        for s in whole:  # golden-ratio points keep every source near its share all along
            assert abs(seen[s] - n * whole[s] / len(slots)) < 12
    uses = Counter((r.source_no, r.block) for r in slots)
    assert max(uses.values()) <= 2 and len({r.slot for r in slots}) == len(slots)


def test_mix_cuts_and_repeats_texts(corpus):
    rows, docs = corpus
    taken = {r.doc_id: r.taken for r in mixing.shares(docs, WEIGHTS).collect()}
    mixed = mixing.mix(docs, WEIGHTS, positions=True)
    assert mixed.columns == [*docs.columns, "mix_slot"]
    got, times = defaultdict(int), Counter()
    texts = {i: t for i, t, _ in rows}
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        times[r.doc_id] += 1
        assert texts[r.doc_id].startswith(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(got) and max(times.values()) == 2


def test_odd_rows(documents, no_documents):
    got = mixing.shares(documents, WEIGHTS).collect()
    assert len(got) == documents.count()
    for r in got:
        assert r.taken <= 2 * r.size
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents.collect()}
    assert all(r["size"] == sizes[r.doc_id] for r in got)
    assert mixing.shares(no_documents, WEIGHTS).collect() == [] and mixing.mix(no_documents, WEIGHTS).collect() == []


def test_rows_alike_in_all_columns_are_mixed_each(spark):
    rows = [(7, "a b c d", "s", 1.5)] * 5 + [(8, "e f g", "t", None)] * 2 + [(9, "h", "t", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x double").repartition(3)
    taken = Counter()
    for r in mixing.shares(docs, WEIGHTS).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixing.mix(docs, WEIGHTS).collect():
        got[r.doc_id] += len(r.text.split())
    assert +got == +taken and sum(taken.values()) in (40, 41)


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in mixing.shares(docs, WEIGHTS).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.mix(docs, WEIGHTS).collect() == []


def test_points_of_many_slots(spark):
    """Beyond 2**63 / golden and beyond 2**32, as exact products give them."""
    ids = [0, 1, 2, 3_474_701_532, 3_474_701_533, 4_000_000_000, 2**32 - 1, 2**32, 2**32 + 1, 10**12 + 7, 10**15 + 3]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.point_of(F.col("id")).alias("p")).collect()
    assert all(r.p == (r.id % 2**32) * 2654435769 % 2**32 / 2**32 for r in rows)


def brute_taken(rows, plan):
    """Words that the mix takes of each row, word by word: lists of (source, words in the order of the digest) and slots."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    taken = Counter()
    wants = {s: int(t) for s, t in plan.items()}
    for source, want in wants.items():
        mine = [(i, t) for i, t, s in rows if s == source]
        mine.sort(key=lambda r: md5(f"{r[0]}:{source or ''}:{md5(r[1])}")[:15])
        line = [i for i, t in mine for _ in t.split()]
        for n in range(want):  # passes over all blocks, the last one cut
            taken[line[n % len(line)]] += 1
    return taken


def test_taken_words_of_each_document(corpus):
    rows, docs = corpus
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_taken(rows, brute_targets(sizes))
    assert {r.doc_id: r.taken for r in mixing.shares(docs, WEIGHTS).collect() if r.taken} == dict(want)


def test_many_sources_and_weight_zero(spark):
    docs = spark.createDataFrame([(i, "a b c d e", f"h{i % 150:03d}") for i in range(600)], "doc_id long, text string, source string").repartition(5)
    got = mixing.shares(docs, (2, 0, 1)).collect()
    plan = {r.doc_id % 150: r.target for r in got}
    assert all(plan[i] == (0 if i % 3 == 1 else 40.0) for i in range(150))  # both are at their limit
    assert sum(r.taken for r in got) == 100 * 40


def test_map_columns(spark):
    rows = [(i % 4, "a b c d", "s", {"k": i % 4, "l": None}, [{"x": 1}]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, a array<map<string,int>>")
    taken = sum(r.taken for r in mixing.shares(docs, WEIGHTS).collect())
    mixed = mixing.mix(docs, WEIGHTS).collect()
    assert sum(len(r.text.split()) for r in mixed) == taken and all(r.m == {"k": r.doc_id, "l": None} for r in mixed)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 5)], "doc_id long, text string, source string, size string, `order` int")
    assert mixing.mix(docs, WEIGHTS).columns == docs.columns
