"""Functions against values worked out by hand, and against plain Python on random texts."""

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.functions import refs, timex
from storyloom.functions import text as tx
from storyloom.functions import vectors as vx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("21:1-7", (21, 1, 21, 7, None, None)), ("15:18-16:4", (15, 18, 16, 4, None, None)), ("21:19a", (21, 19, 21, 19, "a", "a")), ("21:19b-22", (21, 19, 21, 22, "b", None)),
        ("3:5 - 7", (3, 5, 3, 7, None, None)), ("22:9-7", (22, 9, 22, 7, None, None)), ("(21:37-38)", None), ("[17:37]", None), ("Acts 1:18-19", None), ("1 Co. 11:25", None), ("3:1-2-3", None), ("", None), (None, None),
    ],
)
def test_references(spark, ref, want):
    got = one(spark, ref, refs.parse_ref)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("3:2-9", [(3, 2, 9)]), ("3:2-4:5", [(3, 2, 999), (4, 1, 5)]), ("3:2-6:5", [(3, 2, 999), (4, 1, 999), (5, 1, 999), (6, 1, 5)]),
        ("3:2-7:5", []), ("5:2-3:4", [(5, 2, 999), (3, 1, 4)]), ("3:9-2", [(3, 9, 2)]),
    ],
)
def test_ranges(spark, ref, want):
    got = one(spark, ref, lambda c: refs.expand_ref(refs.parse_ref(c)))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("three days", "P3D"), ("forty days", "P40D"), ("about the sixth hour", "T12:00"), ("the second hour", "T07:00"), ("the third day", "+P3D"), ("the next day", "+P1D"),
        ("Sabbath", "XXXX-WXX-6"), ("Passover", None), ("five days", None), ("the first day", None), ("THREE DAYS before the third hour", "P3D"),
    ],
)
def test_times(spark, text, want):
    assert one(spark, text, timex.normalise) == want


def test_halves(spark):
    text = "abcdefghij. klmnopqrs"
    assert one(spark, text, lambda c: tx.slice_part(c, F.lit("a"))) == "abcdefghij"
    assert one(spark, text, lambda c: tx.slice_part(c, F.lit("b"))) == ". klmnopqrs"
    assert one(spark, "short text", lambda c: tx.slice_part(c, F.lit("b"))) == "short text"
    assert one(spark, text, lambda c: tx.slice_part(c, F.lit(None).cast("string"))) == text


def test_buckets(spark):
    words = ["jesus", "été", "a", "42"]
    got = [one(spark, w, vx.bucket) for w in words]
    assert got == [215, 210, 97, 274] == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 300 for w in words]


def test_signs_depend_on_the_bucket_alone():
    for i in range(3000):
        h = int(hashlib.md5(str(i).encode()).hexdigest(), 16)
        assert ((h >> 1) & 1 == 1) == (h % 300 % 4 in (2, 3))


def test_final_cleaning(spark):
    assert one(spark, "He said.. “U S A” <b>ok</b>,, a end.next", tx.clean_final) == 'He said. " " ok , a end. next'
    assert one(spark, None, tx.clean_final) is None and one(spark, "", tx.clean_final) == ""


def test_final_cleaning_is_python_s(spark):
    def plain(t):
        t = re.sub(r"<[^>]*>", " ", t)
        t = re.sub(r"[,]{2,}", ",", re.sub(r"[.]{2,}", ".", t))
        t = re.sub(r"\b[a-zA-Z]\b(?:\s[a-zA-Z]\b)+", " ", t)
        t = re.sub(r"\s+", " ", t)
        t = re.sub("[‘’]", "'", re.sub("[“”]", '"', t))
        return re.sub(r"([.!?])\s*([a-z])", r"\1 \2", t).strip()

    rng = random.Random(5)
    bits = ["a", "b", "é", " ", "  ", ".", "..", ",", ",,", "<x>", "word", "U S", "!", "?", "\n", "“", "’", "1", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.clean_final("t").alias("r"))
    assert {r.i: r.r for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_separators(spark):
    text = "one <doc , sep> two <DOC-sepx> three <v-sep> four <citation id=1>five <x-p>six"
    assert one(spark, text, tx.clean_separators) == "one <doc-sep> two <doc-sep> three <doc-sep> four five six"


def test_sets_and_overlaps(spark):
    df = spark.createDataFrame([("Jesus went to Jerusalem.", "Then Jesus entered Jerusalem."), ("", "A b"), ("a A  b", "b c")], "a string, b string")
    rows = df.select(tx.entity_overlap("a", "b").alias("e"), tx.jaccard("a", "b").alias("j")).collect()
    assert rows[0].e == 2 / 3 and rows[1].j == 0 and rows[2].j == 1 / 3
    assert one(spark, "McDonald Über Ab ABc A1 Xy_z Öl", tx.entities) == ["Ab"]


def test_polarity(spark):
    for text, want in [("They did not go", "NEG"), ("They don't go", "POS"), ("NEVER!", "NEG"), ("nothing notable", "POS"), ("", "POS"), ("I cannot", "NEG")]:
        assert one(spark, text, tx.polarity) == want


def test_places_are_python_s(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é1_,.🙂 \n") for _ in range(rng.randrange(300))) for _ in range(200)] + ["", "x" * 9, "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.places("t", tx.WORD).alias("p"))
    want = {i: [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", t)] for i, t in enumerate(texts)}
    assert {r.i: [tuple(x) for x in r.p] for r in df.collect()} == want
    words = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", tx.word_places("t").alias("p"))
    assert {r.i: [tuple(x) for x in r.p] for r in words.collect()} == want | {-1: []}


def test_chapters_and_verses(spark):
    for ref, want in [("21:19a", (21, 19)), ("15:18-16:4", (15, 18)), (" 3:5 ", (3, 5)), ("3:16 and more", (3, 16)), ("x 3:16", (0, 0)), ("", (0, 0)), (None, (0, 0))]:
        assert tuple(one(spark, ref, lambda c: refs.chapter_verse(F.col(c) if isinstance(c, str) else c))) == want


def test_sentences(spark):
    assert one(spark, " One two.  Three!\nFour?Five ", tx.sentences) == ["One two.", "Three!", "Four?Five"]
    assert one(spark, "Short. A longer one.", lambda c: tx.sentences(c, 11)) == ["A longer one."]


def test_prompts_and_capitals(spark):
    assert one(spark, "Merge these. A story. He went up. Then down.", tx.drop_prompt) == "He went up. Then down."
    assert one(spark, "merge these. He went.", tx.drop_prompt) == "merge these. He went."
    assert one(spark, "élan", tx.capitalise) == "Élan" and one(spark, "", tx.capitalise) == ""
    assert one(spark, " ", tx.or_unknown) == "" and one(spark, "", tx.or_unknown) == "Unknown" and one(spark, None, tx.or_unknown) == "Unknown"


def test_cosines(spark):
    rows = spark.createDataFrame([(0, "Jesus went to Jerusalem."), (1, "Then Jesus entered Jerusalem."), (2, "")], "id int, text string")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (0, 0)], "a int, b int")
    got = {(r.a, r.b): r.cosine for r in vx.pair_cosines(pairs, vx.bucket_counts(rows, ["id"])).collect()}
    assert got == {(0, 1): 0.5, (1, 0): 0.5, (0, 2): 0.0, (0, 0): 1.0}
    dense = {r.id: r.vec for r in vx.hashed_dense(rows, ["id"]).collect()}
    assert math.isclose(sum(x * y for x, y in zip(dense[0], dense[1], strict=True)), 0.5) and not any(dense[2]) and len(dense[2]) == 300


def test_dense_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vx.dense_cosine(F.col("a"), F.col("b")).alias("c"), vx.pad(F.col("a"), 4).alias("p"), vx.pad(F.col("a"), 1).alias("q")).collect()
    assert math.isclose(rows[0].c, 1 / math.sqrt(2)) and rows[1].c == 0 and rows[0].p == [1, 0, 0, 0] and rows[0].q == [1]


def test_a_model_can_be_plugged_in(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, "none"), (2, None)], "id int, text string")

    def load():
        return lambda texts: [None if t == "none" else [float(len(t)), 1.0] for t in texts]

    got = {r.id: r.vec for r in vx.embed(rows, ["id"], load).collect()}
    assert got[0] == [3.0, 1.0] and len(got[1]) == 300 and got[2] == [0.0, 1.0]
    assert {r.id: r.vec for r in vx.embed(rows, ["id"]).collect()}[0] == {r.id: r.vec for r in vx.hashed_dense(rows, ["id"]).collect()}[0]


def test_document_of_an_identifier(spark):
    assert one(spark, "Luke_e12", tx.document_of) == "luke"


def test_places_of_words_take_little_memory():
    """A batch's words aren't held as objects: 400,000 words took over 80 MB of Python's own memory."""
    import tracemalloc

    texts = pa.array([" ".join(f"word{i}{j}" for j in range(400)) for i in range(1000)])
    tracemalloc.start()
    got = tx._word_places(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1000 and len(got.flatten()) == 400_000 and got[3][1].as_py() == {"start": 7, "end": 13, "text": "word31"}
    assert peak < 30e6
