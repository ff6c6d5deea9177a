import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from storyloom.llm import toxicity as tx
from storyloom.llm.queries import op1_toxicity

from .conftest import words

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def terms():
    return {w: (1.0, tx.allowed_edits(w)) for w in ["scoundrel", "villain", "cad", "cadet", "blackguard"]} | {"knav*": (1.0, 0)}


def test_automaton_finds_the_words_within_reach(terms):
    automaton = tx.LexiconAutomaton(terms)
    tried = ["scoundrel", "scoundrl", "scondrl", "scoundrelly", "vilain", "villains", "vilains", "cad", "cod", "cadet", "cadt", "codet", "blckgurd", "blackgard", "knave", "knavery", "knav", "kn", "", "zzz", "xscoundrel"]
    tried += words(200, 3)
    for w in tried:
        near = [(distance(w, t), t) for t, (_, e) in terms.items() if t[-1] != "*" and distance(w, t) <= e]
        near += [(0, t) for t in terms if t[-1] == "*" and w.startswith(t[:-1])]
        assert automaton.match(w) == min(near, default=(-1, "")), w


def test_forgetting_changes_nothing(terms, monkeypatch):
    monkeypatch.setattr(tx, "_CACHE_WORDS", 20)
    automaton, other = tx.LexiconAutomaton(terms), tx.LexiconAutomaton(terms)
    for w in words(300, 8) + ["scoundrel", "vilain"]:
        assert automaton.match(w)[0] == (other.match(w)[0]) if w not in ("scoundrel", "vilain") else automaton.match(w)[0] in (0, 1)


def test_quotation_is_told_from_use(terms):
    automaton = tx.LexiconAutomaton(terms)
    n, found = tx.hits('He is a scoundrel. She wrote the "villain" down', automaton)
    assert n == 9 and [(t, e, q) for t, _, _, e, q in found] == [("scoundrel", 0, False), ("villain", 0, True)]
    assert [q for *_, q in tx.hits("the word villain comes from farms", automaton)[1]] == [True]
    text = "é Vilain!"
    assert tx.hits(text, automaton)[1] == [("villain", 2, 8, 1, False)]


def _labelled(spark):
    """Toxic texts use invented terms, some misspelled; a clean one quotes."""
    rows = []
    for i in range(300):
        w = words(40, i)
        if i % 5 == 0:
            w[10], w[20] = ["grobbler", "snivelkin", "wretchel"][i % 3], ["mudsop", "grobbler", "snivelkin"][i % 3]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_terms_and_catches_misspelled_ones(spark):
    rows = _labelled(spark)
    model = tx.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert set(model.terms) == {"grobbler", "snivelkin", "wretchel", "mudsop"}
    tests = [(0, "you grobler and snivelkn"), (1, "a quiet text about gardens"), (2, 'the word "grobbler" is said to be old'), (3, None), (4, "")]
    got = {r.doc_id: r.score for r in tx.score_documents(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.5 and max(got[1], got[2], got[3], got[4]) < 0.5 and got[3] == got[4]


def test_without_labels_of_both_kinds(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.learn(documents, none)
    scores = tx.score_documents(documents, model)
    assert scores.count() == documents.count() and scores.agg(F.max("score")).first()[0] == 0.0
    assert tx.learn(no_documents, none).weights is None
    assert tx.score_documents(no_documents, model).collect() == []


def test_repeated_and_null_labels(spark):
    rows = _labelled(spark)
    labels = rows.select("doc_id", "toxic").union(spark.createDataFrame([(0, 0), (None, 1), (7, None)], "doc_id long, toxic int"))
    assert set(tx.learn(rows.select("doc_id", "text"), labels).terms) == {"grobbler", "snivelkin", "wretchel", "mudsop"}


def test_keep_clean_keeps_columns(spark, documents):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    out = tx.keep_clean(documents, labels)
    assert out.columns == documents.columns and out.count() == documents.count()


def test_held_out_accuracy_on_the_table(spark):
    from storyloom.llm.queries import op1_toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op1_toxicity(spark, SF).join(labels, "doc_id")
    right = rows.groupBy("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("a"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("wrong")).collect()
    assert all(r.a >= 0.93 for r in right) and sum(r.wrong for r in right) <= 2
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.select("doc_id", "held_out").collect())


def test_places_where_lower_casing_changes_lengths():
    automaton = tx.LexiconAutomaton({"grobbler": (1.0, 1)})
    text = "İİ Grobbler İ, grobblr"
    _, found = tx.hits(text, automaton)
    assert [(text[a:b], e) for _, a, b, e, _ in found] == [("Grobbler", 0), ("grobblr", 1)]


def nearest(word, terms):
    near = []
    for term, (weight, room) in terms.items():
        if term.endswith("*"):
            near += [(0, term, weight)] if word.startswith(term[:-1]) else []
        elif abs(len(term) - len(word)) <= room and (e := distance(word, term)) <= room:
            near.append((e, term, weight))
    return min(near, default=None)


def plain_score(text, model, known):
    """The score of a text, with every word held against every term, and windows and quotation marks counted by hand."""
    low = (text or "").lower()
    words = list(re.finditer(r"\w+", low))
    used = quoted = 0.0
    for i, m in enumerate(words):
        if m[0] not in known:
            known[m[0]] = nearest(m[0], model.terms)
        if known[m[0]]:
            e, _, weight = known[m[0]]
            around = words[max(0, i - 6) : i + 7]
            marks = lambda a, b: sum(c in "\"“”„«»‹›" for c in low[a:b])
            said = (marks(around[0].start(), m.start()) % 2 == 1 and marks(m.end(), around[-1].end()) > 0) or any(w[0] in tx._QUOTING for w in around)
            value = weight * (0.5 if e else 1)
            used, quoted = used + value * (not said), quoted + value * said
    x = (math.log1p(used), math.log1p(quoted), math.log1p(300 * used / max(50, len(words))))
    z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_of_a_whole_table_are_those_of_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = tx.learn(docs, labels.filter(~tx.held_out()))
    assert model.terms and model.weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows, known = op1_toxicity(spark, SF).collect(), {}
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.score, plain_score(texts[r.doc_id], model, known), abs_tol=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
