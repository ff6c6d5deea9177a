import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from storyloom.llm import pii

from .conftest import words

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group(0))]
    return sorted(found)


def said(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def check(rows, texts):
    for r in rows:
        found = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(found).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == n for x in found) for n in range(4)]


def test_base_spans_of_odd_texts(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pii.digests(pii.find_spans(documents)).collect()
    assert len(rows) == documents.count()
    check(rows, texts)
    assert next(r for r in rows if r.doc_id == 11).n_card == 1


def test_base_spans_of_random_texts(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "x@y.z", ".", "-", "%", "+", "+1", " ", "  ", "12", "345", "0", "256", "10.0.0.1", "1.2.3.4.5.6.7.8", "(", ")", "4539148803436467", "4539 1488 0343 6467", "é", "🙂", "\n", "555-2485", "00000000255.1.1.1"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(60))) for i in range(1500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pii.digests(pii.find_spans(docs)).collect(), texts)


def test_terms_that_tell_are_found_and_replaced(spark):
    """`zorblax` stands near one address in different texts and nowhere else; `often` is everywhere."""
    rows = [(i, f"{' '.join(words(12, i))} zorblax wrote from ann@mail.example.com often {' '.join(words(12, 50 + i))}") for i in range(5)]
    rows += [(10 + i, f"often {' '.join(words(30, 200 + i))} wrote") for i in range(60)]
    rows += [(90, "a later note says Zorblax was here"), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digests(pii.find_spans(docs)).collect()}
    assert found[90] == "term:18:25" and "term" in found[0] and all("term" not in found[10 + i] for i in range(60))
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "ann@" not in out[0] and "[EMAIL]" in out[0] and "zorblax" not in out[0] and "Zorblax" not in out[90] and out[91] is None and out[10] == dict(rows)[10]


def test_copies_alone_make_no_term_tell(spark):
    text = " ".join(words(10, 1)) + " uniqueword bob@mail.example.com " + " ".join(words(10, 2))
    docs = spark.createDataFrame([(i, text) for i in range(6)] + [(9 + i, " ".join(words(20, i))) for i in range(20)], "doc_id long, text string")
    assert all("term" not in r.spans for r in pii.digests(pii.find_spans(docs)).collect())


def terms_of(spark, surroundings):
    """The telling terms of texts with a value in these surroundings, among texts without."""
    rows = [(i, f"{' '.join(words(12, i))} {a} ann@mail.example.com {b} {' '.join(words(12, 50 + i))}") for i, (a, b) in enumerate(surroundings)]
    rows += [(100 + i, " ".join(words(30, 200 + i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.base_spans(docs).withColumn("row", F.monotonically_increasing_id())
    return {r.term for r in pii.telling_terms(docs, base).collect()}


def test_two_surroundings_make_a_term_tell(spark):
    two = [("red green blue white zorblax", "one two three four five"), ("cat dog cow pig zorblax", "six seven eight nine ten")]
    assert terms_of(spark, two) == {"zorblax"}


def test_surroundings_with_a_set_phrase_are_different(spark):
    """All have `please contact` and the term, and the rest is their own."""
    many = [(f"dear own{c * 3} please contact zorblax", f"{c}aa {c}bb {c}cc {c}dd {c}ee") for c in "pqrstuvw"]
    assert "zorblax" in terms_of(spark, many)


def test_near_copies_alone_make_no_term_tell(spark):
    """Six copies, each with another one of the words near the value changed."""
    left, right = "red green blue white zorblax".split(), "apple pear plum fig lime".split()
    near = [(" ".join(left), " ".join(w if j != i else f"edit{'abcdef'[i]}" for j, w in enumerate(right))) for i in range(6)]
    assert terms_of(spark, near) == set()


def test_a_term_that_tells_of_a_kind(spark):
    """`hotline` is in texts with telephone numbers, far from them; `gloop` too, but all those texts share a passage."""
    far = lambda i: " ".join(words(40, i))
    rows = [(i, f"hotline {far(i)} +1 234 567 8{i:03d}") for i in range(8)]
    rows += [(20 + i, f"gloop {far(700)} +1 234 567 9{i:03d}") for i in range(8)] + [(40 + i, far(300 + i)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (200, "ask the Hotline now"), (201, "a gloop of it")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digests(pii.find_spans(docs)).collect()}
    assert found[200] == "term:8:15" and found[0].startswith("term:0:7") and found[201] == "" and all("term" not in found[20 + i] for i in range(8))


def test_overlaps_and_columns(spark):
    docs = spark.createDataFrame([(1, "call +1 (234) 567-8901 now", "s", "k")], "doc_id long, text string, spans string, key string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.first().text == "call [PHONE] now"


def test_clashing_columns_are_kept(spark):
    names = ["_key", "_spans", "_maybe", "_part", "_words", "_gone", "key", "start", "a.b"]
    docs = spark.createDataFrame([(1, "mail ann@mail.example.com now", *"123456789"), (2, "nothing", *"abcdefghi"), (None, None, *[None] * 9)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("mail [EMAIL] now", *"123456789"), 2: ("nothing", *"abcdefghi"), None: (None,) * 10}


def brute_terms(texts):
    """Telling terms recomputed from the texts of a whole table, in plain Python."""
    n_all, held = len(texts), []
    n_term, n_named, both = Counter(), Counter(), defaultdict(set)
    n_kind, together, around, sketches = Counter(), Counter(), defaultdict(set), defaultdict(list)
    for t in texts.values():
        low = (t or "").lower()
        n_term.update(set(re.findall(r"[^\W\d_]+", low)))
        found = brute(t)
        if not found:
            continue
        row = len(held)
        flat = re.findall(r"[^\W\d_]+", re.sub(PATTERNS["email"], " ", t).lower())
        threes = {" ".join(flat[i : i + 3]) for i in range(max(1, len(flat) - 2))} if flat else {""}
        sketch = tuple(sorted(int.from_bytes((xxhash.xxh64(x.encode(), seed=42).intdigest()).to_bytes(8, "big"), "big", signed=True) for x in threes)[:16])
        held.append(row)
        for k in {k for *_, k in found}:
            n_kind[k] += 1
            for w in {w for w in flat if len(w) > 2}:
                together[w, k] += 1
                sketches[w, k, ""].append(sketch)
        seen = set()
        for a, _, b, k in found:
            cut = lambda piece: [w for w in re.split(r"[\W\d_]+", piece.lower()) if len(w) > 2]
            near = cut(t[max(0, a - 120) : a])[::-1][:5] + cut(t[b : b + 120])[:5]
            for e in named(k, t[a:b]):
                seen.add((k, e))
                for w in near:
                    around[w, k, e].add(tuple(sorted(set(near) - {w})))
                    if row not in both[w, k, e]:
                        both[w, k, e].add(row)
                        sketches[w, k, e].append(sketch)
        n_named.update(seen)
    told = {}

    def share(n_both, w, n):
        return math.log2(n_all * n_both / (n_term[w] * n)) / math.log2(n_all / n) if n < n_all else 0

    def tells(key, n_both, n, pairs, least):
        if (s := share(n_both, key[0], n)) < 0.75:
            return
        seen = Counter(h for x in sketches[key] for h in x)
        n_own = sum(5 * sum(seen[h] == 1 for h in x) > 4 * len(x) for x in sketches[key])
        p, q = n_both / n_term[key[0]], n / n_all
        d = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        if n_own >= least and n_term[key[0]] * d / math.log(pairs) >= max(1, n_both / n_own):
            told[key[0]] = max(told.get(key[0], 0), s)

    for key, sets in around.items():
        if apart(sets):
            tells(key, len(both[key]), n_named[key[1:]], len(around), 2)
    for (w, k), n in together.items():
        if n >= 3:
            tells((w, k, ""), n, n_kind[k], len(together), 3)
    return told


def named(kind, value):
    out = [value]
    if kind == "email":
        name, host = value.lower().split("@")
        out += ["host:" + host] + ["name:" + w for w in re.findall("[a-z]{3,}", name)]
    elif kind == "ip":
        out += ["net:" + ".".join(value.split(".")[:n]) for n in (2, 3)]
    else:
        out.append("first:" + re.sub("[^0-9]", "", value)[: 6 if kind == "card" else 4])
    return set(out)


def apart(sets):
    left = sorted(sets)
    return any(100 * len(set(s) & set(left[0])) < 60 * len(set(s) | set(left[0])) for s in left)


def test_terms_of_a_whole_table_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = brute_terms(texts)
    want = {}
    for i, t in texts.items():
        own = [(a, n, b, k) for a, n, b, k in brute(t)]
        own += [(m.start(), 4, m.end(), "term") for m in re.finditer(r"[^\W\d_]+", t or "") if m[0].lower() in told and not any(a < m.end() and m.start() < b for a, _, b, _ in own)]
        want[i] = said(sorted(own))
    got = {r.doc_id: r.spans for r in pii.digests(pii.find_spans(docs)).collect()}
    assert got == want and sum("term:" in s for s in got.values()) > 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h.example.com" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check(pii.digests(pii.find_spans(docs)).collect(), {1: text})


def test_empty_table(no_documents):
    assert pii.digests(pii.find_spans(no_documents)).collect() == [] and pii.sanitise(no_documents).collect() == []


def test_no_python_in_the_plan(documents):
    plan = pii.digests(pii.find_spans(documents))._jdf.queryExecution().toString() + pii.sanitise(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
