import math
import re
from collections import Counter

from storyloom.llm import licenses


def cosine(segment, template, idf, unknown):
    a, b = (Counter(re.findall("[a-z0-9]+", t.lower())) for t in (segment, template))
    w = lambda c: {t: n * idf.get(t, unknown) for t, n in c.items()}
    x, y = w(a), w(b)
    return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


FILES = [
    (1, "/r/LICENSE", "Released under the MIT License.\n" + "blah " * 100),
    (2, "/r/src/a.py", "print(1)"),
    (3, "/r/src/b.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)" + " x" * 100),
    (4, "/r/lib/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (5, "/r/lib/deep/er/c.c", "int main"),
    (6, "/q/d.c", "no words on it; licence plates and warranty cards"),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "/r/lib/deep/e.c", None),
    (9, "/r/x", ""),
    (10, None, "int x"),
    (11, "top", "int x"),
    (12, "/r/libfoo/f", "x"),
]


def test_own_and_inherited(spark):
    files = spark.createDataFrame([(*f, "clash") for f in FILES] + [(2, "/r/src/a.py", "print(1)", "clash"), (None, "/r/lib/n", "x", "c")], "doc_id long, path string, text string, license string")
    rows = licenses.scan(files).collect()
    assert len(rows) == len(FILES) + 2
    got = {r.doc_id: (r.own_license, r.license, r.origin, r.license_dir) for r in rows}
    assert got == {
        1: ("MIT", "MIT", "own", None), 2: (None, "MIT", "directory", "/r"), 3: ("Apache-2.0", "Apache-2.0", "own", None), 4: ("GPL-3.0", "GPL-3.0", "own", None),
        5: (None, "GPL-3.0", "directory", "/r/lib"), 6: (None, None, "none", None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own", None), 8: (None, "GPL-3.0", "directory", "/r/lib"),
        9: (None, "MIT", "directory", "/r"), 10: (None, None, "none", None), 11: (None, None, "none", None), 12: (None, "MIT", "directory", "/r"), None: (None, "GPL-3.0", "directory", "/r/lib"),
    }


def test_short_texts_are_license_files_only_if_asked(spark):
    files = spark.createDataFrame([(1, "/a/note", "Released under the MIT License."), (2, "/a/b/c", "x")], "doc_id long, path string, text string")
    licensed = lambda n: {r.doc_id: r.license for r in licenses.scan(files, file_words=n).collect()}
    assert licensed(0) == {1: "MIT", 2: None} and licensed(80) == {1: "MIT", 2: "MIT"}


def test_scores_are_those_of_all_templates(spark):
    segments = ["Licensed under CC BY-SA 4.0", "Released under MIT License by me", "licence of nothing at all", "Permission granted, free of charge, to any person", "license license license MIT"]
    got = {r.segment: (r.license, r.score) for r in licenses.score_segments(spark.createDataFrame([(s,) for s in segments], "segment string")).collect()}
    rows, unknown = licenses.template_weights(licenses.TEMPLATES)
    idf = {t: i for _, _, t, i, _ in rows}
    for s in segments:
        scored = sorted((-round(cosine(s, t, idf, unknown), 6), n) for n, t in licenses.TEMPLATES)
        if -scored[0][0] >= licenses.MIN_COSINE:
            assert got[s][0] == scored[0][1] and abs(got[s][1] + scored[0][0]) < 2e-6
        else:
            assert s not in got


def test_every_template_holds_an_anchor_or_is_found_whole():
    assert all(re.search(licenses.ANCHOR, t.lower()) or "cc by" in t.lower() for _, t in licenses.TEMPLATES)


def test_odd_documents(documents, no_documents):
    with_path = licenses.document_path(documents)
    assert licenses.scan(with_path).count() == documents.count()
    assert licenses.scan(licenses.document_path(no_documents)).collect() == []


def test_no_python_in_the_plan(documents):
    plan = licenses.scan(licenses.document_path(documents))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
