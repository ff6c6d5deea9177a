"""Toxicity by a learned lexicon that also catches misspelled terms.

Learning, from at most MAX_LABELLED labelled rows (those with the smallest hashed identifiers): words and word beginnings
that are in MIN_SHARE of the toxic texts or more, at least MIN_RATIO times as likely there as in the others, and so by more
than chance among as many terms, form the lexicon, each with the logarithm of its ratio. A term may be misspelled by 1 or 2
letters by its length, unless words that near are usual in clean texts. A logistic regression weighs how a text uses it.

Matching: the lexicon is a trie, whose walk is intersected with a Levenshtein automaton of as many edits as the term
allows; the product is made deterministic as words are read, so a word costs a table lookup a letter, and most words leave
it after a few. Around each hit a window of WINDOW words decides whether the term is quoted (it stands between
quotation marks, or words for quoting are near) or used; both are counted apart.

Edge cases: null text is empty, and an empty text gets the score of a text without hits; all rows are kept, repeated ones
and those with a null identifier too; without labelled rows of both kinds, or terms that tell
them apart, every score is 0; labels that repeat an
identifier count as toxic if one of them is; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import forget, tidy, values, written

MAX_LABELLED = 30_000
MIN_SHARE, MIN_TEXTS, MIN_RATIO = 0.004, 3, 6.0
#: Share of the clean texts in which misspellings of a term may be found.
MAX_CLEAN = 0.0005
STEM_LETTERS = range(4, 9)
WINDOW = 6
#: Words that a worker remembers before it starts over.
_CACHE_WORDS = 500_000
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‹›"
#: Words that announce a quotation or speak about a word.
_QUOTING = frozenset("quote quoted quotes quoting said says word words term terms called slur insult mot terme dit wort begriff sagte palabra término dijo".split())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 9 else 2


@dataclass
class Model:
    """terms: weight and edits of each word, and of each word beginning (with a star); weights: of bias and features."""

    terms: dict[str, tuple[float, int]]
    weights: list[float] | None


class LexiconAutomaton:
    """The product of the lexicon's trie and Levenshtein automata, made deterministic as it is used."""

    def __init__(self, terms: dict[str, tuple[float, int]]):
        self.weight = {t: w for t, (w, _) in terms.items()}
        self._next: list[dict[str, int]] = [{}]
        self._room: list[int] = [0]  # edits that some term below allows
        self._word: dict[int, tuple[int, str]] = {}  # node of a whole term: edits it allows, the term
        self._stem: dict[int, str] = {}
        for term, (_, room) in sorted(terms.items()):
            at = 0
            self._room[0] = max(self._room[0], room)
            for c in term.rstrip("*"):
                if c not in self._next[at]:
                    self._next[at][c] = len(self._next)
                    self._next.append({})
                    self._room.append(0)
                at = self._next[at][c]
                self._room[at] = max(self._room[at], room)
            if term.endswith("*"):
                self._stem[at] = term
            else:
                self._word[at] = (room, term)
        self._forget()

    def _forget(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: list[dict[str, int]] = []
        self._ends: list[tuple[int, str]] = []
        self._start = self._state({0: 0})
        self.known: dict[str, tuple[int, str]] = {}

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached)
        while todo:  # a term's letter may be missing from the word
            at = todo.pop()
            for child in self._next[at].values():
                e = reached[at] + 1
                if e <= self._room[child] and e < reached.get(child, 9):
                    reached[child] = e
                    todo.append(child)
        key = frozenset(reached.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
            ends = [(e, self._word[n][1]) for n, e in reached.items() if n in self._word and e <= self._word[n][0]]
            ends += [(0, self._stem[n]) for n, e in reached.items() if n in self._stem and not e]
            self._ends.append(min(ends, default=(-1, "")))
        return self._states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self._room[node] or not e:
                reached[node] = min(e, reached.get(node, 9))

        for node, e in self._sets[state]:
            if node in self._stem and not e:
                reached[node] = 0  # what follows a stem is free
            put(node, e + 1)
            for letter, child in self._next[node].items():
                put(child, e + (letter != c))
        return self._state(reached)

    def match(self, word: str) -> tuple[int, str]:
        """The edits between the word and the nearest term, and the term; -1 if no term is near."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > _CACHE_WORDS or len(self._sets) > _CACHE_WORDS // 10:
                self._forget()
            state = self._start
            for c in word:
                after = self._moves[state].get(c)
                if after is None:
                    after = self._moves[state][c] = self._step(state, c)
                state = after
                if not self._sets[state]:
                    break
            got = self.known[word] = self._ends[state]
        return got


def hits(text: str, automaton: LexiconAutomaton) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
    """The number of words; term, start, end, edits and whether it is quoted of each hit in the text."""
    low = text.lower()
    words = _WORD.findall(low)
    if all(automaton.match(w)[0] < 0 for w in set(words)):
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) != len(text):  # lower-casing changes lengths: where each of its characters comes from
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        places = [(origin[a], origin[b - 1] + 1) for a, b in spans]
    else:
        places = spans
    marks = [i for i, c in enumerate(low) if c in _QUOTES]
    out = []
    for i, w in enumerate(words):
        e, term = automaton.match(w)
        if e >= 0:
            a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            before = bisect_left(marks, spans[i][0]) - bisect_left(marks, spans[a][0])
            after = bisect_right(marks, spans[b - 1][1]) - bisect_left(marks, spans[i][1])
            quoted = bool(before % 2 and after) or not _QUOTING.isdisjoint(words[a:b])
            out.append((term, *places[i], e, quoted))
    return len(words), out


def features(n_words: int, found: list[tuple[str, int, int, int, bool]], weight: dict[str, float]) -> tuple[float, float, float]:
    """Weight of used and of quoted hits, on a scale that saturates, and the used ones' share of the words; a misspelled
    hit counts half."""
    used = quoted = 0.0
    for term, _, _, e, said in found:
        value = weight[term] * (0.5 if e else 1.0)
        used, quoted = used + value * (not said), quoted + value * said
    return math.log1p(used), math.log1p(quoted), math.log1p(300 * used / max(50, n_words))


def score(n_words: int, found: list, model: Model, weight: dict[str, float]) -> float:
    if model.weights is None:
        return 0.0
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features(n_words, found, weight), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    """Words, and beginnings of words with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LETTERS if n < len(w)}


def _count_rows(wanted: frozenset | None):
    """Texts that have each term; wanted: only these terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in values(batch.column(0)):
                found = _terms(text or "")
                counts.update(found if wanted is None else found & wanted)
            if len(counts) > 2_000_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return run


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, tuple[float, int]]:
    """Terms that tell toxic texts; of terms in the same texts the longest, and none that a stem covers."""
    base, surprise = n_toxic / (n_toxic + n_clean), math.log(max(2, len(toxic))) + 3
    good: dict[str, float] = {}
    for t, n in toxic.items():
        c = clean.get(t, 0)
        ratio = (n / n_toxic) / ((c + 0.5) / (n_clean + 1))
        told = n * math.log(n / ((n + c) * base)) + (c * math.log(c / ((n + c) * (1 - base))) if c else 0)
        if ratio >= MIN_RATIO and told >= surprise:
            good[t] = min(2.0, math.log(ratio) / math.log(50))
    stems = {t for t in good if t[-1] == "*"}
    for t in good:
        stem = t.rstrip("*")
        for n in range(1, len(stem) + (t[-1] != "*")):
            shorter = stem[:n] + "*"
            if shorter in stems and shorter != t and toxic[t] >= 0.98 * toxic[shorter]:
                stems.discard(shorter)
    covered = lambda t: any(t != s and t.startswith(s[:-1]) for s in stems)
    return {t: (w, allowed_edits(t)) for t, w in good.items() if (t in stems or t[-1] != "*") and not covered(t)}


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method, with a small ridge that keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled documents; labels: rows of id_col and label_col (0 or 1)."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = written(texts.join(F.broadcast(marked), "doc_id"), "labelled")  # at most max_labelled identifiers
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        forget(sample)
        return Model({}, None)
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * n_toxic))

    def counted(kind: int, wanted: frozenset | None, at_least: int) -> dict[str, int]:
        rows = sample.filter(F.col("toxic") == kind).select("text").mapInArrow(tidy(_count_rows(wanted)), "term string, n bigint")
        rows = rows.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)
        return {r[0]: r[1] for r in rows.toLocalIterator()}  # of toxic terms, those in a fixed share of at most max_labelled texts

    toxic = counted(1, None, least)
    terms = _lexicon(toxic, counted(0, frozenset(toxic), 1), n_toxic, n_clean)
    if not terms:
        forget(sample)
        return Model({}, None)
    near = sample.filter("toxic = 0").select("text").mapInArrow(tidy(_near_rows(terms)), "term string, edits int, n bigint")
    usual = near.groupBy("term", "edits").agg(F.sum("n").alias("n")).filter(F.col("n") > MAX_CLEAN * n_clean).collect()  # two rows a term at most
    for term, edits, _ in usual:
        terms[term] = (terms[term][0], min(terms[term][1], edits - 1))
    rows = sample.select("text", "toxic").mapInArrow(tidy(_feature_rows(terms)), "toxic int, used double, quoted double, share double")
    got = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 4)  # four numbers for each of the labelled rows
    got = got[np.lexsort(got.T)]
    forget(sample)
    return Model(terms, _fit(got[:, 1:], got[:, 0]))


def _near_rows(terms: dict[str, tuple[float, int]]):
    """Texts that have misspellings of each term, by the number of edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = LexiconAutomaton(terms), Counter()
        for batch in batches:
            for text in values(batch.column(0)):
                counts.update({(term, e) for w in set(_WORD.findall((text or "").lower())) for e, term in [automaton.match(w)] if e > 0})
        cols = [pa.array([t for t, _ in counts], pa.string()), pa.array([e for _, e in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "edits", "n"])

    return run


def _feature_rows(terms: dict[str, tuple[float, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            x = [features(*hits(t or "", automaton), automaton.weight) for t in values(batch.column(0))]
            x = np.array(x, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(3))], names=["toxic", "used", "quoted", "share"])

    return run


def _score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(model.terms)
        span = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
        for batch in batches:
            found = [hits(t or "", automaton) for t in values(batch.column(1))]
            scores = pa.array([score(n, h, model, automaton.weight) for n, h in found], pa.float64())
            spans = pa.array([[{"term": t, "start": a, "end": b, "edits": e, "quoted": q} for t, a, b, e, q in h] for _, h in found], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, spans], names=["doc_id", "score", "terms"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), terms (term, start, end, edits, quoted; places in the text as it is)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidy(_score_rows(model)), f"doc_id {kind}, score double, terms array<struct<term:string,start:int,end:int,edits:int,quoted:boolean>>")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: a checksum of the identifier divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below a half, all columns as they are."""
    model = learn(docs, labels.filter(~held_out(id_col)), id_col, text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, at = LexiconAutomaton(model.terms), names.index(text_col)
        for batch in batches:
            keep = [score(*hits(t or "", automaton), model, automaton.weight) < 0.5 for t in values(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
