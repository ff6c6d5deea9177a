"""Annotation of verses: events, time expressions, signals, and the temporal and subordination links within documents.

Verses are rows (doc_id string, verse_idx int from 0, chapter int, verse int, text string). Every annotation is a projection
of its verse but for the counters in identifiers and the links, which need the order of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions import timex

# Lemmas by event class, in the order in which classes are tried, and words of states.
LEMMAS = {
    "REPORTING": "say tell ask answer reply declare announce proclaim preach teach warn command order call cry shout write testify prophesy explain".split(),
    "PERCEPTION": "see hear watch notice observe feel perceive look behold witness".split(),
    "ASPECTUAL": "begin start stop finish end cease continue resume complete".split(),
    "I_ACTION": "try attempt seek desire want plan decide intend hope promise agree refuse choose".split(),
    "I_STATE": "believe know think understand love fear hate trust doubt suppose expect remember forget".split(),
}
STATES = "is are was were am be being been has have had belong contain consist exist remain seem appear become".split()


def _document() -> Window:
    return Window.partitionBy("doc_id")


def verses(rows: DataFrame, doc: Column, position: Column, text: Column, per_chapter: int = 10) -> DataFrame:
    """Verses of rows of text: numbered by position within a document, so many to a chapter."""
    named = rows.select(doc.cast("string").alias("doc_id"), position.alias("_at"), text.alias("text"))
    at = F.row_number().over(_document().orderBy("_at")) - 1
    numbered = named.withColumn("verse_idx", at)
    return numbered.select("doc_id", "verse_idx", (F.floor(F.col("verse_idx") / per_chapter) + 1).cast("int").alias("chapter"), (F.col("verse_idx") % per_chapter + 1).cast("int").alias("verse"), "text")


def event_class(words: Column) -> Column:
    """The class of the first class's lemma among the words; a word for a state; else an occurrence."""
    has = lambda of: F.arrays_overlap(words, F.array(*(F.lit(w) for w in of)))
    out = F.when(has(STATES), "STATE").otherwise("OCCURRENCE")
    for name, lemmas in reversed(LEMMAS.items()):
        out = F.when(has(lemmas), name).otherwise(out)
    return out


def _event(text: Column, kind: Column, number: Column, tense: Column | None = None, aspect: Column | None = None) -> list[Column]:
    tense, aspect = (F.lit("PAST") if tense is None else tense), (F.lit("PERFECTIVE") if aspect is None else aspect)
    return [
        F.concat_ws("_e", "doc_id", number.cast("string")).alias("id"), "doc_id", number.cast("int").alias("seq"), text.alias("text"), "verse_idx", "chapter", "verse",
        F.concat_ws(":", "chapter", "verse").alias("verse_ref"), kind.alias("event_class"), tense.alias("tense"), aspect.alias("aspect"), tx.polarity(text).alias("polarity"),
    ]


def events(verses: DataFrame) -> DataFrame:
    """One event a verse, as without a language model: an occurrence in the past."""
    return verses.select(*_event(tx.strip("text"), F.lit("OCCURRENCE"), F.col("verse_idx")))


def lexicon_events(verses: DataFrame) -> DataFrame:
    """One event for each different sentence of a verse, its class from the lemmas among its words.

    An approximation where no language model tells verbs: words count as they are written.
    """
    cut = verses.select("doc_id", "verse_idx", "chapter", "verse", F.posexplode(F.array_distinct(tx.sentences("text"))).alias("_at", "_text"))
    number = F.row_number().over(_document().orderBy("verse_idx", "_at")) - 1
    cut = cut.withColumn("_n", number)
    return cut.select(*_event(F.col("_text"), event_class(tx.words("_text")), F.col("_n")))


def model_events(verses: DataFrame, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """One event for each different sentence of a verse in which a language model finds a verb, by the first such verb;
    columns as of events(), and verb_lemma. A verse without verbs has none.

    load: each worker calls it once; it returns a function from texts to, for each, its verbs in order as (sentence, word,
    lemma, tense, aspect, future): tense Past or Pres and aspect Perf or Prog as morphology names them, else null or empty;
    future: whether will or shall belongs to the verb. A null list counts as empty.
    """

    @F.pandas_udf("array<struct<sentence:string,word:string,lemma:string,tense:string,aspect:string,future:boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[tuple(v) for v in found or ()] for found in model(texts.fillna("").tolist())])

    verbs = verses.select("doc_id", "verse_idx", "chapter", "verse", F.posexplode(run("text")).alias("_at", "_v"))
    verbs = verbs.withColumn("_text", tx.strip("_v.sentence"))
    first = Window.partitionBy("doc_id", "verse_idx", "_text").orderBy("_at")
    cut = verbs.withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    cut = cut.withColumn("_n", F.row_number().over(_document().orderBy("verse_idx", "_at")) - 1)
    lemma, state = F.lower(F.coalesce("_v.lemma", "_v.word")), F.lower("_v.word")
    kind = event_class(F.array(lemma))
    kind = F.when(kind.isin(*LEMMAS), kind).when(state.isin(*STATES), "STATE").otherwise("OCCURRENCE")
    tense = F.when(F.col("_v.tense") == "Past", "PAST").when(F.col("_v.tense") == "Pres", "PRESENT").when(F.col("_v.future"), "FUTURE").otherwise("PAST")
    aspect = F.when(F.col("_v.aspect") == "Perf", "PERFECTIVE").when(F.col("_v.aspect") == "Prog", "PROGRESSIVE").when(F.col("_v.tense") == "Past", "PERFECTIVE").otherwise("NONE")
    return cut.select(*_event(F.col("_text"), kind, F.col("_n"), tense, aspect), lemma.alias("verb_lemma"))


def _numbered(found: DataFrame, letter: str) -> DataFrame:
    number = F.row_number().over(_document().orderBy("verse_idx", "_at")) - 1
    return found.withColumn("seq", number).withColumn("id", F.concat(F.col("doc_id"), F.lit(f"_{letter}"), F.col("seq").cast("string")))


def _named_times(load: Callable[[], Callable[[list[str]], list]]):
    """Each text's entities that are labelled DATE or TIME; of those at the same place the first."""

    def kept(text: str, found) -> list[tuple]:
        once: dict[tuple[int, int], tuple] = {}
        for start, end, label in found or ():
            if label in ("DATE", "TIME"):
                once.setdefault((start, end), (start, end, text[start:end], label))
        return list(once.values())

    @F.pandas_udf("array<struct<start_char:int,end_char:int,text:string,timex3_type:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            plain = texts.fillna("").tolist()
            yield pd.Series([kept(t, found) for t, found in zip(plain, model(plain), strict=True)])

    return run


def time_expressions(verses: DataFrame, load: Callable[[], Callable[[list[str]], list]] | None = None) -> DataFrame:
    """Time expressions by pattern; a match that overlaps one of an earlier pattern is dropped.

    load: each worker calls it once; it returns a function from texts to, for each, the named entities (start, end, label)
    of a language model, in code points. Those labelled DATE or TIME come first, each place once; patterns may not overlap
    them.
    """

    def typed(pattern: str, kind: str) -> Column:
        return F.transform(tx.places("text", "(?iU)" + pattern), lambda s: F.struct(s["start"].alias("start_char"), s["end"].alias("end_char"), s["text"].alias("text"), F.lit(kind).alias("timex3_type")))

    def accept(kept: Column, more: Column) -> Column:
        meets = lambda m: F.exists(kept, lambda k: (m["start_char"] < k["end_char"]) & (k["start_char"] < m["end_char"]))
        return F.concat(kept, F.filter(more, lambda m: ~meets(m)))

    if load is not None:
        verses = verses.withColumn("_named", _named_times(load)("text"))
    kept = ["doc_id", "verse_idx", "text", *(["_named"] if load is not None else [])]
    found = verses.select(*kept, *(typed(p, k).alias(f"_p{i}") for i, (p, k) in enumerate(timex.TIMEX_PATTERNS)))
    if load is not None:
        found = found.withColumn("_p0", accept(F.col("_named"), F.col("_p0")))
    found = reduce(lambda df, i: df.withColumn("_p0", accept(F.col("_p0"), F.col(f"_p{i}"))), range(1, len(timex.TIMEX_PATTERNS)), found)
    rows = found.select("doc_id", "verse_idx", F.posexplode("_p0").alias("_at", "_t"))
    rows = _numbered(rows, "t")
    return rows.select("id", "doc_id", "seq", F.col("_t.text").alias("text"), "verse_idx", F.col("_t.timex3_type").alias("timex3_type"), timex.normalise(F.col("_t.text")).alias("value"), F.col("_t.start_char").alias("start_char"), F.col("_t.end_char").alias("end_char"))


def signals(verses: DataFrame) -> DataFrame:
    """Words and phrases that signal a temporal relation."""
    rows = verses.select("doc_id", "verse_idx", F.posexplode(tx.places("text", "(?iU)" + timex.SIGNAL_PATTERN)).alias("_at", "_s"))
    rows = _numbered(rows, "s")
    return rows.select("id", "doc_id", "seq", F.col("_s.text").alias("text"), "verse_idx", F.col("_s.start").alias("start_char"), F.col("_s.end").alias("end_char"))


def signal_relations(signals: DataFrame) -> DataFrame:
    """signals with the relation that each tells; those that tell none are left out."""
    table = F.create_map(*(F.lit(x) for pair in timex.SIGNALS.items() for x in pair))
    return signals.withColumn("rel_type", F.element_at(table, F.lower("text"))).filter("rel_type is not null")


def narrative_links(events: DataFrame) -> DataFrame:
    """Each event before the next of its document."""
    after = F.lead("id").over(_document().orderBy("seq"))
    rows = events.select("doc_id", "seq", F.col("id").alias("event_id"), after.alias("related_to_event"))
    return rows.filter("related_to_event is not null").withColumn("rel_type", F.lit("BEFORE")).withColumn("source", F.lit("narrative_order"))


def signal_links(events: DataFrame, signals: DataFrame, last_verse_only: bool = False) -> DataFrame:
    """The first event of a verse to its last by each signal in it, if the verse has two events or more.

    last_verse_only: only the signals of a document's last verse count.
    """
    ends = events.groupBy("doc_id", "verse_idx").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("event_id"), F.max_by("id", "seq").alias("related_to_event"))
    told = signal_relations(signals)
    if last_verse_only:
        last = events.groupBy("doc_id").agg(F.max("verse_idx").alias("verse_idx"))
        told = told.join(last, ["doc_id", "verse_idx"], "left_semi")
    rows = told.select("doc_id", "verse_idx", "seq", "rel_type", F.col("id").alias("signal_id")).join(ends.filter("n >= 2"), ["doc_id", "verse_idx"])
    return rows.select("doc_id", "seq", "event_id", "related_to_event", "rel_type", "signal_id", F.lit("signal").alias("source"))


def anchor_links(events: DataFrame, times: DataFrame) -> DataFrame:
    """Every event of a verse within each time expression of the verse."""
    at = times.select("doc_id", "verse_idx", F.col("id").alias("related_to_time"), F.col("seq").alias("_t"))
    rows = events.select("doc_id", "verse_idx", F.col("id").alias("event_id"), F.col("seq").alias("_e")).join(at, ["doc_id", "verse_idx"])
    return rows.select("doc_id", F.col("_t").alias("seq"), F.col("_e").alias("seq2"), "event_id", "related_to_time", F.lit("IS_INCLUDED").alias("rel_type"), F.lit("temporal_anchor").alias("source"))


def temporal_links(events: DataFrame, times: DataFrame, signals: DataFrame, last_verse_only: bool = False) -> DataFrame:
    """All temporal links, numbered within a document: narrative order, then signals, then anchors."""
    parts = [narrative_links(events), signal_links(events, signals, last_verse_only), anchor_links(events, times)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("_rule", F.lit(i)) for i, p in enumerate(parts)))
    number = F.row_number().over(_document().orderBy("_rule", "seq", "seq2")) - 1
    return rows.select(F.concat(F.col("doc_id"), F.lit("_tl"), number.cast("string")).alias("id"), "doc_id", "rel_type", "event_id", "related_to_event", "related_to_time", "signal_id", "source")


def subordination_links(events: DataFrame) -> DataFrame:
    """Reporting, intention and negated belief or perception, to the next event of the same verse."""
    after = F.lead(F.struct("id", "verse_idx")).over(_document().orderBy("seq"))
    rows = events.withColumn("_next", after).filter("_next.verse_idx = verse_idx")
    kind = F.when(F.col("event_class") == "REPORTING", "EVIDENTIAL").when(F.col("event_class") == "I_ACTION", "MODAL")
    kind = kind.when((F.col("polarity") == "NEG") & F.col("event_class").isin("I_STATE", "PERCEPTION"), "COUNTER_FACTIVE")
    rows = rows.withColumn("rel_type", kind).filter("rel_type is not null")
    number = F.row_number().over(_document().orderBy("seq")) - 1
    return rows.select(F.concat(F.col("doc_id"), F.lit("_sl"), number.cast("string")).alias("id"), "doc_id", "rel_type", F.col("id").alias("event_id"), F.col("_next.id").alias("subordinated_event"))


def type_counts(events: DataFrame, times: DataFrame, signals: DataFrame, tlinks: DataFrame, slinks: DataFrame) -> DataFrame:
    """Annotations by document and type, with totals: nulls stand for all."""
    parts = {"EVENT": events, "TIMEX3": times, "SIGNAL": signals, "TLINK": tlinks, "SLINK": slinks}
    rows = reduce(DataFrame.unionByName, (df.select("doc_id", F.lit(k).alias("type")) for k, df in parts.items()))
    return rows.rollup("doc_id", "type").agg(F.count("*").alias("n"))
