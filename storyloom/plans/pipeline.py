"""The whole job as one lazy plan: verses, annotations, alignments, macro-events, segments, narrative, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from storyloom.operators import align, annotate, consolidate, evaluate, generate, segments


@dataclass
class Story:
    """The tables of a run."""

    verses: DataFrame
    events: DataFrame
    times: DataFrame
    signals: DataFrame
    tlinks: DataFrame
    slinks: DataFrame
    alignments: DataFrame
    macro: DataFrame
    edges: DataFrame
    log: DataFrame
    segment_texts: DataFrame
    narrative: DataFrame

    def type_counts(self) -> DataFrame:
        return annotate.type_counts(self.events, self.times, self.signals, self.tlinks, self.slinks)

    def metrics(self, gold: DataFrame | None = None) -> DataFrame:
        return evaluate.evaluate(self.events, self.tlinks, self.alignments, self.narrative, gold)


def build(verses: DataFrame, timetable: DataFrame, documents: list[str], lexicon: bool = False, generator=None) -> Story:
    """The tables of a run over verses and a timetable (chronology_index, description, day, a column for each document)."""
    verses = verses.persist()
    events = annotate.lexicon_events(verses) if lexicon else annotate.events(verses)
    times, signals = annotate.time_expressions(verses), annotate.signals(verses)
    tlinks = annotate.temporal_links(events, times, signals)
    parallel = align.parallel_pericopes(timetable, documents, "description")
    matches = align.group_ids(align.best_matches(events, parallel), events)
    macro = consolidate.macro_events(timetable, documents, events, consolidate.verse_texts(verses)).persist()
    log = generate.consolidation_log(segments.segment(macro), generator)
    parts = generate.segment_texts(log)
    return Story(verses, events, times, signals, tlinks, annotate.subordination_links(events), matches, macro, consolidate.chain_edges(macro), log, parts, generate.narrative(parts))


def preview(verses: DataFrame, timetable: DataFrame, documents: list[str], rows: int = 3) -> Story:
    """The tables of a run over the first rows of the timetable alone."""
    return build(verses, timetable.orderBy("chronology_index").limit(rows), documents)
