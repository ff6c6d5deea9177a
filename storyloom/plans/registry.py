"""Queries by name: each takes (spark, sf_dir) and returns a DataFrame over whole tables.

Conversations stand for documents of verses (a conversation is a document, a turn a verse; or a role is a document, a
conversation a chapter), documents for long accounts, events for a timeline, embeddings for dense vectors, pages for markup,
orders and their lines for chapters and their verses. What the tables have no case of is in small tables of fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import refs
from storyloom.functions import text as tx
from storyloom.functions import timex
from storyloom.functions import vectors as vx
from storyloom.operators import align, annotate, consolidate, evaluate, generate, graph, segments
from storyloom.operators.tables import settle
from storyloom.plans import fixtures as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a document, a turn a verse."""
    return annotate.verses(_table(spark, d, "conversations"), F.col("conv_id"), F.col("turn"), F.col("text"))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """A role is a document, a conversation a chapter, a turn a verse."""
    rows = annotate.verses(_table(spark, d, "conversations").withColumn("_at", F.struct("conv_id", "turn")), F.col("role"), F.struct("conv_id", "turn"), F.col("text"))
    return rows.drop("chapter", "verse").join(_numbers(spark, d), ["doc_id", "verse_idx"]).select("doc_id", "verse_idx", "chapter", "verse", "text")


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("role").orderBy("conv_id", "turn")
    rows = _table(spark, d, "conversations").withColumn("verse_idx", F.row_number().over(order) - 1)
    return rows.select(F.col("role").alias("doc_id"), "verse_idx", (F.col("conv_id") + 1).cast("int").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"))


_ROLES = ["user", "assistant", "system"]


def _timetable(spark: SparkSession, d: str) -> DataFrame:
    """A row for each conversation, told by the roles that speak in it."""
    days = F.array(*(F.lit(x) for x in fx.DAY_CYCLE))
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), *(F.max(F.when(F.col("role") == r, F.lit(1))).alias(f"_{r}") for r in _ROLES))
    ref = F.concat((F.col("conv_id") + 1).cast("string"), F.lit(":1-"), (F.col("last") + 1).cast("string"))
    return rows.select(
        F.col("conv_id").cast("int").alias("chronology_index"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("description"),
        F.element_at(days, (F.col("conv_id") % len(fx.DAY_CYCLE) + 1).cast("int")).alias("day"), *(F.when(F.col(f"_{r}") == 1, ref).alias(r) for r in _ROLES),
    )


def _macro(spark: SparkSession, d: str) -> DataFrame:
    verses = _roles(spark, d)
    return consolidate.macro_events(_timetable(spark, d), _ROLES, annotate.events(verses), consolidate.verse_texts(verses))


def _joined(c: str, sep: str = "|"):
    return F.array_join(F.col(c), sep)


# Scans, sentences, words


@query
def verses_from_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d)


@query
def verses_from_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("seq", "text"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    found = tx.sentences("text")
    return _table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.size(tx.sentences("text", 11)).cast("long").alias("n_long"))


@query
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = tx.words("text")
    return _table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_words"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"), F.size(tx.spaced_words("text")).cast("long").alias("n_spaced"))


@query
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", tx.word_places("text").alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[f])
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), total("start").alias("sum_start"), total("end").alias("sum_end"))


@query
def text_projections(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents")
    return rows.select("doc_id", F.left("text", F.lit(2000)).alias("head"), F.length("text").cast("long").alias("n_chars"), F.length(tx.half("text", True)).cast("long").alias("n_first"), F.length(tx.half("text", False)).cast("long").alias("n_second"), tx.capitalise(F.lower("lang")).alias("lang"))


@query
def entity_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.array_sort(tx.entities("text")).alias("e"))
    return rows.select("doc_id", F.size("e").cast("long").alias("n"), _joined("e").alias("entities"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, d, "conversations").withColumn("before", F.lag("text").over(order))
    return rows.filter("before is not null")


@query
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("conv_id", "turn", tx.jaccard("before", "text").alias("jaccard"))


@query
def entity_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("conv_id", "turn", tx.entity_overlap("before", "text").alias("overlap"))


@query
def clean_separators(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    rows = rows.unionByName(spark.createDataFrame(fx.MARKUP, "page_id long, text string"))
    return rows.select("page_id", tx.clean_separators("text").alias("text"))


@query
def clean_final(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", "text")
    rows = rows.unionByName(spark.createDataFrame(fx.DIRTY, "doc_id long, text string"))
    return rows.select("doc_id", tx.clean_final("text").alias("text"))


@query
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", generate.reduce_redundancy("text").alias("text"))


@query
def greedy_dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", generate.reduce_redundancy("text").alias("text"))


@query
def dedup_cap8(spark: SparkSession, d: str) -> DataFrame:
    kept = generate.dedup_texts(tx.sentences("text"))
    rows = _table(spark, d, "documents").select("doc_id", kept.alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), _joined("k", " ").alias("text"))


# Annotation


@query
def polarity(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").unionByName(spark.createDataFrame(fx.TURNS, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", tx.polarity("text").alias("polarity"))


@query
def event_fallback(spark: SparkSession, d: str) -> DataFrame:
    return annotate.events(_turns(spark, d))


@query
def event_class_lexicon(spark: SparkSession, d: str) -> DataFrame:
    rows = annotate.lexicon_events(_fixture_verses(spark).unionByName(_turns(spark, d)))
    return rows.select("id", "doc_id", "verse_idx", "text", "event_class", "polarity")


def _fixture_verses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fx.VERSES, "doc_id string, verse_idx int, chapter int, verse int, text string")


def _all_verses(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).unionByName(_fixture_verses(spark))


@query
def signal_extract(spark: SparkSession, d: str) -> DataFrame:
    return annotate.signals(_all_verses(spark, d)).drop("seq")


@query
def signal_relation_join(spark: SparkSession, d: str) -> DataFrame:
    return annotate.signal_relations(annotate.signals(_all_verses(spark, d))).groupBy("rel_type").agg(F.count("*").alias("n"))


@query
def timex_extract(spark: SparkSession, d: str) -> DataFrame:
    return annotate.time_expressions(_all_verses(spark, d)).drop("seq")


@query
def timex_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in fx.TIMES], "text string")
    return rows.select("text", timex.normalise(F.col("text")).alias("value"))


@query
def tlink_narrative(spark: SparkSession, d: str) -> DataFrame:
    return annotate.narrative_links(annotate.events(_turns(spark, d))).drop("seq")


@query
def tlink_signal(spark: SparkSession, d: str) -> DataFrame:
    verses = _all_verses(spark, d)
    return annotate.signal_links(annotate.lexicon_events(verses), annotate.signals(verses)).drop("seq")


@query
def tlink_anchor(spark: SparkSession, d: str) -> DataFrame:
    verses = _all_verses(spark, d)
    return annotate.anchor_links(annotate.lexicon_events(verses), annotate.time_expressions(verses)).drop("seq", "seq2")


@query
def tlinks(spark: SparkSession, d: str) -> DataFrame:
    verses = _all_verses(spark, d)
    events = annotate.events(verses)
    return annotate.temporal_links(events, annotate.time_expressions(verses), annotate.signals(verses))


@query
def slinks(spark: SparkSession, d: str) -> DataFrame:
    return annotate.subordination_links(annotate.lexicon_events(_all_verses(spark, d)))


@query
def annotation_type_counts(spark: SparkSession, d: str) -> DataFrame:
    verses = _all_verses(spark, d)
    events, times, signals = annotate.events(verses), annotate.time_expressions(verses), annotate.signals(verses)
    return annotate.type_counts(events, times, signals, annotate.temporal_links(events, times, signals), annotate.subordination_links(events))


# Vectors


@query
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = vx.bucket_counts(_table(spark, d, "conversations"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.col("bucket").cast("long").alias("bucket"), "cnt")


@query
def hash_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = annotate.events(_turns(spark, d)).select("id", "text")
    pairs = annotate.narrative_links(annotate.events(_turns(spark, d))).select(F.col("event_id").alias("a"), F.col("related_to_event").alias("b"))
    out = vx.pair_cosines(pairs, vx.bucket_counts(rows, ["id"]))
    return out.select("a", "b", F.round("cosine", 9).alias("cosine"))


@query
def centroid_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings")
    middle = vx.centroid(rows, ["label"], "embedding")
    return rows.join(middle, "label").select("vec_id", "label", F.round(vx.dense_cosine(F.col("embedding"), F.col("centroid")), 6).alias("relevance"))


@query
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, d, "embeddings")
    middle = vx.centroid(rows, ["label"], "embedding")
    near = rows.join(middle, "label").select("label", "vec_id", F.round(vx.dense_cosine(F.col("embedding"), F.col("centroid")), 6).alias("relevance"))
    order = Window.partitionBy("label").orderBy(F.desc("relevance"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


@query
def vector_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select("vec_id", vx.pad(F.transform("embedding", lambda x: x.cast("double")), 96).alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("width"), F.element_at("v", 64).alias("last"), F.element_at("v", 96).alias("end"))


# Alignment


@query
def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.col("source").alias("doc_id"))
    return align.document_pairs(align.document_order(rows))


@query
def parallel_pericopes(spark: SparkSession, d: str) -> DataFrame:
    rows = align.last_by_name(align.parallel_pericopes(spark.createDataFrame(fx.TIMETABLE, fx.TIMETABLE_SCHEMA), ["matthew", "mark", "luke"], "description"))
    return rows.select("chrono_idx", "event_name", F.array_join(F.transform(F.array_sort(F.map_keys("doc_refs")), lambda k: F.concat_ws("=", k, F.element_at("doc_refs", k))), ";").alias("refs"))


@query
def align_best_match(spark: SparkSession, d: str) -> DataFrame:
    return align.best_matches(annotate.events(_roles(spark, d)))


@query
def align_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return align.best_matches_by_index(annotate.events(_roles(spark, d)))


@query
def alignment_groups(spark: SparkSession, d: str) -> DataFrame:
    events = annotate.events(_roles(spark, d))
    return align.group_ids(align.best_matches(events), events)


@query
def tlink_gather(spark: SparkSession, d: str) -> DataFrame:
    events = annotate.events(_roles(spark, d))
    links = annotate.narrative_links(events).withColumn("id", F.concat(F.col("doc_id"), F.lit("_tl"), F.col("seq").cast("string")))
    return align.gather_links(align.group_ids(align.best_matches(events), events), links)


@query
def align_with_pericopes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that some row of the timetable has in common are near; the timetable knows two of the three."""
    pericopes = align.parallel_pericopes(_timetable(spark, d), ["user", "assistant"], "description")
    return align.best_matches(annotate.events(_roles(spark, d)), pericopes)


@query
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures, and a user's kinds of events that follow each other, as four accounts tell them."""
    links = _timeline(spark, d).select("event_id", "event_type", "rel_type", F.col("related_to_event").cast("long").alias("_next"), "ord")
    events = _table(spark, d, "events").select(F.col("event_id").alias("_next"), F.col("event_type").alias("next_type"), "user_id")
    links = links.join(events, "_next").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("group_id"), F.col("event_type").alias("event_id"), F.col("next_type").alias("related_to_event"), "rel_type", F.concat(F.lit("d"), (F.col("ord") % 4).cast("string")).alias("doc_id"), F.col("ord").cast("long").alias("ord"))
    fixed = spark.createDataFrame(fx.GROUP_LINKS, fx.GROUP_LINKS_SCHEMA).withColumn("ord", F.col("ord").cast("long"))
    return align.conflicts(fixed.unionByName(links))


# Consolidation


@query
def verse_ref_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r in fx.REFERENCES], "ref string")
    return rows.select("ref", refs.parse_ref(F.col("ref")).alias("p")).select("ref", "p.*")


@query
def verse_range_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r in fx.REFERENCES], "ref string").select("ref", refs.parse_ref(F.col("ref")).alias("p")).filter("p is not null")
    return rows.select("ref", F.posexplode(refs.expand_ref(F.col("p"))).alias("range_no", "r")).select("ref", "range_no", "r.*")


@query
def verse_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders are rows that cover lines 2 to 5 of their own chapter; the lines are verses."""
    lines = _table(spark, d, "lineitem").select(F.lit("book").alias("doc_id"), F.col("l_orderkey").cast("int").alias("chapter"), F.col("l_linenumber").cast("int").alias("verse"), F.col("l_quantity").alias("q"))
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("chronology_index"), F.lit("book").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(":2-5")).alias("ref"))
    covered = consolidate.covered_verses(orders, lines.withColumn("id", F.lit("")))
    rows = covered.join(lines, ["doc_id", "chapter", "verse"])
    return rows.groupBy("chronology_index").agg(F.count("*").alias("n_verses"), F.sum("q").alias("sum_quantity"))


@query
def part_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").withColumn("part", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("turn") % 3 + 1).cast("int")))
    return rows.select("conv_id", "turn", tx.slice_part("text", F.col("part")).alias("text"))


@query
def macro_events(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d).select("id", "text", "description", _joined("original_events").alias("original_events"), "chronology_index", "num_source_texts", _joined("source_docs").alias("source_docs"), "day")


def _parted(spark: SparkSession, d: str) -> DataFrame:
    """References with parts: users from the second half of a conversation's first verse into the next one's second, assistants
    the first half of a verse."""
    at = (F.col("conv_id") + 1).cast("string")
    refs_of = {"user": F.concat(at, F.lit(":1b-"), (F.col("conv_id") + 2).cast("string"), F.lit(":2a")), "assistant": F.concat(at, F.lit(":2a"))}
    rows = _table(spark, d, "conversations").select("conv_id").distinct()
    cells = F.array(*(F.struct(F.lit(r).alias("doc_id"), F.lit(i).alias("doc_ord"), ref.alias("ref")) for i, (r, ref) in enumerate(refs_of.items())))
    return rows.select(F.col("conv_id").cast("int").alias("chronology_index"), F.explode(cells).alias("c")).select("chronology_index", "c.*")


@query
def part_ranges(spark: SparkSession, d: str) -> DataFrame:
    verses = _roles(spark, d)
    rows = consolidate.accounts(_parted(spark, d), annotate.events(verses), consolidate.verse_texts(verses))
    return rows.select("chronology_index", "doc_id", "text", _joined("event_ids").alias("event_ids"))


@query
def chapter_verse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r in fx.REFERENCES + fx.ODD_REFERENCES], "ref string").unionByName(_parted(spark, d).select("ref"))
    return rows.select("ref", refs.chapter_verse(F.col("ref")).alias("p")).select("ref", "p.*")


@query
def macro_events_fixture(spark: SparkSession, d: str) -> DataFrame:
    verses, table = _fixture_verses(spark), spark.createDataFrame(fx.TIMETABLE, fx.TIMETABLE_SCHEMA)
    rows = consolidate.macro_events(table, ["matthew", "mark", "luke"], annotate.events(verses), consolidate.verse_texts(verses))
    return rows.withColumn("original_events", _joined("original_events")).withColumn("source_docs", _joined("source_docs"))


@query
def account_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d).select("chronology_index", "chosen_doc")


@query
def chain_edges(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.chain_edges(_macro(spark, d))


@query
def detail_edges(spark: SparkSession, d: str) -> DataFrame:
    events = annotate.events(_roles(spark, d))
    matches = align.best_matches(events)
    links = annotate.narrative_links(events)
    return consolidate.detail_edges(links, matches).unionByName(consolidate.across_edges(links, matches)).groupBy("etype").agg(F.count("*").alias("n"))


# Segments, order, narrative


@query
def segment_events(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment(_macro(spark, d)).select("id", "seg_rank", "label", "day_key", "chronology_index")


@query
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_runs(_timetable(spark, d)).select("chronology_index", "seg_rank", "label")


@query
def topo_order(spark: SparkSession, d: str) -> DataFrame:
    """The fixture's graph, and behind it the chain of the macro-events."""
    macro = settle(_macro(spark, d).select("id", "chronology_index"))
    nodes, edges = spark.createDataFrame(fx.NODES, "id string, no int"), spark.createDataFrame(fx.EDGES, "src string, dst string")
    nodes = nodes.unionByName(macro.select("id", (F.col("chronology_index") + 100).alias("no")))
    return segments.narrative_order(nodes, edges.unionByName(consolidate.chain_edges(macro).select("src", "dst")), "no")


@query
def extractive_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d).select("id", generate.extractive_consolidate("text").alias("text"))


@query
def consolidation_log(spark: SparkSession, d: str) -> DataFrame:
    return generate.consolidation_log(segments.segment(_macro(spark, d)))


@query
def narrative(spark: SparkSession, d: str) -> DataFrame:
    return generate.narrative(generate.segment_texts(generate.consolidation_log(segments.segment(_macro(spark, d)))))


# Evaluation


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    """Links of each user's events in order of time, as the relation that values tell."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, d, "events").withColumn("n", F.lead("event_id").over(order)).withColumn("v", F.lead("value").over(order)).filter("n is not null")
    return rows.select(F.col("event_id").cast("string").alias("event_id"), F.col("n").cast("string").alias("related_to_event"), "event_type", F.when(F.col("value") <= F.col("v"), "BEFORE").otherwise("AFTER").alias("rel_type"), F.col("event_id").alias("ord"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted: all before, those of purchases by a signal. Gold: by value, without errors."""
    rows = _timeline(spark, d)
    predicted = rows.select("event_id", "related_to_event", F.lit("BEFORE").alias("rel_type"), F.when(F.col("event_type") == "purchase", "signal").otherwise("narrative_order").alias("source"))
    return predicted, rows.filter("event_type <> 'error'")


@query
def temporal_ordering_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ordering_accuracy(*_links(spark, d))


@query
def adjacent_pair_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.adjacent_pair_accuracy(*_links(spark, d))


@query
def temporal_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.temporal_f1(*_links(spark, d))


def _talks(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, output, reference: what the assistant and the user say, in order."""
    rows = _table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    rows = rows.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), " "))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("text"))), F.lit("")).alias("output"), F.coalesce(F.max(F.when(F.col("role") == "user", F.col("text"))), F.lit("")).alias("reference"))


@query
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    talks = _talks(spark, d)
    return evaluate.entity_coverage(talks.select("conv_id", F.col("reference").alias("text")), talks.select("conv_id", F.col("output").alias("narrative")), ["conv_id"])


@query
def coherence(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.coherence(_table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query
def redundancy_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.redundancy_ratio(_table(spark, d, "conversations"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("n_repeated").cast("long").alias("n_repeated"), "ratio")


@query
def ngram_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ngram_redundancy(_table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query
def rouge_1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rouge_n(_talks(spark, d), ["conv_id"], 1)


@query
def rouge_2(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rouge_n(_talks(spark, d), ["conv_id"], 2)


@query
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rouge_l(_talks(spark, d), ["conv_id"])


@query
def meteor(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.meteor(_talks(spark, d), ["conv_id"])


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")


@query
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.kendall_tau(_ranks(spark, d), ["user_id"], "at", "value").select("user_id", "n", "concordant", "discordant", "tau")


@query
def rank_pair_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_pair_accuracy(_ranks(spark, d), ["user_id"], "at", "value")


@query
def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"), (F.col("vec_id") % 2).alias("side"))
    out = evaluate.greedy_matching(rows.filter("side = 0").select("label", "vec"), rows.filter("side = 1").select("label", "vec"), ["label"])
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# Graph


def _ring(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as nodes; each receives from the next two of its label, by a type each."""
    from pyspark.sql import Window

    rows = _table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("no"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    order = Window.partitionBy("label").orderBy("no")
    parts = [rows.select(F.lead("no", k).over(order).alias("src_no"), F.col("no").alias("dst_no"), F.lit(k - 1).alias("type_no")) for k in (1, 2)]
    return rows, parts[0].unionByName(parts[1]).filter("src_no is not null")


@query
def rgat_softmax(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _ring(spark, d)
    x = nodes.select("no", "x")
    ends = edges.join(x.toDF("src_no", "a"), "src_no").join(x.toDF("dst_no", "b"), "dst_no").withColumn("score", F.round(vx.dot(F.col("a"), F.col("b")), 9))
    out = graph.softmax_by_target(ends.select("dst_no", "src_no", "score"), ["dst_no"])
    return out.select("dst_no", "src_no", F.round("weight", 6).alias("weight"))


@query
def rgat_message(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _ring(spark, d)
    weights = graph.softmax_by_target(edges.withColumn("score", 0.5 * F.col("type_no")), ["dst_no"])
    rows = weights.join(nodes.select(F.col("no").alias("src_no"), F.col("x").alias("h")), "src_no").withColumn("head", F.lit(0))
    out = graph.aggregate_messages(nodes, rows)
    return out.select("no", F.round(F.element_at("out", 1), 6).alias("first"), F.round(F.element_at("out", 64), 6).alias("last"))


@query
def rgat_losses(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _ring(spark, d)
    half = nodes.select("no", F.transform("x", lambda v: v / 2).alias("x"))
    out = graph.losses(nodes.select("no", "x"), half, edges)
    return out.select(*(F.round(c, 9).alias(c) for c in ("reconstruction", "consistency", "loss")))


@query
def document_of(spark: SparkSession, d: str) -> DataFrame:
    events = annotate.events(_turns(spark, d))
    return events.groupBy(tx.document_of("id").alias("doc_id")).agg(F.count("*").alias("n"))


@query
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first three rows of the timetable that some role tells."""
    return _macro(spark, d).select("chronology_index", "description").orderBy("chronology_index").limit(3)


@query
def rgat_forward(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _ring(spark, d)
    net = graph.network(64, len(consolidate.EDGE_TYPES), 8)
    out = graph.forward(nodes.select("no", "x"), edges, net)
    return out.select("no", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query
def rgat_train(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the macro-events along their chain, by a network trained on it."""
    macro = settle(_macro(spark, d).select("id", "text", "chronology_index"))
    numbers = consolidate.number_nodes(macro, "chronology_index")
    vecs = vx.hashed_dense(macro, ["id"]).join(numbers, "id").select("no", vx.pad(F.col("vec"), vx.NODE_WIDTH).alias("x"))
    return graph.embed_all_nodes(vecs, consolidate.index_edges(numbers, consolidate.chain_edges(macro)), len(consolidate.EDGE_TYPES))


@query
def index_edges(spark: SparkSession, d: str) -> DataFrame:
    macro = settle(_macro(spark, d).select("id", "chronology_index"))
    return consolidate.index_edges(consolidate.number_nodes(macro, "chronology_index"), consolidate.chain_edges(macro))
