"""Personal data, and terms that give it away, with DataFrame functions alone.

Base spans are those of four patterns: e-mail addresses, IP addresses, card numbers that pass Luhn's check and telephone
numbers. Their places come from text.places(); patterns are possessive and start only where a run starts, so long runs
cost linear time.

Further terms are found by their information. With N and n() counted in texts over the whole corpus, a term tells of a
protected entity

    pointwise mutual information = log2(N * n(term, entity) / (n(term) * n(entity)))

If that is GENERALISE or more of the entity's own information log2(N / n(entity)), the term is generalised to the kind of
the entity; if REMOVE or more, it is removed, wherever it stands. Entities are of two sorts:

- what a value names: the value itself, an address's host and the names in it, a network, the first digits of a card or a
  telephone number. Term and entity meet if the term stands within WINDOW words of the value, and have to do so in
  LEAST_CONTEXTS different surroundings;
- the kind of value. Term and kind meet if the text has both, outside of addresses.

They have to meet in LEAST_CONTEXTS (for kinds LEAST_TEXTS) texts of their own, and more often than by chance: so often that
of all pairs of a term and an entity that meet, less than one would. That is so if n(term), times the share of texts of
their own, times the Kullback-Leibler divergence of n(term, entity) / n(term) from n(entity) / N is at least the logarithm
of the number of pairs. A text is its own if less than a fifth of its SKETCH least hashes of three words are in another text
where the two meet; others are copies, or little more than a passage that texts share.

Edge cases: null text is empty and has no spans; all rows are kept, repeated ones and those with a null identifier too;
copies count as often as they are there, but are one surrounding, as near copies are: of a value and a term, the
surrounding that is first in order and those whose other words are like its own (a Jaccard similarity of LIKE percent or
more) count as one, then the first of those left, and so on; so copies alone don't make a term tell; an empty table gives an empty result; other columns are ignored by find_spans() and kept, whatever their names,
by sanitise().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import bind, places
from storyloom.llm.common import fresh_names, maybe_in, written

#: Fixed values, in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, LEAST_CONTEXTS, LEAST_TEXTS, LIKE, SKETCH = 5, 2, 3, 60, 16
GENERALISE, REMOVE = 0.75, 0.9
#: Characters on either side of a value that are looked at for words.
_REACH = 120
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be worth a search.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_NO_LETTER = r"[^\p{L}]+"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """start, end and text of a kind's spans. A text without the kind's hint isn't searched."""
    hint = (text.contains(_HINT[kind]) if _HINT[kind] else F.lit(True)) & (text.rlike("[0-9]") if kind != "email" else F.lit(True))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    return F.when(hint, F.filter(places(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))).otherwise(none)


def _near(text: Column, span: Column) -> Column:
    """The words next to a span, WINDOW on either side; a word that the reach cuts is left out with the rest of its piece."""
    low = F.greatest(span["start"] - _REACH, F.lit(0))
    before = F.lower(F.substr(text, low + 1, span["start"] - low))
    after = F.lower(F.substr(text, span["end"] + 1, F.lit(_REACH)))
    words = lambda t: F.filter(F.split(t, _NO_LETTER), lambda w: F.length(w) > 2)
    left = F.slice(F.reverse(words(before)), 1, WINDOW)
    return F.array_distinct(F.concat(left, F.slice(words(after), 1, WINDOW)))


def _typed(column: str, kind_no: int) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), s["text"].alias("value"), _near(F.col("text"), s).alias("near")))


def _count(kind_no: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_no"] == kind_no)).cast("long")


def _entities(kind: str, value: Column) -> Column:
    """What a value names: itself, and what it has in common with others."""
    cut = lambda head, part: F.concat(F.lit(head), part)
    if kind == "email":
        name, host = F.substring_index(F.lower(value), "@", 1), F.substring_index(F.lower(value), "@", -1)
        names = F.transform(F.filter(F.split(name, "[^a-z]+"), lambda w: F.length(w) > 2), lambda w: cut("name:", w))
        return F.array_distinct(F.concat(F.array(value, cut("host:", host)), names))
    if kind == "ip":
        return F.array(value, cut("net:", F.substring_index(value, ".", 3)), cut("net:", F.substring_index(value, ".", 2)))
    return F.array(value, cut("first:", F.left(_digits(value), F.lit(6 if kind == "card" else 4))))


def _letters(text: Column) -> Column:
    """The lower-case words of a text outside of addresses, in order."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), _NO_LETTER), lambda w: w != "")


def _sketch(words: Column) -> Column:
    """The SKETCH least hashes of three words that follow each other: near copies have most in common."""
    three = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    threes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(three(i)))
    return F.slice(F.array_sort(F.array_distinct(threes)), 1, SKETCH)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (digest of the text), spans: kind_no, start, end, value and near (the words next to it) of base spans;
    of texts that have some also words (the different ones) and sketch."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.md5("text"))
    for kind in PATTERNS:
        out = out.withColumn(kind, _found(F.col("text"), kind))
    out = out.withColumn("spans", F.concat(*(_typed(k, n) for n, k in enumerate(PATTERNS))))
    told = bind(_letters(F.col("text")), lambda w: F.struct(F.filter(F.array_distinct(w), lambda x: F.length(x) > 2).alias("words"), _sketch(w).alias("sketch")))
    return out.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, told).alias("of")).select("doc_id", "key", "spans", "of.words", "of.sketch")


def _share(rows: DataFrame, n_all: int) -> DataFrame:
    """rows (n_both, n_term, n_value) with the share of the entity's information that the term tells."""
    scored = rows.withColumn("own", F.log2(F.lit(n_all) / F.col("n_value")))
    scored = scored.withColumn("told", F.log2(F.lit(n_all) * F.col("n_both") / (F.col("n_term") * F.col("n_value"))))
    return scored.filter("own > 0").withColumn("share", F.col("told") / F.col("own")).filter(F.col("share") >= GENERALISE)


def _near_values(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind_no, value, term, row where terms stand next to what a value names; of these pairs those with different
    surroundings and their numbers: kind_no, value, term, n_both, n_value."""
    seen = base.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    named = F.when(F.lit(False), F.array(F.lit("")))
    for n, kind in enumerate(PATTERNS):
        named = named.when(F.col("s.kind_no") == n, _entities(kind, F.col("s.value")))
    seen = written(seen.select("row", F.col("s.kind_no"), F.explode(named).alias("value"), F.col("s.near")).distinct(), "seen")
    value = ["kind_no", "value"]
    n_value = seen.select("row", *value).distinct().groupBy(*value).agg(F.count("*").alias("n_value"))
    contexts = seen.select(*value, F.array_sort("near").alias("near")).distinct().withColumn("term", F.explode("near"))
    contexts = _apart(contexts.withColumn("near", F.array_remove("near", F.col("term"))), [*value, "term"])
    meet = written(seen.select("row", *value, F.explode("near").alias("term")).distinct(), "near")
    pairs = meet.groupBy(*value, "term").agg(F.count("*").alias("n_both")).join(contexts, [*value, "term"]).join(n_value, value)
    return meet, pairs


def _own_texts(meet: DataFrame, sketches: DataFrame) -> DataFrame:
    """kind_no, value, term, n_own: in how many texts of their own these meet. meet: also row; sketches: row, sketch."""
    pair = ["kind_no", "value", "term"]
    cells = meet.join(sketches, "row").select("row", *pair, F.explode("sketch").alias("hash"))
    alone = cells.groupBy(*pair, "hash").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    # a hash of one text alone counts for that text
    alone = alone.filter("n = 1").groupBy(*pair, "row").agg(F.count("*").alias("n_alone"))
    own = alone.join(sketches.select("row", F.size("sketch").alias("n_hashes")), "row").filter(5 * F.col("n_alone") > 4 * F.col("n_hashes"))
    return own.groupBy(*pair).agg(F.count("*").alias("n_own"))


def telling_terms(docs: DataFrame, base: DataFrame, text_col: str = "text") -> DataFrame:
    """term, share (the largest share of an entity's information that it tells), kind_no (of that entity), action."""
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind_no"]))
    held = base.filter(F.size("spans") > 0).select("row", kinds.alias("kinds"), "words", "sketch")
    of_kinds = held.select("row", "words", F.explode("kinds").alias("kind_no")).select("row", "kind_no", F.lit("").alias("value"), F.explode("words").alias("term"))
    by_kind = written(of_kinds.groupBy("kind_no", "value", "term").agg(F.count("*").alias("n_both")), "kinds")
    n_kind = held.select(F.explode("kinds").alias("kind_no")).groupBy("kind_no").agg(F.count("*").alias("n_value"))
    meet, near = _near_values(base)
    pair = ["kind_no", "value", "term"]
    often = by_kind.filter(F.col("n_both") >= LEAST_TEXTS).join(n_kind, "kind_no")
    pairs = written(near.select(*pair, "n_both", "n_value").unionByName(often.select(*pair, "n_both", "n_value")), "pairs")

    n_all, n_kinds, n_near = base.count(), by_kind.count(), meet.select(*pair).distinct().count()
    words = maybe_in(_words(docs.select(_text(text_col))), F.col("term"), pairs.select("term").distinct(), "_maybe").filter("_maybe")
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = _share(pairs.join(n_term, "term"), n_all)
    hit, usual = F.col("n_both") / F.col("n_term"), F.col("n_value") / F.lit(n_all)
    apart = hit * F.ln(hit / usual) + F.when(hit < 1, (1 - hit) * F.ln((1 - hit) / (1 - usual))).otherwise(0.0)
    whole = F.col("value") == ""
    chance = F.when(whole, math.log(max(1, n_kinds))).otherwise(math.log(max(1, n_near)))
    scored = scored.withColumn("told", F.col("n_term") * apart / chance).filter("told >= 1")
    scored = written(scored.select(*pair, "n_both", "share", "told"), "scored")

    some = maybe_in(meet.unionByName(of_kinds.select("row", *pair)), F.col("term"), scored.select("term").distinct(), "_maybe").filter("_maybe")
    own = _own_texts(some.select("row", *pair).join(scored.select(*pair), pair), held.select("row", "sketch"))
    least = F.when(whole, LEAST_TEXTS).otherwise(LEAST_CONTEXTS)
    good = scored.join(own, pair).filter((F.col("n_own") >= least) & (F.col("told") * F.col("n_own") >= F.col("n_both")))
    best = good.groupBy("term").agg(F.max("share").alias("share"), F.max_by("kind_no", F.struct("share", -F.col("kind_no"))).alias("kind_no"))
    best = best.filter(F.col("share") >= GENERALISE)
    return written(best.withColumn("action", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")), "terms")


def _apart(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that have LEAST_CONTEXTS surroundings or more; near copies are one. contexts: keys, near (no row twice)."""
    both, either = F.size(F.array_intersect("near", "first")), F.size(F.array_union("near", "first"))
    for _ in range(LEAST_CONTEXTS - 1):  # each round sets one surrounding aside, with its near copies
        first = contexts.groupBy(*keys).agg(F.min("near").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        contexts = contexts.join(first, keys).filter(100 * both < LIKE * either).select(*keys, "near")
    return contexts.select(*keys).distinct()


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).alias("text")


def _words(texts: DataFrame) -> DataFrame:
    """texts with a row for each different lower-case word of column text, in its place."""
    return texts.select(*(c for c in texts.columns if c != "text"), F.explode(F.array_distinct(F.split(F.lower("text"), _NO_LETTER))).alias("term"))


def _term_spans(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """key, terms (start, kind_no, end, why): where telling terms stand in each text that has some."""
    texts = docs.select(_text(text_col)).withColumn("key", F.md5("text"))
    words = maybe_in(_words(texts), F.col("term"), terms.select("term"), "_maybe").filter("_maybe").select("key", "term")
    of = F.map_from_entries(F.collect_set(F.struct("term", F.struct("action", "kind_no")))).alias("of")  # words of one text
    has = written(words.join(terms, "term").groupBy("key").agg(of), "hits")
    held = maybe_in(texts, F.col("key"), has.select("key"), "_maybe").filter("_maybe").groupBy("key").agg(F.first("text").alias("text"))
    at = F.filter(places("text", r"\p{L}+"), lambda s: F.map_contains_key("of", F.lower(s["text"])))
    got = F.transform(at, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind_no"), s["end"].alias("end"), F.col("of")[F.lower(s["text"])].alias("why")))
    return written(held.join(has, "key").select("key", got.alias("terms")), "term-spans")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, spans: start, kind_no (place in KINDS), end, label; in order of start, then kind.

    Terms inside a base span belong to it and aren't listed. label is what takes a span's place.
    """
    base = written(base_spans(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "base")
    terms = _term_spans(docs, telling_terms(docs, base, text_col), text_col)
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    own = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), F.get(kinds, s["kind_no"]).alias("label")))
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    said = lambda t: F.when(t["why"]["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("[ABOUT "), F.ltrim(F.get(kinds, t["why"]["kind_no"]), F.lit("["))))
    more = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["kind_no"].alias("kind_no"), t["end"].alias("end"), said(t).alias("label")))
    both = base.join(terms, "key", "left").select("doc_id", "key", F.array_sort(F.when(F.col("terms").isNull(), own).otherwise(F.concat(own, more))).alias("spans"))
    return both


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans: the spans of find_spans() as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    term = KINDS.index("term")
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")
    counts = [_count(n).alias(f"n_{k}") for n, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(say(F.filter("spans", lambda s: s["kind_no"] < term)), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def base_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind and base_sha256, without looking for terms."""
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))))
    return digests(base_spans(docs, id_col, text_col).select("doc_id", spans.alias("spans"))).drop("spans")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its label (of spans that overlap, the first), all columns kept."""
    key, spans, maybe = fresh_names(docs.columns, "_key", "_spans", "_maybe")
    found = find_spans(docs, id_col, text_col).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias(spans))
    found = written(found.withColumnRenamed("key", key), "found")
    text = F.col(text_col)

    def put(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.struct(F.when(ahead, s["end"]).otherwise(acc["at"]).alias("at"), F.when(ahead, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    new = F.when(F.col(spans).isNull(), text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    keyed = maybe_in(docs.withColumn(key, F.md5(F.coalesce(text, F.lit("")))), F.col(key), found.select(key), maybe)
    own = [F.col(f"`{c}`") for c in docs.columns]
    changed = keyed.filter(F.col(maybe)).join(found, key, "left")
    changed = changed.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    return keyed.filter(~F.col(maybe)).select(*own).unionByName(changed)


#: The patterns as they are meant, for engines that need no care for long runs.
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def oracle_base() -> str:
    """The rows of base_digests() over documents for DuckDB."""
    digits = "regexp_replace(part, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END * CAST(substr({digits}, CAST(length({digits}) - i AS BIGINT), 1) AS INT) - CASE WHEN i % 2 = 1 AND substr({digits}, CAST(length({digits}) - i AS BIGINT), 1) > '4' THEN 9 ELSE 0 END)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(part, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    found = ",\n".join(
        f"""{kind} AS (
  SELECT row, {n} AS no, '{kind}' AS kind, CAST(pos - length(part) AS BIGINT) AS low, CAST(pos AS BIGINT) AS high FROM (
    SELECT row, i, part, sum(length(part)) OVER (PARTITION BY row ORDER BY i) AS pos FROM (
      SELECT row, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (
        SELECT row, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM t))) WHERE i % 2 = 0 AND {valid[kind]})"""
        for n, (kind, pattern) in enumerate(_PLAIN.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PLAIN)
    return f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), {found},
spans AS ({" UNION ALL ".join(f"SELECT * FROM {k}" for k in _PLAIN)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, no), '')) AS base_sha256 FROM t LEFT JOIN spans USING (row) GROUP BY row, doc_id"""
