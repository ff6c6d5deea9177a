"""Column functions on texts: sentences, words, entities, cleaning. All run in the JVM, whole-stage where Spark can.

A word is a run of letters, digits and underscores of any script. Bare `\\w` and `\\b` are ASCII in Java, so words are
written out as WORD and word boundaries are asked for with the flag (?U).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Words that make a sentence negative.
NEGATIVE = ("not", "never", "no", "neither", "nor", "cannot")
#: Separators between accounts that lost their form, and tags that are dropped.
SEPARATORS = (
    r"<doc[,\-\s]*sep[,\-\s]*>",
    r"<[a-zA-Z]+\-sep[a-zA-Z]*>",
    r"<DOC[,\-\s]*sep[a-zA-Z]*>",
    r"<[a-zA-Z]*sep[,\-\s]*[a-zA-Z]*>",
)
TAGS = r"<[^>]*(?:html|citation|footnote|xhtml|x-p|v-sep|hen|doc-p|nowiki)[^>]*>"
DOC_SEP = "<doc-sep>"
#: Texts whose words are held as objects at once.
_PART_TEXTS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end (trim() alone takes off spaces only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def sentences(c: Column | str, least: int = 1) -> Column:
    """Sentences, cut behind `.`, `!` or `?` before white space, stripped; those shorter than `least` are left out."""
    return F.filter(F.transform(F.split(_col(c), r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) >= least)


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def spaced_words(c: Column | str) -> Column:
    """The different lower-case words between white space, in order of first use."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return overlap(spaced_words(a), spaced_words(b))


def entities(c: Column | str) -> Column:
    """The different words of one capital and then small ASCII letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]+$")))


def entity_overlap(a: Column | str, b: Column | str) -> Column:
    return overlap(entities(a), entities(b))


def polarity(c: Column | str) -> Column:
    return F.when(F.arrays_overlap(words(c), F.array(*(F.lit(w) for w in NEGATIVE))), "NEG").otherwise("POS")


def clean_separators(c: Column | str) -> Column:
    """Malformed separators become DOC_SEP, known tags go, white space is collapsed."""
    out = _col(c)
    for pattern in SEPARATORS:
        out = F.regexp_replace(out, "(?i)" + pattern, f" {DOC_SEP} ")
    out = F.regexp_replace(out, "(?i)" + TAGS, " ")
    return strip(F.regexp_replace(out, r"\s+", " "))


def clean_final(c: Column | str) -> Column:
    """The last cleaning of a text."""
    # The steps, in an order that matters
    out = F.regexp_replace(_col(c), "<[^>]*>", " ")
    out = F.regexp_replace(out, "[.]{2,}", ".")
    out = F.regexp_replace(out, "[,]{2,}", ",")
    out = F.regexp_replace(out, r"(?U)\b[a-zA-Z]\b(?:\s[a-zA-Z]\b)+", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, "[“”]", '"')
    out = F.regexp_replace(out, "[‘’]", "'")
    return strip(F.regexp_replace(out, r"([.!?])\s*([a-z])", "$1 $2"))


def half(c: Column | str, first: bool) -> Column:
    """The first or second half of a text; a text of under 20 characters is whole in both."""
    c = _col(c)
    middle = F.floor(F.length(c) / 2).cast("int")
    cut = F.left(c, middle) if first else F.substr(c, middle + 1, F.length(c))
    return F.when(F.length(c) < 20, c).otherwise(strip(cut))


def slice_part(c: Column | str, part: Column) -> Column:
    """The half that part (a or b) names, else the whole text."""
    c = _col(c)
    return F.when(part == "a", half(c, True)).when(part == "b", half(c, False)).otherwise(c)


def drop_prompt(c: Column | str) -> Column:
    """Without leading sentences on merging, where the text shows that it repeats its instruction."""
    c = _col(c)
    about = r"[^.]*(?:merge|gospel|version|story)[^.]*"
    rest = F.regexp_replace(c, rf"(?i)^(?:{about}\.)++", "")
    told = F.contains(c, F.lit("Merge")) | F.contains(c, F.lit("different gospel"))
    return F.when(told & ~rest.rlike(rf"(?i)^{about}"), strip(rest)).otherwise(c)


def capitalise(c: Column | str) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2), F.length(c)))


def document_of(c: Column | str) -> Column:
    """The document that an annotation's identifier begins with, in small letters."""
    return F.lower(F.substring_index(_col(c), "_", 1))


def or_unknown(c: Column | str) -> Column:
    return strip(F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("Unknown")))


def places(c: Column | str, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches, in code points from 0, end exclusive.

    Matches and the pieces between them come from one pattern; running sums of their lengths are the places. Sums run in
    chunks of 64 matches and then over the chunks, so that many matches don't cost their square.
    """
    c = _col(c)
    span = "struct<start:int,end:int,text:string>"
    none, chunks = F.expr(f"cast(array() as array<{span}>)"), F.expr(f"cast(array() as array<array<{span}>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return bind(got, lambda g: F.struct(g["at"].alias("at"), F.array_append(acc["out"], g["out"]).alias("out")))

    def run(both: Column) -> Column:
        steps = F.zip_with(both["pieces"], both["found"], lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("text")))
        parts = bind(F.filter(steps, lambda x: x["text"].isNotNull()), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 64).cast("int")), lambda k: F.slice(s, k * 64 + 1, F.lit(64))))
        return F.when(F.size(both["found"]) > 0, F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), chunks.alias("out")), chunk)["out"])).otherwise(none)

    return bind(F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern, -1).alias("pieces")), run)


def word_places(c: Column | str) -> Column:
    """places() of WORD, for texts of many words: an Arrow function, linear in the text. A null text has none."""
    return F.arrow_udf(_word_places, "array<struct<start:int,end:int,text:string>>")(_col(c))


def _word_places(texts: pa.Array) -> pa.Array:
    """Of each text. Few texts' words are objects at once; what is found is kept as numbers and bytes."""
    word = regex.compile(WORD)
    parts, kind = [], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    for at in range(0, len(texts), _PART_TEXTS):
        sizes, starts, ends, found = array("i", [0]), array("i"), array("i"), []
        for t in texts.slice(at, _PART_TEXTS):
            for m in word.finditer(t.as_py() or ""):
                starts.append(m.start())
                ends.append(m.end())
                found.append(m[0])
            sizes.append(len(found))
        cells = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], names=["start", "end", "text"])
        parts.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), cells).cast(kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
