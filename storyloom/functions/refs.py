"""Verse references such as 21:1-7, 15:18-16:4, 21:19a: parsing and expansion into ranges within chapters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import strip

_CROSS = r"^(\d+):(\d+)([ab]?)-(\d+):(\d+)([ab]?)$"
_ONE = r"^\s*(\d+)\s*:(\d+)([ab]?)$"
_WITHIN = r"^\s*(\d+)\s*:\s*(\d+)([ab]?)\s*-\s*(\d+)([ab]?)\s*$"
#: Stands for the last verse of a chapter; longer spans than LONGEST chapters are not expanded.
OPEN_END, LONGEST = 999, 3


def parse_ref(c: Column) -> Column:
    """Struct of start chapter and verse, end chapter and verse, start and end part; null if the reference has no such form."""
    c = strip(c)
    number = lambda pattern, g: F.regexp_extract(c, pattern, g).cast("int")
    part = lambda pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))

    def ref(pattern: str, groups: tuple[int, int, int, int, int, int]) -> Column:
        a, b, x, y, p, q = groups
        return F.struct(number(pattern, a).alias("sc"), number(pattern, b).alias("sv"), number(pattern, x).alias("ec"), number(pattern, y).alias("ev"), part(pattern, p).alias("sp"), part(pattern, q).alias("ep"))

    return (
        F.when(c.rlike(_CROSS), ref(_CROSS, (1, 2, 4, 5, 3, 6)))
        .when(c.rlike(_ONE), ref(_ONE, (1, 2, 1, 2, 3, 3)))
        .when(c.rlike(_WITHIN), ref(_WITHIN, (1, 2, 1, 4, 3, 5)))
    )


def expand_ref(ref: Column) -> Column:
    """Array of (chapter, v_start, v_end) that a parsed reference covers; empty for spans of too many chapters.

    A reference that runs backwards covers its first chapter's end and its last chapter's beginning.
    """
    one = lambda c, a, b: F.struct(c.cast("int").alias("chapter"), a.cast("int").alias("v_start"), b.cast("int").alias("v_end"))
    between = F.when(ref["ec"] > ref["sc"] + 1, F.sequence(ref["sc"] + 1, ref["ec"] - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    middle = F.transform(between, lambda c: one(c, F.lit(1), F.lit(OPEN_END)))
    across = F.concat(F.array(one(ref["sc"], ref["sv"], F.lit(OPEN_END))), middle, F.array(one(ref["ec"], F.lit(1), ref["ev"])))
    return F.when(ref["sc"] == ref["ec"], F.array(one(ref["sc"], ref["sv"], ref["ev"]))).when(ref["ec"] <= ref["sc"] + LONGEST, across).otherwise(F.slice(across, 1, 0))


def chapter_verse(c: Column) -> Column:
    """Struct of the chapter and verse that a reference begins with; of one without a known form, those it starts with, else
    0 and 0."""
    ref, start = parse_ref(c), r"^(\d+):(\d+)"
    number = lambda known, group: F.coalesce(known, F.nullif(F.regexp_extract(c, start, group), F.lit("")).cast("int"), F.lit(0))
    return F.struct(number(ref["sc"], 1).alias("chapter"), number(ref["sv"], 2).alias("verse"))
