"""License scans with DataFrame functions alone: TF-IDF cosine to templates, then inheritance along directories.

1. A text's segments (lines and sentences) that hold an anchor word, as every template does, are compared with the
   templates: different segments once, token by token, by an equi-join with the templates' weights. The cosine is over all
   tokens of a segment; tokens that no template has weigh as the rarest. The best template of MIN_COSINE or more counts.
2. A file's own license is that of its best segment. A license file is one with an own license that bears a license name:
   its directory and what lies below have its license. Where names tell nothing, the caller may let texts with an own
   license and at most `file_words` words count, too. Of several in a directory, that with the smallest name counts.
3. Other files take the license of the nearest directory above them that has one: different directories are exploded into
   their ancestors, joined with the licensed ones, and the deepest kept, so a directory of many files is one row.

Edge cases: null and empty text have no segments; a null path has no directory and inherits nothing; all rows are kept,
repeated ones and null identifiers too; ties between templates go to the smaller license name; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import written

MIN_COSINE = 0.6
ANCHOR = r"licen[cs]e|copyright|copying|permission|public domain|warrant|redistribut"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
SPLIT = r"[.!?][ \t\r\n]+|\n"
TOKEN = "[a-z0-9]+"
#: Notices and phrases by which licenses are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """Rows (license, template, token, idf, weight / norm), and the idf of tokens that no template has."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for i, (name, c) in enumerate(zip((n for n, _ in templates), counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, i, t, idf[t], n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, math.log(1 + len(counts)) + 1


def _weights(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, float]:
    rows, unknown = template_weights(templates)
    table = spark.createDataFrame(rows, "license string, template int, token string, idf double, weight double")
    return table.select("license", "template", "token", "weight"), table.select("token", "idf").distinct(), unknown


def score_segments(segments: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """segment, license, score: the best template of each different segment, if it is near enough."""
    weights, idf, unknown = _weights(segments.sparkSession, templates)
    tokens = segments.select("segment").distinct().select("segment", F.explode(F.regexp_extract_all(F.lower("segment"), F.lit(TOKEN), F.lit(0))).alias("token"))
    tokens = tokens.groupBy("segment", "token").agg(F.count("*").alias("n")).join(F.broadcast(idf), "token", "left")  # the templates' tokens
    tokens = tokens.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    norms = tokens.groupBy("segment").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tokens.join(F.broadcast(weights), "token").groupBy("segment", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "segment").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= MIN_COSINE)
    best = scored.groupBy("segment", "license").agg(F.max("score").alias("score"))
    best = best.groupBy("segment").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("segment", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, file_words: int = 0) -> DataFrame:
    """doc_id, path, own_license, own_score, license, origin (own, directory or none), license_dir (if inherited)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.filter(F.split(text, SPLIT), lambda s: F.lower(s).rlike(ANCHOR))
    held = F.when(F.lower(text).rlike(ANCHOR), F.array_distinct(held)).otherwise(F.expr("cast(array() as array<string>)"))
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), held.alias("segments"), F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).alias("words"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "files")
    segments = rows.filter(F.size("segments") > 0).select("row", F.explode("segments").alias("segment"))
    found = segments.join(score_segments(segments, templates), "segment")
    own = found.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = rows.join(own.select("row", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score")), "row", "left")
    own = written(own.select("doc_id", "path", "words", "own_license", "own_score", _directory(F.col("path")).alias("dir")), "own")

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    bears = F.col("own_license").isNotNull() & F.col("path").isNotNull() & ((F.col("words") <= file_words) | name.rlike(LICENSE_NAME))
    licensed = own.filter(bears).groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("b")).select(F.col("dir").alias("at"), F.col("b.own_license").alias("inherited"))
    dirs = own.filter("path is not null and own_license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = dirs.select("dir", F.explode(above).alias("at")).join(licensed, "at")
    near = near.groupBy("dir").agg(F.max(F.struct(F.length("at").alias("n"), "at", "inherited")).alias("b"))
    out = own.join(near.select("dir", F.col("b.at").alias("license_dir"), F.col("b.inherited").alias("inherited")), "dir", "left")
    takes = F.col("own_license").isNull() & F.col("path").isNotNull()
    origin = F.when(F.col("own_license").isNotNull(), "own").when(takes & F.col("inherited").isNotNull(), "directory").otherwise("none")
    return out.select("doc_id", "path", "own_license", "own_score", F.when(takes, F.col("inherited")).otherwise(F.col("own_license")).alias("license"), origin.alias("origin"), F.when(takes, F.col("license_dir")).alias("license_dir"))


def oracle(file_words: int, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same rows for DuckDB, over documents with the paths of document_path()."""
    rows, unknown = template_weights(templates)
    quoted = ", ".join(f"('{n}', {i}, '{t}', {idf!r}::double, {w!r}::double)" for n, i, t, idf, w in rows)
    return f"""
WITH weights(license, template, token, idf, weight) AS (VALUES {quoted}),
idfs AS (SELECT DISTINCT token, idf FROM weights),
files AS (
  SELECT doc_id, '/' || source || '/' || array_to_string(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), '/') AS path, coalesce(text, '') AS text FROM documents),
segs AS (
  SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[.!?][ \\t\\r\\n]+|\\n'), lambda s: regexp_matches(lower(s), '{ANCHOR}')))) AS segment
  FROM files WHERE regexp_matches(lower(text), '{ANCHOR}')),
toks AS (
  SELECT segment, token, count(*) AS n FROM (SELECT segment, unnest(regexp_extract_all(lower(segment), '{TOKEN}')) AS token FROM (SELECT DISTINCT segment FROM segs)) GROUP BY 1, 2),
w AS (SELECT segment, t.token, n * coalesce(idf, {unknown!r}::double) AS w FROM toks t LEFT JOIN idfs USING (token)),
norms AS (SELECT segment, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
dots AS (SELECT segment, license, template, sum(w * weight) AS dot FROM w JOIN weights USING (token) GROUP BY 1, 2, 3),
scored AS (SELECT segment, license, max(round(dot / norm, 6)) AS score FROM dots JOIN norms USING (segment) GROUP BY 1, 2),
best AS (SELECT * FROM scored WHERE score >= {MIN_COSINE}),
own AS (
  SELECT doc_id, license AS own_license, score AS own_score FROM (
    SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM segs JOIN best USING (segment)) WHERE r = 1),
f AS (
  SELECT doc_id, path, own_license, own_score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS words
  FROM files LEFT JOIN own USING (doc_id)),
lic AS (SELECT dir AS spot, min_by(own_license, path) AS inherited FROM f WHERE own_license IS NOT NULL AND words <= {file_words} GROUP BY 1),
near AS (
  SELECT dir, spot, inherited, row_number() OVER (PARTITION BY dir ORDER BY length(spot) DESC) AS r
  FROM (SELECT DISTINCT dir FROM f) d JOIN lic ON d.dir = lic.spot OR starts_with(d.dir, lic.spot || '/'))
SELECT doc_id, path, own_license, own_score, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN spot END AS license_dir
FROM f LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (dir)"""


def document_path(docs: DataFrame) -> DataFrame:
    """documents with a path: the source, then a directory for each digit of the identifier."""
    digits = F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/")
    return docs.withColumn("path", F.concat(F.lit("/"), F.col("source"), F.lit("/"), digits))
