"""URL filters: host and path rules, and a logistic regression where no rule fits.

A rule `host/path` fits its host and all hosts below it, if the path starts with the rule's; the longest rule wins. The
caller's rules become one expression, tried from the longest on.

The regression sees hashed character n-grams of host and path (2 ** BITS buckets, presence only, host and path apart). It
is trained by averaged adaptive gradient steps on a small table of labelled urls, by default the hand-written one of
url_labels: on hosts none of whose words it was trained on, it is right for four of five. The bias
is moved to an expected share PRIOR of blocked urls, so that a url without known n-grams is allowed.

Edge cases: a url that is null or has no `://` has an empty host and path, which no rule fits and which give nothing to
judge by: P(block) is 0; a host or a path alone may be empty; all rows are kept, repeated ones and null identifiers too;
labelled rows without url or label are left out; without labelled urls of both kinds the verdict is that of the only kind,
or allow; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.url_labels import ALLOWED, BLOCKED

BITS, GRAMS, EPOCHS, PRIOR = 16, (3, 4), 40, 0.3
_START, _END = "^", "$"

@dataclass
class Model:
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls (with host, path) and: rule (the longest that fits, or null), ruled (its verdict). rules: (rule, verdict)."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: (len(x[0]), x[0])):  # the last that is put on is tried first
        host, _, path = rule.partition("/")
        inside = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(inside & F.startswith(F.col("path"), F.lit("/" + path)), found).otherwise(fitting)
    out = urls.withColumn("_fit", fitting)
    return out.withColumn("rule", F.col("_fit.rule")).withColumn("ruled", F.col("_fit.verdict")).drop("_fit")


def buckets(host: str, path: str) -> np.ndarray:
    """The buckets of a url's n-grams."""
    found = set()
    for mark, text in (("h", host), ("p", path)):
        if text:
            text = _START + text + _END
            for n in GRAMS:
                found.update(mark + text[i : i + n] for i in range(len(text) - n + 1))
    return np.fromiter((zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in found), np.int64, len(found))


def train(rows: list[tuple[str, str, bool]], seed: int = 5, prior: float = PRIOR) -> Model:
    """A model of P(block) from (host, path, blocked), where a share `prior` of all urls is expected to be blocked."""
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 8.0 if len(y) and y[0] else -8.0)
    x = [buckets(h, p) for h, p, _ in rows]
    w, total, rng = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.random.default_rng(seed)
    steps = 0
    squares = np.full((1 << BITS) + 1, 1e-8)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            at = np.append(np.unique(x[i]), 1 << BITS)
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(), -30, 30)))
            g = (p - y[i]) + 1e-4 * w[at]
            squares[at] += g * g
            w[at] -= 0.1 * g / np.sqrt(squares[at])
        total += w
        steps += 1
    mean = total / steps
    odds = lambda p: float(np.log(p / (1 - p)))
    return Model(mean[:-1], float(mean[-1]) + odds(prior) - odds(float(y.mean())))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked: the small table of labelled urls."""
    return spark.createDataFrame([(u, True) for u in BLOCKED] + [(u, False) for u in ALLOWED], "url string, blocked boolean")


def _labelled_rows(labelled: DataFrame) -> list[tuple[str, str, bool]]:
    host, path = host_and_path(F.col("url"))
    rows = labelled.dropna(subset=["url", "blocked"]).select(host.alias("host"), path.alias("path"), "blocked").distinct()
    return [(r.host, r.path, r.blocked) for r in rows.orderBy("host", "path", "blocked").collect()]  # a small table


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value.weights, model.value.bias
        for batch in batches:
            found = [np.unique(buckets(h, p)) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            z = np.array([bias + weights[x].sum() for x in found], float)
            p = np.where([len(x) > 0 for x in found], 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_block"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else block if P(block) is a half or more), p_block.

    labelled: url, blocked: a table to train on that fits the driver; without it, that of labelled_urls().
    """
    urls = apply_rules(split_urls(pages, id_col, url_col), rules)
    spark = pages.sparkSession
    model = train(_labelled_rows(labelled_urls(spark) if labelled is None else labelled))
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights
    kind = urls.schema["page_id"].dataType.simpleString()
    scored = urls.select("page_id", "host", "path", "rule", "ruled").mapInArrow(_score_rows(shared), f"page_id {kind}, host string, path string, rule string, ruled string, p_block double")
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def oracle_rules(rules: list[tuple[str, str]]) -> str:
    """page_id, host, path, rule and ruled of split_urls() and apply_rules() for DuckDB."""
    given = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in rules)
    return rf"""
WITH rules(rule, verdict, below, start) AS (VALUES {given}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS row, page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM rest),
urls AS (
  SELECT row, page_id, coalesce(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '') AS path FROM parts),
fits AS (
  SELECT row, rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, rule DESC) AS n
  FROM urls JOIN rules ON (host = below OR ends_with(host, '.' || below)) AND starts_with(path, start))
SELECT page_id, host, path, rule, verdict AS ruled FROM urls LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (row)"""
