import public_tokenizers as P
import pytest
import tiktoken

from storyloom.llm import byte_bpe
from storyloom.llm.queries import oracle_sql, queries

from .conftest import SCHEMA, words

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, copies, toxic texts by invented terms, an address."""
    where = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, labels = [], []
    for i in range(240):
        w = words(60, i)
        if i % 6 == 0:
            w[3], w[30] = "grobbler", "mudsop"
        rows.append((i, " ".join(w), f"s{i % 3}", "en", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300, rows[1][1], "s1", "en", 0), (301, rows[2][1] + " end", "s2", "en", 0), (302, "write to ann@mail.example.com now " + " ".join(words(30, 999)), "s0", "en", 0), (303, None, None, None, None), (None, "null id text", "s1", "en", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_stages_do_their_work(spark, corpus):
    where, rows = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "byte_bpe"]
    clean = stages["toxicity"](spark, docs, where)
    toxic = {i for i, *_ in rows if i is not None and i < 240 and i % 6 == 0}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - toxic
    single = stages["near_dedup"](spark, clean, where)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i, *_ in rows} - toxic - {300, 301}
    private = stages["pii"](spark, single, where)
    texts = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == docs.columns and texts[302].startswith("write to [EMAIL] now") and texts[1] == rows[1][1] and texts[303] is None
    mixed = stages["mixing"](spark, private, where).collect()
    assert set(mixed[0].asDict()) == set(docs.columns) and all(r.n_chars == len(r.text) for r in mixed)


def test_run_is_the_stages_and_gives_the_library_s_ids(spark, corpus):
    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), plain.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in pipeline.run(spark, where).collect()) == want


def test_registered():
    names = queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")].__len__() == 10 and {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names}
    assert set(oracle_sql()) <= set(names)
