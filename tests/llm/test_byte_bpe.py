import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

from storyloom.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library_for_every_row(documents, ranks, plain):
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in byte_bpe.encode(documents, ranks, P.PATTERN).collect())
    want = Counter((r.doc_id, len(ids), tuple(ids)) for r in documents.collect() for ids in [plain.encode_ordinary(r.text or "")])
    assert got == want


def test_digests_and_round_trip(documents, ranks, plain):
    rows = byte_bpe.encode_decode_digests(documents, ranks, P.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = byte_bpe.encode(documents, ranks, P.PATTERN)
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded, ranks).collect()} == texts


def test_blocks_don_t_matter(documents, ranks, monkeypatch):
    want = sorted((str(r) for r in byte_bpe.encode(documents, ranks, P.PATTERN).collect()))
    small = byte_bpe._encoded(documents, ranks, P.PATTERN, "doc_id", "text", 3, byte_bpe._as_ids, None, "n_tokens bigint, ids array<int>")
    assert sorted(str(r) for r in small.collect()) == want


def test_empty_table_and_clashing_columns(no_documents, documents, ranks):
    assert byte_bpe.encode(no_documents, ranks, P.PATTERN).count() == 0
    clash = documents.withColumnRenamed("lang", "ids").withColumnRenamed("source", "block")
    assert byte_bpe.encode(clash, ranks, P.PATTERN).columns == ["doc_id", "n_tokens", "ids"]


def test_each_word_is_encoded_once(spark, ranks):
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(50)], "doc_id long, text string").repartition(4)
    assert {tuple(r.ids) for r in byte_bpe.encode(docs, ranks, P.PATTERN).collect()} == {tuple(tiktoken.Encoding("p", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("the same words again and again"))}


def test_missing_ids_are_an_error():
    import numpy as np

    blob = byte_bpe._planes(np.array([0, 1]))
    payload = len(blob).to_bytes(4, "little") + blob + byte_bpe._planes(np.array([0, 1]))
    with pytest.raises(RuntimeError, match="missing"):
        byte_bpe._put_together(payload, [2], {0: (np.array([1], np.uint32), np.array([7], np.uint32))})


def test_positions_are_shuffled_once(documents, ranks):
    encoded = byte_bpe.encode(documents, ranks, P.PATTERN)
    rows = encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "ReusedExchange" in line]
    dealt = [line for line in exchanges if "hashpartitioning(deal" in line or "payload" in line]
    assert len(rows) == documents.count()
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1  # both sides read one exchange of texts, parted once
    assert not any(name in line for line in plan.splitlines() if "hashpartitioning(block" in line for name in ("payload", "docs"))


def test_blocks_of_the_same_words_have_keys_of_their_own(spark, ranks, plain, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 10)
    same = pa.RecordBatch.from_arrays([pa.array([1, 1, None, 2]), pa.array(["the same text"] * 3 + [None])], names=["doc_id", "text"])
    keys = [block.key for block in byte_bpe._blocks(iter([same]), P.PATTERN)]
    assert len(keys) == len(set(keys)) == 4
    again = [block.key for block in byte_bpe._blocks(iter([same]), P.PATTERN)]
    assert again == keys  # a task that is run again
    docs = spark.createDataFrame([(i % 3, "the same text") for i in range(12)], "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(docs, ranks, P.PATTERN).collect())
    assert got == {(i, tuple(plain.encode_ordinary("the same text"))): 4 for i in range(3)}


def test_texts_without_words(spark, ranks):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, ""), (1, None)], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in byte_bpe.encode(docs, ranks, P.PATTERN).collect()) == ["(1, 0, [])", "(1, 0, [])", "(2, 0, [])", "(None, 0, [])"]


def test_words_without_their_documents_are_an_error():
    import pyarrow as pa

    words = pa.table({"block": [b"k"], "bucket": pa.array([0], pa.int32()), "ids": [b""]})
    with pytest.raises(RuntimeError, match="missing"):
        byte_bpe._finish_rows(byte_bpe._as_ids, None)(words, pa.table({"payload": pa.array([], pa.binary())}))
