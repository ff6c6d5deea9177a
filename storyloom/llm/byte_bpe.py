"""Byte-level BPE over a whole corpus, each distinct pre-token encoded once.

Pre-tokens are exploded block by block (a block is some megabytes of neighbouring documents) into the block's distinct
words and, for each document, the positions of its words. The words are shuffled by their hash, so that equal words of
all blocks meet in one task and are encoded once; their ids travel back to the blocks, where documents are put together
by position. A word that is everywhere is one entry a block, so no task is hot. What is shuffled is packed: words of a
bucket in one row, ids as 16 bits where the vocabulary allows, positions by descending frequency, all under zstd. A block
has at most BUCKETS rows of words, whatever the number of tasks.

Texts are read and parted once, and positions are shuffled once: they are dealt by block in the same exchange as the words,
of which one side reads the words and sends their ids on, by block, and the other reads the positions where they lie. Where
spark.sql.exchange.reuse is off, each side parts the texts for itself.

A block's key is a digest of its words and its place in the input, so a lost task that is run again gives the same rows; if
the input isn't deterministic, the last step finds ids missing and fails rather than giving wrong ids. Blocks of the same
words have keys of their own, so they aren't gathered in one task.

Edge cases: null text counts as empty, empty text has no ids; null identifiers and repeated rows are kept row by row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import give_back, tidy, values

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: Parts at most in which words are encoded: a block's row of one bucket has some tens of words even then.
BUCKETS = 2048
#: Words of a bucket that a task remembers; beyond that it starts over, and words that come again are encoded again.
KNOWN_WORDS = 1_000_000
#: Bucket number of a block's documents.
_DOCS = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at `path`: lines of a base64 token and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; ids in between that don't exist are empty."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of bytes, which pack better; planes that are all zero are left out."""
    x = x.astype("<u4")
    rows = x.view(np.uint8).reshape(-1, 4).T
    n = 4
    while n > 1 and not rows[n - 1].any():
        n -= 1
    return zstandard.compress(bytes([n]) + rows[:n].tobytes(), 3)


def _unplanes(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = raw[0]
    rows = np.frombuffer(raw, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((rows.shape[1], 4), np.uint8)
    out[:, :n] = rows.T
    return out.view("<u4").ravel()


def _bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)


class _Block:
    """The words of one block in order of frequency, and its documents as positions in that list."""

    def __init__(self, ids: list, texts: list[str], pattern: regex.Pattern, place: tuple[int, int]):
        index: dict[str, int] = {}
        found = [np.fromiter((index.setdefault(w, len(index)) for w in pattern.findall(t)), np.int32) for t in texts]
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        often = np.bincount(flat, minlength=len(index))
        names = list(index)
        by = np.argsort(-often, kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        self.ids, self.sizes = ids, [len(x) for x in found]
        del found
        self.positions = rank[flat]
        self.words = [names[i].encode("utf-8") for i in by.tolist()]
        digest = hashlib.blake2b(b"%d %d " % place, digest_size=16)
        lengths = np.fromiter(map(len, self.words), np.uint32, len(self.words))
        digest.update(lengths.tobytes())
        digest.update(b"".join(self.words))
        self.key = digest.digest()


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[_Block]:
    compiled = regex.compile(pattern)
    task = TaskContext.get()
    places = ((task.partitionId() if task else 0, n) for n in count())
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
            t = t or ""
            if texts and chars + len(t) > BLOCK_CHARS:
                block = _Block(ids, texts, compiled, next(places))
                ids, texts, chars = [], [], 0  # the block doesn't need the texts
                yield block
            ids.append(i)
            texts.append(t)
            chars += len(t)
    if texts:
        block = _Block(ids, texts, compiled, next(places))
        del ids, texts
        yield block


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(len(words).to_bytes(4, "little") + lengths.tobytes() + b"".join(words), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    at, out = 4 + 4 * n, []
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def _block_rows(pattern: str, buckets: int, id_type: pa.DataType) -> Callable:
    """For each block a row for each bucket of its words, the most frequent first, and one with the bucket of each word, the
    positions, and the documents with their numbers of words. `deal` is what rows are dealt to tasks by: the bucket of words,
    the block of documents."""
    docs_type, sizes_type = pa.list_(id_type), pa.list_(pa.int32())
    names = ["block", "bucket", "deal", "payload", "docs", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            bucket = _bucket_of(block.words, buckets)
            by = np.argsort(bucket, kind="stable")
            kinds, starts = np.unique(bucket[by], return_index=True)
            ends, n = [*starts[1:].tolist(), len(by)], len(kinds)
            blobs = [_pack_words([block.words[i] for i in by[a:b].tolist()]) for a, b in zip(starts.tolist(), ends, strict=False)]
            deal = pa.array([k.to_bytes(4, "little") for k in kinds.tolist()], pa.binary())
            kinds = pa.array(kinds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([block.key] * n, pa.binary()), kinds, deal, pa.array(blobs, pa.binary()), pa.nulls(n, docs_type), pa.nulls(n, sizes_type)], names=names)
            head = _planes(bucket)
            payload = len(head).to_bytes(4, "little") + head + _planes(block.positions)
            cols = [pa.array([block.key], pa.binary()), pa.array([_DOCS], pa.int32()), pa.array([block.key], pa.binary()), pa.array([payload], pa.binary()), pa.array([block.ids], docs_type), pa.array([block.sizes], sizes_type)]
            del block, bucket, blobs
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _encode_rows(ranks) -> Callable:
    """Rows of words sorted by bucket: each distinct word of a bucket is encoded once, whatever the number of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})
        at, known = None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                if bucket != at or len(known) > KNOWN_WORDS:
                    at, known = bucket, {}
                got = []
                for w in _unpack_words(blob.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = core.encode_ordinary(w.decode("utf-8"))
                    got.append(ids)
                sizes = np.fromiter(map(len, got), np.uint32, len(got))
                flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
                head = _planes(sizes)
                out.append(len(head).to_bytes(4, "little") + head + _planes(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return run


def _two(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    return _unplanes(blob[4:cut]), _unplanes(blob[cut:])


def _put_together(blob: bytes, sizes: list[int], parts: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The id arrays of a block's documents."""
    bucket, positions = _two(blob)
    by = np.argsort(bucket, kind="stable")
    none = np.zeros(0, np.uint32)
    ordered = [parts[k] for k in sorted(parts)]
    length_by = np.concatenate([none, *(x[0] for x in ordered)]).astype(np.int64)  # of the block's different words
    if len(length_by) != len(by):
        raise RuntimeError("ids of some words are missing: the input changed between two reads; write it to a table first")
    flat = np.concatenate([none, *(x[1] for x in ordered)])
    start, length = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    start[by], length[by] = np.cumsum(length_by) - length_by, length_by
    taken = length[positions].astype(np.int32)
    ends = np.cumsum(taken, dtype=np.int64)
    at = np.repeat(start[positions] - (ends - taken), taken)
    at += np.arange(len(at))
    ids = flat[at]
    del at
    cuts = np.concatenate([[0], ends])[np.cumsum(sizes)[:-1]] if sizes else []
    return np.split(ids, np.asarray(cuts, np.int64))


def _finish_rows(finish: Callable, context) -> Callable:
    """The ids of a block's words and its row of documents: finish(identifiers, id arrays, context) makes the result."""

    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        try:
            if docs.num_rows != 1:
                raise RuntimeError("documents of some words are missing: the input changed between two reads; write it to a table first")
            parts = {bucket: _two(blob.as_py()) for bucket, blob in zip(words["bucket"].to_pylist(), words["ids"], strict=True)}
            n, names = docs["sizes"][0].as_py(), docs["docs"][0].values
            ids = _put_together(docs["payload"][0].as_py(), n, parts)
            del parts
            return pa.Table.from_batches([finish(names[a : a + 500], ids[a : a + 500], context) for a in range(0, len(n), 500)])
        finally:
            give_back()

    return run


def _as_ids(names: pa.Array, ids: list[np.ndarray], _) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([names, pa.array(np.diff(offsets).astype(np.int64)), tokens], names=["doc_id", "n_tokens", "ids"])


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of a document: its ids joined with the token-byte table."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def _as_digests(names: pa.Array, ids: list[np.ndarray], table) -> pa.RecordBatch:
    decimal = _decimals(len(table.value))
    said = [hashlib.sha256(b",".join(map(decimal.__getitem__, x.tolist()))).hexdigest() for x in ids]
    back = [hashlib.sha256(decode_ids(x, table.value)).hexdigest() for x in ids]
    return pa.RecordBatch.from_arrays([names, pa.array([len(x) for x in ids], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


_DECIMALS: list[bytes] = []


def _decimals(n: int) -> list[bytes]:
    if len(_DECIMALS) < n:
        _DECIMALS[:] = [b"%d" % i for i in range(n)]
    return _DECIMALS


def _kept_above(condition):
    """condition as one that the optimizer can't move below an exchange, so that filters of the same rows share theirs."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, buckets: int | None, finish: Callable, context, columns: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = T.StructType([docs.schema["doc_id"]])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id, id_sql = to_arrow_type(id_type[0].dataType), id_type[0].dataType.simpleString()
    buckets = buckets or min(BUCKETS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary: it doesn't grow with the corpus
    schema = f"block binary, bucket int, deal binary, payload binary, docs array<{id_sql}>, sizes array<int>"
    rows = docs.mapInArrow(tidy(_block_rows(pattern, buckets, arrow_id)), schema).repartition("deal")
    words, texts = (rows.filter(_kept_above(x)) for x in (F.col("bucket") != _DOCS, F.col("bucket") == _DOCS))  # all columns of both, or the exchange isn't one
    ids = words.sortWithinPartitions("bucket").mapInArrow(tidy(_encode_rows(shared)), "block binary, bucket int, ids binary")
    return ids.groupBy("block").cogroup(texts.groupBy("deal")).applyInArrow(_finish_rows(finish, context), f"doc_id {id_sql}, {columns}")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>: a row for each row of docs.

    buckets: parts in which distinct words are encoded.
    """
    return _encoded(docs, ranks, pattern, id_col, text_col, buckets, _as_ids, None, "n_tokens bigint, ids array<int>")


def encode_decode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the bytes decoded from the ids."""
    table = docs.sparkSession.sparkContext.broadcast(token_table(ranks))
    return _encoded(docs, ranks, pattern, id_col, text_col, buckets, _as_digests, table, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """`encoded` with its ids decoded: column text, bytes that aren't UTF-8 replaced. Null ids give null."""
    table = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))

    @F.pandas_udf(T.StringType())
    def text(ids):
        return ids.map(lambda x: None if x is None else decode_ids(np.asarray(x, np.int64), table.value).decode("utf-8", "replace"))

    return encoded.withColumn("text", text(ids_col))
