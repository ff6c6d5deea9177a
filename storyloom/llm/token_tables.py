"""Token ids of a corpus in sorted string tables: shards of documents by identifier, made to be searched.

A shard is a file of lines, each followed by MAGIC; numbers are little-endian:

    data     blocks one after the other, then for each an index entry, and a tail: offset of the first entry u32, ids of
             the shard before this line u64, kind u8 (0). A block is zstd over entries in key order; an entry is varint shared, varint
             unshared, varint value length, the key's unshared bytes, the value. `shared` counts the bytes in common with
             the key before; a block starts over at 0
    last     the index, all entries again: a block's first key (8 bytes), offset in the file u64, length u32, entries u32,
             mask u8; a Bloom filter over the keys, FILTER_BITS a key, FILTER_HASHES probes; a footer: offsets of index
             and filter u64, their sizes u32, entries u64, ids u64, bytes of an id u32, kind u8 (1)

A line ends with its mask, a byte that all its other bytes are combined with by exclusive or: 0, or, where MAGIC would
stand within the line, the first that avoids it. A key is the identifier as 8 big-endian bytes, its sign bit flipped, so
bytes sort as numbers do. A value is the ids, 2 bytes each where the vocabulary allows, else 4.

Texts are encoded where they lie; the ids travel to their shards, whose borders come from a sample of (identifier, digest
of the text, size): SAMPLE rows and SHARD_ROWS for each shard, about, so that an identifier that very many rows have is cut,
too. A shard has about SHARD_BYTES of ids; of a small corpus less, down to LEAST_BYTES, so that all tasks have work. A
manifest, a row a shard, has first and last identifier, entries and ids: it gives every shard its place in the whole, and
lookup() opens the shards alone that may hold an identifier, and of them footer, index, filter and one block.

Files are written by Spark's text writer, a row a line, whose line end is the format's MAGIC: so they reach any store that
Spark reaches, and a task that is run again leaves no halves behind.

Edge cases: null text is empty and gets the end id alone; rows with a null identifier are left out, as a key is needed;
repeated identifiers are entries one after the other; an empty table gives no files and an empty result; other columns are
ignored; a tokenizer whose words white space doesn't part is refused.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import forget, tidy, values, written

MAGIC = b"LOOMSST1"
SHARD_BYTES, LEAST_BYTES = 256_000_000, 16_000_000
#: Compressed bytes of a data line, and bytes of values in a block.
LINE_BYTES, BLOCK_BYTES = 1_000_000, 64_000
SAMPLE, SHARD_ROWS = 20_000, 20
FILTER_BITS, FILTER_HASHES = 10, 7
#: Bytes of ids for a character of text, about: for choosing how many shards there are.
_ID_BYTES = 0.6
_INDEX, _TAIL, _FOOTER = struct.Struct("<8sQIIB"), struct.Struct("<IQB"), struct.Struct("<QQIIQQIB")
#: Words whose ids a worker remembers before it starts over.
_CACHE_WORDS = 1_000_000
#: Characters of text whose words are learned together.
_TOGETHER = 1_000_000
#: All of ASCII's marks but the apostrophe, with which letters go together.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def key_of(doc_id: int) -> bytes:
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _halves(key: bytes) -> tuple[int, int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return a, b | 1


def _masked(line: bytes, mask: int) -> bytes:
    return (np.frombuffer(line, np.uint8) ^ np.uint8(mask)).tobytes() if mask else line


def _safe(line: bytes) -> tuple[bytes, int]:
    """The line with a mask at its end, so that the first MAGIC behind is the line's end."""
    for mask in range(256):
        out = _masked(line, mask) + bytes([mask])
        if (out + MAGIC).find(MAGIC) == len(out):
            return out, mask
    raise ValueError("no mask keeps the line's end out of the line")


class Builder:
    """A shard from entries in ascending order: add() gives the lines that are full, finish() the last ones."""

    def __init__(self, width: int):
        self.width, self.at, self.n_ids, self.entries, self.first, self.last_key = width, 0, 0, 0, b"", b""
        self._index: list[tuple] = []
        self._hashes: list[tuple[int, int]] = []
        self._line: list[bytes] = []
        self._open: list[tuple] = []
        self._line_bytes, self._before = 0, 0
        self._block, self._block_first, self._count, self._held = bytearray(), b"", 0, 0

    def add(self, doc_id: int, value: bytes) -> list[bytes]:
        key, shared = key_of(doc_id), 0
        if self._count:
            while shared < 8 and key[shared] == self.last_key[shared]:
                shared += 1
        else:
            self._block_first = key
        self.first = self.first or key
        self._block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self._count, self._held, self.last_key = self._count + 1, self._held + len(value), key
        self.entries, self.n_ids = self.entries + 1, self.n_ids + len(value) // self.width
        self._hashes.append(_halves(key))
        if self._held >= BLOCK_BYTES:
            self._close()
        return self._flush() if self._line_bytes >= LINE_BYTES else []

    def _close(self) -> None:
        if self._count:
            packed = zstandard.compress(bytes(self._block), 1)
            self._open.append((self._block_first, self.at + self._line_bytes, len(packed), self._count))
            self._line.append(packed)
            self._line_bytes += len(packed)
        self._block, self._count, self._held = bytearray(), 0, 0

    def _flush(self) -> list[bytes]:
        if not self._line:
            return []
        table = b"".join(_INDEX.pack(*x, 0) for x in self._open)
        line, mask = _safe(b"".join([*self._line, table, _TAIL.pack(self._line_bytes, self._before, 0)]))
        self._index += [(*x, mask) for x in self._open]
        self.at += len(line) + len(MAGIC)
        self._line, self._open, self._line_bytes, self._before = [], [], 0, self.n_ids
        return [line]

    def finish(self) -> list[bytes]:
        self._close()
        out = self._flush()
        bits = max(64, FILTER_BITS * self.entries)
        mask = np.zeros(bits, np.uint8)
        if self._hashes:
            a, b = np.array(self._hashes, np.uint64).T
            for i in range(FILTER_HASHES):
                mask[(a + np.uint64(i) * b) % np.uint64(bits)] = 1
        table, bloom = b"".join(_INDEX.pack(*x) for x in self._index), np.packbits(mask, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.at, self.at + len(table), len(table), bits, self.entries, self.n_ids, self.width, 1)
        return [*out, _safe(table + bloom + footer)[0]]


def build(entries: list[tuple[int, bytes]], width: int) -> bytes:
    """A whole shard but for its last MAGIC; entries in ascending order of identifier."""
    made = Builder(width)
    lines = [x for doc_id, value in entries for x in made.add(doc_id, value)]
    return MAGIC.join([*lines, *made.finish()])


def _block_entries(block: bytes, count: int) -> Iterator[tuple[int, bytes]]:
    raw, i, key = zstandard.decompress(block), 0, b""
    for _ in range(count):
        head = []
        for _ in range(3):
            value = shift = 0
            while True:
                byte = raw[i]
                i += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            head.append(value)
        shared, unshared, length = head
        key = key[:shared] + raw[i : i + unshared]
        i += unshared
        yield id_of(key), raw[i : i + length]
        i += length


def read_line(line: bytes) -> tuple[int, Iterator[tuple[int, bytes]]]:
    """Ids before a data line, and its entries."""
    line = _masked(line[:-1], line[-1])
    table, before, _ = _TAIL.unpack_from(line, len(line) - _TAIL.size)
    found = [_INDEX.unpack_from(line, i) for i in range(table, len(line) - _TAIL.size, _INDEX.size)]
    start = found[0][1]
    return before, (e for _, at, size, count, _ in found for e in _block_entries(line[at - start : at - start + size], count))


class Table:
    """A shard, opened by its footer. read(offset, length) gives bytes of the file; or the file's bytes are given."""

    def __init__(self, raw: bytes | Callable[[int, int], bytes], size: int | None = None):
        if isinstance(raw, bytes):
            self.read, size = (lambda at, n: raw[at : at + n]), len(raw)
        else:
            self.read = raw
        end = self.read(size - len(MAGIC) - 1 - _FOOTER.size, _FOOTER.size + 1 + len(MAGIC))
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a table file")
        self._mask = end[_FOOTER.size]
        index_at, self._filter_at, index_size, self._bits, self.entries, self.n_ids, self.width, _ = _FOOTER.unpack(_masked(end[: _FOOTER.size], self._mask))
        index = _masked(self.read(index_at, index_size), self._mask)
        self._blocks = list(_INDEX.iter_unpack(index))
        self._filter: bytes | None = None

    def _entries(self, n: int) -> Iterator[tuple[int, bytes]]:
        _, at, size, count, mask = self._blocks[n]
        return _block_entries(_masked(self.read(at, size), mask), count)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for n in range(len(self._blocks)):
            yield from self._entries(n)

    def may_hold(self, doc_id: int) -> bool:
        if self._filter is None:
            self._filter = _masked(self.read(self._filter_at, (self._bits + 7) // 8), self._mask)
        a, b = _halves(key_of(doc_id))
        places = [(a + i * b & (1 << 64) - 1) % self._bits for i in range(FILTER_HASHES)]
        return all(self._filter[p // 8] >> (p % 8) & 1 for p in places)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document by filter, binary search of the index, then its block; the first, if it is repeated."""
        if not self._blocks or not self.may_hold(doc_id):
            return None
        firsts, key = [b[0] for b in self._blocks], key_of(doc_id)
        n = max(0, bisect_right(firsts, key) - 1)
        while n and firsts[n] == key:  # a repeated key may begin in the block before
            n -= 1
        for at in range(n, len(firsts)):
            if firsts[at] > key:
                return None
            for other, value in self._entries(at):
                if other == doc_id:
                    return self.ids(value)
        return None

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")


def _lowers(normalizer: dict | None) -> bool:
    """Whether the tokenizer lower-cases, and does nothing before that which tells a word of letters from its lower case."""
    steps = (normalizer or {}).get("normalizers", [normalizer or {}])
    spaces = lambda s: s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " "
    known = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and spaces(s) for s in steps)
    return known and any(s["type"] == "Lowercase" for s in steps)


class _Encoder:
    """Ids of texts as bytes. Words between spaces and line ends are encoded once while a worker remembers them: white
    space parts the tokenizer's words, so a text's ids are those of its words one after the other.

    Many texts are taken together: Arrow numbers their distinct words, and each of these alone is a Python string and is
    looked for among the known ones. New words of letters alone are given to the tokenizer many at a time, A-Z as a-z where
    it lower-cases anyway, and told apart by the tokens that end a word; if their number isn't that of the words, or the
    vocabulary has no such tokens, each is encoded by itself. A word of letters with marks behind it is put together from
    both, where the tokenizer parts them so and normalizing leaves it letters alone.
    """

    _last: _Encoder | None = None

    def __init__(self, tokenizer: str, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.source, self.tokenizer, self.kind, self.known = tokenizer, Tokenizer.from_str(tokenizer), f"<u{width}", {}
        made = json.loads(tokenizer)
        suffix = made["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        named = any(t["content"][:1].isalpha() for t in made.get("added_tokens", []))  # found in one case alone, and before words are parted
        self.parts_marks = not named and all(one(w + m) == one(w) + one(m) for w in ("word", "Étés", "漢字") for m in (*_MARKS, "...", "?!", "$$$", ",\"", _MARKS))
        self.lowers = not named and _lowers(made.get("normalizer"))

    @classmethod
    def of(cls, tokenizer: str, width: int) -> _Encoder:
        """The encoder that this worker has from an earlier task, with the words it remembers, or a new one."""
        if cls._last is None or cls._last.source != tokenizer or cls._last.kind != f"<u{width}":
            cls._last = cls(tokenizer, width)
        return cls._last

    def _apart(self, words: list[str]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(got.ids, self.kind).tobytes()

    def _stay_letters(self, cores: list[str]) -> set[str]:
        """Those of letters alone once they are normalized, too: else what they end in may go together with marks behind."""
        if not cores or not self.tokenizer.normalizer:
            return set(cores)
        after = self.tokenizer.normalizer.normalize_str(" ".join(cores)).split(" ")
        return {core for core, a in zip(cores, after, strict=True) if a.isalpha()} if len(after) == len(cores) else set()

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that aren't known yet; they are known from now on."""
        known = self.known
        if self.ends is None or not words:
            self._apart(words)
            return [known[w] for w in words]
        lower = " ".join(words).encode().lower().decode().split(" ") if self.lowers else words  # A-Z alone
        cores = [w.rstrip(_MARKS) for w in lower] if self.parts_marks else list(lower)
        marks = [w[len(core) :] for w, core in zip(lower, cores, strict=True)]
        stay = self._stay_letters([core for core, m in zip(cores, marks, strict=True) if m and not core.isascii() and core.isalpha()])
        for n, core in enumerate(cores):
            if not core.isalpha() or marks[n] and not core.isascii() and core not in stay:
                cores[n], marks[n] = "", words[n]  # by itself
        self._apart([m for m in {"", *marks} if m not in known])
        plain = [w for w in set(cores) if w not in known]
        groups = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                self._apart(group)
                continue
            raw, size = ids.tobytes(), ids.itemsize
            known.update(zip(group, [raw[a * size : b * size] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        out = [known[core] + known[m] for core, m in zip(cores, marks, strict=True)]
        known.update(zip(words, out, strict=True))
        return out

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        raw = [t.encode() for t in texts]
        line = b" ".join([*raw, b""]).replace(b"\n", b" ")
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == ord(" ")) + 1  # of the words, each with the space behind it
        cuts = np.concatenate([np.zeros(1, np.int64), ends])
        words = pa.Array.from_buffers(pa.large_utf8(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(line)]).dictionary_encode()
        distinct = str(words.dictionary.buffers()[2], "utf-8").split(" ")[:-1]  # Python strings at once, not one by one
        got = list(map(self.known.get, distinct))
        new = [n for n, ids in enumerate(got) if ids is None]
        if new and len(self.known) + len(new) > _CACHE_WORDS:
            self.known = {w: ids for w, ids in zip(distinct, got, strict=True) if ids is not None}
        for n, ids in zip(new, self._learn([distinct[n] for n in new]), strict=True):
            got[n] = ids
        ids = pa.array(got, pa.large_binary()).take(words.indices)
        found, places = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64)
        after = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw])) + 1  # words up to the end of each text
        at = 0
        for to in places[after].tolist():
            yield bytes(found[at:to])
            at = to

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        held, chars = [], 0
        for t in texts:
            held.append(t)
            chars += len(t)
            if chars >= _TOGETHER:
                yield from self._together(held)
                held, chars = [], 0
        if held:
            yield from self._together(held)


def _check(tokenizer) -> None:
    """Refuses a tokenizer for which a text's ids aren't those of its words one after the other."""
    for text in ("one two", " one", "one ", "one  two", "one\ntwo\n", "Don't stop, now!", "été 漢字 12 34.5", "it 's a b"):
        apart = [i for w in text.replace("\n", " ").split(" ") for i in tokenizer.encode(w, add_special_tokens=False).ids]
        if apart != tokenizer.encode(text, add_special_tokens=False).ids:
            raise ValueError(f"white space doesn't part this tokenizer's words: {text!r}")


def _borders(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, tie) at which shards after the first begin."""
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", "tie", F.coalesce(F.length("text"), F.lit(0)).alias("size")), "sizes")
    n, chars = sizes.agg(F.count("*"), F.sum("size")).first()
    total = (chars or 0) * _ID_BYTES * width / 2 + n * width
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / LEAST_BYTES))
    shards = max(1, few, math.ceil(total / SHARD_BYTES))
    wanted = SAMPLE + SHARD_ROWS * shards
    some = sizes if n <= wanted else sizes.sample(fraction=wanted / n, seed=1)
    got = some.toArrow()  # about `wanted` rows of three numbers
    forget(sizes)
    ids, ties, mass = (got[c].to_numpy() for c in ("doc_id", "tie", "size"))
    by = np.lexsort((ties, ids))
    ids, ties, reached = ids[by], ties[by], np.cumsum(mass[by] + 10.0)
    cuts = np.unique(np.searchsorted(reached, [reached[-1] * i / shards for i in range(1, shards)])) if len(ids) else np.zeros(0, int)
    cuts = cuts[cuts > 0]
    new = [i for i, c in enumerate(cuts) if not i or (ids[c], ties[c]) != (ids[cuts[i - 1]], ties[cuts[i - 1]])]
    return ids[cuts[new]], ties[cuts[new]]


def _shard_of(ids: np.ndarray, ties: np.ndarray, borders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many borders are not above each (id, tie)."""
    low, high = np.searchsorted(borders[0], ids, "left"), np.searchsorted(borders[0], ids, "right")
    out = high.copy()
    for i in np.flatnonzero(high > low):  # identifiers at a border
        out[i] = low[i] + np.searchsorted(borders[1][low[i] : high[i]], ties[i], "right")
    return out


def _encode_rows(tokenizer, width: int, end_id: int | None, borders) -> Callable:
    tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer.value, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [v + tail for v in encoder(t or "" for t in values(part.column(2)))]
                shard = _shard_of(part.column(0).to_numpy(), part.column(1).to_numpy(), borders.value)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), part.column(1), pa.array(found, pa.binary())], names=["shard", "doc_id", "tie", "value"])

    return run


def _shard_rows(width: int) -> Callable:
    """Rows (shard, doc_id, value) in order -> lines of each shard, and its statistics as a line of another kind."""
    names = ["kind", "shard", "line", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, n = None, Builder(width), 0

        def rows(kind: str, lines: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            n += len(lines)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(lines)), pa.array([at] * len(lines), pa.int32()), pa.array(range(n - len(lines), n), pa.int32()), pa.array(lines, pa.binary())], names=names)

        def done() -> Iterator[pa.RecordBatch]:
            if made.entries:
                yield rows("data", made.finish())
                told = {"first": id_of(made.first), "last": id_of(made.last_key), "entries": made.entries, "ids": made.n_ids}
                yield rows("stats", [json.dumps(told).encode()])

        for batch in batches:
            for shard, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != at:
                    yield from done()
                    at, made, n = shard, Builder(width), 0
                lines = made.add(doc_id, value.as_py())
                if lines:
                    yield rows("data", lines)
        yield from done()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text to shards below `path`, in ascending order of identifier, and their manifest.

    tokenizer_path: a file of the tokenizers library whose words white space parts. end_id is appended to each document.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer)
    _check(made)
    size = max(made.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    width = 2 if size <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(tokenizer)  # a vocabulary: it doesn't grow with the corpus
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")).filter("doc_id is not null")
    borders = _borders(docs, width)
    held = spark.sparkContext.broadcast(borders)  # two numbers a shard
    ids = docs.mapInArrow(tidy(_encode_rows(shared, width, end_id, held)), "shard int, doc_id bigint, tie bigint, value binary")
    ids = ids.repartitionById(len(borders[0]) + 1, "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "doc_id", "value")
    lines = ids.mapInArrow(tidy(_shard_rows(width)), "kind string, shard int, line int, content binary").sortWithinPartitions("kind", "shard", "line")
    lines = lines.select(F.col("content").cast("string").alias("content"), "kind", "shard")
    lines.write.partitionBy("kind", "shard").option("lineSep", MAGIC.decode()).text(f"{path}/tables")
    stats = F.from_json("value", "first long, last long, entries long, ids long")
    told = _lines(spark, path, "stats").select("shard", stats.alias("s")).select("shard", "s.*")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    told.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """value, shard: lines of the shards' files."""
    found = spark.read.option("lineSep", MAGIC.decode()).text(f"{path}/tables")
    if "kind" not in found.columns:  # no files
        return found.select("value", F.lit(0).alias("shard")).limit(0)
    return found.filter(F.col("kind") == kind).select("value", F.col("shard").cast("int").alias("shard"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, first, last, entries, ids, base (ids of all shards before): a row a shard."""
    return spark.read.schema("shard int, first long, last long, entries long, ids long, base long").parquet(f"{path}/manifest")


def _data(spark: SparkSession, path: str) -> DataFrame:
    """shard, line, without the last line of each file, which is no data."""
    return _lines(spark, path, "data").select("shard", F.col("value").cast("binary").alias("line"))


def _is_data(line: bytes) -> bool:
    return line[-2] == line[-1]  # the kind is 0


def _read_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            line = raw.as_py()
            if not _is_data(line):
                continue
            docs, sizes, sums = [], [], []
            before, entries = read_line(line)
            for doc_id, value in entries:
                ids = np.frombuffer(value, f"<u{width}")
                docs.append(doc_id)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            n = np.array(sizes, np.int64)
            cols = [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])


def _width(spark: SparkSession, path: str) -> int:
    """Bytes of an id, from the footer of some shard."""
    one = manifest(spark, path).select("shard").first()
    return open_table(spark, path, one.shard).width if one else 2


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files."""
    width = _width(spark, path)
    rows = _data(spark, path).mapInArrow(tidy(lambda batches: _read_rows(batches, width)), "shard int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    joined = rows.join(manifest(spark, path).select("shard", "base"), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<int> of each document, from the files."""
    width = _width(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                line = raw.as_py()
                got = list(read_line(line)[1]) if _is_data(line) else []
                ids = [np.frombuffer(v, f"<u{width}").astype(np.int32) for _, v in got]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _data(spark, path).mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def open_table(spark: SparkSession, path: str, shard: int) -> Table:
    """A shard whose bytes are read where they are asked for."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/tables/kind=data/shard={shard}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    status = next(s for s in store.listStatus(folder) if s.getPath().getName().startswith("part-"))

    def read(at: int, n: int) -> bytes:
        stream = store.open(status.getPath())
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    return Table(read, status.getLen())


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id, ids of the wanted documents (a short list) that are there: by manifest, filter, index and block."""
    asked = F.array(*(F.lit(int(w)).cast("long") for w in wanted))
    near = manifest(spark, path).filter(F.exists(asked, lambda w: (w >= F.col("first")) & (w <= F.col("last")))) if wanted else manifest(spark, path).limit(0)
    got: dict[int, np.ndarray] = {}
    for row in near.orderBy("shard").collect():  # the shards that may hold one of them
        table = open_table(spark, path, row.shard)
        for w in wanted:
            if w not in got and row.first <= w <= row.last and (ids := table.get(w)) is not None:
                got[w] = ids
    return spark.createDataFrame([(int(w), [int(i) for i in ids]) for w, ids in got.items()], "doc_id bigint, ids array<int>")
