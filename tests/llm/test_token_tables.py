import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from storyloom.llm import token_tables as tt

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_files_hold_what_the_library_gives(documents, plain, tmp_path):
    path = f"file://{tmp_path}/t"
    tt.write(documents, path, PATH, end_id=2)
    spark = documents.sparkSession
    rows = sorted(tt.read_summary(spark, path).collect(), key=lambda r: r.start)
    docs = sorted(((r.doc_id, r.text or "") for r in documents.collect() if r.doc_id is not None), key=lambda x: x[0])
    assert [r.doc_id for r in rows] == [i for i, _ in docs]
    at = 0
    for r, (_, text) in zip(rows, docs, strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: list(r.ids) for r in tt.read_ids(spark, path).collect()}[7] == plain.encode("one TWO three", add_special_tokens=False).ids + [2]
    assert sorted(r.doc_id for r in tt.lookup(spark, path, [8, 9, 999, -1]).collect()) == [8, 9]


def test_shards_manifest_and_lookup(spark, tmp_path, plain, monkeypatch):
    """Many shards, an identifier that a third of the rows have, clashing columns; a lookup opens one file."""
    monkeypatch.setattr(tt, "LEAST_BYTES", 2000)
    monkeypatch.setattr(tt, "SHARD_BYTES", 4000)
    monkeypatch.setattr(tt, "LINE_BYTES", 300)
    monkeypatch.setattr(tt, "BLOCK_BYTES", 100)
    rows = [(i if i % 3 else 300, f"word{i} two three " * (i % 9), "x", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string, shard int").repartition(5)
    path = f"file://{tmp_path}/t"
    tt.write(docs, path, PATH, end_id=2)
    shards = tt.manifest(spark, path).orderBy("shard").collect()
    assert len(shards) > 4 and sum(r.entries for r in shards) == 1200 and all(a.last <= b.first for a, b in zip(shards, shards[1:], strict=False))
    got = sorted(tt.read_summary(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    sums = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((i, sums(plain.encode(t, add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    opened = []
    whole = tt.open_table
    monkeypatch.setattr(tt, "open_table", lambda s, p, n: opened.append(n) or whole(s, p, n))
    found = tt.lookup(spark, path, [700]).collect()
    assert len(opened) == 1 and [list(r.ids) for r in found] == [plain.encode(dict((i, t) for i, t, *_ in rows)[700], add_special_tokens=False).ids + [2]]
    assert tt.lookup(spark, path, [2000, -1]).collect() == [] and len(opened) == 1 and tt.lookup(spark, path, []).collect() == []


def test_a_line_never_holds_its_end():
    for line in (b"", b"ab" + tt.MAGIC + b"c", tt.MAGIC * 3, tt.MAGIC[:7], b"x" + tt.MAGIC[:1]):
        out, mask = tt._safe(line)
        assert (out + tt.MAGIC).find(tt.MAGIC) == len(out) and tt._masked(out[:-1], mask) == line


def test_other_tokenizers_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        tt.write(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))


def test_empty_table(no_documents, tmp_path):
    path = f"file://{tmp_path}/t"
    tt.write(no_documents, path, PATH)
    assert tt.read_summary(no_documents.sparkSession, path).collect() == []


def test_table_lookup_filter_and_prefixes():
    rng = random.Random(3)
    ids = sorted({rng.randrange(-(10**12), 10**12) for _ in range(3000)})
    entries = [(i, np.arange(rng.randrange(0, 90), dtype="<u2").tobytes()) for i in ids]
    table = tt.Table(tt.build(entries, 2) + tt.MAGIC)
    assert list(table) == entries and table.entries == len(ids) and len(table._blocks) > 1
    assert table.n_ids == sum(len(v) // 2 for _, v in entries)
    for i, v in entries[::37]:
        assert table.get(i).tobytes() == v
    absent = [i + 1 for i in ids[::5] if i + 1 not in set(ids)]
    assert all(table.get(i) is None for i in absent)
    assert sum(table.may_hold(i) for i in absent) < 0.05 * len(absent)


def test_keys_sort_as_numbers():
    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    assert sorted(map(tt.key_of, ids)) == [tt.key_of(i) for i in ids] and [tt.id_of(tt.key_of(i)) for i in ids] == ids


def test_encoder_is_the_library_on_odd_letters(plain):
    rng = random.Random(1)
    letters = ["a", "B", "é", "́", "İ", "Σ", "ΟΔΟΣ", " ", "\n", "\t", " ", "1", "'s", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "漢字", "ᄒ", "ᅡ", "🙂", "²", "ẞ", "_", "\r\n", "ﬁ", "ǅ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    encoder = tt._Encoder(open(PATH, encoding="utf-8").read(), 2)
    for text, got in zip(texts, encoder(iter(texts)), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cases_and_marks_of_a_word_are_encoded_once(plain):
    """A word in other cases of A-Z or with marks behind it isn't given to the tokenizer again; ids are the library's."""

    class Counted:
        seen = 0

        def __init__(self, whole):
            self.whole = whole

        def __getattr__(self, name):
            return getattr(self.whole, name)

        def encode_batch_fast(self, texts, **how):
            Counted.seen += sum(map(len, texts))
            return self.whole.encode_batch_fast(texts, **how)

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdeéñ") for _ in range(8)) for _ in range(500)})
    forms = [w for word in words for w in (word, word.capitalize() if word[0].isascii() else word, word + ".", word + "$$$", word + ",***", f"{word}!!")]
    texts = [" ".join(rng.sample(forms, 300)) for _ in range(40)]
    encoder = tt._Encoder(open(PATH, encoding="utf-8").read(), 2)
    encoder.tokenizer = Counted(encoder.tokenizer)
    for text, got in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert Counted.seen < 1.3 * sum(len(w) + 1 for w in words)


def test_encoder_is_the_library_where_case_and_marks_matter(plain):
    """Letters that compose in one case only, letters that normalizing takes apart, added tokens, endings behind an apostrophe."""
    middles = ("", "\u0331", "\u0308", "\u030c", "\u0130", "\u212a", "\u03a3", "\u0958", "\ufb1d", "'", "'S", "<|endoftext|>", "<|ENDOFTEXT|>")
    texts = [w + c + m for c in middles for w in ("H", "WT", "j", "Él", "") for m in ("", ".", "$$$", ',"', "|>", "\t", "\u2028", "\x1c")]
    texts += ["", " ", "\n", "a  b\n", "", " a", "x" * 5000 + ".", " ".join(texts)]
    encoder = tt._Encoder(open(PATH, encoding="utf-8").read(), 2)
    for text, got in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)
    assert list(encoder([])) == []


def test_words_are_forgotten_and_learned_again(plain, monkeypatch):
    monkeypatch.setattr(tt, "_CACHE_WORDS", 50)
    monkeypatch.setattr(tt, "_TOGETHER", 200)
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('aBc')}{chr(97 + rng.randrange(26))}{rng.choice(['', '.', '&&&'])}" for _ in range(20)) for _ in range(100)]
    encoder = tt._Encoder(open(PATH, encoding="utf-8").read(), 2)
    for text, got in zip(texts, encoder(iter(texts)), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("cased", [False, True])
@pytest.mark.parametrize("parted", [False, True])
def test_encoder_keeps_case_and_marks_together_where_the_tokenizer_does(cased, parted):
    made = json.load(open(PATH, encoding="utf-8"))
    if cased:
        made["normalizer"] = None
    if not parted:
        made["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, made["pre_tokenizer"]["pretokenizers"][-1]]}
    whole, encoder = Tokenizer.from_str(json.dumps(made)), tt._Encoder(json.dumps(made), 2)
    assert (encoder.lowers, encoder.parts_marks) == (not cased, parted)
    texts = ["One two. TWO ONE, (one) two$$$ one", "two. Two 12 it's\n\nÉté. été", "", "one. two one", "H\u0958. ẖ H\u0331."]
    for _ in range(2):  # learned, then known
        for text, got in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)
