import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def words(n, seed):
    """n words by a small generator of its own."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 128 % 97))
    return out


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every odd kind: null, empty, blank, short, repeated, long, several scripts."""
    long = " ".join(words(30_000, 5))
    base = " ".join(words(120, 1))
    return [
        (0, base), (1, base), (2, base + " tail"), (3, None), (4, ""), (5, " \n\t "), (6, "One"), (7, "one TWO three"), (8, "ÉTÉ été 漢字 🙂 'll don't  x"),
        (9, long), (10, long + " end"), (11, "a@b.co and +1 (234) 567-8901 or 4539 1488 0343 6467 at 10.0.0.255"), (12, "x" * 50_000), (13, "1." * 20_000), (14, "7" * 30_000), (15, "one TWO three"),
    ]


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture
def documents(spark, odd_texts):
    """The odd texts as documents, rows with null identifiers and repeated rows among them."""
    sources = ["b", "a", None, "a", "é"]
    rows = [(i, t, sources[i % 5], "en", len(t or "")) for i, t in odd_texts]
    rows += [(None, "nobody", "a", None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
