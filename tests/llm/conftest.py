import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside, to see that none clashes.
CLASHING = ["score", "predicted", "kept", "keep_id", "key", "digest", "slot", "length", "piece", "kind", "rate", "copies", "_slot", "_text", "lang_pred"]


@pytest.fixture(scope="session")
def corpus(spark):
    """A table of (id, text) pairs with the columns of ``documents`` and many more."""
    def build(rows, langs=None):
        from pyspark.sql import functions as F

        data = [(i, t, (langs or {}).get(i), None, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, SCHEMA)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empties, ties, copies, odd signs, a long text."""
    sentence = "the quick brown fox jumps over the lazy dog while seven old owls watch from a tall tree"
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, sentence), (5, sentence.replace(" ", "  ")), (6, sentence), (7, sentence + " today"), (8, "a b"), (9, "A  b"),
        (10, "é ü ß 漢字 \U0001f600   x"), (11, (sentence + "\n") * 40), (12, "word " * 30_000), (13, "1" * 5_000), (14, "!" * 5_000), (15, "<|endoftext|> x<|endoftext|>"),
        (16, sentence.upper()), (17, "mail a.b@c.de, call +1 (988) 555-2485, ip 10.0.0.255 and 999.1.1.1, card 4111 1111 1111 1111"), (18, "x" * 300_000),
    ]
