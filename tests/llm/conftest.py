import random

import pytest

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with all columns and one more whose name clashes."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        return df.selectExpr("*", "'x' AS name", "1 AS key", "2 AS component")

    return build


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank and one-word texts, repeats, a null id's text, one very long text, odd bytes."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    near = [*base]
    near[60] = "changed"
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "Word"), (6, "two words"), (7, " ".join(base)), (8, " ".join(near)), (9, "\n".join(base)),
        (10, " ".join(base)), (11, long), (12, long + " more"), (13, "naïve 漢字 \u00a0 \x1c <|endoftext|> 'tis 12³"), (14, "a" * 3000), (15, None), (16, "two words"),
    ]
