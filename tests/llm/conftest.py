import os
import random

import pytest

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of a caller's own, with names that operators use inside.
EXTRA = (
    "size", "hash", "row", "kept", "run", "digest", "score", "id", "root", "a", "b", "n", "y", "h", "p", "rep_id", "copies", "node", "block", "piece", "rank", "s", "target",
    "slice", "bits", "found", "mark", "kept_id", "kept_mark", "salt", "mix_source", "mix_whole", "mix_bound", "mix_copy", "__hash", "__copy", "__slice", "__id", "__found", "length", "base", "at", "part", "task",
)


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=False, parts=3):
        full = [(i, t, lang, src, len(t or "")) for i, t, lang, src in (r if len(r) == 4 else (*r, "en", "a") for r in rows)]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        return df.selectExpr("*", *(f"'x' as `{c}`" for c in EXTRA)) if extra else df

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns of the caller's own."""
    draw = random.Random(1)
    long = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", None), (None, "one two", None, "b"), (None, None, None, None),
        (5, long, "en", "b"), (6, "one two three four five six seven eight nine ten eleven", "en", "a"), (6, "one two three four five six seven eight nine ten eleven", "en", "a"), (7, "!!!", "en", "c"),
        (8, "naïve  café\n漢字 <|endoftext|> \x85 end", "fr", "c"), (9, "one  two\tthree four five six seven eight nine ten eleven", "en", "b"), (10, "x", "en", "b"), (11, "y", "en", "b"),
    ]
    return make(rows, extra=True)


@pytest.fixture(scope="session")
def none(make):
    return make([])
