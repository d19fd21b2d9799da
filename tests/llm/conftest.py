import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, signature int, __gone int, group_id string, shard string, token_ids string, probability string, copy int, bucket string"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


LONG = " ".join(f"word{k % 977} goes on and, {k}" for k in range(60_000))  # over a million characters
PROSE = "The committee met again in spring and agreed, after some debate, on the plan for the harbour and its two bridges."
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE), (None, None), (6, LONG), (7, "a"), (8, "\x00� \U0001f600 é́ ‮ x"), (9, "9" * 5000), (-10, PROSE + " It was late."), (11, "x"), (12, "x"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns named like those that operators add."""
    rows = [(i, t, None, None, None if t is None else len(t), "k", 1, 2, "g", "s", None, "p", 3, "b") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
