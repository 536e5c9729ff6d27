import pytest

SMALL = "/root/testdata/sf0.001"
CLASH = ["h", "sha", "kept", "group_size", "norm", "shard", "slot", "part", "fp", "label", "key", "dk", "pos",
         "hash", "held_out", "old", "size", "words", "count", "__h", "__dk", "name", "blocks", "old_no"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def frame(spark, rows):
    """(doc_id, text) rows with further columns whose names the operators use too."""
    more = (None, "src", 3) + tuple("x" for _ in CLASH)
    return spark.createDataFrame([(i, t) + more for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} Alpha{i % 31}" for i in range(60_000))
    rows = [(1, "Hello World, this is one text"), (2, "hello world, this is one text"), (3, None), (4, ""),
            (None, "HELLO world, this is one text"), (None, None), (5, long), (6, long + " end"), (7, " \t\n"),
            (7, " \t\n"), (8, "É vu É"), (9, "é vu é"), (10, "same row"), (10, "same row"), (10, "other text, same id"),
            (None, "only null ids here"), (None, "only null ids here"), (11, "a"), (12, "a b"), (13, "x" * 5000)]
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
