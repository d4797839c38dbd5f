import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 9000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, part int, came long, row_key long, component_id long, n long, h long, label string, kept boolean, bands array<long>"


def edge_rows():
    texts = [
        (None, "a null id with words of its own"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "same text in two rows"), (6, "same text in two rows"),
        (7, "same text in two rows"), (6, "another text under a repeated id"), (8, LONG), (9, "x" * 50_000), (10, "émigré ÉCOLE 漢字 🙂\u2028 \x0b\x0c end"), (11, "\x00\x01 control"), (12, "!!! ... ???"), (None, None), (13, "1 2 3 4 5 6 7 8 9"),
    ]
    return [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 3 == 0 else "s", len(t) if t else None, 7, 8, 9, 1, 2, 3, 4, 5, "z", True, [1]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and further columns named as the operators name theirs."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", F.lit(1).alias("extra"))
