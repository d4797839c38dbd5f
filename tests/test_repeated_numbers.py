"""Features that repeat a number, as tables that were put together from several may have."""

from strandline.operators import diffing, search
from tests.test_diffing import SCHEMA


def row(idx, record, tag="t", text="M", start=5):
    return ("", idx, record, start, start + 89, 1, tag, "", "g", "p", text, [], [])


def test_a_number_is_paired_once(spark):
    rows = [row(1, "a"), row(1, "b"), row(2, "a", start=500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["old_idx"], r["new_idx"]) for r in diffing.by_key(df, df, "locus_tag").collect())
    assert got == [(1, 1), (2, 2)]


def test_classify_one_row_for_each(spark):
    df = spark.createDataFrame([row(1, "a"), row(1, "b"), row(2, "a", start=500)], SCHEMA)
    fewer = spark.createDataFrame([row(1, "a"), row(1, "b")], SCHEMA)
    tier = lambda a, b: diffing.by_translation(a, b).selectExpr("*", "'translation_hash' AS tier")
    counts = lambda a, b: {r["classification"]: r["n"] for r in diffing.class_counts(diffing.classify(a, b, tier(a, b))).collect()}
    assert counts(df, df) == {"unchanged": 3}
    assert counts(df, fewer) == {"unchanged": 2, "removed": 1}
    assert counts(fewer, df) == {"unchanged": 2, "added": 1}


def test_places_of_one_number_by_record(spark):
    rows = [("f", "t", "CDS", r, i, 7, 5, 9, 1) for r, i in (("C10", 10), ("C9", 9), ("C100", 100))]
    df = spark.createDataFrame(rows, "path string, locus_tag string, type string, record_id string, record_index int, feature_index long, start long, end long, strand int")
    assert search.locus_duplicates(df).first()["places"] == "C9:5..9(+), C10:5..9(+), C100:5..9(+)"
