"""Every operator over nulls, empty and long texts, repeated rows, clashing columns, and empty tables."""

import pytest

from strandline.llm import decontam, dedup, langid, licenses, packing, quality, secret_scan, sharding, tokencount
from tests.llm.conftest import SCHEMA, edge_rows

N = len(edge_rows())
BENCH = [(1, "some benchmark question about nothing at all"), (2, None), (None, ""), (3, "two")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "op2": lambda d: dedup.near_duplicates(d),
    "op4": lambda d: sharding.shards(d, 3),
    "op5": lambda d: quality.quality_report(d),
    "op6": lambda d: licenses.license_scan(d),
    "op7": lambda d: langid.identify(d),
    "op8": lambda d: tokencount.token_counts(d),
    "op9": lambda d: secret_scan.secret_digest(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(edges, nothing, name):
    got = PER_ROW[name](edges).toPandas()
    assert len(got) == N and got["doc_id"].isna().sum() == 2
    assert len(PER_ROW[name](nothing).toPandas()) == 0


def test_values(edges):
    d = dedup.near_duplicates(edges).toPandas()
    none = d[d["doc_id"].isna()].sort_values("n_shingles")
    assert none["n_shingles"].tolist() == [0, 6] and none["component_id"].isna().all()
    by = d[d["doc_id"] == 7].iloc[0]
    assert (by["component_id"], by["kept"]) == (6, False)
    assert d[d["doc_id"] == 2].iloc[0][["n_shingles", "component_id", "kept"]].tolist() == [0, 2, True]
    assert d[d["doc_id"] == 4].iloc[0]["n_shingles"] == 1 and d[d["doc_id"].isna()]["kept"].all()
    s = sharding.shards(edges, 3).toPandas()
    assert sorted(s["slot"][s["shard"] == 0]) == list(range((s["shard"] == 0).sum())) and s[s["doc_id"] == 1].iloc[0][["size", "text_crc32"]].tolist() == [16, 0]
    t = tokencount.token_counts(edges).toPandas()
    assert t[t["doc_id"] == 1].iloc[0][["n_bytes", "n_tokens"]].tolist() == [0, 0]
    lang = langid.identify(edges).toPandas()
    assert set(lang[lang["doc_id"].isin([1, 2, 3, 12, 13])]["lang_pred"]) == {"und"} and lang["score"].between(0, 1).all()
    q = quality.quality_report(edges).toPandas()
    assert q[q["doc_id"] == 1].iloc[0][["n_words", "base_failed", "kept"]].tolist() == [0, True, False]
    assert q[q["doc_id"] == 8].iloc[0]["n_repeat_words"] == 45_000


def test_packing(edges, nothing):
    parts = packing.placements(packing.best_fit_bins(edges)).toPandas()
    assert (parts["piece"] == 0).sum() == N and parts["doc_id"].isna().sum() == 2
    assert len(packing.best_fit_bins(nothing).toPandas()) == 0


def test_slices():
    import pyarrow as pa

    from strandline.llm import common

    sizes = [3, common.SUB_BYTES + 5, 10, None, *[common.SUB_BYTES // 3] * 7, *[1] * 600]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None if n is None else "x" * n for n in sizes])})
    parts = [p.column("text").to_pylist() for p in common.slices(batch)]
    assert [x for p in parts for x in p] == batch.column("text").to_pylist()
    assert all(len(p) <= common.SUB_BATCH and (len(p) == 1 or sum(len(x or "") for x in p) <= common.SUB_BYTES) for p in parts)


def test_decontamination(spark, edges, nothing):
    assert len(decontam.contaminated(edges, bench(spark)).toPandas()) == 0
    assert len(decontam.contaminated(nothing, bench(spark)).toPandas()) == 0
    assert len(decontam.contaminated(edges, bench(spark, [])).toPandas()) == 0
    assert decontam.decontaminate(edges, bench(spark)).count() == N
    own = bench(spark, [(5, "same text in two rows")])
    assert sorted(decontam.contaminated(edges, own).toPandas()["doc_id"]) == [6, 6, 7]
    left = decontam.decontaminate(edges, own)
    assert left.count() == N - 3 and left.columns == edges.columns


def test_filters_keep_columns(edges, nothing):
    for f in (quality.quality_filter, dedup.drop_near_duplicates, secret_scan.redact):
        assert f(edges).columns == edges.columns
        assert f(nothing).count() == 0 and [x.split(" ")[0] for x in SCHEMA.split(", ")] == f(nothing).columns
    left = dedup.drop_near_duplicates(edges)
    assert left.where("doc_id = 7").count() == 0 and left.where("doc_id is null").count() == 2
    # of two equal rows under one id one stays, and the other text under that id
    assert sorted(r["text"] for r in left.where("doc_id = 6").collect()) == ["another text under a repeated id", "same text in two rows"]


def test_one_of_each_group_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text.replace("w3 ", "v3 "), " ".join(f"u{i}" for i in range(80))
    rows = [(None, text), (None, text), (None, near), (None, other), (None, other + " x"), (4, "only one"), (4, "only one"), (5, other + " y"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in dedup.drop_near_duplicates(docs).collect()]
    assert sorted(t for d, t in left if d is None and t) in ([text], [near]) and (5, other + " y") in left
    assert left.count((4, "only one")) == 1 and len(left) == 5
    got = dedup.near_duplicates(docs, dedup.Setting(5, 80)).toPandas()
    assert set(got[got["n_shingles"] == 76]["component_id"].dropna()) <= {5} and got["component_id"].isna().sum() == 5
