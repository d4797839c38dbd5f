"""Each pipeline stage against a plain version on its own input."""

import corpus_pipeline
from strandline.llm import dedup, quality, secret_scan, tokencount
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]

    first = stage["quality_rules"](spark, docs, SMALL)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == {d for d, k in verdict.items() if k}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and verdict.get(d) is not None]
    assert sum(verdict[d] for d in good) > 0.85 * len(good)

    second = stage["near_duplicates"](spark, first, SMALL)
    parts = brute_components([(r["doc_id"], r["text"]) for r in first.collect()], dedup.STAGE)
    assert {r["doc_id"] for r in second.collect()} == set(parts.values())

    third = stage["decontamination"](spark, second, SMALL)
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect() if not any(b in r["text"] for b in bench)}

    fourth = stage["secret_scan"](spark, third, SMALL)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    scanner = secret_scan.Scanner(secret_scan.RULES)
    assert scanner.scan([r["text"].encode() for r in fourth.collect()]) == {}

    fifth = stage["packing"](spark, fourth, SMALL).collect()
    sp = tokencount.encoder(tokencount.default_model_path(), 1 << 30, 1).sp
    want = {r["doc_id"]: [*sp.encode(r["text"]), sp.eos_id()] for r in fourth.collect()}
    found = {}
    for b in fifth:
        for doc, start, a, e in zip(b["doc_ids"], b["starts"], b["offsets"], [*b["offsets"][1:], b["bin_used"]]):
            found.setdefault(doc, []).append((start, b["tokens"][a:e]))
    assert {d: [t for _, part in sorted(x) for t in part] for d, x in found.items()} == want


def test_run(spark):
    a = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(a) and set(a["bin_length"]) <= {1024, 2048, 4096, 8192, 16384}


def test_run_over_edges_and_nothing(spark, edges, nothing, tmp_path):
    for name, rows in (("edges", edges), ("nothing", nothing)):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "some benchmark question about nothing at all"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {d for b in got for d in b["doc_ids"]} <= {8} and (name == "edges" or not got)
