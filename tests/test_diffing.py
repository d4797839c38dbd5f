"""Pairing of two annotations against a plain version, feature by feature."""

import random
import time

import pytest

from strandline.operators import diffing

SCHEMA = "genome string, idx long, record_id string, start long, end long, strand int, locus_tag string, protein_id string, gene string, product string, translation string, kos array<string>, ecs array<string>"


def overlap(a, b):
    if (a["record_id"], a["strand"]) != (b["record_id"], b["strand"]):
        return 0.0
    shared = max(0, min(a["end"], b["end"]) - max(a["start"], b["start"]) + 1)
    return min(shared / max(1, a["end"] - a["start"] + 1), shared / max(1, b["end"] - b["start"] + 1))


def plain_pairs(old, new):
    out, free_old, free_new = [], sorted(old, key=lambda r: r["idx"]), sorted(new, key=lambda r: r["idx"])

    def take(tier, choose):
        for a in list(free_old):
            got = choose(a)
            if got is not None:
                out.append((a["genome"], a["idx"], got["idx"], tier))
                free_old.remove(a)
                free_new.remove(got)

    def best(rows, a):
        return max(rows, key=lambda b: (overlap(a, b), -b["idx"]), default=None)

    for key in ("locus_tag", "protein_id"):
        take(key, lambda a: best([b for b in free_new if b[key] == a[key]], a) if a[key] else None)  # noqa: B023
    take("coordinate_overlap", lambda a: best([b for b in free_new if overlap(a, b) >= diffing.OVERLAP], a))
    take("translation_hash", lambda a: next((b for b in free_new if a["translation"].strip() and b["translation"].strip() == a["translation"].strip()), None))
    return out


def some(rng, n, genome, tags, proteins, texts, width):
    rows = []
    for i in range(n):
        start = rng.randint(1, width)
        rows.append({
            "genome": genome, "idx": i * 3 + 1, "record_id": rng.choice(["r1", "r2"]), "start": start, "end": start + rng.choice([0, 5, 9, 10, 11, 40]), "strand": rng.choice([1, -1, None]), "locus_tag": rng.choice(["", *tags]),
            "protein_id": rng.choice(["", *proteins]), "gene": rng.choice(["", "g"]), "product": rng.choice(["p", "q "]), "translation": rng.choice(["", " ", *texts]), "kos": rng.choice([[], ["K1"]]), "ecs": [],
        })
    return rows


@pytest.mark.parametrize("name, tags, proteins, texts", [("tags", [f"t{i}" for i in range(40)], [], []), ("proteins", [], [f"w{i}" for i in range(40)], []), ("overlap", [], [], []), ("translations", [], [], list("MNOP")), ("all", ["t1", "t2"], ["w1", "w2", "w3"], ["M", "N"])])
def test_pairs_brute_force(spark, name, tags, proteins, texts):
    rng = random.Random(name)
    old, new = [], []
    for genome in ("a", "b"):
        old += some(rng, 300, genome, tags, proteins, texts, 900)
        new += some(rng, 280, genome, tags, proteins, texts, 900)
    want = [p for g in ("a", "b") for p in plain_pairs([r for r in old if r["genome"] == g], [r for r in new if r["genome"] == g])]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = diffing.pair_features(frame(old), frame(new))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    changes = diffing.classify(frame(old), frame(new), got).collect()
    assert len(changes) == len(want) + (len(old) - len(want)) + (len(new) - len(want))
    assert len({(r["genome"], *r["ord"]) for r in changes}) == len(changes)


def test_one_tag_for_all(spark):
    """3,000 features under one tag on both sides: no pairs of them are made."""
    row = lambda i, at: ("", i, "r", at, at + 90, 1, "same", "", "", "p", "", [], [])
    old, new = [row(i, 100 * i) for i in range(3000)], [row(i, 100 * (2999 - i) + 5) for i in range(3000)]
    began = time.time()
    got = {(r["old_idx"], r["new_idx"]) for r in diffing.pair_features(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()}
    assert got == {(i, 2999 - i) for i in range(3000)}
    assert time.time() - began < 60
    assert diffing.greedy([(i, "r", 1, 5, 9) for i in range(3000)], [(i, "r", 1, 5, 9) for i in range(3000)], 0.8) == [(i, i) for i in range(3000)]


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], SCHEMA)
    some_ = spark.createDataFrame([("", 1, "r", 1, 9, 1, "t", "", "", "", "", None, None)], SCHEMA)
    assert diffing.pair_features(none, none).count() == 0
    changes = diffing.classify(some_, none, diffing.pair_features(some_, none))
    assert [r["classes"] for r in changes.collect()] == [["removed"]] and diffing.diff_counts(some_, none, changes).first()["new_cds_count"] == 0


def test_one_keys_rows_are_dealt_for_the_pairing(spark):
    """The join before the pairing deals by the same key. Its shuffle may be read by mapper once it is a broadcast join, so
    it can't stand for the pairing's own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("", i, "r", 1, 9, 1, f"t{i % 3}", "", "", "p", "", [], []) for i in range(9)], SCHEMA)
        plan = diffing.by_key(df, df, "locus_tag")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_COL" in plan
