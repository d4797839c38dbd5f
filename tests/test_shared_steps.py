"""Steps that several queries over genomes share: each does its work once."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence
from strandline.operators import codon_usage, intervals, validation
from strandline.plans import genome_queries, genomes, queries, views
from strandline.sources import flatfile
from strandline.sources.scratch import Scratch
from tests.conftest import SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 7, 4 << 20])
def test_proteins_as_translate(spark, monkeypatch, most):
    monkeypatch.setattr(sequence, "MOST_BASES", most)
    texts = ["ATGGCNTAARAYZZ", "", "AT", "augGCCuga", "CTNYTARAYSAR", "AÅGATGÅÅÅ😀😀😀TGA", "---atg", None]
    rows = spark.createDataFrame([(x,) for x in texts], "s string")
    for t in (1, 4, 11, 33):
        code = F.create_map(*[F.lit(x) for kv in sequence.ambiguous_table(t).items() for x in kv])
        got = rows.select(sequence.translate(F.col("s"), code).alias("a"), sequence.proteins(F.col("s"), F.lit(t)).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    assert rows.select(sequence.proteins(F.col("s"), F.lit(None).cast("int")).alias("b")).distinct().collect()[0]["b"] is None


def test_validation_without_codes_in_rows(spark):
    plan = plan_of(queries.nt_validate_translation(spark, SMALL))
    assert "Join" not in plan and "try_element_at" not in plan


def test_bases_as_before(spark):
    texts = ["Abc, xyz! É ß İ K", "", "12 34", None, "ZZ\ntop"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    got = rows.select(plain.alias("a"), views._bases(F.lower("text")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_features_go_without_bases(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: kept.append(df) or df)
    genomes.features(spark, SMALL)
    plan = plan_of(kept[0])
    # all that reads bases is below the step that makes several features of a record
    assert "substring(bases" not in plan[: plan.index("Generate")] and "replace(s" not in plan[: plan.index("Generate")]


def test_gff_fasta_without_features(spark, monkeypatch):
    monkeypatch.setattr(genomes, "features", lambda *_: pytest.fail("features were worked out"))
    assert genome_queries.gen_gff_fasta(spark, SMALL).columns == ["path", "record_index", "line"]


def test_findings_sorted_once(spark, monkeypatch):
    # rows that the query numbers itself aren't sorted as a whole first
    assert "], true" not in plan_of(genome_queries.gen_findings_json(spark, SMALL))
    labels, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: labels.append(label) or keep(self, df, label))
    rows = genome_queries.gen_findings(spark, SMALL)
    assert labels[-1] == "findings" and "Join" not in plan_of(rows)
    paths = [r["path"] for r in rows.collect()]
    assert paths == sorted(paths)


def test_only_coding_features_meet_bases(spark):
    f, r = genomes.features(spark, SMALL), genomes.records(spark, SMALL)
    joins = [x for x in plan_of(validation.unordered_findings(f, r)).split("\n") if "Join LeftOuter" in x]
    assert len(joins) == 1
    found = validation.unordered_findings(f, r)
    assert found.where("code = 'TRANSLATION_EXTRACTION_ERROR'").count() == f.where("type = 'CDS' and location is null").count() > 0


def test_rules_are_matched_once(spark):
    for query in (genome_queries.gen_discovery_table, genome_queries.gen_discovery_document):
        assert "Contains(" not in (plan := plan_of(query(spark, SMALL))) and "contains(" not in plan.lower()


def test_gff_lines_sorted_once(spark):
    assert "], true" not in plan_of(genome_queries.gen_gff(spark, SMALL))


def test_compared_features_are_narrow(spark, monkeypatch):
    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: kept.setdefault(label, df) and keep(self, df, label))
    genome_queries._old_new(spark, SMALL)
    assert "qualifiers" not in kept["old"].columns and kept["old"].where("type <> 'CDS'").isEmpty()


def test_codons_are_counted_once(spark):
    assert "Generate" not in plan_of(genome_queries.gen_codon_tsv(spark, SMALL))


def test_table_without_codons_is_listed(spark):
    rows = [("ATGAAATAA", 11, None), ("ATG", 4, "nontriplet"), ("ATG", 5, "pseudo")]
    got = codon_usage.codon_usage(spark.createDataFrame(rows, "nt string, table_id int, reason string")).collect()
    assert {r["table_id"] for r in got} == {4, 11} and sorted(r["codon"] for r in got if r["count"]) == ["AAA", "ATG"]


def test_numbers_only_where_targets_are(spark):
    f = genomes.features(spark, SMALL)
    plan = plan_of(intervals.ordinal_window(f.where("gene = 'dnaK' and type = 'CDS'"), f, 2, True))
    assert plan.index("Window") < plan.rindex("LeftSemi")


def test_lines_of_bases_are_cut_once(spark):
    f, r = genomes.features(spark, SMALL), genomes.records(spark, SMALL)
    for n in (1, 60, 61, 120, 125):
        one = r.where("seq is not null").limit(1).withColumn("seq", F.repeat(F.lit("ACGTN"), 25).substr(1, n))
        rows = flatfile.flatfile_texts(one, f.limit(0))
        lines = rows.first()["value"].split("ORIGIN\n")[1].split("\n")[:-1]
        assert lines == [f"{i + 1:>9} {('acgtn' * 25)[i : min(i + 60, n)]}" for i in range(0, n, 60)]
    # before, each line put the whole bases into small letters and counted up to its place
    assert "sequence(" not in plan_of(flatfile.flatfile_texts(r, f))


def test_bases_once_a_row(spark):
    """A filter on the bases or their number doesn't work them out again, and one on the document passes below."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    r = genomes.records(spark, SMALL).where("length >= 120 and length(seq) > 7 and topology = 'circular'")
    assert plan(r).count("ArrowEvalPython") == 1 and plan(r).rindex("% 2) = 0") > plan(r).index("ArrowEvalPython")


def test_bases_of_every_letter(spark):
    """Nothing but A to Z, the Kelvin sign and the dotted I is a letter from a to z in small."""
    some = "".join(map(chr, [*range(1, 0x3000), *range(0xA640, 0xD800), *range(0xE000, 0x20000)]))
    rows = spark.createDataFrame([(some[i : i + 500],) for i in range(0, len(some), 500)] + [("K\u212aI\u0130i\u0307z\u0131",), ("",), (None,)], "text string")
    plain = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    got = rows.select(plain.alias("a"), views._bases("text").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[-1]["b"] is None


def test_parts_by_bytes(spark):
    rows = spark.createDataFrame([("ACGTNacgtn", s, e) for s in (-3, -1, 0, 4, 9, 10, 12) for e in (-2, 0, 3, 9, 10, 11, 40)] + [("", 0, 3), (None, 0, 3), ("ACÅGT", 1, 4)], "seq string, a long, b long")
    parts = F.array(*[F.struct(F.col("a").alias("start0"), F.col("b").alias("end0"), F.lit(x).alias("strand")) for x in (1, -1)])
    got = rows.select(sequence.extract(F.col("seq"), parts).alias("x"), sequence.extract(F.col("seq"), parts, sequence.byte_each(F.col("seq"))).alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got]


def test_coding_bases_are_cut_once(spark):
    for df in (genome_queries.gen_cds_fasta(spark, SMALL), genome_queries.gen_codon_exclusions(spark, SMALL)):
        # before, the filter or each condition on the bases cut them out again
        assert plan_of(df).count("reverse(") == 1
    assert genome_queries.gen_cds_fasta(spark, SMALL).count() > 0


def test_only_coding_features_are_written(spark, monkeypatch):
    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: kept.setdefault(label, df) and keep(self, df, label))
    every = genomes.features(spark, SMALL).where("type = 'CDS'")
    kept.clear()
    genome_queries.gen_cds_fasta(spark, SMALL)
    assert kept["features"].where("type <> 'CDS'").isEmpty()
    only = genomes.features(spark, SMALL, "CDS")
    shown = ["record_id", "feature_index", "location", "translation", "product"]
    assert only.select(shown).exceptAll(every.select(shown)).isEmpty() and only.count() == every.count()
