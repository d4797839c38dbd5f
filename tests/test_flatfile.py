"""Parser, derived columns and operators over small flatfiles of our own."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import columns, sequence
from strandline.operators import codon_usage, diffing, gff, panels, regions, search, sinks, summaries, validation
from strandline.sources import dimensions, flatfile
from strandline.sources.locations import Part, parse_location, render_location

GENE = "ATGGCTAAACGTTTCCACGGTGAT"  # MAKRFHGD


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def record(name, seq, features, topology="linear", version=None, strain=None):
    out = [f"LOCUS       {name} {len(seq)} bp    DNA     {topology}   BCT 02-FEB-2021", "DEFINITION  A made-up record", "            on two lines.", f"ACCESSION   {name}", f"VERSION     {version or name}", "SOURCE      Made up", "  ORGANISM  Fictus exemplum", "FEATURES             Location/Qualifiers"]
    source = {"organism": "Fictus exemplum"} | ({"strain": strain} if strain else {})
    for kind, where, quals in [("source", f"1..{len(seq)}", source), *features]:
        out.append(f"     {kind:<16}{where}")
        for k, vs in quals.items():
            for v in vs if isinstance(vs, list) else [vs]:
                out.append(" " * 21 + (f"/{k}" if v is None else f'/{k}="{v}"'))
    out += ["ORIGIN"] + [f"{i + 1:>9} " + " ".join(seq[j : j + 10].lower() for j in range(i, min(i + 60, len(seq)), 10)) for i in range(0, len(seq), 60)]
    return "\n".join([*out, "//"]) + "\n"


# gene on the forward strand, its twin on the reverse strand, one in two parts, one over the origin
SEQ_A = GENE + "TTTTTT" + rc(GENE) + "CCCCCC" + GENE[:12] + "GGGG" + GENE[12:] + "AAAAAAAAAA"
FILE_A = record("ALPHA", SEQ_A, [
    ("gene", "1..24", {"locus_tag": "A_1", "gene": "fooA"}),
    ("CDS", "1..24", {"locus_tag": "A_1", "gene": "fooA", "product": "foo; 50% active", "db_xref": ["COG:COG0007", "KEGG:K00845", "PF00012", "GO:0001", "UniRef:UniRef50_1"], "EC_number": "2.7.1.2", "note": ["EC:9.9.9.9", "RF00005", "say ""x"""], "translation": "MAKRFHGD"}),
    ("CDS", "complement(31..54)", {"locus_tag": "A_2", "gene": "barA", "product": "bar transposase", "translation": "MAKRFHGD"}),
    ("CDS", "join(61..72,77..88)", {"locus_tag": "A_3", "product": "recombinase", "translation": "MAKRFHGD", "protein_id": "P3"}),
    ("CDS", "<91..>96", {"locus_tag": "A_4", "product": "partial"}),
    ("CDS", "40..45", {"locus_tag": "A_5", "pseudo": None, "product": "dead"}),
    ("repeat_region", "89..92", {"note": "CRISPR repeat"}),
], version="ALPHA.1", strain="S-1").replace('say x', 'say ""x""')
SEQ_B = "GGTGAT" + "T" * 30 + GENE[:18]
FILE_B = record("BETA", SEQ_B, [("CDS", "join(37..54,1..6)", {"locus_tag": "B_1", "gene": "ringB", "product": "cas9 like", "translation": "MAKRFHGD"}), ("CDS", "10..18", {"locus_tag": "B_2", "product": "x"})], "circular") + record("GAMMA", "ACGTN" * 4, [], strain="S-2")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flat")
    (folder / "a.gb").write_text(FILE_A.replace("\n", "\r\n"))
    (folder / "b.gbff").write_text(FILE_B)
    records, features = flatfile.read_flatfiles(spark, str(folder / "a.gb"), str(folder / "b.gbff"))
    name = lambda df: df.withColumn("path", F.element_at(F.split("path", "/"), -1))
    return name(records).cache(), name(features).cache()


def one(features, tag, kind="CDS"):
    return features.where((F.col("locus_tag") == tag) & (F.col("type") == kind)).collect()[0]


@pytest.mark.parametrize("text, want", [
    ("5", (None, [Part(4, 5)])), ("5..9", (None, [Part(4, 9)])), ("<5..>9", (None, [Part(4, 9, 1, "<", ">")])), ("5^6", (None, [Part(5, 5)])),
    ("complement(join(1..3,7..9))", ("join", [Part(6, 9, -1), Part(0, 3, -1)])), ("order(1..3,complement(5..6))", ("order", [Part(0, 3), Part(4, 6, -1)])),
    ("90..10", ("join", [Part(89, 100), Part(0, 10)])), ("J00194.1:1..5", None), ("join(1..2", None), ("", None),
])
def test_locations(text, want):
    assert parse_location(text, 100, True) == want
    if want and text not in ("90..10",):
        assert parse_location(render_location(*want), 100, True) == want


def test_records(lake):
    rows = {r["record_id"]: r for r in lake[0].collect()}
    assert set(rows) == {"ALPHA.1", "BETA", "GAMMA"}
    a = rows["ALPHA.1"]
    assert (a["seq"], a["length"], a["topology"], a["description"], a["organism"], a["date"], a["division"]) == (SEQ_A, len(SEQ_A), "linear", "A made-up record on two lines", "Fictus exemplum", "02-FEB-2021", "BCT")
    assert (rows["GAMMA"]["record_index"], rows["BETA"]["topology"]) == (2, "circular")


def test_feature_columns(lake):
    f = lake[1]
    a3, a2, a4, a5, b1 = (one(f, t) for t in ("A_3", "A_2", "A_4", "A_5", "B_1"))
    assert (a3["start"], a3["end"], a3["length"], a3["genomic_span"], [tuple(x) for x in a3["join_segments"]]) == (61, 88, 24, 28, [(61, 72), (77, 88)])
    assert (a2["strand"], a2["is_compound"], a4["is_partial_start"], a4["is_partial_end"], a5["is_pseudo"], b1["genomic_span"]) == (-1, False, True, True, True, 54)
    assert [r["feature_index"] for r in f.where("path = 'b.gbff'").orderBy("feature_index").collect()] == [1, 2, 3, 4]
    x = one(f, "A_1")["xrefs"]
    assert (x["cog_ids"], x["kegg_kos"], x["pfam"], x["rfam"], x["go_terms"], x["ec_numbers"], x["db_xrefs"]) == (["COG0007"], ["K00845"], ["PF00012"], ["RF00005"], ["GO:0001"], ["2.7.1.2"], ["UniRef:UniRef50_1"])
    assert 'say "x"' in one(f, "A_1")["notes"]
    assert f.select(columns.qual("gene", "?").alias("g")).where("g = '?'").count() > 0


def test_xrefs_brute_force(spark):
    import random
    import re

    rng = random.Random(17)
    words = ["GO:1", "go:2", "COG:COG0007", "cog12", "COGX", "KEGG:K00001", "k00002", "K0000", "xK00003", "Pfam:PF1", "pf02", "PFAM", "Rfam:RF1", "RFAM:1", "rf7", "EC:1.1.1.1", "ec:2", "EC:", "", "UniRef:a", " GO:3", "K000011", "a COG1"]
    rows = [(i, rng.choices(words, k=rng.randint(0, 5)), rng.choices(words, k=rng.randint(0, 4)), rng.choices(["3.1", "3.2"], k=rng.choice([0, 0, 1, 3]))) for i in range(400)]
    unique = lambda x: list(dict.fromkeys(x))
    shapes = {"cog_ids": r"(?:COG:)?(COG\d+)", "kegg_kos": r"(?:KEGG:)?(K\d{5})", "pfam": r"(?:Pfam:)?(PF\d+)", "rfam": r"(?:Rfam:)?(RF\d+)"}
    got = {r["i"]: r["x"].asDict() for r in spark.createDataFrame(rows, "i int, d array<string>, n array<string>, e array<string>").select("i", columns.xrefs(F.col("d"), F.col("n"), F.col("e")).alias("x")).collect()}
    for i, d, n, e in rows:
        both = d + n
        want = {k: unique(m[1] for x in both if (m := re.match(p, x, re.I))) for k, p in shapes.items()}
        want["go_terms"] = unique(x for x in both if x.startswith("GO:"))
        want["ec_numbers"] = unique(e or [x[3:] for x in both if x.startswith("EC:")])
        want["db_xrefs"] = unique(x for x in d if not x.startswith(("GO:", "COG", "PF", "RFAM", "Rfam:", "EC:")) and not any(re.match(p, x, re.I) for p in shapes.values()))
        assert got[i] == want, (d, n, e)


def test_sequences_and_translation(spark, lake):
    cds = codon_usage.coding_sequences(lake[1], lake[0])
    nt = {r["locus_tag"]: r["nt"] for r in cds.collect()}
    assert all(nt[t] == GENE for t in ("A_1", "A_2", "A_3", "B_1"))
    code = sequence.code_dimension(spark).where("table_id = 11").first()["code"]
    df = spark.createDataFrame([("ATGGCNTAARAYZZ",)], "s string").select(sequence.translate(F.col("s"), F.create_map(*[F.lit(x) for kv in code.items() for x in kv])).alias("p"), sequence.reverse_complement(F.lit("ACGTNry")).alias("r"), sequence.gc_percent(F.lit("GCATNN")).alias("g"), sequence.wrapped_slice(F.lit("ABCDE"), F.lit(4), F.lit(11)).alias("w"))
    assert tuple(df.first()) == ("MA*B", "ryNACGT", 50.0, "DEABCDEA")
    ids = spark.createDataFrame([("",), ("4",), ("99",), ("x",), ("7",)], "t string").select(sequence.table_id(F.col("t"))).collect()
    assert [r[0] for r in ids] == [11, 4, None, None, None]
    assert sequence.code_table(4)["TGA"] == "W" and sequence.stop_codons(31) == ["TAA", "TAG"] and len(sequence.code_table(2)) == 64


def test_validation(lake):
    found = {(r["locus_tag"], r["code"]) for r in validation.findings(lake[1], lake[0]).collect()}
    assert found == {("A_4", "MISSING_TRANSLATION"), ("B_2", "MISSING_TRANSLATION")}
    broken = lake[1].withColumn("translation", F.when(F.col("locus_tag") == "A_2", "MKKKKKKK").otherwise(F.col("translation"))).withColumn("transl_table", F.when(F.col("locus_tag") == "A_3", "99").otherwise(F.col("transl_table"))).withColumn("locus_tag", F.when(F.col("locus_tag") == "A_5", "A_1").otherwise(F.col("locus_tag")))
    rows = validation.findings(broken, lake[0])
    assert {("A_2", "CDS_TRANSLATION_MISMATCH"), ("A_3", "UNKNOWN_TRANSLATION_TABLE"), ("A_1", "DUPLICATE_LOCUS_TAG")} <= {(r["locus_tag"], r["code"]) for r in rows.collect()}
    assert validation.severity_counts(rows).where("path = 'a.gb'").first()["error"] == 0


def test_codons(lake):
    cds = codon_usage.exclusions(codon_usage.coding_sequences(lake[1], lake[0]), min_len_aa=5)
    reasons = {r["locus_tag"]: r["reason"] for r in cds.collect()}
    assert reasons == {"A_1": None, "A_2": None, "A_3": None, "B_1": None, "A_4": "partial", "A_5": "pseudo", "B_2": "nontriplet"}
    usage = {r["codon"]: r for r in codon_usage.codon_usage(cds).collect()}
    assert len(usage) == 61 and usage["GCT"]["count"] == 4 and usage["GCT"]["rscu"] == 4.0 and usage["ATG"]["per_thousand"] == 125.0
    t = codon_usage.codon_totals(cds).first()
    assert (t["sense"], t["terminal_stops"], t["gc1"]) == (32, 0, 62.5)


def test_search_and_lookup(lake):
    f = lake[1].where("path = 'a.gb'")
    assert [r["locus_tag"] for r in search.search(f, ko="k00845").collect()] == ["A_1"]
    assert search.search(f, ec="2.7.1").count() == 1 and search.search(f, gene="FOOA").count() == 2 and search.search(f, ftype="cds", product_regex="^bar").count() == 1
    assert search.find_locus(f, "A_1").first()["type"] == "CDS" and search.resolve(f, "BARA", "region").first()["locus_tag"] == "A_2"
    assert search.resolve(f, "fooa", "locus").first()["type"] == "gene"
    near = search.neighborhood(f, "A_5", 1).orderBy("offset").collect()
    assert [r["locus_tag"] for r in near] == ["A_2", "A_5", "A_3"]
    ring = search.neighborhood(lake[1].where("path = 'b.gbff'"), "B_1", 2).orderBy("offset").collect()
    assert [r["locus_tag"] for r in ring] == ["B_1", "B_2", "B_1", "B_2", "B_1"]
    row = search.search_rows(search.search(f, ko="K00845")).first()
    assert row["kegg_ko"] == ["K00845"] and row["strand"] == "+"
    with pytest.raises(ValueError):
        search.neighborhood(f, "A_1", -1)


def test_summaries(spark, lake):
    cov = {r["record_id"]: r for r in summaries.coding(lake[1], lake[0]).collect()}
    assert (cov["ALPHA.1"]["coding_bp"], cov["ALPHA.1"]["cds_bp"], cov["GAMMA"]["coding_density"]) == (78, 84, 0.0)
    meta = {r["locus"]: r for r in summaries.metadata(lake[0], lake[1]).collect()}
    assert meta["ALPHA"]["strain"] == "S-1" and meta["GAMMA"]["strain"] == "S-2" and meta["BETA"]["accession"] == "BETA"
    report = {r["path"]: r for r in summaries.genome_report(lake[0], summaries.coding(lake[1], lake[0])).collect()}
    assert report["a.gb"]["bases"] == len(SEQ_A) and abs(report["a.gb"]["coding_density"] - 100 * 78 / len(SEQ_A)) < 1e-9
    assert summaries.sequences_by_id(lake[0]).where("record_id = 'BETA'").first()["seq"] == SEQ_B
    assert search.find_record(lake[0], "ALPHA").first()["record_id"] == "ALPHA.1"
    lines = spark.createDataFrame([("x/a.txt", 0, "Length: 5,050 bp"), ("x/a.txt", 1, "  CDSs: 12"), ("x/a.txt", 2, "GC: 59.8 %"), ("x/a.txt", 3, "other: 1"), ("x/a.txt", 4, "tRNAs: 2")], "path string, pos int, value string")
    s = dimensions.parse_summaries(lines)
    assert s.first()["summary"] == {"genome_size_bp": 5050.0, "cds": 12.0, "gc_content": 59.8, "trna": 2.0}
    rows = {r["Sample / Isolate"]: r for r in summaries.batch_summary(lake[0], lake[1], s).collect()}
    assert rows["a"]["CDS"] == 12 and rows["a"]["Genome Size (Mbp)"] == "0.005" and rows["a"]["Total Gene/Feature Count"] == 12 + 2 + 1 and rows["a"]["tRNA / tmRNA"] == "2 / 0"
    assert rows["b"]["CDS"] == 2 and rows["b"]["Pseudogenes"] == 0 and rows["a"]["Genes assigned to UniRef"] == 1
    assert sinks.markdown_rows(spark.createDataFrame([("a|b\nc",)], "x string")).first()[0] == "| a\\|b<br>c |"


def test_panels(spark, lake, tmp_path):
    f = lake[1]
    hits = panels.discovery_hits(f)
    assert {(r["locus_tag"], r["weight"]) for r in hits.collect()} == {("A_2", 3), ("A_3", 2)}
    members = panels.discovery_islands(hits)
    isle = panels.island_summary(members).first()
    assert (isle["cluster_id"], isle["genes"], isle["total_weight"], isle["start"], isle["end"]) == ("island_1", 2, 5, 31, 88)
    assert panels.discovery_table(hits, members).where("cluster_id is not null").count() == 2
    assert panels.discovery_islands(hits, cluster_gap=2).count() == 0
    rules = tmp_path / "r.json"
    rules.write_text(json.dumps([{"id": "k", "terms": ["FOO"], "weight": 7}]))
    assert panels.discovery_hits(f, rules_file=str(rules)).first()["weight"] == 7
    with pytest.raises(FileNotFoundError):
        dimensions.load_rules(rules_file=str(tmp_path / "no.json"))
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(TypeError):
        dimensions.load_rules(rules_file=str(tmp_path / "o.json"))
    p = {(r["path"], r["pathway"]): r for r in panels.pathway_completeness(f).collect()}
    assert p["a.gb", "Glycolysis (Embden-Meyerhof)"]["steps_present"] == 1 and p["b.gbff", "TCA Cycle"]["completeness_pct"] == 0.0
    m = {r["path"]: r for r in panels.target_matrix(f, ["foo", "cog0007", "cas9", "foo"]).collect()}
    assert (m["a.gb"]["foo"], m["a.gb"]["cog0007"], m["b.gbff"]["cas9"]) == (2, 1, 1)
    words = spark.createDataFrame([("a ladA b",), ("ladA-like",), ("xladA",)], "s string").select(panels.word_in("lada", F.col("s")))
    assert [r[0] for r in words.collect()] == [True, False, False]
    hits = panels.marker_hits(f, {"fooA": "none", "zz": "bar transposase"}, 5)
    status = {(r["path"], r["marker"]): r["status"] for r in panels.marker_status(hits, f, {"fooA": "none", "zz": "bar transposase"}).collect()}
    assert status["a.gb", "fooA"] == "SINGLE_COPY" and status["b.gbff", "zz"] == "ABSENT"
    assert panels.crispr_arrays(f).count() == 1 and panels.cas_genes(f).first()["locus_tag"] == "B_1"
    near = panels.colocated(panels.crispr_arrays(f), f.where("locus_tag = 'A_3'"), 5).collect()
    assert [r["distance"] for r in near] == [1]


def test_diff(lake):
    old = diffing.cds_of(lake[1].where("path = 'a.gb'"))
    later = lake[1].where("path = 'a.gb' and locus_tag <> 'A_5'").withColumn("end", F.when(F.col("locus_tag") == "A_1", F.col("end") + 1).otherwise(F.col("end"))).withColumn("locus_tag", F.concat(F.lit("N"), "locus_tag")).withColumn("product", F.upper("product"))
    new = diffing.cds_of(later)
    pairs = {(r["old_idx"], r["new_idx"]): r["tier"] for r in diffing.pair_features(old, new).collect()}
    assert sorted(pairs.values()) == ["coordinate_overlap"] * 3 + ["protein_id"] and all(a == b for a, b in pairs)
    changes = diffing.classify(old, new, diffing.pair_features(old, new))
    assert {r["classification"]: r["n"] for r in diffing.class_counts(changes).collect()} == {"boundary_shifted": 1, "product_changed": 4, "removed": 1}
    assert diffing.shared_coordinates(old, new).count() == 3


def test_regions(lake):
    r, f = lake
    b, a = "path = 'b.gbff'", "path = 'a.gb'"
    cut, feats = regions.extract_regions(regions.gene_window(f.where(b), "B_1"), r.where(b), f.where(b))
    row = cut.first()
    assert (row["record_id"], row["length"], row["seq"]) == ("BETA_region_1_54", 54, SEQ_B)
    one_ = r.where("record_id = 'BETA'").select("path", "record_index", F.lit(37).cast("long").alias("start"), F.lit(6).cast("long").alias("end"))
    cut, feats = regions.extract_regions(one_, r, f)
    assert cut.first()["seq"] == GENE
    spans = {x["type"]: [(p["start0"], p["end0"]) for p in x["location"]["parts"]] for x in feats.where("type = 'CDS'").collect()}
    assert spans == {"CDS": [(0, 18), (18, 24)]}
    own = feats.where("type = 'CDS'").first()["qualifiers"]
    assert own["original_record"] == ["BETA"] and own["original_start"] == ["1"]
    cut, feats = regions.extract_regions(regions.gene_window(f.where(a), "A_2", 1), r.where(a), f.where(a), flank_bp=2)
    assert (cut.first()["length"], cut.first()["annotations"]["parent_start"]) == (47, "1")


def test_gff_and_sinks(lake):
    r, f = lake
    lines = [x["line"] for x in gff.gff_lines(f.where("path = 'a.gb'"), r.where("path = 'a.gb'"), True).collect()]
    assert lines[:2] == ["##gff-version 3", f"##sequence-region ALPHA.1 1 {len(SEQ_A)}"] and lines[-2] == "##FASTA"
    body = [x.split("\t") for x in lines if x.count("\t") == 8]
    ids = [x[8].split(";")[0] for x in body]
    assert len(set(ids)) == len(ids) and "ID=gene:A_1" in ids
    a1 = next(x for x in body if x[8].startswith("ID=CDS:A_1;"))
    assert "Parent=gene:A_1" in a1[8] and "product=foo%3B%2050%25%20active" in a1[8] and "Dbxref=PF00012" in a1[8]
    a3 = [(x[2], x[7]) for x in body if "locus_tag=A_3" in x[8]]
    assert a3 == [("gene", "."), ("mRNA", "."), ("CDS", "0"), ("CDS", "0")]
    entry = sinks.protein_fasta(f.where("locus_tag = 'A_2'")).first()["entry"]
    assert entry == ">A_2 gene=barA product=bar transposase [ALPHA.1:31..54(-)]\nMAKRFHGD"
    assert sinks.genome_fasta(r).where("path = 'a.gb'").first()["entry"].split("\n")[1] == SEQ_A[:70]
    assert {x["entry"].split("\n")[1] for x in sinks.cds_fasta(f.where("locus_tag in ('A_1', 'A_2', 'A_3', 'B_1')"), r).collect()} == {GENE}


def test_round_trip(lake):
    r = lake[0].where("path = 'a.gb'").first().asDict()
    own = [{"type": x["type"], "location": x["location"].asDict(), "qualifiers": x["qualifiers"]} for x in lake[1].where("path = 'a.gb'").orderBy("feature_index").collect()]
    again = flatfile.parse_record(flatfile.render_record(r, own))
    assert again["seq"] == SEQ_A and again["record_id"] == "ALPHA.1"
    plain = lambda loc: None if loc is None else (loc["operator"], [dict(p) if isinstance(p, dict) else p.asDict() for p in loc["parts"]])
    assert [(x["type"], plain(x["location"]), x["qualifiers"]) for x in again["features"]] == [(x["type"], plain(x["location"]), x["qualifiers"]) for x in own]


def test_files(tmp_path):
    for n in ("z.gb", "sub/A.GBK", "no.txt"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text("")
    got = flatfile.find_flatfiles([str(tmp_path), str(tmp_path / "z.gb")])
    assert [p.rsplit("/", 1)[1] for p in got] == ["A.GBK", "z.gb"]
    assert len(flatfile.find_flatfiles([str(tmp_path / "z.gb"), str(tmp_path / "z.gb")], distinct=False)) == 2


def test_stream(spark, tmp_path):
    from strandline.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gb").write_text(FILE_A)
    for _ in range(2):  # what was taken once isn't taken again
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "lake"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "lake" / "features")).count() == 8
