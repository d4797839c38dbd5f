"""Every command over a small file."""

import json

import pytest

from strandline import cli
from tests.test_flatfile import FILE_A, FILE_B, GENE


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "a.gb").write_text(FILE_A)
    (d / "b.gbff").write_text(FILE_B)
    (d / "a.txt").write_text("CDSs: 40\nLength: 1,000,000 bp\n")
    return d


def run(spark, capsys, *argv):
    capsys.readouterr()
    assert cli.main(list(map(str, argv))) == 0
    return capsys.readouterr().out


def test_tables(spark, files, capsys):
    a, b = files / "a.gb", files / "b.gbff"
    call = lambda *x: run(spark, capsys, *x)
    assert [f["code"] for f in json.loads(call("validate", a, "--json"))] == ["MISSING_TRANSLATION"]
    assert "MISSING_TRANSLATION" in call("validate", a)
    assert "S-1" in call("summary", a) and "S-2" in call("metadata", b)
    assert call("extract", a).splitlines()[2].split("\t")[:6] == ["ALPHA.1", "1", "24", "+", "gene", "A_1"]
    assert [r["locus_tag"] for r in json.loads(call("search", a, "--ko", "K00845", "--format", "json"))] == ["A_1"]
    assert "A_2" in call("search", a, "--product", "TRANSPOSASE")
    assert json.loads(call("locus", a, "A_3"))[0]["length"] == 24
    assert [x.split("\t")[:3:2] for x in call("neighborhood", a, "A_5", "1").splitlines()[1:]] == [["", "A_2"], [">>", "A_5"], ["", "A_3"]]
    assert "Glycolysis" in call("functional", a) and "island_1" in call("discover", a, "--format", "tsv") and "island_1" in call("discover", a)
    assert call("compare", files, "--targets", "foo,cas9").splitlines()[1:] == [f"a\t{a}\t1\t0", f"b\t{b}\t0\t1"]
    same = json.loads(call("diff", a, a, "--format", "json"))
    assert same["classification_counts"] == {"unchanged": 5, "removed": 0, "added": 0} and same["matched_cds"] == 5 and len(same["changes"]) == 5
    other = json.loads(call("diff", a, b, "--format", "json"))
    assert list(other)[:4] == ["old_file", "new_file", "old_cds_count", "new_cds_count"] and list(other["details"]) == ["product_changes", "gene_changes", "xref_changes", "boundary_shifts", "added", "removed"]
    assert (other["added_cds"], other["removed_cds"], other["product_name_changes"]) == (1, 4, 1) and other["details"]["product_changes"][0]["match"] == "translation_hash"
    assert other["details"]["xref_changes"][0]["xref_changes"]["ec_numbers"] == {"old": ["2.7.1.2"], "new": []} and "matched_cds" in call("diff", a, b)
    found = json.loads(call("discover", a, "--format", "json"))
    assert (found["file"], found["total_hits"], found["total_islands"], found["islands"][0]["cluster_id"], len(found["islands"][0]["features"])) == (str(a), 2, 1, "island_1", 2)
    assert found["hits"][0] == found["islands"][0]["features"][0] and found["hits"][0]["matches"][0]["rule"] == "transposase"
    functions = json.loads(call("functional", a, "--format", "json"))
    assert functions["total_cds"] == 5 and functions["pathways"]["Glycolysis (Embden-Meyerhof)"]["steps"][0] == {"name": "Glucokinase / Hexokinase", "matched": ["K00845", "EC:2.7.1.2"], "status": "PRESENT"}
    assert call("crispr", a).splitlines()[:2] == ["record\ttype\tlocus_tag\tgene\tproduct\tstart\tend\tstrand", "ALPHA.1\trepeat_region\t-\t-\t-\t89\t92\t+"]
    assert "ABSENT" in call("phylo", a, "--markers", "housekeeping") and "B_1" in call("crispr", b)
    assert call("gff", a).startswith("##gff-version 3\n")
    pairs = [x.split("\t") for x in call("operons", a).splitlines()]
    assert [(x[3], x[4], x[6]) for x in pairs[1:3]] == [("A_5", "A_3", "15"), ("A_3", "A_4", "2")] and pairs[4][-1] == "A_5;A_3;A_4"
    assert "ATG" in call("codon", a, "--min-len", "5")


def test_files(spark, files, capsys):
    a, b = files / "a.gb", files / "b.gbff"
    run(spark, capsys, "fasta", a)
    assert (files / "a.faa").read_text().startswith(">A_1 gene=fooA")
    run(spark, capsys, "sequence", b)
    assert (files / "b.ffn").read_text().splitlines()[:2] == [">B_1 gene=ringB product=cas9 like [BETA:1..54(+)]", GENE] and (files / "b.fna").read_text().startswith(">BETA len=54")
    run(spark, capsys, "region", b, "--record", "BETA", "--start", "37", "--end", "6", "--output", files / "r.fa")
    assert (files / "r.fa").read_text().splitlines()[1] == GENE
    assert "/original_record" in run(spark, capsys, "region", a, "--locus", "A_2", "--flank-bp", "3")
    out = [files / f"o.{x}" for x in ("csv", "tsv", "md")]
    run(spark, capsys, "batch-summary", files, "--csv", out[0], "--tsv", out[1], "--md", out[2])
    assert out[1].read_text().splitlines()[1].startswith("a\t1.000\t") and out[2].read_text().startswith("| Sample / Isolate |")
    for _ in range(2):  # the second replaces the first
        run(spark, capsys, "ingest", a, b, "--lake", files / "lake")
    assert spark.read.parquet(str(files / "lake" / "features")).count() == 12
    (files / "bad").mkdir()
    (files / "bad" / "c.gb").write_text("not an annotation")
    capsys.readouterr()
    cli.main(["batch-summary", str(a), str(files / "bad"), str(files / "none.xyz"), *(x for n, p in zip(("--csv", "--tsv", "--md"), out) for x in (n, str(p)))])
    warned = capsys.readouterr().err
    assert "c.gb" in warned and "none.xyz" in warned and len(out[1].read_text().splitlines()) == 2
    with pytest.raises(LookupError):
        cli.main(["neighborhood", str(a), "no such tag"])
    with pytest.raises(SystemExit):
        cli.main(["locus", str(a), "no such tag"])
    with pytest.raises(ValueError):
        cli.main(["discover", str(a), "--cluster-gap", "-1"])
