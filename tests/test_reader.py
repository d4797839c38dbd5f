"""Reading files in pieces, in any line ending and folder, and unique GFF3 ids where names clash."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import gff
from strandline.sources import flatfile
from tests.test_flatfile import FILE_A, FILE_B, GENE, record


def many(n):
    return "".join(record(f"REC{i}", GENE * (1 + i % 5), [("CDS", "1..24", {"locus_tag": f"T{i}_{k}"}) for k in range(i % 4)]) for i in range(n))


def shown(tables):
    records, features = tables
    r = sorted((x["path"].rsplit("/", 1)[1], x["record_index"], x["record_id"], x["length"]) for x in records.collect())
    f = sorted((x["path"].rsplit("/", 1)[1], x["record_index"], x["feature_index"], x["type"], x["locus_tag"]) for x in features.collect())
    return r, f


def test_pieces_of_a_file(spark, tmp_path):
    (tmp_path / "big.gb").write_text(many(120))
    whole = shown(flatfile.read_flatfiles(spark, str(tmp_path / "big.gb")))
    assert [x[1:3] for x in whole[0]] == [(i + 1, f"REC{i}") for i in range(120)]
    assert [x[2] for x in whole[1]] == list(range(1, len(whole[1]) + 1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        tables = flatfile.read_flatfiles(spark, str(tmp_path / "big.gb"))
        assert shown(tables) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(spark, tmp_path, end):
    (tmp_path / "a.gb").write_bytes((FILE_A + FILE_B).replace("\n", end).encode() + b"\xff")
    records, features = flatfile.read_flatfiles(spark, str(tmp_path / "a.gb"))
    assert [(r["record_index"], r["record_id"]) for r in records.orderBy("record_index").collect()] == [(1, "ALPHA.1"), (2, "BETA"), (3, "GAMMA")]
    assert features.where("locus_tag = 'A_1' and type = 'CDS'").first()["translation"] == "MAKRFHGD"


def test_folders_and_other_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.gb").write_text(FILE_A)
    (tmp_path / "x" / "y" / "b.gb").write_text(FILE_B)
    (tmp_path / "x" / "y" / "notes.txt").write_text("a note\n//\nanother")
    records, _ = flatfile.read_flatfiles(spark, str(tmp_path / "x"))
    assert records.groupBy("path").count().count() == 2


def test_unreadable_records(spark, tmp_path, monkeypatch):
    assert flatfile._parsed_row("nothing", True) is None
    monkeypatch.setattr(flatfile, "parse_record", lambda t: int("x"))
    assert flatfile._parsed_row("t", False) is None
    with pytest.raises(ValueError):
        flatfile._parsed_row("t", True)


def test_clashing_ids(spark, tmp_path):
    feature = lambda kind, tag: (kind, "1..24", {"locus_tag": tag})
    text = record("ONE", GENE, [feature(k, t) for t in ("a", "a", "a_2", "a", "a_2") for k in ("gene", "CDS")] + [("CDS", "1..9", {}), ("CDS", "join(1..9,13..18)", {}), ("CDS", "1..6", {})])
    (tmp_path / "c.gb").write_text(text)
    (tmp_path / "d.gb").write_text(record("TWO", GENE, [feature(k, "a") for k in ("gene", "CDS") * 2]))
    records, features = flatfile.read_flatfiles(spark, str(tmp_path))
    lines = [(x["path"].rsplit("/", 1)[1], x["line"]) for x in gff.gff_lines(features, records).collect()]
    ids = [(p, x.split("ID=")[1].split(";")[0]) for p, x in lines if "ID=" in x]
    assert len(set(ids)) == len(ids)
    of = lambda p, kind: [i for q, i in ids if q == p and i.startswith(kind + ":")]
    assert of("d.gb", "gene") == ["gene:a", "gene:a_2"] and of("d.gb", "CDS") == ["CDS:a", "CDS:a_2"]
    # names that were made come before the tag of that name
    assert of("c.gb", "gene")[:5] == ["gene:a", "gene:a_2", "gene:a_2_2", "gene:a_3", "gene:a_2_3"]
    assert of("c.gb", "CDS")[5:] == ["CDS:CDS", "CDS:CDS_2.1", "CDS:CDS_2.2", "CDS:CDS_3"] and of("c.gb", "mRNA") == ["mRNA:CDS_2"]
    parents = {x.split("ID=")[1].split(";")[0]: x.split("Parent=")[1].split(";")[0] for p, x in lines if p == "c.gb" and "Parent=" in x}
    assert parents["CDS:a"] == "gene:a" and parents["CDS:CDS_2.1"] == "mRNA:CDS_2" and parents["mRNA:CDS_2"] == "gene:CDS_2"


def test_written_and_read_again(spark, tmp_path):
    (tmp_path / "a.gb").write_text(FILE_A)
    (tmp_path / "b.gb").write_text(FILE_B)
    records, features = flatfile.read_flatfiles(spark, str(tmp_path))
    name = lambda df: df.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    flatfile.flatfile_texts(name(records), name(features)).write.partitionBy("path").text(str(tmp_path / "out"))
    again = flatfile.read_flatfiles(spark, str(tmp_path / "out"))
    columns = ["record_id", "type", "start", "end", "strand", "locus_tag", "product", "translation", "notes", "db_xref", "is_partial", "feature_index"]
    rows = lambda f: sorted(map(repr, f.select(*columns).collect()))
    assert rows(again[1]) == rows(features)
    assert sorted((r["record_id"], r["seq"]) for r in again[0].collect()) == sorted((r["record_id"], r["seq"]) for r in records.collect())
