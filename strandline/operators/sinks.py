"""Text forms of results: FASTA, TSV, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import once, strand_symbol
from strandline.functions.sequence import byte_each, extract, wrap


def _head(tag: Column, product: Column) -> Column:
    gene = F.when(F.col("gene") != "", F.concat(F.lit(" gene="), F.col("gene"))).otherwise("")
    return F.format_string(">%s%s product=%s [%s:%d..%d(%s)]", tag, gene, product, "record_id", "start", "end", strand_symbol(F.col("strand")))


def protein_fasta(features: DataFrame) -> DataFrame:
    """One FASTA entry, wrapped at 60, per CDS with a translation."""
    rows = features.where("type = 'CDS' and translation <> ''")
    tag = F.when(F.col("locus_tag") != "", F.col("locus_tag")).otherwise(F.concat(F.lit("cds_"), F.col("feature_index").cast("string")))
    product = F.when(F.col("product") != "", F.col("product")).otherwise("hypothetical protein")
    return rows.select("path", "feature_index", F.concat(_head(tag, product), F.lit("\n"), wrap(F.col("translation"), 60)).alias("entry"))


def genome_fasta(records: DataFrame, width: int = 70) -> DataFrame:
    rows = records.where("length(seq) > 0")
    return rows.select("path", "record_index", F.concat(F.format_string(">%s len=%d\n", "record_id", F.length("seq")), wrap(F.upper("seq"), width)).alias("entry"))


def cds_fasta(features: DataFrame, records: DataFrame, width: int = 70) -> DataFrame:
    """Bases of each CDS in biological order; those without bases are left out."""
    seqs = records.select("path", "record_index", "seq", byte_each(F.col("seq")).alias("_plain"))
    nt = F.upper(extract(F.col("seq"), F.col("location.parts"), F.col("_plain")))
    rows = features.where("type = 'CDS'").join(seqs, ["path", "record_index"]).withColumn("nt", once(nt)).where("nt <> ''")
    tag = F.when(F.col("locus_tag") != "", F.col("locus_tag")).otherwise("unknown")
    return rows.select("path", "feature_index", F.concat(_head(tag, F.col("product")), F.lit("\n"), wrap(F.col("nt"), width)).alias("entry"))


def region_fasta(regions: DataFrame, width: int = 60) -> DataFrame:
    """One entry per region that was cut out, with its description."""
    return regions.select("path", "record_index", F.concat(F.lit(">"), "record_id", F.lit(" "), "description", F.lit("\n"), wrap(F.col("seq"), width)).alias("entry"))


def marker_fasta(hits: DataFrame) -> DataFrame:
    """Entries by marker, unwrapped; write with partitionBy("marker")."""
    return hits.select("marker", F.concat(F.lit(">"), F.concat_ws(" ", "marker", "locus_tag", "record_id"), F.lit("\n"), F.col("translation")).alias("entry"))


def tsv(rows: DataFrame) -> DataFrame:
    """``rows`` with lists joined by semicolons, ready for write.csv(sep="\\t", header=True)."""
    return rows.select(*[F.array_join(c, ";").alias(c) if kind.startswith("array<string") else F.col(f"`{c}`") for c, kind in rows.dtypes])


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[f"`{c}`" for c in rows.columns])).alias("value"))


def markdown_cell(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_line(columns: list[str]) -> Column:
    cells = [markdown_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    return rows.select(markdown_line(rows.columns).alias("line"))
