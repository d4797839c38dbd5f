"""Codon usage per translation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import once
from strandline.functions.sequence import byte_each, codon_dimension, codons, extract, table_id
from strandline.sources.scratch import Scratch


def coding_sequences(features: DataFrame, records: DataFrame) -> DataFrame:
    """CDS with ``nt``: their bases from the first codon on; null without a sequence."""
    seqs = records.select("path", "record_index", F.upper("seq").alias("seq"), byte_each(F.upper("seq")).alias("_plain"))
    joined = features.where("type = 'CDS'").join(seqs, ["path", "record_index"], "left")
    nt = F.substring(extract(F.col("seq"), F.col("location.parts"), F.col("_plain")), F.col("codon_start"), F.lit(1 << 30))
    return joined.withColumn("nt", once(nt)).drop("seq", "_plain")


def exclusions(cds: DataFrame, min_len_aa: int = 100, include_pseudo: bool = False) -> DataFrame:
    """``cds`` with ``reason``, null for those that count; a short CDS goes with those that aren't whole triplets."""
    table = table_id(F.col("transl_table"))
    reason = (
        F.when(F.col("is_pseudo") & F.lit(not include_pseudo), "pseudo")
        .when(F.col("is_partial"), "partial")
        .when(table.isNull(), "unknown_table")
        .when((F.coalesce(F.length("nt"), F.lit(0)) < 3 * min_len_aa) | (F.length("nt") % 3 != 0) | F.col("nt").isNull(), "nontriplet")
    )
    return cds.withColumn("table_id", table).withColumn("reason", reason)


def _split(cds: DataFrame) -> DataFrame:
    """Counts of each codon by whether it is the last; the codons are counted before they are joined."""
    rows = cds.where("reason is null").select("table_id", codons(F.col("nt")).alias("c"))
    placed = rows.select("table_id", F.size("c").alias("n"), F.posexplode("c").alias("pos", "codon"))
    return placed.groupBy("table_id", "codon", (F.col("pos") == F.col("n") - 1).alias("last")).agg(F.count("*").alias("n"))


def codon_counts(cds: DataFrame) -> DataFrame:
    """table_id, codon, last, n, aa, is_stop and family; aa is null for ambiguous codons."""
    dim = codon_dimension(cds.sparkSession)
    # 64 rows for each known table
    return _split(cds).join(F.broadcast(dim), ["table_id", "codon"], "left")


def codon_usage(cds: DataFrame) -> DataFrame:
    """All sense codons of the tables that occur, with count, share per thousand of all sense codons, and RSCU."""
    dim = codon_dimension(cds.sparkSession)
    # one pass over the CDS: a table's row without a codon stands for those whose codons don't count
    listed = F.when(F.col("reason").isNull(), codons(F.col("nt")))
    rows = cds.where("table_id is not null and coalesce(reason, '') in ('', 'nontriplet')").select("table_id", F.explode_outer(listed).alias("codon"))
    counted = Scratch(cds.sparkSession).keep(rows.groupBy("table_id", "codon").agg(F.count("*").alias("n")), "codons")
    sense = counted.join(F.broadcast(dim.where("aa is not null and not is_stop")), ["table_id", "codon"]).select("table_id", "codon", "n")
    full = dim.where("not is_stop and aa <> '*'").join(F.broadcast(counted.select("table_id").distinct()), "table_id").join(sense, ["table_id", "codon"], "left").na.fill(0, ["n"])
    family = F.sum("n").over(Window.partitionBy("table_id", "aa"))
    whole = F.sum("n").over(Window.partitionBy())  # over 64 rows a table
    rscu = F.when(family > 0, F.col("n") * F.col("family") / family).otherwise(F.lit(0.0))
    return full.select("table_id", "aa", "codon", F.col("n").alias("count"), F.when(whole > 0, 1000.0 * F.col("n") / whole).otherwise(F.lit(0.0)).alias("per_thousand"), rscu.alias("rscu"))


def codon_table(cds: DataFrame) -> DataFrame:
    """The six columns of the codon table, numbers as texts of two and three decimals."""
    names = {"table_id": "TranslationTable", "aa": "AminoAcid", "codon": "Codon", "count": "Count"}
    return codon_usage(cds).select(*[F.col(k).alias(v) for k, v in names.items()], F.format_string("%.2f", F.bround("per_thousand", 2)).alias("PerThousand"), F.format_string("%.3f", F.bround("rscu", 3)).alias("RSCU"))


def codon_totals(cds: DataFrame) -> DataFrame:
    """Sense, stop and ambiguous codons and GC by codon position, over all tables."""
    c = codon_counts(cds)
    sense = F.col("aa").isNotNull() & ~F.col("is_stop")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    gc = lambda k: F.substring("codon", k, 1).isin("G", "C")
    syn = sense & (F.col("family") > 1)
    share = lambda a, b: F.when(total(b) > 0, 100.0 * total(a) / total(b)).otherwise(F.lit(0.0))
    return c.agg(
        total(sense).alias("sense"), total(F.col("is_stop") & F.col("last")).alias("terminal_stops"), total(F.col("is_stop") & ~F.col("last")).alias("internal_stops"), total(F.col("aa").isNull()).alias("ambiguous"),
        share(sense & gc(1), sense).alias("gc1"), share(sense & gc(2), sense).alias("gc2"), share(sense & gc(3), sense).alias("gc3"), share(syn & gc(3), syn).alias("gc3s"),
    )
