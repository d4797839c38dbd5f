"""Adjacent genes on one strand, and chains of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BY = ("path", "record_index")


def _with_next(features: DataFrame, max_gap: int, min_gap: int) -> DataFrame:
    w = Window.partitionBy(*_BY).orderBy("start", "feature_index")
    cds = features.where("type = 'CDS'").select(*_BY, "record_id", "feature_index", "locus_tag", "start", "end", "strand")
    n = cds.withColumn("next", F.lead(F.struct("feature_index", "locus_tag", "start", "strand")).over(w))
    gap = F.col("next.start") - F.col("end") - 1
    pair = F.coalesce((F.col("strand") == F.col("next.strand")) & F.col("strand").isin(1, -1) & gap.between(min_gap, max_gap), F.lit(False))
    return n.withColumn("gap", gap).withColumn("pair", pair)


def operon_pairs(features: DataFrame, max_gap: int = 150, min_gap: int = -50) -> DataFrame:
    """Neighbouring CDS on one strand with a gap between the bounds."""
    rows = _with_next(features, max_gap, min_gap).where("pair")
    return rows.select(*_BY, "record_id", F.col("feature_index").alias("first_index"), F.col("next.feature_index").alias("second_index"), F.col("locus_tag").alias("first_tag"), F.col("next.locus_tag").alias("second_tag"), "strand", F.col("gap").cast("long").alias("gap"))


def operon_clusters(features: DataFrame, max_gap: int = 150, min_gap: int = -50, least: int = 3) -> DataFrame:
    """Chains of at least ``least`` CDS in which each neighbouring two are a pair."""
    w = Window.partitionBy(*_BY).orderBy("start", "feature_index")
    rows = _with_next(features, max_gap, min_gap).withColumn("joined", F.coalesce(F.lag("pair").over(w), F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w))
    grouped = rows.groupBy(*_BY, "chain").agg(F.first("record_id").alias("record_id"), F.count("*").alias("genes"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("feature_index").alias("first_index"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "feature_index", "locus_tag"))), lambda x: x["locus_tag"]), ";").alias("locus_tags"))
    return grouped.where(F.col("genes") >= least).drop("chain")
