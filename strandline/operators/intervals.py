"""Interval shapes shared by the operators: union, islands, neighbours, ordinal windows and the binned range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(intervals: DataFrame, by: list[str], start0: str, end0: str) -> DataFrame:
    """Length of the union of half-open intervals per group; touching ones are one."""
    order = Window.partitionBy(*by).orderBy(start0, end0)
    reach = F.max(end0).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # what an interval adds beyond all before it; no second pass over islands is needed
    added = F.greatest(F.lit(0), F.col(end0) - F.greatest(F.col(start0), F.coalesce(reach, F.col(start0))))
    return intervals.select(*by, added.alias("_added")).groupBy(*by).agg(F.sum("_added").cast("long").alias("union_length"))


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Adds the running number, from 1, of the island within its group. ``breaks`` may use lag() over the same window."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_break", breaks).withColumn(name, F.sum(F.when(F.coalesce("_break", F.lit(True)), 1).otherwise(0)).over(w)).drop("_break")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], reach: int, width: int) -> DataFrame:
    """Pairs with equal keys whose intervals [start, end] lie at most ``reach`` apart; right columns get the prefix r_.

    Both sides go into bins of ``width``; a pair is taken in the first bin that both have, so it comes once. An equality
    join on keys and bin that Spark can split when it is skewed.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    lhs = left.withColumn("_from", F.floor((F.col("start") - reach) / width)).withColumn("_bin", F.explode(bins(F.col("start") - reach, F.col("end") + reach)))
    rhs = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_r_from", F.floor(F.col("r_start") / width)).withColumn("_r_bin", F.explode(bins(F.col("r_start"), F.col("r_end"))))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys] + [F.col("_bin") == F.col("_r_bin")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    near = (F.col("r_start") <= F.col("end") + reach) & (F.col("r_end") >= F.col("start") - reach)
    return lhs.join(rhs, cond).where(near & (F.col("_bin") == F.greatest("_from", "_r_from"))).drop("_bin", "_r_bin", "_from", "_r_from")


def distance(a_start, a_end, b_start, b_end) -> Column:
    """0 on overlap, else the difference of the facing ends: 1 for neighbours."""
    a_start, a_end, b_start, b_end = (F.col(x) if isinstance(x, str) else x for x in (a_start, a_end, b_start, b_end))
    return F.when(a_end < b_start, b_start - a_end).when(b_end < a_start, a_start - b_end).otherwise(F.lit(0))


def numbered_cds(features: DataFrame) -> DataFrame:
    """CDS with their number ``i`` from 0 and the count ``n`` along their record."""
    along = Window.partitionBy("path", "record_index").orderBy("start", "feature_index")
    return features.where("type = 'CDS'").withColumn("i", F.row_number().over(along) - 1).withColumn("n", F.count("*").over(Window.partitionBy("path", "record_index")))


def ordinal_window(targets: DataFrame, features: DataFrame, window: int, circular: bool) -> DataFrame:
    """CDS up to ``window`` places before and after each target (path, record_index, feature_index), with ``offset``.

    Circular records wrap around and repeat CDS where the window is longer than the record has.
    """
    if window < 0:
        raise ValueError("window must not be negative")
    # records without a target need no numbers
    cds = numbered_cds(features.join(targets.select("path", "record_index").distinct(), ["path", "record_index"], "left_semi"))
    keys = ["path", "record_index", "feature_index"]
    centre = cds.join(targets.select(*keys), keys, "left_semi").select("path", "record_index", F.col("feature_index").alias("target_index"), F.col("i").alias("_i"), F.col("n").alias("_n"))
    wanted = centre.withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("i", F.pmod(F.col("_i") + F.col("offset"), F.col("_n")) if circular else F.col("_i") + F.col("offset"))
    return wanted.drop("_i", "_n").join(cds, ["path", "record_index", "i"])
