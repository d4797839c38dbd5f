"""Feature search, lookups by tag or gene, neighbourhoods and the annotation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import strand_symbol
from strandline.operators.intervals import ordinal_window


def _dash(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "-").otherwise(F.col(c))


def search(features: DataFrame, gene=None, product=None, ko=None, ec=None, cog=None, pfam=None, ftype=None, gene_regex=None, product_regex=None) -> DataFrame:
    """Features that meet all the given conditions. Plain column tests come before the list tests."""
    cond = F.lit(True)
    same = lambda c, v: F.lower(c) == v.lower()
    if ftype:
        cond = cond & same("type", ftype)
    if gene:
        cond = cond & same("gene", gene)
    if product:
        cond = cond & F.contains(F.lower("product"), F.lit(product.lower()))
    if gene_regex:
        cond = cond & F.rlike(F.col("gene"), F.lit(f"(?i){gene_regex}"))
    if product_regex:
        cond = cond & F.rlike(F.col("product"), F.lit(f"(?i){product_regex}"))
    for field, value in (("kegg_kos", ko), ("cog_ids", cog), ("pfam", pfam)):
        if value:
            wanted = value.lower()
            cond = cond & F.exists(F.col(f"xrefs.{field}"), lambda x: F.lower(x) == wanted)  # noqa: B023
    if ec:
        # part of a number, in its own case: 1.1.1.1 finds 1.1.1.10 too
        cond = cond & F.exists(F.col("xrefs.ec_numbers"), lambda x: F.contains(x, F.lit(ec)))
    return features.where(cond)


def search_rows(found: DataFrame) -> DataFrame:
    """The 13 columns of a search result."""
    lists = [F.col(f"xrefs.{a}").alias(b) for a, b in (("kegg_kos", "kegg_ko"), ("ec_numbers", "ec_number"), ("cog_ids", "cog"), ("pfam", "pfam"))]
    return found.select(F.col("record_id").alias("record"), _dash("locus_tag").alias("locus_tag"), "type", _dash("gene").alias("gene"), _dash("product").alias("product"), "start", "end", strand_symbol(F.col("strand")).alias("strand"), "length", *lists)


def annotation_table(features: DataFrame) -> DataFrame:
    """The 15 columns of the annotation table, lists joined by semicolons."""
    x = lambda f: F.array_join(F.col(f"xrefs.{f}"), ";")
    return features.select(
        F.col("record_id").alias("contig"), "start", "end", strand_symbol(F.col("strand")).alias("strand"), "type", "locus_tag", "gene", "product",
        x("ec_numbers").alias("ec_number"), x("cog_ids").alias("cog"), x("kegg_kos").alias("kegg_ko"), x("pfam").alias("pfam"), x("rfam").alias("rfam"), x("db_xrefs").alias("db_xref"), "protein_id",
    )


def preferred(features: DataFrame, by: list[str], prefer: str = "CDS") -> DataFrame:
    """One feature per group: of the first record that has any, the first of the preferred type, else the first."""
    rank = F.struct(F.col("record_index"), (F.lower("type") != prefer.lower()).cast("int"), F.col("feature_index"))
    whole = F.struct(*features.columns)
    # an aggregate, not a window: partial results, no sort
    return features.groupBy(*by).agg(F.min_by(whole, rank).alias("_f")).select("_f.*")


def locus_features(features: DataFrame, tag: str) -> DataFrame:
    """All features with the tag."""
    return features.where(F.col("locus_tag") == tag)


def find_locus(features: DataFrame, tag: str, prefer: str = "CDS") -> DataFrame:
    return preferred(locus_features(features, tag), ["path"], prefer)


def find_gene(features: DataFrame, name: str, cds_only: bool = False, cds_first: bool = True) -> DataFrame:
    got = features.where(F.lower("gene") == name.lower())
    if cds_only:
        got = got.where("type = 'CDS'")
    return preferred(got, ["path"], "CDS" if cds_first else "")


def resolve(features: DataFrame, name: str, how: str) -> DataFrame:
    """A feature per file by locus tag, else by gene. ``how``: locus (any type, in order), neighborhood (CDS first) or
    region (CDS only)."""
    by_tag = find_locus(features, name).withColumn("_tier", F.lit(0))
    if how == "locus":
        by_gene = features.where(F.lower("gene") == name.lower())
        by_gene = by_gene.groupBy("path").agg(F.min_by(F.struct(*features.columns), "feature_index").alias("_f")).select("_f.*")
    else:
        by_gene = find_gene(features, name, cds_only=how == "region")
    both = by_tag.unionByName(by_gene.withColumn("_tier", F.lit(1)))
    return both.groupBy("path").agg(F.min_by(F.struct(*features.columns), "_tier").alias("_f")).select("_f.*")


def neighborhood(features: DataFrame, name: str, window: int = 5) -> DataFrame:
    """CDS around a resolved CDS with their offsets; circular records wrap."""
    if window < 0:
        raise ValueError("window must not be negative")
    target = resolve(features, name, "neighborhood")
    round_, straight = F.col("topology") == "circular", F.coalesce(F.col("topology") != "circular", F.lit(True))
    keys = ["path", "record_index", "feature_index"]
    cds = target.where("type = 'CDS'")
    return ordinal_window(cds.where(round_).select(*keys), features, window, True).unionByName(ordinal_window(cds.where(straight).select(*keys), features, window, False))


def neighborhood_of(features: DataFrame, name: str, window: int = 5) -> DataFrame:
    """``neighborhood`` in one file, where the target must be there and be a CDS."""
    target = resolve(features, name, "neighborhood").select("type", "record_id").first()
    if target is None:
        raise LookupError(f"no feature with the tag or gene {name!r}")
    if target["type"] != "CDS":
        raise ValueError(f"{name!r} on {target['record_id']!r} is a {target['type']}, and neighbourhoods are of CDS")
    return neighborhood(features, name, window)


def locus_duplicates(features: DataFrame) -> DataFrame:
    """Locus tags that several CDS of a file share, with their places in order; rows that repeat a number by record."""
    place = F.format_string("%s:%d..%d(%s)", "record_id", "start", "end", strand_symbol(F.col("strand")))
    rows = features.where("type = 'CDS' and locus_tag <> ''").groupBy("path", "locus_tag").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature_index", "record_index", "start", "end", place.alias("p")))), lambda x: x["p"]), ", ").alias("places"))
    return rows.where("n > 1")


def first_per_record(features: DataFrame, k: int) -> DataFrame:
    """The first k features of each record, by start."""
    w = Window.partitionBy("path", "record_index").orderBy("start", "feature_index")
    return features.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def find_record(records: DataFrame, name: str) -> DataFrame:
    """The first record of each file with the id or name."""
    got = records.where((F.col("record_id") == name) | (F.col("name") == name))
    return got.groupBy("path").agg(F.min_by(F.struct(*records.columns), "record_index").alias("_r")).select("_r.*")
