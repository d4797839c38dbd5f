"""Counts and statistics per file, record metadata, coding density and the batch summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import strand_symbol
from strandline.functions.fixed_values import BATCH_COLUMNS
from strandline.functions.sequence import gc_percent
from strandline.operators.intervals import union_length


def type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("path", "type").agg(F.count("*").alias("n"), F.min("feature_index").alias("first_index")).orderBy("path", F.desc("n"), "first_index")


def strand_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("path", strand_symbol(F.col("strand")).alias("strand")).agg(F.count("*").alias("n"))


def qualifier_keys(features: DataFrame) -> DataFrame:
    return features.select("path", F.explode(F.map_keys("qualifiers")).alias("key")).distinct()


def cds_stats(features: DataFrame) -> DataFrame:
    """Lengths, tags and product kinds of each file's CDS. The median is the upper one.

    Lengths are counted per value first, so a group's array has one entry per distinct length.
    """
    cds = features.where("type = 'CDS'")
    product = F.lower("product")
    hypothetical = F.contains(product, F.lit("hypothetical")) | F.contains(product, F.lit("domain-containing")) | F.contains(product, F.lit("duf"))
    tag = F.when(F.col("locus_tag") != "", F.col("locus_tag"))
    main = cds.groupBy("path").agg(
        F.count("*").alias("cds"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("mean_length"),
        F.count(tag).alias("tags"), F.countDistinct(tag).alias("distinct_tags"), F.min(tag).alias("first_tag"), F.max(tag).alias("last_tag"),
        F.count_if(F.col("gene") != "").alias("named_genes"), F.count_if(hypothetical).alias("hypothetical"),
    )
    lengths = cds.groupBy("path", "length").agg(F.count("*").alias("n")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("a"), F.sum("n").alias("total"))
    step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["m"].isNull() & (acc["seen"] + x["n"] > F.floor(F.col("total") / 2)), x["length"]).otherwise(acc["m"]).alias("m"))
    median = lengths.select("path", F.aggregate("a", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("m")), step)["m"].alias("median_length"))
    return main.join(median, "path")


def document_totals(records: DataFrame, features: DataFrame) -> DataFrame:
    return records.groupBy("path").agg(F.count("*").alias("records"), F.sum("length").alias("total_length")).join(features.groupBy("path").agg(F.count("*").alias("total_features")), "path", "left").na.fill(0, ["total_features"])


def coding(features: DataFrame, records: DataFrame) -> DataFrame:
    """Per record: summed CDS length, length of the union of their parts within the record, and coding density."""
    keys = ["path", "record_index"]
    cds = features.where("type = 'CDS'")
    parts = cds.select(*keys, "record_length", F.explode("location.parts").alias("p")).select(*keys, F.greatest(F.lit(0), F.col("p.start0")).alias("a"), F.least("record_length", F.col("p.end0")).alias("b")).where("b > a")
    sums = cds.groupBy(*keys).agg(F.sum("length").alias("cds_bp"))
    out = records.select(*keys, "record_id", "length").join(sums, keys, "left").join(union_length(parts, keys, "a", "b"), keys, "left").na.fill(0, ["cds_bp", "union_length"])
    density = F.when(F.col("length") > 0, 100.0 * F.col("union_length") / F.col("length")).otherwise(F.lit(0.0))
    return out.select(*keys, "record_id", "cds_bp", F.col("union_length").alias("coding_bp"), density.alias("coding_density"))


def metadata(records: DataFrame, features: DataFrame) -> DataFrame:
    """Eleven fields per record; the strain is the first strain or isolate of a source feature."""
    named = features.where("type = 'source'").withColumn("strain", F.coalesce(*[F.when(F.try_element_at(F.col("qualifiers"), F.lit(k))[0] != "", F.try_element_at(F.col("qualifiers"), F.lit(k))[0]) for k in ("strain", "isolate")]))
    strains = named.where("strain is not null").groupBy("path", "record_index").agg(F.min_by("strain", "feature_index").alias("strain"))
    return records.join(strains, ["path", "record_index"], "left").select(
        F.col("name").alias("locus"), "length", F.coalesce("molecule_type", F.lit("DNA")).alias("mol_type"), F.coalesce("topology", F.lit("linear")).alias("topology"), F.coalesce("division", F.lit("")).alias("division"), F.coalesce("date", F.lit("")).alias("date"),
        F.col("description").alias("definition"), F.coalesce(F.get("accessions", F.lit(0)), F.lit("")).alias("accession"), "organism", "source", F.coalesce("strain", F.lit("")).alias("strain"),
    )


def identity():
    """By tag where there is one, else by place."""
    tagged = F.col("locus_tag") != ""
    return F.when(tagged, F.concat(F.lit("tag\x01"), F.col("locus_tag"))).otherwise(F.concat_ws("\x01", F.lit("at"), "record_id", "start", "end"))


def has_xref(prefix: str):
    return F.exists(F.concat("db_xref", "notes"), lambda x: F.startswith(F.lower(F.ltrim(x)), F.lit(prefix)))


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def batch_summary(records: DataFrame, features: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row of 14 columns per file; values of a summary report with the file's stem come first."""
    low = F.lower("type")
    counted = features.withColumn("_id", identity()).withColumn("_low", low)
    is_cds = F.col("_low") == "cds"
    n = lambda cond: F.count_if(cond)
    kinds = ("trna", "tmrna", "rrna", "ncrna", "regulatory")
    main = counted.groupBy("path").agg(
        n(is_cds).alias("cds"), *[n(F.col("_low") == k).alias(k) for k in kinds], n(~F.col("_low").isin("source", "gene")).alias("plain"),
        n(is_cds & has_xref("uniref")).alias("uniref"), n(is_cds & has_xref("refseq")).alias("refseq"), n(is_cds & (F.size("xrefs.cog_ids") > 0)).alias("cogs"),
        n(is_cds & ((F.size("xrefs.kegg_kos") > 0) | has_xref("ko:"))).alias("kos"), n(is_cds & (F.lower(F.trim("product")) == "hypothetical protein")).alias("unknown"),
    )
    ids = counted.groupBy("path", "_id").agg(F.bool_or("is_pseudo").alias("pseudo"), F.bool_or(~F.col("_low").isin("source", "gene")).alias("other"))
    pseudo = ids.groupBy("path").agg(F.count_if("pseudo").alias("pseudogene"), F.count_if(F.col("pseudo") & ~F.col("other")).alias("pseudo_only"))
    size = records.groupBy("path").agg(F.sum("length").alias("bp"), F.sum(gc_percent(F.coalesce("seq", F.lit(""))) * F.col("length")).alias("gc_bp"))
    rows = main.join(pseudo, "path").join(size, "path", "left").withColumn("stem", _stem(F.col("path")))
    if summaries is None:
        rows = rows.withColumn("summary", F.create_map().cast("map<string,double>"))
    else:
        rows = rows.join(summaries.select(_stem(F.col("path")).alias("stem"), "summary"), "stem", "left").withColumn("summary", F.coalesce("summary", F.create_map().cast("map<string,double>")))
    s = lambda k: F.try_element_at(F.col("summary"), F.lit(k))
    count = lambda k, own=None: F.coalesce(s(k).cast("long"), F.col(own or k) if own != "" else F.lit(0))
    heads = {k: count(k) for k in ("cds", *kinds, "pseudogene")} | {k: count(k, "") for k in ("crispr", "sorf", "oric", "oriv", "orit")}
    total = F.lit(0)
    for x in heads.values():
        total = total + x
    bp = F.coalesce(s("genome_size_bp").cast("long"), F.when(F.col("bp") > 0, F.col("bp")))
    gc = F.coalesce(s("gc_content"), F.when(F.col("bp") > 0, F.col("gc_bp") / F.col("bp")))
    # half to even, as the decimal text of most doubles rounds
    text = lambda v, d: F.coalesce(F.format_string(f"%.{d}f", F.bround(v, d)), F.lit(""))
    values = (
        F.col("stem"), text(bp / 1_000_000, 3), F.when(s("cds").isNotNull(), total).otherwise(F.col("plain") + F.col("pseudo_only")), text(gc, 2), heads["cds"], heads["rrna"],
        F.format_string("%d / %d", heads["trna"], heads["tmrna"]), F.col("uniref"), F.col("refseq"), F.col("cogs"), F.col("kos"), F.col("unknown"), heads["pseudogene"], heads["regulatory"],
    )
    return rows.select(*[v.alias(c) for v, c in zip(values, BATCH_COLUMNS)]).orderBy(F.lower(F.col(f"`{BATCH_COLUMNS[0]}`")))


def sequences_by_id(records: DataFrame) -> DataFrame:
    """Upper-case sequence of each record id of a file; of records with one id the last."""
    return records.where("length(seq) > 0").groupBy("path", "record_id").agg(F.max_by(F.upper("seq"), "record_index").alias("seq"))


def genome_report(records: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Bases, GC over all records and, with ``coding``'s rows, coding density over all bases, per file."""
    s = F.upper(F.coalesce("seq", F.lit("")))
    gc, acgt = F.sum(F.regexp_count(s, F.lit("[GC]"))), F.sum(F.regexp_count(s, F.lit("[ACGT]")))
    out = records.groupBy("path").agg(F.sum(F.length(s)).cast("long").alias("bases"), F.when(acgt > 0, 100.0 * gc / acgt).otherwise(F.lit(0.0)).alias("gc"))
    if coverage is not None:
        out = out.join(coverage.groupBy("path").agg(F.sum("coding_bp").alias("coding_bp")), "path", "left").withColumn("coding_density", F.when(F.col("bases") > 0, 100.0 * F.coalesce("coding_bp", F.lit(0)) / F.col("bases")).otherwise(F.lit(0.0)))
    return out
