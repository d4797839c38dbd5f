"""Annotation checks: one projection works out all findings of a feature, then they are exploded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import quals, strand_symbol
from strandline.functions.sequence import byte_each, extract, proteins, table_id
from strandline.sources.scratch import Scratch

EXCEPTIONS = ("transl_except", "exception", "ribosomal_slippage", "frameshift")


def _finding(order, cond, severity, code, message):
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(order).alias("ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message")))


def structural(features: DataFrame) -> DataFrame:
    """Features with an array of the findings that need no sequence."""
    cds = F.col("type") == "CDS"
    return features.select(
        "*",
        F.array(
            _finding(2, (F.col("record_length") > 0) & (F.col("end") > F.col("record_length")), "ERROR", "COORDINATE_OUT_OF_BOUNDS", "ends beyond its record"),
            _finding(3, F.col("length") <= 0, "ERROR", "ZERO_LENGTH_FEATURE", "has no length"),
            _finding(4, cds & (F.col("product") == ""), "WARNING", "MISSING_PRODUCT", "CDS without a product"),
            _finding(5, cds & ~F.col("is_pseudo") & (F.col("translation") == ""), "WARNING", "MISSING_TRANSLATION", "CDS without a translation"),
        ).alias("_found"),
    )


def coding_findings(cds: DataFrame) -> DataFrame:
    """Findings of CDS with ``nt`` (bases from the first codon on, null without a sequence), ``raw_nt_length``-free:
    needs is_pseudo, is_partial, exceptional, transl_table, translation and nt."""
    rows = cds.withColumn("_table", table_id(F.col("transl_table")))
    rows = rows.withColumn("_protein", F.regexp_replace(proteins(F.col("nt"), F.col("_table")), r"\*+$", ""))
    usable = F.col("nt").isNotNull() & ~F.col("is_pseudo")
    normal = usable & ~F.col("exceptional") & ~F.col("is_partial")
    own, computed = F.col("translation"), F.col("_protein")
    # another start codon: the annotation begins with M and agrees from the second residue on
    other_start = (F.length(own) == F.length(computed)) & F.startswith(own, F.lit("M")) & (F.substring(own, 2, 1 << 30) == F.substring(computed, 2, 1 << 30))
    found = F.array(
        _finding(6, usable & F.col("exceptional"), "INFO", "EXCEPTIONAL_TRANSLATION_ANNOTATION", "translated in an exceptional way"),
        _finding(7, usable & ~F.col("is_partial") & (F.length("nt") % 3 != 0), "WARNING", "LENGTH_NOT_DIVISIBLE_BY_THREE", "coding length is no multiple of three"),
        _finding(8, usable & F.col("_table").isNull(), "WARNING", "UNKNOWN_TRANSLATION_TABLE", "unknown translation table"),
        _finding(9, normal & (own != "") & (own != computed) & ~other_start, "WARNING", "CDS_TRANSLATION_MISMATCH", "translation differs from the sequence"),
        _finding(10, normal & F.contains(computed, F.lit("*")), "ERROR", "INTERNAL_STOP_CODON", "stop codon inside"),
    )
    return rows.withColumn("_coding", found).drop("_table", "_protein")


def unordered_findings(features: DataFrame, records: DataFrame) -> DataFrame:
    """``findings`` in no order, with part, record_index, feature_index and ord, which give the report's."""
    place = F.format_string("%s:%d..%d(%s)", "record_id", "start", "end", strand_symbol(F.col("strand")))
    seqs = records.select("path", "record_index", F.upper("seq").alias("_seq"), byte_each(F.upper("seq")).alias("_plain"))
    exceptional = F.lit(False)
    for k in EXCEPTIONS:
        exceptional = exceptional | (F.size(quals(k)) > 0)
    is_cds = F.col("type") == "CDS"
    lost = _finding(11, is_cds & F.col("location").isNull(), "INFO", "TRANSLATION_EXTRACTION_ERROR", "location isn't understood")
    shown = ["path", "record_index", "feature_index", "record_id", "locus_tag", F.col("type").alias("feature_type"), place.alias("coordinates")]
    rows = structural(features).select(*shown, is_cds.alias("_cds"), F.filter(F.concat("_found", F.array(lost)), lambda x: x.isNotNull()).alias("_found"), exceptional.alias("exceptional"), "is_pseudo", "is_partial", "transl_table", "translation", "codon_start", F.col("location.parts").alias("_parts"))
    # only CDS with a place meet bases
    coded = rows.where("_cds and _parts is not null").join(seqs, ["path", "record_index"], "left").withColumn("nt", F.substring(extract(F.col("_seq"), F.col("_parts"), F.col("_plain")), F.col("codon_start"), F.lit(1 << 30))).drop("_seq", "_plain", "_parts")
    shown = ["path", F.lit(1).alias("part"), "record_index", "feature_index", "f.ord", "f.severity", "f.code", "record_id", "locus_tag", "feature_type", "coordinates", "f.message"]
    single = lambda df, found: df.withColumn("f", F.explode(found)).select(*shown)
    single = single(rows, F.col("_found")).unionByName(single(coding_findings(coded), F.filter("_coding", lambda x: x.isNotNull())))
    cds = features.where("type = 'CDS' and locus_tag <> ''")
    twice = cds.groupBy("path", "locus_tag").agg(F.count("*").alias("n"), F.min(F.struct("feature_index", "record_index", "record_id")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature_index", place.alias("p")))), lambda x: x["p"]), ", ").alias("coordinates")).where("n > 1")
    twice = twice.select("path", F.lit(0).alias("part"), F.lit(0).alias("record_index"), F.col("first.feature_index").alias("feature_index"), F.lit(1).alias("ord"), F.lit("WARNING").alias("severity"), F.lit("DUPLICATE_LOCUS_TAG").alias("code"), F.col("first.record_id").alias("record_id"), "locus_tag", F.lit("CDS").alias("feature_type"), "coordinates", F.concat(F.lit("tag of "), F.col("n").cast("string"), F.lit(" CDS")).alias("message"))
    return twice.unionByName(single)


def findings(features: DataFrame, records: DataFrame, keep_order: bool = False) -> DataFrame:
    """severity, code, record_id, locus_tag, feature_type, coordinates and message, in the order of the report;
    ``keep_order``: with the columns that give it."""
    # written first: a sort by ranges looks at its input twice
    found = Scratch(features.sparkSession).keep(unordered_findings(features, records), "findings")
    ordered = found.orderBy("path", "part", "record_index", "feature_index", "ord")
    return ordered if keep_order else ordered.select("path", "severity", "code", "record_id", "locus_tag", "feature_type", "coordinates", "message")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")])
