"""Columns derived from a feature's location and qualifiers, and cross-references, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<start0:bigint,end0:bigint,strand:int,start_fuzzy:string,end_fuzzy:string>"
LOCATION = f"struct<operator:string,parts:array<{PART}>>"
FEATURE_SCHEMA = f"path string, record_id string, record_index int, feature_index bigint, type string, location {LOCATION}, qualifiers map<string,array<string>>, record_length bigint, topology string"


def quals(key: str) -> Column:
    """All values of a qualifier."""
    return F.coalesce(F.try_element_at(F.col("qualifiers"), F.lit(key)), F.array().cast("array<string>"))


def qual(key: str, default: str = "") -> Column:
    """First value of a qualifier, or the default."""
    return F.coalesce(F.try_element_at(quals(key), F.lit(1)), F.lit(default))


def once(c: Column) -> Column:
    """``c``, worked out once a row: an expression is else repeated by each filter above it and wherever it is read. Filters
    on other columns pass below."""
    return F.explode(F.array(c))


def notes_with(prefix: str) -> Column:
    return F.filter(quals("note"), lambda x: F.startswith(x, F.lit(prefix)))


def strand_symbol(strand: Column) -> Column:
    return F.when(strand == 1, "+").when(strand == -1, "-").when(strand == 0, "?").otherwise(".")


# what a typed reference looks like, and by what else the residual ones don't begin
_KO, _COG, _PFAM, _RFAM = r"(?:KEGG:)?(K\d{5})", r"(?:COG:)?(COG\d+)", r"(?:Pfam:)?(PF\d+)", r"(?:Rfam:)?(RF\d+)"
_PREFIXES = ("GO:", "COG", "PF", "RFAM", "Rfam:", "EC:")
_RESIDUAL = f"(?!{'|'.join(_PREFIXES)}|(?i:{'|'.join(x.replace('(K', '(?:K').replace('(C', '(?:C').replace('(P', '(?:P').replace('(R', '(?:R') for x in (_KO, _COG, _PFAM, _RFAM))}))"
_MARK = "\x01"


def xrefs(db_xref: Column, note: Column, ec_number: Column) -> Column:
    """Typed cross-references, each list in order of appearance without repeats.

    The lists are joined, a mark before each entry, and searched as one text: regular expressions run in generated code, functions over
    list entries don't.
    """
    listed = lambda text, regex: F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_MARK}{regex}"), F.lit(1)))
    joined = lambda a: F.concat(F.lit(_MARK), F.array_join(a, _MARK))
    both = joined(F.concat(db_xref, note))
    typed = lambda regex: listed(both, f"(?i:{regex})")
    rest = F.when(F.size(db_xref) > 0, listed(joined(db_xref), f"({_RESIDUAL}[^{_MARK}]*)")).otherwise(F.array().cast("array<string>"))
    return F.struct(
        listed(both, f"(GO:[^{_MARK}]*)").alias("go_terms"),
        typed(_COG).alias("cog_ids"),
        typed(_KO).alias("kegg_kos"),
        typed(_PFAM).alias("pfam"),
        typed(_RFAM).alias("rfam"),
        F.when(F.size(ec_number) > 0, F.array_distinct(ec_number)).otherwise(listed(both, f"EC:([^{_MARK}]*)")).alias("ec_numbers"),
        rest.alias("db_xrefs"),
    )


def derive(features: DataFrame) -> DataFrame:
    """``features`` with coordinates, texts and cross-references as columns, ready to be stored as a flat table."""
    parts = F.col("location.parts")
    strands = F.array_distinct(F.transform(parts, lambda p: p["strand"]))
    low, high = F.array_min(F.transform(parts, lambda p: p["start0"])), F.array_max(F.transform(parts, lambda p: p["end0"]))
    start, end = F.coalesce(low + 1, F.lit(1)).cast("long"), F.coalesce(high, F.lit(0)).cast("long")
    compound = F.coalesce(F.size(parts) > 1, F.lit(False))
    some = lambda k: F.size(quals(k)) > 0
    phase = qual("codon_start").try_cast("int")
    return features.select(
        "*",
        start.alias("start"),
        end.alias("end"),
        F.when(F.size(strands) == 1, F.get(strands, F.lit(0))).alias("strand"),
        F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["end0"] - p["start0"]), F.lit(0)).alias("length"),
        F.greatest(F.lit(0), end - start + 1).alias("genomic_span"),
        compound.alias("is_compound"),
        F.coalesce(F.exists(parts, lambda p: (p["start0"] == low) & (p["start_fuzzy"] == "<")), F.lit(False)).alias("is_partial_start"),
        F.coalesce(F.exists(parts, lambda p: (p["end0"] == high) & (p["end_fuzzy"] == ">")), F.lit(False)).alias("is_partial_end"),
        F.when(compound, F.transform(parts, lambda p: F.struct((p["start0"] + 1).alias("start"), p["end0"].alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("join_segments"),
        *[qual(k).alias(k) for k in ("locus_tag", "gene", "product", "protein_id", "translation")],
        F.when(phase.isin(1, 2, 3), phase).otherwise(F.lit(1)).alias("codon_start"),
        qual("transl_table").alias("transl_table"),
        ((F.lower("type") == "pseudogene") | some("pseudo") | some("pseudogene")).alias("is_pseudo"),
        quals("note").alias("notes"),
        quals("db_xref").alias("db_xref"),
        xrefs(quals("db_xref"), quals("note"), quals("EC_number")).alias("xrefs"),
    ).withColumn("is_partial", F.col("is_partial_start") | F.col("is_partial_end"))


def dict_view(features: DataFrame) -> DataFrame:
    """Flat features under their short names: contig, line (the feature's number), strand as a symbol."""
    return features.select(F.col("record_id").alias("contig"), F.col("feature_index").alias("line"), "type", "start", "end", strand_symbol(F.col("strand")).alias("strand"), "length", "locus_tag", "gene", "product", "protein_id", "translation", "qualifiers")
