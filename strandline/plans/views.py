"""The driver's business tables read as annotation tables, so that every operator has data at any scale.

An order line is a feature: its supplier is the record, order and line give the place, quantity the length. Documents are
sequences. The same mapping stands as SQL in ``plans.oracles``.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions.columns import PART, once, xrefs
from strandline.sources.spread import spread

RECORD_LENGTH = 1_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat features. The number of a feature only has to be unique and in order, so it is worked out from the keys
    instead of ranking all rows in one place."""
    line, part = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    quantity = F.col("l_quantity").cast("int")
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 7 + 1
    length = (quantity * 30).cast("long")
    strand = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    end = start + length - 1
    db = F.array(F.concat(F.lit("KEGG:K"), _padded(F.col("p_partkey"), 5)), F.concat(F.lit("COG:COG"), _padded(F.col("p_size"), 4)), F.concat(F.lit("Pfam:PF"), _padded(F.col("p_partkey") % 500, 5)), F.concat(F.lit("GO:"), _padded(F.col("l_suppkey"), 7)), F.concat(F.lit("UniRef:U"), F.col("p_partkey").cast("string")))
    notes = F.array(F.concat(F.lit("EC:"), F.concat_ws(".", (F.col("l_suppkey") % 6 + 1).cast("string"), F.col("l_linenumber").cast("string"), F.lit("1"), (F.col("l_partkey") % 20).cast("string"))))
    none = F.array().cast("array<string>")
    # a third of the features, by part, have two segments with a gap of ten bases in the middle
    half = start - 1 + F.floor(length / 2)
    span = lambda a, b: F.struct(a.alias("start0"), b.alias("end0"), strand.alias("strand"), F.lit("").alias("start_fuzzy"), F.lit("").alias("end_fuzzy"))
    compound = F.col("l_partkey") % 3 == 0
    parts = F.when(compound, F.array(span(start - 1, half - 5), span(half + 5, end))).otherwise(F.array(span(start - 1, end))).cast(f"array<{PART}>")
    segments = F.when(compound, F.array(F.struct(start.alias("start"), (half - 5).alias("end")), F.struct((half + 6).alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 200_000 + F.col("l_partkey") % 200_000) * 64 + quantity
    return j.select(
        F.lit("driver").alias("path"), F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("record_id"), F.col("l_suppkey").cast("int").alias("record_index"), number.alias("feature_index"),
        F.when(F.col("l_returnflag") == "N", "gene").otherwise("CDS").alias("type"), start.alias("start"), end.alias("end"), strand.alias("strand"), F.when(compound, length - 10).otherwise(length).alias("length"), length.alias("genomic_span"),
        F.lit(RECORD_LENGTH).cast("long").alias("record_length"), F.when(F.col("l_suppkey") % 2 == 0, "circular").otherwise("linear").alias("topology"), compound.alias("is_compound"), F.lit(False).alias("is_partial"),
        (F.col("l_partkey") % 40 == 0).alias("is_pseudo"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("locus_tag"), F.col("p_name").alias("gene"), F.concat_ws(" ", "p_brand", "p_type").alias("product"),
        F.concat(F.lit("WP_"), F.col("l_orderkey").cast("string")).alias("protein_id"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).alias("translation"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("codon_start"), F.lit("").alias("transl_table"),
        notes.alias("notes"), db.alias("db_xref"), xrefs(db, notes, none).alias("xrefs"), F.struct(F.when(compound, "join").alias("operator"), parts.alias("parts")).alias("location"), segments.alias("join_segments"),
        F.create_map(F.lit("note"), notes, F.lit("db_xref"), db).alias("qualifiers"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each supplier, without a sequence."""
    s = table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    return s.select(
        F.lit("driver").alias("path"), F.col("s_suppkey").cast("int").alias("record_index"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("record_id"), F.col("s_name").alias("name"), F.concat(F.lit("Genome of "), F.col("s_name")).alias("description"), none.alias("seq"),
        F.lit(RECORD_LENGTH).cast("long").alias("length"), F.when(F.col("s_suppkey") % 2 == 0, "circular").otherwise("linear").alias("topology"), none.alias("molecule_type"), F.lit("BCT").alias("division"), none.alias("date"), F.concat(F.lit("Organism "), F.col("s_nationkey").cast("string")).alias("organism"), F.lit("test").alias("source"),
        F.array(F.concat(F.lit("ACC"), F.col("s_suppkey").cast("string"))).alias("accessions"), F.create_map().cast("map<string,string>").alias("annotations"),
    )


def genome_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features with one file for each nation of suppliers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("record_index"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit(".gbff")).alias("path"))
    return features(spark, sf_dir).drop("path").join(s, "record_index")


def genome_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("record_index"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit(".gbff")).alias("path"))
    return records(spark, sf_dir).drop("path").join(s, "record_index")


def changed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later annotation: some features moved, renamed, given other references, some gone."""
    f = features(spark, sf_dir)
    order = F.floor((F.col("start") - 1) / 100)
    moved = F.when(order % 3 == 0, F.col("end") + 3).otherwise(F.col("end"))
    renamed = F.when(order % 7 == 0, F.concat("product", F.lit(" like"))).otherwise(F.col("product"))
    regened = F.when(order % 5 == 0, F.upper("gene")).otherwise(F.col("gene"))
    return f.where(order % 11 != 0).withColumns({"end": moved, "product": renamed, "gene": regened})


_BASES = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ACGTACGTACGTACGTACGTACGTAC" * 2)
_NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha()) + bytes(range(128, 256))
#: What else is such a letter in small: the Kelvin sign, and the I with a dot, whose dot stays behind.
_LOW = (("\u212a".encode(), b"k"), ("\u0130".encode(), b"i"))


@functools.partial(F.arrow_udf, returnType=StringType())
def _bases(text: pa.Array) -> pa.Array:
    """Letters a to z, small or not, as bases, nothing else."""

    def one(x: bytes) -> bytes:
        if not x.isascii():
            for a, b in _LOW:
                x = x.replace(a, b)
        return x.translate(_BASES, _NO_LETTERS)

    return pa.array([None if x is None else one(x) for x in text.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and s: the letters of each document's text as bases."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "source", once(_bases("text")).alias("s"))


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as a CDS from its first base, with a table and the columns that codon and translation checks read."""
    d = sequences(spark, sf_dir)
    table_id = F.when(F.col("doc_id") % 10 == 9, "99").when(F.col("doc_id") % 10 == 4, "4").otherwise("11")
    return d.select("doc_id", F.lit("driver").alias("path"), F.col("s").alias("nt"), table_id.alias("transl_table"), (F.col("doc_id") % 25 == 0).alias("is_pseudo"), (F.col("doc_id") % 20 == 1).alias("is_partial"), (F.col("doc_id") % 50 == 2).alias("exceptional"), F.lit("").alias("translation"))
