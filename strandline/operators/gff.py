"""GFF3: attribute texts and phases as native expressions, and whole files with unique ids.

Ids are unique through a file: a name that was taken gets the next number. Every row of the output claims a name, and
the claims of one name are numbered where they meet, so nothing gathers a file. Only where a numbered name is also
claimed as such (a tag that ends in ``_2`` beside a repeated one) are that file's names, without their rows, numbered one
after the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.fixed_values import GFF_SOURCE
from strandline.sources.scratch import Scratch

_ENCODED = (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def encode(text: Column) -> Column:
    for a, b in _ENCODED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tail_attributes() -> Column:
    """Attributes after ID and Parent, each with its semicolon in front; keys of several values repeat."""
    one = lambda k, c: F.when(F.col(c) != "", F.array(F.concat(F.lit(f";{k}="), encode(F.col(c))))).otherwise(F.array().cast("array<string>"))
    many = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(f";{k}="), encode(x)))
    values = lambda k: F.coalesce(F.try_element_at(F.col("qualifiers"), F.lit(k)), F.array().cast("array<string>"))
    return F.array_join(F.concat(one("locus_tag", "locus_tag"), one("gene", "gene"), one("product", "product"), many("ec_number", values("EC_number")), many("Dbxref", values("db_xref")), many("Note", values("note")), many("inference", values("inference"))), "")


def gff_strand() -> Column:
    return F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")


def segment_phases(segments: Column, first: Column) -> Column:
    """Phase of each segment in the order of translation: what is left of a codon goes over to the next segment."""
    start = F.struct(first.cast("int").alias("next"), F.array().cast("array<int>").alias("out"))
    step = lambda a, s: F.struct(F.pmod(F.lit(3) - F.pmod((s["end"] - s["start"] + 1).cast("int") - a["next"], F.lit(3)), F.lit(3)).alias("next"), F.concat(a["out"], F.array(a["next"])).alias("out"))
    return F.aggregate(segments, start, step)["out"]


def ordered_segments() -> Column:
    """Segments by start, downwards on the reverse strand."""
    up = F.array_sort("join_segments")
    return F.when(F.col("strand") == -1, F.reverse(up)).otherwise(up)


def ordinary_rows(features: DataFrame) -> DataFrame:
    """Nine columns of features with one span and a tag; ids are ``type:tag`` before repeats are numbered."""
    rows = features.where("not is_compound and locus_tag <> ''")
    phase = F.when(F.col("type") == "CDS", (F.col("codon_start") - 1).cast("string")).otherwise(".")
    return rows.select(F.col("record_id").alias("seqid"), F.lit(GFF_SOURCE).alias("source"), "type", "start", "end", F.lit(".").alias("score"), gff_strand().alias("strand"), phase.alias("phase"), F.concat(F.lit("ID="), encode(F.concat_ws(":", "type", "locus_tag")), tail_attributes()).alias("attributes"))


def _claimed(names: list[str]) -> list[str]:
    """Each name itself, or with the first number from 2 on that makes it new."""
    used, last, out = set(), {}, []
    for wish in names:
        name, k = wish, last.get(wish, 1)
        while name in used:
            k += 1
            name = f"{wish}_{k}"
        last[wish] = k
        used.add(name)
        out.append(name)
    return out


_CLAIM = ["path", "late", "record_index", "feature_index", "sub"]


def unique_names(claims: DataFrame) -> DataFrame:
    """``claims`` with ``name``, made of ``wish``; the order is late, record_index, feature_index, sub."""
    n = F.row_number().over(Window.partitionBy("path", "wish").orderBy(*_CLAIM[1:]))
    named = claims.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("wish")).otherwise(F.concat_ws("_", "wish", F.col("_n").cast("string"))))
    named = Scratch(claims.sparkSession).keep(named, "claims")
    wishes = named.where("_n = 1").select(F.col("path").alias("_path"), F.col("wish").alias("_wish"))
    clashing = named.where("_n > 1").join(wishes, (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_wish")), "left_semi").select("path").distinct()
    if clashing.isEmpty():
        return named.drop("_n")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_CLAIM[1:])
        return pdf.assign(name=_claimed(pdf["wish"].tolist()))[[*_CLAIM, "name"]]

    again = named.select(*_CLAIM, "wish").join(clashing, "path", "left_semi").groupBy("path").applyInPandas(number, "path string, late int, record_index int, feature_index long, sub int, name string")
    return named.drop("_n", "name").join(named.join(clashing, "path", "left_anti").select(*_CLAIM, "name").unionByName(again), _CLAIM)


def gff_body(features: DataFrame) -> DataFrame:
    """path, record_index, feature_index, sub and line of every row of the features."""
    segments, tag, kind, record = ordered_segments(), F.col("locus_tag"), F.col("type"), ["path", "record_id"]
    shaped = features.select(
        *record, "record_index", "feature_index", "type", "locus_tag", "start", "end", "is_compound", "codon_start", gff_strand().alias("strand"), tail_attributes().alias("tail"), segments.alias("segments"),
        segment_phases(segments, F.col("codon_start") - 1).alias("phases"), ((F.col("topology") == "circular") & (F.col("genomic_span") >= F.col("record_length")) & (F.col("record_length") > 0)).alias("around"),
    )
    # untagged features are called by their kind, with a number
    k = F.row_number().over(Window.partitionBy("path", "type").orderBy("record_index", "feature_index"))
    untagged = shaped.where(tag == "").withColumn("base", F.when(k == 1, kind).otherwise(F.concat_ws("_", kind, k.cast("string"))))
    shaped = shaped.where(tag != "").withColumn("base", tag).unionByName(untagged)
    held = shaped.where((kind == "gene") & (tag != "")).select(*record, "locus_tag").distinct().withColumn("held", F.lit(True))
    shaped = shaped.join(held, [*record, "locus_tag"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    is_cds, is_gene = kind == "CDS", kind == "gene"
    real = is_gene & (tag != "")
    above = F.when(is_cds | F.col("held"), "mRNA").otherwise(kind)

    def row(sub, kind, start, end, phase, wish, parent, extra):
        """``parent``: -1 for none, -2 for the gene with the tag, else the sub of the feature's own row above."""
        return F.struct(sub.cast("int").alias("sub"), kind.alias("kind"), start.alias("start"), end.alias("end"), phase.alias("phase"), wish.alias("wish"), parent.cast("int").alias("parent"), extra.alias("extra"))

    name = lambda k: F.concat_ws(":", k, F.col("base"))
    no, dot, none = F.lit(""), F.lit("."), F.lit(-1)
    whole = lambda sub, k, parent: row(F.lit(sub), k, F.col("start"), F.col("end"), dot, name(k), parent, F.when(F.coalesce("around", F.lit(False)), ";origin_spanning=true").otherwise(""))
    plain = row(F.lit(0), kind, F.col("start"), F.col("end"), F.when(is_cds, (F.col("codon_start") - 1).cast("string")).otherwise("."), name(kind), F.when(is_cds & F.col("held"), -2).otherwise(-1), no)
    parts = F.transform(
        F.arrays_zip("segments", "phases"),
        lambda x, i: row(i + 2, kind, x["segments"]["start"], x["segments"]["end"], F.when(is_cds, x["phases"].cast("string")).otherwise("."), F.concat(name(kind), F.lit("."), (i + 1).cast("string")), F.when(is_gene, 0).otherwise(1), no),
    )
    gene = F.lit("gene")
    tops = F.when(is_gene, F.array(whole(0, gene, none))).when(F.col("held"), F.array(whole(1, above, F.lit(-2)))).otherwise(F.array(whole(0, gene, none), whole(1, above, F.lit(0))))
    rows = F.when(F.col("is_compound"), F.concat(tops, parts)).otherwise(F.array(plain))
    claims = shaped.withColumn("late", F.when(real, 0).otherwise(1)).select(*record, "record_index", "feature_index", "locus_tag", "strand", "tail", F.explode(rows).alias("r"), "late")
    claims = claims.select("*", "r.*").drop("r").withColumn("late", F.when(F.col("sub") == 0, F.col("late")).otherwise(1))
    named = unique_names(claims)
    genes = named.where("late = 0").groupBy(*record, "locus_tag").agg(F.min_by("name", F.struct("record_index", "feature_index")).alias("gene_id"))
    named = named.join(genes, [*record, "locus_tag"], "left")
    own = Window.partitionBy("path", "record_index", "feature_index")
    top = lambda sub: F.max(F.when(F.col("sub") == sub, F.col("name"))).over(own)
    parent = F.when(F.col("parent") == -2, F.col("gene_id")).when(F.col("parent") == 0, top(0)).when(F.col("parent") == 1, top(1))
    attributes = F.concat(F.lit("ID="), encode(F.col("name")), F.coalesce(F.concat(F.lit(";Parent="), encode(parent)), no), F.col("tail"), F.col("extra"))
    line = F.concat_ws("\t", "record_id", F.lit(GFF_SOURCE), "kind", F.col("start").cast("string"), F.col("end").cast("string"), dot, "strand", "phase", attributes)
    return named.select("path", "record_index", "feature_index", "sub", line.alias("line"))


def _place(df: DataFrame, part: int, record: Column, line: Column) -> DataFrame:
    zero = lambda c: F.lit(0).cast("long" if c == "feature_index" else "int").alias(c)
    return df.select("path", F.lit(part).alias("part"), record.cast("int").alias("record_index"), zero("feature_index"), zero("sub"), line.alias("line"))


def fasta_lines(records: DataFrame) -> DataFrame:
    """The bases at the end of whole files: a mark for each file and an entry for each record, as in ``unordered_lines``."""
    with_seq = records.where("length(seq) > 0")
    mark = _place(with_seq.select("path").distinct(), 3, F.lit(0), F.lit("##FASTA"))
    return mark.unionByName(_place(with_seq, 4, F.col("record_index"), F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.regexp_replace("seq", "(.{60})(?!$)", "$1\n"))))


def unordered_lines(features: DataFrame, records: DataFrame, include_fasta: bool = False) -> DataFrame:
    """path and line of the whole files, with part, record_index, feature_index and sub, which give the order."""
    body = gff_body(features).select("path", F.lit(2).alias("part"), "record_index", "feature_index", "sub", "line")
    ends = features.groupBy("path", "record_index").agg(F.max("end").alias("most"))
    head = _place(records.select("path").distinct(), 0, F.lit(0), F.lit("##gff-version 3"))
    size = F.when(F.col("length") > 0, F.col("length")).otherwise(F.coalesce("most", F.lit(1)))
    regions = _place(records.join(ends, ["path", "record_index"], "left"), 1, F.col("record_index"), F.concat_ws(" ", F.lit("##sequence-region"), "record_id", F.lit("1"), size.cast("string")))
    out = head.unionByName(regions).unionByName(body)
    return out.unionByName(fasta_lines(records)) if include_fasta else out


def gff_lines(features: DataFrame, records: DataFrame, include_fasta: bool = False) -> DataFrame:
    """``unordered_lines`` in order."""
    return unordered_lines(features, records, include_fasta).orderBy("path", "part", "record_index", "feature_index", "sub")
