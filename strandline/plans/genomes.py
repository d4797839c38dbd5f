"""Documents read as genomes with bases: records, and features of every kind that the operators tell apart.

Each document is a record whose letters are bases; a file has 25 of them. A record of 120 bases or more has up to
thirteen features, whose kind, place and qualifiers follow from the number of the document and of the feature: plain and
joined, partial, over the origin, without a place, without a length, with wrong translations and repeated tags. The same
rules stand as SQL in ``GEN``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import LOCATION, derive
from strandline.functions.sequence import code_table, proteins, reverse_complement
from strandline.plans.views import sequences
from strandline.sources.scratch import Scratch

RECORDS, SLOTS, LEAST = 25, 16, 120
GENES = ("recA", "rpsB", "tnpA", "", "cas9x")
PRODUCTS = ("DNA recombinase A", "IS5 family transposase", "", "hypothetical protein", "phage tail protein", "30S ribosomal protein S2; 50% = x & y, z | w")
CAS_PROTEIN = "MNNLKKLAVVAQWERTYIPASDFGHKLCVNMRST" * 2
CHAPERONE = "MKT" * 20
KINDS = ("source", "gene", "CDS", "CDS", "CDS", "repeat_region", "CDS", "CDS", "CDS", "CDS", "tRNA", "gene", "CDS")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir)
    n, doc = F.octet_length("s"), F.col("doc_id")  # bases are a byte each
    none = F.lit(None).cast("string")
    bases = F.when(doc % 6 == 0, F.replace("s", F.lit("CCC"), F.lit("CNC"))).otherwise(F.col("s"))
    return d.where("s is not null").select(
        F.concat(F.lit("g"), F.floor(doc / RECORDS).cast("string"), F.lit(".gb")).alias("path"), (doc % RECORDS + 1).cast("int").alias("record_index"), F.concat(F.lit("R"), doc.cast("string")).alias("record_id"), F.concat(F.lit("N"), doc.cast("string")).alias("name"),
        F.concat(F.lit("Document "), doc.cast("string")).alias("description"), F.when((doc % 13 != 0) & (n > 0), bases).alias("seq"), n.cast("long").alias("length"), F.when(doc % 2 == 0, "circular").otherwise("linear").alias("topology"), none.alias("molecule_type"),
        F.lit("UNK").alias("division"), none.alias("date"), F.lit("Fictus").alias("organism"), F.lit("made up").alias("source"), F.array(F.concat(F.lit("A"), doc.cast("string"))).alias("accessions"), F.create_map().cast("map<string,string>").alias("annotations"), doc.alias("doc_id"), bases.alias("bases"),
    )


def features(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Flat features, of all types or of one; derived columns come from locations and qualifiers, as after parsing."""
    doc, n = F.col("doc_id"), F.col("length")
    at = lambda place: 1 + (doc * 37 + place * 61) % (n - 100)
    # what is read of the bases is worked out once a record, before its features, which go without the bases
    nt = F.substring("bases", at(2).cast("int"), F.lit(60))
    nt = F.when(doc % 4 >= 2, reverse_complement(nt)).otherwise(nt)
    protein = F.regexp_replace(proteins(nt, F.when((doc % 4).isin(0, 3), F.when(doc % 7 == 0, 4).otherwise(11))), r"\*+$", "")
    r = records(spark, sf_dir).where(n >= LEAST).select("path", "record_id", "record_index", "length", "topology", "doc_id", protein.alias("protein"))
    rows = r.withColumn("k", F.explode(F.array(*[F.lit(i) for i, kind in enumerate(KINDS) if only in (None, kind)])))
    k = F.col("k")
    there = ~((k == 7) & (doc % 2 != 0)) & ~((k == 8) & (doc % 7 != 0)) & ~((k == 9) & (doc % 9 != 0)) & ~(k.isin(11, 12) & (doc % 3 != 0))
    # a gene lies where its CDS does
    place = F.when(k == 1, 2).when(k == 11, 12).otherwise(k)
    rows = rows.where(there).withColumn("p", at(place)).withColumn("kind", F.array(*map(F.lit, KINDS))[k])
    p, back = F.col("p"), F.when(place == 2, doc % 4 >= 2).when(k == 3, doc % 2 == 1).otherwise(k == 6)
    part = lambda a, b, low="": F.struct(F.lit(a).cast("long").alias("start0") if isinstance(a, int) else a.cast("long").alias("start0"), b.cast("long").alias("end0"), F.when(back, -1).otherwise(1).alias("strand"), F.lit(low).alias("start_fuzzy"), F.lit("").alias("end_fuzzy"))
    two = lambda a, b, c, d: F.when(back, F.array(part(c, d), part(a, b))).otherwise(F.array(part(a, b), part(c, d)))
    parts = (
        F.when(k == 0, F.array(part(0, n))).when(place == 2, F.array(part(p - 1, p + 59))).when(k.isin(3, 12), two(p - 1, p + 29, p + 39, p + 69)).when(k == 4, F.array(part(p - 1, p + 44, "<"))).when(k == 5, F.array(part(p - 1, p + 20)))
        .when(k == 6, F.array(part(p - 1, p + 38))).when(k == 7, F.array(part(n - 15, n), part(0, F.lit(15)))).when(k == 8, F.array(part(p, p))).when(k == 10, F.array(part(p - 1, p + 9))).when(k == 11, F.array(part(p - 1, p + 69)))
    )
    operator = F.when(k.isin(3, 7, 12), "join")
    location = F.when(parts.isNotNull(), F.struct(operator.alias("operator"), parts.alias("parts")))
    text = F.concat(F.lit("G"), doc.cast("string"), F.lit("_"), F.when(k == 1, 2).when(k == 11, 12).otherwise(k).cast("string"))
    tag = F.when(k.isin(0, 5, 10), F.lit(None)).when((place == 2) & (doc % 10 == 0), F.concat(F.lit("DUP"), F.floor(doc / RECORDS).cast("string"))).otherwise(text)
    pick = lambda values, i: F.array(*map(F.lit, values))[i.cast("int")]
    gene = F.when(place == 2, pick(GENES, doc % 5)).when(k == 6, F.concat(F.lit("cas"), (doc % 5).cast("string"))).when(k.isin(11, 12), "dnaK")
    named = F.when(k == 2, pick(PRODUCTS, doc % 6)).when(k == 3, "joined product").when(k == 4, "partial one").when(k == 6, F.concat(F.lit("CRISPR-associated protein Cas"), (doc % 5).cast("string"))).when(k == 7, "origin protein").when(k == 9, "lost place").when(k == 12, "DnaK chaperone")
    protein = F.col("protein")
    protein = F.when(k == 2, F.when(doc % 4 == 0, protein).when(doc % 4 == 2, "MKV").when(doc % 4 == 3, F.concat(F.lit("M"), F.substring(protein, 2, 100)))).when(k == 6, CAS_PROTEIN).when(k == 12, CHAPERONE)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c))
    quals = {
        "organism": F.when(k == 0, F.array(F.lit("Fictus"))), "strain": F.when((k == 0) & (doc % 3 == 0), F.array(F.concat(F.lit("S"), doc.cast("string")))), "isolate": F.when((k == 0) & (doc % 3 == 1), F.array(F.concat(F.lit("I"), doc.cast("string")))),
        "locus_tag": one(tag), "gene": one(gene), "product": one(named), "translation": one(protein), "codon_start": F.when((k == 3) & (doc % 3 == 0), F.array(F.lit("2"))),
        "transl_table": F.when((k == 2) & (doc % 7 == 0), F.array(F.lit("4"))).when((k == 2) & (doc % 7 == 1), F.array(F.lit("99"))),
        "pseudo": F.when((k == 2) & (doc % 11 == 0), F.array(F.lit(""))), "exception": F.when((k == 2) & (doc % 17 == 0), F.array(F.lit("ribosomal slippage"))),
        "EC_number": F.when((k == 2) & (doc % 2 == 0), F.array(F.concat(F.lit("2.7.1."), (doc % 4).cast("string")))),
        "note": F.when(k == 2, F.array(F.concat(F.lit("EC:1.1.1."), (doc % 9).cast("string")), F.lit("a, b; c=d"))).when(k == 5, F.array(F.when(doc % 2 == 0, "CRISPR direct repeat").otherwise("inverted repeat"))),
        "db_xref": F.when(k == 2, F.array(F.concat(F.lit("KEGG:K008"), F.lpad((doc % 100).cast("string"), 2, "0")), F.concat(F.lit("UniRef:U"), doc.cast("string")))),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(x).alias("key"), v.cast("array<string>").alias("value")) for x, v in quals.items()]), lambda e: e["value"].isNotNull())
    raw = rows.select(
        "path", "record_id", "record_index", (F.col("record_index") * SLOTS + k).cast("long").alias("feature_index"), F.col("kind").alias("type"), location.cast(LOCATION).alias("location"), F.map_from_entries(entries).alias("qualifiers"), F.col("length").alias("record_length"), "topology"
    )
    # written first, as parsed tables are: else each derived column would work out all of the above again
    return derive(Scratch(spark).keep(raw, "features"))


def _codes(t: int) -> str:
    """A DuckDB map of the codons over A, C, G, T and N that have one meaning."""
    table, out = code_table(t), {}
    for letters in product("ACGTN", repeat=3):
        meanings = {table["".join(c)] for c in product(*("ACGT" if x == "N" else x for x in letters))}
        if len(meanings) == 1:
            out["".join(letters)] = meanings.pop()
    return "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in out.items()) + "}"


def protein_sql(nt: str, table: str) -> str:
    codon = f"CASE WHEN {table} = 4 THEN ({_codes(4)})[c] ELSE ({_codes(11)})[c] END"
    return f"regexp_replace(coalesce(array_to_string(list_transform(regexp_extract_all({nt}, '...'), lambda c: coalesce({codon}, 'X')), ''), ''), '[*]+$', '')"


def bases_sql(parts: str = "parts") -> str:
    """Bases of (a, b) parts in biological order."""
    one = "substr(seq, CAST(x.a + 1 AS INT), CAST(x.b - x.a AS INT))"
    return f"array_to_string(list_transform({parts}, lambda x: CASE WHEN sd = -1 THEN reverse(translate({one}, 'ACGTN', 'TGCAN')) ELSE {one} END), '')"


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_P = lambda a, b: f"{{'a': CAST({a} AS BIGINT), 'b': CAST({b} AS BIGINT)}}"

#: rec: the records; gen: the features with bases (nt) and what the parser derives.
GEN = f"""
    letters AS (SELECT doc_id AS doc, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents WHERE text IS NOT NULL),
    rec AS (SELECT doc, 'g' || (doc // {RECORDS}) || '.gb' AS path, CAST(doc % {RECORDS} + 1 AS INT) AS ri, 'R' || doc AS rid, CASE WHEN doc % 6 = 0 THEN replace(s, 'CCC', 'CNC') ELSE s END AS bases,
                   CASE WHEN doc % 13 <> 0 AND length(s) > 0 THEN CASE WHEN doc % 6 = 0 THEN replace(s, 'CCC', 'CNC') ELSE s END END AS seq, CAST(length(s) AS BIGINT) AS n, CASE WHEN doc % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology FROM letters),
    g0 AS (SELECT *, CASE k WHEN 1 THEN 2 WHEN 11 THEN 12 ELSE k END AS pl FROM (SELECT *, unnest(range(0, {len(KINDS)})) AS k FROM rec WHERE n >= {LEAST})
           WHERE NOT (k = 7 AND doc % 2 <> 0) AND NOT (k = 8 AND doc % 7 <> 0) AND NOT (k = 9 AND doc % 9 <> 0) AND NOT (k IN (11, 12) AND doc % 3 <> 0)),
    g1 AS (SELECT *, 1 + (doc * 37 + pl * 61) % (n - 100) AS p, CASE WHEN pl = 2 THEN doc % 4 >= 2 WHEN k = 3 THEN doc % 2 = 1 ELSE k = 6 END AS back, ({_LIST(KINDS)})[k + 1] AS type FROM g0),
    g2 AS (SELECT *, CASE WHEN k = 9 THEN NULL WHEN back THEN -1 ELSE 1 END AS sd,
                  CASE WHEN k = 0 THEN [{_P(0, 'n')}] WHEN pl = 2 THEN [{_P('p - 1', 'p + 59')}] WHEN k IN (3, 12) THEN CASE WHEN back THEN [{_P('p + 39', 'p + 69')}, {_P('p - 1', 'p + 29')}] ELSE [{_P('p - 1', 'p + 29')}, {_P('p + 39', 'p + 69')}] END
                       WHEN k = 4 THEN [{_P('p - 1', 'p + 44')}] WHEN k = 5 THEN [{_P('p - 1', 'p + 20')}] WHEN k = 6 THEN [{_P('p - 1', 'p + 38')}] WHEN k = 7 THEN [{_P('n - 15', 'n')}, {_P(0, 15)}] WHEN k = 8 THEN [{_P('p', 'p')}] WHEN k = 10 THEN [{_P('p - 1', 'p + 9')}] WHEN k = 11 THEN [{_P('p - 1', 'p + 69')}] END AS parts,
                  CASE WHEN k IN (0, 5, 10) THEN '' WHEN pl = 2 AND doc % 10 = 0 THEN 'DUP' || (doc // {RECORDS}) ELSE 'G' || doc || '_' || pl END AS tag,
                  CASE WHEN pl = 2 THEN ({_LIST(GENES)})[CAST(doc % 5 + 1 AS INT)] WHEN k = 6 THEN 'cas' || doc % 5 WHEN k IN (11, 12) THEN 'dnaK' ELSE '' END AS gene,
                  CASE WHEN k = 2 THEN ({_LIST(PRODUCTS)})[CAST(doc % 6 + 1 AS INT)] WHEN k = 3 THEN 'joined product' WHEN k = 4 THEN 'partial one' WHEN k = 6 THEN 'CRISPR-associated protein Cas' || doc % 5 WHEN k = 7 THEN 'origin protein' WHEN k = 9 THEN 'lost place' WHEN k = 12 THEN 'DnaK chaperone' ELSE '' END AS product,
                  CASE WHEN k = 3 AND doc % 3 = 0 THEN 2 ELSE 1 END AS cstart, CASE WHEN k = 2 AND doc % 7 = 0 THEN 4 WHEN k = 2 AND doc % 7 = 1 THEN NULL ELSE 11 END AS tt,
                  k = 2 AND doc % 11 = 0 AS pseudo, k = 4 AS partial, k = 2 AND doc % 17 = 0 AS exceptional,
                  CASE WHEN k = 2 THEN ['EC:1.1.1.' || doc % 9, 'a, b; c=d'] WHEN k = 5 THEN [CASE WHEN doc % 2 = 0 THEN 'CRISPR direct repeat' ELSE 'inverted repeat' END] ELSE [] END AS notes,
                  CASE WHEN k = 2 THEN ['KEGG:K008' || lpad(CAST(doc % 100 AS VARCHAR), 2, '0'), 'UniRef:U' || doc] ELSE [] END AS dbs, CASE WHEN k = 2 AND doc % 2 = 0 THEN ['2.7.1.' || doc % 4] ELSE [] END AS ec_list,
                  CAST(ri * {SLOTS} + k AS BIGINT) AS fi FROM g1),
    g3 AS (SELECT *, {bases_sql()} AS nt, CASE sd WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END AS sym, coalesce(list_min(list_transform(parts, lambda x: x.a)) + 1, 1) AS st, coalesce(list_max(list_transform(parts, lambda x: x.b)), 0) AS en,
                  coalesce(list_sum(list_transform(parts, lambda x: x.b - x.a)), 0) AS len, coalesce(len(parts) > 1, false) AS compound, substr(bases, CAST(p AS INT), 60) AS own_nt FROM g2),
    g4 AS (SELECT *, CASE WHEN k = 2 THEN {protein_sql("CASE WHEN sd = -1 THEN reverse(translate(own_nt, 'ACGTN', 'TGCAN')) ELSE own_nt END", 'coalesce(tt, 11)')} END AS fit FROM g3),
    gen AS (SELECT * EXCLUDE (fit, own_nt, bases, p, back), CASE WHEN k = 2 THEN CASE doc % 4 WHEN 0 THEN fit WHEN 2 THEN 'MKV' WHEN 3 THEN 'M' || substr(fit, 2, 100) ELSE '' END WHEN k = 6 THEN '{CAS_PROTEIN}' WHEN k = 12 THEN '{CHAPERONE}' ELSE '' END AS translation FROM g4)"""
