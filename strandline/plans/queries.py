"""The registry: one query for each operator over the driver's tables, and SQL that an independent engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import derive, dict_view, strand_symbol
from strandline.functions.fixed_values import PATHWAYS
from strandline.functions.sequence import codons, gc_percent, reverse_complement, translate, wrap
from strandline.operators import codon_usage, diffing, gff, intervals, operons, panels, regions, search, sinks, summaries, validation
from strandline.plans import genome_queries, views  # noqa: F401
from strandline.plans.genome_queries import pairs_sql
from strandline.plans.oracles import FEAT, LENGTH, SEQ, code_rows
from strandline.plans.registry import REGISTRY, Query
from strandline.plans.registry import query as _query
from strandline.sources import flatfile

def _flat(df: DataFrame) -> DataFrame:
    return sinks.tsv(df)


_ROW = "record_id AS record, tag AS locus_tag, type, gene, product, st AS start, en AS \"end\", sym AS strand, len AS length, ko AS kegg_ko, ec AS ec_number, cog, pf AS pfam"


@_query(f"WITH {FEAT} SELECT {_ROW} FROM feat WHERE lower(gene) = 'red widget'")
def feat_search_gene(spark, d):
    return _flat(search.search_rows(search.search(views.features(spark, d), gene="RED widget")))


@_query(f"WITH {FEAT} SELECT {_ROW} FROM feat WHERE type = 'CDS' AND contains(lower(product), 'brand#1')")
def feat_search_product_sub(spark, d):
    return _flat(search.search_rows(search.search(views.features(spark, d), product="BRAND#1", ftype="cds")))


@_query(f"WITH {FEAT} SELECT {_ROW} FROM feat WHERE regexp_matches(gene, '(?i)^(small|red) .*g') AND regexp_matches(product, '(?i)promo$')")
def feat_search_regex(spark, d):
    return _flat(search.search_rows(search.search(views.features(spark, d), gene_regex="^(SMALL|red) .*g", product_regex="promo$")))


@_query(f"WITH {FEAT} SELECT {_ROW} FROM feat WHERE cog = 'COG0012' AND contains(ec, '1.1')")
def feat_search_xref(spark, d):
    return _flat(search.search_rows(search.search(views.features(spark, d), cog="cog0012", ec="1.1")))


@_query(f"WITH {FEAT} SELECT fi AS feature_index, go AS go_terms, cog AS cog_ids, ko AS kegg_kos, pf AS pfam, '' AS rfam, ec AS ec_numbers FROM feat")
def feat_xref_extract(spark, d):
    names = ("go_terms", "cog_ids", "kegg_kos", "pfam", "rfam", "ec_numbers")
    return _flat(views.features(spark, d).select("feature_index", *[f"xrefs.{n}" for n in names]))


@_query(f"WITH {FEAT} SELECT uniref AS db_xrefs, count(*) AS n FROM feat GROUP BY 1")
def feat_xref_residual(spark, d):
    return views.features(spark, d).groupBy(F.array_join("xrefs.db_xrefs", ";").alias("db_xrefs")).agg(F.count("*").alias("n"))


@_query(f"WITH {FEAT} SELECT type, count(*) AS n, min(fi) AS first_index FROM feat GROUP BY type")
def feat_type_counts(spark, d):
    return summaries.type_counts(views.features(spark, d)).drop("path")


@_query(f"WITH {FEAT} SELECT sym AS strand, count(*) AS n FROM feat GROUP BY 1")
def feat_strand_counts(spark, d):
    return summaries.strand_counts(views.features(spark, d)).drop("path")


@_query(f"""WITH {FEAT}, c AS (SELECT * FROM feat WHERE type = 'CDS')
    SELECT count(*) AS cds, min(len) AS min_length, max(len) AS max_length, round(avg(len), 6) AS mean_length, (list(len ORDER BY len))[count(*) // 2 + 1] AS median_length,
           count(tag) AS tags, count(DISTINCT tag) AS distinct_tags, min(tag) AS first_tag, max(tag) AS last_tag, count(*) AS named_genes,
           count(*) FILTER (regexp_matches(lower(product), 'hypothetical|domain-containing|duf')) AS hypothetical FROM c""")
def feat_cds_stats(spark, d):
    return summaries.cds_stats(views.features(spark, d)).drop("path").withColumn("mean_length", F.round("mean_length", 6))


@_query(f"""WITH {FEAT}, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY record_index, type <> 'CDS', fi) AS k FROM feat)
    SELECT tag AS locus_tag, record_id, type, fi AS feature_index FROM r WHERE k = 1""")
def feat_find_locus_prefer_cds(spark, d):
    f = views.features(spark, d).select("locus_tag", "record_index", "record_id", "type", "feature_index")
    return search.preferred(f, ["locus_tag"]).drop("record_index")


_PARTS = f"""parts AS (SELECT record_index, st - 1 AS a, CASE WHEN compound THEN half - 5 ELSE en END AS b FROM feat WHERE type = 'CDS'
              UNION ALL SELECT record_index, half + 5, en FROM feat WHERE type = 'CDS' AND compound),
    kept AS (SELECT record_index, greatest(0, a) AS a, least({LENGTH}, b) AS b FROM parts WHERE least({LENGTH}, b) > greatest(0, a)),
    reach AS (SELECT *, max(b) OVER (PARTITION BY record_index ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM kept),
    isl AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY record_index ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM reach),
    uni AS (SELECT record_index, sum(n) AS n FROM (SELECT record_index, k, max(b) - min(a) AS n FROM isl GROUP BY 1, 2) GROUP BY 1),
    sums AS (SELECT record_index, sum(len) AS cds_bp FROM feat WHERE type = 'CDS' GROUP BY 1)"""


@_query(f"""WITH {FEAT}, {_PARTS}
    SELECT 'C' || s_suppkey AS record_id, CAST(coalesce(cds_bp, 0) AS BIGINT) AS cds_bp, CAST(coalesce(n, 0) AS BIGINT) AS coding_bp, round(100.0::DOUBLE * coalesce(n, 0) / {LENGTH}, 6) AS coding_density
    FROM supplier LEFT JOIN sums ON s_suppkey = sums.record_index LEFT JOIN uni ON s_suppkey = uni.record_index""")
def feat_coding_density(spark, d):
    return summaries.coding(views.features(spark, d), views.records(spark, d)).select("record_id", "cds_bp", "coding_bp", F.round("coding_density", 6).alias("coding_density"))


_NEXT = """nxt AS (SELECT *, lead(st) OVER w AS nst, lead(sd) OVER w AS nsd, lead(fi) OVER w AS nfi, lead(tag) OVER w AS ntag FROM feat WHERE type = 'CDS' WINDOW w AS (PARTITION BY record_index ORDER BY st, fi))"""


@_query(f"""WITH {FEAT}, {_NEXT} SELECT record_id, fi AS first_index, nfi AS second_index, tag AS first_tag, ntag AS second_tag, sd AS strand, nst - en - 1 AS gap
    FROM nxt WHERE sd = nsd AND nst - en - 1 BETWEEN -50 AND 150""")
def feat_operon_pairs(spark, d):
    return operons.operon_pairs(views.features(spark, d)).drop("path", "record_index")


@_query(f"""WITH {FEAT}, {_NEXT}, j AS (SELECT *, coalesce(sd = nsd AND nst - en - 1 BETWEEN -50 AND 5000, false) AS pair FROM nxt),
    l AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY record_index ORDER BY st, fi), false) AS joined FROM j),
    k AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY record_index ORDER BY st, fi ROWS UNBOUNDED PRECEDING) AS chain FROM l)
    SELECT record_id, count(*) AS genes, min(st) AS start, max(en) AS "end", min(fi) AS first_index, string_agg(tag, ';' ORDER BY st, fi) AS locus_tags FROM k GROUP BY record_id, chain HAVING count(*) >= 3""")
def feat_operon_clusters(spark, d):
    return operons.operon_clusters(views.features(spark, d), max_gap=5000).drop("path", "record_index")


_RULES = [("size", "Size", 2, ["small", "LARGE"]), ("colour", "Colour", 3, ["red", "blue"]), ("deal", "Deal", 1, ["promo"])]
_HITS = """hits AS (SELECT *, CASE WHEN t LIKE '%small%' OR t LIKE '%large%' THEN 2 ELSE 0 END + CASE WHEN t LIKE '%red%' OR t LIKE '%blue%' THEN 3 ELSE 0 END + CASE WHEN t LIKE '%promo%' THEN 1 ELSE 0 END AS weight
    FROM (SELECT *, lower(gene) || chr(1) || lower(product) || chr(1) || lower('EC:' || ec) AS t FROM feat WHERE type = 'CDS'))"""


def _hits(spark, d, least=1):
    return panels.discovery_hits(views.features(spark, d), rules=_RULES, min_weight=least)


@_query(f"""WITH {FEAT}, {_HITS} SELECT fi AS feature_index, weight,
    concat_ws(';', CASE WHEN t LIKE '%small%' THEN 'size:small' WHEN t LIKE '%large%' THEN 'size:LARGE' END, CASE WHEN t LIKE '%red%' THEN 'colour:red' WHEN t LIKE '%blue%' THEN 'colour:blue' END, CASE WHEN t LIKE '%promo%' THEN 'deal:promo' END) AS matches
    FROM hits WHERE weight >= 2""")
def feat_discovery_hits(spark, d):
    return _hits(spark, d, 2).select("feature_index", "weight", F.array_join(F.transform("matches", lambda m: F.concat(m["rule"], F.lit(":"), m["term"])), ";").alias("matches"))


_ISLANDS = f"""{_HITS}, br AS (SELECT *, CASE WHEN st - lag(en) OVER w <= 5000 THEN 0 ELSE 1 END AS b FROM hits WHERE weight >= 1 WINDOW w AS (PARTITION BY record_index ORDER BY st, fi)),
    ix AS (SELECT *, sum(b) OVER (PARTITION BY record_index ORDER BY st, fi ROWS UNBOUNDED PRECEDING) AS island FROM br),
    mem AS (SELECT *, count(*) OVER (PARTITION BY record_index, island) AS n, sum(weight) OVER (PARTITION BY record_index, island) AS w FROM ix QUALIFY n >= 2 OR w >= 4)"""


@_query(f"""WITH {FEAT}, {_ISLANDS}, a AS (SELECT record_index, record_id, island, min(st) AS start, arg_max(en, (st, fi)) AS "end", count(*) AS genes, sum(weight) AS total_weight FROM mem GROUP BY 1, 2, 3)
    SELECT record_id, start, "end", CAST(genes AS INT) AS genes, CAST(total_weight AS BIGINT) AS total_weight, 'island_' || row_number() OVER (ORDER BY record_index, start) AS cluster_id, "end" - start + 1 AS span FROM a""")
def feat_islands(spark, d):
    return panels.island_summary(panels.discovery_islands(_hits(spark, d))).drop("path", "record_index", "island")


@_query(f"""WITH {FEAT}, {_ISLANDS}, {_NEXT} SELECT a.record_id, a.fi AS first_index, a.nfi AS second_index, a.nst - a.en - 1 AS gap
    FROM nxt a JOIN mem x ON x.fi = a.fi JOIN mem y ON y.fi = a.nfi AND y.island = x.island AND y.record_index = x.record_index WHERE a.sd = a.nsd AND a.nst - a.en - 1 BETWEEN -50 AND 150""")
def feat_island_links(spark, d):
    members = panels.discovery_islands(_hits(spark, d))
    return panels.island_links(members, views.features(spark, d)).select("record_id", "first_index", "second_index", "gap")


_NUM = """num AS (SELECT *, row_number() OVER (PARTITION BY record_index ORDER BY st, fi) - 1 AS i, count(*) OVER (PARTITION BY record_index) AS n FROM feat WHERE type = 'CDS')"""


@_query(f"""WITH {FEAT}, {_NUM} SELECT t.fi AS target_index, c.fi AS feature_index, c.i - t.i AS "offset" FROM num t JOIN num c ON t.record_index = c.record_index AND c.i BETWEEN t.i - 2 AND t.i + 2""")
def feat_neighborhood_linear(spark, d):
    f = views.features(spark, d)
    return intervals.ordinal_window(f.where("type = 'CDS'"), f, 2, False).select("target_index", "feature_index", F.col("offset").cast("long").alias("offset"))


@_query(f"""WITH {FEAT}, {_NUM}, o AS (SELECT record_index, fi, i, n, unnest(range(-3, 4)) AS k FROM num)
    SELECT o.fi AS target_index, c.fi AS feature_index, o.k AS "offset" FROM o JOIN num c ON o.record_index = c.record_index AND c.i = ((o.i + o.k) % o.n + o.n) % o.n""")
def feat_neighborhood_circular(spark, d):
    f = views.features(spark, d)
    return intervals.ordinal_window(f.where("type = 'CDS'"), f, 3, True).select("target_index", "feature_index", F.col("offset").cast("long").alias("offset"))


@_query(f"""WITH {FEAT}, p AS (SELECT a.fi AS array_index, b.fi AS gene_index, CASE WHEN a.en < b.st THEN b.st - a.en WHEN b.en < a.st THEN a.st - b.en ELSE 0 END AS distance
              FROM feat a JOIN feat b ON a.record_index = b.record_index AND b.st <= a.en + 2000 AND b.en >= a.st - 2000 WHERE a.type = 'gene' AND b.type = 'CDS')
    SELECT array_index, count(*) AS n, sum(distance)::BIGINT AS total_distance, min(distance) AS nearest FROM p GROUP BY 1""")
def feat_window_colocalize(spark, d):
    f = views.features(spark, d)
    near = panels.colocated(f.where("type = 'gene'"), f.where("type = 'CDS'"), 2000)
    return near.groupBy(F.col("feature_index").alias("array_index")).agg(F.count("*").alias("n"), F.sum("distance").alias("total_distance"), F.min("distance").alias("nearest"))


@_query(f"""WITH {FEAT} SELECT tag AS locus_tag, count(*) AS n, string_agg(record_id || ':' || st || '..' || en || '(' || sym || ')', ', ' ORDER BY fi) AS places FROM feat WHERE type = 'CDS' GROUP BY tag HAVING count(*) > 1""")
def feat_duplicate_tags(spark, d):
    return search.locus_duplicates(views.features(spark, d)).drop("path")


@_query(f"""WITH {FEAT} SELECT code, count(*) AS n, min(fi) AS first_index FROM (
        SELECT fi, 'COORDINATE_OUT_OF_BOUNDS' AS code FROM feat WHERE en > {LENGTH} UNION ALL SELECT fi, 'ZERO_LENGTH_FEATURE' FROM feat WHERE len <= 0
        UNION ALL SELECT fi, 'MISSING_PRODUCT' FROM feat WHERE type = 'CDS' AND product = '' UNION ALL SELECT fi, 'MISSING_TRANSLATION' FROM feat WHERE type = 'CDS' AND NOT pseudo AND translation = '') GROUP BY code""")
def feat_validate_structural(spark, d):
    rows = validation.structural(views.features(spark, d)).select("feature_index", F.explode(F.filter("_found", lambda x: x.isNotNull())).alias("f"))
    return rows.groupBy("f.code").agg(F.count("*").alias("n"), F.min("feature_index").alias("first_index"))


def _shown(parts):
    return F.array_join(F.transform(parts, lambda p: F.format_string("%d-%d", p["start0"], p["end0"])), ";").alias("parts")


_PART_ROWS = """pr AS (SELECT fi, record_index, sd, 0 AS k, st - 1 AS a, CASE WHEN compound THEN half - 5 ELSE en END AS b FROM feat UNION ALL SELECT fi, record_index, sd, 1, half + 5, en FROM feat WHERE compound)"""


@_query(f"""WITH {FEAT}, {_PART_ROWS}, c AS (SELECT fi, k, greatest(a, 499999) - 499999 AS a, least(b, 700000) - 499999 AS b FROM pr WHERE least(b, 700000) > greatest(a, 499999))
    SELECT fi AS feature_index, string_agg(a || '-' || b, ';' ORDER BY k) AS parts FROM c GROUP BY fi""")
def feat_region_clip(spark, d):
    f = views.features(spark, d).select("feature_index", regions.clip_parts(F.col("location.parts"), F.lit(500_000), F.lit(700_000)).alias("p"))
    return f.where(F.size("p") > 0).select("feature_index", _shown(F.col("p")))


@_query(f"""WITH {FEAT}, {_PART_ROWS}, laps AS (SELECT *, unnest(range(-(a // 100000) - 2, 4)) AS lap FROM pr),
    c AS (SELECT fi, k, sd, greatest(a + lap * 100000, 79999) - 79999 AS a, least(b + lap * 100000, 130000) - 79999 AS b FROM laps WHERE least(b + lap * 100000, 130000) > greatest(a + lap * 100000, 79999))
    SELECT fi AS feature_index, string_agg(a || '-' || b, ';' ORDER BY k, a * sd, b * sd) AS parts FROM c GROUP BY fi""")
def feat_region_circular(spark, d):
    f = views.features(spark, d).select("feature_index", regions.wrap_parts(F.col("location.parts"), F.lit(80_000), F.lit(130_000), F.lit(100_000)).alias("p"))
    return f.where(F.size("p") > 0).select("feature_index", _shown(F.col("p")))


@_query(f"""WITH {FEAT} SELECT concat_ws(chr(9), record_id, 'genbank_gff', type, st, en, '.', sym, CASE WHEN type = 'CDS' THEN CAST(codon_start - 1 AS VARCHAR) ELSE '.' END,
        'ID=' || type || ':' || tag || ';locus_tag=' || tag || ';gene=' || replace(gene, ' ', '%20') || ';product=' || replace(product, ' ', '%20')
        || ';Dbxref=KEGG:' || ko || ';Dbxref=COG:' || cog || ';Dbxref=Pfam:' || pf || ';Dbxref=' || go || ';Dbxref=' || uniref || ';Note=EC:' || ec) AS line
    FROM feat WHERE NOT compound""")
def feat_gff_ordinary(spark, d):
    rows = gff.ordinary_rows(views.features(spark, d))
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))


@_query(f"""WITH {FEAT}, s AS (SELECT fi, codon_start - 1 AS p0, CASE WHEN sd = 1 THEN half - 5 - st + 1 ELSE en - half - 5 END AS first FROM feat WHERE compound AND type = 'CDS')
    SELECT fi AS feature_index, p0 || ';' || ((3 - (((first - p0) % 3) + 3) % 3) % 3) AS phases FROM s""")
def feat_gff_phase(spark, d):
    f = views.features(spark, d).where("is_compound and type = 'CDS'")
    return f.select("feature_index", F.array_join(gff.segment_phases(gff.ordered_segments(), F.col("codon_start") - 1).cast("array<string>"), ";").alias("phases"))


@_query(f"""WITH {FEAT} SELECT record_id AS contig, st AS start, en AS "end", sym AS strand, type, tag AS locus_tag, gene, product, ec AS ec_number, cog, ko AS kegg_ko, pf AS pfam, '' AS rfam, uniref AS db_xref, protein_id FROM feat""")
def feat_annotation_table(spark, d):
    return search.annotation_table(views.features(spark, d))


_CHANGED = f"""chg AS (SELECT * REPLACE (CASE WHEN o % 3 = 0 THEN en + 3 ELSE en END AS en, CASE WHEN o % 7 = 0 THEN product || ' like' ELSE product END AS product, CASE WHEN o % 5 = 0 THEN upper(gene) ELSE gene END AS gene)
    FROM (SELECT *, (st - 1) // 100 AS o FROM feat) WHERE o % 11 <> 0)"""


def _both(spark, d):
    return diffing.cds_of(views.features(spark, d)), diffing.cds_of(views.changed_features(spark, d))


_RANKED = """ro AS (SELECT *, row_number() OVER (PARTITION BY translation ORDER BY fi) AS k FROM feat WHERE type = 'CDS' AND translation <> ''), rn AS (SELECT *, row_number() OVER (PARTITION BY translation ORDER BY fi) AS k FROM chg WHERE type = 'CDS' AND translation <> '')"""


@_query(f"WITH {FEAT}, {_CHANGED}, {_RANKED} SELECT ro.fi AS old_idx, rn.fi AS new_idx FROM ro JOIN rn ON ro.translation = rn.translation AND ro.k = rn.k")
def feat_diff_hash(spark, d):
    return diffing.by_translation(*_both(spark, d)).drop("genome")


_SIDE = "'' AS genome, fi AS idx, record_id AS rid, sd, st, en, tag, protein_id AS pid, translation"
_PAIRS = f"""{FEAT}, {_CHANGED}, od AS (SELECT {_SIDE} FROM feat WHERE type = 'CDS'), ne AS (SELECT {_SIDE} FROM chg WHERE type = 'CDS'), {pairs_sql('od', 'ne')}"""


@_query(f"WITH {_PAIRS} SELECT o AS old_idx, n AS new_idx FROM p1")
def feat_diff_tags(spark, d):
    return diffing.by_key(*_both(spark, d), "locus_tag").drop("genome")


@_query(f"""WITH {_PAIRS} SELECT o AS old_idx, n AS new_idx, tier FROM p""")
def feat_diff_pairs(spark, d):
    return diffing.pair_features(*_both(spark, d)).drop("genome")


@_query(f"""WITH {FEAT}, {_CHANGED}, {_RANKED}, p AS (SELECT ro.fi AS a, rn.fi AS b, ro.record_id <> rn.record_id OR ro.st <> rn.st OR ro.en <> rn.en OR ro.sd <> rn.sd AS moved, ro.product <> rn.product AS prod, ro.gene <> rn.gene AS gen, ro.ko <> rn.ko OR ro.ec <> rn.ec AS xr
              FROM ro JOIN rn ON ro.translation = rn.translation AND ro.k = rn.k)
    SELECT * FROM (SELECT 'boundary_shifted' AS classification, count(*) FILTER (moved) AS n FROM p UNION ALL SELECT 'product_changed', count(*) FILTER (prod) FROM p UNION ALL SELECT 'gene_changed', count(*) FILTER (gen) FROM p UNION ALL SELECT 'xref_changed', count(*) FILTER (xr) FROM p
        UNION ALL SELECT 'unchanged', count(*) FILTER (NOT (moved OR prod OR gen OR xr)) FROM p UNION ALL SELECT 'removed', (SELECT count(*) FROM feat WHERE type = 'CDS') - count(*) FROM p UNION ALL SELECT 'added', (SELECT count(*) FROM chg WHERE type = 'CDS') - count(*) FROM p) WHERE n > 0""")
def feat_diff_classify(spark, d):
    old, new = _both(spark, d)
    pairs = diffing.by_translation(old, new).withColumn("tier", F.lit("translation_hash"))
    return diffing.class_counts(diffing.classify(old, new, pairs)).drop("genome")


@_query(f"WITH {FEAT}, {_CHANGED} SELECT record_id, st AS start, en AS \"end\", sd AS strand FROM feat WHERE type = 'CDS' INTERSECT SELECT record_id, st, en, sd FROM chg WHERE type = 'CDS'")
def feat_diff_shared(spark, d):
    return diffing.shared_coordinates(*_both(spark, d)).drop("genome")


@_query(f"WITH {SEQ} SELECT doc_id, CAST(length(s) AS BIGINT) AS bases, CASE WHEN length(s) > 0 THEN round(100.0::DOUBLE * length(regexp_replace(s, '[AT]', '', 'g')) / length(s), 6) ELSE 0.0 END AS gc FROM seq")
def nt_gc(spark, d):
    return views.sequences(spark, d).select("doc_id", F.length("s").cast("long").alias("bases"), F.round(gc_percent(F.col("s")), 6).alias("gc"))


@_query(f"WITH {SEQ} SELECT doc_id, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS digest FROM seq")
def nt_revcomp(spark, d):
    return views.sequences(spark, d).select("doc_id", F.md5(reverse_complement(F.col("s"))).alias("digest"))


def _code_map(t: int) -> str:
    from strandline.functions.sequence import code_table

    return "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in code_table(t).items()) + "}"


@_query(f"WITH {SEQ} SELECT doc_id, md5(coalesce(array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: coalesce(({_code_map(11)})[c], 'X')), ''), '')) AS digest FROM seq")
def nt_translate(spark, d):
    from strandline.functions.sequence import ambiguous_table

    code = F.create_map(*[F.lit(x) for kv in ambiguous_table(11).items() for x in kv])
    return views.sequences(spark, d).select("doc_id", F.md5(translate(F.col("s"), code)).alias("digest"))


@_query(f"WITH {SEQ} SELECT doc_id, md5('>' || doc_id || chr(10) || rtrim(regexp_replace(s, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM seq")
def nt_fasta_wrap(spark, d):
    return views.sequences(spark, d).select("doc_id", F.md5(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), wrap(F.col("s"), 60))).alias("digest"))


@_query(f"WITH {SEQ} SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, '...')) AS codon FROM seq) GROUP BY 1")
def nt_codon_counts(spark, d):
    return views.sequences(spark, d).select(F.explode(codons(F.col("s"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))


_CODING = f"""{SEQ}, {code_rows()}, cds AS (SELECT doc_id, s, CASE WHEN doc_id % 10 = 4 THEN 4 ELSE 11 END AS table_id, doc_id % 25 = 0 AS pseudo, doc_id % 20 = 1 AS partial, doc_id % 10 = 9 AS unknown, length(s) < 300 OR length(s) % 3 <> 0 AS nontriplet FROM seq),
    used AS (SELECT * FROM cds WHERE NOT pseudo AND NOT partial AND NOT unknown AND NOT nontriplet),
    x AS (SELECT table_id, regexp_extract_all(s, '...') AS c FROM used), y AS (SELECT table_id, unnest(c) AS codon, unnest(range(1, len(c) + 1)) AS i, len(c) AS n FROM x),
    cod AS (SELECT table_id, codon, i = n AS last, count(*) AS k FROM y GROUP BY ALL),
    cnt AS (SELECT cod.table_id, codon, last, aa, stop, family, sum(k) AS n FROM cod JOIN code USING (table_id, codon) GROUP BY ALL)"""


def _cds(spark, d):
    return codon_usage.exclusions(views.coding(spark, d))


@_query(f"WITH {_CODING} SELECT CASE WHEN pseudo THEN 'pseudo' WHEN partial THEN 'partial' WHEN unknown THEN 'unknown_table' WHEN nontriplet THEN 'nontriplet' ELSE 'used' END AS reason, count(*) AS n FROM cds GROUP BY 1")
def nt_codon_exclusions(spark, d):
    return _cds(spark, d).groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


@_query(f"""WITH {_CODING}, t AS (SELECT DISTINCT table_id FROM cds WHERE NOT pseudo AND NOT partial AND NOT unknown), sn AS (SELECT table_id, codon, sum(n) AS n FROM cnt WHERE NOT stop GROUP BY 1, 2),
    f AS (SELECT code.*, coalesce(n, 0) AS n FROM code JOIN t USING (table_id) LEFT JOIN sn USING (table_id, codon) WHERE NOT stop)
    SELECT table_id, aa, codon, CAST(n AS BIGINT) AS count, round(coalesce(1000.0::DOUBLE * n / nullif(sum(n) OVER (), 0), 0), 6) AS per_thousand, round(coalesce(n::DOUBLE * family / nullif(sum(n) OVER (PARTITION BY table_id, aa), 0), 0), 6) AS rscu FROM f""")
def nt_rscu(spark, d):
    return codon_usage.codon_usage(_cds(spark, d)).withColumns({c: F.round(c, 6) for c in ("per_thousand", "rscu")})


_GC = "round(coalesce(100.0::DOUBLE * sum(n) FILTER (NOT stop{c} AND substr(codon, {k}, 1) IN ('G', 'C')) / sum(n) FILTER (NOT stop{c}), 0), 6) AS {name}"


@_query(f"""WITH {_CODING} SELECT CAST(coalesce(sum(n) FILTER (NOT stop), 0) AS BIGINT) AS sense, CAST(coalesce(sum(n) FILTER (stop AND last), 0) AS BIGINT) AS terminal_stops, CAST(coalesce(sum(n) FILTER (stop AND NOT last), 0) AS BIGINT) AS internal_stops, CAST(0 AS BIGINT) AS ambiguous,
    {_GC.format(c='', k=1, name='gc1')}, {_GC.format(c='', k=2, name='gc2')}, {_GC.format(c='', k=3, name='gc3')}, {_GC.format(c=' AND family > 1', k=3, name='gc3s')} FROM cnt""")
def nt_gc123(spark, d):
    return codon_usage.codon_totals(_cds(spark, d)).withColumns({c: F.round(c, 6) for c in ("gc1", "gc2", "gc3", "gc3s")})


@_query(f"""WITH {SEQ}, c AS (SELECT doc_id, s, doc_id % 25 = 0 AS pseudo, doc_id % 20 = 1 AS partial, doc_id % 50 = 2 AS exceptional, doc_id % 10 = 9 AS unknown,
        regexp_replace(coalesce(array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: CASE WHEN doc_id % 10 = 4 THEN ({_code_map(4)})[c] ELSE ({_code_map(11)})[c] END), ''), ''), '[*]+$', '') AS p FROM seq)
    SELECT doc_id, code FROM (
        SELECT doc_id, 'EXCEPTIONAL_TRANSLATION_ANNOTATION' AS code FROM c WHERE NOT pseudo AND exceptional UNION ALL SELECT doc_id, 'LENGTH_NOT_DIVISIBLE_BY_THREE' FROM c WHERE NOT pseudo AND NOT partial AND length(s) % 3 <> 0
        UNION ALL SELECT doc_id, 'UNKNOWN_TRANSLATION_TABLE' FROM c WHERE NOT pseudo AND unknown UNION ALL SELECT doc_id, 'INTERNAL_STOP_CODON' FROM c WHERE NOT pseudo AND NOT unknown AND NOT exceptional AND NOT partial AND contains(p, '*'))""")
def nt_validate_translation(spark, d):
    found = validation.coding_findings(views.coding(spark, d))
    return found.select("doc_id", F.explode(F.filter("_coding", lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.code")


_TARGETS = ["widget", "K00012", "COG0007", "economy", "widget"]


def _target_sql(t: str) -> str:
    return f"lower(gene) = lower('{t}') OR regexp_matches(product, '(?i)(^|[^\\w-]){t}($|[^\\w-])') OR lower(ko) = lower('{t}') OR lower(cog) = lower('{t}') OR ec = '{t}'"


@_query(f"""WITH {FEAT} SELECT 'nation' || s_nationkey || '.gbff' AS path, {', '.join(f'CAST(sum(CASE WHEN {_target_sql(t)} THEN {_TARGETS.count(t)} ELSE 0 END) AS BIGINT) AS {t}' for t in dict.fromkeys(_TARGETS))}
    FROM feat JOIN supplier ON s_suppkey = l_suppkey WHERE type = 'CDS' GROUP BY 1""")
def marker_matrix(spark, d):
    return panels.target_matrix(views.genome_features(spark, d), _TARGETS)


_MARKERS = {"red widget": "Brand#3 PROMO", "gizmo": "Brand#5", "nothing": "no such product"}


@_query(f"""WITH {FEAT}, m(marker, description) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _MARKERS.items())}), g AS (SELECT feat.*, 'nation' || s_nationkey || '.gbff' AS path FROM feat JOIN supplier ON s_suppkey = l_suppkey),
    h AS (SELECT path, marker, count(*) AS n FROM g JOIN m ON lower(gene) = lower(marker) OR lower(product) = lower(description) WHERE type = 'CDS' AND length(translation) >= 5 GROUP BY 1, 2)
    SELECT path, marker, coalesce(n, 0) AS copies, CASE coalesce(n, 0) WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'SINGLE_COPY' ELSE 'MULTI_COPY' END AS status FROM (SELECT DISTINCT path FROM g) CROSS JOIN m LEFT JOIN h USING (path, marker)""")
def marker_panel_status(spark, d):
    f = views.genome_features(spark, d)
    return panels.marker_status(panels.marker_hits(f, _MARKERS, 5), f, _MARKERS)


_STEPS = ", ".join(f"('{p}', {k}, '{r}')" for p, steps in PATHWAYS.items() for k, (_, refs) in enumerate(steps) for r in refs)


@_query(f"""WITH {FEAT}, st(pathway, step, ref) AS (VALUES {_STEPS}), g AS (SELECT feat.*, 'nation' || s_nationkey || '.gbff' AS path FROM feat JOIN supplier ON s_suppkey = l_suppkey WHERE type = 'CDS'),
    r AS (SELECT DISTINCT path, ko AS ref FROM g UNION SELECT DISTINCT path, 'EC:' || ec FROM g), x AS (SELECT path, pathway, count(DISTINCT step) AS n FROM r JOIN st USING (ref) GROUP BY 1, 2), t AS (SELECT pathway, count(DISTINCT step) AS total FROM st GROUP BY 1)
    SELECT path, pathway, coalesce(n, 0) AS steps_present, total AS steps_total, round(100.0::DOUBLE * coalesce(n, 0) / total, 1) AS completeness_pct FROM (SELECT DISTINCT path FROM g) CROSS JOIN t LEFT JOIN x USING (path, pathway)""")
def pathway_completeness(spark, d):
    return panels.pathway_completeness(views.genome_features(spark, d))


@_query(f"""WITH {FEAT}, g AS (SELECT feat.*, 'nation' || s_nationkey || '.gbff' AS path FROM feat JOIN supplier ON s_suppkey = l_suppkey WHERE type = 'CDS')
    SELECT path, count(*) AS total_cds, count(*) AS total_cogs, count(DISTINCT ko) AS unique_kos, count(DISTINCT ec) AS unique_ecs FROM g GROUP BY 1""")
def functional_totals(spark, d):
    return panels.functional_totals(views.genome_features(spark, d))


@_query(f"""WITH {FEAT}, g AS (SELECT feat.*, 'nation' || s_nationkey AS stem FROM feat JOIN supplier ON s_suppkey = l_suppkey),
    ids AS (SELECT stem, tag, bool_or(pseudo) AS ps, bool_or(type <> 'gene') AS other FROM g GROUP BY 1, 2), p AS (SELECT stem, count(*) FILTER (ps) AS n, count(*) FILTER (ps AND NOT other) AS alone FROM ids GROUP BY 1),
    r AS (SELECT 'nation' || s_nationkey AS stem, count(*) * {LENGTH} AS bp FROM supplier GROUP BY 1), c AS (SELECT stem, count(*) FILTER (type = 'CDS') AS cds FROM g GROUP BY 1)
    SELECT stem, cds + alone AS total, cds, n AS pseudogenes, cds AS uniref, cds AS cogs, cds AS kos, '0 / 0' AS trna, bp / 1000000.0::DOUBLE AS mbp FROM c JOIN p USING (stem) JOIN r USING (stem)""")
def genome_summary(spark, d):
    b = summaries.batch_summary(views.genome_records(spark, d), views.genome_features(spark, d))
    names = {"Sample / Isolate": "stem", "Total Gene/Feature Count": "total", "CDS": "cds", "Pseudogenes": "pseudogenes", "Genes assigned to UniRef": "uniref", "Genes assigned to COGs": "cogs", "Genes assigned to KEGG/KO": "kos", "tRNA / tmRNA": "trna"}
    return b.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()], F.col("`Genome Size (Mbp)`").cast("double").alias("mbp"))


@_query(f"""SELECT s_name AS locus, CAST({LENGTH} AS BIGINT) AS length, 'DNA' AS mol_type, CASE WHEN s_suppkey % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology, 'BCT' AS division, '' AS date, 'Genome of ' || s_name AS definition, 'ACC' || s_suppkey AS accession,
    'Organism ' || s_nationkey AS organism, 'test' AS source, '' AS strain FROM supplier""")
def record_metadata(spark, d):
    return summaries.metadata(views.records(spark, d), views.features(spark, d))


@_query(f"WITH {FEAT}, f AS (SELECT count(*) AS n FROM feat) SELECT count(*) AS records, CAST(count(*) * {LENGTH} AS BIGINT) AS total_length, any_value(n) AS total_features FROM supplier, f")
def document_totals(spark, d):
    return summaries.document_totals(views.records(spark, d), views.features(spark, d)).drop("path")


@_query(f"""WITH {FEAT} SELECT fi AS feature_index, '>' || tag || ' gene=' || gene || ' product=' || product || ' [' || record_id || ':' || st || '..' || en || '(' || sym || ')]' || chr(10) || translation AS entry FROM feat WHERE type = 'CDS' AND translation <> ''""")
def feat_protein_fasta(spark, d):
    return sinks.protein_fasta(views.features(spark, d)).drop("path")


@_query(f"WITH {FEAT} SELECT record_id AS contig, fi AS line, type, st AS start, en AS \"end\", sym AS strand, len AS length, tag AS locus_tag, gene, product, protein_id, translation FROM feat")
def feat_dict_view(spark, d):
    return dict_view(views.features(spark, d)).drop("qualifiers")


@_query(f"WITH {FEAT} SELECT record_id, type, st AS start, en AS \"end\", sym AS strand, tag AS locus_tag, len AS length FROM feat")
def flatfile_roundtrip(spark, d):
    """Features written as flatfile text, one file per record, and parsed again."""
    f = views.features(spark, d)
    spans = F.transform("location.parts", lambda p: F.concat((p["start0"] + 1).cast("string"), F.lit(".."), p["end0"].cast("string")))
    inner = F.when(F.size(spans) > 1, F.concat(F.lit("join("), F.array_join(spans, ","), F.lit(")"))).otherwise(spans[0])
    where = F.when(F.col("strand") == -1, F.concat(F.lit("complement("), inner, F.lit(")"))).otherwise(inner)
    text = F.concat(F.lit("     "), F.rpad("type", 16, " "), where, F.lit('\n                     /locus_tag="'), F.col("locus_tag"), F.lit('"\n'))
    body = f.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature_index", text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    head = F.concat(F.lit("LOCUS       "), F.col("record_id"), F.lit(f" {LENGTH} bp    DNA     linear   BCT 01-JAN-2000\nACCESSION   "), F.col("record_id"), F.lit("\nVERSION     "), F.col("record_id"), F.lit("\nFEATURES             Location/Qualifiers\n"))
    files = body.select(F.concat("record_id", F.lit(".gb")).alias("path"), F.concat(head, F.col("t"), F.lit("//\n")).alias("value"))
    _, got = flatfile.tables(flatfile.parse_texts(files))
    return derive(got).select("record_id", "type", "start", "end", strand_symbol(F.col("strand")).alias("strand"), "locus_tag", "length")


@_query(f"WITH {SEQ} SELECT source AS path, CAST(sum(length(s)) AS BIGINT) AS bases, round(coalesce(100.0::DOUBLE * sum(length(regexp_replace(s, '[AT]', '', 'g'))) / nullif(sum(length(s)), 0), 0), 6) AS gc FROM seq GROUP BY 1")
def nt_genome_report(spark, d):
    rows = views.sequences(spark, d).select(F.col("source").alias("path"), F.col("s").alias("seq"))
    return summaries.genome_report(rows).withColumn("gc", F.round("gc", 6))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operon clusters over the order lines: join, derived columns, windows, islands and aggregation."""
    return feat_operon_clusters(spark, sf_dir)
