"""Features against small dimensions: functional pathways, target matrices, marker panels, discovery rules, CRISPR."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import strand_symbol
from strandline.functions.fixed_values import CAS_KEYWORDS, PATHWAYS, REPEAT_KEYWORDS
from strandline.operators.intervals import distance, islands, range_join
from strandline.operators.operons import operon_pairs
from strandline.sources.dimensions import load_rules, marker_dimension, pathway_dimension
from strandline.sources.scratch import Scratch

# The dimensions below are lists of tens of rows that are part of the program or a user's rule file; broadcasting them
# avoids a cross product by shuffle.


def functional_totals(features: DataFrame) -> DataFrame:
    cds = features.where("type = 'CDS'").select("path", F.size("xrefs.cog_ids").alias("cogs"), F.col("xrefs.kegg_kos").alias("kos"), F.col("xrefs.ec_numbers").alias("ecs"))
    base = cds.groupBy("path").agg(F.count("*").alias("total_cds"), F.sum("cogs").alias("total_cogs"))
    both = cds.select("path", F.explode(F.concat(F.transform("kos", lambda x: F.struct(F.lit("ko").alias("k"), x.alias("v"))), F.transform("ecs", lambda x: F.struct(F.lit("ec").alias("k"), x.alias("v"))))).alias("r"))
    # distinct first, so the counts need one row per reference
    refs = both.select("path", "r.k", "r.v").distinct().groupBy("path").agg(F.count_if(F.col("k") == "ko").alias("unique_kos"), F.count_if(F.col("k") == "ec").alias("unique_ecs"))
    return base.join(refs, "path", "left").na.fill(0)


def pathway_completeness(features: DataFrame) -> DataFrame:
    """Steps of each pathway with any of their references, per file."""
    dim = pathway_dimension(features.sparkSession)
    cds = features.where("type = 'CDS'")
    have = cds.select("path", F.explode(F.concat(F.col("xrefs.kegg_kos"), F.transform("xrefs.ec_numbers", lambda x: F.concat(F.lit("EC:"), x)))).alias("ref"))
    wanted = dim.select("pathway_ord", "pathway", "step_ord", F.explode("refs").alias("ref"))
    met = have.join(F.broadcast(wanted), "ref").select("path", "pathway", "step_ord").distinct().groupBy("path", "pathway").agg(F.count("*").alias("steps_present"))
    sizes = dim.groupBy("pathway_ord", "pathway").agg(F.count("*").alias("steps_total"))
    every = cds.select("path").distinct().join(F.broadcast(sizes))
    out = every.join(met, ["path", "pathway"], "left").na.fill(0, ["steps_present"])
    return out.select("path", "pathway", "steps_present", "steps_total", F.round(100.0 * F.col("steps_present") / F.col("steps_total"), 1).alias("completeness_pct"))


def functional_document(features: DataFrame) -> DataFrame:
    """path and document: the totals and, for each pathway, its steps with the references that are there."""
    wanted = pathway_dimension(features.sparkSession).select(F.explode("refs").alias("ref")).distinct()
    have = features.where("type = 'CDS'").select("path", F.explode(F.concat(F.col("xrefs.kegg_kos"), F.transform("xrefs.ec_numbers", lambda x: F.concat(F.lit("EC:"), x)))).alias("ref"))
    # at most as many as the pathways ask for
    have = have.join(F.broadcast(wanted), "ref").groupBy("path").agg(F.collect_set("ref").alias("have"))
    rows = functional_totals(features).join(have, "path", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))

    def step(name, refs):
        matched = F.filter(F.array(*map(F.lit, refs)), lambda r: F.array_contains("have", r))
        return F.struct(F.lit(name).alias("name"), matched.alias("matched"), F.when(F.size(matched) > 0, "PRESENT").otherwise("ABSENT").alias("status"))

    def pathway(name, steps):
        listed = F.array(*[step(*s) for s in steps])
        n = F.size(F.filter(listed, lambda x: x["status"] == "PRESENT"))
        return F.struct(n.alias("steps_present"), F.lit(len(steps)).alias("steps_total"), F.round(100.0 * n / len(steps), 1).alias("completeness_pct"), listed.alias("steps")).alias(name)

    pathways = F.struct(*[pathway(k, v) for k, v in PATHWAYS.items()])
    return rows.select("path", F.struct(F.col("path").alias("file"), "total_cds", "unique_kos", "unique_ecs", "total_cogs", pathways.alias("pathways")).alias("document"))


def word_in(needle: str, column):
    """The needle as a word of its own: no letter, digit, underscore or hyphen next to it."""
    return F.rlike(column, F.lit(rf"(?iU)(?<![\w-])\Q{needle}\E(?![\w-])"))


def target_matrix(features: DataFrame, targets: list[str]) -> DataFrame:
    """Matching CDS per file and target; a target given twice counts twice. One pass, no join."""
    low = lambda f: F.transform(f"xrefs.{f}", lambda x: F.lower(x))

    def hit(t: str):
        listed = F.array_contains(F.concat(low("kegg_kos"), low("ec_numbers"), low("cog_ids")), t.lower())
        return (F.lower("gene") == t.lower()) | word_in(t, F.col("product")) | listed

    names = list(dict.fromkeys(targets))
    counts = [F.sum(F.when(hit(t), targets.count(t)).otherwise(0)).alias(t) for t in names]
    return features.where("type = 'CDS'").groupBy("path").agg(*counts)


def compare_matrix(features: DataFrame, files: list[str], targets: list[str]) -> DataFrame:
    """ord, Genome, Path and the targets' counts of each file in the order given; files given twice have two rows."""
    stem = F.regexp_replace(F.element_at(F.split("Path", "/"), -1), r"\.[^.]*$", "")
    local = lambda c: F.regexp_replace(c, "^file:/*", "/")
    listed = features.sparkSession.createDataFrame(list(enumerate(files)), "ord int, Path string")
    counts = target_matrix(features, targets).withColumn("path", local(F.col("path")))
    rows = listed.select("ord", stem.alias("Genome"), "Path", local(F.col("Path")).alias("_p")).join(counts.withColumnRenamed("path", "_q"), F.col("_p") == F.col("_q"), "left").na.fill(0)
    return rows.select("ord", "Genome", "Path", *[F.col(f"`{t}`") for t in dict.fromkeys(targets)])


def marker_hits(features: DataFrame, panel: str | dict[str, str] = "core", min_length: int = 50) -> DataFrame:
    """CDS with a long enough translation that match a marker by gene, product or, lacking a gene, words of the product."""
    dim = marker_dimension(features.sparkSession, panel)
    cds = features.where((F.col("type") == "CDS") & (F.col("translation") != "") & (F.length("translation") >= min_length))
    word = F.concat(F.lit(r"(?iU)(?:\Q"), F.col("description"), F.lit(r"\E|\b\Q"), F.col("marker"), F.lit(r"\E\b)(?![\w\-])"))
    match = (F.lower("gene") == F.lower("marker")) | (F.lower("product") == F.lower("description")) | ((F.col("gene") == "") & F.rlike("product", word))
    return cds.join(F.broadcast(dim), match)


def marker_status(hits: DataFrame, features: DataFrame, panel: str | dict[str, str] = "core") -> DataFrame:
    """Copies of every marker of the panel in every file."""
    dim = marker_dimension(features.sparkSession, panel)
    every = features.select("path").distinct().join(F.broadcast(dim))
    n = hits.groupBy("path", "marker").agg(F.count("*").alias("copies"))
    out = every.join(n, ["path", "marker"], "left").na.fill(0, ["copies"])
    return out.select("path", "marker", "copies", F.when(F.col("copies") == 0, "ABSENT").when(F.col("copies") == 1, "SINGLE_COPY").otherwise("MULTI_COPY").alias("status"))


def discovery_hits(features: DataFrame, ruleset: str = "mobilome", rules_file: str | None = None, min_weight: int = 1, rules=None) -> DataFrame:
    """CDS whose rules weigh at least ``min_weight``, with the first matching term of each rule.

    The rules are literals of the plan: one projection over the CDS, no join and no regrouping.
    """
    rules = load_rules(ruleset, rules_file, features.sparkSession) if rules is None else rules
    text = lambda x: F.contains(F.lower("gene"), x) | F.contains(F.lower("product"), x) | F.contains(F.lower(F.array_join("notes", " ")), x)
    found = []
    for name, _, weight, terms in rules:
        first = F.coalesce(*[F.when(text(F.lit(t.lower())), F.lit(t)) for t in terms]) if terms else F.lit(None).cast("string")
        found.append(F.when(first.isNotNull(), F.struct(F.lit(name).alias("rule"), first.alias("term"), F.lit(weight).alias("weight"))))
    matches = F.filter(F.array(*found), lambda x: x.isNotNull())
    hits = features.where("type = 'CDS'").withColumn("matches", matches)
    return hits.withColumn("weight", F.aggregate("matches", F.lit(0), lambda a, x: a + x["weight"])).where(F.col("weight") >= min_weight)


def kept_hits(hits: DataFrame) -> DataFrame:
    """The columns of hits that islands, tables and documents read, written first: they read them several times."""
    columns = ("path", "record_index", "record_id", "feature_index", "start", "end", "strand", "locus_tag", "gene", "product", "matches", "weight")
    return Scratch(hits.sparkSession).keep(hits.select(*columns), "hits")


def discovery_islands(hits: DataFrame, cluster_gap: int = 5000, least_hits: int = 2, least_weight: int = 4) -> DataFrame:
    """Hits with the number of their island on the record; each starts at most ``cluster_gap`` after the one before ends."""
    if cluster_gap < 0:
        raise ValueError("gaps must not be negative")
    by, order = ["path", "record_index"], ["start", "feature_index"]
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = islands(hits, by, order, F.coalesce(F.col("start") - F.lag("end").over(w) > cluster_gap, F.lit(True)))
    own = Window.partitionBy(*by, "island")
    return numbered.withColumn("_n", F.count("*").over(own)).withColumn("_w", F.sum("weight").over(own)).where((F.col("_n") >= least_hits) | (F.col("_w") >= least_weight)).drop("_n", "_w")


def island_summary(members: DataFrame) -> DataFrame:
    """One row per island, named island_k in the order of the file's records and starts."""
    rows = members.groupBy("path", "record_index", "record_id", "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "feature_index")).alias("end"), F.count("*").cast("int").alias("genes"), F.sum("weight").alias("total_weight"))
    k = F.row_number().over(Window.partitionBy("path").orderBy("record_index", "start"))
    return rows.withColumn("cluster_id", F.concat(F.lit("island_"), k.cast("string"))).withColumn("span", F.col("end") - F.col("start") + 1)


def island_links(members: DataFrame, features: DataFrame, operon_gap: int = 150) -> DataFrame:
    """Operon pairs over all CDS of which both lie in one island."""
    m = members.select("path", "record_index", "feature_index", "island")
    first = m.select("path", "record_index", F.col("feature_index").alias("first_index"), "island")
    second = m.select("path", "record_index", F.col("feature_index").alias("second_index"), "island")
    return operon_pairs(features, operon_gap).join(first, ["path", "record_index", "first_index"]).join(second, ["path", "record_index", "second_index", "island"])


def discovery_table(hits: DataFrame, members: DataFrame, keep_order: bool = False) -> DataFrame:
    """One row per hit and matched rule; island cells stay empty outside islands. ``keep_order``: with feature_index and
    rule_no, which give the order."""
    keys = ["path", "record_index", "island"]
    named = members.select(*keys, "feature_index").join(island_summary(members).select(*keys, "cluster_id", F.col("start").alias("cluster_start"), F.col("end").alias("cluster_end")), keys).drop("island")
    rows = hits.join(named, ["path", "record_index", "feature_index"], "left").select("*", F.posexplode_outer("matches").alias("rule_no", "m"))
    dash = _dash
    return rows.select("path", *(["feature_index", "rule_no"] if keep_order else []), F.col("record_id").alias("record"), "cluster_id", "cluster_start", "cluster_end", dash("locus_tag"), dash("gene"), dash("product"), strand_symbol(F.col("strand")).alias("strand"), F.col("m.rule").alias("rule_id"), F.col("m.term").alias("matched_term"), F.col("m.weight").alias("weight"), F.col("weight").alias("total_feature_score"))


_HIT = ("contig", "locus_tag", "gene", "product", "start", "end", "strand", "weight", "matches", "feature_index")


def _dash(c: str) -> Column:
    return F.when(F.col(c) == "", "-").otherwise(F.col(c)).alias(c)


def feature_summary(features: DataFrame, *more: str) -> DataFrame:
    """Eight fields of each feature, empty texts as dashes."""
    return features.select(*more, F.col("record_id").alias("record"), "type", _dash("locus_tag"), _dash("gene"), _dash("product"), "start", "end", strand_symbol(F.col("strand")).alias("strand"))


def discovery_document(features: DataFrame, ruleset: str = "mobilome", rules_file: str | None = None, cluster_gap: int = 5000, operon_gap: int = 150, min_weight: int = 1, rules=None) -> DataFrame:
    """path and document: hits, operon links between hits, and islands with their links and features.

    A document is one row, so a file's hits must fit in a row, as they do for a genome.
    """
    if operon_gap < 0:
        raise ValueError("gaps must not be negative")
    keys = ["path", "record_index"]
    found = kept_hits(discovery_hits(features, ruleset, rules_file, min_weight, rules))
    members = Scratch(features.sparkSession).keep(discovery_islands(found, cluster_gap), "members")

    def shaped(df, *more):
        own = df.withColumn("contig", F.col("record_id")).withColumn("symbol", strand_symbol(F.col("strand")))
        cells = [_dash(c) if c in ("locus_tag", "gene", "product") else F.col("symbol").alias("strand") if c == "strand" else F.col(c) for c in _HIT]
        return own.select(*keys, *more, F.struct(*cells).alias("hit"))

    in_order = lambda rows, by, order, value, name: rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias(name), F.count("*").alias(f"n_{name}"))
    hits = in_order(shaped(found, "feature_index"), ["path"], ["feature_index"], "hit", "hits")
    index = lambda name, *more: found.select(*keys, F.col("feature_index").alias(name), *more)
    pairs = operon_pairs(features, operon_gap).join(index("first_index", "start"), [*keys, "first_index"]).join(index("second_index"), [*keys, "second_index"])
    link = F.struct(F.col("record_id").alias("contig"), _dash("first_tag").alias("first_locus_tag"), _dash("second_tag").alias("second_locus_tag"), F.col("first_index").alias("first_feature_index"), F.col("second_index").alias("second_feature_index"), "gap")
    pairs = Scratch(features.sparkSession).keep(pairs.select(*keys, "start", "first_index", "second_index", link.alias("link")), "links")
    links = in_order(pairs, ["path"], ["record_index", "start", "first_index"], "link", "operon_links")
    at = lambda name: members.select(*keys, F.col("feature_index").alias(name), "island")
    within = pairs.join(at("first_index"), [*keys, "first_index"]).join(at("second_index"), [*keys, "second_index", "island"])
    within = in_order(within, [*keys, "island"], ["start", "first_index"], "link", "links")
    inside = in_order(shaped(members, "island", "start", "feature_index"), [*keys, "island"], ["start", "feature_index"], "hit", "features")
    rows = island_summary(members).join(inside, [*keys, "island"]).join(within, [*keys, "island"], "left")
    rows = rows.withColumn("links", F.coalesce("links", F.array().cast(within.schema["links"].dataType)))
    island = F.struct("cluster_id", F.col("record_id").alias("contig"), "start", "end", "span", "genes", "total_weight", F.col("links").alias("operon_links"), "features")
    islands_ = in_order(rows.select(*keys, "start", island.alias("whole")), ["path"], ["record_index", "start"], "whole", "islands")
    out = features.select("path").distinct().join(hits, "path", "left").join(links, "path", "left").join(islands_, "path", "left").na.fill(0, ["n_hits", "n_islands"])
    listed = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    document = F.struct(
        F.col("path").alias("file"), F.lit(ruleset if rules_file is None else rules_file).alias("ruleset"), F.col("n_hits").alias("total_hits"), F.col("n_islands").alias("total_islands"), F.lit(operon_gap).alias("operon_gap"),
        listed("hits", hits), listed("operon_links", links), listed("islands", islands_),
    )
    return out.select("path", document.alias("document"))


def cas_genes(features: DataFrame) -> DataFrame:
    words = "|".join(map(re.escape, CAS_KEYWORDS))
    return features.where((F.col("type") == "CDS") & F.rlike(F.lower(F.concat_ws(" ", "gene", "product")), F.lit(words)))


def crispr_arrays(features: DataFrame) -> DataFrame:
    words = "|".join(REPEAT_KEYWORDS)
    return features.where((F.col("type") == "repeat_region") & F.rlike(F.lower(F.concat_ws(" ", F.col("product"), F.array_join("notes", " "))), F.lit(words)))


def colocated(arrays: DataFrame, genes: DataFrame, window: int = 15_000) -> DataFrame:
    """Pairs of an array and a gene on one record at most ``window`` apart, by a binned range join."""
    keep = ["path", "record_index", "record_id", "feature_index", "locus_tag", "start", "end"]
    pairs = range_join(arrays.select(*keep), genes.select(*keep), ["path", "record_index"], window, max(window, 1000))
    return pairs.withColumn("distance", distance("start", "end", "r_start", "r_end")).where(F.col("distance") <= window)


def crispr_groups(features: DataFrame, window: int = 15_000) -> DataFrame:
    """Arrays with the Cas genes near them."""
    near = colocated(crispr_arrays(features), cas_genes(features), window)
    return near.groupBy("path", "record_index", "record_id", "feature_index", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("r_feature_index").alias("feature_index"), F.col("r_locus_tag").alias("locus_tag"), "distance"))).alias("cas_genes"), F.count("*").alias("n"))
