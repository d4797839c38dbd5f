"""Command line: ``python -m strandline COMMAND ...``. Each command is one query over the files it is given.

Tables go to the standard output or a file as TSV, CSV or JSON, row by row; a JSON document or a report of one file is one
row. For many files, parse them once with ``ingest`` and work on the stored tables instead.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import strand_symbol
from strandline.operators import codon_usage, diffing, gff, operons, panels, regions, search, sinks, summaries, validation
from strandline.sources import dimensions, flatfile


def _session() -> SparkSession:
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _out(path: str | None):
    return open(path, "w", encoding="utf-8") if path else sys.stdout


def _lines(df: DataFrame, path: str | None, column: str = "line") -> None:
    out = _out(path)
    for row in df.toLocalIterator():
        out.write(row[column] + "\n")
    if path:
        out.close()


def _table(df: DataFrame, path: str | None = None, form: str = "tsv") -> None:
    """Rows as TSV, CSV or one JSON list."""
    out, empty = _out(path), True
    if form == "json":
        for k, row in enumerate(sinks.json_lines(df).toLocalIterator()):
            out.write(("[\n" if k == 0 else ",\n") + row["value"])
            empty = False
        out.write("[]\n" if empty else "\n]\n")
    else:
        flat = sinks.tsv(df)
        import csv

        writer = csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n")
        writer.writerow(flat.columns)
        for row in flat.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
    if path:
        out.close()


def _json(value, path: str | None = None) -> None:
    out = _out(path)
    out.write(json.dumps(value, indent=2) + "\n")
    if path:
        out.close()


def _report(title: str, *sections) -> None:
    """Sections are (heading, lines) with lines as texts or (name, value)."""
    print("=" * 70, f"  {title}", "=" * 70, sep="\n")
    for heading, lines in sections:
        if heading:
            print(f"\n[{heading}]")
        for line in lines:
            print("  " + (f"{line[0]:<22}: {line[1]:,}" if isinstance(line, tuple) and isinstance(line[1], int) else f"{line[0]:<22}: {line[1]}" if isinstance(line, tuple) else line))
    print("=" * 70)


def _one(df: DataFrame) -> dict:
    row = df.first()
    return {} if row is None else row.asDict()


def _read(args, *names: str):
    paths = [getattr(args, n) for n in names or ("input",)]
    got = [flatfile.read_flatfiles(args.spark, p) for p in paths]
    got = [(r.persist(), f.persist()) for r, f in got]
    return got[0] if len(got) == 1 else got


def _many(args, inputs, distinct, strict=True):
    files = flatfile.find_flatfiles(inputs, distinct)
    if not files:
        sys.exit("no annotation files found")
    records, features = flatfile.read_flatfiles(args.spark, *dict.fromkeys(files), strict=strict)
    return files, records.persist(), features.persist()


def _base(path: str, suffix: str) -> str:
    return os.path.splitext(path)[0] + suffix


def validate(args):
    records, features = _read(args)
    if features.isEmpty():
        sys.exit("no features were found")
    found = validation.findings(features, records).drop("path")
    if args.json:
        return _table(found, form="json")
    totals, cds, severity = _one(summaries.document_totals(records, features)), _one(summaries.cds_stats(features)), _one(validation.severity_counts(found.withColumn("path", F.lit(args.input))))
    first = [f"[{r['severity']}] {r['code']} {r['coordinates']}: {r['message']}" for r in found.limit(26).collect()]
    _report(
        "Annotation check",
        ("", [("File", args.input), ("Records", totals["records"]), ("Features", totals["total_features"]), ("Total length (bp)", totals["total_length"])]),
        ("Types", [(r["type"], r["n"]) for r in summaries.type_counts(features).collect()]),
        ("Strands", [(r["strand"], r["n"]) for r in summaries.strand_counts(features).orderBy("strand").collect()]),
        ("CDS", [(k, round(v) if isinstance(v, float) else v) for k, v in cds.items() if k != "path"]),
        ("Findings", [(k, severity.get(k, 0)) for k in ("error", "warning", "info")] + (first[:25] or ["none"]) + (["and more"] if len(first) > 25 else [])),
    )


def summary(args):
    records, features = _read(args)
    _table(summaries.metadata(records, features))
    _table(records.agg(F.count("*").alias("records"), F.sum("length").alias("total_bp")))


def extract(args):
    _table(search.annotation_table(_read(args)[1].orderBy("feature_index")), args.output)


def search_(args):
    keys = ("gene", "product", "ko", "ec", "cog", "pfam", "gene_regex", "product_regex")
    found = search.search(_read(args)[1], **{k: getattr(args, k) for k in keys}, ftype=args.feature).orderBy("feature_index")
    rows = search.search_rows(found)
    # the text form is for reading: it goes to the standard output, with short products
    _table(rows.withColumn("product", F.substring("product", 1, 35)) if args.format == "text" else rows, None if args.format == "text" else args.output, args.format)


def locus(args):
    got = search.resolve(_read(args)[1], args.locus_tag, "locus").drop("path", "_tier")
    if got.isEmpty():
        sys.exit(f"no feature {args.locus_tag}")
    _table(got, form="json")


def neighborhood(args):
    features = _read(args)[1]
    near = search.neighborhood_of(features, args.tag, args.window).orderBy("offset")
    _table(near.select(F.when(F.col("offset") == 0, ">>").otherwise("").alias("target"), "offset", "locus_tag", "gene", "start", "end", strand_symbol(F.col("strand")).alias("strand"), "product"))


def region(args):
    if args.flank_genes < 0 or args.flank_bp < 0:
        raise ValueError("flanks must not be negative")
    records, features = _read(args)
    if args.locus:
        windows = regions.gene_window(features, args.locus, args.flank_genes)
    else:
        chosen = records.where((F.col("record_id") == args.record) | (F.col("name") == args.record)) if args.record else records
        place = lambda v: F.lit(v).cast("long")
        windows = chosen.orderBy("record_index").limit(1).select("path", "record_index", place(args.start).alias("start"), place(args.end).alias("end"))
    cut, inside = regions.extract_regions(windows, records, features, args.flank_bp)
    rows = cut.collect()  # the one region that was asked for
    if not rows:
        raise ValueError("no such region")
    record = rows[0].asDict()
    if args.output and args.output.lower().endswith((".fasta", ".fna", ".fa")):
        text = sinks.region_fasta(cut).first()["entry"] + "\n"
    else:
        own = [{"type": f["type"], "location": f["location"].asDict(), "qualifiers": f["qualifiers"]} for f in inside.orderBy("feature_index").toLocalIterator()]
        text = flatfile.render_record(record, own)
    out = _out(args.output)
    out.write(text)
    if args.output:
        out.close()


def fasta(args):
    _lines(sinks.protein_fasta(_read(args)[1]).orderBy("feature_index"), args.output or _base(args.input, ".faa"), "entry")


def sequence(args):
    records, features = _read(args)
    if records.where("length(seq) > 0").isEmpty():
        return print("No nucleotide sequences.")
    _lines(sinks.genome_fasta(records).orderBy("record_index"), args.fna or _base(args.input, ".fna"), "entry")
    _lines(sinks.cds_fasta(features, records).orderBy("feature_index"), args.ffn or _base(args.input, ".ffn"), "entry")
    coverage = summaries.coding(features, records)
    report, coded = _one(summaries.genome_report(records, coverage)), _one(coverage.groupBy("path").agg(F.sum("cds_bp").alias("cds_bp")))
    _report("Sequences", ("", [("Bases", report["bases"]), ("GC (%)", f"{report['gc']:.2f}"), ("CDS bases, summed", coded["cds_bp"]), ("CDS bases, once", report["coding_bp"]), ("Coding density (%)", f"{report['coding_density']:.2f}")]))


def codon(args):
    records, features = _read(args)
    if records.where("length(seq) > 0").isEmpty():
        raise ValueError("codon usage needs sequences")
    cds = codon_usage.exclusions(codon_usage.coding_sequences(features, records), args.min_len, args.include_pseudo).persist()
    _table(cds.groupBy(F.coalesce("reason", F.lit("evaluated")).alias("outcome")).count())
    _table(codon_usage.codon_totals(cds))
    _table(codon_usage.codon_table(cds).orderBy("TranslationTable", "AminoAcid", "Codon"), args.output)


def functional(args):
    features = _read(args)[1]
    documents = panels.functional_document(features).select(F.col("document").alias("d"))
    found = _one(documents.select(F.to_json("d").alias("value")))
    # a file without CDS has no row
    document = (json.loads(found["value"]) if found else {"total_cds": 0, "unique_kos": 0, "unique_ecs": 0, "total_cogs": 0, "pathways": {}}) | {"file": args.input}
    if args.format == "json":
        return _json({"file": args.input} | document)
    totals = [("File", args.input)] + [(k, document[k]) for k in ("total_cds", "unique_kos", "unique_ecs", "total_cogs")]
    steps = [f"{k:<36} {v['steps_present']:>2}/{v['steps_total']:<2} {v['completeness_pct']:5.1f}%" for k, v in document["pathways"].items()]
    _report("Functions", *([] if args.pathways_only else [("", totals)]), *([] if args.cog_only else [("Pathways", steps)]))


def discover(args):
    if args.cluster_gap < 0 or args.operon_gap < 0:
        raise ValueError("gaps must not be negative")
    features = _read(args)[1]
    if args.format == "tsv":
        hits = panels.discovery_hits(features, args.ruleset, args.rules, args.min_weight).persist()
        rows = panels.discovery_table(hits, panels.discovery_islands(hits, args.cluster_gap), keep_order=True).orderBy("feature_index", "rule_no")
        return _table(rows.drop("path", "feature_index", "rule_no"))
    found = _one(panels.discovery_document(features, args.ruleset, args.rules, args.cluster_gap, args.operon_gap, args.min_weight).select(F.to_json("document").alias("value")))
    document = (json.loads(found["value"]) if found else {"ruleset": args.rules or args.ruleset, "total_hits": 0, "total_islands": 0, "operon_gap": args.operon_gap, "hits": [], "operon_links": [], "islands": []}) | {"file": args.input}
    if args.format == "json":
        return _json({"file": args.input} | document)
    islands = []
    for x in document["islands"]:
        islands.append(f"{x['cluster_id']}: {x['contig']}:{x['start']:,}..{x['end']:,} ({x['span']:,} bp, {x['genes']} genes, weight {x['total_weight']})")
        islands += [f"  [{f['strand']}] {f['locus_tag']} {f['gene']} {f['product'][:35]} ({', '.join(m['rule'] + ':' + m['term'] for m in f['matches'])})" for f in x["features"]]
    _report("Discovery", ("", [("File", args.input), ("Rules", document["ruleset"]), ("Hits", document["total_hits"]), ("Islands", document["total_islands"]), ("Operon links", len(document["operon_links"]))]), ("Islands", islands or ["none"]))


def compare(args):
    targets = [t.strip() for t in args.targets.split(",") if t.strip()]
    files, _, features = _many(args, args.genomes, False)
    absolute = [os.path.abspath(p) for p in files]
    rows = panels.compare_matrix(features, absolute, targets).orderBy("ord").drop("ord")
    given = F.create_map(*[F.lit(x) for kv in zip(absolute, files) for x in kv])  # the files of the command
    _table(rows.withColumn("Path", F.try_element_at(given, F.col("Path"))), args.output)


def _change(r: dict) -> dict:
    """A row of the report as its document shows it: only what is there."""
    out = {k: r[k] for k in ("record", "old_locus", "new_locus", "old_coordinates", "new_coordinates") if r[k] is not None}
    if r["tier"] is not None:
        out["match"] = r["tier"]
    out["classification"] = r["classes"]
    out |= {k: r[k] for k in ("old_product", "new_product", "old_gene", "new_gene") if r[k] is not None}
    if r["xref_changes"] is not None:
        out["xref_changes"] = {k: v.asDict() for k, v in r["xref_changes"].asDict().items() if v is not None}
    return out


def diff(args):
    (_, old), (_, new) = _read(args, "old", "new")
    a, b = diffing.cds_of(old).persist(), diffing.cds_of(new).persist()
    changes = diffing.classify(a, b, diffing.pair_features(a, b)).persist()
    counts = _one(diffing.diff_counts(a, b, changes)) or dict.fromkeys(diffing.COUNTS, 0)
    kinds = {"boundary_shifted": "boundary_shifted_cds", "product_changed": "product_name_changes", "gene_changed": "gene_name_changes", "xref_changed": "xref_changes", "unchanged": "unchanged"}
    result = {"old_file": args.old, "new_file": args.new} | {k: counts[k] for k in diffing.COUNTS if k != "unchanged"}
    result["classification_counts"] = {k: counts[v] for k, v in kinds.items() if counts[v]} | {"removed": counts["removed_cds"], "added": counts["added_cds"]}
    if args.format != "json":
        shown = [("Old", args.old), ("New", args.new), ("CDS", f"{counts['old_cds_count']} -> {counts['new_cds_count']}")] + [(k, counts[k]) for k in diffing.COUNTS[2:]]
        return _report("Annotations compared", ("", shown))
    lists: dict[str, list] = {k: [] for k in ("changes", "product_changes", "gene_changes", "xref_changes", "boundary_shifts", "added", "removed")}
    for r in diffing.first_changes(changes).orderBy("list", "k").toLocalIterator():  # 500 rows at most
        lists[r["list"]].append(_change(r.asDict()))
    _json(result | {"changes": lists.pop("changes"), "details": lists}, args.output)


def phylo(args):
    features = _read(args)[1]
    hits = panels.marker_hits(features, args.markers, args.min_length).persist()
    _table(panels.marker_status(hits, features, args.markers).drop("path").orderBy("marker"))
    wrong = hits.where("lower(gene) = lower(marker) and product <> '' and lower(product) <> lower(description)")
    _table(hits.select("marker", "locus_tag", F.length("translation").alias("aa"), "product").orderBy("marker"))
    _table(wrong.select("marker", "locus_tag", "product", "description"))
    if args.output_dir:
        os.makedirs(args.output_dir, exist_ok=True)
        for (marker,) in hits.select("marker").distinct().collect():  # of a panel of tens
            _lines(sinks.marker_fasta(hits.where(F.col("marker") == marker)), os.path.join(args.output_dir, f"{marker}.faa"), "entry")


def crispr(args):
    features = _read(args)[1]
    _table(panels.feature_summary(panels.crispr_arrays(features)))
    _table(panels.feature_summary(panels.cas_genes(features)))
    _table(panels.crispr_groups(features, args.window).select("record_id", "start", "end", "n", F.to_json("cas_genes").alias("cas_genes")))


def gff_(args):
    records, features = _read(args)
    _lines(gff.gff_lines(features, records, args.include_fasta), args.output)


def batch_summary(args):
    files, records, features = _many(args, args.inputs, True, strict=False)
    local = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")
    good = {local(r["path"]) for r in records.select("path").distinct().collect()}  # one row per file
    for f in files:
        if f not in good:
            print(f"Warning: {f} can't be read and is left out", file=sys.stderr)
    reports = [p for p in (_base(f, ".txt") for f in files) if os.path.exists(p)]
    rows = summaries.batch_summary(records, features, dimensions.read_summaries(args.spark, *reports) if reports else None).persist()
    _table(rows, args.csv, "csv")
    _table(rows, args.tsv)
    head = args.spark.createDataFrame([("| " + " | ".join(rows.columns) + " |",), ("|" + " --- |" * len(rows.columns),)], "line string")
    out = _out(args.md)
    for part in (head, sinks.markdown_rows(rows)):
        for r in part.toLocalIterator():
            out.write(r["line"] + "\n")
    out.close()


def operons_(args):
    features = _read(args)[1]
    _table(operons.operon_pairs(features, args.max_gap, args.min_gap).drop("path", "record_index"))
    _table(operons.operon_clusters(features, args.max_gap, args.min_gap).drop("path", "record_index"))


def ingest(args):
    # one set of inputs has one place, so that a second run replaces the first
    records, features = flatfile.read_flatfiles(args.spark, *args.inputs)
    batch = hashlib.sha256("\n".join(sorted(args.inputs)).encode()).hexdigest()[:16]
    records.write.mode("overwrite").parquet(f"{args.lake}/records/batch={batch}")
    features.write.mode("overwrite").parquet(f"{args.lake}/features/batch={batch}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Queries over annotation flatfiles.")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name, run, *args, aliases=()):
        c = commands.add_parser(name, aliases=list(aliases))
        c.set_defaults(run=run)
        for names, options in args:
            c.add_argument(*([names] if isinstance(names, str) else names), **options)

    arg = lambda name, **o: (name, o)
    number = lambda name, default: arg(name, type=int, default=default)
    inp, out = arg("input"), arg("output", nargs="?")
    add("validate", validate, inp, arg("--json", action="store_true"))
    add("summary", summary, inp, aliases=("metadata",))
    add("extract", extract, inp, out)
    add("search", search_, inp, *[arg(f"--{k}") for k in ("gene", "product", "ko", "ec", "cog", "pfam", "feature", "gene-regex", "product-regex", "output")], arg("--format", choices=("text", "tsv", "csv", "json"), default="text"))
    add("locus", locus, inp, arg("locus_tag"))
    add("neighborhood", neighborhood, inp, arg("tag"), arg("window", nargs="?", type=int, default=5))
    add("region", region, inp, arg("--locus"), arg("--record"), arg("--start", type=int), arg("--end", type=int), number("--flank-genes", 0), number("--flank-bp", 0), arg("--rebase", action="store_true"), arg("--output"))
    add("fasta", fasta, inp, out)
    add("sequence", sequence, inp, arg("--fna"), arg("--ffn"))
    add("codon", codon, inp, number("--min-len", 100), arg("--output"), arg("--include-pseudo", action="store_true"))
    add("functional", functional, inp, arg("--format", choices=("tsv", "json"), default="tsv"), arg("--pathways-only", action="store_true"), arg("--cog-only", action="store_true"))
    add("discover", discover, inp, number("--cluster-gap", 5000), number("--operon-gap", 150), number("--min-weight", 1), arg("--format", choices=("text", "json", "tsv"), default="text"), arg("--ruleset", default="mobilome"), arg("--rules"))
    add("compare", compare, arg("genomes", nargs="+"), arg("--targets", required=True), arg("--output"))
    add("diff", diff, arg("old"), arg("new"), arg("--format", choices=("text", "json"), default="text"), arg("--output"))
    add("phylo", phylo, inp, arg("--markers", choices=("core", "housekeeping", "all"), default="core"), number("--min-length", 50), arg("--output-dir"))
    add("crispr", crispr, inp, number("--window", 15_000))
    add("gff", gff_, inp, out, arg("--include-fasta", action="store_true"))
    add("batch-summary", batch_summary, arg("inputs", nargs="+"), arg("--csv", default="batch_summary.csv"), arg("--tsv", default="batch_summary.tsv"), arg("--md", default="batch_summary.md"))
    add("operons", operons_, inp, arg("max_gap", nargs="?", type=int, default=150), number("--min-gap", -50))
    add("ingest", ingest, arg("inputs", nargs="+"), arg("--lake", required=True))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.spark = _session()
    args.run(args)
    return 0
