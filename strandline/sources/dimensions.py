"""Small dimensions: discovery rules, markers, pathways, and summary reports that lie next to flatfiles."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.fixed_values import CORE_MARKERS, HOUSEKEEPING_MARKERS, PATHWAYS, RULESETS, SUMMARY_KEYS, SUMMARY_LINE


def _rules_text(rules_file: str, spark: SparkSession | None) -> str:
    """Of a file of the driver's or, with a session, of any that Spark reads."""
    if os.path.exists(rules_file):
        with open(rules_file, encoding="utf-8") as f:
            return f.read()
    if spark is None:
        raise FileNotFoundError(rules_file)
    path = spark._jvm.org.apache.hadoop.fs.Path(rules_file)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(rules_file)
    return spark.read.text(rules_file, wholetext=True).first()["value"]


def load_rules(ruleset: str = "mobilome", rules_file: str | None = None, spark: SparkSession | None = None) -> list[tuple[str, str, int, list[str]]]:
    """Rules of a named set or of a YAML or JSON file: a list of objects with id, category, weight and terms."""
    if rules_file is None:
        if ruleset not in RULESETS:
            raise ValueError(f"no rule set {ruleset}")
        return RULESETS[ruleset]
    text = _rules_text(rules_file, spark)
    if rules_file.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("rules in YAML need the yaml package; JSON works without") from e
        rules = yaml.safe_load(text)
    else:
        rules = json.loads(text)
    if not isinstance(rules, list):
        raise TypeError("rules must be a list")
    return [(str(r["id"]), str(r.get("category", "")), int(r.get("weight", 1)), [str(t) for t in r.get("terms", [])]) for r in rules]


def rule_dimension(spark: SparkSession, ruleset: str = "mobilome", rules_file: str | None = None) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(load_rules(ruleset, rules_file, spark))]
    return spark.createDataFrame(rows, "rule_ord int, id string, category string, weight int, terms array<string>")


def markers(panel: str = "core") -> dict[str, str]:
    """Marker genes and products of the panel: core, housekeeping or all."""
    if panel not in ("core", "housekeeping", "all"):
        raise ValueError(f"no marker panel {panel}")
    return (CORE_MARKERS if panel != "housekeeping" else {}) | (HOUSEKEEPING_MARKERS if panel != "core" else {})


def marker_dimension(spark: SparkSession, panel: str | dict[str, str] = "core") -> DataFrame:
    """Marker and description of a named panel or of one that is given."""
    chosen = panel if isinstance(panel, dict) else markers(panel)
    return spark.createDataFrame(sorted(chosen.items()), "marker string, description string")


def pathway_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, p, k, step, refs) for i, (p, steps) in enumerate(PATHWAYS.items()) for k, (step, refs) in enumerate(steps)]
    return spark.createDataFrame(rows, "pathway_ord int, pathway string, step_ord int, step string, refs array<string>")


def parse_summaries(lines: DataFrame) -> DataFrame:
    """path and summary (metric to number) from lines (path, value) of summary reports; the last of a metric counts."""
    keys = F.create_map(*[F.lit(x) for kv in SUMMARY_KEYS.items() for x in kv])
    raw = F.regexp_replace(F.lower(F.trim(F.regexp_extract("value", SUMMARY_LINE, 1))), r"\s+", " ")
    rows = lines.select("path", "pos", F.try_element_at(keys, raw).alias("metric"), F.replace(F.regexp_extract("value", SUMMARY_LINE, 2), F.lit(",")).try_cast("double").alias("number"))
    last = rows.where("metric is not null and number is not null").groupBy("path", "metric").agg(F.max_by("number", "pos").alias("number"))
    number = F.when(F.col("metric") == "gc_content", F.col("number")).otherwise(F.floor("number").cast("double"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("metric", number.alias("number")))).alias("summary"))


def read_summaries(spark: SparkSession, *paths: str) -> DataFrame:
    text = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return parse_summaries(text)
