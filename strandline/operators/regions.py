"""Cutting a window out of a record: resolving it, clipping and shifting features, wrapping around circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import PART
from strandline.functions.sequence import wrapped_slice
from strandline.operators.intervals import ordinal_window
from strandline.operators.search import resolve

_PARTS = f"array<{PART}>"


def _cut(p: Column, shift: Column, start: Column, end: Column) -> Column:
    """A part moved by ``shift``, within start..end (1-based), from 0 at the window's first base; it becomes exact."""
    a, b = F.greatest(p["start0"] + shift, start - 1), F.least(p["end0"] + shift, end)
    return F.struct((a - start + 1).alias("start0"), (b - start + 1).alias("end0"), p["strand"].alias("strand"), F.lit("").alias("start_fuzzy"), F.lit("").alias("end_fuzzy"))


def clip_parts(parts: Column, start: Column, end: Column) -> Column:
    """Parts of a location within a window of a linear record, empty ones dropped."""
    return F.filter(F.transform(parts, lambda p: _cut(p, F.lit(0), start, end)), lambda p: p["end0"] > p["start0"]).cast(_PARTS)


def wrap_parts(parts: Column, start: Column, end: Column, size: Column) -> Column:
    """The same on a circle: every copy of a part, whole laps away, that meets the window, downwards on the reverse strand."""

    def copies(p):
        laps = F.sequence(F.floor((start - 1 - p["end0"]) / size), F.ceil((end - p["start0"]) / size))
        found = F.array_sort(F.filter(F.transform(laps, lambda k: _cut(p, k * size, start, end)), lambda x: x["end0"] > x["start0"]))
        return F.when(p["strand"] == -1, F.reverse(found)).otherwise(found)

    return F.flatten(F.transform(parts, copies)).cast(_PARTS)


def gene_window(features: DataFrame, name: str, flank_genes: int = 0) -> DataFrame:
    """path, record_index, start and end around a CDS found by tag or gene, with ``flank_genes`` CDS on both sides."""
    target = resolve(features, name, "region").where("type = 'CDS'")
    keys = ["path", "record_index"]
    out = None
    for round_ in (True, False):
        own = target.where(F.coalesce(F.col("topology") == "circular", F.lit(False)) == F.lit(round_))
        near = ordinal_window(own.select(*keys, "feature_index"), features, flank_genes, round_)
        left, right = F.min_by("start", "offset"), F.max_by("end", "offset")
        got = near.groupBy(*keys).agg(left.alias("start"), right.alias("end"), F.first("record_length").alias("size"))
        if round_:
            got = got.withColumn("end", F.when(F.col("end") < F.col("start"), F.col("end") + F.col("size")).otherwise(F.col("end")))
        out = got if out is None else out.unionByName(got)
    return out.select(*keys, "start", "end")


def normalise(windows: DataFrame, records: DataFrame, flank_bp: int = 0) -> DataFrame:
    """Windows (path, record_index, start, end; null for the record's own) within their records."""
    if flank_bp < 0:
        raise ValueError("flanks must not be negative")
    rows = windows.join(records, ["path", "record_index"])
    circular = F.coalesce(F.col("topology") == "circular", F.lit(False))
    a, b = F.coalesce("start", F.lit(1)).cast("long"), F.coalesce("end", "length").cast("long")
    b = F.when(circular & (b < a), b + F.col("length")).otherwise(b)
    rows = rows.withColumn("start", a - flank_bp).withColumn("end", b + flank_bp)
    low = F.greatest(F.lit(1), F.col("start"))
    rows = rows.withColumn("end", F.when(circular, F.col("end")).otherwise(F.least("length", F.greatest(low, F.col("end")))))
    return rows.withColumn("start", F.when(circular, F.col("start")).otherwise(low)).withColumn("circular", circular)


def extract_regions(windows: DataFrame, records: DataFrame, features: DataFrame, flank_bp: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records and features (type, location, qualifiers) of the windows, with local coordinates and where they came from."""
    w = normalise(windows, records, flank_bp)
    seq = F.when(F.col("circular"), wrapped_slice(F.col("seq"), F.col("start"), F.col("end"))).otherwise(F.substring("seq", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")))
    name = F.concat_ws("_", "record_id", F.lit("region"), "start", "end")
    origin = F.create_map(*[x for k, v in (("parent_record", "record_id"), ("parent_start", "start"), ("parent_end", "end")) for x in (F.lit(k), F.col(v).cast("string"))], F.lit("parent_topology"), F.coalesce("topology", F.lit("linear")))
    cut = w.select("path", "record_index", name.alias("record_id"), F.substring(name, 1, 16).alias("name"), F.concat(F.lit("Region of "), "record_id", F.lit(":"), "start", F.lit(".."), "end").alias("description"), seq.alias("seq"), (F.col("end") - F.col("start") + 1).alias("length"), F.lit("linear").alias("topology"), F.lit("DNA").alias("molecule_type"), origin.alias("annotations"))
    span = w.select("path", "record_index", F.col("start").alias("w_start"), F.col("end").alias("w_end"), "circular", F.col("length").alias("w_size"))
    rows = features.join(span, ["path", "record_index"])
    parts = F.when(F.col("circular"), wrap_parts(F.col("location.parts"), F.col("w_start"), F.col("w_end"), F.col("w_size"))).otherwise(clip_parts(F.col("location.parts"), F.col("w_start"), F.col("w_end")))
    rows = rows.withColumn("_parts", parts).where(F.size("_parts") > 0)
    own = F.map_from_arrays(F.array(*map(F.lit, ("original_record", "original_location", "original_start", "original_end"))), F.array(F.array("record_id"), F.array(location_text(F.col("location"))), F.array(F.col("start").cast("string")), F.array(F.col("end").cast("string"))))
    added = F.map_filter(own, lambda k, v: ~F.map_contains_key("qualifiers", k))
    return cut, rows.select("path", "record_index", "feature_index", "type", F.struct(F.col("location.operator").alias("operator"), F.col("_parts").alias("parts")).alias("location"), F.map_concat("qualifiers", added).alias("qualifiers"))


def location_text(location: Column) -> Column:
    """[start0:end0](strand) of each part, with the operator around several."""
    one = lambda p: F.format_string("[%s%d:%s%d](%s)", p["start_fuzzy"], p["start0"], p["end_fuzzy"], p["end0"], F.when(p["strand"] == -1, "-").otherwise("+"))
    text = F.array_join(F.transform(location["parts"], one), ", ")
    return F.when(F.size(location["parts"]) > 1, F.concat(F.coalesce(location["operator"], F.lit("join")), F.lit("{"), text, F.lit("}"))).otherwise(text)
