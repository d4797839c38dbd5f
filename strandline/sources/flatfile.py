"""Annotation flatfiles as ``records`` and ``features`` tables, and a writer for round trips."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.columns import LOCATION, derive
from strandline.functions.fixed_values import FLATFILE_SUFFIXES
from strandline.sources.locations import Part, parse_location, render_location
from strandline.sources.scratch import Scratch

RECORD_COLUMNS = "path string, record_index int, record_id string, name string, description string, seq string, length bigint, topology string, molecule_type string, division string, date string, organism string, source string, accessions array<string>, annotations map<string,string>"
_PARSED = f"{RECORD_COLUMNS}, features array<struct<type:string,location:{LOCATION},qualifiers:map<string,array<string>>>>"
_QUALIFIER = re.compile(r"/([^=\s]+)(?:=(.*))?\Z", re.S)


def _sections(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    """Keyword and lines of each section; keywords stand in the first twelve columns."""
    key, own = None, []
    for line in lines:
        if line[:1] not in ("", " "):
            if key is not None:
                yield key, own
            key, own = line[:12].strip().split(" ")[0], [line[12:] if line[:12].strip() == line[:12].strip().split(" ")[0] else line[len(line.split(" ")[0]) :]]
        elif key is not None:
            own.append(line)
    if key is not None:
        yield key, own


def _locus(line: str) -> dict:
    words = line.split()
    out = {"name": words[0] if words else "", "length": None, "molecule_type": None, "topology": None, "division": None, "date": None}
    unit = next((i for i, w in enumerate(words) if w in ("bp", "aa", "rc") and i and words[i - 1].isdigit()), None)
    if unit is not None:
        out["length"] = int(words[unit - 1])
        for w in words[unit + 1 :]:
            if w in ("linear", "circular"):
                out["topology"] = w
            elif re.fullmatch(r"\d{1,2}-[A-Za-z]{3}-\d{4}", w):
                out["date"] = w
            elif re.fullmatch(r"[A-Z]{3}", w) and out["molecule_type"]:
                out["division"] = w
            elif out["molecule_type"] is None:
                out["molecule_type"] = w
    return out


def _value(key: str, raw: str | None) -> str:
    if raw is None:
        return ""
    text = raw.strip()
    if text.startswith('"'):
        text = text[1:-1] if text.endswith('"') and len(text) > 1 else text[1:]
        text = text.replace('""', '"')
    lines = [x.strip() for x in text.split("\n")]
    return "".join("".join(lines).split()) if key == "translation" else " ".join(lines)


def _features(lines: list[str]) -> Iterator[tuple[str, str, dict[str, list[str]]]]:
    """Type, location text and qualifiers; keys stand in column 6, the rest from column 22."""
    entries: list[tuple[str, list[str]]] = []
    for line in lines:
        if line[5:6].strip() and line[:5].strip() == "":
            entries.append((line[5:21].strip(), [line[21:]]))
        elif entries and line.strip():
            entries[-1][1].append(line[21:] if not line[:21].strip() else line.strip())
    for kind, body in entries:
        location, quals, at = [], {}, 0
        while at < len(body) and not body[at].lstrip().startswith("/"):
            location.append(body[at].strip())
            at += 1
        while at < len(body):
            text = [body[at].strip()]
            at += 1
            # a quoted value goes on until its quotes are even; others until the next qualifier
            quoted = '="' in text[0]
            while at < len(body) and (("\n".join(text).count('"') % 2 == 1) if quoted else not body[at].lstrip().startswith("/")):
                text.append(body[at].strip())
                at += 1
            m = _QUALIFIER.match("\n".join(text))
            if m:
                quals.setdefault(m[1], []).append(_value(m[1], m[2]))
        yield kind, "".join(location), quals


def parse_record(text: str) -> dict | None:
    """One record of a flatfile; None for text without a LOCUS line."""
    rec: dict = {"annotations": {}, "accessions": [], "features": [], "seq": None, "description": "", "organism": "", "source": ""}
    version, raw = "", []
    for key, lines in _sections(text.split("\n")):
        joined = " ".join(x.strip() for x in lines if x.strip())
        if key == "LOCUS":
            rec |= _locus(lines[0])
        elif key == "DEFINITION":
            rec["description"] = joined.removesuffix(".")
        elif key == "ACCESSION":
            rec["accessions"] = joined.split()
        elif key == "VERSION":
            version = joined.split(" ")[0]
        elif key == "SOURCE":
            head = [x for x in lines if not x.lstrip().startswith("ORGANISM")]
            rec["source"] = head[0].strip() if head else ""
            rec["organism"] = next((x.strip()[len("ORGANISM") :].strip() for x in lines if x.lstrip().startswith("ORGANISM")), "")
        elif key == "FEATURES":
            raw = list(_features(lines[1:]))
        elif key == "ORIGIN":
            rec["seq"] = re.sub(r"[\d\s]", "", "".join(lines[1:])).upper() or None
        elif key in ("COMMENT", "KEYWORDS", "DBLINK"):
            rec["annotations"][key.lower()] = joined
    if "name" not in rec:
        return None
    identity = version or (rec["accessions"][0] if rec["accessions"] else "") or rec["name"]
    rec["record_id"] = rec["name"] if identity in ("", ".") else identity
    rec["length"] = len(rec["seq"]) if rec["seq"] else (rec["length"] or 0)
    for kind, where, quals in raw:
        got = parse_location(where, rec["length"], rec["topology"] == "circular")
        location = None if got is None else {"operator": got[0], "parts": [vars(p) for p in got[1]]}
        rec["features"].append({"type": kind, "location": location, "qualifiers": quals})
    return rec


_NAMES = [c.split(" ")[0] for c in RECORD_COLUMNS.split(", ")] + ["features"]


def _parsed_row(text: str, strict: bool) -> dict | None:
    try:
        return parse_record(text)
    except (ValueError, IndexError, KeyError):
        if strict:
            raise
        return None


#: Features and characters of text that a worker holds parsed at a time; a longer record is held alone.
MOST_PARSED, MOST_TEXT = 5_000, 4 << 20


def _parser(more: list[str], strict: bool):
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame([[r[n] for n in [*_NAMES, *more]] for r in rows], columns=[*_NAMES, *more])
        for pdf in frames:
            rows, features, letters = [], 0, 0
            for x, text in zip(pdf.drop(columns="text").to_dict("records"), pdf["text"]):
                got = _parsed_row(text, strict)
                if got:
                    rows.append(got | x | {"n_features": len(got["features"])})
                    features, letters = features + len(got["features"]), letters + len(text)
                    if features >= MOST_PARSED or letters >= MOST_TEXT:
                        yield frame(rows)
                        rows, features, letters = [], 0, 0
            yield frame(rows)

    return parse


def _blocks(files: DataFrame) -> DataFrame:
    """``files`` with pos and text of each record of their value."""
    plain = F.regexp_replace("value", "\r\n?", "\n")
    return files.select("*", F.posexplode(F.filter(F.split(plain, r"(?m)^//[ \t]*$"), lambda x: F.rlike(x, F.lit(r"(?m)^LOCUS")))).alias("pos", "text")).drop("value")


def parse_texts(files: DataFrame, strict: bool = True) -> DataFrame:
    """Parsed records of ``files`` (path, value): one row per record, its features in an array.

    ``strict``: records that can't be read raise, else they are left out.
    """
    blocks = _blocks(files.select("path", "value"))
    return blocks.select("path", (F.col("pos") + 1).alias("record_index"), "text").mapInPandas(_parser([], strict), _PARSED)


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records`` and canonical ``features``; features are numbered from 1 through each file.

    ``parsed`` is worked out once, into the shared folder, one row for each record and each feature: readers take
    thousands of rows at a time, which records with all their features would make large.
    """
    scratch = Scratch(parsed.sparkSession)
    columns = [c.split(" ")[0] for c in RECORD_COLUMNS.split(", ")]
    record, feature = F.struct(*columns, F.size("features").alias("n")), parsed.schema["features"].dataType.elementType
    none = F.when(F.lit(False), record)
    items = F.concat(F.array(F.struct(record.alias("r"), F.lit(None).cast(feature).alias("f"))), F.transform("features", lambda f: F.struct(none.alias("r"), f.alias("f"))))
    rows = scratch.keep(parsed.select("path", "record_index", F.posexplode(items).alias("pos", "x")).select("path", "record_index", "pos", "x.r", "x.f"), "parsed")
    records = rows.where("r is not null").select("r.*")
    before = Window.partitionBy("path").orderBy("record_index").rowsBetween(Window.unboundedPreceding, -1)
    numbers = records.select("path", "record_index", "record_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.col("length").alias("record_length"), "topology")
    numbers = scratch.keep(numbers, "numbers")
    numbers = F.broadcast(numbers) if numbers.count() <= MOST_NUMBERS else numbers
    features = rows.where("f is not null").select("path", "record_index", "pos", "f").join(numbers, ["path", "record_index"])
    return records.drop("n"), features.select("path", "record_id", "record_index", (F.col("offset") + F.col("pos")).cast("long").alias("feature_index"), "f.type", "f.location", "f.qualifiers", "record_length", "topology")


def _split(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = numbered.select("path", "record_id", "record_index", "offset", F.col("length").alias("record_length"), "topology", F.posexplode("features").alias("pos", "f"))
    features = rows.select("path", "record_id", "record_index", (F.col("offset") + F.col("pos") + 1).cast("long").alias("feature_index"), "f.type", "f.location", "f.qualifiers", "record_length", "topology")
    return numbered.select(*[c.split(" ")[0] for c in RECORD_COLUMNS.split(", ")]), features


#: Records whose numbers are broadcast.
MOST_NUMBERS = 500_000


def read_flatfiles(spark: SparkSession, *paths: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``records`` and flat ``features`` (with all derived columns) of files and folders, those within folders too; files
    without a LOCUS line give nothing.

    A file is read record by record, by its terminator, so it may be of any size and is split over tasks; a record must
    fit in memory. Files are parsed once, into the shared folder, and both tables read that. Records and features are
    numbered through each file from the place of their text. Store both tables and query those.
    """
    scratch = Scratch(spark)
    # bad bytes become U+FFFD, as text readers with replacement do
    raw = spark.read.option("recursiveFileLookup", True).text(list(paths), lineSep="\n//")
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("came"), F.make_valid_utf8("value").alias("value"))
    more = ["block", "came", "pos", "n_features"]
    blocks = _blocks(files).withColumn("record_index", F.lit(0))
    parsed = scratch.keep(blocks.mapInPandas(_parser(more, strict), f"{_PARSED}, block long, came long, pos int, n_features int"), "parsed")
    # one short row per record
    along = Window.partitionBy("path").orderBy("block", "came", "pos")
    before = F.coalesce(F.sum("n_features").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = scratch.keep(parsed.select("came", "pos", F.row_number().over(along).alias("record_index"), before.alias("offset")), "numbers")
    numbers = F.broadcast(numbers) if numbers.count() <= MOST_NUMBERS else numbers
    records, features = _split(parsed.drop("record_index").join(numbers, ["came", "pos"]))
    return records, derive(features)


def flatfile_texts(records: DataFrame, features: DataFrame) -> DataFrame:
    """path and value: each record as flatfile text, by path and number. Its features are gathered in a row.

    Write with partitionBy("path").text(...): partitions hold whole files.
    """
    span = lambda p: F.when(p["end0"] == p["start0"], F.concat(p["start0"].cast("string"), F.lit("^"), (p["start0"] + 1).cast("string"))).otherwise(F.concat(p["start_fuzzy"], (p["start0"] + 1).cast("string"), F.lit(".."), p["end_fuzzy"], p["end0"].cast("string")))
    parts = F.col("location.parts")
    back = F.forall(parts, lambda p: p["strand"] == -1)
    turned = lambda p: F.when((p["strand"] == -1) & ~back, F.concat(F.lit("complement("), span(p), F.lit(")"))).otherwise(span(p))
    listed = F.transform(F.when(back, F.reverse(parts)).otherwise(parts), turned)
    inner = F.when(F.size(parts) > 1, F.concat(F.coalesce("location.operator", F.lit("join")), F.lit("("), F.array_join(listed, ","), F.lit(")"))).otherwise(F.get(listed, F.lit(0)))
    # a place that isn't understood stays one
    where = F.when(parts.isNull(), F.lit("unknown")).when(back, F.concat(F.lit("complement("), inner, F.lit(")"))).otherwise(inner)
    indent = F.lit("\n" + " " * 21)
    one = lambda k, v: F.concat(indent, F.lit("/"), k, F.when(v == "", "").otherwise(F.concat(F.lit('="'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))))
    quals = F.array_join(F.flatten(F.transform(F.map_entries("qualifiers"), lambda e: F.transform(e["value"], lambda v: one(e["key"], v)))), "")
    own = features.select("path", "record_index", "feature_index", F.concat(F.lit("     "), F.rpad("type", 16, " "), where, quals, F.lit("\n")).alias("t"))
    own = own.groupBy("path", "record_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature_index", "t"))), lambda x: x["t"]), "").alias("body"))
    # cut once: a piece taken by its place would read the bases up to there again for each line
    pieces = F.regexp_extract_all(F.lower("seq"), F.lit("(?s).{1,60}"), F.lit(0))
    line = lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), x)
    origin = F.when(F.length("seq") > 0, F.concat(F.lit("ORIGIN\n"), F.array_join(F.transform(pieces, line), "\n"), F.lit("\n"))).otherwise("")
    text = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))
    head = F.concat(
        F.lit("LOCUS       "), "name", F.lit(" "), F.col("length").cast("string"), F.lit(" bp    "), text("molecule_type", "DNA"), F.lit("     "), text("topology", "linear"), F.lit("   "), text("division", "UNK"), F.lit(" "), text("date", "01-JAN-1980"),
        F.lit("\nDEFINITION  "), text("description", "."), F.lit("\nACCESSION   "), F.array_join("accessions", " "), F.lit("\nVERSION     "), "record_id", F.lit("\nSOURCE      "), text("source", "."), F.lit("\n  ORGANISM  "), text("organism", "."), F.lit("\nFEATURES             Location/Qualifiers\n"),
    )
    rows = records.join(own, ["path", "record_index"], "left").select("path", "record_index", F.concat(head, F.coalesce("body", F.lit("")), origin, F.lit("//")).alias("value"))
    return rows.repartition("path").sortWithinPartitions("path", "record_index").select("path", "value")


def find_flatfiles(inputs: Iterable[str], distinct: bool = True) -> list[str]:
    """Files and folders' files with a flatfile suffix. ``distinct``: resolved, without repeats, by stem then path, and
    others warned of; otherwise files keep their order, folders are sorted, and repeats stay."""
    found: list[str] = []
    for item in map(str, inputs):
        if os.path.isdir(item):
            found += sorted(os.path.join(d, f) for d, _, names in os.walk(item) for f in names if f.lower().endswith(FLATFILE_SUFFIXES))
        elif os.path.isfile(item) and item.lower().endswith(FLATFILE_SUFFIXES):
            found.append(item)
        elif distinct:
            print(f"Warning: {item} isn't there or no annotation flatfile", file=sys.stderr)
    if not distinct:
        return found
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    return sorted({os.path.realpath(p) for p in found}, key=lambda p: (stem(p).casefold(), p.casefold()))


def _wrapped(text: str, width: int = 58) -> list[str]:
    return [text[i : i + width] for i in range(0, len(text), width)] or [""]


def render_record(rec: dict, features: list[dict]) -> str:
    """Flatfile text of a record (as in ``records``) and its features (type, location, qualifiers)."""
    seq = rec.get("seq") or ""
    out = [f"LOCUS       {rec['name']} {rec['length']} bp    {rec.get('molecule_type') or 'DNA'}     {rec.get('topology') or 'linear'}   {rec.get('division') or 'UNK'} {rec.get('date') or '01-JAN-1980'}"]
    out += [f"DEFINITION  {rec.get('description') or '.'}", f"ACCESSION   {' '.join(rec.get('accessions') or [rec['record_id']])}", f"VERSION     {rec['record_id']}"]
    if rec.get("source") or rec.get("organism"):
        out += [f"SOURCE      {rec.get('source') or rec.get('organism')}", f"  ORGANISM  {rec.get('organism') or rec.get('source')}"]
    out.append("FEATURES             Location/Qualifiers")
    for f in features:
        parts = [Part(**p) if isinstance(p, dict) else Part(**p.asDict()) for p in f["location"]["parts"]]
        where = _wrapped(render_location(f["location"]["operator"], parts))
        out.append(f"     {f['type']:<16}{where[0]}")
        out += [" " * 21 + x for x in where[1:]]
        for key, values in f["qualifiers"].items():
            for v in values:
                doubled = v.replace('"', '""')
                out += [" " * 21 + x for x in (_wrapped(f'/{key}="{doubled}"') if key == "translation" else [f'/{key}="{doubled}"' if v else f"/{key}"])]
    if seq:
        out.append("ORIGIN")
        low = seq.lower()
        out += [f"{i + 1:>9} " + " ".join(low[j : j + 10] for j in range(i, min(i + 60, len(low)), 10)) for i in range(0, len(low), 60)]
    return "\n".join([*out, "//"]) + "\n"
