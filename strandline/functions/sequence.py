"""Nucleotide expressions and the genetic code as a dimension."""

from __future__ import annotations

import functools
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions.fixed_values import CODE_CHANGES, DUAL_STOPS, IUPAC, STANDARD_CODE

_FROM = "ACGTURYKMBVDHSWN"
_TO = "TGCAAYRMKVBHDSWN"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _FROM + _FROM.lower(), _TO + _TO.lower()))


def gc_percent(seq: Column) -> Column:
    """100 (G + C) / (A + C + G + T), other letters left out; 0 for none."""
    s = F.upper(seq)
    gc, acgt = F.regexp_count(s, F.lit("[GC]")), F.regexp_count(s, F.lit("[ACGT]"))
    return F.when(acgt > 0, 100.0 * gc / acgt).otherwise(F.lit(0.0))


def codons(nt: Column) -> Column:
    """Whole triplets from the first base on."""
    return F.regexp_extract_all(nt, F.lit("(?s).{3}"), F.lit(0))


def wrap(seq: Column, width: int) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def wrapped_slice(seq: Column, start: Column, end: Column) -> Column:
    """Bases start..end (1-based) of a circular sequence; both may lie beyond its ends."""
    size = F.length(seq)
    first, span = F.pmod(start - 1, size), end - start + 1
    return F.substring(F.repeat(seq, (F.ceil((first + span) / size)).cast("int")), (first + 1).cast("int"), span.cast("int"))


@functools.cache
def code_table(table_id: int) -> dict[str, str]:
    """Amino acid of each codon; stops are ``*`` unless the codon also codes."""
    table = dict(zip(map("".join, product("TCAG", repeat=3)), STANDARD_CODE))
    return table | {x[:3]: x[3] for x in CODE_CHANGES[table_id].split()}


def stop_codons(table_id: int) -> list[str]:
    return sorted({c for c, a in code_table(table_id).items() if a == "*"} | set(DUAL_STOPS.get(table_id, ())))


@functools.cache
def ambiguous_table(table_id: int) -> dict[str, str]:
    """As ``code_table`` for IUPAC codons too; those with several meanings give B, Z or J where that fits, else nothing."""
    table, pairs = code_table(table_id), {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}
    out = {}
    for letters in product(IUPAC, repeat=3):
        meanings = {table["".join(c)] for c in product(*(IUPAC[x] for x in letters))}
        one = next(iter(meanings)) if len(meanings) == 1 else pairs.get(frozenset(meanings))
        if one:
            out["".join(letters)] = one
    return out


def code_dimension(spark: SparkSession) -> DataFrame:
    """table_id, code (codon to amino acid, IUPAC codons too) and stops: one row for each known table."""
    rows = [(t, ambiguous_table(t), stop_codons(t)) for t in CODE_CHANGES]
    return spark.createDataFrame(rows, "table_id int, code map<string,string>, stops array<string>")


def codon_dimension(spark: SparkSession) -> DataFrame:
    """table_id, codon, aa, is_stop and family (number of codons of the amino acid): 64 rows for each known table."""
    rows = []
    for t in CODE_CHANGES:
        table, stops = code_table(t), set(stop_codons(t))
        for codon, aa in table.items():
            rows.append((t, codon, aa, codon in stops, sum(a == aa for a in table.values()) if aa != "*" else 0))
    return spark.createDataFrame(rows, "table_id int, codon string, aa string, is_stop boolean, family int")


def translate(nt: Column, code: Column) -> Column:
    """Protein of whole codons by a code map; X for codons without one meaning."""
    return F.array_join(F.transform(codons(F.upper(nt)), lambda c: F.coalesce(F.try_element_at(code, F.replace(c, F.lit("U"), F.lit("T"))), F.lit("X"))), "")


#: Bases that a worker translates at a time; a longer text is translated alone.
MOST_BASES = 4 << 20


@functools.cache
def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """A number below 16 for each byte, 15 for none that is a base, and the residue by table and three such numbers."""
    digits, residues = np.full(256, 15, np.uint32), np.full((max(CODE_CHANGES) + 1, 16, 16, 16), ord("X"), np.uint8)
    for i, base in enumerate(IUPAC):
        digits[ord(base)] = i
    digits[ord("U")] = digits[ord("T")]
    for t in CODE_CHANGES:
        for codon, aa in ambiguous_table(t).items():
            residues[(t, *(int(digits[ord(x)]) for x in codon))] = ord(aa)
    return digits, residues.ravel()


def _translated(texts: list[str], tables: list[int]) -> list[str]:
    digits, residues = _lookup()
    sizes = [len(x) // 3 for x in texts]
    whole = "".join(x[: 3 * n] for x, n in zip(texts, sizes))
    if not whole.isascii():
        whole = re.sub(r"[^\x00-\x7f]", "?", whole)
    d = digits[np.frombuffer(whole.encode(), np.uint8)].reshape(-1, 3)
    at = (d[:, 0] << 8) | (d[:, 1] << 4) | d[:, 2]
    out = residues[at + (np.repeat(np.array(tables, np.uint32), sizes) << 12)].tobytes().decode()
    ends = np.cumsum(sizes).tolist()
    return [out[b - n : b] for b, n in zip(ends, sizes)]


@functools.partial(F.arrow_udf, returnType=StringType())
def _proteins(nt: pa.Array, table: pa.Array) -> pa.Array:
    out, texts, tables, places, letters = [None] * len(nt), [], [], [], 0

    def flush():
        for i, x in zip(places, _translated(texts, tables)):
            out[i] = x

    for i, t in enumerate(table.to_pylist()):
        text = None if t is None else nt[i].as_py()
        if text is not None:
            texts.append(text)
            tables.append(t)
            places.append(i)
            letters += len(text)
            if letters >= MOST_BASES:
                flush()
                texts, tables, places, letters = [], [], [], 0
    flush()
    return pa.array(out, pa.string())


def proteins(nt: Column, table: Column) -> Column:
    """``translate`` by the number of a known table, whole batches at a time; null without bases or table."""
    return _proteins(F.upper(nt), table.cast("int"))


def table_id(raw: Column) -> Column:
    """Translation table: 11 if none is named; null if the name is no integer or no known table."""
    n = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("11")).otherwise(F.trim(raw)).try_cast("int")
    return F.when(n.isin(*CODE_CHANGES), n)


def byte_each(seq: Column) -> Column:
    """Whether each letter is one byte, as ``extract`` can use."""
    return F.octet_length(seq) == F.length(seq)


def extract(seq: Column, parts: Column, plain: Column | bool = False) -> Column:
    """Bases of a location: its parts in biological order, those on the reverse strand complemented; null without bases.

    ``plain`` tells, from one look at the record, that each letter is a byte: then parts are cut out by their place, where
    letters are else counted from the record's start for every part.
    """

    def one(p):
        at, size = (p["start0"] + 1).cast("int"), (p["end0"] - p["start0"]).cast("int")
        s = F.when(F.lit(plain), F.substring(seq.cast("binary"), at, size).cast("string")).otherwise(F.substring(seq, at, size))
        return F.when(p["strand"] == -1, reverse_complement(s)).otherwise(s)

    return F.when(seq.isNotNull(), F.array_join(F.transform(parts, one), ""))
