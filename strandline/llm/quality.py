"""Operator 5: quality rules with adaptive thresholds, all in DataFrame functions.

Every rule looks at a share in millionths (symbols per word character, repeated lines, repeated words) or at the mean
word length in thousandths. For each language and source a quantile sketch is kept of each of them: counts of values cut
to their ``DIGITS`` leading binary digits, so bins are as wide as values are large. It holds any value, errs by less than
one part in 2^(DIGITS - 1), has at most 2^(DIGITS - 1) bins for each doubling, takes map-side partial sums, merges by
addition, and doesn't depend on the partitioning. Groups with fewer than ``LEAST_ROWS`` rows use the sketch of their
language, merged from its sources, and languages with fewer use the sketch of the whole corpus.

A group's threshold is its upper quartile plus ``FENCE`` times the larger of its interquartile range and a least
spread; for the word length there is a lower one too. These fences lie far outside the bulk of a group, so that clean
documents stay, while the cutoffs follow what is usual for the language and source. A document is kept if it passes
the base rules and stays within its group's fences.

The text is read once; its statistics are written to the shared folder and joined with the thresholds, which are
broadcast up to ``MOST_GROUPS`` groups. The filter writes the rows beside their statistics, so that texts aren't shuffled.
Null text counts as empty (n_words 0, so base_failed); null language and null source are groups of their own; repeated
rows count as often as they appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

SPACE = r"[ \t\n\x0B\f\r]"
DIGITS = 8
LEAST_ROWS = 100
FENCE = 6
#: Metric and least spread, in its unit.
UPPER = (("symbol_ppm", 8_000), ("dup_line_ppm", 80_000), ("repeat_ppm", 80_000), ("word_len", 1_000))
LOWER = (("word_len", 500),)
#: Thresholds that are broadcast: some 100 bytes for each language and source.
MOST_GROUPS = 50_000


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for a body that uses it in nested lambdas."""
    return F.transform(F.array(value), body)[0]


def _n_repeat_words(words: Column) -> Column:
    """Words within a 3-word window that stands at least twice, by sorting hashed windows only if some stands twice."""

    def of_windows(w, h):
        # where a window stands that also stands elsewhere: its neighbours in (hash, place) order tell
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, places))

    def windows(w):
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, lambda w: _let(windows(w), lambda h: of_windows(w, h)))).cast("long")


def text_stats(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts that the rules use, and ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    got = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _n_repeat_words(w).alias("rep"))).alias("words"),
        *more,
    )
    return got.select(
        "doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.rep").cast("long").alias("n_repeat_words"),
        *got.columns[len(got.columns) - len(more) :],
    )


METRICS = {
    "symbol_ppm": "coalesce(1000000 * n_symbols div nullif(word_chars, 0), 0)",
    "dup_line_ppm": "coalesce(1000000 * n_dup_lines div nullif(n_lines, 0), 0)",
    "repeat_ppm": "coalesce(1000000 * n_repeat_words div nullif(n_words, 0), 0)",
    "word_len": "coalesce(1000 * word_chars div nullif(n_words, 0), 0)",
}


def bin_of(value: str) -> Column:
    """The least value of the sketch's bin: the leading binary digits, zeros behind."""
    rest = f"greatest(0, length(bin({value})) - {DIGITS})"
    return F.expr(f"shiftleft(shiftright({value}, {rest}), {rest})")


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, upper and lower fences of each group of a sketch with columns ``by``, metric, bin and n."""
    counts = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    # as many entries as the sketch has bins, so a group's array is bounded
    grouped = counts.groupBy(*by, "metric").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))

    def quantile(parts: int) -> Column:
        """The least bin below or in which at least parts / 4 of the rows lie."""
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["q"].isNull() & (4 * (acc["seen"] + x["n"]) >= parts * F.col("rows")), x["bin"]).otherwise(acc["q"]).alias("q"))
        return F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("q")), step)["q"]

    q = grouped.select(*by, "metric", "rows", quantile(1).alias("q1"), quantile(3).alias("q3"))
    spread = lambda least: F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
    up = [F.max(F.when(F.col("metric") == m, F.col("q3") + FENCE * spread(s))).alias(f"{m}_max") for m, s in UPPER]
    low = [F.max(F.when(F.col("metric") == m, F.col("q1") - FENCE * spread(s))).alias(f"{m}_min") for m, s in LOWER]
    return q.groupBy(*by).agg(F.max("rows").alias("rows"), *up, *low)


LIMITS = [f"{m}_max" for m, _ in UPPER] + [f"{m}_min" for m, _ in LOWER]


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def thresholds(stats: DataFrame, scratch: Scratch, least_rows: int = LEAST_ROWS) -> DataFrame:
    """t_lang, t_source and the limits of each group with rows that pass the base rules, from which they come."""
    rows = stats.where(f"not ({BASE_FAILED})").select("lang", "source", *[F.expr(e).cast("long").alias(m) for m, e in METRICS.items()])
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(m).alias("bin")) for m in METRICS]))
    sketch = rows.select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.metric", "e.bin").agg(F.count("*").alias("n"))
    sketch = scratch.keep(sketch, "sketch")
    fine, of_lang, whole = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch.withColumn("all", F.lit(1)), ["all"])
    pick = lambda a, b, x: F.when(a["rows"] >= least_rows, a[x]).when(b["rows"] >= least_rows, b[x]).otherwise(whole[x]).alias(x)
    limits = (
        fine.join(of_lang, fine["lang"].eqNullSafe(of_lang["lang"]))
        .join(F.broadcast(whole))  # one row
        .select(fine["lang"].alias("t_lang"), fine["source"].alias("t_source"), *[pick(fine, of_lang, x) for x in LIMITS])
    )
    limits = scratch.keep(limits, "limits")
    return F.broadcast(limits) if limits.count() <= MOST_GROUPS else limits


def verdicts(stats: DataFrame, scratch: Scratch, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``stats`` with base_failed and kept."""
    rows = stats.select("*", *[F.expr(e).alias(m) for m, e in METRICS.items()], F.expr(BASE_FAILED).alias("base_failed"))
    limits = thresholds(stats, scratch, least_rows)
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"]), "left")
    within = F.lit(True)
    for m, _ in UPPER:
        within = within & (F.col(m) <= F.col(f"{m}_max"))
    for m, _ in LOWER:
        within = within & (F.col(m) >= F.col(f"{m}_min"))
    # a group without thresholds has no row that passed the base rules
    return joined.select(*[F.col(c) for c in stats.columns], "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def quality_report(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(text_stats(docs), "stats")
    return verdicts(stats, scratch, least_rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The documents that pass, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stats = scratch.keep(text_stats(docs, row), "stats")
    return verdicts(stats, scratch, least_rows).where("kept").select("_row.*")


def quality_sql(least_rows: int = LEAST_ROWS) -> str:
    metric = {m: e.replace(" div ", " // ") for m, e in METRICS.items()}
    rest = lambda m: f"greatest(0, length(bin({m})) - {DIGITS})"
    cut = lambda m: f"(({m} >> {rest(m)}) << {rest(m)})"
    spread = lambda m, least: f"greatest(max(q3) FILTER (metric = '{m}') - max(q1) FILTER (metric = '{m}'), {least})"
    fences = ", ".join([f"max(q3) FILTER (metric = '{m}') + {FENCE} * {spread(m, s)} AS {m}_max" for m, s in UPPER] + [f"max(q1) FILTER (metric = '{m}') - {FENCE} * {spread(m, s)} AS {m}_min" for m, s in LOWER])
    level = lambda by: f"""SELECT {by}, max(n) AS n, {fences} FROM (
        SELECT {by}, metric, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
        FROM (UNPIVOT (SELECT {', '.join(dict.fromkeys((by + ', lang, source').replace('one, ', '').split(', ')))}, 1 AS one, {', '.join(f'{cut(m)} AS {m}' for m in METRICS)} FROM m WHERE NOT base_failed) ON {', '.join(METRICS)} INTO NAME metric VALUE v)
        GROUP BY {by}, metric) GROUP BY {by}"""  # noqa: E731
    pick = ", ".join(f"CASE WHEN f.n >= {least_rows} THEN f.{x} WHEN l.n >= {least_rows} THEN l.{x} ELSE o.{x} END AS {x}" for x in LIMITS)
    within = " AND ".join([f"{m} <= {m}_max" for m, _ in UPPER] + [f"{m} >= {m}_min" for m, _ in LOWER])
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '\x01') AS lang, coalesce(source, '\x01') AS source, coalesce(text, '') AS text, row_number() OVER () AS rid,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
         win AS (SELECT rid, i, w[i + 1 : i + 3] AS tri FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
         rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM win) WHERE c > 1),
         reps AS (SELECT rid, count(DISTINCT i) AS n FROM rep GROUP BY rid),
         s AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
                      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
               FROM d LEFT JOIN reps USING (rid)),
         m AS (SELECT *, {', '.join(f'CAST({e} AS BIGINT) AS {m}' for m, e in metric.items())}, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
         f AS ({level('lang, source')}), l AS ({level('lang')}), o AS ({level('one')}),
         t AS (SELECT f.lang, f.source, {pick} FROM f JOIN l ON f.lang = l.lang CROSS JOIN o)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce({within}, false)) AS kept
    FROM m LEFT JOIN t ON m.lang = t.lang AND m.source = t.source"""
