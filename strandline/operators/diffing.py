"""Two annotations of genomes: features paired tier by tier, and what changed within the pairs.

``genome`` tells several pairs of files apart; features of one genome are paired with each other only. A tier on keys
meets as features under one key, never as pairs of them, and the overlap tier as chains of overlapping features. Both
stream through sorted partitions, so a task holds one key's or one chain's features of one genome at a time.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import strand_symbol
from strandline.operators.intervals import islands
from strandline.sources.scratch import Scratch

KEPT = ("record_id", "start", "end", "strand", "locus_tag", "protein_id", "gene", "product", "translation", "kos", "ecs")
OVERLAP = 0.8
#: Most changes that a report lists, and of each kind.
MOST_CHANGES, MOST_DETAILS = 200, 50


def overlap_fraction(a: str = "", b: str = "r_"):
    """Shared length over the longer span; 0 on other records or strands."""
    c = lambda p, n: F.col(f"{p}{n}")
    shared = F.greatest(F.lit(0), F.least(c(a, "end"), c(b, "end")) - F.greatest(c(a, "start"), c(b, "start")) + 1)
    size = lambda p: F.greatest(F.lit(1), c(p, "end") - c(p, "start") + 1)
    same = c(a, "record_id").eqNullSafe(c(b, "record_id")) & c(a, "strand").eqNullSafe(c(b, "strand"))
    return F.when(same, F.least(shared / size(a), shared / size(b))).otherwise(F.lit(0.0))


def cds_of(features: DataFrame, genome: Column | None = None) -> DataFrame:
    """CDS with ``genome`` (by default all are of one), ``idx``, their order, and sorted KO and EC lists."""
    kos, ecs = F.array_sort(F.array_distinct("xrefs.kegg_kos")), F.array_sort(F.array_distinct("xrefs.ec_numbers"))
    return features.where("type = 'CDS'").select((F.lit("") if genome is None else genome).alias("genome"), F.col("feature_index").alias("idx"), *KEPT[:-2], kos.alias("kos"), ecs.alias("ecs"))


class _New:
    """New features that are left: by place for overlaps, by number for the rest."""

    def __init__(self, rows):
        self.left = {idx for idx, *_ in rows}
        self.order = sorted(self.left)
        heapq.heapify(self.order)
        self.by_place: dict[tuple, list] = {}
        for idx, record, strand, start, end in rows:
            self.by_place.setdefault((record, strand), []).append((start, end, idx))
        self.longest = {}
        for k, x in self.by_place.items():
            x.sort()
            self.longest[k] = max(end - start for start, end, _ in x)

    def best(self, record, strand, start, end, least: float):
        """(-overlap, idx) of the new feature with the largest overlap, if that is large enough; of equal ones the first."""
        rows = self.by_place.get((record, strand), [])
        best = None
        low = bisect_left(rows, (start - self.longest.get((record, strand), 0),))
        for a, b, idx in rows[low : bisect_right(rows, (end, float("inf")))]:
            shared = min(end, b) - max(start, a) + 1
            if shared > 0 and idx in self.left:
                score = min(shared / max(1, end - start + 1), shared / max(1, b - a + 1))
                if score >= least and (best is None or (-score, idx) < best):
                    best = (-score, idx)
        return best

    def first(self):
        while self.order and self.order[0] not in self.left:
            heapq.heappop(self.order)
        return self.order[0] if self.order else None


def greedy(old: list[tuple], new: list[tuple], least: float = 0.0, any_place: bool = False) -> list[tuple[int, int]]:
    """In their order the old features (idx, record, strand, start, end) each take the best new one that is left;
    with ``any_place`` the first one where none overlaps. Rows that repeat an idx are places of one feature."""
    there, out = _New(new), []
    for idx, places in groupby(sorted(old, key=lambda r: r[0]), lambda r: r[0]):
        found = [x for x in (there.best(*place, least) for _, *place in places) if x]
        got = min(found)[1] if found else there.first() if any_place else None
        if got is not None:
            there.left.discard(got)
            out.append((idx, got))
    return out


_PLACE = ["record_id", "strand", "start", "end"]
_PAIR_SCHEMA = "genome string, old_idx long, new_idx long"
_PAIR_ARROW = pa.schema([("genome", pa.string()), ("old_idx", pa.int64()), ("new_idx", pa.int64())])


def _streamed(rows: DataFrame, by: list[str], least: float, any_place: bool) -> DataFrame:
    """Greedy pairs within each group of rows (by, genome, is_new, idx and place)."""
    columns = ["genome", "is_new", "idx", *_PLACE]
    # dealt by a digest: Spark leaves out a repartition by keys by which a join dealt the rows, and then may read that
    # join's shuffle by mapper or cut its partitions, since a map over batches asks for no keys
    dealt = rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], *columns)

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        # several groups a batch of results
        out = []
        for _, group in groupby(each(), lambda r: r[: len(by)]):
            sides: tuple[list, list] = ([], [])
            genome = None
            for r in group:
                genome, is_new, *feature = r[len(by) :]
                sides[is_new].append(tuple(feature))
            if sides[0] and sides[1]:
                out += [(genome, a, b) for a, b in greedy(*sides, least, any_place)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PAIR_ARROW)], schema=_PAIR_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PAIR_ARROW)], schema=_PAIR_ARROW)

    return dealt.mapInArrow(run, _PAIR_SCHEMA)


def _both(old: DataFrame, new: DataFrame, *more: str) -> DataFrame:
    side = lambda df, n: df.select(F.lit(n).alias("is_new"), "genome", "idx", *_PLACE, *more)
    return side(old, 0).unionByName(side(new, 1))


def by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Pairs with one key. Keys that stand once on both sides, the usual case, come out of the counts; only the features
    under repeated keys are matched one by one."""
    rows = _both(old, new, key).where(F.col(key) != "")
    side = lambda n, f, c: f(F.when(F.col("is_new") == n, F.col(c)))
    counts = rows.groupBy("genome", key).agg(side(0, F.count, "idx").alias("_a"), side(1, F.count, "idx").alias("_b"), side(0, F.min, "idx").alias("old_idx"), side(1, F.min, "idx").alias("new_idx")).where("_a > 0 and _b > 0")
    simple = counts.where("_a = 1 and _b = 1").select("genome", "old_idx", "new_idx")
    several = rows.join(counts.where("_a > 1 or _b > 1").select("genome", key), ["genome", key], "left_semi")
    return simple.unionByName(_streamed(several, ["genome", key], 0.0, True))


def by_overlap(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """Pairs that overlap. Features of both sides are cut into chains of overlapping ones along each record and strand."""
    by = ["genome", "record_id", "strand"]
    order = ["start", "end", "is_new", "idx"]
    reach = F.max("end").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    chains = islands(_both(old, new), by, order, F.coalesce(F.col("start") > reach, F.lit(True)), "chain")
    sizes = chains.groupBy(*by, "chain").agg(F.min("is_new").alias("low"), F.max("is_new").alias("high")).where("low < high")
    same = [chains[c].eqNullSafe(sizes[c]) for c in (*by, "chain")]
    mixed = chains.join(sizes, same[0] & same[1] & same[2] & same[3], "left_semi")
    return _streamed(mixed, [*by, "chain"], least, False)


def by_translation(old: DataFrame, new: DataFrame) -> DataFrame:
    """The k-th old feature of a translation with its k-th new one."""

    def ranked(df, name):
        digest = F.sha2(F.trim("translation"), 256)
        return df.where(F.trim("translation") != "").select("genome", digest.alias("digest"), F.col("idx").alias(name)).withColumn("k", F.row_number().over(Window.partitionBy("genome", "digest").orderBy(name)))

    return ranked(old, "old_idx").join(ranked(new, "new_idx"), ["genome", "digest", "k"]).select("genome", "old_idx", "new_idx")


def pair_features(old: DataFrame, new: DataFrame, least: float = OVERLAP) -> DataFrame:
    """genome, old_idx, new_idx and tier; each tier works on what those before left.

    What is left is written to the shared folder after each tier: later tiers read it only.
    """
    scratch = Scratch(old.sparkSession)
    need = ["genome", "idx", "record_id", "start", "end", "strand", "locus_tag", "protein_id", "translation"]
    old, new, done = scratch.keep(old.select(*need), "old"), scratch.keep(new.select(*need), "new"), None
    tiers = (("locus_tag", lambda a, b: by_key(a, b, "locus_tag")), ("protein_id", lambda a, b: by_key(a, b, "protein_id")), ("coordinate_overlap", lambda a, b: by_overlap(a, b, least)), ("translation_hash", by_translation))
    for tier, match in tiers:
        got = scratch.keep(match(old, new), "pairs")
        done = got.withColumn("tier", F.lit(tier)) if done is None else done.unionByName(got.withColumn("tier", F.lit(tier)))
        if tier != tiers[-1][0]:
            before = old, new
            old = scratch.keep(old.join(got.select("genome", F.col("old_idx").alias("idx")), ["genome", "idx"], "left_anti"), "old")
            new = scratch.keep(new.join(got.select("genome", F.col("new_idx").alias("idx")), ["genome", "idx"], "left_anti"), "new")
            scratch.drop(*before)
    return done


def classify(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair and per feature without a partner, with its classes and, where they changed, the names and lists.

    ``ord``: matched ones first, by record and place, then the removed and the added, in their order.
    """
    o = old.select("genome", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "genome"])
    n = new.select("genome", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "genome"])
    # rows that repeat a number go with its pairs one to one. Numbers of repeats are no equality to Spark, so that one
    # shuffle by genome and idx serves window and join
    number = lambda df, side, *order: df.withColumn(f"{side}_no", F.row_number().over(Window.partitionBy("genome", f"{side}_idx").orderBy(*order)))
    placed = lambda df, side: number(df, side, F.length(f"{side}_record_id"), *[f"{side}_{c}" for c in ("record_id", "start", "end", "strand", "product", "gene")])

    def meet(a, b, side, how):
        b = b.withColumnsRenamed({"genome": "_g", f"{side}_idx": "_i", f"{side}_no": "_n"})
        return a.join(b, (F.col("genome") == F.col("_g")) & (F.col(f"{side}_idx") == F.col("_i")) & (F.col(f"{side}_no") <= F.col("_n")) & (F.col(f"{side}_no") >= F.col("_n")), how).drop("_g", "_i", "_n")

    o, n = placed(o, "old"), placed(n, "new")
    pairs = number(pairs, "old", "new_idx")
    rows = number(meet(pairs, o, "old", "inner"), "new", "old_idx", "old_no")
    rows = meet(rows, n, "new", "inner")
    pairs = number(pairs, "new", "old_idx", "old_no")
    differ = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    moved = differ("record_id") | differ("start") | differ("end") | differ("strand")
    changed = lambda c: F.trim(f"old_{c}") != F.trim(f"new_{c}")
    refs = differ("kos") | differ("ecs")
    classes = F.filter(F.array(F.when(moved, "boundary_shifted"), F.when(changed("product"), "product_changed"), F.when(changed("gene"), "gene_changed"), F.when(refs, "xref_changed")), lambda x: x.isNotNull())
    classes = F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("unchanged")))
    place = lambda p: F.format_string("%d..%d(%s)", f"{p}start", f"{p}end", strand_symbol(F.col(f"{p}strand")))
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    both = lambda c: F.when(differ(c), F.struct(F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")))
    none = F.lit(None).cast("string")

    def shaped(df, group, record, a, b, tier, kinds, start, end, idx):
        names = [(F.when(changed(c), dash(f"{p}_{c}")) if a and b else none).alias(f"{p}_{c}") for c in ("product", "gene") for p in ("old", "new")]
        lists = F.when(refs, F.struct(both("kos").alias("kegg_kos"), both("ecs").alias("ec_numbers"))) if a and b else F.lit(None).cast("struct<kegg_kos:struct<old:array<string>,new:array<string>>,ec_numbers:struct<old:array<string>,new:array<string>>>")
        order = F.struct(F.lit(group).alias("group"), F.col(record).alias("record") if group == 0 else F.lit("").alias("record"), (F.col(start) if group == 0 else F.lit(0)).cast("long").alias("start"), (F.col(end) if group == 0 else F.lit(0)).cast("long").alias("end"), F.col(idx).alias("idx"))
        return df.select(
            "genome", order.alias("ord"), F.col(record).alias("record"), (dash("old_locus_tag") if a else none).alias("old_locus"), (dash("new_locus_tag") if b else none).alias("new_locus"),
            (place("old_") if a else none).alias("old_coordinates"), (place("new_") if b else none).alias("new_coordinates"), tier.alias("tier"), kinds.alias("classes"), *names, lists.alias("xref_changes"),
        )

    matched = shaped(rows, 0, "old_record_id", True, True, F.col("tier"), classes, "old_start", "old_end", "old_idx")
    gone = shaped(meet(o, pairs.select("genome", "old_idx", "old_no"), "old", "left_anti"), 1, "old_record_id", True, False, none, F.array(F.lit("removed")), "old_start", "old_end", "old_idx")
    came = shaped(meet(n, pairs.select("genome", "new_idx", "new_no"), "new", "left_anti"), 2, "new_record_id", False, True, none, F.array(F.lit("added")), "new_start", "new_end", "new_idx")
    return matched.unionByName(gone).unionByName(came)


def class_counts(changes: DataFrame) -> DataFrame:
    return changes.select("genome", F.explode("classes").alias("classification")).groupBy("genome", "classification").agg(F.count("*").alias("n"))


def shared_coordinates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct places that both annotations have."""
    key = ["genome", "record_id", "start", "end", "strand"]
    return old.select(*key).intersect(new.select(*key))


COUNTS = ("old_cds_count", "new_cds_count", "shared_coordinate_cds", "matched_cds", "added_cds", "removed_cds", "product_name_changes", "gene_name_changes", "xref_changes", "boundary_shifted_cds", "unchanged")


def diff_counts(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The ten counts of each genome's report."""
    n = lambda df, name: df.groupBy("genome").agg(F.count("*").alias(name))
    kind = lambda c: F.count_if(F.array_contains("classes", c))
    counts = changes.groupBy("genome").agg(
        F.count("tier").alias("matched_cds"), kind("added").alias("added_cds"), kind("removed").alias("removed_cds"), kind("product_changed").alias("product_name_changes"),
        kind("gene_changed").alias("gene_name_changes"), kind("xref_changed").alias("xref_changes"), kind("boundary_shifted").alias("boundary_shifted_cds"), kind("unchanged").alias("unchanged"),
    )
    sizes = n(old, "old_cds_count").join(n(new, "new_cds_count"), "genome", "full").join(n(shared_coordinates(old, new), "shared_coordinate_cds"), "genome", "left")
    return sizes.join(counts, "genome").na.fill(0).select("genome", *COUNTS)


def first_changes(changes: DataFrame) -> DataFrame:
    """Rows that a report lists: ``list`` is changes or the kind, in the report's order, with the row's number ``k``."""
    kinds = {"product_changed": "product_changes", "gene_changed": "gene_changes", "xref_changed": "xref_changes", "boundary_shifted": "boundary_shifts", "added": "added", "removed": "removed"}
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    listed = changes.withColumn("list", F.explode(F.concat(F.array(F.lit("changes")), F.filter(F.transform("classes", lambda c: F.try_element_at(names, c)), lambda x: x.isNotNull()))))
    k = F.row_number().over(Window.partitionBy("genome", "list").orderBy("ord"))
    return listed.withColumn("k", k).where(F.col("k") <= F.when(F.col("list") == "changes", MOST_CHANGES).otherwise(MOST_DETAILS))
