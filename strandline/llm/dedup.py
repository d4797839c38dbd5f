"""Operator 2: near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles (A-Z lowered, words split at ASCII white space), as 64-bit hashes.

1. Sketch. Register i holds floor(1 - log_b x) of the least exponential value x that hash function i gives to a shingle:
   exponentially spaced, truncated minima. Two sketches merge by the register-wise maximum, and registers of similar
   sets are equal with at least the sets' Jaccard similarity as probability.
2. Candidates. Documents with one and the same set become one class, represented by its smallest doc_id. Bands of
   registers of the representatives meet in buckets. Each bucket names its smallest id as centre, and every member is
   paired with that centre only, so a bucket of n gives n - 1 rows, never all pairs. Any two members of a bucket also
   meet in the group of their centre.
3. Verification. A centre's group is cut into blocks of ``BLOCK`` members, and each block, joined by its centre, is
   compared with full sets. What these links leave in different components is compared block by block: the members
   outside a group's most frequent component with each other and with all others. The comparison leaves out pairs whose
   sizes rule the link out, and pairs whose similarity, estimated by maximum likelihood jointly from the register
   comparison counts and both set sizes, is improbable to reach the threshold. All others are counted exactly on the
   full sets. Only links that join what isn't joined yet are returned, a forest, not all pairs.
4. Components by alternating large-star and small-star steps over the links, written to the shared folder each round.

Band sizes are chosen so that a pair at the threshold shares no band with a probability of at most ``MISS``; pairs above
it still less. Work and set copies of a group of n near copies, of which u stay outside its largest component after the
first step, grow with n * BLOCK + n * u comparisons and n + n * u / BLOCK copies: in proportion to n where most are copies
of one text, and never as pairs. The links that the first step makes needless are those within one component.

Null and empty texts have empty sets: they link with nothing, are their own component and are kept. A text with fewer
words than a shingle is one shingle. Rows with a null doc_id take part under an id behind all others that their set gives
(so doc_ids must lie under 2^62): they get the component of a document with an id that they reach, else null, and one set
of such a group is kept. Rows that repeat a doc_id with another text get the component of their own text's set. Hash collisions of 64 bits are taken to be absent.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import MOST_BROADCAST, Scratch, given_back, map_batches, raw_texts, slices, text_key, without

BASE = 1.02
MISS = 1e-6
MOST_REGISTERS = 208
#: Members and shingles of a block, on average: 16 MB. A larger set is a block by itself or with few others.
BLOCK = 256
BLOCK_SHINGLES = 1 << 21
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62
#: Log likelihood by which the estimate must beat the threshold to rule a pair out (about five standard errors).
RULED_OUT = 12.5


@dataclass(frozen=True)
class Setting:
    """Link two sets if ``scale * |A and B| >= percent * |A or B|``; the characters ``marks`` are left out of the texts."""

    shingle: int = 3
    percent: int = 85
    scale: int = 100
    marks: bytes = b""

    @property
    def threshold(self) -> float:
        return self.percent / self.scale

    @functools.cached_property
    def bands(self) -> tuple[int, int]:
        """Registers per band and bands: the longest bands that keep the miss probability."""
        for rows in range(12, 0, -1):
            n = math.ceil(math.log(MISS) / math.log1p(-(self.threshold**rows)))
            if rows * n <= MOST_REGISTERS:
                return rows, n
        return 1, MOST_REGISTERS


class _Words(dict):
    """Hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _forget() -> None:
    _WORDS.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, n: int, marks: bytes = b"") -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of n words."""
    words = text.lower().translate(None, marks).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(words) - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


@functools.lru_cache(maxsize=4)
def _hashes(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 1 << 32, m, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, m, dtype=np.uint32)


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a set that isn't empty."""
    a, b = _hashes(m)
    x = _mix(shingles) >> np.uint64(32)
    x = x.astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * a + b).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + 200, 0, 65535).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


@functools.lru_cache(maxsize=8)
def _grid(points: int) -> np.ndarray:
    return np.linspace(0.0, 1.0, points)


def log_likelihood(j, u, d_plus, d_minus, d_equal):
    """Joint log likelihood of similarity j from counts of larger, smaller and equal registers; u: share of the first set."""
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    plus, minus = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return d_plus * np.log(np.maximum(plus, tiny)) + d_minus * np.log(np.maximum(minus, tiny)) + d_equal * np.log(np.maximum(1 - plus - minus, tiny))


def plausible(reg_a: np.ndarray, n_a: int, regs: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets with registers ``regs`` may reach the threshold with the first, by sizes and likelihood."""
    ok = np.minimum(sizes, n_a) >= threshold * np.maximum(sizes, n_a) - 1e-9
    at = np.flatnonzero(ok)
    if len(at):
        r = regs[at]
        equal = (r == reg_a).sum(axis=1)
        # nearly all candidates are clear: enough equal registers to try without the estimate
        unsure = at[equal < threshold * len(reg_a)]
        if len(unsure):
            r = regs[unsure]
            plus, equal = (reg_a > r).sum(axis=1)[:, None], (reg_a == r).sum(axis=1)[:, None]
            minus = len(reg_a) - plus - equal
            u = (n_a / (n_a + sizes[unsure]))[:, None]
            most = np.minimum(u / (1 - u), (1 - u) / u)
            ll = log_likelihood(np.minimum(_grid(41)[None, :], most), u, plus, minus, equal)
            at_threshold = log_likelihood(np.minimum(threshold, most), u, plus, minus, equal)[:, 0]
            best = ll.argmax(axis=1)
            ok[unsure[(_grid(41)[best] < threshold) & (ll.max(axis=1) - at_threshold > RULED_OUT)]] = False
    return ok


MASK = (1 << 64) - 1


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Fingerprint of a set, as two signed numbers."""
    key = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


SIG_SCHEMA = "doc_id long, row_key long, n long, k1 long, k2 long, bands array<long>"
SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, setting: Setting) -> DataFrame:
    """Size, fingerprint and band keys of every row's set; no bands for an empty set."""
    rows, n_bands = setting.bands

    def sign(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n": [], "k1": [], "k2": [], "bands": []}
        for text in raw_texts(batch.column("text")):
            s = shingle_set(text, setting.shingle, setting.marks)
            out["n"].append(len(s))
            k1, k2 = set_key(s)
            out["k1"].append(k1)
            out["k2"].append(k2)
            bands = []
            if len(s):
                r = registers(s, rows * n_bands)
                bands = [xxhash.xxh64_intdigest(r[b * rows : (b + 1) * rows].tobytes(), seed=b) - (1 << 63) for b in range(n_bands)]
            out["bands"].append(bands)
        return out | {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key")}

    return map_batches(docs.select("doc_id", "row_key", "text"), sign, SIG_SCHEMA, SIG_ARROW, forget=_forget)


SET_SCHEMA = "doc_id long, n long, shingles binary"
SET_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])


def _sets(docs: DataFrame, setting: Setting) -> DataFrame:
    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, setting.shingle, setting.marks) for t in raw_texts(batch.column("text"))]
        ids = [i if i < NO_ID else NO_ID + ((set_key(s)[0] & MASK) >> 2) for i, s in zip(batch.column("doc_id").to_pylist(), sets)]
        return {"doc_id": ids, "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return map_batches(docs.select("doc_id", "text"), make, SET_SCHEMA, SET_ARROW, forget=_forget)


def _forest(ids: list[int], pairs) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def links_between(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, setting: Setting, m: int) -> list[tuple[int, int]]:
    """Links between the members of two blocks, or within one (right is None), as a forest."""
    members = left + (right or [])
    sizes = np.array([len(s) for _, s in members])
    regs = np.stack([registers(s, m) for _, s in members])
    # all sets one after the other, each shingle as a number below the block's number of distinct ones
    whole = np.concatenate([s for _, s in members])
    values, numbers = np.unique(whole, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = [numbers[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
    mark = np.zeros(len(values), np.int32)
    found = []
    for i in range(len(left)):
        first = len(left) if right is not None else i + 1
        if first >= len(members):
            continue
        near = np.flatnonzero(plausible(regs[i], int(sizes[i]), regs[first:], sizes[first:], setting.threshold)) + first
        if not len(near):
            continue
        mark[own[i]] = 1
        if 4 * len(near) > len(members) - first:
            common = np.add.reduceat(mark[numbers], starts)[near]
        else:
            common = np.array([mark[own[k]].sum() for k in near])
        mark[own[i]] = 0
        union = sizes[i] + sizes[near] - common
        found += [(members[i][0], members[k][0]) for k in near[setting.scale * common >= setting.percent * union]]
    return _forest([d for d, _ in members], found)


LINK_SCHEMA = "a long, b long"
LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(grouped: DataFrame, setting: Setting) -> DataFrame:
    """Links of each (centre, bi, bj): rows come sorted by these, and a group may reach over several batches."""
    rows, n_bands = setting.bands
    m = rows * n_bands

    def links(key, members):
        left = [(d, s) for d, s, block in members if block == key[1]]
        right = [(d, s) for d, s, block in members if block != key[1]] if key[1] != key[2] else None
        if left and (right or right is None) and len(left) + len(right or []) > 1:
            return links_between(left, right, setting, m)
        return []

    def run(batches):
        with given_back():
            key, members, out = None, [], []
            for batch in batches:
                for part in slices(batch, "shingles"):
                    columns = [part.column(c).to_pylist() for c in ("centre", "bi", "bj", "doc_id", "block", "shingles")]
                    for centre, bi, bj, doc, block, blob in zip(*columns):
                        if (centre, bi, bj) != key:
                            if key is not None:
                                out += links(key, members)
                            key, members = (centre, bi, bj), []
                        members.append((doc, np.frombuffer(blob, np.uint64), block))
                if out:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=LINK_ARROW)
                    out = []
            if key is not None:
                out = links(key, members)
                if out:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=LINK_ARROW)

    return grouped.mapInArrow(run, LINK_SCHEMA)


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest reachable node) of every node of ``links`` (a, b); alternating stars."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: larger neighbours of a node go to the smallest node around it
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        large = scratch.keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        after = scratch.keep(small, "edges")
        scratch.drop(large)
        # done when every node hangs on one that has nothing below it, and nothing changed
        stars = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("x")), after["b"] == F.col("x"), "left_semi").isEmpty()
        scratch.drop(edges)
        edges = after
        if stars:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _blocks(n, shingles) -> F.Column:
    """Blocks of so many members with so many shingles together."""
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _block_of(doc_id: str, n_blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), n_blocks).cast("int")


def _with_sets(meets: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (centre, bi, bj, block, doc_id) with their sets, each pair of blocks together in one task."""
    return meets.join(sets, "doc_id").select("centre", "bi", "bj", "block", "doc_id", "shingles").repartition("centre", "bi", "bj").sortWithinPartitions("centre", "bi", "bj")


def _loose_meets(members: DataFrame, components: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Pairs of blocks that are still open in the groups ``members`` (centre, doc_id, n), and the number of such groups.

    Two members of one component need no further link. So only the members outside a group's most frequent component,
    the loose ones, are compared: with each other and with all others. Blocks of loose members come first.
    """
    found = scratch.keep(members.join(components, members["doc_id"] == components["node"], "left").select("centre", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "found")
    counts = found.groupBy("centre", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("rows", (-F.col("component")).alias("minus"), "shingles")).alias("most")
    groups = counts.groupBy("centre").agg(most, F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).where("rows > most.rows")
    groups = groups.select("centre", (-F.col("most.minus")).alias("main"), (F.col("rows") - F.col("most.rows")).alias("loose"), (F.col("shingles") - F.col("most.shingles")).alias("loose_shingles"), F.col("most.rows").alias("rows"), F.col("most.shingles").alias("shingles"))
    groups = scratch.keep(groups.select("centre", "main", _blocks("loose", "loose_shingles").alias("n_loose"), _blocks("rows", "shingles").alias("n_main")), "groups")
    n_groups = groups.count()
    placed = found.join(F.broadcast(groups) if n_groups <= MOST_BROADCAST else groups, "centre").withColumn("loose", F.col("component") != F.col("main"))
    placed = placed.withColumn("block", F.when(F.col("loose"), _block_of("doc_id", F.col("n_loose"))).otherwise(F.col("n_loose") + _block_of("doc_id", F.col("n_main"))))
    last = F.when(F.col("loose"), F.col("n_loose") + F.col("n_main") - 1).otherwise(F.col("n_loose") - 1)
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return meets.select("centre", "doc_id", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")), n_groups


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and kept for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(signatures(rows, setting), "signed")
    # a row without an id stands behind all ids, by its set
    nodes = signed.where("n > 0").withColumn("doc_id", F.coalesce("doc_id", NO_ID + F.shiftrightunsigned("k1", 2)))
    # one row per class: its smallest id; the bands and the size are a function of the class
    classes = scratch.keep(nodes.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row_key")).alias("r"), F.first("bands").alias("bands"), F.first("n").alias("n")).select("k1", "k2", "r.doc_id", "r.row_key", "bands", "n"), "classes")
    banded = classes.select("doc_id", "n", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("band", "centre")
    pairs = scratch.keep(banded.join(centres, "band").select("centre", "doc_id", "n").distinct(), "pairs")

    # sets of those that are in some group, with the group's blocks
    members = pairs.select("doc_id").distinct()
    reps = classes.select("doc_id", "row_key").join(members, "doc_id", "left_semi")
    # rows without an id go by their text until their set is there again; one partitioning serves the join and the rest
    known = lambda c: F.coalesce(c, F.lit(NO_ID)).alias("known")
    named = reps.select(F.least("doc_id", F.lit(NO_ID)).alias("known"), "row_key")
    texts = rows.select(known(F.col("doc_id")), "row_key", "text").join(named, ["known", "row_key"], "left_semi").dropDuplicates(["known", "row_key"])
    sets = scratch.keep(_sets(texts.withColumnRenamed("known", "doc_id"), setting), "sets")
    # only centres of more than a block are looked up: few, and broadcast if their count proves it
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    large = scratch.keep(sizes.select("centre", _blocks("rows", "shingles").alias("n_blocks")).where("n_blocks > 1"), "large")
    n_large = large.count()
    few = F.broadcast(large) if n_large <= MOST_BROADCAST else large
    home = pairs.join(few, "centre", "left").na.fill(1, ["n_blocks"]).select("centre", "doc_id", _block_of("doc_id", F.col("n_blocks")).alias("block"))
    guests = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).where(F.col("block") != _block_of("centre", F.col("n_blocks"))).select("centre", F.col("centre").alias("doc_id"), "block")
    meets = home.unionByName(guests).withColumn("bi", F.col("block")).withColumn("bj", F.col("block"))
    links = scratch.keep(_verified(_with_sets(meets, sets), setting), "links")
    components = scratch.keep(connected(links, scratch), "components")
    if n_large:
        meets, n_loose = _loose_meets(pairs.join(few.select("centre"), "centre"), components, scratch)
        if n_loose:
            more = scratch.keep(_verified(_with_sets(meets, sets), setting), "links")
            components = connected(more.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    scratch.drop(pairs, sets, links)

    least = classes.select("k1", "k2", F.col("doc_id").alias("rep")).join(components, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "row_key", "n", "k1", "k2").join(least, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("n") > 0, F.coalesce("doc_id", NO_ID + F.shiftrightunsigned("k1", 2)) == component).otherwise(F.lit(True))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(component < NO_ID, component).alias("component_id"), kept.alias("kept"))


#: Five words, 0.8 or more; punctuation that comes and goes makes no other word.
STAGE = Setting(shingle=5, percent=80, marks=b".,;:!?\"'()")


def drop_near_duplicates(docs: DataFrame, setting: Setting = STAGE) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id; all columns stay.

    Of rows with one doc_id and one set of shingles one stays, any of them. Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(near_duplicates(docs, setting), "classes")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("row_key").alias("_gone_key"))
    left = without(docs, gone)
    # rows that repeat an id: few, so they are told apart by a join of their own
    again = scratch.keep(found.where("kept and n_shingles > 0").groupBy("doc_id", "component_id", "n_shingles").agg(F.count("*").alias("n"), F.min("row_key").alias("key")).where("n > 1"), "again")
    if again.isEmpty():
        return left
    keys = again.select(F.col("doc_id").alias("_gone_id"))
    several = found.where("kept and n_shingles > 0").join(again.select(F.col("doc_id").alias("a_id")), F.col("doc_id").eqNullSafe(F.col("a_id")), "left_semi").select(F.col("doc_id").alias("_gone_id"), F.col("row_key").alias("_gone_key"))
    on = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (text_key(docs["text"]) == F.col("_gone_key"))
    one = docs.join(F.broadcast(several.distinct()) if again.count() <= MOST_BROADCAST // 4 else several.distinct(), on, "left_semi")
    return without(left, several).unionByName(one.dropDuplicates(["doc_id", "text"]))


def dedup_sql(setting: Setting = Setting()) -> str:
    """Brute force: all pairs that share a shingle, then the smallest id reachable."""
    k = setting.shingle
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - {k - 1})), lambda i: array_to_string(w[i + 1 : i + {k}], ' '))) AS g FROM d WHERE len(w) > 0)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
         e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {setting.scale} * c >= {setting.percent} * (x.n + y.n - c)),
         e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
         r AS (SELECT doc_id AS start, doc_id AS node FROM d UNION SELECT r.start, e2.b FROM r JOIN e2 ON r.node = e2.a),
         c AS (SELECT start AS doc_id, min(node) AS component_id FROM r GROUP BY start)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""
