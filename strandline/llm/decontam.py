"""Operator 1: benchmark decontamination by template windows.

Texts become typed tokens: numbers, units after numbers, and names (words with a capital) turn into placeholders, other
words are lowered; punctuation goes. What the placeholders stood for is carried along as slots. Whether a capital marks
a name or a sentence's first word can't be told from the text, so the benchmark is read in three ways: every capital a
name, only those inside sentences, and none (as a copy in one case has it). Documents are read the first way.

Every window of ``WINDOW`` tokens of which at least ``LITERALS`` are words is hashed. Items whose windows can't carry
them (short ones, and those dense in numbers, units or names) are also hashed in chunks of up to ``CHUNK`` tokens of any
kind. Document windows meet benchmark windows in a hash join.

A match is judged per document and item. Matched windows lie on diagonals (place in the document minus place in the
item). On one diagonal the slots must be consistent: an item's value must always turn into the same value, so "3 pears
for 3 people" matches "5 pears for 5 people" and not "5 pears for 7 people". Windows against a diagonal's most frequent
value are left out. A chunk counts if its slots are equal, or consistent and held by enough fixed tokens. The item is
found if the windows left cover at least ``COVER`` of its tokens, on the diagonal with the fewest changes that does so,
else on all of them together. ``reparameterised`` says that slots changed.

The join goes rare windows first, as prefix joins do. Benchmark rows with one text are one item. Of each item the rarest
windows are its probes: the others cover less than ``COVER``, so a document that has the item has a probe, and a window
that very many items share brings no pairs. Items that differ in their values only are one template, represented by the
first: the others are found by probes with their own values. The tasks drop all document windows that two bit arrays of
at most ``MOST_BITS`` bits exclude (32 MB each, whatever the benchmark's size); the rest is joined by shuffles, on the
hash for pairs and then on the pair. Documents without a probe leave their task with nothing.

A copy's first token is read without its context there. Items under ``LEAST`` tokens are too common to be evidence inside
a sentence and must fill a line of the document, slots equal. Scripts written without spaces (Chinese, Japanese, Thai
and their like) are cut into characters, each a word. Null and empty texts have no windows. Repeated rows each get their
rows. Null item_ids stay null; of rows with one text the smallest item_id is reported, and their number.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, given_back, raw_texts, slices, text_key, without

WINDOW = 5
LITERALS = 3
LEAST = 3
CHUNK = 32
COVER = (1, 2)
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28

UNITS = frozenset("mm cm m km kg g mg lb lbs oz mile miles meter meters metre metres inch inches foot feet second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent liter liters litre litres mph kmh".split())
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
_TABLE = bytes(b if b >= 0x80 or b == 0x0A or chr(b).isalnum() or chr(b) in ".!?" else 0x20 for b in range(256))
#: Stands at the end of a line's last word; the table leaves no such byte.
_LINE = b"\x01"
_STRIP = ".!?\x01"
# punctuation outside ASCII: Latin-1's, and the block from U+2000
_MARKS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf]|\xe2[\x80\x81][\x80-\xbf]")
# bytes that begin a character of an unsegmented script, of others too
_MAYBE = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
_WIDE_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_WIDE_ENDS = {ord(c): ". " for c in "\u3002\uff01\uff1f\uff0e\uff61"}
_UNSEGMENTED = re.compile("([\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u312f\u31a0-\u31bf\u31f0-\u9fff\uf900-\ufaff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\U00020000-\U0003ffff])")
# flags of a token
ENDS, CAPITAL, NUMBER, UNIT, EMPTY, LINE = 1, 2, 4, 8, 16, 32
_PLACE = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


class _Tokens(dict):
    """Number of each token as it stands in texts; its literal's hash and flags lie in arrays, the newest in lists."""

    def __init__(self):
        super().__init__()
        self.hashes, self.flags = np.empty(0, np.uint64), np.empty(0, np.uint8)
        self.new_hashes: list[int] = []
        self.new_flags: list[int] = []

    def of(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags of tokens."""
        ids = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        if self.new_hashes:
            self.hashes = np.concatenate([self.hashes, np.array(self.new_hashes, np.uint64)])
            self.flags = np.concatenate([self.flags, np.array(self.new_flags, np.uint8)])
            self.new_hashes, self.new_flags = [], []
        return self.hashes[ids], self.flags[ids]

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode(errors="replace")
        word = text.strip(_STRIP)
        flags = ENDS if text and text[-1] in _STRIP else 0
        if raw.endswith(_LINE):
            flags |= LINE
        if not word:
            flags |= EMPTY
        elif _NUMBER.fullmatch(word):
            flags |= NUMBER
        else:
            if word[0].isupper() and (len(word) == 1 or not word.isupper()):
                flags |= CAPITAL
            if word.lower() in UNITS:
                flags |= UNIT
        n = self[raw] = len(self)
        self.new_hashes.append(xxhash.xxh64_intdigest(word.lower()))
        self.new_flags.append(flags)
        return n


_TOKENS = _Tokens()


@dataclass(frozen=True)
class Canonical:
    """Tokens of several texts, one after the other."""

    hashes: np.ndarray
    literal: np.ndarray
    alone: np.ndarray  # hashes as they would be without what stands before
    plain: np.ndarray  # hashes of the words themselves
    name: np.ndarray  # read as a name
    begins: np.ndarray  # first of a sentence
    text: np.ndarray  # number of the text of each token
    starts: np.ndarray  # first token of each text, and the end
    raw: list[bytes]  # the words behind the tokens
    line: np.ndarray  # number of the line of each token

    def with_words(self, words: np.ndarray) -> Canonical:
        """With these names read as words."""
        return replace(self, hashes=np.where(words, self.plain, self.hashes), alone=np.where(words, self.plain, self.alone), literal=self.literal | words)

    def readings(self) -> list[Canonical]:
        return [self, self.with_words(self.name & self.begins), self.with_words(self.name)]


def _words(text: bytes) -> list[bytes]:
    if not text.isascii():
        if _MAYBE.search(text):
            text = _UNSEGMENTED.sub(r" \1 ", _WIDE_MARKS.sub(" ", text.decode(errors="replace").translate(_WIDE_ENDS))).encode()
        text = _MARKS.sub(b" ", text)
    # a line end separates words and ends a sentence
    return text.translate(_TABLE).replace(b"\n", _LINE + b" ").split()


#: Tokens that are remembered: some 60 MB.
MOST_TOKENS = 300_000


def _forget() -> None:
    global _TOKENS
    _TOKENS = _Tokens()


def canonical(texts: list[bytes]) -> Canonical:
    if len(_TOKENS) > MOST_TOKENS:
        _forget()
    split = [_words(t) for t in texts]
    raw = [w for s in split for w in s]
    plain, flags = _TOKENS.of(raw)
    text = np.repeat(np.arange(len(texts)), np.array([len(s) for s in split], np.int64))
    first = np.ones(len(raw), bool)
    first[1:] = text[1:] != text[:-1]
    before = np.zeros(len(raw), np.uint8)
    before[1:] = flags[:-1]
    number = flags & NUMBER > 0
    unit = (flags & UNIT > 0) & ~first & (before & NUMBER > 0)
    capital = (flags & CAPITAL > 0) & ~number
    name = capital & ~unit
    alone = np.where(number, _PLACE["number"], np.where(capital, _PLACE["name"], plain))
    hashes = np.where(unit, _PLACE["unit"], alone)
    line = np.cumsum(first | (before & LINE > 0))
    begins = first | (before & ENDS > 0)
    keep = np.flatnonzero(flags & EMPTY == 0)
    text = text[keep]
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    return Canonical(hashes[keep], ~(number | unit | name)[keep], alone[keep], plain[keep], name[keep], begins[keep], text, starts, [raw[i] for i in keep.tolist()] if len(keep) < len(raw) else raw, line[keep])


def window_hashes(c: Canonical, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of n tokens that lie in one text and hold enough words."""
    count = len(c.hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(count, n, np.uint64)
    words = np.zeros(count, np.int8)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c.hashes[i : count + i]
        words += c.literal[i : count + i]
    at = np.flatnonzero((words >= literals) & (c.text[:count] == c.text[n - 1 :]))
    h = h[at]
    return at, h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class Wholes:
    """Hashes of windows of any length, with no word asked for and the first token read alone, from sums over the tokens."""

    def __init__(self, c: Canonical):
        self.c, count = c, len(c.hashes)
        down, self.up = np.full(count + 1, _INVERSE), np.full(count + 1, np.uint64(_BASE))
        down[0] = self.up[0] = 1
        np.cumprod(down, out=down)
        np.cumprod(self.up, out=self.up)
        self.sums = np.zeros(count + 1, np.uint64)
        np.cumsum(c.hashes * down[:count], out=self.sums[1:])
        self.slots = np.zeros(count + 1, np.int64)
        np.cumsum(~c.literal, out=self.slots[1:])

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        h = (self.sums[at + n] - self.sums[at + 1]) * self.up[at + n] + self.c.alone[at] * np.uint64(pow(_BASE, n, 1 << 64)) + np.uint64(n)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    def places(self, n: int, slots: int) -> np.ndarray:
        """First tokens of windows in one text that hold at least so many placeholders; short ones fill a line."""
        c, count = self.c, len(self.c.hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.int64)
        enough = self.slots[n:] - self.slots[:count] >= slots
        if n < LEAST:
            begins = np.append(True, c.line[1:] != c.line[:-1])
            ends = np.append(begins[1:], True)
            enough &= begins[:count] & ends[n - 1 :] & (c.line[:count] == c.line[n - 1 :])
        at = np.flatnonzero(enough)
        return at[c.text[at] == c.text[at + n - 1]]


def _slots(c: Canonical, at: int, n: int, whole: bool) -> list[str]:
    """What the placeholders stand for; of a whole chunk the first is a unit only behind a number of its own."""
    out = ["" if c.literal[k] else c.raw[k].decode(errors="replace").strip(_STRIP) for k in range(at, at + n)]
    if whole and c.alone[at] == c.plain[at]:
        out[0] = ""
    return out


def item_windows(texts: list[bytes]) -> list[tuple[int, int, int, int, bool, int, list[str]]]:
    """(number of the text, its tokens, place, length, whether a chunk, hash, slots) of every window in every reading."""
    c = canonical(texts)
    sizes = np.diff(c.starts)
    # what the windows of a copy cover at least: its first token may be read otherwise
    sure = np.zeros(len(c.hashes), bool)
    out: dict[tuple, tuple] = {}
    for reading in c.readings():
        for n in range(LEAST, WINDOW + 1):
            at, h = window_hashes(reading, n, min(LITERALS, n))
            for a, x in zip(at.tolist(), h.tolist()):
                k = int(c.text[a])
                if n == WINDOW or sizes[k] == n:
                    place = a - int(c.starts[k])
                    out.setdefault((k, place, n, x), (k, int(sizes[k]), place, n, False, x, _slots(reading, a, n, False)))
                    if place and reading is c:
                        sure[a : a + n] = True
    for reading in c.readings():
        wholes = Wholes(reading)
        for k, size in enumerate(sizes.tolist()):
            first = int(c.starts[k])
            if size and int(sure[first : first + size].sum()) * COVER[1] < size * COVER[0]:
                n = min(size, CHUNK)
                for place in sorted({*range(0, size - n, n), size - n}):
                    x = int(wholes.hashes(np.array([first + place]), n)[0])
                    out.setdefault((k, place, n, x), (k, size, place, n, True, x, _slots(reading, first + place, n, True)))
    return list(out.values())


def chunk_holds(own: list[str], other: list[str]) -> bool:
    """Equal values, or consistent ones among enough fixed tokens: words, and names that stayed."""
    if own == other:
        return True
    fixed = sum(a == b and not _NUMBER.fullmatch(a) for a, b in zip(own, other))
    if not (fixed >= LITERALS or fixed >= 2 and len(own) - fixed >= WINDOW):
        return False
    value: dict[str, str] = {}
    return all(value.setdefault(a, b) == b for a, b in zip(own, other) if a)


def judge(n_tokens: int, matches: list[tuple[int, int, int, bool, list[str], list[str]]]) -> tuple[int, int, int, bool] | None:
    """From (place in the item, place in the document, length, whether a chunk, item's slots, document's slots): windows,
    tokens covered, slots that changed, and whether any did; None if the item isn't found."""
    by_diagonal: dict[int, list] = {}
    for m in matches:
        if all(bool(a) == bool(b) for a, b in zip(m[4], m[5])) and (not m[3] or chunk_holds(m[4], m[5])):
            by_diagonal.setdefault(m[1] - m[0], []).append(m)
    places, covered, changed, alone = set(), set(), set(), []
    for rows in by_diagonal.values():
        seen: dict[str, Counter] = {}
        for m in rows:
            for a, b in zip(m[4], m[5]):
                if a:
                    seen.setdefault(a, Counter())[b] += 1
        # the most frequent value; of equally frequent ones the smallest
        value = {a: min(c, key=lambda b: (-c[b], b)) for a, c in seen.items()}
        fit = [m for m in rows if all(not a or value[a] == b for a, b in zip(m[4], m[5]))]
        own_places = {m[0] for m in fit}
        own_covered = {t for m in fit for t in range(m[0], m[0] + m[2])}
        own_changed = {a for m in fit for a, b in zip(m[4], m[5]) if a != b}
        if len(own_covered) * COVER[1] >= n_tokens * COVER[0]:
            alone.append((len(own_changed), -len(own_covered), -len(own_places)))
        places |= own_places
        covered |= own_covered
        changed |= own_changed
    if alone:
        n_changed, minus_covered, minus_places = min(alone)
        return -minus_places, -minus_covered, n_changed, n_changed > 0
    if len(covered) * COVER[1] < n_tokens * COVER[0]:
        return None
    return len(places), len(covered), len(changed), bool(changed)


def probes(total: int, windows: list[tuple[int, int, int, int]]) -> list[int]:
    """From (place, length, key, items with that key): the rarest keys, so that windows of the others cover too little
    of ``total`` tokens."""
    cover = np.zeros(max((p + n for p, n, *_ in windows), default=0), np.int64)
    by_key: dict[tuple[int, int], list] = {}
    for place, n, key, items in windows:
        cover[place : place + n] += 1
        by_key.setdefault((items, key), []).append((place, n))
    left, out = int((cover > 0).sum()), []
    for (_, key), places in sorted(by_key.items()):
        if left * COVER[1] < total * COVER[0]:
            break
        out.append(key)
        for place, n in places:
            cover[place : place + n] -= 1
        left = int((cover > 0).sum())
    return out


def value_cover(windows) -> int:
    """Tokens within the windows that hold a value."""
    return len({t for w in windows if any(w["slots"]) for t in range(w["place"], w["place"] + w["length"])})


_WINDOW = "struct<place:int,length:int,whole:boolean,h:bigint,exact:bigint,slots:array<string>>"
_WINDOW_ARROW = pa.struct([("place", pa.int32()), ("length", pa.int32()), ("whole", pa.bool_()), ("h", pa.int64()), ("exact", pa.int64()), ("slots", pa.list_(pa.string()))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def exact_key(h: int, slots: list[str]) -> int:
    """Key of a window with its values, signed as its hash is."""
    return _signed(xxhash.xxh64_intdigest("\x00".join(slots), seed=h & 0xFFFFFFFFFFFFFFFF))


def benchmark_items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """item, item_id, n_items, n_tokens, total, leads and windows of each distinct text that has windows. ``total`` is the
    number of tokens of which a document must cover enough: of those that lead a template all, else those near values."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    numbered = texts.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items")).withColumn("item", F.monotonically_increasing_id())
    schema = f"item long, item_id long, n_items long, n_tokens int, near_values int, template long, windows array<{_WINDOW}>"
    arrow = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("n_items", pa.int64()), ("n_tokens", pa.int32()), ("near_values", pa.int32()), ("template", pa.int64()), ("windows", pa.list_(_WINDOW_ARROW))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                raw = raw_texts(part.column("text"))
                c, windows = canonical(raw), {}
                for k, size, place, n, whole, h, slots in item_windows(raw):
                    windows.setdefault((k, size), []).append({"place": place, "length": n, "whole": whole, "h": _signed(h), "exact": exact_key(h, slots), "slots": slots})
                own = [part.column(name).to_pylist() for name in ("item", "item_id", "n_items")]
                template = lambda k: _signed(xxhash.xxh64_intdigest(c.hashes[c.starts[k] : c.starts[k + 1]].tobytes()))  # noqa: B023, E731
                rows = [(*(x[k] for x in own), size, value_cover(w), template(k), w) for (k, size), w in windows.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    items = scratch.keep(numbered.mapInArrow(run, schema), "items")
    first = items.groupBy("template").agg(F.min("item").alias("first"))
    leads = F.col("item") == F.col("first")
    return scratch.keep(items.join(first, "template").select("item", "item_id", "n_items", "n_tokens", F.when(leads, F.col("n_tokens")).otherwise(F.col("near_values")).alias("total"), leads.alias("leads"), "windows"), "items")


def item_probes(items: DataFrame) -> DataFrame:
    """key, item: the windows by which documents find each item; with its values unless it leads its template."""
    w = F.col("w")
    rows = items.select("item", "total", "leads", F.explode("windows").alias("w")).where(F.col("leads") | (F.array_max("w.slots") != ""))
    keyed = rows.select("item", "total", "leads", "w.place", "w.length", F.when(F.col("leads"), w["h"]).otherwise(w["exact"]).alias("key"))
    # how many items have the key; partial sums, no list
    counts = keyed.select("leads", "key", "item").distinct().groupBy("leads", "key").agg(F.count("*").alias("items"))
    grouped = keyed.join(counts, ["leads", "key"]).groupBy("item", "total").agg(F.collect_list(F.struct("place", "length", "key", "items")).alias("w"))  # one text's windows
    arrow = pa.schema([("key", pa.int64()), ("item", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, of = [], []
            for item, total, windows in zip(*(batch.column(c).to_pylist() for c in ("item", "total", "w"))):
                got = probes(total, [(w["place"], w["length"], w["key"], w["items"]) for w in windows])
                keys += got
                of += [item] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(of, pa.int64())], schema=arrow)

    return grouped.select("item", "total", "w").mapInArrow(run, "key long, item long")


class Bits:
    """A set of keys as bits: two per key, at least ``LEAST_BITS`` and at most ``MOST_BITS`` in all."""

    def __init__(self, keys: DataFrame, n: int):
        size = LEAST_BITS
        while size < MOST_BITS and size < 32 * n:
            size *= 2
        self.size, self.bits = size, np.zeros(size // 64, np.uint64)
        places = keys.select(F.explode(F.array(F.pmod("key", F.lit(size)), F.pmod(F.shiftrightunsigned("key", 32), F.lit(size)))).alias("b"))
        # one row per word of the array at most
        words = places.groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits")).toArrow()
        self.bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Of uint64 keys: False is sure."""
        mask = np.uint64(self.size - 1)
        out = self._bit(keys & mask)
        maybe = np.flatnonzero(out)
        out[maybe] = self._bit((keys[maybe] >> np.uint64(32)) & mask)
        return out

    def _bit(self, b: np.ndarray) -> np.ndarray:
        return (self.bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0


@dataclass
class Lookup:
    """What the tasks need of the benchmark."""

    windows: Bits
    probes: Bits
    lengths: list[int]  # of windows
    chunks: dict[int, int]  # length to least count of placeholders

    def find(self, c: Canonical) -> list[tuple[np.ndarray, np.ndarray, int, bool]]:
        """(first tokens, hashes, length, whether chunks) of the document windows that the benchmark may have."""
        out = []
        for n in self.lengths:
            at, h = window_hashes(c, n, min(LITERALS, n))
            maybe = self.windows.has(h)
            out.append((at[maybe], h[maybe], n, False))
        if self.chunks and len(c.hashes):
            wholes = Wholes(c)
            for n, slots in self.chunks.items():
                at = wholes.places(n, slots)
                h = wholes.hashes(at, n)
                maybe = self.windows.has(h)
                out.append((at[maybe], h[maybe], n, True))
        return out


_HIT = "struct<at:int,length:int,whole:boolean,h:bigint,slots:array<string>>"
_HIT_ARROW = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("whole", pa.bool_()), ("h", pa.int64()), ("slots", pa.list_(pa.string()))])
_MET = f"came long, doc_id long, row_key long, keys array<long>, hits array<{_HIT}>"
_MET_ARROW = pa.schema([("came", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("hits", pa.list_(_HIT_ARROW))])


def document_hits(rows: DataFrame, lookup: Lookup) -> DataFrame:
    """Documents (came, doc_id, row_key, text) that hold a probe: their hits, and the keys of these that may be probes."""
    shared = rows.sparkSession.sparkContext.broadcast(lookup)

    def met(part: pa.RecordBatch) -> list[tuple]:
        c = canonical(raw_texts(part.column("text")))
        hits: dict[int, list] = {}
        for at, h, n, whole in shared.value.find(c):
            for a, x in zip(at.tolist(), h.view(np.int64).tolist()):
                k = int(c.text[a])
                hits.setdefault(k, []).append({"at": a - int(c.starts[k]), "length": n, "whole": whole, "h": x, "slots": _slots(c, a, n, whole)})
        out = []
        for k, found in hits.items():
            keys = np.unique(np.array([y for x in found for y in (x["h"], exact_key(x["h"], x["slots"]))], np.int64))
            keys = keys[shared.value.probes.has(keys.view(np.uint64))]
            if len(keys):
                out.append((*(part.column(name)[k].as_py() for name in ("came", "doc_id", "row_key")), keys, found))
        return out

    def run(batches):
        with given_back(_forget):
            for batch in batches:
                for part in slices(batch):
                    if out := met(part):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _MET_ARROW)], schema=_MET_ARROW)

    return rows.mapInArrow(run, _MET)


HIT_SCHEMA = "doc_id long, row_key long, item_id long, n_windows long, n_covered long, n_item_tokens long, n_changed long, reparameterised boolean, n_items long"
_LONGS = ("doc_id", "row_key", "item_id", "n_windows", "n_covered", "n_item_tokens", "n_changed")
HIT_ARROW = pa.schema([*((n, pa.int64()) for n in _LONGS), ("reparameterised", pa.bool_()), ("n_items", pa.int64())])


_PAIR = ["doc_id", "row_key", "item_id", "n_items", "n_tokens", "total", "leads", "windows", "hits"]


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs with the document's hits and the item's windows to the rows found."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                out = []
                for doc, key, item, n_items, n, total, leads, windows, hits in zip(*(batch.column(c).to_pylist() for c in _PAIR)):
                    by_hash: dict[int, list] = {}
                    for w in windows:
                        by_hash.setdefault(w["h"], []).append(w)
                    met = [(w, x) for x in hits for w in by_hash.get(x["h"], ()) if w["length"] == x["length"] and w["whole"] == x["whole"]]
                    if not leads:
                        met = [(w, x) for w, x in met if w["slots"] == x["slots"]]
                        if value_cover(w for w, _ in met) * COVER[1] < total * COVER[0]:
                            continue
                    got = judge(n, [(w["place"], x["at"], w["length"], w["whole"], w["slots"], x["slots"]) for w, x in met])
                    if got:
                        out.append((doc, key, item, got[0], got[1], n, got[2], got[3], n_items))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), HIT_ARROW)], schema=HIT_ARROW)

    return pairs.select(*_PAIR).mapInArrow(run, HIT_SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark_items(benchmark, scratch)
    wanted = scratch.keep(item_probes(items), "probes")
    hashes = items.select(F.explode("windows").alias("w")).select(F.col("w.h").alias("key"), "w.length", "w.whole", F.size(F.array_remove("w.slots", "")).alias("slots"))
    # at most CHUNK rows of each kind
    kinds = hashes.groupBy("whole", "length").agg(F.min("slots").alias("slots"), F.count("*").alias("n")).collect()
    if not kinds:
        return spark.createDataFrame([], HIT_SCHEMA)
    lookup = Lookup(Bits(hashes, sum(r["n"] for r in kinds)), Bits(wanted, wanted.count()), sorted(r["length"] for r in kinds if not r["whole"]), {r["length"]: r["slots"] for r in sorted(kinds, key=lambda r: r["length"]) if r["whole"]})
    rows = docs.select(F.monotonically_increasing_id().alias("came"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    met = scratch.keep(document_hits(rows, lookup), "met")
    pairs = scratch.keep(met.select("came", F.explode("keys").alias("key")).join(wanted, "key").select("came", "item").distinct(), "pairs")
    return judged(pairs.join(met.drop("keys"), "came").join(items, "item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay."""
    hits = contaminated(docs, benchmark)
    return without(docs, hits.select(F.col("doc_id").alias("_gone_id"), F.col("row_key").alias("_gone_key")))
