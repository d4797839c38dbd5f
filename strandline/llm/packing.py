"""Operator 3: best-fit packing into bins of several permitted lengths.

A document is a run of tokens of the subword model that operator 8 counts with, and one end token. Documents longer than
the largest permitted length are cut into pieces of that length and a rest. Pieces are dealt by a hash into groups of
about ``GROUP`` tokens, so a group is bounded however large or skewed the corpus is, and each group is packed alone by
best-fit decreasing:

* a piece goes into the open bin whose space left is the smallest that holds it (the oldest such bin);
* where none holds it, a bin is opened whose length is chosen over all permitted ones together. For each length a trial
  fill takes, the largest first, the pieces still to come that fit; what the space left in open bins will take of them
  doesn't count. The length wins at which a token costs least; ties go to the longer one. A bin costs its length, a
  fixed ``BIN_COST``, and the square of its length over ``SQUARE``, as attention does, so short bins win where they fill
  well and long ones are for long pieces;
* at last every bin is downsized to the least permitted length that holds its contents.

The result has one row per bin, with its tokens and what lies where. Null and empty texts are pieces of one token, the
end token. Repeated rows are packed as often as they appear. Null doc_ids stay null. Lengths of one tie by the order of
doc_id, row and piece.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, given_back, slices
from strandline.llm.tokencount import default_model_path, unit_encoder

LENGTHS = (1024, 2048, 4096, 8192, 16384)
BIN_COST = 64
#: Length at which attention costs as much as all the rest: six times a model width of 4096.
SQUARE = 24_576
#: Tokens of a group: 8 MB of 16-bit numbers.
GROUP = 1 << 22
#: Rows that are encoded at a time, up to 4 MB of text: the more, the more words repeat.
ROWS = 4096


def cost_of(length: int, bin_cost: int = BIN_COST, square: int = SQUARE) -> float:
    return length + bin_cost + length * length / square


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST, square: int = SQUARE) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final length of each bin. Pieces are taken by size, large first, then in order."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rising = [sizes[i] for i in reversed(order)]
    to_come = sum(sizes)
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    open_bins: list[tuple[int, int]] = []  # space left, bin
    space = 0  # in all of them

    def least(content: int) -> int:
        return next(x for x in lengths if x >= content)

    def opening(size: int, n_left: int) -> int:
        """``n_left`` pieces, the first of ``rising``, are still to come."""
        supply, best = max(0, to_come - space), None
        for length in lengths:
            if length >= size:
                left, end = length - size, n_left
                while left and (end := bisect_right(rising, left, 0, end)):
                    end -= 1
                    left -= rising[end]
                content = min(length - left, size + supply)
                rate = (cost_of(least(content), bin_cost, square) / content, -length)
                if best is None or rate < best:
                    best = rate
        return -best[1]

    for k, i in enumerate(order):
        size = sizes[i]
        to_come -= size
        at = bisect_right(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            space -= size
        else:
            left, b = opening(size, len(order) - k - 1), len(used)
            used.append(0)
            space += left - size
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(open_bins, (left - size, b))
    return bin_of, offset, [least(u) for u in used]


PIECE_SCHEMA = "doc_id long, came long, piece int, start long, n_tokens long, tokens binary"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("came", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])


def pieces(docs: DataFrame, longest: int, model_path: str | None = None) -> DataFrame:
    """doc_id, came, piece, start, n_tokens and tokens (16-bit numbers, 32-bit ones if the vocabulary needs them): every
    document with its end, cut at ``longest``."""
    path = model_path or default_model_path()

    def run(batches):
        encode = unit_encoder(path)
        with given_back(encode.end_task):
            for batch in batches:
                for part in slices(batch, rows=ROWS):
                    rows = []
                    for doc, came, ids in zip(part.column("doc_id").to_pylist(), part.column("came").to_pylist(), encode.all_ids(part.column("text"))):
                        ids = np.append(ids, encode.kind(encode.end))
                        rows += [(doc, came, k, a, min(longest, len(ids) - a), ids[a : a + longest].tobytes()) for k, a in enumerate(range(0, len(ids), longest))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECE_ARROW)], schema=_PIECE_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("came"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


SCHEMA = "bin_id long, bin_length int, bin_used int, doc_ids array<long>, pieces array<int>, starts array<long>, offsets array<int>, tokens array<int>"
_ARROW = pa.schema([("bin_id", pa.int64()), ("bin_length", pa.int32()), ("bin_used", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def best_fit_bins(docs: DataFrame, lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST, square: int = SQUARE, group: int = GROUP, model_path: str | None = None) -> DataFrame:
    """One row per bin: its length and tokens used, the pieces in it (document, number, first token in the document, place
    in the bin), and the tokens themselves."""
    lengths = sorted(set(lengths))
    path = model_path or default_model_path()
    rows = Scratch(docs.sparkSession).keep(pieces(docs, lengths[-1], path), "pieces")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n_groups = max(1, -(-total // group))
    # by a hash of the row's place as well, so that repeated rows spread
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "came"), F.lit(n_groups)))

    kind = unit_encoder(path).kind

    def run(key: tuple, part: pa.Table) -> pa.Table:
        with given_back():
            part = part.sort_by([("doc_id", "ascending"), ("came", "ascending"), ("piece", "ascending")])
            sizes = part.column("n_tokens").to_pylist()
            bin_of, offset, final = pack(sizes, lengths, bin_cost, square)
            placed = np.lexsort((offset, bin_of))
            ends = np.cumsum(np.bincount(bin_of, minlength=len(final)))
            used = np.bincount(bin_of, weights=sizes, minlength=len(final)).astype(np.int64)
            at = pa.array(np.concatenate([[0], ends]), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(at, x)
            own = lambda name: part.column(name).combine_chunks().take(pa.array(placed))
            tokens = np.frombuffer(b"".join(own("tokens").to_pylist()), kind).astype(np.int32)
            # bins of all groups are told apart by the group in the upper digits
            ids = np.arange(len(final), dtype=np.int64) + (int(key[0].as_py()) << 32)
            columns = [pa.array(ids), pa.array(final, pa.int32()), pa.array(used, pa.int32()), listed(own("doc_id")), listed(own("piece")), listed(own("start")), listed(pa.array(np.array(offset)[placed], pa.int32())), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]), pa.int32()), pa.array(tokens))]
            return pa.table(columns, schema=_ARROW)

    return dealt.groupBy("pack").applyInArrow(run, SCHEMA)


def placements(bins: DataFrame) -> DataFrame:
    """doc_id, piece, start, bin_id and bin_offset of every piece."""
    return bins.select("bin_id", F.inline(F.arrays_zip("doc_ids", "pieces", "starts", "offsets"))).select(F.col("doc_ids").alias("doc_id"), F.col("pieces").alias("piece"), F.col("starts").alias("start"), "bin_id", F.col("offsets").alias("bin_offset"))
