"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* columns are read by name, so further columns of the input, whatever their names, are ignored;
* a null text counts as the empty text unless the operator's docstring says otherwise;
* repeated rows are kept as they are: one output row for each input row where the operator returns rows per document;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.scratch import Scratch  # noqa: F401
from strandline.sources.spread import spread

#: Rows and bytes of text that a worker handles at a time; one longer text is handled alone.
SUB_BATCH = 256
SUB_BYTES = 4 << 20
#: Rows of two numbers that are broadcast once their count proves it; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def native_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As it is read: for the operators that use nothing but DataFrame functions."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = SUB_BATCH) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``SUB_BYTES`` bytes of the column ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(int(np.searchsorted(ends, before + SUB_BYTES, "right")), at + rows)
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


@contextlib.contextmanager
def given_back(forget: Callable[[], None] | None = None):
    """Around a task's work in Python. Workers outlive tasks, so what a task looked up mustn't stay (``forget``), and what
    was freed goes back to the system: many idle workers would else hold the most that each of them ever needed."""
    try:
        yield
    finally:
        if forget:
            forget()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, arrow: pa.Schema, text: str = "text", forget: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over small slices; ``fn`` gives a dict of columns for a slice. ``forget``: see ``given_back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with given_back(forget):
            for batch in batches:
                for part in slices(batch, text):
                    got = fn(part)
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_key(text) -> F.Column:
    """Two columns' worth of fingerprint for telling rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) isn't in ``gone`` (columns ``_gone_id``, ``_gone_key``), all columns kept.

    ``gone`` is written and counted. Up to ``MOST_BROADCAST`` rows are broadcast, so that texts aren't shuffled; more are
    joined by a shuffle on the equality keys, whose skewed partitions Spark splits.
    """
    gone = Scratch(docs.sparkSession).keep(gone.distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone.hint("merge")
    on = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (text_key(docs["text"]) == gone["_gone_key"])
    return docs.join(gone, on, "left_anti")
