"""Operator 4: contiguous shards of near-equal bytes from global prefix sums, all in DataFrame functions.

Rows are dealt by range of doc_id, so a partition holds a contiguous stretch. Within each partition a running sum gives
local prefixes; the partitions' totals, one row each, are summed into offsets; both together give every row's place in
the global order of bytes and of rows. Cuts at equal targets of the total then give shards that differ by no more than
about the largest document.

Only ids, sizes and checksums are shuffled, never texts. The order is (doc_id, text_crc32, size) with nulls first, and
rows that are equal in all of these, as repeated rows are, are spread over partitions by their place in the input:
which of them comes first makes no difference. The dealt rows are written to the shared folder, so that a recomputed
task can't see other partition bounds than the totals did. A null text has size 16 and checksum 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

OVERHEAD = 16


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("came"),
    )
    scratch = Scratch(docs.sparkSession)
    order = ["doc_id", "text_crc32", "size", "came"]
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards)
    dealt = scratch.keep(rows.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()), "dealt")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # one row per partition, so a single window over all of them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("bytes_here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rows_here", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "part")  # at most n_parts rows
    )
    # by the middle of a row: its shard is the target interval that holds it
    middle = 2 * (F.col("bytes_before") + F.col("bytes_here")) + F.col("size")
    cut = placed.select("doc_id", "size", "text_crc32", middle.alias("middle"), "total", (F.col("rows_before") + F.col("rows_here")).alias("row_no"))
    cut = scratch.keep(cut.select("doc_id", "size", "text_crc32", F.expr(f"cast(middle * {n_shards} div (2 * total) as int)").alias("shard"), "row_no"), "cut")
    scratch.drop(dealt)
    firsts = cut.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # at most n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_no") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shards_sql(n_shards: int = 40) -> str:
    """The same law by one global window; the checksum is worked out byte by byte."""
    return f"""
    WITH tbl AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
         d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         s AS (SELECT doc_id, octet_length(encode(text)) + {OVERHEAD} AS size,
                      xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                                                  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS text_crc32 FROM d, tbl),
         p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
                      row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS row_no FROM s),
         c AS (SELECT *, CAST((2 * before + size) * {n_shards} // (2 * total) AS INT) AS shard FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
           CAST(row_no - min(row_no) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM c"""
