"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `bits` bits; the Hilbert index of the cell orders the rows (ties: row id), and the order
is cut into runs, so that a shard covers a compact box of all dimensions and files can be pruned on any of them. The
global position of a row is its position within a range partition plus the sizes of the partitions before it: no
window over all rows, and a cell that holds a third of all rows is split by its row ids.

Defined edge cases: nulls in a dimension go to cell 0, values outside a range to its border cells; null texts have
size 16 and the checksum of the empty text; null or repeated ids keep their rows, each with a place of its own; an
empty table gives no rows; columns that clash with a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS = 40
BITS = 6
OVERHEAD = 16


def index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indexes of rows of integer coordinates below 2**bits (bits times dimensions at most 62).

    From the highest bit down the coordinates are turned into the curve's frame (the lower bits of the first axis are
    inverted, or exchanged with another axis); what remains is Gray-coded and its bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            inverted = (x[i] >> level) & 1 == 1
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> level) & 1
    return out


def quantise(value: Column, low: float, high: float, bits: int = BITS) -> Column:
    """Cell of a number between two bounds (null: 0)."""
    cell = F.floor((value.cast("double") - low) * (1 << bits) / (high - low))
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def label_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a label: its hash, as labels have no order (null: 0)."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("long")


def shards(df: DataFrame, cells: list[Column], tie: list[str], *, n: int = SHARDS, bits: int = BITS) -> DataFrame:
    """df with curve (index), shard and slot: runs of the curve's order whose row counts differ by one at most."""
    names = [f"__cell{i}" for i in range(len(cells))]

    def make():
        def f(batch: pa.RecordBatch) -> list:
            return [pa.array(index(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1), bits))]

        return f

    curved = common.append_columns(df.drop("curve", "shard", "slot").select("*", *[c.alias(a) for c, a in zip(cells, names, strict=True)]), make, [T.StructField("curve", T.LongType())]).drop(*names)
    ordered = curved.repartitionByRange("curve", *tie).sortWithinPartitions("curve", *tie)
    # The bounds are sampled, so the order is written down before it is counted.
    ordered = common.materialise(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.cast("int").alias("p")).count().collect()  # one row for each range partition
    starts, total = {}, 0
    for p, c in sorted((r["p"], r["count"]) for r in sizes):
        starts[p] = total
        total += c
    offsets = ordered.sparkSession.createDataFrame([*starts.items()] or [(0, 0)], "__p int, __start long")
    placed = ordered.withColumn("__p", part.cast("int")).join(F.broadcast(offsets), "__p").withColumn("__rank", F.col("__start") + within)
    placed = placed.withColumn("shard", F.expr(f"cast(({n} * (__rank + 1) - 1) div {max(1, total)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"cast(__rank - (shard * {total}L) div {n} as int)"))
    return placed.drop("__at", "__p", "__start", "__rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + OVERHEAD
    rows = docs.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), label_cell(F.col("lang")).alias("lang"), label_cell(F.col("source")).alias("source"))
    cells = [F.col("lang"), F.col("source"), quantise(F.log2(F.col("size").cast("double")), 4.0, 28.0)]
    found = shards(rows, cells, ["doc_id", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
