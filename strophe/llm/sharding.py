"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0..n-1 by ascending key (ties by a hash of the other order columns, then by these),
without a sort in one task: rows are dealt by ranges of all of that, so that rows of one key, nulls too,
and rows repeated in full are parted as well; they are numbered within a range, and the ranges' sizes
are summed up. A keyed Feistel network permutes the least power of four that is at least n; a value
of n or more is put through again until it falls under n (cycle walking), which makes the whole a
permutation of 0..n-1. Place p belongs to shard ``p mod shards`` at slot ``p div shards``: shard
sizes differ by one row at most, and ``place_of`` and ``row_at`` compute both directions without data.

Edge cases: a null text has no bytes and the checksum of the empty text; null keys come first; rows
equal in all order columns get different numbers (which of them gets which cannot be told apart);
an empty table gives an empty result; one row is shard 0, slot 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strophe.llm.common import free_name, materialize, mix64, shuffle_width

ROUNDS = 6


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    w = np.uint64(bits)
    left, right = x >> w, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = np.uint64((seed * ROUNDS + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << w) | right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    bits = half_bits(n)
    out = _network(np.asarray(x).astype(np.uint64), bits, seed, back)
    far = np.flatnonzero(out >= n)
    while len(far):
        out[far] = _network(out[far], bits, seed, back)
        far = far[out[far] >= n]
    return out.astype(np.int64)


def place_of(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Shuffled places of row numbers."""
    return _walk(rows, n, seed, False)


def row_at(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row numbers at places: the inverse of ``place_of``."""
    return _walk(places, n, seed, True)


def number_rows(df: DataFrame, key: str, ties: list[str], name: str = "row_number", rows_each: int = 1 << 20) -> DataFrame:
    """``df`` with global row numbers by ``key`` (nulls first), a hash of ``ties`` and ``ties``; one shuffle by ranges.

    The sorted rows are written to shared scratch; ``df`` should be cheap to read twice (ranges are sampled).
    """
    tie, place, uid, part, off = (free_name(df, c) for c in ("_tie", "_place", "_uid", "_part", "_offset"))
    ranges = max(shuffle_width(df.sparkSession), df.count() // rows_each + 1)
    order = [F.col(key).asc_nulls_first(), F.col(tie), *ties, F.col(uid)]
    rows = df.withColumn(tie, F.xxhash64(*ties) if ties else F.lit(0)).withColumn(uid, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop(tie, uid)
    # The id's upper bits are the range, its lower 33 bits the row's number within it.
    rows = materialize(rows.withColumn(place, F.monotonically_increasing_id())).withColumn(part, F.shiftright(place, 33))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range: one to a million rows
    sizes = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias(off))
    numbered = rows.join(F.broadcast(sizes), part)
    return numbered.withColumn(name, F.col(off) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, off, place)


def shard(df: DataFrame, key: str = "doc_id", ties: list[str] | None = None, shards: int = 8, seed: int = 0) -> DataFrame:
    """``df`` with ``shard int`` and ``slot bigint`` (names get underscores before them on a clash)."""
    ties = [c for c in df.columns if c != key] if ties is None else ties
    place, row = free_name(df, "_place"), free_name(df, "_row")
    n = df.count()

    @pandas_udf("bigint")
    def permuted(x):
        import pandas as pd

        return pd.Series(place_of(x.to_numpy(), n, seed))

    out = number_rows(df, key, ties, row).withColumn(place, permuted(F.col(row)))
    shard_name, slot_name = free_name(df, "shard"), free_name(df, "slot")
    return out.withColumn(shard_name, (F.col(place) % shards).cast("int")).withColumn(slot_name, F.expr(f"`{place}` div {shards}")).drop(place, row)


def write_shards(df: DataFrame, path: str, shards: int = 8, files_each: int = 1, **options) -> None:
    """Writes whole rows as one folder per shard, each file a range of slots in order.

    ``files_each`` ranges a shard: raise it with the data, so that a file fits an executor.
    """
    placed = shard(df, shards=shards, **options)
    s, t = placed.columns[-2:]
    placed.repartitionByRange(shards * files_each, s, t).sortWithinPartitions(s, t).write.partitionBy(s).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lean = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shard(materialize(lean))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
