"""Helpers that the operators of this subpackage share.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor can reach, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType


#: Scratch tables of this process, oldest first.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a temporary folder of our own where that is
    unset and all runs on this machine. On a cluster an unset folder is an error: executors share no disk."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to shared scratch and reads them back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the scratch tables from the ``since``-th on, the last ``but`` excepted; frames that read them end with them."""
    gone = _WRITTEN[since : len(_WRITTEN) - but]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def scratch_tables() -> int:
    return len(_WRITTEN)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MOST_CUTS = 50_000


def with_range(df: DataFrame, key: str, tie: Column, name: str, rows_each: int = 4000) -> DataFrame:
    """``df`` with ``name``: a number (bigint) that rises with (key, tie) and has about ``rows_each`` rows, of any table.

    First come quantiles of the integer column ``key`` (a bounded list on the driver: ``MOST_CUTS`` at most; nulls
    come first); a key that takes more than a quantile has a range to itself. A range of more rows than
    twice ``rows_each`` is parted further: one of a single key, or of nulls, by ``tie`` (a 64-bit hash, in its
    own order), one of many keys evenly between its least and greatest. Rows of equal key and tie stay
    together. The result of whatever uses the ranges must not hang on where they are cut.
    """
    n = df.count()
    parts = int(min(MOST_CUTS, max(1, n // rows_each)))
    found: list[int] = []
    if parts > 1:
        found = df.agg(F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] or []
    cuts = sorted({int(x) for x in found} | {int(x) + 1 for x, y in pairwise(found) if x == y})
    bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    # Binary search: the number of cuts that are not above the key.
    higher = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(bounds, acc + s - 1) <= F.col(key)), acc + s).otherwise(acc)
    inside = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), higher) if cuts else F.lit(0)
    first = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(inside)
    if n <= 2 * rows_each:
        return df.withColumn(name, first.cast("bigint") * F.lit(1 << 31))
    at, low, high, ways = (free_name(df, c) for c in ("_at", "_low", "_high", "_ways"))
    large = df.groupBy(first.alias(at)).agg(F.min(key).alias(low), F.max(key).alias(high), F.count(F.lit(1)).alias(ways)).where(F.col(ways) > 2 * rows_each)
    large = materialize(large.withColumn(ways, F.expr(f"`{ways}` div {rows_each} + 1")))  # a row per range at most
    cut = df.withColumn(at, first).join(F.broadcast(large), at, "left")
    by_tie = F.shiftright((F.shiftright(tie, 33) + F.lit(1 << 30)) * F.col(ways), 31)
    by_key = F.floor((F.col(key).cast("double") - F.col(low)) / (F.col(high).cast("double") - F.col(low) + 1) * F.col(ways)).cast("bigint")
    sub = F.when(F.col(ways).isNull(), F.lit(0)).when(F.col(low).isNull() | (F.col(low) == F.col(high)), by_tie).otherwise(F.least(by_key, F.col(ways) - 1))
    return cut.withColumn(name, F.col(at).cast("bigint") * F.lit(1 << 31) + sub).drop(at, low, high, ways)


def range_of(name: str) -> Column:
    """The first-level range of a number from ``with_range``: at most 2 * ``MOST_CUTS`` of them."""
    return F.shiftright(name, 31)


def running_sums(counts: DataFrame, within: list[str], order: str, group: Column, value: str, name: str) -> DataFrame:
    """``counts`` with the sum of ``value`` over the rows before in ``order``, in two levels.

    ``group`` rises with ``order``; sums run inside a group, and over the groups' totals.
    """
    g, ahead, total = (free_name(counts, c) for c in ("_group", "_ahead", "_total"))
    cut = counts.withColumn(g, group)
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*within, g).agg(F.sum(value).alias(total))
    totals = totals.select(*within, g, F.coalesce(F.sum(total).over(before(within, g)), F.lit(0).cast("bigint")).alias(ahead))
    inside = F.coalesce(F.sum(value).over(before([*within, g], order)), F.lit(0).cast("bigint"))
    return cut.withColumn(name, inside).join(totals, [*within, g]).withColumn(name, F.col(name) + F.col(ahead)).drop(g, ahead)


#: Characters of texts that one numpy step takes at a time (or one text, if it is longer).
CHARS = 500_000


def release_memory() -> None:
    """Hands memory that a worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def text_runs(column, chars: int = CHARS) -> Iterator[list[str]]:
    """The texts of an Arrow column (null: empty) in lists that end where ``chars`` is passed.

    Garbage collection rests meanwhile: there are many small lists and tuples and no cycles.
    """
    texts: list[str] = []
    total = 0
    on = gc.isenabled()
    gc.disable()
    try:
        for x in column:
            texts.append(x.as_py() or "")
            total += len(texts[-1])
            if total >= chars:
                yield texts
                texts, total = [], 0
        if texts:
            yield texts
    finally:
        if on:
            gc.enable()
        del texts
        release_memory()


def map_texts(df: DataFrame, make: Callable[[list[str]], dict], schema: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``make(texts) -> columns`` over whole texts (null: empty) in Arrow batches.

    A batch is worked off in runs of ``CHARS`` characters, so memory follows that bound and the
    longest text. ``keep`` columns are passed through; ``schema`` names all columns that come out.
    """

    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields if f.name not in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {c: batch.column(c) for c in keep}
            at = 0
            for texts in text_runs(batch.column(text_col)):
                out = make(texts)
                cols = {c: v.slice(at, len(texts)) for c, v in kept.items()}
                yield pa.RecordBatch.from_pydict({**cols, **{c: pa.array(v, types[c]) for c, v in out.items()}})
                at += len(texts)

    names = list(dict.fromkeys([*keep, text_col]))
    return df.select(*names).mapInArrow(run, schema)


def of_texts(make: Callable[[list[str]], list], kind: str):
    """A column function: ``make(texts)`` over whole texts, a value per row. The rows' other columns stay
    in the JVM, so a text goes to Python once and does not come back."""
    arrow_type = to_arrow_type(DataType.fromDDL(kind))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = [pa.array(make(texts), arrow_type) for texts in text_runs(part)]
            yield pa.concat_arrays(out) if out else pa.array([], arrow_type)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v bigint): a row (id, component) per node with an edge.

    The component is the least id in it. Each round every node hooks to the first of itself and its
    neighbours, hooks are followed to their roots by doubling, and the edges between roots go to the
    next round until none is left. First is the least id in the first round (stars collapse at once)
    and the least of a fresh hash in later ones: a node with an edge then comes first with chance one
    half at most, so that the nodes left halve on average and rounds grow with the logarithm of their
    number, whatever the diameter. A hub's rows are reduced before its neighbours' minimum is shuffled;
    the join that takes edges to their ends' roots has the hub as its key and leans on the adaptive skew
    join, which splits that key's rows. Hooks and edges are written to shared scratch each round.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    live = materialize(edges.where("u <> v").select(*pair).distinct())
    hooks: list[DataFrame] = []  # one per round: every node that had an edge, and its root
    while not hooks or live.limit(1).count():
        first = lambda c: F.xxhash64(c, F.lit(len(hooks))) if hooks else F.col(c)
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("id")).agg(F.min_by("v", first("v")).alias("v"))
        hook = materialize(near.select("id", F.when(first("v") < first("id"), F.col("v")).otherwise(F.col("id")).alias("root")))
        while True:
            jump = hook.select(F.col("id").alias("root"), F.col("root").alias("next"))
            new = materialize(hook.join(jump, "root").select("id", F.col("root").alias("old"), F.col("next").alias("root")))
            hook = new.select("id", "root")
            if new.where("old <> root").limit(1).count() == 0:
                break
        hooks.append(hook)
        ends = live.join(hook.select(F.col("id").alias("u"), F.col("root").alias("ru")), "u").join(hook.select(F.col("id").alias("v"), F.col("root").alias("rv")), "v")
        live = materialize(ends.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    found = hooks.pop()
    if not hooks:
        return found.select("id", F.col("root").alias("component"))
    while hooks:
        later = found.select(F.col("id").alias("root"), F.col("root").alias("last"))
        found = hooks.pop().join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    found = materialize(found)
    return materialize(found.join(found.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
