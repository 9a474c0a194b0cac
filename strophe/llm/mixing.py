"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

* Targets: the sources, by code point and null last, weigh 5, 2, 1, 5, 2, 1, ...; together they take
  ``share`` of all words; a source stops at ``most`` times its own words and what it cannot take is
  dealt out again by weight until no source is above (the fixed point, computed by sorting the
  sources by how soon they fill).
* Schedule: slot i of the mix is the golden-ratio point frac((i + 1/2) * phi), in 62-bit integers, mapped
  through the sources' cumulative slots to a source by binary search, so that every stretch of the mix holds
  each source in proportion. A source needs its blocks for every full epoch and those of its last one.
* Rank: a slot's number among its source's slots, from counts per chunk of slots and ranks within a chunk.
* Blocks: a source's documents in hashed order are one stream of words, cut into blocks of
  ``block`` words; slot rank r takes block r modulo the source's blocks (its r div blocks-th epoch).
  A source's slots beyond its target are dropped and its last slot is cut to fit; the few ranks that
  the points leave out (discrepancy) are appended, so every source meets its target to a word.

The driver holds a row per source (its size and target), which the schedule needs as a whole.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own,
the last; null and repeated ids are rows like any other, ordered by their texts; rows repeated in full are
separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import free_name, materialize, running_sums

BLOCK = 256
CHUNK = 1 << 12
SHARE, MOST = 1.5, 2.0
WEIGHTS = (5, 2, 1)
POINT_BITS = 62
GOLDEN = 0x13C6EF372FE94F83  # the golden ratio's fraction times 2**61, to the next odd number


def words(text: Column) -> Column:
    """Number of ASCII-blank separated words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def target_table(sizes: dict[str | None, int], share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target words of each source; ``sizes`` has a row per source (a list on the driver, not of documents)."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_weight = share * sum(sizes.values()), sum(weight.values())
    full: set[str | None] = set()
    level = left / open_weight if open_weight else 0.0
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):  # those that fill first
        if most * sizes[s] > level * weight[s]:
            break
        full.add(s)
        left -= most * sizes[s]
        open_weight -= weight[s]
        level = left / open_weight if open_weight else 0.0
    return {s: float(most * sizes[s]) if s in full else level * weight[s] for s in names}


def arrange(docs: DataFrame, keep: list[str], text_col: str, source_col: str, seed: int, order: Column) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """Documents as intervals of their source's word stream: keep, size, code (of the source), start."""
    lean = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), order.alias("hash"))
    lean = materialize(lean)
    found = lean.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # a row per source
    sizes = {r["source"]: r["n"] for r in found}
    names = [*target_table(sizes)]
    most_rows = max((r["rows"] for r in found), default=1)
    pieces = max(1, most_rows // 512)  # of the hash's range: about 512 documents of the largest source in each
    known = F.from_json(F.lit(json.dumps({s: i for i, s in enumerate(names) if s is not None})), "map<string,int>")
    code = F.coalesce(F.element_at(known, F.col("source")), F.lit(len(names) - 1))
    spread = (F.shiftright("hash", 33).bitwiseAND(F.lit((1 << 31) - 1)) * pieces).cast("bigint")  # as the hash rises without its sign
    lean = lean.withColumn("code", code).withColumn("piece", F.shiftright(spread, 31))
    sums = lean.groupBy("code", "piece").agg(F.sum("size").alias("n"))
    sums = running_sums(sums, ["code"], "piece", F.shiftright("piece", 12), "n", "offset").drop("n")
    unsigned = [F.col("hash") < 0, F.col("hash")]
    inside = Window.partitionBy("code", "piece").orderBy(*unsigned, *[f"k_{c}" for c in keep], "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = lean.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["code", "piece"]).withColumn("start", F.col("offset") + F.col("ahead"))
    return placed.drop("offset", "ahead", "piece", "hash"), [(s, sizes[s]) for s in names]


def golden_points(number: Column) -> Column:
    """frac((number + 1/2) * phi) * 2**62 for numbers under 2**61: products of 31-bit halves, which fit 64 bits."""
    half = F.lit((1 << 31) - 1)
    odd = number * 2 + 1
    low, high = odd.bitwiseAND(half), F.shiftright(odd, 31).bitwiseAND(half)
    c0, c1 = F.lit(GOLDEN & (1 << 31) - 1), F.lit(GOLDEN >> 31)
    middle = (low * c1 + high * c0).bitwiseAND(half)
    return (low * c0 + F.shiftleft(middle, 31)).bitwiseAND(F.lit((1 << POINT_BITS) - 1))


def schedule(spark: SparkSession, targets: list[float], sizes: list[int], block: int = BLOCK) -> DataFrame:
    """The mix: slot, code, rank, epoch, block, n_words (the last slot of a source may be cut)."""
    goals = [int(round(t)) for t in targets]
    needs = [g // n * -(-n // block) + -(-(g % n) // block) if n else 0 for g, n in zip(goals, sizes, strict=True)]
    slots = sum(needs)
    cuts = [(x << POINT_BITS) // slots for x in accumulate(needs[:-1])] if slots else []
    bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")
    seq = spark.range(slots).withColumn("point", golden_points(F.col("id")))
    # The number of cuts that are not above the point, by binary search.
    higher = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(bounds, acc + s - 1) <= F.col("point")), acc + s).otherwise(acc)
    steps = [F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]
    place = F.aggregate(F.array(*steps), F.lit(0), higher) if cuts else F.lit(0)
    seq = seq.select(F.col("id").alias("slot"), place.alias("code"), F.expr(f"id div {CHUNK}").alias("chunk"))
    counts = seq.groupBy("chunk", "code").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_sums(counts, ["code"], "chunk", F.shiftright("chunk", 12), "n", "offset").drop("n")
    inside = Window.partitionBy("chunk", "code").orderBy("slot")
    ranked = seq.withColumn("within", F.row_number().over(inside) - 1).join(offsets, ["chunk", "code"])
    ranked = ranked.select("slot", "code", (F.col("offset") + F.col("within")).cast("bigint").alias("rank"))
    # A row per source, and per rank left out: as many as the points' discrepancy, logarithmic in the slots.
    need = F.get(F.from_json(F.lit(str(needs)), "array<bigint>"), F.col("code"))
    given = counts.groupBy("code").agg(F.sum("n").alias("given"))
    short = spark.range(len(needs)).select(F.col("id").cast("int").alias("code")).join(given, "code", "left")
    short = short.select("code", F.coalesce("given", F.lit(0)).alias("given"), need.alias("need")).where("given < need")
    short = short.select("code", "given", F.explode(F.expr("sequence(given, need - 1)")).alias("rank"))
    ranked = ranked.unionByName(short.select((slots + (F.col("rank") - F.col("given")) * len(needs) + F.col("code")).alias("slot"), "code", "rank"))
    goal = F.get(F.from_json(F.lit(str(goals)), "array<bigint>"), F.col("code"))
    size = F.get(F.from_json(F.lit(str([int(s) for s in sizes])), "array<bigint>"), F.col("code"))
    out = ranked.withColumn("size", size).where("size > 0").withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}"))
    out = out.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    full = F.least(F.lit(block), F.col("size") - F.col("block") * block)
    done = F.col("epoch") * F.col("size") + F.col("block") * block
    out = out.withColumn("n_words", F.least(full, goal - done)).where("n_words > 0")
    return out.select("slot", "code", "rank", "epoch", "block", "n_words")


def mix(docs: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0, order: Column | None = None, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(mix, documents).

    The mix has a row per stretch of a document in a slot: slot, at (words before it in the slot),
    epoch, keep, first_word, n_words. The documents have keep, size, source_size, target, taken.
    """
    spark = docs.sparkSession
    order = F.xxhash64(*keep, text_col, F.lit(seed)) if order is None else F.coalesce(order, F.lit(0))
    placed, names = arrange(docs, keep, text_col, source_col, seed, order)
    targets = target_table(dict(names), share, most)
    row = free_name(placed, "row")
    placed = materialize(placed.withColumn(row, F.monotonically_increasing_id()))
    slots = schedule(spark, [targets[s] for s, _ in names], [n for _, n in names], block)
    b = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    pieces = placed.where("size > 0").select(row, "start", "size", "code", b.alias("block"))
    # A source and a block meet once or, over epochs, a few times: no key is hot.
    met = slots.join(pieces, ["code", "block"])
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("n_words"))
    met = met.withColumn("n_words", last - first).where("n_words > 0")
    met = met.withColumn("first_word", first - F.col("start")).withColumn("at", first - F.col("block") * block)
    took = met.groupBy(row).agg(F.sum("n_words").alias("taken"))
    got = placed.join(took, row, "left")
    goal = F.get(F.from_json(F.lit(str([float(targets[s]) for s, _ in names])), "array<double>"), F.col("code"))
    own = F.get(F.from_json(F.lit(str([int(n) for _, n in names])), "array<bigint>"), F.col("code"))
    kept = [F.col(f"k_{c}").alias(c) for c in keep]
    documents = got.select(*kept, "size", own.alias("source_size"), goal.alias("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    stream = met.join(placed.select(row, *[f"k_{c}" for c in keep]), row).select("slot", "at", "epoch", *kept, "first_word", "n_words")
    return stream, documents


def mix_documents(docs: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Whole documents as the mix takes them: each row of ``docs`` taken / size times, to the nearest
    whole number (halves up). A source's taken words are a stretch of its stream, so at most one
    document of a source is rounded. Texts are shuffled once, to meet their numbers.
    """
    hashed = free_name(docs, "text_hash")
    lean = docs.select(F.col(key), F.col(text_col), F.col(source_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(hashed))
    took = mix(lean, [key, hashed], text_col, source_col, **options)[1]
    copies = F.expr("(2 * taken + size) div (2 * size)")
    # One key for both the join and the numbering after it: the texts are shuffled once. Rows repeated in
    # full are equal, so any of them may have any of their numbers of copies.
    join, number, lists = (free_name(docs, c) for c in ("row_key", "row_no", "copies"))
    took = took.where("size > 0").select(F.xxhash64(key, hashed).alias(join), copies.cast("int").alias("m_copies"))
    took = took.groupBy(join).agg(F.sort_array(F.collect_list("m_copies"), asc=False).alias(lists)).where(F.get(lists, F.lit(0)) > 0)
    full = docs.withColumn(join, F.xxhash64(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    met = full.join(took, join)
    met = met.withColumn(number, F.row_number().over(Window.partitionBy(join).orderBy(F.col(source_col))) - 1)
    repeat = free_name(met, "repeat")
    return met.withColumn(repeat, F.explode(F.array_repeat(F.lit(0), F.coalesce(F.get(lists, F.col(number)), F.lit(0))))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # 60 bits of an MD5 as the hashed order: a function that SQL engines share. Documents that share an id
    # or have none differ by their texts.
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(F.coalesce("text", F.lit(""))), F.lit("mix"))
    digits = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")
    order = F.shiftleft(digits, 4)  # to the top bits, by which a source is cut into pieces
    return mix(docs, ["doc_id"], order=order)[1]


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / weight, source IS NULL, encode(source)) AS k FROM w),
p AS (SELECT *, (SELECT 1.5::DOUBLE * sum(n) FROM s) - coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM f),
x AS (SELECT min(k) AS k FROM p WHERE 2 * n > rest / open_weight * weight),
l AS (SELECT rest / open_weight AS level FROM p WHERE k = (SELECT k FROM x)),
t AS (SELECT source, n, CASE WHEN p.k < coalesce((SELECT k FROM x), 1e18) THEN CAST(2 * n AS DOUBLE) ELSE (SELECT level FROM l) * weight END AS target FROM p),
o AS (SELECT d.*, t.n, t.target, CAST(round_even(t.target, 0) AS BIGINT) AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE goal // n * size + greatest(0, least(start + size, goal % n) - start) END AS BIGINT) AS taken FROM o
"""
