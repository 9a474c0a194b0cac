"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

Words are lower-cased runs of letters and digits; a shingle is five words in a row (a text of one to
four words is one shingle). Its weight is its count in the document times its inverse document
frequency ln(1 + n / max(df, floor * n)): shingles in at most ``floor`` of all documents weigh alike.

1. *Frequencies.* Every task counts its documents' shingles in 2**21 hash buckets; the summed counts
   bound each shingle's frequency from above, so the shingles of buckets above the floor are the only
   ones that can be above it, and only those are counted exactly, over all documents. There are at most
   (mean distinct shingles) / ``floor`` of them: a bounded table.
2. *Signatures.* 36 samples a document (12 bands of 3), each the shingle and level of least hash by
   the consistent weighted scheme: two documents agree in a sample with the chance of their weighted
   Jaccard similarity. Two documents of similarity 0.8 share a band with chance 0.9998.
3. *Candidates.* Documents with equal word sequences are one node. In every bucket the least node is
   the anchor and is compared with all others: pairs linear in the bucket. Linked nodes become
   components. In buckets of up to ``SMALL`` nodes every pair of *different* components is compared too
   (at most ``SMALL`` / 2 pairs a node). In a larger bucket of several components nodes are dealt to blocks
   of ``BLOCK``, a large component to blocks of its own, and every two blocks meet in one group of bounded
   size, but for those of one component; a group's similarities are one matrix product and its result
   is a link a node, never the pairs. A node's shingles so travel at most (bucket / ``BLOCK``) times a
   bucket, and only as far as documents of the bucket are not linked already. No bucket is capped and
   no pair of a bucket is left out.
4. *Verification.* The weighted Jaccard similarity over the whole texts decides on every route, after
   an exact bound by the texts' whole weights.

Edge cases: texts without a word (null: empty) are equal only if the texts are equal; repeated rows
and equal texts are in one class; documents with null ids can be members, and a class is named by its
least id that is not null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import components, free_name, map_texts, materialize, mix64, text_runs

WORDS, THRESHOLD, FLOOR = 5, 0.8, 0.001
BANDS, ROWS = 12, 3
SKETCH_BITS, SKETCH_PARTS = 21, 64
TABLE_BITS = 12
SMALL, BLOCK, COLUMNS = 32, 256, 4096


@lru_cache(1)
def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


@lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles x of Gamma(2, 1) at equal steps, 1 / x and ln x."""
    p = (np.arange(1 << TABLE_BITS) + 0.5) / (1 << TABLE_BITS)
    lo, hi = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo.astype(np.float32), (1 / lo).astype(np.float32), np.log(lo).astype(np.float32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's begin (one more entry than texts)."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, lower)])
    none = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    if not len(codes):
        return none
    inside = _word_characters()[codes]
    before = np.empty(len(codes), bool)
    before[0], before[1:] = False, inside[:-1]
    before[ends[:-1][ends[:-1] < len(codes)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return none
    spread = np.diff(np.append(starts, len(codes)))
    codes, inside = codes[starts[0] :], inside[starts[0] :]
    place = np.arange(len(codes), dtype=np.uint64)
    place -= np.repeat((starts - starts[0]).astype(np.uint64), spread)
    with np.errstate(over="ignore"):
        place *= np.uint64(0xD6E8FEB86659FD93)
        m = codes.astype(np.uint64)
        m += np.uint64(0x51ED27)
        m *= np.uint64(0x9E3779B97F4A7C15)
        m ^= place
        m *= np.uint64(0xFF51AFD7ED558CCD)
        np.right_shift(m, np.uint64(32), out=place)
        m ^= place
        m[~inside] = 0
        words = mix64(np.add.reduceat(m, starts - starts[0]))
    return words, np.searchsorted(starts, ends)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of each text: hashes, counts, where each text's begin, and keys of the word sequences."""
    words, at = word_hashes(texts)
    n = len(words)
    keys = []
    with np.errstate(over="ignore"):
        h = words.copy()
        for k in range(1, WORDS):
            m = max(0, n - k)
            h[:m] = h[:m] * np.uint64(0xC6A4A7935BD1E995) + words[k:]
        h = mix64(h)
        out = []
        for i, text in enumerate(texts):
            a, b = at[i], at[i + 1]
            w = words[a:b]
            keys.append(hashlib.blake2b(w.tobytes() if b > a else b"no words:" + text.encode(), digest_size=8).digest())
            if b - a >= WORDS:
                out.append(np.sort(h[a : b - WORDS + 1]))
            elif b > a:
                z = np.uint64(b - a)
                for x in w:
                    z = z * np.uint64(0xC6A4A7935BD1E995) + x
                out.append(mix64(np.array([z])))
            else:
                out.append(h[:0])
    sizes = np.array([len(x) for x in out])
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[ends[:-1][ends[:-1] < len(flat)]] = True
    where = np.flatnonzero(new)
    return flat[where], np.diff(np.append(where, len(flat))), np.searchsorted(where, ends), keys


class Idf:
    """ln(1 + n / max(df, floor * n)); exact counts of the shingles above the floor, sorted by hash."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int, floor: float = FLOOR):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.least = max(1.0, floor * n)
        self.values = np.log1p(n / np.maximum(df[order], self.least))
        self.rest = float(np.log1p(n / self.least))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rest)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.values[at[hit]]
        return out


def sample(hashes: np.ndarray, weights: np.ndarray, ends: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """(texts, count) samples (uint32) of texts that have a shingle; ``ends`` as from ``shingles``."""
    r_table, inv_table, ln_table = _gamma()
    texts = len(ends) - 1
    out = np.zeros((texts, count), np.uint32)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    ln_w = np.log(weights).astype(np.float32)
    full = np.flatnonzero(np.diff(ends) > 0)
    step = 0
    while step < len(full):  # runs of texts of about 16,000 shingles: they stay in the cache
        first = step
        begin = ends[full[first]]
        step = max(first + 1, int(np.searchsorted(ends[full], begin + 16_000)))
        part = full[first:step]
        stop = ends[part[-1] + 1]
        h, lw, seg = hashes[begin:stop], ln_w[begin:stop], ends[part] - begin
        with np.errstate(over="ignore"):
            for k in range(count):
                z = h * np.uint64(2 * k + 0x9E3779B97F4A7C15 | 1)
                z ^= z >> np.uint64(32)
                z *= np.uint64(0xD6E8FEB86659FD93)
                z ^= z >> np.uint64(29)
                i = (z & mask).astype(np.int32)
                j = ((z >> np.uint64(TABLE_BITS)) & mask).astype(np.int32)
                beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
                t = np.floor(lw * inv_table[i] + beta)
                r = r_table[i]
                a = ln_table[j] - r * (t - beta + np.float32(1)) + np.float32(1024)
                token = z.astype(np.uint32) * np.uint32(0x9E3779B1) + t.astype(np.int32).astype(np.uint32) * np.uint32(0x85EBCA77)
                packed = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | token
                out[part, k] = np.minimum.reduceat(packed, seg).astype(np.uint32)
    return out


def heavy_shingles(docs: DataFrame, n: int, text_col: str, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document frequencies) of the shingles in more than ``floor`` of the ``n`` documents."""
    least = max(1.0, floor * n)
    wide = (1 << SKETCH_BITS) // SKETCH_PARTS

    def sketch(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen = False
        for texts in (run for b in batches for run in text_runs(b.column(0))):
            h = shingles(texts)[0]
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            seen = True
        if seen:
            for p in range(SKETCH_PARTS):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "counts": [zlib.compress(total[p * wide : p * wide + wide].tobytes(), 1)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                one = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
                sums[p] = sums[p] + one if p in sums else one.astype(np.uint64)
        for p, c in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bits": [np.packbits(c > least).tobytes()]})

    lean = docs.select(F.col(text_col).alias("text"))
    rows = lean.mapInArrow(sketch, "part int, counts binary").repartition("part").mapInArrow(add, "part int, bits binary").collect()  # 64 rows of 4 kB
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.zeros((1 << SKETCH_BITS) // 8, np.uint8)
    for r in rows:
        bits[r["part"] * wide // 8 : (r["part"] + 1) * wide // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 256 kB

    def heavy(batches):
        above = np.unpackbits(shared.value).astype(bool)
        for texts in (run for b in batches for run in text_runs(b.column(0))):
            h = shingles(texts)[0]
            h, c = np.unique(h[above[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]], return_counts=True)
            if len(h):
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)})

    got = lean.mapInArrow(heavy, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("df")).where(F.col("df") > least).toArrow()  # bounded: see above
    return got.column("h").to_numpy().view(np.uint64), got.column("df").to_numpy()


def signatures(docs: DataFrame, key: str, text_col: str, idf: Idf) -> DataFrame:
    """key, xt (hash of the text), node (hash of the word sequence), weight (of all shingles), bands (null without a word)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def make(texts: list[str]) -> dict:
        h, counts, ends, keys = shingles(texts)
        weights = shared.value.of(h) * counts
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        sig = sample(h, weights, ends) if len(h) else np.zeros((len(texts), BANDS * ROWS), np.uint32)
        band = np.zeros((len(texts), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                z = np.full(len(texts), b + 1, np.uint64)
                for k in range(ROWS):
                    z = mix64(z * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + k])
                band[:, b] = z
        some = np.diff(ends) > 0
        return {
            "node": [int.from_bytes(k, "little", signed=True) for k in keys],
            "weight": sums[ends[1:]] - sums[ends[:-1]],
            "bands": [s if ok else None for s, ok in zip(band.view(np.int64), some, strict=True)],
        }

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("xt"), F.col(text_col).alias("text"))
    return map_texts(lean, make, f"key {kind}, xt bigint, node bigint, weight double, bands array<bigint>", ["key", "xt"])


def _verify(pairs: DataFrame, nodes: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) of nodes: those whose weighted Jaccard similarity is ``threshold`` or more.

    The similarity is at most the lesser of two texts' whole weights over the greater: pairs that fall
    short of that bound are left out before their shingles are fetched, which loses none.
    """
    a = nodes.select(F.col("node").alias("u"), F.col("weight").alias("wa"))
    b = nodes.select(F.col("node").alias("v"), F.col("weight").alias("wb"))
    near = pairs.join(a, "u").join(b, "v").where(F.least("wa", "wb") >= threshold * (1 - 1e-9) * F.greatest("wa", "wb")).select("u", "v")
    fa = feats.select(F.col("node").alias("u"), F.col("h").alias("ha"), F.col("tf").alias("ta"), F.col("idf").alias("ia"))
    fb = feats.select(F.col("node").alias("v"), F.col("h").alias("hb"), F.col("tf").alias("tb"), F.col("idf").alias("ib"))

    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("ha", "ta", "ia", "hb", "tb", "ib")]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in cols]
            ends = [c.offsets.to_numpy() for c in cols]
            keep = []
            for i in range(batch.num_rows):
                ha, ta, ia, hb, tb, ib = (f[e[i] : e[i + 1]] for f, e in zip(flat, ends, strict=True))
                wa, wb = ta * ia, tb * ib
                _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                low = np.minimum(wa[x], wb[y]).sum()
                keep.append(low >= threshold * (wa.sum() + wb.sum() - low) * (1 - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = near.join(fa, "u").join(fb, "v").select("u", "v", "ha", "ta", "ia", "hb", "tb", "ib")
    return rows.mapInArrow(run, "u bigint, v bigint")


def link_block(node, side, component, h, tf, idf, ends, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks' documents of different components: (node, least node of what it links to).

    A shingle of count c is c features of its weight, so that the weight two documents share is a
    product of 0-1 matrices, made a range of columns at a time. Rows of side 0 come first; with one side
    alone, the block meets itself.
    """
    n, base = len(node), int((side == 0).sum())
    none = np.zeros(0, np.int64)
    if not base or len(np.unique(component)) < 2:
        return none, none
    doc = np.repeat(np.arange(n), np.diff(ends))
    total = np.bincount(doc, tf * idf, n)
    f_doc, f_idf = np.repeat(doc, tf), np.repeat(idf, tf)
    level = np.arange(len(f_doc)) - np.repeat(np.cumsum(tf) - tf, tf)
    with np.errstate(over="ignore"):
        key = mix64(np.repeat(h.view(np.uint64), tf) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, column, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    f_doc, f_idf = f_doc[shared], f_idf[shared]
    left, right = (slice(0, base), slice(base, n)) if base < n else (slice(0, n), slice(0, n))
    both = np.zeros((left.stop - left.start, right.stop - right.start))
    order = np.argsort(column, kind="stable")
    f_doc, f_idf, column = f_doc[order], f_idf[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        m = np.zeros((n, COLUMNS))
        weight = np.zeros(COLUMNS)
        m[f_doc[part], column[part] - at] = 1
        weight[column[part] - at] = f_idf[part]
        both += (m[left] * weight) @ m[right].T
    near = both >= threshold * (total[left][:, None] + total[right][None, :] - both) * (1 - 1e-12)
    near &= component[left][:, None] != component[right][None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return none, none
    i, j = i + left.start, j + right.start
    least = node.copy()
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            break
        least = new
    moved = least != node
    return node[moved], least[moved]


def _link_blocks(threshold: float):
    """Rows sorted by group -> (u, v) links; a group is held whole, it is two blocks at most."""

    def run(batches):
        held: list = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
            lists = [one(c) for c in ("h", "tf", "idf")]
            ends = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for x in lists]
            u, v = link_block(*(one(c).to_numpy() for c in ("node", "side", "component")), *flat, ends - ends[0], threshold)
            return pa.RecordBatch.from_pydict({"u": u, "v": v})

        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column("g")[0].as_py() != g[a]:
                    yield flush()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _meetings(many: DataFrame, block: int | None = None) -> DataFrame:
    """(bucket, node, component) -> (g, side, node, component): which blocks of a bucket meet in which group.

    A component of a block's size or more has blocks of its own; the lesser ones share the others. Every
    two blocks meet, and a shared one meets itself, but for two blocks of one component: a bucket of one
    component has no meeting. A node goes into as many groups as its bucket has blocks it must meet.
    """
    block = BLOCK if block is None else block
    parts = many.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.expr(f"if(n >= {block}, (n + {block - 1}) div {block}, 0)"))
    sums = parts.groupBy("bucket").agg(F.sum("own").alias("own_blocks"), F.expr(f"(sum(if(own = 0, n, 0)) + {block - 1}) div {block}").alias("shared"), F.count(F.lit(1)).alias("comps"))
    sums = sums.where("comps > 1").select("bucket", "shared", (F.col("own_blocks") + F.col("shared")).alias("blocks"))
    # At most a row per block of the bucket in a window.
    before = Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.where("own > 0").withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0))).select("bucket", "component", "own", "first")
    rows = many.join(sums, "bucket").join(large, ["bucket", "component"], "left")
    mine = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("component", "node"), F.col("shared"))).otherwise(F.col("shared") + F.col("first") + F.pmod(F.xxhash64("node"), F.col("own")))
    rows = rows.withColumn("b", mine)
    others = "filter(sequence(0, blocks - 1), k -> own is null or k < shared + first or k >= shared + first + own)"
    meet = f"transform({others}, k -> struct(least(k, b) as i, greatest(k, b) as j, if(b > k, 1, 0) as side))"
    rows = rows.select("node", "component", "bucket", F.explode(F.expr(meet)).alias("in"))
    return rows.select(F.xxhash64("bucket", "in.i", "in.j").alias("g"), "in.side", "node", "component")


def classes(docs: DataFrame, key: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """A row per document: key, xt (hash of its text), class_key (least key of its class), keeper_xt."""
    spark = docs.sparkSession
    n = docs.count()
    idf = Idf(*heavy_shingles(docs, n, text_col, floor), n, floor)
    signed = materialize(signatures(docs, key, text_col, idf))
    # One document stands for each node; the copies' rows are reduced before the shuffle.
    nodes = signed.groupBy("node").agg(F.min(F.struct("key", "xt")).alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)
    entries = nodes.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
    size = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("anchor")).where("size > 1")
    entries = materialize(entries.join(size, "bucket").select("bucket", "node", "anchor", "size"))
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.key").alias("key"), F.col("rep.xt").alias("xt"))
    lean = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("xt"), F.col(text_col).alias("text"))
    met = lean.alias("d").join(wanted.alias("w"), F.col("d.key").eqNullSafe(F.col("w.key")) & (F.col("d.xt") == F.col("w.xt"))).select("w.node", "d.text")
    shared = spark.sparkContext.broadcast(idf)

    def features(texts: list[str]) -> dict:
        h, counts, ends, _ = shingles(texts)
        idf_of, tf = shared.value.of(h), counts.astype(np.int32)
        cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {"h": [h[c].view(np.int64) for c in cut], "tf": [tf[c] for c in cut], "idf": [idf_of[c] for c in cut]}

    feats = materialize(map_texts(met, features, "node bigint, h array<bigint>, tf array<int>, idf array<double>", ["node"]).dropDuplicates(["node"]))
    pairs = entries.where("node <> anchor").select(F.col("anchor").alias("u"), F.col("node").alias("v")).distinct()
    links = materialize(_verify(pairs, nodes, feats, threshold))
    comp = components(links)

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    # Small buckets: the one pair of a bucket of two has been compared already.
    few = with_component(entries.where(f"size > 2 and size <= {SMALL}").select("bucket", "node", "anchor"))
    few = materialize(few)
    a = few.where("node <> anchor").select("bucket", F.col("node").alias("u"), F.col("component").alias("cu"))
    b = few.where("node <> anchor").select("bucket", F.col("node").alias("v"), F.col("component").alias("cv"))
    pairs = a.join(b, "bucket").where("u < v and cu <> cv").select("u", "v").distinct()
    links = links.unionByName(materialize(_verify(pairs, nodes, feats, threshold)))
    # Large buckets that hold several components, block by block.
    many = with_component(entries.where(f"size > {SMALL}").select("bucket", "node"))
    rows = _meetings(materialize(many)).join(feats, "node").select("g", "side", "node", "component", "h", "tf", "idf")
    rows = rows.repartition("g").sortWithinPartitions("g", "side", "node")
    links = links.unionByName(materialize(rows.mapInArrow(_link_blocks(threshold), "u bigint, v bigint")))
    comp = components(links)
    named = nodes.select("node", "rep").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep.key").isNull().alias("none"), F.col("rep.key").alias("key"), F.col("rep.xt").alias("xt"))).alias("keeper"))
    of_node = named.join(least, "component").select("node", "component", F.col("keeper.key").alias("class_key"), F.col("keeper.xt").alias("keeper_xt"))
    return signed.select("key", "xt", "node").join(of_node, "node").select(F.col("key").alias(key), "xt", "class_key", "keeper_xt", F.col("component").alias("class_node"))


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one of least key (then text); columns as they were."""
    found = classes(docs, key, text_col, **options)
    mine = F.col(key).eqNullSafe(F.col("class_key")) & (F.col("xt") == F.col("keeper_xt"))
    # One key for both the join and the numbering after it: the texts are shuffled once.
    join, xt, n = (free_name(docs, c) for c in ("_join", "_xt", "_n"))
    keepers = found.where(mine).select(F.xxhash64(key, "xt").alias(join)).distinct()
    rows = docs.withColumn(xt, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(join, F.xxhash64(key, xt))
    order = Window.partitionBy(join, key, xt).orderBy(F.lit(0))  # rows repeated in full: any one stays
    return rows.join(keepers, join).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("class_key"))
    return found.select("doc_id", F.col("class_key").alias("class_id"), kept.alias("kept"))
