"""Embedding near-duplicates by lattice hashing: random projections decoded to points of E8.

Vectors are compared only within a label, by cosine in double precision; those that are null, zero,
or hold null or non-finite components link with nothing, as do those with a null label. Vectors of
different lengths are not compared.

* Equal vectors of a label become one vector with a count (rows are reduced before the shuffle).
* Each table projects a unit vector to 16 random orthonormal directions, scales them by ``scale`` times the
  root of (dimension / 64), so that cells hold the same share of unrelated vectors at any dimension, and decodes
  the two halves to their nearest points of the E8 lattice; the pair of points is the cell. A vector
  is stored in its own cell and probes the ``probes`` cells next nearest to it (one half moved by one
  of the 240 shortest lattice vectors).
* Only ids travel until it is known which cells hold two entries or more. The entries of such a cell
  meet in groups of two blocks of at most about ``block`` each: a cell of any size is worked off in
  groups of bounded size, and no pair is capped or lost. A group's result has a row per vector that
  links: the number of its links and the least id of the linked set, never the pairs.
* A pair that meets in several tables or probes counts in the first alone: the cells of linked
  vectors are computed again and compared.
* Components follow from the rows' (vector, least id) links, in shared scratch.

Edge cases: an empty table gives an empty result; repeated vec_ids are separate vectors of one id
(their links and the component follow from their vectors); rows repeated in full link with each other.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import components, materialize, mix64

THRESHOLD = 0.93
TABLES, PROBES, SCALE, BLOCK = 8, 4, 3.5, 1024
FEW_PAIRS = 20_000
HALVES = 2


@lru_cache(None)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if int((v < 0).sum()) % 2 == 0:
            out.append(v)
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        k = np.abs(gap).argmax(1)
        r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (the union of D8 and D8 + 1/2)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


@lru_cache(8)
def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    wide = max(dim, 8 * HALVES)
    return np.stack([np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim, : 8 * HALVES] for _ in range(tables)])


def _key(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of lattice points (rows of doubled coordinates)."""
    h = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for c in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        h = mix64(h ^ c)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 0) -> np.ndarray:
    """(n, tables, 1 + probes) cell hashes of unit vectors: the own cell, then the next nearest."""
    n, dim = x.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    around = neighbours()
    for t, p in enumerate(projections(dim, tables, seed)):
        y = x @ p * (scale * math.sqrt(max(dim, 8 * HALVES) / 64))
        halves = [decode(y[:, 8 * h : 8 * h + 8]) for h in range(HALVES)]
        point = np.hstack(halves)
        out[:, t, 0] = _key(point)
        if not probes:
            continue
        # How much farther a neighbour is than the own point: 2 - 2 r.v for a step v of length sqrt 2.
        gain = np.hstack([(y[:, 8 * h : 8 * h + 8] - halves[h]) @ around.T for h in range(HALVES)])
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(gain, best, 1), axis=1, kind="stable"), 1)
        for k in range(probes):
            moved = point.copy()
            half, v = best[:, k] // 240, around[best[:, k] % 240]
            for h in range(HALVES):
                moved[:, 8 * h : 8 * h + 8] += np.where((half == h)[:, None], v, 0)
            out[:, t, 1 + k] = _key(moved)
    return out


def usable(embedding: Column) -> Column:
    """The vector as doubles, or null if it links with nothing."""
    v = embedding.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0), v)


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each vector length in a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = {}
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[ends[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(1)[:, None]
        out[int(dim)] = rows, x / np.sqrt((x * x).sum(1))[:, None]
    return out


def _entries(tables: int, probes: int, scale: float, seed: int):
    """(rid, seal) -> a row (rid, bin, t, role) per cell of a vector; role 0 is its own cell."""

    def run(batches):
        for b in batches:
            rid, seal = b.column("rid").to_numpy(), b.column("seal").to_numpy()
            for dim, (rows, x) in _units(b.column("v")).items():
                for a in range(0, len(rows), 2000):
                    part = rows[a : a + 2000]
                    c = cells(x[a : a + 2000], tables, probes, scale, seed)
                    n = c.shape[1] * c.shape[2]
                    t = np.repeat(np.arange(c.shape[1]), c.shape[2])
                    salt = mix64((seal[part].astype(np.uint64)[:, None] * np.uint64(64) + t.astype(np.uint64)) ^ np.uint64(dim << 40))
                    yield pa.RecordBatch.from_pydict({
                        "rid": np.repeat(rid[part], n), "bin": mix64(c.reshape(len(part), n).view(np.uint64) ^ salt).view(np.int64).ravel(),
                        "t": np.tile(t, len(part)).astype(np.int32), "role": np.tile((np.arange(n) % c.shape[2] > 0).astype(np.int32), len(part)),
                    })

    return run


def _first_here(a: np.ndarray, b: np.ndarray, t: np.ndarray, a_less: np.ndarray) -> np.ndarray:
    """Of pairs that met in table ``t`` (a stored, b stored or probing): true in one meeting of each pair.

    That is in the first table that has them together; there, in the own cell of both if it is one
    cell, else where b probes a's cell, or, if each probes the other's, where the stored one has the
    lesser id. ``a``, ``b``: (pairs, tables, 1 + probes) cells.
    """
    forward = (a[:, :, :1] == b).any(2)
    backward = (b[:, :, :1] == a).any(2)
    earlier = ((forward | backward) & (np.arange(a.shape[1]) < t[:, None])).any(1)
    k = np.arange(len(t))
    same_own = a[k, t, 0] == b[k, t, 0]
    return ~earlier & (same_own | ~backward[k, t] | a_less)


def _links(tables: int, probes: int, scale: float, seed: int, threshold: float):
    """Rows sorted by group -> (rid, links, least) per vector and run of groups."""

    def work(rid, n, x, g, t, side, inner):
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        ends = np.append(starts[1:], len(g))
        sizes = ends - starts
        base = np.add.reduceat((side == 0).astype(np.int64), starts)
        seg = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(g)) - starts[seg]
        # A row pairs with the base rows before it: all of them if it is on the other side.
        count = np.where(side == 1, base[seg], np.where(inner == 1, place, 0))
        pairs_a, pairs_b = [], []
        per_group = np.add.reduceat(count, starts)
        small = per_group[seg] <= FEW_PAIRS
        rows = np.flatnonzero(small & (count > 0))
        step = 0
        while step < len(rows):  # runs of small groups, 50,000 pairs or so at a time
            take = max(1, int(np.searchsorted(np.cumsum(count[rows[step:]]), 50_000)))
            part = rows[step : step + take]
            step += take
            b = np.repeat(part, count[part])
            first = np.cumsum(count[part]) - count[part]
            a = starts[seg[b]] + np.arange(len(b)) - np.repeat(first, count[part])
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            pairs_a.append(a[hit]), pairs_b.append(b[hit])
        for k in np.flatnonzero(per_group > FEW_PAIRS):
            s, e, m = starts[k], ends[k], base[k]
            for lo in range(s, e, 256):
                hi = min(e, lo + 256)
                hit = x[lo:hi] @ x[s : s + m].T >= threshold
                hit &= np.arange(m) < count[lo:hi][:, None]
                i, j = np.nonzero(hit)
                pairs_a.append(s + j), pairs_b.append(lo + i)
        a, b = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pairs_a, pairs_b))
        if not len(a):
            return None
        used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        c = np.concatenate([cells(x[used[k : k + 2000]], tables, probes, scale, seed) for k in range(0, len(used), 2000)])
        wa, wb = where[: len(a)], where[len(a) :]
        counted = np.empty(len(a), bool)
        for k in range(0, len(a), 50_000):
            p, q = wa[k : k + 50_000], wb[k : k + 50_000]
            i, j = a[k : k + 50_000], b[k : k + 50_000]
            counted[k : k + 50_000] = _first_here(c[p], c[q], t[i], rid[i] < rid[j])
        links = np.zeros(len(used), np.int64)
        np.add.at(links, wa[counted], n[b[counted]])
        np.add.at(links, wb[counted], n[a[counted]])
        ids, at = np.unique(rid[used], return_inverse=True)  # a vector can be in several groups
        least = ids.copy()
        pa_, pb_ = at[wa], at[wb]
        while True:
            low = np.minimum(least[pa_], least[pb_])
            new = least.copy()
            np.minimum.at(new, pa_, low)
            np.minimum.at(new, pb_, low)
            if (new == least).all():
                break
            least = new
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, links)
        return pa.RecordBatch.from_pydict({"rid": ids, "links": total, "least": least})

    def run(batches):
        held: list = []

        def flush(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            cols = {c: table.column(c).to_numpy() for c in ("rid", "n", "g", "t", "side", "inner")}
            column = table.column("v").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            out = []
            for rows, x in _units(column).values():  # a group's vectors are of one length
                got = work(*(cols[c][rows] for c in ("rid", "n")), x, *(cols[c][rows] for c in ("g", "t", "side", "inner")))
                if got is not None:
                    out.append(got)
            return out

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on in the next batch
            if cut:
                yield from flush([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            elif held and held[-1].column("g")[0].as_py() != g[0]:
                yield from flush(held)
                held = [b]
            else:
                held.append(b)
        if held:
            yield from flush(held)

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """A row per vector: key, n_links, component_id (least key of its component), kept."""
    lean = df.select(F.col(key).alias("key"), F.col(label_col).alias("label"), usable(F.col(vector_col)).alias("v"))
    rid = F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.xxhash64("label", "v"))
    lean = materialize(lean.withColumn("rid", rid))
    one = lean.where("rid is not null").groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least_key"), F.first("label").alias("label"), F.first("v").alias("v"))
    one = materialize(one.withColumn("seal", F.xxhash64("label")))
    found = materialize(one.select("rid", "seal", "v").mapInArrow(_entries(tables, probes, scale, seed), "rid bigint, bin bigint, t int, role int"))
    held = found.groupBy("bin").agg(F.count_if(F.col("role") == 0).alias("ns"), F.count_if(F.col("role") == 1).alias("np")).where("ns >= 1 and ns + np >= 2")
    met = found.join(held, "bin").withColumn("nbs", F.expr(f"cast((ns + {block - 1}) div {block} as int)")).withColumn("nbp", F.expr(f"cast((np + {block - 1}) div {block} as int)"))
    mine = F.pmod(F.xxhash64("rid", "t"), F.when(F.col("role") == 0, F.col("nbs")).otherwise(F.col("nbp"))).cast("int")
    met = met.withColumn("own", mine)
    group = "struct(cast({i} as int) as i, cast({j} as int) as j, {kind} as kind, {side} as side, {inner} as inner)"
    whole = group.format(i=0, j=0, kind=0, side="role", inner=1)
    among = "transform(sequence(0, nbs - 1), k -> " + group.format(i="least(k, own)", j="greatest(k, own)", kind=1, side="if(own > k, 1, 0)", inner="if(own = k, 1, 0)") + ")"
    stored = "if(nbp > 0, transform(sequence(0, nbp - 1), k -> " + group.format(i="own", j="k", kind=2, side=0, inner=0) + "), array())"
    probing = "transform(sequence(0, nbs - 1), k -> " + group.format(i="k", j="own", kind=2, side=1, inner=0) + ")"
    groups = F.expr(f"explode(case when nbs = 1 and nbp <= 1 then array({whole}) when role = 0 then concat({among}, {stored}) else {probing} end)")
    met = met.select("rid", "bin", "t", groups.alias("in"))
    met = met.select("rid", "t", F.xxhash64("bin", "in.i", "in.j", "in.kind").alias("g"), "in.side", "in.inner")
    rows = met.join(one.select("rid", "n", "v"), "rid").select("rid", "n", "v", "g", "t", "side", "inner")
    rows = rows.repartition("g").sortWithinPartitions("g", "side", "rid")
    got = materialize(rows.mapInArrow(_links(tables, probes, scale, seed, threshold), "rid bigint, links bigint, least bigint"))
    links = got.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(got.select(F.col("rid").alias("u"), F.col("least").alias("v")))
    comp = one.select("rid", "n", "least_key").join(comp.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    heads = comp.groupBy("component").agg(F.min("least_key").alias("component_id"))
    state = comp.join(heads, "component").join(links, "rid", "left").select("rid", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = lean.select("key", "rid").join(state, "rid", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS root, vec_id AS node FROM v
  UNION
  SELECT r.root, l.w FROM reach r JOIN links l ON l.u = r.node),
comp AS (SELECT root, min(node) AS c FROM reach GROUP BY root),
deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT t.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, t.vec_id) AS component_id, t.vec_id = coalesce(comp.c, t.vec_id) AS kept
FROM embeddings t LEFT JOIN comp ON comp.root = t.vec_id LEFT JOIN deg ON deg.u = t.vec_id
"""
