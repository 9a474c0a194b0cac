"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words, its pairs of neighbouring words (a word followed by itself is one
feature, whatever the word) and its character n-grams (3 to 5 code points, across word borders),
each hashed to one of ``2**bits`` buckets. Every bucket has a learned vector; a document is the mean
of its features' vectors, and a softmax layer over two classes turns the mean into a score. Case and
punctuation are kept: they tell quality.

Training: a bounded sample of labelled rows (``sample_rows``; the rows of least hash of their key)
is reduced on the executors to bucket counts, at most ``2**bits`` of each row, and one task fits the
model to them; the driver gets the model alone. Scoring covers whole texts: as the softmax is linear in the mean, each bucket's
vector is first multiplied into one log-odds number, and a text's log-odds are the mean over its
features plus a bias.

Edge cases: a null or empty text has no features and gets the bias's score; rows with a null or
conflicting label are not learned from (labels of one key are averaged, an average of exactly one
half is dropped); of documents that share an id, one text is learned from (the one of least hash); with no labels, or labels of one class only, the model says what the bias says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import free_name, map_texts, of_texts

#: Bound on labelled rows that a model is fit on.
SAMPLE_ROWS = 5000
BITS = 16
ORDERS = (3, 4, 5)
BLOCK = 1 << 20


def features(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of all features of one text given as code points (uint32); each occurrence counts."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        c = codes * np.uint32(0x9E3779B1)
        c ^= c >> np.uint32(15)
        out = []
        h = c
        for k in range(2, max(ORDERS) + 1):
            if n < k:
                break
            h = h[: n - k + 1] * np.uint32(0x01000193) + c[k - 1 :]
            if k in ORDERS:
                out.append(((h * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32))
        blank = (codes <= 32) | (codes == 0xA0) | (codes == 0x3000)
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if len(starts):
            # A word's hash: the sum of its characters' mixes, each turned by its place in the word.
            place = np.arange(n, dtype=np.uint32)
            first = np.zeros(n, np.uint32)
            first[starts] = starts
            place -= np.maximum.accumulate(first)
            mixed = np.where(blank, np.uint32(0), c * (np.uint32(2) * place + np.uint32(1)) ^ (c >> np.uint32(7)))
            words = np.add.reduceat(mixed, starts, dtype=np.uint32)
            out.append(((words * np.uint32(0xC2B2AE35)) >> shift).astype(np.int32))
            two = words[:-1] * np.uint32(0x27D4EB2F) + words[1:]
            two[words[:-1] == words[1:]] = np.uint32(0x165667B1)
            out.append(((two * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """(log-odds of each bucket, bias) from rows of (buckets, counts, label)."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << bits, dim), np.float32) - 0.5) / dim
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    ones = sum(y for *_, y in rows)
    if rows:
        share = (ones + 1) / (len(rows) + 2)
        bias[:] = np.log([1 - share, share]) / 2
    if 0 < ones < len(rows):
        steps = epochs * len(rows)
        done = 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                buckets, counts, y = rows[k]
                lr = rate * (1 - done / steps)
                done += 1
                if not len(buckets):
                    continue
                share = (counts / counts.sum()).astype(np.float32)
                mean = share @ vectors[buckets]
                logit = out @ mean + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y] -= 1
                grad = out.T @ p
                out -= lr * np.outer(p, mean)
                bias -= 0.1 * lr * p
                # A step on the mean reaches every feature whole, as in the usual scheme for such models.
                vectors[buckets] -= lr * np.minimum(share * 50, 1)[:, None] * grad
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, bits: int = BITS, text_col: str = "text", **options) -> tuple[np.ndarray, float]:
    """A model from at most ``sample_rows`` labelled rows that are not held out."""
    one = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y")).where("y <> 0.5")
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    # sample_rows rows of two numbers: a proven bound.
    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(one), "doc_id")
    # One text an id, however often the id is repeated: reduced before the shuffle.
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))

    def make(texts: list[str]) -> dict:
        pairs = [np.unique(features(codes_of(t), bits), return_counts=True) for t in texts]
        return {"b": [p[0].astype(np.int32) for p in pairs], "n": [p[1].astype(np.int32) for p in pairs]}

    def learn(batches):
        """One task learns from the bounded sample: what comes back is the model alone."""
        data = []
        for batch in batches:
            y, key = batch.column("y").to_pylist(), batch.column("doc_id").to_pylist()
            lists = [batch.column(c) for c in ("b", "n")]
            ends = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            data += [(key[i], y[i], *(x[ends[i] : ends[i + 1]].copy() for x in flat)) for i in range(len(y))]
        data.sort(key=lambda d: (d[0], d[1], len(d[2]), d[3].tobytes()))
        weights, bias = train([(b, n, y) for _, y, b, n in data], bits, **options)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    sample = map_texts(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, b array<int>, n array<int>", ["doc_id", "y"])
    model = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def log_odds(texts: list[str], weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Of each whole text; a long one in blocks that overlap by an n-gram's length would differ, so it is done at once."""
    out = np.full(len(texts), bias, np.float64)
    for k, text in enumerate(texts):
        f = features(codes_of(text), bits)
        if len(f):
            out[k] += float(weights[f].mean(dtype=np.float64))
    return out


def score_of(spark: SparkSession, model: tuple[np.ndarray, float], bits: int = BITS):
    """A column function: the score (0 to 1, higher: better) of a text."""
    weights, bias = model
    shared = spark.sparkContext.broadcast(weights)  # 2**bits floats

    def make(texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-log_odds(texts, shared.value, bias, bits)))

    return of_texts(make, "double")


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``keep`` columns (default: all but the text) and ``score`` (0 to 1, higher: better)."""
    keep = [c for c in docs.columns if c not in (text_col, "score")] if keep is None else keep
    name = free_name(docs.select(*keep), "score")
    return docs.select(*keep, score_of(docs.sparkSession, model, bits)(F.col(text_col)).alias(name))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
