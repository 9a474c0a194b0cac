"""Document fingerprints by I-Match, in DataFrame operations only.

A document's terms are its distinct lower-cased runs of letters and digits (as 64-bit hashes). The
lexicon keeps the terms whose document frequency over all documents lies within a band, that is,
whose inverse document frequency does. A fingerprint hashes the sorted lexicon terms of a document
once, and once more for each randomised subset of the lexicon: seven families of nested subsets that
keep a half, a quarter, ... of the terms by bits of the term's hash. There are nine levels at least, and
as many more as the longest text needs (``levels_for``), so that some subsets stay small enough to agree
however many terms differ. Fingerprints to be compared need equal ``levels``. A document without a
lexicon term has n = 0 and the hashes of its whole text: it is like texts equal to it alone.

Likeness of two fingerprints: a subset that keeps a share p of the lexicon agrees with chance
(1 - p)^D if D terms differ, so the number of differing hashes gives an estimate of D, and with the
two term counts one of the Jaccard similarity of the terms: 1 for equal fingerprints, 0 for none shared.

Size of the lexicon: a term of the band is in ``low`` of all documents at least, so there are at
most (mean distinct terms) / ``low`` of them however many documents there are. Up to ``inline_terms``
they are looked up in an array that goes with the plan; beyond, by a shuffled join.

Edge cases: a null text is the empty text, which has no terms and a fingerprint of its own (likeness
1 to itself); equal texts have equal fingerprints; null keys come first in the order of documents,
rows with equal keys are ordered by a hash of the text; one document is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import free_name, materialize, range_of, with_range

LOW, HIGH = 0.001, 0.1
INLINE_TERMS = 1 << 20
FAMILIES, LEVELS = 7, 9
MOST_LEVELS = 48  # of the table of estimates: twice the terms of 2^31 characters need fewer
PATTERN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.array_distinct(F.transform(F.split(F.lower(text), PATTERN), lambda w: F.xxhash64(w)))
    return F.array_remove(found, F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Terms (h bigint) whose share of all documents is within the band, in shared scratch."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return materialize(df.where((F.col("df") >= low * n) & (F.col("df") <= max(1.0, high * n))).select("h"))


def lexicon_lookup(words: DataFrame, inline_terms: int = INLINE_TERMS):
    """A function from an array of term hashes to those in the lexicon, or None if it is too large for that."""
    n = words.count()
    if n > inline_terms:
        return None
    slots = 1 << max(0, n - 1).bit_length()
    table: list[list[int]] = [[] for _ in range(slots)]
    for r in words.toLocalIterator():  # bounded by inline_terms
        table[r["h"] % slots].append(r["h"])
    held = F.from_json(F.lit(str(table).replace(" ", "")), "array<array<bigint>>")  # folded to a constant once
    return lambda found: F.filter(found, lambda h: F.array_contains(F.get(held, F.pmod(h, F.lit(slots)).cast("int")), h))


def keep_joined(rows: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """``rows`` with each array of term hashes cut to the lexicon by a shuffled join, for a lexicon of any size."""
    key = free_name(rows, "_row")
    rows = materialize(rows.withColumn(key, F.monotonically_increasing_id()))
    for c in columns:
        hit = rows.select(key, F.explode(c).alias("h")).join(words, "h").groupBy(key).agg(F.collect_list("h").alias("hit"))
        rows = rows.drop(c + "_in").join(hit, key, "left").withColumn(c + "_in", F.coalesce("hit", F.array().cast("array<bigint>"))).drop("hit")
    return rows.drop(key)


def levels_for(docs: DataFrame, text_col: str = "text") -> int:
    """Levels whose smallest subset expects an eighth of a term of all that two of the texts may differ in."""
    longest = docs.agg(F.max(F.length(text_col)).alias("n")).first()["n"] or 0  # at most (n + 1) / 2 terms
    return max(LEVELS, (longest + 1).bit_length() + 3)


def _without(family: int, level: int):
    word, bit = divmod(level, LEVELS)
    bit += family * LEVELS
    return lambda h: (F.xxhash64(h, F.lit(word)) if word else h).bitwiseAND(F.lit(1 << bit)) == 0


def hash_subsets(df: DataFrame, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """Replaces each array of term hashes and its number ``_n`` by struct<n, hashes>: the fingerprint's parts.

    A level's subsets are made from those of the level before, one projection each, so that each
    family costs twice its terms and not once per subset.
    """
    kept = [c for c in df.columns if c not in columns and c not in [f"{c}_n" for c in columns]]
    low16 = lambda a: F.xxhash64(a).bitwiseAND(F.lit(0xFFFF)).cast("int")
    state = df.select(*kept, *[f"{c}_n" for c in columns], *[F.sort_array(c).alias(c) for c in columns])
    state = state.select(*kept, *[f"{c}_n" for c in columns], *[F.array(low16(F.col(c))).alias(f"{c}_h") for c in columns], *[F.col(c).alias(f"{c}_{f}") for c in columns for f in range(FAMILIES)])
    numbers = [f"{c}_n" for c in columns]
    for level in range(levels):
        cut = [F.filter(f"{c}_{f}", _without(f, level)).alias(f"{c}_{f}") for c in columns for f in range(FAMILIES)]
        state = state.select(*kept, *numbers, *[f"{c}_h" for c in columns], *cut)
        more = [F.concat(f"{c}_h", F.array(*[low16(F.col(f"{c}_{f}")) for f in range(FAMILIES)])).alias(f"{c}_h") for c in columns]
        state = state.select(*kept, *numbers, *more, *[f"{c}_{f}" for c in columns for f in range(FAMILIES)])
    return state.select(*kept, *[F.struct(F.col(f"{c}_n").alias("n"), F.col(f"{c}_h").alias("hashes")).alias(c) for c in columns])


def text_of(fp: Column) -> Column:
    """The fingerprint as text: number of terms, then each hash in four hex digits."""
    return F.concat(fp["n"].cast("string"), F.lit(":"), F.array_join(F.transform(fp["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 4, "0")), ""))


def differing_terms() -> list[float]:
    """For each number of differing hashes, the D at which that number is expected."""
    expected = lambda d: (d > 0) + FAMILIES * sum(1 - (1 - 0.5**j) ** d for j in range(1, MOST_LEVELS + 1))
    out = [0.0]
    for k in range(1, 1 + FAMILIES * MOST_LEVELS + 1):
        lo, hi = 0.0, 1e12
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if expected(mid) < k else (lo, mid)
        out.append(max(1.0, hi))
    return out


def likeness(a: Column, b: Column) -> Column:
    differ = F.size(F.filter(F.zip_with(a["hashes"], b["hashes"], lambda x, y: x == y), lambda e: ~e))
    d = F.element_at(F.array(*[F.lit(x) for x in differing_terms()]), differ + 1)
    both = (a["n"] + b["n"]).cast("double")
    return F.when(differ == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (both - d) / (both + d)))


def with_next(df: DataFrame, key: str, value: str, name: str, rows_each: int = 128) -> tuple[DataFrame, Window, str, str]:
    """``df`` with ``name``: ``value`` of the next row by ``key`` (then by a hash of ``value``); after the last comes the first.

    Rows are dealt by ranges of that order (one shuffle); a range's last row gets its next from the first
    row of the range after it. Also returned: the window, the range's column, and the column that is
    true for a range's last row.
    """
    bucket, last, tie, first, after, head = (free_name(df, c) for c in ("_bucket", "_last", "_tie", "_first", "_after", "_head"))
    cut = with_range(df, key, F.xxhash64(value), bucket, rows_each).withColumn(tie, F.xxhash64(value))
    order = Window.partitionBy(bucket).orderBy(F.col(key).asc_nulls_first(), tie)
    led = cut.withColumn(name, F.lead(value).over(order)).withColumn(last, F.lead(F.lit(1)).over(order).isNull()).withColumn(first, F.lag(F.lit(1)).over(order).isNull())
    heads = led.where(first).select(F.col(bucket).alias(after), F.col(value).alias(head))
    # The range after each, among the ranges alone: in its first-level range, else the first of the next one.
    ranges = materialize(cut.select(bucket).distinct())
    inside = Window.partitionBy(range_of(bucket)).orderBy(bucket)
    firsts = ranges.groupBy(range_of(bucket).alias("_r")).agg(F.min(bucket).alias("_f"))
    whole = Window.orderBy("_r")  # a row per first-level range: a bounded number
    firsts = firsts.select("_r", F.coalesce(F.lead("_f").over(whole), F.first("_f").over(whole)).alias("_f"))
    follows = ranges.select(bucket, F.lead(bucket).over(inside).alias(after), range_of(bucket).alias("_r")).join(F.broadcast(firsts), "_r")
    follows = follows.select(bucket, F.coalesce(after, "_f").alias(after)).join(heads, after).select(bucket, head)
    led = led.join(follows.hint("merge"), bucket).withColumn(name, F.when(F.col(last), F.col(head)).otherwise(F.col(name)))
    return led.drop(head, first), order, bucket, last


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", words: DataFrame | None = None, levels: int | None = None, **band) -> DataFrame:
    """``docs`` with the fingerprint of each text as struct<n, hashes> in ``name``."""
    levels = levels_for(docs, text_col) if levels is None else levels
    words = lexicon(docs, text_col, **band) if words is None else words
    text = F.coalesce(F.col(text_col), F.lit(""))
    return hash_subsets(_cut(docs.withColumn(name, terms(text)), {name: F.xxhash64(text)}, words), [name], levels)


def _cut(df: DataFrame, texts: dict[str, Column], words: DataFrame) -> DataFrame:
    """Cuts arrays of term hashes to the lexicon, with their numbers ``_n``; a text without lexicon terms has its own hash (the values of ``texts``)."""
    look = lexicon_lookup(words)
    if look is None:
        df = keep_joined(df, [*texts], words)
    else:
        df = df.withColumns({c + "_in": look(F.col(c)) for c in texts})
    df = df.withColumns({c + "_n": F.size(c + "_in") for c in texts})
    return df.withColumns({c: F.when(F.col(c + "_n") > 0, F.col(c + "_in")).otherwise(F.array(t)) for c, t in texts.items()}).drop(*[c + "_in" for c in texts])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    led, order, bucket, last = with_next(docs, "doc_id", "text", "next_text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.expr("left(next_text, length(text) div 4)"))
    led = led.withColumn("edited", edited)
    after = F.when(F.col(last), terms(F.col("next_text"))).otherwise(F.array().cast("array<bigint>"))  # the other rows get theirs from the next row
    digests = [F.xxhash64(c).alias(f"{c}_x") for c in ("text", "edited", "next_text")]
    made = led.select("doc_id", bucket, last, "_tie", *digests, F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("edit"), after.alias("after"))
    made = _cut(made, {"own": F.col("text_x"), "edit": F.col("edited_x"), "after": F.col("next_text_x")}, words)
    made = hash_subsets(made, ["own", "edit", "after"], levels_for(docs))
    following = F.when(F.col(last), F.col("after")).otherwise(F.lead("own").over(order))
    made = made.withColumn("following", following)
    return made.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
