"""Resolving entities and decisions: themes, hits, candidates, overrides, caches."""

from __future__ import annotations

import bisect
import difflib
import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType

from strophe.functions.text import fold, norm_title


def dedupe_first(themes: DataFrame) -> DataFrame:
    """One theme per (kind, title without signs): the first by ``ord``; an empty artist is filled from the
    first later one that has it, and that row's source is appended."""
    key = F.lower(F.regexp_replace("title", r"(?U)\W+", ""))
    t = themes.withColumn("_key", key)
    row = F.struct(*[c for c in themes.columns])
    named = F.min_by(F.when(F.col("artist") != "", F.struct("ord", "artist", "source")), F.when(F.col("artist") != "", F.col("ord")))
    got = t.groupBy("kind", "_key").agg(F.min_by(row, "ord").alias("r"), named.alias("named"))
    fill = (F.coalesce(F.col("r.artist"), F.lit("")) == "") & F.col("named").isNotNull()
    cols = [F.col(f"r.{c}").alias(c) for c in themes.columns if c not in ("artist", "source")]
    artist = F.when(fill, F.col("named.artist")).otherwise(F.col("r.artist")).alias("artist")
    source = F.when(fill, F.concat(F.col("r.source"), F.lit("+"), F.col("named.source"))).otherwise(F.col("r.source")).alias("source")
    return got.select(*cols, artist, source).select(*themes.columns)


def filter_kind(themes: DataFrame, kind: str | None, keys: list[str] = ()) -> DataFrame:
    """Rows of the kind, or all rows (of the group) where none is."""
    if not kind:
        return themes
    if not keys:
        found = themes.where(F.col("kind") == kind).limit(1).select(F.lit(True).alias("_any"))  # one row at most
        return themes.join(F.broadcast(found), F.lit(True), "left").where(F.col("_any").isNull() | (F.col("kind") == kind)).drop("_any")
    # Reduced to a row per group before it is joined, so that a hot group stays spread.
    some = themes.groupBy(*keys).agg(F.bool_or(F.col("kind") == kind).alias("_any"))
    return themes.join(some, list(keys)).where(~F.coalesce(F.col("_any"), F.lit(False)) | (F.col("kind") == kind)).drop("_any")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (Ratcliff-Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def word_overlap(query: Column, series: Column) -> Column:
    """Share of the query's distinct words that the series has."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(norm_title(c), " "), ""))
    return F.size(F.array_intersect(words(query), words(series))) / F.greatest(F.size(words(query)), F.lit(1))


def series_score(query: Column, series: Column) -> Column:
    """Half the ratio of matching blocks, half the overlap of words; 0 if either is empty."""
    q, s = norm_title(query), norm_title(series)
    score = F.round(0.5 * sequence_ratio(q, s) + 0.5 * word_overlap(query, series), 3)
    return F.when((q != "") & (s != ""), score).otherwise(0.0)


def rank_themes(themes: DataFrame, query: str, keys: list[str] = ()) -> DataFrame:
    """``rank``: best series, then OP before others, then the sequence as text, then ``ord``."""
    scored = themes.withColumn("score", series_score(F.lit(query), F.col("series")))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), (F.col("kind") != "OP").cast("int"), F.coalesce("sequence", F.lit("")), "ord")
    return scored.withColumn("rank", F.row_number().over(w))


def usable_hits(hits: DataFrame) -> DataFrame:
    return hits.where((F.coalesce("syncedLyrics", F.lit("")) != "") & ~F.coalesce("instrumental", F.lit(False)))


def artists_match(a: Column, b: Column, least: float = 0.82) -> Column:
    """Either folded name holds the other, or their ratio is ``least`` or more; empty names match nothing."""
    x, y = fold(a), fold(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (sequence_ratio(x, y) >= least))


def verify_hits(hits: DataFrame, wanted: DataFrame, key: str = "song_id") -> DataFrame:
    """The nearest usable hit of each wanted song (key, artist, duration), if it is near enough.

    A known artist must match and allows 10 s; an unknown one allows 5 s; no duration, no hit.
    """
    w = wanted.where("duration is not null").select(key, F.col("artist").alias("_artist"), F.col("duration").alias("_want"))
    met = usable_hits(hits).join(w, key)
    known = F.coalesce(F.col("_artist"), F.lit("")) != ""
    met = met.where(~known | artists_match(F.col("_artist"), F.col("artistName")))
    away = F.abs(F.col("duration") - F.col("_want"))
    met = met.withColumn("_away", away).withColumn("_most", F.when(known, 10.0).otherwise(5.0))
    best = met.groupBy(key).agg(F.min_by(F.struct(*hits.columns, "_away", "_most"), F.struct("_away", "ord")).alias("h"))
    return best.where("h._away <= h._most").select(*[F.col(f"h.{c}").alias(c) for c in hits.columns])


def plausible(candidates: DataFrame, low: float = 60, high: float = 600, want: float | None = None, keys: list[str] = ()) -> DataFrame:
    """Candidates of a plausible duration; with ``want``, ``choice`` numbers them from the nearest on."""
    out = candidates.where(F.col("duration").between(low, high))
    if want is None:
        return out
    return out.withColumn("choice", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col("duration") - want), "ord")))


def manual_overrides(table: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by line and surface, by surface alone) of the rows of ``table`` that a user changed.

    ``table``: line, flag, surface, reading and perhaps ord (else as read); ``baseline``: line, surface,
    reading as written. Of rows that share line and surface the last one counts. A surface stands for itself
    if it is in one row of the table and that row was changed.
    """
    b = baseline.select("line", "surface", F.col("reading").alias("_was"))
    written = table.where(F.col("reading").cast("string") != "")
    changed = written.join(b, ["line", "surface"], "left").where(~F.col("reading").eqNullSafe(F.col("_was")))
    last = F.col("ord") if "ord" in table.columns else F.monotonically_increasing_id()
    by_line = changed.withColumn("_ord", last).groupBy("line", "surface").agg(F.max_by("reading", "_ord").alias("reading"))
    rows = table.groupBy("surface").agg(F.count(F.lit(1)).alias("_rows"))
    one = changed.groupBy("surface").agg(F.min("reading").alias("reading"), F.count_distinct("reading").alias("_values"))
    by_surface = one.join(rows, "surface").where("_rows = 1 and _values = 1").select("surface", "reading")
    return by_line, by_surface


def valid_reading(reading: Column) -> Column:
    return F.coalesce(reading.rlike(r"^[ぁ-ゖゝゞー\s]+$"), F.lit(False))


def invalid_overrides(table: DataFrame, baseline: DataFrame) -> DataFrame:
    """line, surface, reading, error: rows that a user changed to something that is no reading; callers stop on any."""
    bad = manual_overrides(table, baseline)[0].where(~valid_reading(F.col("reading")))
    return bad.select("line", "surface", "reading", F.format_string("row %s: not hiragana and blanks alone", F.col("line").cast("string")).alias("error"))


def unite(providers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all providers that answer, in their order; name -> ok or the failure's kind): one that fails is left out."""
    found, status = None, {}
    for i, (name, ask) in enumerate(providers.items()):
        try:
            got = ask()
        except Exception as e:  # a provider may fail in any way
            status[name] = type(e).__name__
            continue
        status[name] = "ok"
        got = got.withColumn("ord", F.lit(i).cast("bigint") * F.lit(1 << 40) + F.col("ord"))
        found = got if found is None else found.unionByName(got)
    return found, status


def search_themes(providers: dict[str, Callable[[], DataFrame]], query: str, kind: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Themes of all providers, one a title, of the kind if there are any, ranked for the query."""
    found, status = unite(providers)
    return (None if found is None else rank_themes(filter_kind(dedupe_first(found), kind), query)), status


def first_tried(candidates: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` candidates of each key, numbered by ``try_no``."""
    out = candidates.withColumn("try_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col("try_no") <= most)


@pandas_udf(StringType())
def array_identity(samples: pd.Series) -> pd.Series:
    """SHA-256 of a waveform: its shape as text and its samples as 32-bit floats."""
    def one(x):
        x = np.ascontiguousarray([] if x is None else x, np.float32)
        return hashlib.sha256(str(x.shape).encode() + x.astype("<f4").tobytes()).hexdigest()

    return samples.map(one)


def stable_key(kind: str, schema: int, **values: Column) -> Column:
    """SHA-256 of a key's parts as compact JSON, names in order."""
    parts = {"kind": F.lit(kind), "schema": F.lit(schema), **values}
    return F.sha2(F.to_json(F.struct(*[parts[c].alias(c) for c in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def derived_identity(operation: Column, options: Column, path: Column, size: Column, modified: Column, schema: int = 1) -> Column:
    """JSON that tells what a derived file was made from: operation, options and the source's path, size and time."""
    source = F.struct(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).alias("path"), size.alias("size"), modified.alias("mtime_ns"))
    return F.to_json(F.struct(F.lit(schema).alias("schema"), operation.alias("operation"), source.alias("source"), options.alias("options")), {"ignoreNullFields": "false"})


@pandas_udf(BooleanType())
def metadata_matches(stored: pd.Series, expected: pd.Series) -> pd.Series:
    """Whether stored JSON says the same as expected JSON, in any order of names; null or broken JSON does not."""
    def same(a, b):
        try:
            return json.loads(a) == json.loads(b)
        except (TypeError, ValueError):
            return False

    return pd.Series([same(a, b) for a, b in zip(stored, expected, strict=True)])


def apply_overrides(rows: DataFrame, by_line: DataFrame, by_surface: DataFrame) -> DataFrame:
    """``override``: by (line, surface), else by surface, else null."""
    a = by_line.select("line", "surface", F.col("reading").alias("_line"))
    b = by_surface.select("surface", F.col("reading").alias("_surface"))
    out = rows.join(a, ["line", "surface"], "left").join(b, "surface", "left")
    return out.withColumn("override", F.coalesce("_line", "_surface")).drop("_line", "_surface")


def cache_key(*parts: Column) -> Column:
    """Content key: SHA-256 of the parts as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def with_cache(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the cached decision, rows that the cache misses)."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def prune_stage(decisions: DataFrame, active: DataFrame, stage: str) -> DataFrame:
    """Drops the stage's decisions whose key is not active; other stages' stay."""
    live = decisions.where(F.col("stage") == stage).join(active.select("key").distinct(), "key", "left_semi")
    return decisions.where(~F.col("stage").eqNullSafe(stage)).unionByName(live)


def update_baseline(baseline: DataFrame, written: DataFrame, table: DataFrame) -> DataFrame:
    """The new baseline: what was written, but for rows that a user has edited, which keep theirs."""
    keys = ["line", "surface"]
    edited = table.join(baseline.select(*keys, F.col("reading").alias("_was")), keys).where(~F.col("reading").eqNullSafe(F.col("_was"))).select(*keys, "_was")
    return written.join(edited, keys, "left").select(*keys, F.coalesce("_was", "reading").alias("reading"))


def match_timings(lines: DataFrame, timings: DataFrame, song: list[str]) -> DataFrame:
    """song, line_no, t: each line takes the first later timing of equal folded text (greedy, in order).

    The lines and timings of one song are scanned together; songs are spread.
    """
    a = lines.select(*song, F.lit(0).alias("_kind"), F.col("line_no").cast("double").alias("_at"), fold(F.col("text")).alias("_text"))
    b = timings.select(*song, F.lit(1).alias("_kind"), F.col("t").alias("_at"), fold(F.col("text")).alias("_text"))
    schema = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in song) + ", line_no int, t double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        want = rows[rows._kind == 0].sort_values("_at", kind="stable")
        have = rows[rows._kind == 1].sort_values("_at", kind="stable")
        places: dict[str, list[int]] = {}
        for i, x in enumerate(have._text):
            places.setdefault(x, []).append(i)
        times, at, out = have._at.tolist(), 0, []
        for no, x in zip(want._at, want._text, strict=True):
            known = places.get(x, ()) if x else ()
            k = bisect.bisect_left(known, at)
            if k < len(known):
                out.append((*key, int(no), times[known[k]]))
                at = known[k] + 1
        return pd.DataFrame(out, columns=[*song, "line_no", "t"])

    return a.unionByName(b).groupBy(*song).applyInPandas(run, schema)
