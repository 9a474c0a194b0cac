"""Compositions: timed lines from lyrics and emissions, and karaoke from corrected lines.

Both work on a corpus: every table carries ``song_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators import acoustic, matching, timeline, words
from strophe.sources.readers import lyric_rows

LEAST_LINE = 0.4


def timed_lines(lyrics: DataFrame, frames: DataFrame, vocab: dict[str, int], segments: DataFrame, max_hold: float = timeline.MAX_HOLD) -> DataFrame:
    """Lyrics (song_id, text in kana) and emissions -> lines on the video's clock.

    Every line is aligned, the units are post-processed (smear, durations, tails), lines that
    straddle or miss the splice map are dropped, and the others end with their segment at the latest.
    """
    rows = lyric_rows(lyrics, ["song_id"])
    lines = words.units_and_cells(rows.withColumn("resolved", F.split("surface", r"\s+"))).groupBy("song_id", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit"))), lambda x: x["unit"]).alias("units"))
    placed = acoustic.align_song(frames, lines, vocab, ["song_id"])
    done = timeline.post_process(placed, ["song_id"], ["song_id", "line_no"], ["unit_no"], max_hold)
    spans = done.groupBy("song_id", "line_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("conf").alias("conf")).where("start is not null")
    spans = matching.spans_cut(spans, segments, ["song_id"]).where("not spans").drop("spans")
    mapped = matching.map_times(spans, segments, ["song_id"], "start").where("seg_no is not null")
    limit = segments.select("song_id", "seg_no", F.col("ref_end").alias("_limit"), "offset")
    out = mapped.join(limit, ["song_id", "seg_no"])
    end = F.greatest(F.least("end", "_limit") + F.col("offset"), F.col("mapped") + LEAST_LINE)
    out = out.select("song_id", "line_no", F.col("mapped").alias("start"), end.alias("end"), "conf")
    return out.join(rows, ["song_id", "line_no"])


def karaoke(lines: DataFrame, frames: DataFrame, vocab: dict[str, int], envelope: DataFrame | None = None) -> DataFrame:
    """Corrected lines (song_id, line_no, start, end, resolved words) -> one karaoke text in kana and one in romaji each.

    Lines with fewer frames than units are spaced evenly. Both tracks share their boundaries.
    """
    units = words.units_and_cells(lines.withColumnsRenamed({"start": "line_start", "end": "line_end"}))
    of_line = units.groupBy("song_id", "line_no", "line_start", "line_end").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit"))), lambda x: x["unit"]).alias("units"))
    near = frames.join(of_line.select("song_id", "line_no", "line_start", "line_end"), "song_id").where(
        (F.col("frame") >= F.floor(F.col("line_start") / acoustic.STRIDE)) & (F.col("frame") <= F.floor(F.col("line_end") / acoustic.STRIDE))
    )
    keys = ["song_id", "line_no"]
    placed = _placed(near, of_line, vocab)
    if envelope is not None:
        placed = timeline.snap_to_onsets(placed, envelope, ["song_id"])
    got = units.join(placed.select(*keys, "unit_no", "start"), [*keys, "unit_no"], "left")
    w = Window.partitionBy(*keys)
    even = F.col("line_start") + (F.col("line_end") - F.col("line_start")) * F.col("unit_no") / F.count(F.lit(1)).over(w)
    none = F.count("start").over(w) == 0
    got = got.withColumn("start", F.when(none, even).otherwise(F.coalesce("start", "line_start")))
    tiled = timeline.tile(timeline.space_starts(got, keys, ["unit_no"]), keys, ["unit_no"])
    kana = timeline.karaoke_text(tiled, keys, ["unit_no"], "unit").withColumnRenamed("text", "kana_text")
    romaji = timeline.karaoke_text(tiled, keys, ["unit_no"], "cell").withColumnRenamed("text", "romaji_text")
    return kana.join(romaji, keys)


def _placed(near: DataFrame, lines: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """Units of each line on the line's own frames."""
    keyed = lines.select("song_id", F.col("line_no").alias("line_key"), "line_no", "units")
    got = acoustic.align_lines(near.select("song_id", F.col("line_no").alias("line_key"), "frame", "lp"), keyed, vocab, ["song_id", "line_key"])
    return got.select("song_id", "line_no", "unit_no", "start")


def unequal_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines (song_id, line_no, cells) whose two tracks differ in their number of cells."""
    return a.select("song_id", "line_no", F.col("cells").alias("left")).join(b.select("song_id", "line_no", F.col("cells").alias("right")), ["song_id", "line_no"]).where("left <> right")
