"""Writers: subtitles, reading tables, JSON state. Spark's committer puts whole files in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import clock

FORMAT = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def subtitle_text(events: DataFrame, keys: list[str], header: str) -> DataFrame:
    """keys, body: the header, the Format line and a Dialogue or Comment line per event by ``event_no``."""
    line = F.concat(
        F.when(F.coalesce("comment", F.lit(False)), "Comment: ").otherwise("Dialogue: "),
        F.concat_ws(",", F.col("layer").cast("string"), clock(F.col("start")), clock(F.col("end")), "style", F.coalesce("name", F.lit("")),
                    *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("margin_l", "margin_r", "margin_v")], F.coalesce("effect", F.lit("")), F.coalesce("text", F.lit(""))),
    )
    got = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("event_no", line.alias("line")))).alias("_l"))
    body = F.concat(F.lit(f"{header.rstrip()}\n\n[Events]\nFormat: {FORMAT}\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
    return got.select(*keys, body.alias("body"))


def readings_text(rows: DataFrame, keys: list[str], comment: str = "# line\tflag\tsurface\treading") -> DataFrame:
    """keys, body of a readings TSV."""
    line = F.concat_ws("\t", F.col("line").cast("string"), F.coalesce("flag", F.lit("")), "surface", F.coalesce("reading", F.lit("")))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("_l"))
    return got.select(*keys, F.concat(F.lit(comment + "\n"), F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("body"))


def json_text(columns: list[str]) -> Column:
    """The columns as one JSON object with its keys in order, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def write_bodies(bodies: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key with the body as text."""
    bodies.select(*keys, F.col("body").alias("value")).write.partitionBy(*keys).option("lineSep", "").text(path)
