"""Readers: subtitles, lyric files, reading tables, phrase lists, dictionaries, service payloads, state.

Files are read whole and parsed by column expressions; ``path`` tells the rows of one file apart.
Malformed rows are dropped where the format says so, or get a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import scalars, text
from strophe.functions.text import nfkc

LEXICON = "surface string, reading string, base string, pos string, common int, ord int, uk int, conj int, form string"
THEMES = "array<struct<name:string, year:int, animethemes:array<struct<type:string, sequence:string, song:struct<title:string, artists:array<struct<name:string>>>>>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("body"))


def subtitle_events(files: DataFrame, body: str = "body") -> DataFrame:
    """Events of subtitle files: columns by each file's Format line, Dialogue rows alone, by start.

    Rows of too few fields or with bad times are dropped; a file without a Format line has none.
    """
    part = F.regexp_replace(F.regexp_extract(body, r"(?is)(?:^|\n)\[Events\][^\n]*\n(.*?)(?=\n\[|$)", 1), "\r", "")
    fmt = F.transform(F.split(F.regexp_extract(part, r"(?m)^Format:\s*(.*)$", 1), ","), lambda c: F.lower(F.trim(c)))
    rows = F.regexp_extract_all(part, F.lit(r"(?m)^Dialogue:\s*(.*)$"), F.lit(1))
    other = [c for c in files.columns if c != body]
    out = files.select(*other, fmt.alias("_fmt"), F.posexplode(rows).alias("ord", "_row"))
    # The last column takes the rest of the row, commas and all.
    out = out.withColumn("_cells", F.expr("split(_row, ',', size(_fmt))")).where(F.size("_cells") == F.size("_fmt"))
    out = out.withColumn("_m", F.map_from_arrays("_fmt", "_cells"))
    cell = lambda c: F.trim(F.element_at("_m", F.lit(c)))
    out = out.select(
        *other, "ord", scalars.parse_clock(cell("start")).alias("start"), scalars.parse_clock(cell("end")).alias("end"), F.element_at("_m", F.lit("text")).alias("text"),
        cell("style").alias("style"), F.coalesce(cell("layer").try_cast("int"), F.lit(0)).alias("layer"), F.coalesce(cell("name"), F.lit("")).alias("name"),
        cell("marginl").alias("margin_l"), cell("marginr").alias("margin_r"), cell("marginv").alias("margin_v"), F.coalesce(cell("effect"), F.lit("")).alias("effect"),
    )
    out = out.where("start is not null and end is not null and text is not null")
    return out.withColumn("event_no", F.row_number().over(Window.partitionBy(*other).orderBy("start", "ord")) - 1)


def header_stamp(files: DataFrame, name: str, body: str = "body") -> DataFrame:
    """The first ``; name: value`` comment before the events."""
    head = F.regexp_extract(body, r"(?is)^(.*?)(?:\n\[Events\]|$)", 1)
    return files.withColumn("stamp", F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^;\s*{name}:\s*(.*)$", 1)), F.lit("")))


def lyric_file(files: DataFrame, body: str = "body") -> DataFrame:
    """``lines`` (cleaned) and ``timings`` of lyric texts with or without stamps."""
    return files.withColumn("timings", text.parse_lrc(F.col(body))).withColumn("lines", text.clean_lines(F.array_join(text.lrc_lines(F.col(body)), "\n")))


def lyric_rows(df: DataFrame, keys: list[str], body: str = "text", escaped: bool = True, trim_edges: bool = True) -> DataFrame:
    """keys, line_no (from 1, blank lines counted), surface of the lines that are not blank."""
    lines = text.clean_lines(F.col(body), escaped) if trim_edges else F.transform(F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "\r\n|\r", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"[ \t]+$", ""))
    out = df.select(*keys, F.posexplode(lines).alias("line_no", "surface"))
    return out.select(*keys, (F.col("line_no") + 1).alias("line_no"), "surface").where(F.trim("surface") != "")


def _tsv(files: DataFrame, body: str) -> DataFrame:
    other = [c for c in files.columns if c != body]
    rows = files.select(*other, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n", -1)).alias("row_no", "_row"))
    return rows.where((F.trim("_row") != "") & ~F.startswith("_row", F.lit("#"))).withColumn("cells", F.split("_row", "\t", -1)).drop("_row")


def readings_table(files: DataFrame, body: str = "body") -> DataFrame:
    """line, flag, surface, reading of a readings TSV; rows of fewer than four cells are dropped."""
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    rows = _tsv(files, body).where(F.size("cells") >= 4)
    return rows.select(*[c for c in files.columns if c != body], "row_no", cell(0).try_cast("int").alias("line"), cell(1).alias("flag"), cell(2).alias("surface"), F.trim(nfkc(cell(3))).alias("reading"))


def reading_overrides(files: DataFrame, body: str = "body") -> DataFrame:
    """surface, reading of a readings TSV: the last row of a surface wins, empty readings do not count."""
    rows = readings_table(files, body).where("reading <> ''")
    keys = [c for c in files.columns if c != body]
    return rows.groupBy(*keys, "surface").agg(F.max_by("reading", "row_no").alias("reading"))


def phrases(builtin: DataFrame, files: DataFrame, body: str = "body") -> DataFrame:
    """surface, reading: the built-in phrases without those a file deletes, and those it adds (the last row wins)."""
    rows = _tsv(files, body).select("row_no", F.trim(F.get("cells", F.lit(0))).alias("surface"), F.trim(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))).alias("reading")).where("surface <> ''")
    rows = rows.groupBy("surface").agg(F.max_by("reading", "row_no").alias("reading"))
    kept = builtin.select("surface", "reading").join(rows.select("surface"), "surface", "left_anti")
    return kept.unionByName(rows.where(F.upper("reading") != "DELETE").withColumn("reading", F.nullif("reading", F.lit(""))))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary TSV (gzip or not) with a header, and each entry's ``place`` among those of its surface."""
    d = spark.read.csv(path, sep="\t", schema=LEXICON, header=True, mode="DROPMALFORMED", quote="")
    w = Window.partitionBy("surface").orderBy((F.col("common") == -1).cast("int"), "common", "ord")
    return d.withColumn("place", F.row_number().over(w) - 1)


def chapters(df: DataFrame, payload: str = "payload") -> DataFrame:
    """ord, start, end, title of chapter JSON; titles that are missing are empty."""
    kind = "chapters array<struct<start_time:string, end_time:string, tags:struct<title:string>>>"
    got = df.select(*[c for c in df.columns if c != payload], F.posexplode(F.from_json(payload, kind)["chapters"]).alias("ord", "c"))
    return got.select(*[c for c in got.columns if c != "c"], F.col("c.start_time").try_cast("double").alias("start"), F.col("c.end_time").try_cast("double").alias("end"), F.coalesce("c.tags.title", F.lit("")).alias("title"))


def lyric_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """title, artist, lines of lyric pages; ``status`` is ``no body`` where the page has none."""
    out = df.withColumn("_p", text.lyric_page(F.col(html)))
    status = F.when(F.size("_p.lines") > 0, "ok").otherwise("no body")
    return out.select(*[c for c in df.columns if c != html], "_p.title", "_p.artist", "_p.lines", status.alias("status"))


def _theme(title: Column, kind: Column, source: str, sequence: Column) -> list[Column]:
    """Columns of a printed theme; a leading number is its sequence."""
    t = text.theme_text(title)
    number = F.regexp_extract(t["title"], r"^#?(\d+)[:.]?\s*(.*)", 1)
    rest = text.theme_text(F.trim(F.regexp_extract(t["title"], r"(?s)^#?(\d+)[:.]?\s*(.*)", 2)))
    has = number != ""
    pick = lambda c: F.when(has & (t[c] == ""), rest[c]).otherwise(t[c])
    return [
        kind.alias("kind"), F.when(has, number).otherwise(sequence).alias("sequence"), F.when(has, rest["title"]).otherwise(t["title"]).alias("title"),
        pick("artist").alias("artist"), pick("episodes").alias("episodes"), F.lit(source).alias("source"),
    ]


def themes_from_catalogue(df: DataFrame, payload: str = "payload", source: str = "catalogue") -> DataFrame:
    """Themes of a catalogue's JSON: anime, their themes, songs and artists."""
    a = df.select(F.posexplode(F.from_json(F.get_json_object(payload, "$.anime"), THEMES)).alias("_i", "a"))
    t = a.select("_i", "a.name", "a.year", F.posexplode("a.animethemes").alias("_j", "t"))
    kind = text.split_kind(F.col("t.type"))
    artists = F.array_join(F.filter(F.transform("t.song.artists", lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    out = t.select(
        (F.col("_i") * 1000 + F.col("_j")).alias("ord"), kind["kind"].alias("kind"), F.coalesce(F.nullif(F.col("t.sequence"), F.lit("0")), kind["sequence"]).alias("sequence"),
        F.trim(F.coalesce("t.song.title", F.lit(""))).alias("title"), F.coalesce(artists, F.lit("")).alias("artist"), F.lit("").alias("episodes"), F.lit(source).alias("source"), F.coalesce("name", F.lit("")).alias("series"), "year",
    )
    return out.where("title <> ''")


def themes_from_xml(df: DataFrame, payload: str = "payload", source: str = "encyclopedia") -> DataFrame:
    """Themes of an encyclopedia's XML."""
    p = F.col(payload)
    pattern = r'(?is)<info[^>]*type="(Opening|Ending) Theme"[^>]*>(.*?)</info>'
    both = F.arrays_zip(F.regexp_extract_all(p, F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(p, F.lit(pattern), F.lit(2)).alias("body"))
    series = F.replace(F.regexp_extract(p, r'<anime[^>]*\sname="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))
    rows = df.select(series.alias("series"), F.regexp_extract(p, r"<vintage>(\d{4})", 1).try_cast("int").alias("year"), F.posexplode(both).alias("ord", "x"))
    kind = text.split_kind(F.col("x.kind"))
    out = rows.select("ord", *_theme(F.regexp_replace("x.body", "<[^>]+>", ""), kind["kind"], source, kind["sequence"]), "series", "year")
    return out.where("title <> ''")


def themes_from_lists(df: DataFrame, payload: str = "payload", source: str = "list") -> DataFrame:
    """Themes of a service that prints lists of openings and endings (columns series, year beside the payload)."""
    x = df.withColumn("_x", F.from_json(payload, "openings array<string>, endings array<string>"))
    parts = [x.select("series", "year", F.lit(k).alias("_kind"), F.posexplode(f"_x.{c}").alias("_i", "_raw")) for c, k in (("openings", "OP"), ("endings", "ED"))]
    rows = parts[0].unionByName(parts[1])
    number = F.when(F.col("_i") > 0, (F.col("_i") + 1).cast("string")).otherwise("")
    out = rows.select((F.col("_i") + F.when(F.col("_kind") == "ED", 1000).otherwise(0)).alias("ord"), *_theme(F.col("_raw"), F.col("_kind"), source, number), "series", "year")
    return out.where("title <> ''")


def search_lines(df: DataFrame, output: str = "output") -> DataFrame:
    """Candidates of JSON-lines output: other lines, malformed ones and those without an id are dropped."""
    rows = df.select(*[c for c in df.columns if c != output], F.posexplode(F.split(output, "\n")).alias("ord", "_line")).where(F.startswith(F.trim("_line"), F.lit("{")))
    rows = rows.withColumn("_x", F.from_json("_line", "id string, title string, uploader string, channel string, duration double"))
    out = rows.select(*[c for c in rows.columns if c not in ("_line", "_x")], F.col("_x.id").alias("ident"), F.coalesce("_x.title", F.lit("")).alias("title"), F.coalesce("_x.uploader", "_x.channel", F.lit("")).alias("uploader"), F.col("_x.duration").alias("duration"))
    return out.where("ident is not null and ident <> ''")


def search_ids(page: Column, pattern: str = r'href="/song/(\d+)/?"') -> Column:
    """Distinct ids of a search page in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)))


def state(df: DataFrame, schema: str, version: int, payload: str = "payload") -> DataFrame:
    """Parsed state JSON; ``status`` is ok, or bad version, or unreadable (then all fields are null)."""
    out = df.withColumn("_x", F.from_json(payload, f"schema_version int, {schema}"))
    status = F.when(F.col("_x.schema_version").isNull(), "unreadable").when(F.col("_x.schema_version") != version, "bad version").otherwise("ok")
    out = out.withColumn("status", status)
    return out.select(*[c for c in df.columns if c != payload], "status", F.when(F.col("status") == "ok", F.col("_x")).alias("state"))
