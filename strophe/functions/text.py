"""Text functions: lyric lines, time stamps, pages, titles, scripts."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

KANJI = "一-鿿㐀-䶿々〆ヶ"
KANA = "ぁ-ゖァ-ヺー"


@pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else html.unescape(s))


def fold(text: Column) -> Column:
    """For comparison: NFKC, lower case, digits, Latin letters, kana and kanji alone."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), "[^0-9a-zぁ-ゖァ-ヺー一-鿿]", "")


def norm_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def strip_ruby(text: Column) -> Column:
    """Kanji with a kana gloss in parentheses become the gloss."""
    return F.regexp_replace(text, r"[一-鿿々]+[(（]([ぁ-ゖァ-ヺー]+)[)）]", "$1")


def normalise_surface(text: Column) -> Column:
    """NFKC without variation selectors, full-width blanks as blanks, ruby resolved, trimmed."""
    t = F.regexp_replace(nfkc(text), "[︀-️\U000e0100-\U000e01ef]", "")
    return F.trim(strip_ruby(F.regexp_replace(t, "　", " ")))


def clean_lines(text: Column, escaped: bool = True) -> Column:
    """Lines of a lyric text: any line break, entities resolved, no blanks at ends, no blank lines at the edges."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    t = F.regexp_replace(unescape(t) if escaped else t, "　", " ")
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    marked = F.transform(lines, lambda x, i: F.when(x != "", i + 1))
    first, last = F.coalesce(F.array_min(marked), F.lit(1)), F.coalesce(F.array_max(marked), F.lit(0))
    return F.slice(lines, first, last - first + 1)


# Fixed patterns of stamped lyric lines.
LRC_LINE = r"^((?:\[\d+:\d+(?:[.:]\d+)?\])+)(.*)$"
LRC_STAMP = r"\[(\d+):(\d+)(?:[.:](\d+))?\]"


def _lrc_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n", -1)


def parse_lrc(text: Column) -> Column:
    """array<struct<t, line_no, text>> of stamped lines, by time; a line may have several stamps."""

    def of_line(x, i):
        stamps = F.regexp_extract(F.trim(x), LRC_LINE, 1)
        words = F.trim(F.regexp_extract(F.trim(x), LRC_LINE, 2))
        part = lambda k: F.regexp_extract_all(stamps, F.lit(LRC_STAMP), F.lit(k))
        fraction = F.transform(part(3), lambda f: F.when(f == "", 0.0).otherwise(F.concat(F.lit("0."), f).cast("double")))
        whole = F.zip_with(part(1), part(2), lambda m, s: m.cast("double") * 60 + s.cast("double"))
        return F.transform(F.zip_with(whole, fraction, lambda w, f: w + f), lambda t: F.struct(t.alias("t"), i.alias("line_no"), words.alias("text")))

    return F.array_sort(F.flatten(F.transform(_lrc_lines(text), of_line)))


def lrc_lines(text: Column) -> Column:
    """The text's lines without their stamps; lines without stamps as they are."""
    return F.transform(_lrc_lines(text), lambda x: F.when(F.trim(x).rlike(LRC_LINE), F.trim(F.regexp_extract(F.trim(x), LRC_LINE, 2))).otherwise(F.regexp_replace(x, r"\s+$", "")))


def script_ratio(text: Column) -> Column:
    """Share of ASCII letters among the letters; null without a letter."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when(letters > 0, ascii_ / letters)


def looks_like_romaji(text: Column, least: float = 0.6) -> Column:
    return F.coalesce(script_ratio(text) >= least, F.lit(False))


def line_flags(surface: Column, reading: Column | None = None, source: str = "jp") -> Column:
    """Flags of a line, in order, joined by commas: digits, latin, unresolved-kanji, n-vowel-ambiguous."""
    r = surface if reading is None else reading
    romaji = source == "romaji"
    return F.concat_ws(",",
        F.when(surface.rlike(r"[0-9０-９]"), "digits"), F.when(F.lit(not romaji) & surface.rlike(r"[A-Za-z]"), "latin"),
        F.when(r.rlike(f"[{KANJI}]"), "unresolved-kanji"),
        F.when(F.lit(romaji) & ~F.contains(surface, F.lit("'")) & F.lower(surface).rlike("n[aiueo]"), "n-vowel-ambiguous"))


# Fixed pattern of how catalogues print a theme.
THEME_LINE = r'(?i)^["“「]\s*(.+?)\s*["”」](?:\s*by\s*(.+?))?(?:\s*\(([^)]*ep[^)]*)\))?\s*$'


def theme_text(text: Column) -> Column:
    """struct<title, artist, episodes> of ``"TITLE" by ARTIST (eps 1-13)`` or ``TITLE by ARTIST``."""
    t = F.trim(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    m = lambda i: F.trim(F.regexp_extract(t, THEME_LINE, i))
    quoted = t.rlike(THEME_LINE)
    at = F.locate(" by ", t)
    plain_title = F.when(at > 0, F.trim(F.substring(t, F.lit(1), at - 1))).otherwise(t)
    plain_artist = F.when(at > 0, F.trim(F.substring(t, at + 4, F.length(t)))).otherwise("")
    return F.struct(
        F.when(quoted, m(1)).otherwise(plain_title).alias("title"), F.when(quoted, m(2)).otherwise(plain_artist).alias("artist"),
        F.when(quoted, m(3)).otherwise("").alias("episodes"))


def split_kind(raw: Column) -> Column:
    """struct<kind, sequence>: OP or ED or empty, and the first number."""
    r = F.trim(F.coalesce(raw, F.lit("")))
    kind = F.when(r.rlike("(?i)open|^op"), "OP").when(r.rlike("(?i)end|^ed"), "ED").otherwise("")
    return F.struct(kind.alias("kind"), F.regexp_extract(r, r"(\d+)", 1).alias("sequence"))


def lyric_page(page: Column) -> Column:
    """struct<title, artist, lines>: the lyric of a web page.

    The body is the element marked ``itemprop="text"`` or, failing that, the one of id ``kashi_area``;
    title and artist are those of the page's music description, or the title is its second heading.
    """
    body = lambda p: F.regexp_extract(page, p, 1)
    marked = body(r'(?is)<div[^>]*itemprop="text"[^>]*>(.*?)</div>')
    area = body(r'(?is)<div[^>]*id="kashi_area"[^>]*>(.*?)</div>')
    text = F.when(marked != "", marked).otherwise(area)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*<br\s*/?>\s*", "\n"), r"(?s)<[^>]+>", "")
    blocks = F.regexp_extract_all(page, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    kind = "`@type` string, name string, byArtist struct<name:string>, recordedAs struct<byArtist:struct<name:string>>"
    parsed = F.filter(F.transform(blocks, lambda b: F.from_json(b, kind)), lambda x: F.contains(x["@type"], F.lit("Music")))
    music = F.get(parsed, F.lit(0))
    heading = F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<h2[^>]*>(.*?)</h2>", 1), r"(?s)<[^>]+>", ""))
    artist = F.coalesce(music["byArtist"]["name"], music["recordedAs"]["byArtist"]["name"], F.lit(""))
    return F.struct(unescape(F.coalesce(music["name"], heading)).alias("title"), unescape(artist).alias("artist"), clean_lines(text).alias("lines"))


def search_query(title: Column, artist: Column, series: Column) -> Column:
    """Artist and title, or series and title where there is no artist; blanks squeezed."""
    first = F.when(F.coalesce(artist, F.lit("")) != "", artist).otherwise(series)
    return F.trim(F.regexp_replace(F.concat_ws(" ", first, title), r"\s+", " "))


def track_id(url: Column, hosts: tuple[str, ...]) -> Column:
    """Number of a track page on one of the hosts; null for another host or path."""
    right = F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts)
    number = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/tracks/([1-9]\d*)/?$", 1)
    return F.when(right & (number != ""), number)


def project_name(file_name: Column, suffixes: tuple[str, ...] = (".ass", ".kara.romaji", ".kara.kana", ".kara.jp", ".lines")) -> Column:
    """A file's name without its role suffixes, however many; a name of suffixes alone stays."""
    base = F.regexp_replace(file_name, r"^.*[/\\]", "")
    tail = "|".join(x.replace(".", r"\.") for x in suffixes)
    name = F.regexp_replace(base, f"(?i)(?:{tail})+$", "")
    return F.when(name == "", base).otherwise(name)


def event_text(text: Column) -> Column:
    return F.regexp_replace(text, r"\{[^}]*\}", "")


def karaoke_values(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{[^}]*?\\kf?(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def annotate(text: Column, romaji: Column) -> Column:
    safe = F.translate(F.replace(romaji, F.lit("*RO*"), F.lit("*R0*")), "{}", "()")
    return F.when(F.coalesce(romaji, F.lit("")) == "", text).otherwise(F.concat(F.lit("{*RO*"), safe, F.lit("*RO*}"), text))


def strip_annotation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\{\*RO\*.*?\*RO\*\}", "")


def is_annotated(text: Column) -> Column:
    return text.rlike(r"(?s)\{\*RO\*.*?\*RO\*\}")


def is_punctuation(ch: Column) -> Column:
    return ch.rlike(r"^[^\p{L}\p{N}\s]$")


def hiragana(text: Column) -> Column:
    """Katakana as hiragana, letter by letter (a rule: 96 code points down)."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(text, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def classify_spec(spec: Column, cached: Column, lyric_host: str, page_host: str) -> Column:
    """Where a lyric comes from: cache, file, track, page, url or search, in this order."""
    host = F.lower(F.try_parse_url(spec, F.lit("HOST")))
    return (
        F.when(F.coalesce(cached, F.lit(False)), "cache").when(spec.rlike(r"(?i)^[^:]+\.(txt|lrc)$"), "file")
        .when(host.isin(lyric_host, f"www.{lyric_host}"), "track").when(host.isin(page_host, f"www.{page_host}"), "page")
        .when(host.isNotNull(), "url").otherwise("search")
    )
