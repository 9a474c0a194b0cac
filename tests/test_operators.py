"""Inline cases of the operators, with results worked out by hand or by a plain restatement."""

import hashlib
import itertools
import json
import random
import struct
from dataclasses import astuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import kana, scalars, text
from strophe.operators import acoustic, matching, resolve, timeline
from strophe.sources import readers, writers

SEG = "song_id string, ord int, ref_start double, ref_end double, ep_start double, ep_end double, offset double, support int"


def segs(spark, rows):
    return spark.createDataFrame([("s", i, *map(float, r[:5]), int(r[5])) for i, r in enumerate(rows)], SEG)


@pytest.mark.parametrize(
    "rows, status",
    [
        ([(10, 10, 40, 70, 30, 900)], ["empty"]),
        ([(0, 30, 40, 70, 40, 900), (40, 70, 60, 90, 20, 900)], ["ok", "overlap"]),
        ([(90, 120, 40, 70, -50, 900), (0, 30, 70, 100, 70, 900)], ["ok", "reorder"]),
        ([(0, 30, 40, 70, 40, 900), (10, 50, 80, 120, 70, 100)], ["ok", "ok"]),
    ],
)
def test_validate(spark, rows, status):
    got = timeline.validate_segments(segs(spark, rows), ["song_id"]).orderBy("ep_start").collect()
    assert [r.status for r in got] == status


def test_map_times(spark):
    s = segs(spark, [(0, 30, 40, 70, 40, 900), (90, 120, 70, 100, -20, 900)]).withColumn("seg_no", F.col("ord"))
    t = spark.createDataFrame([("s", 15.0), ("s", 105.0), ("s", 50.0), ("x", 1.0)], "song_id string, t double")
    got = {(r.song_id, r.t): r.mapped for r in matching.map_times(t, s, ["song_id"]).collect()}
    assert got == {("s", 15.0): 55.0, ("s", 105.0): 85.0, ("s", 50.0): None, ("x", 1.0): None}
    assert got == {(r.song_id, r.t): r.mapped for r in matching.map_times(t, s, ["song_id"], wide=20.0).collect()}
    lines = spark.createDataFrame([("s", 28.0, 92.0), ("s", 1.0, 2.0), ("s", 40.0, 95.0)], "song_id string, start double, end double")
    assert {r.start: r.spans for r in matching.spans_cut(lines, s, ["song_id"]).collect()} == {28.0: True, 1.0: False, 40.0: False}


NAMES = ["ref_start", "ref_end", "ep_start", "ep_end", "offset", "support"]


def keep(rows):
    return [astuple(s) for s in matching.keep_consistent([matching.Segment(**dict(zip(NAMES, r, strict=True))) for r in rows])]


def test_keep_consistent():
    a, b = (0.976, 60.848, 1371.744, 1431.616, 1370.768, 4976), (145.024, 185.536, 1415.952, 1456.464, 1270.928, 4352)
    got = keep([a, b])
    assert got[0][:4] == (0.976, 45.184, 1371.744, 1415.952) and got[1] == b
    assert [g[:4] for g in keep([(0, 60, 100, 160, 100, 800), (150, 190, 145, 185, -5, 1200)])] == [(0, 45, 100, 145), (150, 190, 145, 185)]
    assert len(keep([(0, 60, 100, 160, 100, 1000), (40, 90, 145, 195, 105, 900)])) == 1
    assert len(keep([(0, 80, 100, 180, 100, 3000), (150, 160, 175, 182, 25, 100)])) == 1
    first = [(0, 60, 0, 60, 0, 1000), (130, 170, 60, 100, -70, 950)]
    assert keep([*first, (100, 145, 45, 90, -55, 900)]) == first


def test_best_chain(spark):
    rows = [(0, 60, 0, 60, 0, 8000), (40, 66, 62, 88, 22, 500), (200, 216, 62, 78, -138, 400)]
    got = matching.best_chain(segs(spark, rows), ["song_id"]).orderBy("seg_no").collect()
    assert [r.support for r in got] == [8000, 400]


def test_locate_end_to_end(spark):
    rng = random.Random(4)
    song = sorted({(rng.randrange(400), t) for t in range(0, 3000, 3)}, key=lambda p: p[1])
    points = lambda rows: spark.createDataFrame([("s", f, t) for f, t in rows], "song_id string, f int, t int")
    video = [(f, t + 500) for f, t in song if t < 1500] + [(f, t - 200) for f, t in song if t >= 2300]
    got = matching.locate(points(song), points(video), ["song_id"]).collect()
    assert [round(r.offset / timeline.FRAME) for r in got] == [500, -200] or [round(r.offset / timeline.FRAME) for r in got] == [500]


UNITS = "line_no int, unit_no int, start double"


@pytest.mark.parametrize("starts, end", [([0.0, 0.2, 0.4], 0.9), ([0.0, 0.05], 0.4)])
def test_tails(spark, starts, end):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(starts)], UNITS)
    df = df.withColumn("end", F.when(F.col("start") == starts[-1], 8.0).otherwise(F.lead("start").over(timeline.Window.partitionBy("line_no").orderBy("unit_no"))))
    got = timeline.trim_line_tails(df, ["line_no"], ["unit_no"]).orderBy("unit_no").collect()
    assert got[-1].end == pytest.approx(end) and got[-1].trimmed


def test_tail_of_one_unit(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 4.0)], UNITS + ", end double")
    r = timeline.trim_line_tails(df, ["line_no"], ["unit_no"]).first()
    assert (r.start, r.end, r.trimmed) == (1.0, 4.0, False)


def test_tiling_fills_every_line(spark):
    rng = random.Random(1)
    rows = []
    for line in range(40):
        a, width, n = rng.random() * 50, rng.choice([0.0, 0.03, 0.3, 2.0]), rng.randrange(1, 9)
        rows += [(line, i, "x", a + rng.uniform(-0.1, width + 0.1), a, a + width) for i in range(n)]
    df = spark.createDataFrame(rows, "line_no int, unit_no int, unit string, start double, line_start double, line_end double")
    tiled = timeline.tile(timeline.space_starts(df, ["line_no"], ["unit_no"]), ["line_no"], ["unit_no"])
    lines = timeline.karaoke_text(tiled, ["line_no"], ["unit_no"]).withColumn("k", text.karaoke_values(F.col("text")))
    total = {r.line_no: round((r.line_end - r.line_start) * 100) for r in df.collect()}
    for r in lines.collect():
        assert sum(r.k) == total[r.line_no] and min(r.k) >= 0


def test_clock(spark):
    df = spark.createDataFrame([(59.999,), (-1.0,), (3661.5,)], "t double").select(scalars.clock(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["0:01:00.00", "0:00:00.00", "1:01:01.50"]
    t = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7",), ("x",), ("1:2:3:4",)], "t string").select(scalars.parse_time(F.col("t")).alias("a"), scalars.parse_clock(F.col("t")).alias("b"))
    assert [(r.a, r.b) for r in t.collect()] == [(3723.5, 3723.5), (123.0, None), (7.0, None), (None, None), (None, None)]


def test_snap(spark):
    env = spark.createDataFrame([("s", i, 1.0 if i >= 50 else 0.1) for i in range(200)], "song_id string, hop int, rms double")
    units = spark.createDataFrame([("s", 0.47), ("s", 1.5), ("s", None)], "song_id string, start double")
    got = {r.start: r.snapped for r in timeline.snap_to_onsets(units, env, ["song_id"]).collect()}
    assert got == {0.5: True, 1.5: False, None: False}


@pytest.mark.parametrize(
    "word, units, cells",
    [("おもって", "お も っ て", ["o", "mo", "t", "te"]), ("まっちゃ", "ま っ ちゃ", ["ma", "t", "cha"]), ("がっしゅく", "が っ しゅ く", ["ga", "s", "shu", "ku"]), ("あっ", "あ っ", ["a", ""]), ("きょー", "きょー", ["kyoo"])],
)
def test_moras(word, units, cells):
    assert kana.split_moras(word) == units.split()
    assert kana.romanise_line(units.split()) == cells


def test_words_and_spaces():
    units, owner = kana.split_words(["おもって", "ほど"])
    assert "".join(kana.romanise_spaced(units, owner)) == "omotte hodo"
    assert kana.split_moras("everyday な…") == ["everyday", "な…"]


def test_to_kana():
    for romaji, want in (("omotte", "おもって"), ("matcha", "まっちゃ"), ("kan'i", "かんい"), ("kani", "かに"), ("tsudzukete", "つづけて"), ("shinjuku", "しんじゅく")):
        assert kana.to_kana(romaji) == want


@pytest.mark.parametrize("seed", range(4))
def test_cells_join_to_the_line(seed):
    rng = random.Random(seed)
    for _ in range(500):
        line = "".join(rng.choice("aiueokstnhmyrw'g .,!-…\t　かっーゃ漢1Qé") for _ in range(rng.randrange(0, 30)))
        assert "".join(kana.romaji_tokens(line)) == line
        units, owner, cells = kana.sourced_line(line, kana.has_residue)
        assert len(units) == len(owner) == len(cells)
        if units:
            assert "".join(cells) == line


def test_lrc(spark):
    body = "[00:01.00]a\n[00:10.00][01:20.00]b\n[ar:x]\n[00:01:50]c\nplain"
    r = spark.createDataFrame([(body,)], "b string").select(text.parse_lrc(F.col("b")).alias("t"), text.lrc_lines(F.col("b")).alias("l")).first()
    assert [(x.t, x.text) for x in r.t] == [(1.0, "a"), (1.5, "c"), (10.0, "b"), (80.0, "b")]
    assert r.l == ["a", "b", "[ar:x]", "c", "plain"]


def test_clean_lines(spark):
    df = spark.createDataFrame([("\n\na &amp; b  \r\n\rc\n\n",), ("",), (None,)], "t string").select(text.clean_lines(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a & b", "", "c"], [], []]


def test_theme_text(spark):
    rows = [('"TRUTH" by Rin (eps 1-13)', ("TRUTH", "Rin", "eps 1-13")), ("Song by Someone", ("Song", "Someone", "")), ("Only", ("Only", "", "")), (None, ("", "", ""))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.theme_text(F.col("t")).alias("x"))
    assert [tuple(r.x) for r in df.orderBy("i").collect()] == [w for _, w in rows]
    kinds = spark.createDataFrame([("Opening Theme",), ("OP2",), ("Ending Theme",), ("ED3",)], "t string").select(text.split_kind(F.col("t")).alias("k"))
    assert [tuple(r.k) for r in kinds.collect()] == [("OP", ""), ("OP", "2"), ("ED", ""), ("ED", "3")]


def test_lyric_page(spark):
    page = """<script type="application/ld+json">{"@type":"WebPage","name":"no"}</script><script type="application/ld+json">{"@type":"MusicComposition","name":"きょくめい","byArtist":{"name":"かしゅ"}}</script>
    <div class=x itemprop="text">いちぎょうめ<br>にぎょうめ<br /><br/>さんぎょうめ</div>"""
    df = spark.createDataFrame([(1, page), (2, '<h2>きょくめい</h2><div id="kashi_area">いち</div>'), (3, "none")], "i int, html string")
    got = {r.i: r for r in readers.lyric_pages(df).collect()}
    assert got[1].title == "きょくめい" and got[1].artist == "かしゅ" and got[1].lines == ["いちぎょうめ", "にぎょうめ", "", "さんぎょうめ"]
    assert got[2].title == "きょくめい" and got[2].lines == ["いち"] and got[3].status == "no body"


def test_subtitles_round_trip(spark):
    ev = spark.createDataFrame([("f", 0, 1.0, 2.5, "a, b"), ("f", 1, 59.999, 61.0, "{\\k5}x")], "path string, event_no int, start double, end double, text string")
    ev = ev.withColumns({"style": F.lit("S"), "comment": F.lit(False), "layer": F.lit(0), "name": F.lit(""), "margin_l": F.lit("0"), "margin_r": F.lit("0"), "margin_v": F.lit("0"), "effect": F.lit("")})
    body = writers.subtitle_text(ev, ["path"], "[Script Info]\n; stamp: 7")
    got = readers.subtitle_events(body).orderBy("event_no").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(1.0, 2.5, "a, b"), (60.0, 61.0, "{\\k5}x")]
    assert readers.header_stamp(body, "stamp").first().stamp == "7"
    odd = spark.createDataFrame([("f", "[Events]\nFormat: Start, End, Text, Style, Layer, Effect\nDialogue: 0:00:01.00,0:00:02.00,hi,Top,3,\nDialogue: bad,0:00:02.00,x,Top,3,\nComment: 0:00:01.00,0:00:02.00,no,Top,3,\n")], "path string, body string")
    assert [(r.text, r.style, r.layer) for r in readers.subtitle_events(odd).collect()] == [("hi", "Top", 3)]


def test_tables(spark):
    f = spark.createDataFrame([("p", "# c\n1\tf\t未だ\tまだ\n2\t\t未だ\tいまだ\n3\tx\n")], "path string, body string")
    assert [r.reading for r in readers.reading_overrides(f).collect()] == ["いまだ"]
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "surface string, reading string")
    ph = spark.createDataFrame([("a\tDELETE\nc\nb\tz\n",)], "body string")
    assert {(r.surface, r.reading) for r in readers.phrases(base, ph).collect()} == {("b", "z"), ("c", None)}
    out = spark.createDataFrame([('{"id":"1","title":"t","duration":200}\nWARNING\n{bad\n{"id":""}\n{"id":"2"}',)], "output string")
    assert [r.ident for r in readers.search_lines(out).orderBy("ord").collect()] == ["1", "2"]


def test_dedupe_and_rank(spark):
    t = spark.createDataFrame([(0, "OP", "TRUTH", "", "a"), (1, "OP", "truth!", "Rin", "b"), (2, "ED", "x", "", "c")], "ord int, kind string, title string, artist string, source string")
    got = resolve.dedupe_first(t).orderBy("ord").collect()
    assert [(r.title, r.artist, r.source) for r in got] == [("TRUTH", "Rin", "a+b"), ("x", "", "c")]
    assert {r.ord for r in resolve.filter_kind(t, "ED").collect()} == {2} and resolve.filter_kind(t, "XX").count() == 3


def test_verify_hits(spark):
    hits = spark.createDataFrame([("a", 0, "t", "Madonna", 250.4, "x", False), ("b", 0, "t", "OUTER-TRIBE", 198.0, "x", False), ("c", 0, "t", "n", 250.4, "x", False), ("d", 0, "t", "n", 196.0, "x", False)], "song_id string, ord int, trackName string, artistName string, duration double, syncedLyrics string, instrumental boolean")
    want = spark.createDataFrame([("a", "OUTER-TRIBE", 242.0), ("b", "outer tribe", 194.3), ("c", "", 242.0), ("d", None, 194.3)], "song_id string, artist string, duration double")
    assert {r.song_id for r in resolve.verify_hits(hits, want).collect()} == {"b", "d"}


def test_match_timings(spark):
    lines = spark.createDataFrame([("s", 0, "hook"), ("s", 1, "verse"), ("s", 2, "hook"), ("t", 0, "Hello, world!"), ("t", 1, "none")], "song_id string, line_no int, text string")
    times = spark.createDataFrame([("s", 1.0, "hook"), ("s", 5.0, "verse"), ("s", 9.0, "hook"), ("t", 2.0, "hello world")], "song_id string, t double, text string")
    got = {(r.song_id, r.line_no): r.t for r in resolve.match_timings(lines, times, ["song_id"]).collect()}
    assert got == {("s", 0): 1.0, ("s", 1): 5.0, ("s", 2): 9.0, ("t", 0): 2.0}


def test_overrides(spark):
    table = spark.createDataFrame([(3, "", "未だ", "いまだ"), (9, "", "未だ", "まだ"), (7, "", "彼", "かれ")], "line int, flag string, surface string, reading string")
    base = spark.createDataFrame([(3, "未だ", "まだ"), (9, "未だ", "まだ"), (7, "彼", "あれ")], "line int, surface string, reading string")
    by_line, by_surface = resolve.manual_overrides(table, base)
    got = {r.line: r.override for r in resolve.apply_overrides(table, by_line, by_surface).collect()}
    assert got == {3: "いまだ", 9: None, 7: "かれ"}
    assert [r.surface for r in by_surface.collect()] == ["彼"]


VOCAB = {"か": 1, "れ": 2, "い": 3, "ま": 4, "だ": 5}


def heard(*tokens):
    rows = [r for t in tokens for r in (t, 0)]
    x = np.full((len(rows), 6), -8.0)
    x[range(len(rows)), rows] = 8
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def brute_force(lp, targets):
    total = -np.inf
    for path in itertools.product(range(lp.shape[1]), repeat=len(lp)):
        out = [k for i, k in enumerate(path) if k and (i == 0 or path[i - 1] != k)]
        if out == targets:
            total = np.logaddexp(total, sum(lp[i, k] for i, k in enumerate(path)))
    return total


@pytest.mark.parametrize("targets", [[1], [1, 2], [1, 1], [2, 1, 2], [1, 1, 1]])
def test_likelihood(targets):
    rng = np.random.default_rng(len(targets))
    x = rng.standard_normal((5, 3))
    lp = x - np.log(np.exp(x).sum(1, keepdims=True))
    assert acoustic.log_likelihood(lp, targets) == pytest.approx(brute_force(lp, targets))


def test_forced_path():
    got = acoustic.forced_path(heard(1, 2, 3), [1, 2, 3])
    assert [g[0] for g in got] == [0, 2, 4] and acoustic.forced_path(heard(1), [1, 1, 1]) is None


def test_choose_readings():
    words = [("彼", ["かれ"]), ("未だ", ["まだ", "いまだ"])]
    got = acoustic.choose_readings(heard(1, 2, 3, 4, 5), words, VOCAB)
    assert [(d["chosen"], d["confidence"]) for d in got] == [("いまだ", "high")]
    assert sum(p for _, p in got[0]["ranked"]) == pytest.approx(1)
    with pytest.raises(ValueError):
        acoustic.choose_readings(heard(1), [("x", ["か", "れ"])] * 9, VOCAB)
    with pytest.raises(ValueError):
        acoustic.choose_readings(heard(1), [("x", ["龘", "龍"])], VOCAB)


def test_align_and_select(spark):
    frames = spark.createDataFrame([("s", i, row.tolist()) for i, row in enumerate(heard(1, 2, 3, 4, 5))], "song_id string, frame int, lp array<double>")
    lines = spark.createDataFrame([("s", 1, ["か", "れ", "い", "まだ"])], "song_id string, line_no int, units array<string>")
    got = acoustic.align_lines(frames, lines, VOCAB, ["song_id"]).orderBy("unit_no").collect()
    assert [r.start for r in got] == [0.0, 0.04, 0.08, 0.12]
    song = acoustic.align_song(frames, lines, VOCAB, ["song_id"]).orderBy("unit_no").collect()
    assert [r.text for r in song] == ["か", "れ", "い", "まだ"]
    words = spark.createDataFrame([("s", 1, [("彼", ["かれ"]), ("未だ", ["まだ", "いまだ"])])], "song_id string, line_no int, words array<struct<surface:string,readings:array<string>>>")
    assert [r.chosen for r in acoustic.select_readings(frames, words, VOCAB, ["song_id"]).collect()] == ["いまだ"]
    vocab = spark.createDataFrame([(k, v) for k, v in VOCAB.items()], "kana string, token_id int")
    assert acoustic.decoded_text(frames, vocab, ["song_id"]).first().text == "かれいまだ"


def test_peaks(spark):
    rng = np.random.default_rng(0)
    s = rng.random((40, 30))
    df = spark.createDataFrame([("s", f, t, float(s[f, t])) for f in range(40) for t in range(30)], "song_id string, f int, t int, value double")
    want = {(f, t) for f in range(40) for t in range(30) if s[f, t] == s[max(0, f - 10) : f + 11, max(0, t - 4) : t + 5].max() and s[f, t] > np.percentile(s, 82)}
    assert {(r.f, r.t) for r in matching.peaks(df, ["song_id"]).collect()} == want


def test_schemas_parse(spark):
    from pyspark.sql.types import StructType

    from strophe import schemas

    found = {k: StructType.fromDDL(v) for k, v in vars(schemas).items() if k.isupper()}
    assert len(found) > 20 and all(len(s) > 1 for s in found.values())


def test_theme_payloads(spark):
    js = '{"anime":[{"name":"S","year":2020,"animethemes":[{"type":"OP","sequence":"2","song":{"title":"T","artists":[{"name":"A"},{"name":"B"}]}},{"type":"ED","song":{"title":""}}]}]}'
    got = readers.themes_from_catalogue(spark.createDataFrame([(js,), (None,), ("{}",)], "payload string")).collect()
    assert [(r.kind, r.sequence, r.title, r.artist, r.series, r.year) for r in got] == [("OP", "2", "T", "A, B", "S", 2020)]
    xml = '<anime id="1" name="A &amp; B"><vintage>2001-04</vintage><info type="Opening Theme">#2: "Song" by X (eps 1-3)</info><info type="Ending Theme">"End" by Y</info></anime>'
    got = readers.themes_from_xml(spark.createDataFrame([(xml,), ("",)], "payload string")).orderBy("ord").collect()
    assert [(r.kind, r.sequence, r.title, r.artist) for r in got] == [("OP", "2", "Song", "X (eps 1-3)"), ("ED", "", "End", "Y")] and got[0].series == "A & B" and got[0].year == 2001
    lists = '{"openings":["#1: \\"One\\" by P","\\"Two\\" by Q"],"endings":[]}'
    got = readers.themes_from_lists(spark.createDataFrame([("S", 1, lists), ("S", 1, None)], "series string, year int, payload string")).orderBy("ord").collect()
    assert [(r.kind, r.sequence, r.title, r.artist) for r in got] == [("OP", "1", "One", "P"), ("OP", "2", "Two", "Q")]


def test_states_and_names(spark):
    df = spark.createDataFrame([('{"schema_version":2,"title":"t"}',), ('{"schema_version":1}',), ("nonsense",)], "payload string")
    assert [r.status for r in readers.state(df, "title string", 2).collect()] == ["ok", "bad version", "unreadable"]
    n = spark.createDataFrame([("/x/OP01.kara.jp.ass",), ("OP.01.lines.ass",), (".ass",)], "n string").select(text.project_name(F.col("n")).alias("n"))
    assert [r.n for r in n.collect()] == ["OP01", "OP.01", ".ass"]
    u = spark.createDataFrame([("https://h.net/tracks/12/",), ("https://h.net/x",), ("https://o.net/tracks/1",), ("::",)], "u string").select(text.track_id(F.col("u"), ("h.net",)).alias("t"))
    assert [r.t for r in u.collect()] == ["12", None, None, None]


def test_rounding_at_halves(spark):
    """Halves go to the even digit: 0.125 s is .12, 0.375 s is .38; 0.0625 s is 0.062, 0.1875 s is 0.188."""
    got = spark.createDataFrame([(0.125,), (0.375,), (0.0625,), (0.1875,), (59.996,)], "t double").select(scalars.clock(F.col("t")).alias("c"), scalars.millis(F.col("t")).alias("m")).collect()
    assert [r.c for r in got] == ["0:00:00.12", "0:00:00.38", "0:00:00.06", "0:00:00.19", "0:01:00.00"]
    assert [r.m for r in got] == [0.125, 0.375, 0.062, 0.188, 59.996]


def test_long_marks():
    vocab = {"か": 1, "あ": 2, "る": 3}
    assert acoustic.tokenise(["かー", "ー", "る"], vocab) == ([1, 2, 3], [(0, 2), (2, 2), (2, 3)], [])
    assert acoustic.tokenise(["ーか"], vocab)[0] == [2, 1]  # the vowel of its unit, wherever it stands
    assert acoustic.tokenise(["るー", "x"], vocab) == ([3], [(0, 1), (1, 1)], ["x"])  # no token for the vowel: silent
    assert acoustic.tokenise(["かー"], vocab | {"ー": 9})[0] == [1, 9]


def test_overrides_and_decisions(spark):
    table = spark.createDataFrame([(1, "", "a", "あ"), (1, "", "a", "い"), (2, "", "b", "x1"), (3, "", "c", ""), (4, "", "d", "え")], "line int, flag string, surface string, reading string").coalesce(1)
    base = spark.createDataFrame([(4, "d", "え")], "line int, surface string, reading string")
    by_line, by_surface = resolve.manual_overrides(table, base)
    assert {(r.line, r.reading) for r in by_line.collect()} == {(1, "い"), (2, "x1")} and [r.surface for r in by_surface.collect()] == ["b"]
    rows = spark.createDataFrame([(1, "a"), (9, "b"), (9, "c")], "line int, surface string")
    assert {(r.surface, r.override) for r in resolve.apply_overrides(rows, by_line, by_surface).collect()} == {("a", "い"), ("b", "x1"), ("c", None)}
    assert [(r.line, r.reading) for r in resolve.invalid_overrides(table, base).collect()] == [(2, "x1")]
    d = spark.createDataFrame([("k", None), ("k", "s"), ("m", "s"), ("m", "t")], "key string, stage string")
    kept = resolve.prune_stage(d, spark.createDataFrame([("k",)], "key string"), "s").collect()
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in d.collect() if (r.key, r.stage) != ("m", "s")]))


def test_providers(spark):
    kinds = "kind string, sequence string, title string, artist string, series string, source string, ord bigint"
    one = spark.createDataFrame([("OP", "1", "Song!", "", "My Show", "a", 0)], kinds)
    two = spark.createDataFrame([("OP", "1", "song", "Band", "My Show", "b", 0), ("ED", "1", "Other", "", "My Show", "b", 1)], kinds)
    found, status = resolve.search_themes({"a": lambda: one, "down": lambda: 1 / 0, "b": lambda: two}, "my show", "OP")
    assert [(r.title, r.artist, r.source, r.rank) for r in found.collect()] == [("Song!", "Band", "a+b", 1)] and status == {"a": "ok", "down": "ZeroDivisionError", "b": "ok"}
    assert resolve.search_themes({"down": lambda: 1 / 0}, "q")[0] is None


def test_identities(spark):
    df = spark.createDataFrame([([0.5, -1.0], '{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ([0.5, -1.0], "{", "{}"), (None, None, "{}")], "x array<double>, s string, e string")
    got = df.select(resolve.array_identity("x").alias("i"), resolve.metadata_matches("s", "e").alias("m")).collect()
    want = hashlib.sha256(b"(2,)" + struct.pack("<2f", 0.5, -1.0)).hexdigest()
    assert [r.i for r in got] == [want, want, hashlib.sha256(b"(0,)").hexdigest()] and [r.m for r in got] == [True, False, False]
    row = spark.range(1).select(resolve.derived_identity(F.lit("split"), F.struct(F.lit(2).alias("n")), F.lit("/A/b.wav"), F.lit(7), F.lit(8)).alias("d")).first()
    assert json.loads(row.d) == {"schema": 1, "operation": "split", "source": {"path": "/a/b.wav", "size": 7, "mtime_ns": 8}, "options": {"n": 2}}
    assert spark.range(1).select(kana.display_reading(F.lit("おもって ほど")).alias("d")).first().d == "おもって ほど [omotte hodo]"
