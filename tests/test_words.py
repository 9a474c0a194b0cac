"""Words, signals and the two compositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import signal
from strophe.operators import words
from strophe.plans import pipelines


def test_attach_and_join(spark):
    rows = [(1, 0, 0, "行き", "いき", "動詞", ""), (1, 0, 1, "ます", "ます", "助動詞", ""), (1, 0, 2, "だ", "だ", "助動詞", "準体助詞"), (1, 1, 0, "門", "もん", "名詞", ""), (1, 1, 1, "前払い", "まえばらい", "名詞", ""), (1, 1, 2, "誰", "だれ", "代名詞", ""), (1, 1, 3, "か", "か", "助詞", "")]
    df = spark.createDataFrame(rows, "line_no int, chunk int, tok_no int, surface string, kana string, pos1 string, pos2 string")
    got = words.words_of_tokens(df, ["line_no"], {"門前払い": "もんぜんばらい"}).orderBy("word_no").collect()
    assert [(r.surface, r.kana) for r in got] == [("行きますだ", "いきますだ"), ("門前払い", "もんぜんばらい"), ("誰か", "だれか")]


def test_resolved(spark):
    df = spark.createDataFrame([("omotte hodo", None), ("x", "いま だ"), (None, None)], "surface string, override string")
    got = [r.resolved for r in words.resolved_words(df, source="romaji").collect()]
    assert got[:2] == [["おもって", "ほど"], ["いま", "だ"]]
    units = words.units_and_cells(spark.createDataFrame([(1, ["おもって", "ほど"])], "line_no int, resolved array<string>")).orderBy("unit_no").collect()
    assert "".join(r.cell for r in units) == "omotte hodo" and [r.owner for r in units] == [0, 0, 0, 0, 1, 1]


def test_foreign(spark):
    lex = spark.createDataFrame([("輝き", "かがやき")], "surface string, reading string")
    lines = spark.createDataFrame([("Kagayaki light kagayaki",), (None,), ("",)], "text string")
    assert {r.word: r.foreign for r in words.foreign_words(lines, lex).collect()} == {"kagayaki": False, "light": True}
    keys = spark.createDataFrame([("月詠み", "つきよみ"), ("OUTER-TRIBE", "")], "a string, r string").select(words.artist_keys(F.col("a"), F.col("r")).alias("k"))
    assert [r.k for r in keys.collect()] == [["月詠み", "tsukiyomi"], ["outertribe"]]


def test_signal(spark):
    t = np.arange(16000) / 16000
    low, high = np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 1000 * t)
    y = signal.highpassed(low + high)
    assert np.abs(y - high).max() < 0.05
    df = spark.createDataFrame([("s", [float(v) for v in high[:4096]]), ("e", [])], "song_id string, samples array<double>")
    got = signal.spectrogram(df, ["song_id"]).toPandas()
    assert set(got.song_id) == {"s"} and got.loc[got.value.idxmax(), "f"] == round(1000 / 16000 * 1024)


def test_compositions(spark):
    vocab = {"か": 1, "れ": 2, "い": 3, "ま": 4, "だ": 5}
    rows = [r for t in (1, 2, 3, 4, 5) for r in (t, 0, 0, 0, 0)]
    lp = np.full((len(rows), 6), -8.0)
    lp[range(len(rows)), rows] = 8
    lp -= np.log(np.exp(lp).sum(1, keepdims=True))
    frames = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(lp)], "song_id string, frame int, lp array<double>")
    lyrics = spark.createDataFrame([("s", "かれ\n\nいまだ")], "song_id string, text string")
    seg = spark.createDataFrame([("s", 0, 0.0, 10.0, 100.0)], "song_id string, seg_no int, ref_start double, ref_end double, offset double")
    got = pipelines.timed_lines(lyrics, frames, vocab, seg).orderBy("line_no").collect()
    assert [(r.line_no, r.start) for r in got] == [(1, pytest.approx(100.0, abs=0.05)), (3, pytest.approx(100.2, abs=0.05))]
    lines = spark.createDataFrame([("s", 1, 0.0, 0.5, ["かれ", "いまだ"])], "song_id string, line_no int, start double, end double, resolved array<string>")
    r = pipelines.karaoke(lines, frames, vocab).first()
    assert r.kana_text.count("\\k") == r.romaji_text.count("\\k") == 5 and r.romaji_text.endswith("da")
