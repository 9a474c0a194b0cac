"""Segmentation, conjugation and counters over a small dictionary."""

import pytest
from pyspark.sql import functions as F

from strophe.operators import lexicon as L

BASE = [
    ("夜が明ける", "よがあける", "ichidan", "v", 5), ("狂う", "くるう", "godan", "v", 5), ("消える", "きえる", "ichidan", "v", 5), ("待つ", "まつ", "godan", "v", 3), ("行く", "いく", "godan-iku", "v", 1),
    ("分かる", "わかる", "godan", "v", 1), ("知る", "しる", "godan", "v", 1), ("会う", "あう", "godan", "v", 2), ("戻る", "もどる", "godan", "v", 4), ("忘れる", "わすれる", "ichidan", "v", 4), ("高い", "たかい", "adj-i", "adj", 2),
]
PLAIN = [
    ("夜", "よる", "夜", "n", 1, 0, 0, 0, "base"), ("夜", "よ", "夜", "n", 20, 1, 0, 0, "base"), ("が", "が", "が", "prt", 1, 0, 0, 0, "base"), ("よう", "よう", "様", "n", 2, 0, 1, 0, "base"),
    ("に", "に", "に", "prt", 1, 0, 0, 0, "base"), ("ように", "ように", "様に", "exp", -1, 0, 1, 0, "base"), ("冊", "さつ", "冊", "ctr", 3, 0, 0, 0, "base"), ("時", "じ", "時", "ctr", 1, 0, 0, 0, "base"),
    ("羽", "わ", "羽", "ctr", 5, 0, 0, 0, "base"), ("年", "ねん", "年", "ctr", 1, 0, 0, 0, "base"), ("度", "たび", "度", "n", 3, 0, 0, 0, "base"), ("度", "ど", "度", "n", 4, 1, 0, 0, "base"),
]


def rows():
    out = list(PLAIN)
    for s, r, cls, pos, common in BASE:
        out += [(a, b, s, pos, common, 0, 0, int(f != "base"), f) for a, b, f in L.inflect(s, r, cls)]
    return out


@pytest.fixture(scope="module")
def seg():
    return L.Segmenter.of(rows())


@pytest.mark.parametrize("text", "狂っていた 狂ってる 消えても 行かなきゃ 分からん 知らねえ 会いたかった 戻れない 忘れられていた".split())
def test_one_word(seg, text):
    assert [w for w, _ in seg.words_of(text)] == [text]


def test_words(seg):
    assert seg.words_of("夜が明けても")[0] == ("夜が明けても", "よがあけても")
    assert [w for w, _ in seg.words_of("待ってください")] == ["待って", "ください"]
    assert [w for w, _ in seg.words_of("ように")] == ["よう", "に"]
    assert [seg.words_of(x)[0][1] for x in ("行って", "行った")] == ["いって", "いった"]
    assert seg.words_of("abc 夜 龘") == [("abc", "abc"), ("夜", "よる"), ("龘", "")]
    assert seg.readings_of("度", exhaustive=True) == ["たび", "ど"]


@pytest.mark.parametrize("text, kana", [("10冊", "じゅっさつ"), ("４時", "よじ"), ("1人", "ひとり"), ("2人", "ふたり"), ("１羽２羽３羽４羽", "いちわにわさんばよんわ"), ("4月4日", "しがつよっか"), ("2014年", "にせんじゅうよねん")])
def test_counters(seg, text, kana):
    assert "".join(k for _, k in seg.words_of(text)) == kana


@pytest.mark.parametrize("n", [0, 1, 10, 11, 300, 800, 1000, 3000, 10000, 20304, 99999999])
def test_numbers(n):
    assert L.read_numeral(L.write_number(n)) == n
    assert L.say_number(300) == "さんびゃく" and L.say_number(8800) == "はっせんはっぴゃく" and L.say_number(10**12) == "いっちょう"


def test_inflected_matches_inflect(spark):
    df = spark.createDataFrame([(s, r, s, pos, c, 0, 0, 0, "base", cls) for s, r, cls, pos, c in BASE], "surface string, reading string, base string, pos string, common int, ord int, uk int, conj int, form string, cls string")
    got = {(r.surface, r.reading, r.form) for r in L.inflected(df).collect()}
    assert got == {x for s, r, cls, _, _ in BASE for x in L.inflect(s, r, cls)}


def test_segment_lines(spark):
    lines = spark.createDataFrame([(1, "狂ってる 夜"), (2, None)], "line_no int, text string")
    got = {r.line_no: [(w.surface, w.kana) for w in r.words] for r in L.segment_lines(lines, L.spark_lexicon(spark, rows())).collect()}
    assert got == {1: [("狂ってる", "くるってる"), ("夜", "よる")], 2: []}
    found = L.probe(lines, L.spark_lexicon(spark, PLAIN), 5).collect()
    assert {(r.start, r.end, r.reading) for r in found} == {(5, 6, "よる"), (5, 6, "よ")}


def test_two_dictionaries_in_turn(spark):
    lines = spark.createDataFrame([(1, "夜")], "line_no int, text string")
    for i in range(20):
        kana = "よるよ"[i % 2 : i % 2 + 2]
        lex = L.spark_lexicon(spark, [("夜", kana, "夜", "n", 1, 0, 0, 0, "base")])
        assert [w.kana for r in L.segment_lines(lines, lex).collect() for w in r.words] == [kana]


def test_joined_dictionary_equals_a_held_one(spark):
    texts = ["狂ってる 夜", None, "", "夜が明けても", "待ってください 行かなきゃ", "10冊の夜 abc", "消えちゃう 分からん 知らねえ", "夜", "夜", "高すぎる ように 忘れられていた", "４時 １羽 待たなくちゃ 行けりゃ"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no int, text string").withColumn("_line", F.lit("clash"))
    lex = L.spark_lexicon(spark, rows())
    show = lambda df: sorted((r.line_no, [(w.surface, w.kana, tuple(w.readings)) for w in r.words]) for r in df.collect())
    assert show(L.segment_lines(lines, lex)) == show(L.segment_lines(lines, lex, broadcast_rows=1))


def test_candidates(seg):
    got = dict(seg.candidates_of("夜が"))
    assert got["夜"][0] == "よる" and got["が"] == ["が"]
    wo = L.Segmenter.of([("を", "を", "を", "prt", 1, 0, 0, 0, "base"), ("を", "うぉ", "を", "prt", 1, 1, 0, 0, "base")])
    assert wo.candidates_of("を") == [("を", ["お"])]
