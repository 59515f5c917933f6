"""Encodings found from bytes alone."""

import gzip

import pytest

from sparkloom.functions import encoding as E

TEXTS = {
    "zh": "今天天气很好，我们一起去公园散步吧。中国的历史非常悠久，文化也很丰富。", "tw": "今天天氣很好，我們一起去公園散步吧。台灣的夜市非常有名，小吃也很豐富。",
    "ja": "きょうは天気がいいので、みんなで公園へ散歩に行きましょう。カタカナもあります。", "ko": "오늘은 날씨가 좋아서 우리 모두 공원에 산책하러 갑니다. 한국의 음식은 맛있습니다.",
    "ru": "Сегодня хорошая погода, и мы все идём гулять в парк. Русский язык очень богат.", "fr": "Aujourd'hui il fait très beau, nous allons nous promener à la forêt où l'été dure.", "de": "Heute ist schönes Wetter, wir gehen über die Straße in den Wald.", "es": "El niño comió una piña en la mañana, ¿qué pasó después?",
}
CASES = [("zh", "gbk"), ("zh", "gb18030"), ("tw", "big5"), ("ja", "shift_jis"), ("ja", "euc_jp"), ("ko", "euc_kr"), ("ru", "windows-1251"), ("fr", "iso-8859-1"), ("de", "windows-1252"), ("es", "iso-8859-1")] + [(t, e) for t in TEXTS for e in ("utf-8", "utf-16", "utf-8-sig")] + [(t, "utf-16-be") for t in ("fr", "de", "es")]


@pytest.mark.parametrize(("text", "name"), CASES)
def test_round_trip(text, name):
    data = TEXTS[text].encode(name)
    assert E.convert(data)[0] == TEXTS[text]
    assert E.convert(gzip.compress(data)) == (*E.convert(data)[:2], True)


def test_odd_bytes():
    assert E.convert(b"") == ("", "utf-8", False) and E.convert(b"plain") == ("plain", "utf-8", False)
    assert E.convert(b"\x1f\x8bnot gzip at all")[2] is False
    half = gzip.compress(("some words é\n" * 50_000).encode(), 0)[:200_000]
    text, name, zipped = E.convert(half)
    assert zipped and name == "utf-8" and text.startswith("some words é\n") and len(text) > 100_000
    assert E.convert(b"\xef\xbb\xbfa\xffb")[0] == "ab"
    assert E.convert("Œuvre – “été”".encode("windows-1252"))[0] == "Œuvre – “été”"


def test_columns_and_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i, (text, name) in enumerate(CASES[:10]):
        (tmp_path / "f" / f"{i:02d}.txt").write_bytes(TEXTS[text].encode(name))
    got = {r.path[-6:-4]: r for r in E.documents(spark, f"{tmp_path}/f").collect()}
    assert [got[f"{i:02d}"].text for i in range(10)] == [TEXTS[t] for t, _ in CASES[:10]]
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "id int, b binary").select("id", E.to_text("b").alias("x")).select("id", "x.*").collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, None, None, None), (2, "", "utf-8", False)]


@pytest.mark.parametrize("text", ["Of a thing, n èê, and more of it.", "SCHÄIE! DER ÄSC", "Äau Äau Äau", "Le Le éèau éèau un éen", "a text of letters without accents, but for öö, in it", "ÉÈ and then others"])
def test_few_accents_stay_western(text):
    for name in ("iso-8859-1", "windows-1252"):
        assert E.convert(text.encode(name))[0] == text
    # long words of another alphabet stay what they are, among Latin ones too
    for other, name in (("Он сказал: print(x) и привет", "windows-1251"), ("x = 1  # значение по умолчанию", "windows-1251"), ("今天OK吗，我们用Python写程序", "gbk")):
        assert E.convert(other.encode(name))[0] == other
