"""Texts of unknown encoding: gzip by its magic number, byte order marks, valid UTF-8, zeros of UTF-16 and UTF-32,
then the encoding whose decoded characters are the likeliest of those that the bytes can be."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks at the beginning, the longer first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Encodings of which bytes give no other sign, in the order in which equal scores count.
CANDIDATES = ("big5", "gbk", "gb18030", "shift_jis", "euc_jp", "euc_kr", "iso-8859-1", "windows-1252", "windows-1251")


def _lead(c: str, encoding: str) -> int:
    try:
        b = c.encode(encoding)
    except UnicodeEncodeError:
        return 0
    return b[0] if len(b) == 2 else 0


def _chinese(c: str) -> float:
    """Level 1 characters of the national standard and its punctuation are common, its letters less so."""
    lead = _lead(c, "gb2312")
    return 1.0 if 0xB0 <= lead <= 0xD7 or lead in (0xA1, 0xA3) else 0.8 if lead == 0xA8 else 0.3


def _taiwanese(c: str) -> float:
    return 1.0 if 0xA1 <= _lead(c, "big5") <= 0xC6 else 0.3


def _japanese(c: str) -> float:
    if "぀" <= c <= "ヿ":
        return 1.3  # rare by chance
    if "　" <= c <= "。":
        return 1.0
    return 0.2 if "｡" <= c <= "ﾟ" else 0.7 if 0xB0 <= _lead(c, "euc_jp") <= 0xCF else 0.3


def _korean(c: str) -> float:
    return 1.0 if "가" <= c <= "힣" else 0.3


_LIKELY = {"big5": _taiwanese, "gbk": _chinese, "gb18030": _chinese, "shift_jis": _japanese, "euc_jp": _japanese, "euc_kr": _korean}
_LATIN, _MIXED = re.compile("[A-Za-z]+"), re.compile("(?<=[A-Za-z])[Ѐ-ӿ]+|[Ѐ-ӿ]+(?=[A-Za-z])")
_CYRILLIC = re.compile("[Ѐ-ӿ]+")
#: A character of two bytes that stands alone: beside a letter it is seldom one.
_ALONE, _BESIDE = re.compile("(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])"), re.compile("(?<=[A-Za-z])[^\x00-\x7f](?![^\x00-\x7f])|(?<![^\x00-\x7f])[^\x00-\x7f](?=[A-Za-z])")
_WESTERN = re.compile("(?<=[A-Za-z])[À-ÖØ-öø-ÿŒœŠšŽžŸ]+|[À-ÖØ-öø-ÿŒœŠšŽžŸ]+(?=[A-Za-z])")


def score(data: bytes, encoding: str) -> float:
    """How likely the characters beyond ASCII are (about 1), less twice the share of bytes that are none."""
    text = data.decode(encoding, "ignore")
    high = sum(1 for b in data if b > 127)
    lost = high - len(text.encode(encoding, "ignore").translate(None, bytes(range(128))))
    beyond = Counter(c for c in text if c > "\x7f")
    n = sum(beyond.values())
    if not n:
        return -2.0
    if encoding in _LIKELY:
        value = sum(_LIKELY[encoding](c) * k for c, k in beyond.items())
        if encoding == "euc_kr" and value > 0.9 * n:
            value += 0.15 * n  # hardly any text of another language is syllables throughout
        if encoding in ("shift_jis", "euc_jp") and not any("぀" <= c <= "ヿ" for c in beyond):
            value /= 2
        # letters with accents, in ones and twos among letters without, are read as characters that stand alone
        beside = set(m.start() for m in _BESIDE.finditer(text))
        for m in _ALONE.finditer(text):
            value -= (0.8 if m.start() in beside else 0.55) * _LIKELY[encoding](m[0])
    elif encoding == "windows-1251":
        runs = _CYRILLIC.findall(text)
        joined = sum(map(len, _MIXED.findall(text)))
        words = [len(r) for r in runs if len(r) > 1 and (r[1:].islower() or r.isupper())]
        most = sum(k for k in words if k > 3)
        # without longer words, or with hardly any among other letters, those of two and three letters are accents of another language
        long_, short = (1.0 if 50 * most >= sum(map(len, _LATIN.findall(text))) else 0.2), (1.0 if 2 * most >= sum(words) else 0.2)
        value = sum(long_ * k if k > 3 else min(long_, short) * k for k in words) + 0.2 * sum(1 for r in runs if len(r) == 1)
        value = min(value, n - 0.8 * joined)
    else:
        beside = sum(map(len, _WESTERN.findall(text)))
        rest = sum(k for c, k in beyond.items() if unicodedata.category(c)[0] in "PS")
        letters = n - rest - sum(k for c, k in beyond.items() if unicodedata.category(c)[0] == "C")
        # letters in words of their own, less likely unless the text's other letters are without accents
        alone = 0.7 if sum(map(len, _LATIN.findall(text))) > 2 * letters else 0.5
        value = beside + 0.6 * rest + alone * max(0, letters - beside)
    return value / n - 2 * max(0, lost) / max(1, high)


def detect(data: bytes) -> str:
    """The encoding of bytes that are not compressed; utf-8 where nothing speaks for another."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    try:
        data.decode()
        if b"\0" not in data:
            return "utf-8"
    except UnicodeDecodeError:
        pass
    for size, name in ((4, "utf-32"), (2, "utf-16")):
        if len(data) >= size and len(data) % size == 0:
            zeros = [data[i::size].count(0) * size / len(data) for i in range(size)]
            for order, full, empty in (("le", zeros[0], zeros[1:]), ("be", zeros[-1], zeros[:-1])):
                if full < 0.2 and min(empty) > 0.4:
                    return f"{name}-{order}"
    if not any(b > 127 for b in data):
        return "utf-8"
    found = {c: score(data, c) for c in CANDIDATES}
    best = max(found.values())
    if best < -0.5:
        return "utf-8"
    name = next(c for c in CANDIDATES if found[c] == best)
    if name == "iso-8859-1" and any(0x80 <= b <= 0x9F for b in data):
        return "windows-1252"
    return name


def unzipped(data: bytes) -> tuple[bytes, bool]:
    """Bytes without gzip (as much as can be read of a broken stream), and whether they had it."""
    out, left = [], data
    while left[:2] == b"\x1f\x8b":
        stream, rest = zlib.decompressobj(31), b""
        for at in range(0, len(left), 1 << 16):
            try:
                out.append(stream.decompress(left[at : at + (1 << 16)]))
            except zlib.error:
                break
            if stream.eof:
                rest = stream.unused_data + left[at + (1 << 16) :]
                break
        left = rest
    whole = data[:3] == b"\x1f\x8b\x08" and bool(out)
    return (b"".join(out), True) if whole else (data, False)


def convert(data: bytes) -> tuple[str, str, bool]:
    """(text, encoding, whether it was compressed); bytes that are no character are dropped, and so is a byte order mark."""
    data, zipped = unzipped(data)
    name = detect(data)
    mark = next((m for m, n in MARKS if n == name and data.startswith(m)), b"")
    return data[len(mark) :].decode(name, "ignore"), name, zipped


def to_text(column: Column | str) -> Column:
    """struct<text, encoding, gzipped> of a binary column, by Arrow batches; null stays null, empty bytes are an empty utf-8 text."""

    @F.pandas_udf("text string, encoding string, gzipped boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [(None, None, None) if x is None else convert(bytes(x)) for x in s]
        return pd.DataFrame(got, columns=["text", "encoding", "gzipped"])

    return run(F.col(column) if isinstance(column, str) else column)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding, gzipped) of text files in any of the encodings."""
    return spark.read.format("binaryFile").load(path).select("path", to_text("content").alias("x")).select("path", "x.*")
