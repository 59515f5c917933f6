"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton reports every vocabulary piece that ends at each
character; dynamic programming carries the best score and that path's number of
pieces, never the pieces. Tie rules are those of the public unigram tokenizers:
a path is replaced only by one that scores more, and of the pieces that end at a
place the longest comes first. A character that no piece covers alone costs the
least score less 10 and counts its UTF-8 bytes (byte fallback).

White space is written as in such vocabularies: a mark before the text and for
each space. No piece has the mark after another character, so texts split before
the marks; each distinct part is solved once and kept in a bounded cache.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CACHE = 200_000


def pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - 10.0
        whole = any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.parts = re.compile(".+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL).findall
        self.cache: dict[str, tuple[float, int]] = {}

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and its pieces."""
        n = len(text)
        score, count, seen = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        seen[0] = True
        at = 0

        def close(to: int) -> None:
            # a place's single character comes last of all that end there
            nonlocal at
            while at < to:
                at += 1
                c = text[at - 1]
                if c not in self.alone:
                    s = score[at - 1] + self.unknown
                    if not seen[at] or s > score[at]:
                        score[at], count[at], seen[at] = s, count[at - 1] + len(c.encode("utf-8", "surrogatepass")), True

        for end, (size, own) in self.automaton.iter(text):
            close(end)
            end += 1
            s = score[end - size] + own
            if not seen[end] or s > score[end]:
                score[end], count[end], seen[end] = s, count[end - size] + 1, True
        close(n)
        return score[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        score, total, cache = 0.0, 0, self.cache
        for part in self.parts(MARK + text.replace(" ", MARK)):
            got = cache.get(part)
            if got is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                got = self.solve(part)
                if len(part) <= 64:
                    cache[part] = got
            score += got[0]
            total += got[1]
        return score, total


def _run(shared):
    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            got = [counter.count(None if t is None else t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """doc_id, n_tokens, score (of the best path) for each row of docs(doc_id, text, ...).

    vocabulary: (piece, score) with any finite scores; by default that of VOCABULARY.
    With whole-number scores all sums and ties are exact. Null and empty texts have
    no tokens, an empty table no rows. Bytes that are no UTF-8 are read as U+FFFD.
    Repeated rows are each counted; other columns are ignored.
    """
    vocabulary = pieces() if vocabulary is None else vocabulary
    if len(vocabulary) > 2_000_000:
        raise ValueError("a vocabulary of over 2,000,000 pieces is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_run(shared), "doc_id long, n_tokens long, score double")


def op5_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
