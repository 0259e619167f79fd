"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming carries, for each
position, the best score and the number of pieces of the segmentation that has it, never the segmentation itself.
Tie rule: of segmentations of equal score, the one whose last piece starts first stands (pieces are tried by rising
start and replace the best on a strictly higher score only). A character that no piece covers alone costs the
lowest score less ten and counts as many tokens as it has UTF-8 bytes (byte fallback).

Blanks become the piece mark and one mark is put before the text. Where no piece has a mark behind another character,
the best segmentation of a text is that of its marked words one by one, and their counts are cached.

Nulls and odd rows: a null or empty text has 0 tokens; long texts are counted whole; equal texts count alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache

MARK = "▁"
UNKNOWN_COST = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)]


class UnigramCounter:
    """Counts tokens under a vocabulary of scored pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache = Cache(self.viterbi, 400_000)

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation of a marked text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        here, at = [], 0
        for end, match in self.automaton.iter(text):
            while at < end:
                at = self._close(text, at, here, score, count)
                here = []
            here.append(match)
        while at < n:
            at = self._close(text, at, here, score, count)
            here = []
        return count[n]

    def _close(self, text: str, at: int, here: list, score: list, count: list) -> int:
        """Settles the position behind character `at`; here: the matches that end with it, longest first."""
        best, pieces, single = None, 0, False
        for size, gain in here:
            start = at + 1 - size
            single |= size == 1
            total = score[start] + gain
            if best is None or total > best:
                best, pieces = total, count[start] + 1
        if not single:
            total = score[at] + self.unknown
            if best is None or total > best:
                best, pieces = total, count[at] + len(text[at].encode())
        score[at + 1], count[at + 1] = best, pieces
        return at + 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.cache.__getitem__, self.words.findall(marked))) if self.apart else self.viterbi(marked)


@lru_cache(4)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(path))


def token_count(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        counter = load(path)
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counts(text)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    return docs.select("doc_id", token_count(F.col("text"), path).alias("n_tokens"))
