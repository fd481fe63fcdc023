"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches; for each position only the best score and the piece count
of its best path are kept. Of equal scores the path whose last piece starts earlier wins, as in the tokenizer. No piece
holds a word mark after another character, so words (with the marks before them) are independent and are remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark of a word's begin, what an unknown character costs below the worst piece: fixed values of the tokenizer.
MARK, UNKNOWN = "▁", 10.0
CACHE_WORDS = 300_000
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class Counter(dict):
    """Word (without its mark) to piece count; `runs` and whole texts go through `count`."""

    def __init__(self, pieces):
        import ahocorasick

        super().__init__()
        self.pieces = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(self.pieces.values()) - UNKNOWN
        #: Words can be taken apart only if marks stand at the begin of pieces.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.runs: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        n = len(text)
        score, count, single = [float("-inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0], done = 0.0, 0
        for last, (size, value) in self.automaton.iter(text):
            end = last + 1
            for e in range(done + 1, end):
                self._close(text, e, score, count, single)
            done = max(done, end - 1)
            start = end - size
            single[end] |= size == 1
            if start >= 0 and (total := score[start] + value) > score[end]:  # longest first, so earliest start on ties
                score[end], count[end] = total, count[start] + 1
        for e in range(done + 1, n + 1):
            self._close(text, e, score, count, single)
        return count[n]

    def _close(self, text, e, score, count, single) -> None:
        """After all pieces that end at e: a character that is no piece stands for its bytes."""
        if not single[e] and (total := score[e - 1] + self.unknown) > score[e]:
            score[e], count[e] = total, count[e - 1] + len(text[e - 1].encode())

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.viterbi(MARK + word)
        return n

    def _run(self, run):
        if (n := self.runs.get(run)) is None:
            if len(self.runs) >= CACHE_WORDS:
                self.runs.clear()
            self.runs[run] = n = self.viterbi(run)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.apart:
            return self.viterbi(MARK + text.replace(" ", MARK))
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return sum(map(self._run, _RUN.findall(MARK + text.replace(" ", MARK))))
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and n_chars of every row's whole text.

    Null and empty texts have no tokens; texts of any length are counted whole; of segmentations with equal scores the
    tokenizer's own rule decides; repeated rows count alike; an empty table gives an empty result; extra columns of any
    name are left out.
    """

    def each(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(each, picked.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_chars")).schema)
