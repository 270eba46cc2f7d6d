"""Token counts of a unigram vocabulary: Viterbi that carries a score and a count, no pieces.

An Aho-Corasick automaton gives every vocabulary match that ends at a character; the best path to that character
keeps its score and the number of its tokens. Ties follow the tokenizers library's ``Unigram`` model: a path replaces
another only if its score is strictly higher, and paths come in order of where their last piece starts. A character
that no piece covers costs the lowest score less ten and counts as its UTF-8 bytes where the vocabulary has byte
pieces, else as one token for each unbroken run.

Words are cut before each space, which is written as U+2581, so a word's count doesn't depend on its neighbours and is
kept in a bounded dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, control pieces included, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of whole texts over a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], max_words: int = 1_000_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.max_words = max_words

    def viterbi(self, word: str) -> int:
        """Tokens on the best path through one word."""
        n = len(word)
        score: list[float | None] = [0.0, *[None] * n]
        count, loose, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            """Offers the unknown character to the ends that no single character reaches."""
            for end in range(done + 1, upto + 1):
                if not single[end]:
                    total = score[end - 1] + self.unknown
                    if score[end] is None or total > score[end]:
                        score[end], loose[end] = total, True
                        count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.bytes_known else not loose[end - 1])

        for last, (length, own) in self.automaton.iter(word):  # at one end, the earliest start comes first
            if last > done:
                settle(last)
                done = last
            end = last + 1
            total = score[end - length] + own
            if score[end] is None or total > score[end]:
                score[end], count[end] = total, count[end - length] + 1
            if length == 1:
                single[end] = True
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text: a space is put before it, and each space starts a word."""
        if not text:
            return 0
        known, total = self.known, 0
        words = text.replace(" ", SPACE).split(SPACE)
        # A text that begins with a space gets no other; each later empty part is a space of its own.
        for word in words[1:] if words[0] == "" else words:
            tokens = known.get(word)
            if tokens is None:
                if len(known) >= self.max_words:
                    known.clear()
                tokens = self.viterbi(SPACE + word)
                if len(word) <= 64:
                    known[word] = tokens
            total += tokens
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` (long) of its whole ``text``; null or empty text has none.

    path: a sentencepiece model file, on every machine, whose pieces and scores make the unigram vocabulary. Other
    columns stay, one named ``n_tokens`` is replaced. A narrow map without a shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name != "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        own = _counters[path]
        for batch in text_slices(batches):
            counts = [own.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(counts, pa.int64())], [*(f.name for f in kept), "n_tokens"])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType())]))
