"""Token counts of a unigram tokenizer without making the tokens.

The text is cut into words as the Metaspace pre-tokenizer does; in a word an
Aho-Corasick automaton enumerates every match of the vocabulary, and dynamic
programming carries the best score and the piece to the left.  Ties go as in
the tokenizers library: a later candidate must score strictly more, and
candidates for an end come in ascending order of their start, the unknown
character last.  Runs of unknown characters count as their bytes.

Counts of words are remembered up to a bounded number of words, so a word's
dynamic programming runs rarely more than once in a worker.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

SPACE = "▁"
#: What an unknown character scores below the lowest piece (fixed value of the tokenizers library).
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, log probability) of a sentencepiece file's pieces, by Zipf's law on their ranks.

    The public files hold no unigram model, and tokenizers are not trained here;
    a file's order of pieces is an order of frequency, which fixes the scores.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.vocab_size()
    total = math.log(sum(1 / (r + 1) for r in range(size)))
    return [(model.id_to_piece(r), -math.log(r + 1) - total) for r in range(size)]


class Counter:
    """Counts pieces of texts under a unigram vocabulary with byte fallback."""

    MOST, LONGEST = 600_000, 64

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.pieces = {p for p, _ in vocabulary}
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, k == unknown))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {"": self.word(SPACE)}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of a word."""
        n, low = len(word), self.unknown_score
        best, left, strange, single = [0.0] + [-math.inf] * n, [0] * (n + 1), bytearray(n + 1), bytearray(n + 1)
        done = 0  # ends up to here have all their candidates
        for last, (length, score, unknown) in itertools.chain(self.automaton.iter(word), [(n, (0, 0.0, False))]):
            end = last + 1
            while done < last:
                done += 1
                if not single[done] and (total := best[done - 1] + low) > best[done]:
                    best[done], left[done], strange[done] = total, done - 1, 1
            if length:
                start = end - length
                single[end] |= length == 1
                if (total := best[start] + score) > best[end]:
                    best[end], left[end], strange[end] = total, start, unknown
        count, end, stop = 0, n, -1  # stop: where the open run of unknown characters ends
        while end:
            if strange[end]:
                stop = end if stop < 0 else stop
            else:
                count += 1 + (self.strange(word[end:stop]) if stop >= 0 else 0)
                stop = -1
            end = left[end]
        return count + (self.strange(word[:stop]) if stop >= 0 else 0)

    def strange(self, run: str) -> int:
        return len(run.encode()) if run not in self.pieces and self.by_bytes else 1

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.word(SPACE + w)
        total = sum(map(known.__getitem__, words))
        if len(known) > self.MOST:  # the first half holds the frequent words
            self.known = dict(itertools.islice(known.items(), self.MOST // 2))
        if len(text) > self.LONGEST * len(words):
            self.known = {w: k for w, k in self.known.items() if len(w) <= self.LONGEST}
        return total


_counters: dict = {}


def count_tokens(docs: DataFrame, vocabulary: Callable[[], list[tuple[str, float]]], name: str = "default") -> DataFrame:
    """doc_id, n_tokens: the length of each whole text in pieces, one row per row of ``docs``.

    ``vocabulary`` is called once in each worker; ``name`` tells vocabularies
    apart.  A null or empty text has no pieces; very long words are counted but
    not remembered.  Repeated rows give repeated results; other columns and a
    null doc_id don't matter; an empty table gives no rows.
    """

    def rows(batches):
        if name not in _counters:
            _counters[name] = Counter(vocabulary())
        counter = _counters[name]
        for b in batches:
            yield {"doc_id": b["doc_id"], "n_tokens": [counter.text(t) for t in b["body"]]}

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")), rows, "doc_id long, n_tokens long")
