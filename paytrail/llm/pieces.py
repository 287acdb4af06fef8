"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries a score and a count.

An Aho-Corasick machine lists the vocabulary's pieces that end at each character of a word. For each end the best score so far and the number of
pieces on that path are kept, nothing else. Ties go to the piece that starts first. A character that is no piece by itself counts as unknown,
with the lowest score less 10; unknown ones in a row are one token. These are the rules of the public unigram tokenizers.
Words are what white space splits: a blank becomes the word mark and starts the next word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.llm.words import slices

MARK = "▁"
UNKNOWN = "<unk>"
PENALTY = 10.0
CACHED = 300_000  # words whose counts a worker keeps


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The unknown piece, then the ordinary pieces of a public vocabulary file with the file's own scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(UNKNOWN, 0.0), *((sp.id_to_piece(i), float(sp.get_score(i))) for i in ordinary)]


class Counter:
    """Counts and scores words by a list of (piece, score), the first of which is the unknown piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for n, (piece, score) in enumerate(pieces):
            self.machine.add_word(piece, (len(piece), score, n == 0))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """(tokens, score) of the best path."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            got = self.seen[word] = self._viterbi(word)
        return got

    def _viterbi(self, word: str) -> tuple[int, float]:
        """The machine reports matches by rising end, the longest (that is, the earliest start) first; only a better score replaces one."""
        n = len(word)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), set()
        end, best, single, lowest = 0, 0.0, True, float("-inf")

        def unknown(end: int, best: float) -> None:
            total = self.unknown + score[end - 1]
            if total > best:
                score[end], count[end] = total, count[end - 1] + (end - 1 not in odd)
                odd.add(end)

        for last, (size, s, unk) in self.machine.iter(word):
            if last >= end:
                if not single:
                    unknown(end, best)
                for end in range(end + 1, last + 1):
                    unknown(end, lowest)
                end, best, single = last + 1, lowest, False
            total = s + score[end - size]
            if total > best:
                best = score[end] = total
                count[end] = count[end - size] + 1
                if unk:
                    count[end] -= end - size in odd
                    odd.add(end)
                elif odd:
                    odd.discard(end)
            if size == 1:
                single = True
        if not single:
            unknown(end, best)
        for end in range(end + 1, n + 1):
            unknown(end, lowest)
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text, the words' scores added in order."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        parts = marked.split(MARK)
        each = [self.best(MARK + x) for x in (parts[1:] if marked.startswith(MARK) else parts)]
        return sum(n for n, _ in each), sum(s for _, s in each)


@cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (best log probability); one row per input row. Null and empty texts have no token and score 0.

    One pass without shuffle; each Python worker builds the machine from the vocabulary file once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [own.text(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([float(s) for _, s in rows], pa.float64())], ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")
