"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi search.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over end positions carries
the best score and the number of pieces of the path that has it. Words of a text are counted once per worker and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space and starts a word.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ROWS, CACHE_CHARS = 500_000, 64
_workers: dict[str, UnigramCounter] = {}


def rank_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file in the order of their ids, with Zipf's log probability of their rank.

    Control pieces are left out. The files here hold merge orders, not probabilities, so scores follow from ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [(p, -math.log(i + 2)) for i, p in enumerate(pieces)]


class UnigramCounter:
    """Best score and piece count of a text by a unigram vocabulary.

    Ties: matches that end at one position are tried from the longest to the shortest and replace only a strictly lower
    score, so the longest last piece wins. A character without a piece of its own may be unknown, at the least score of
    the vocabulary less a penalty; it counts as its bytes if the vocabulary has all byte pieces, else a run of unknown
    characters counts as one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.cache: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            found[end + 1].append(match)  # at one end the longest comes first
        for end in range(1, n + 1):
            top, start, single, odd = -math.inf, 0, False, False
            for length, score in found[end]:
                if best[end - length] + score > top:
                    top, start = best[end - length] + score, end - length
                single = single or length == 1
            if not single and best[end - 1] + self.unknown > top:
                top, start, odd = best[end - 1] + self.unknown, end - 1, True
            best[end], unknown[end] = top, odd
            pieces = 1 if not odd else len(word[start].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[start])
            count[end] = count[start] + pieces
        return best[n], count[n]

    def text(self, text: str) -> tuple[float, int]:
        """Spaces become marks, a mark is put before the text unless one is there, and each mark starts a word."""
        if not text:
            return 0.0, 0
        marked = text.replace(" ", MARK)
        words = (marked[1:] if marked[0] == MARK else marked).split(MARK)
        get, score, pieces = self.cache.get, 0.0, 0
        for word in words:
            one = get(word)
            if one is None:
                one = self.word(MARK + word)
                if len(word) <= CACHE_CHARS:
                    if len(self.cache) >= CACHE_ROWS:
                        self.cache.clear()
                    self.cache[word] = one
            score += one[0]
            pieces += one[1]
        return score, pieces


def worker(path: str) -> UnigramCounter:
    if path not in _workers:
        _workers[path] = UnigramCounter(rank_vocabulary(path))
    return _workers[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of whole texts by the pieces in the sentencepiece file at `path`.

    Returns one row per input row: id_col, n_tokens, score (of the best path, summed over words). A null or empty text
    has no tokens and score 0. A word of any length is searched in time linear in its length and matches. Ids may be
    null or repeat; an empty table gives no rows; other columns are ignored, whatever their names. No row leaves its
    partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = worker(path)
        for pdf in batches:
            found = [counter.text(t or "") for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "n_tokens": [n for _, n in found], "score": [s for s, _ in found]})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, score double").withColumnRenamed("_id", id_col)
