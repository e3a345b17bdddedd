"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches; dynamic programming keeps, for each place,
only the best score, its start's order for ties, and the number of pieces. The rules are those of unigram
tokenizers: starts are taken in ascending order and a later one must be strictly better; a character
that is no piece costs the lowest score less 10 and counts as its UTF-8 bytes if the vocabulary has byte pieces,
or else each run of such characters as one piece. No piece goes on after a space that
follows another character, so texts fall into parts. Where all scores are whole numbers the parts' counts are kept in a bounded cache;
other scores are carried from part to part, as a search over the whole text adds them.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], float, bool]:
    """(matchable pieces with scores, lowest score, has byte pieces) of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return plain, min(sp.get_score(i) for i in ids), any(sp.is_byte(i) for i in ids)


class Counter:
    """(pieces, score) of texts; ``cached`` parts at most are remembered."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float, bytes_: bool, cached: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p: s for p, s in pieces if len(p) == 1}
        # sums of whole numbers are the same whatever comes before; other scores must be added from the text's start on
        self.whole = all(float(s).is_integer() for _, s in pieces) and float(lowest).is_integer()
        self.unknown, self.bytes, self.cached = lowest - UNKNOWN_PENALTY, bytes_, cached
        self.cache: dict[str, tuple[int, float]] = {}
        # a place before a space is a border only if no piece holds a space after another character
        # and no run of characters that are no pieces, which counts as one, can go on over it
        apart = (bytes_ or SPACE in self.single) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        line = "\n" if bytes_ and not any("\n" in p for p, _ in pieces) else ""
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else "")) if apart else re.compile(r".+", re.S)

    def _search(self, part: str, before: float = 0.0) -> tuple[int, float]:
        """(pieces, score with that of the text ``before``) of one part."""
        n = len(part)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(part):
            ends[end + 1].append((end + 1 - length, score))
        best, count, unknown = [before] + [0.0] * n, [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, at = None, -1
            for s, score in ends[e]:
                score += best[s]
                if top is None or score > top or score == top and s < at:
                    top, at = score, s
            if part[e - 1] not in self.single:  # the latest start of all: it must be strictly better
                score = best[e - 1] + self.unknown
                if top is None or score > top:
                    best[e], unknown[e] = score, True
                    count[e] = count[e - 1] + (len(part[e - 1].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[e - 1])
                    continue
            best[e], count[e] = top, count[at] + 1
        return count[n], best[n]

    def of(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        total, score = 0, 0.0
        for part in self.parts.findall(SPACE + text.replace(" ", SPACE)):
            if not self.whole:
                n, score = self._search(part, score)
                total += n
                continue
            found = self.cache.get(part)
            if found is None:
                found = self._search(part)
                if len(part) <= 64:
                    if len(self.cache) >= self.cached:
                        self.cache.clear()
                    self.cache[part] = found
            total += found[0]
            score += found[1]
        return total, score


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, column: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``column``, and n_tokens and score (of the best segmentation).

    Null and empty texts have 0 tokens and score 0; others get one space in front, as the tokenizer
    has it. Spaces count like the character U+2581. Strings of control or byte pieces in a text are ordinary
    text. Equal rows give equal results; an empty table an empty result. Input columns of the two
    names are replaced. Texts are read whole; time and memory are linear in a part's length.
    """
    rest = [c for c in docs.columns if c not in (column, "n_tokens", "score")]
    # a vocabulary's size doesn't depend on the data
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def make():
        counter = Counter(*shared.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counter.of(t) for t in batch.column(len(rest)).to_pylist()]
            n, score = zip(*found)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n, pa.int64()), pa.array(score, pa.float64())], [*rest, "n_tokens", "score"])

        return f

    rows = docs.select(*rest, column)
    return by_batch(rows, make, rows.drop(column).schema.add("n_tokens", "long").add("score", "double"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
