"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at each character; dynamic programming over
the ends carries the best score and its number of pieces only, no path. Ties are the tokenizer's: of paths with equal
scores to a place the one whose last piece begins first stays. A character that no piece of one character matches can
also be an unknown, at the lowest score less PENALTY; with byte fallback it counts as its UTF-8 bytes, without it a
run of unknowns counts once.

The rules are those of the tokenizers library's unigram model: every piece of the vocabulary can match in the text, also
one that stands for a control symbol or a byte.

Scores of this vocabulary are whole numbers, so sums don't depend on where they start and the parts that sp_model cuts
a text into are counted each by itself, through a bounded memo. Other vocabularies are counted over the whole text.

Nulls and edges: a null or empty text has 0 tokens and score 0; texts are counted whole at any length; repeated rows
and null ids pass through; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, prepare
from tessera.llm.memo import Memo
from tessera.llm.sp_model import SPACE, SpModel, segments

#: Fixed value of the tokenizer: how far an unknown's score is below the lowest score.
PENALTY = 10.0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, pieces: list[str], scores: list[float], byte_fallback: bool, cut: bool):
        known = set(pieces)
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown = min(scores) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in zip(pieces, scores, strict=True):
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cut = cut and self.byte_fallback and all(float(s).is_integer() for s in scores)
        self.memo = Memo(lambda part: complex(*self.best(part)))

    def best(self, text: str) -> tuple[float, float]:
        """(pieces, score) of the best path through a normalised text."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at = 0

        def settle(upto: int) -> None:
            """Ends before `upto` have all their pieces; those without a piece of one character may end in an unknown."""
            nonlocal at
            while at < upto:
                end = at + 1
                if not single[at]:
                    s = score[at] + self.unknown
                    if score[end] is None or s > score[end]:
                        score[end], unknown[end] = s, True
                        count[end] = count[at] + (len(text[at].encode()) if self.byte_fallback else not unknown[at])
                at = end

        single = [False] * n
        for last, (length, s) in self.automaton.iter(text):  # by end, longest first
            settle(last)
            end, start = last + 1, last + 1 - length
            if length == 1:
                single[last] = True
            s += score[start]
            if score[end] is None or s > score[end]:
                score[end], count[end], unknown[end] = s, count[start] + 1, False
        settle(n)
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if self.cut:
            total = sum(map(self.memo.__getitem__, segments(text)), 0j)
            return int(total.real), total.imag
        return self.best(SPACE + text.replace(" ", SPACE))


_loaded: dict[str, Counter] = {}


def load(path: str) -> Counter:
    if path not in _loaded:
        m = SpModel.load(path)
        _loaded[path] = Counter(m.pieces, m.scores, m.byte_fallback, m.plain)
    return _loaded[path]


def counts(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with n_chars (code points), n_tokens and the best path's score."""
    prepare(df.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [counter.count(t) for t in texts]
            cols = [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_chars", "n_tokens", "best_score"])

    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_chars long, n_tokens long, best_score double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir))
