"""Token counts under a unigram vocabulary, by a Viterbi pass that keeps no pieces.

An Aho-Corasick automaton gives the vocabulary's matches by where they end, the longest first. The
best score and its number of pieces are carried from place to place. Tokenizer rules, exactly: a
character without a piece of its own may be unknown, at the least score of the vocabulary less ten;
of equal scores the path whose last piece begins first wins; adjacent unknown characters are one. The
unknown piece's own name in a text is unknown too, at the score of that piece.
No piece has a blank mark behind another character and none has a line end, so a text's count is
made of the counts of its words, which repeat and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm.tokens import in_slices

BLANK = "▁"
#: Below the least score, for an unknown character.
UNKNOWN_PENALTY = 10.0
#: The unknown piece's name and score.
UNKNOWN = ("<unk>", 0.0)
#: Stands between words; a text that holds it is counted whole.
_CUT = "\ue000"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown, unused and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (m.is_control, m.is_unknown, m.is_unused, m.is_byte)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not any(f(i) for f in special)]


class Counter:
    """``count(texts)``: the number of tokens of each. ``room``: words kept at most."""

    def __init__(self, pieces: list[tuple[str, float]], room: int = 500_000):
        import ahocorasick

        if any(BLANK in p.lstrip(BLANK) or "\n" in p or _CUT in p for p, _ in pieces):
            raise ValueError("a piece runs over a word's end")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score, 0))
        self.automaton.add_word(UNKNOWN[0], (len(UNKNOWN[0]), UNKNOWN[1], 1))
        self.automaton.make_automaton()
        self.longest = max(len(UNKNOWN[0]), *(len(p) for p, _ in pieces))
        self.unknown = min(UNKNOWN[1], *(s for _, s in pieces)) - UNKNOWN_PENALTY
        self.room = room
        self.known: dict[str, tuple[int, int, int]] = {}

    def word(self, text: str) -> tuple[int, int, int]:
        """Its pieces, and whether the first and the last are unknown. No more places are kept than the longest piece has."""
        n = len(text)
        if not n:
            return 0, 0, 0
        width = self.longest + 1
        # Of the best way to each of the last places: score, pieces, whether the last and the first are unknown (-1: no piece yet).
        ways: list[tuple[float, int, int, int]] = [(0.0, 0, 0, -1)] * width
        unknown, done = self.unknown, 0

        def settle(end: int, found: list[tuple[int, float, int]]) -> None:
            best, single = None, False
            for length, s, strange in found:
                score, pieces, last, first = ways[(end - length) % width]
                single |= length == 1
                s += score
                if best is None or s > best[0]:
                    best = s, pieces + (not (strange and last)), strange, strange if first < 0 else first
            if not single:
                score, pieces, last, first = ways[(end - 1) % width]
                s = unknown + score
                if best is None or s > best[0]:
                    best = s, pieces + (not last), 1, 1 if first < 0 else first
            ways[end % width] = best

        found: list[tuple[int, float, int]] = []
        for at, value in self.automaton.iter(text):
            while done < at:
                done += 1
                settle(done, found)
                found = []
            found.append(value)
        while done < n:
            done += 1
            settle(done, found)
            found = []
        _, pieces, last, first = ways[n % width]
        return pieces, first, last

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        text = lambda x: pa.scalar(x, pa.large_string())
        whole = pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.binary_join_element_wise(text(BLANK), texts, text("")), " ", BLANK)
        cut = pc.replace_substring_regex(pc.replace_substring(marked, "\n", f"{_CUT}\n{_CUT}"), f"({BLANK}+)", f"{_CUT}\\1")
        split = pc.split_pattern(pc.if_else(pa.array(whole | empty), text(""), cut), _CUT)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.word(distinct[i])
            if len(self.known) < self.room:
                self.known[distinct[i]] = found[i]
        table = np.array(found, dtype=np.int64).reshape(-1, 3)
        index = coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        real = table[index, 0] > 0  # empty words stand beside line ends
        index, doc = index[real], doc[real]
        out = np.bincount(doc, weights=table[index, 0], minlength=len(texts)).astype(np.int64)
        fused = (table[index[:-1], 2] & table[index[1:], 1] & (doc[1:] == doc[:-1])).astype(bool)
        out -= np.bincount(doc[1:][fused], minlength=len(texts))
        for i in np.flatnonzero(whole):
            out[i] = self.word(marked[int(i)].as_py())[0]
        return out


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row; null and empty texts have none. No shuffle.

    Repeated rows and null ids are counted like others; an empty table gives an empty result; a long
    text is counted whole, in memory of some times its own size. Only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model))
        for batch in in_slices(batches):
            counts = pa.array(counter.count(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
