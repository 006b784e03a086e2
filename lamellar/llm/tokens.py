"""Token ids of whole texts by a public tokenizer file, with pieces of text cached.

A byte-level or word-end BPE tokenizer splits a text at fixed places before it merges anything.
At a single blank or line end between two characters that aren't white space it always splits,
so the ids of a text are those of its pieces put together. Pieces repeat, so their ids are kept.
Texts with other runs of white space are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Stands before a text's first piece, which no blank precedes; a text that holds it is encoded whole.
_FIRST = "\x02"
#: Bytes of text that an encoder should be given at once: pieces repeat less in fewer.
ENCODE_AT_ONCE = 4_000_000
#: Characters of the longest piece that is kept.
LONGEST = 64
_WHOLE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}|\x02"


class Encoder:
    """``encode(texts)`` gives the ids of all texts in a row, and where each text begins and ends.

    ``drops_space``: the tokenizer normalises and drops white space. Pieces of up to LONGEST characters
    are kept as columns; beyond ``room`` of them, the half that was met most often stays. So memory is
    bounded, and what isn't kept is encoded again, which changes speed alone.
    """

    def __init__(self, path: str, drops_space: bool, room: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.drops_space, self.room = drops_space, room
        self.pieces = pa.array([], pa.large_string())
        self.flat, self.begins = np.zeros(0, "<u4"), np.zeros(0, np.int32)
        self.sizes, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32)
        (self.mark,) = np.frombuffer(self._ids(["0" if drops_space else "\n"])[0], "<u4")
        self.marks = dict(zip(",.", self._ids([",", "."]), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _joined_ids(self, texts: list[str]) -> list[bytes]:
        """The same for short pieces, many of them in one text, between marks that are a token of their own."""
        mark = "0" if self.drops_space else "\n"
        between = f" {mark} " if self.drops_space else mark
        plain = [mark not in t and len(t.split()) == 1 and t.lstrip(" ") == t.split()[0] for t in texts]
        some = [t for t, p in zip(texts, plain, strict=True) if p]
        groups = [some[lo : lo + 256] for lo in range(0, len(some), 256)]
        found: list[bytes] = []
        for group, e in zip(groups, self.batch([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) + 1 != len(group):  # a piece has the mark's token after all
                found += self._ids(group)
                continue
            raw, lo = ids.tobytes(), 0
            for hi in [*ends.tolist(), len(ids)]:
                found.append(raw[4 * lo : 4 * hi])
                lo = hi + 1
        rest = iter(self._ids([t for t, p in zip(texts, plain, strict=True) if not p]))
        done = iter(found)
        return [next(done) if p else next(rest) for p in plain]

    def _text(self, piece: str) -> str:
        """What stands in the text for a piece."""
        if self.drops_space or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == _FIRST else f" {piece}"

    @staticmethod
    def _core(piece: str) -> str:
        """The piece without a comma or full stop behind an ASCII letter, where these tokenizers always split.

        Behind other letters lower-casing may leave a mark that joins what follows.
        """
        return piece[:-1] if len(piece) > 2 and piece[-1] in ",." and piece[-2].isascii() and piece[-2].isalpha() else piece

    def _kept(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is kept, or -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that aren't kept."""
        cores = list(map(self._core, pieces))
        found: dict[str, bytes] = {}
        wanted = list(dict.fromkeys(cores))
        shorter = [c for c, p in zip(cores, pieces, strict=True) if len(c) < len(p)]
        for c, at in zip(shorter, self._kept(pa.array(shorter, pa.large_string())).tolist(), strict=True):
            if at >= 0:
                found[c] = self.flat[self.begins[at] : self.begins[at] + self.sizes[at]].tobytes()
        wanted = [c for c in wanted if c not in found]
        for lo in range(0, len(wanted), 4096):
            some = wanted[lo : lo + 4096]
            found.update(zip(some, self._joined_ids(list(map(self._text, some))), strict=True))
        return [found[c] if len(c) == len(p) else found[c] + self.marks[p[-1]] for c, p in zip(cores, pieces, strict=True)]

    def _look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, and where those of each piece begin and how many there are."""
        at = self._kept(distinct)
        missing = at < 0
        self.met[at[~missing]] += 1
        new = distinct.filter(pa.array(missing))
        ids = self._encoded(new.to_pylist())
        many = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        first = (len(self.flat) + np.cumsum(many) - many).astype(np.int32)
        begins, sizes = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
        begins[missing], sizes[missing] = first, many
        begins[~missing], sizes[~missing] = self.begins[at[~missing]], self.sizes[at[~missing]]
        short = pc.less_equal(pc.utf8_length(new), LONGEST)
        keep = short.to_numpy(zero_copy_only=False)
        self.pieces = pa.concat_arrays([self.pieces, new.filter(short)])
        self.begins, self.sizes = np.concatenate([self.begins, first[keep]]), np.concatenate([self.sizes, many[keep]])
        self.met, self.flat = np.concatenate([self.met, np.zeros(keep.sum(), np.int32)]), flat
        if len(self.pieces) > self.room or len(flat) > 8 * self.room:
            self._forget()
        return flat, begins, sizes

    def _forget(self) -> None:
        """Keeps the half of ``room`` that was met most often, of equals the latest."""
        stay = np.sort(np.argsort(self.met, kind="stable")[len(self.met) - min(len(self.met), self.room // 2) :])
        self.pieces, self.met, self.sizes = self.pieces.take(pa.array(stay)), self.met[stay], self.sizes[stay]
        ends = np.cumsum(self.sizes)
        self.flat = self.flat[np.repeat(self.begins[stay] - (ends - self.sizes), self.sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.begins = (ends - self.sizes).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if self.drops_space:
            whole = np.zeros(n, bool)
            marked = pc.replace_substring(texts, "\n", " ")
        else:
            whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
            marked = pc.replace_substring(texts, "\n", " \n")
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), marked, pa.scalar("", pa.large_string()))
            if whole.any():  # in its place one empty piece
                marked = pc.if_else(pa.array(whole), pa.scalar(_FIRST, pa.large_string()), marked)
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        index, ends = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)
        ids, begins, sizes = self._look_up(coded.dictionary)
        many = sizes[index]
        at = np.concatenate([[0], np.cumsum(many)])
        place = np.repeat((begins[index] - at[:-1]).astype(np.int32), many)  # of a slice, so 32 bits do
        place += np.arange(at[-1], dtype=np.int32)
        out = ids[place]
        bounds = at[ends]
        if whole.any():
            return self._with_whole(texts, whole, out, bounds)
        return out, bounds

    def _with_whole(self, texts: pa.Array, whole: np.ndarray, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(texts)):
            parts.append(np.frombuffer(self._ids([texts[i].as_py()])[0], "<u4") if whole[i] else out[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def in_slices(batches, text: str = "text", most: int = 2_000_000):
    """Arrow batches, cut so that the texts of a slice have about ``most`` bytes: bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    batch = None
    pa.default_memory_pool().release_unused()  # the worker stays for later stages


@contextmanager
def sent_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """While it is open, tasks send Python rows of about ``most`` bytes at once: for actions on rows of megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, was)
