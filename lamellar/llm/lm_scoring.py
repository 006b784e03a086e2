"""Cross-entropy difference: per-token loss under a target model less that under a background model.

Both are bigram models over one vocabulary, all words of the whole corpus. The background counts all
documents, the target those labelled as wanted. Words are compared as they are, and bigrams by the
numbers of both words, so no two share a count. Documents are dealt into chunks of bounded size; each
chunk sends its distinct words, then its distinct bigrams, to the bucket that adds them up, and gets
back the sums. Nothing of the vocabulary's or the models' size is gathered: chunks and buckets stay as
large as they are, and their number grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm.tokens import in_slices
from lamellar.sources.storage import materialise

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 8_000_000
#: Ids below this stand side by side in one number of 64 bits.
FUSED = 1 << 31
#: Weight of the word probability in a bigram's, in counts.
ALPHA = 50.0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts in a row, and how many each text has."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = split.flatten()
    real = pc.not_equal(words, "")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return words.filter(real), np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ids of distinct bigrams in order, and the place of each one given. Ids are exact at any size."""
    names = None
    if max(left.max(initial=0), right.max(initial=0)) >= FUSED:  # those at hand are fewer
        names, local = np.unique(np.concatenate([left, right]), return_inverse=True)
        left, right = local[: len(left)], local[len(left) :]
    keys, at = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)
    left, right = keys >> 32, keys & 0xFFFFFFFF
    return (left, right, at) if names is None else (names[left], names[right], at)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places."""
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").reshape(n)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of each that has values: never more than there are values."""
    order = np.argsort(bucket, kind="stable")
    found, begins = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=False))


def _word_buckets(words: pa.Array, many: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % many for w in words.to_pylist()), np.int64, len(words))


def _bigram_buckets(left: np.ndarray, right: np.ndarray, many: int) -> np.ndarray:
    keys = (left.astype(np.uint64) << np.uint64(32)) ^ (left.astype(np.uint64) >> np.uint64(32)) ^ right.astype(np.uint64)
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(many)).astype(np.int64)


def chunks(docs: DataFrame, wanted: DataFrame, many: int) -> DataFrame:
    """One row per chunk: its documents, its distinct words, and its tokens as places among these.

    Null texts have no words; rows with a null id are dealt by text.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        words, lengths = _words(left["text"].combine_chunks())
        coded = words.dictionary_encode()
        own = pc.is_in(left["doc_id"], value_set=right["doc_id"].combine_chunks()).to_numpy()
        listed = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (left["doc_id"].combine_chunks(), coded.dictionary.cast(pa.string()))]
        packed = [pa.array([_packed(v)], pa.binary()) for v in (lengths, own.astype(np.int64), coded.indices.to_numpy())]
        return pa.table([left["chunk"].combine_chunks()[:1], *listed, *packed, pa.array([len(words)]), pa.array([int(lengths[own].sum())])], schema=schema)

    schema = pa.schema({"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "words": pa.list_(pa.string())} | dict.fromkeys(("lengths", "wanted", "tokens"), pa.binary()) | dict.fromkeys(("background", "target"), pa.int64()))
    dealt = lambda df, key: df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(many)))
    left = dealt(docs, F.coalesce("doc_id", F.xxhash64("text"))).groupBy("chunk")
    made = "chunk long, doc_ids array<long>, words array<string>, lengths binary, wanted binary, tokens binary, background long, target long"
    return left.cogroup(dealt(wanted, F.col("doc_id")).groupBy("chunk")).applyInArrow(run, made)


def word_models(base: DataFrame, many: int) -> DataFrame:
    """chunk, bucket, ids, target, background for the words of each chunk in the bucket's order, and
    ``fresh``, distinct words, on one row of each bucket. An id is the bucket's own count and the bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, tokens = batch.column("words")[i].values, _unpacked(batch.column("tokens")[i].as_py())
                own = np.repeat(_unpacked(batch.column("wanted")[i].as_py()), _unpacked(batch.column("lengths")[i].as_py()))
                t, b = (np.bincount(x, minlength=len(words)) for x in (tokens[own > 0], tokens))
                order, groups = _dealt(_word_buckets(words, many))
                words = words.take(pa.array(order))
                offsets = pa.array([0, *(hi for _, _, hi in groups)], pa.int32())
                cols = [pa.array([g[0] for g in groups], pa.int64()), pa.repeat(batch.column("chunk")[i], len(groups)), pa.ListArray.from_arrays(offsets, words)]
                cols += [pa.array([_packed(x[order[lo:hi]]) for _, lo, hi in groups], pa.binary()) for x in (t, b)]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "words", "target", "background"])

    def add(rows: pa.Table) -> pa.Table:
        lists = rows["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        at, distinct, bucket = coded.indices.to_numpy(), len(coded.dictionary), rows["bucket"][0].as_py()
        ids = at.astype(np.int64) * many + bucket
        return _sums(rows, at, distinct, ids, np.cumsum(pc.list_value_length(lists).to_numpy()))

    sent = base.select("chunk", "words", "lengths", "wanted", "tokens").mapInArrow(send, "bucket long, chunk long, words array<string>, target binary, background binary")
    return sent.groupBy("bucket").applyInArrow(add, FOUND)


FOUND = "chunk long, bucket long, ids binary, target binary, background binary, fresh long"


def _sums(rows: pa.Table, at: np.ndarray, distinct: int, ids: np.ndarray | None, ends: np.ndarray) -> pa.Table:
    """Each sender's values replaced by the sums over all senders; ``at``: the place of each value."""
    cols = []
    for name in ("target", "background"):
        n = np.concatenate([_unpacked(x) for x in rows[name].to_pylist()])
        total = np.bincount(at, n, distinct).astype(np.int64)  # whole numbers below 2^53
        cols.append(total[at])
    cut = lambda v: pa.array([_packed(p) for p in np.split(v, ends[:-1])], pa.binary())
    fresh = pa.array([distinct] + [0] * (rows.num_rows - 1), pa.int64())
    named = pa.nulls(rows.num_rows, pa.binary()) if ids is None else cut(ids)
    names = ["chunk", "bucket", "ids", "target", "background", "fresh"]
    return pa.table([rows["chunk"].combine_chunks(), rows["bucket"].combine_chunks(), named, *map(cut, cols), fresh], names=names)


def _numbered(chunk: pa.Table, found: pa.Table, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's tokens as global ids, its documents' lengths, which bigrams of the row lie within one document, and words' sums."""
    words = chunk["words"].combine_chunks().flatten()
    order, _ = _dealt(_word_buckets(words, many))
    cols = np.zeros((3, len(words)), np.int64)
    rows = found.sort_by("bucket")
    for col, name in zip(cols, ("ids", "target", "background"), strict=True):
        if len(words):
            col[order] = np.concatenate([_unpacked(x) for x in rows[name].to_pylist()])
    tokens, lengths = _unpacked(chunk["tokens"][0].as_py()), _unpacked(chunk["lengths"][0].as_py())
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return tokens, doc, np.flatnonzero(doc[:-1] == doc[1:]), cols


def bigram_models(base: DataFrame, words: DataFrame, many: int) -> DataFrame:
    """chunk, bucket, target, background for the bigrams of each chunk, in order by bucket and key."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, doc, within, (ids, _, _) = _numbered(left, right, many)
        named = ids[tokens]
        lefts, rights, at = _distinct(named[within], named[within + 1])
        own = _unpacked(left["wanted"][0].as_py())[doc[within]] > 0
        t, b = (np.bincount(x, minlength=len(lefts)) for x in (at[own], at))
        order, groups = _dealt(_bigram_buckets(lefts, rights, many))
        cols = [pa.array([_packed(x[order[lo:hi]]) for _, lo, hi in groups], pa.binary()) for x in (lefts, rights, t, b)]
        head = [pa.array([g[0] for g in groups], pa.int64()), pa.array([left["chunk"][0].as_py()] * len(groups), pa.int64())]
        return pa.table([*head, *cols], names=["bucket", "chunk", "lefts", "rights", "target", "background"])

    def add(rows: pa.Table) -> pa.Table:
        lefts, rights = ([_unpacked(x) for x in rows[name].to_pylist()] for name in ("lefts", "rights"))
        distinct, _, at = _distinct(np.concatenate(lefts), np.concatenate(rights))
        return _sums(rows, at, len(distinct), None, np.cumsum([len(p) for p in lefts]))

    made = "bucket long, chunk long, lefts binary, rights binary, target binary, background binary"
    sent = base.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(send, made)
    return sent.groupBy("bucket").applyInArrow(add, FOUND)


def _repeats(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each value stands in its own document."""
    _, at, n = np.unique(doc * np.int64(value.max(initial=0) + 1) + value, return_inverse=True, return_counts=True)
    return n[at]


def lm_scoring(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score, their difference; less is more wanted.

    A bigram's probability is its count and ALPHA times the word's probability, over the count of the first
    word and ALPHA. So those of all words after a word, and of the document's end, sum to 1, an unseen word having one
    count among the words'. A document is scored by the counts of all others: its own are subtracted from
    both models, so that being labelled doesn't change its score.

    ``labels``: doc_id and wanted (true or false). A document counts as wanted if any of its labels
    says so. Null or empty text has 0 tokens and null losses. Rows with a null id are counted for the
    background and scored; repeated rows count each time. An empty corpus gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    many = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES
    wanted = labels.filter("wanted and doc_id is not null").select("doc_id").distinct()
    base = materialise(chunks(rows, wanted, many), "chunks")
    words = materialise(word_models(base, many), "words")
    pairs = materialise(bigram_models(base, words, many), "bigrams")
    tokens = base.agg(F.sum("target"), F.sum("background")).first()
    distinct = words.agg(F.sum("fresh")).first()[0] or 0
    sums = [float((n or 0) + distinct + 1) for n in tokens]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_word = pc.is_valid(right["ids"])
        tokens, doc, within, (ids, *counts) = _numbered(left, right.filter(of_word), many)
        named = ids[tokens]
        lefts, rights, at = _distinct(named[within], named[within + 1])
        order, _ = _dealt(_bigram_buckets(lefts, rights, many))
        found = right.filter(pc.invert(of_word)).sort_by("bucket")
        lengths, wanted = (_unpacked(left[c][0].as_py()) for c in ("lengths", "wanted"))
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        # A document's own counts are left out of both models, so that it isn't known by heart.
        own_word, own_pair = _repeats(doc, tokens), _repeats(doc[within], at)
        losses = []
        for name, unigram, total, counted in zip(("target", "background"), counts, sums, (wanted[doc], np.ones_like(doc)), strict=True):
            n = np.zeros(len(lefts), np.int64)
            if len(lefts):
                n[order] = np.concatenate([_unpacked(x) for x in found[name].to_pylist()])
            others = unigram[tokens] - own_word * counted
            p = (others + 1.0) / (total - lengths[doc] * counted)
            loss = np.zeros(len(tokens))
            loss[first] = -np.log(p[first])
            loss[within + 1] = -np.log((n[at] - own_pair * counted[within] + ALPHA * p[within + 1]) / (others[within] + ALPHA))
            losses.append(np.bincount(doc, loss, len(lengths)) / np.maximum(lengths, 1))
        none = lengths == 0
        t, b = losses
        cols = [left["doc_ids"].combine_chunks().flatten(), pa.array(lengths), *(pa.array(x, mask=none) for x in (t, b, t - b))]
        return pa.table(cols, names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    scored = base.groupBy("chunk").cogroup(words.union(pairs).groupBy("chunk"))
    return scored.applyInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
