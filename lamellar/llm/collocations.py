"""Phrase collocations by hierarchical pair naming.

Texts become sequences of word numbers. At each level adjacent names of frequent (k-1)-grams are a pair, a
k-gram; pairs are counted over the whole corpus, the frequent ones get numbers of their own, and these take
the pairs' places. A name's two halves are its parents: by them the counts of both sides of a cut are
handed down, and a candidate learns of the longer ones that hold it.

Sequences stay where they are: a task handles chunks of bounded size, of which only distinct pairs and
their counts are sent. Names go to the chunks in a broadcast behind a check of its size; beyond it each chunk
gets those of its own pairs by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.functions.ranking import with_rank
from lamellar.llm.tokens import in_slices, sent_at_once
from lamellar.sources.storage import drop, materialise

#: Fixed value: where texts are cut into pieces.
BREAK = "[.,;:!?\n\x0b\x0c\r]"
#: Words of a phrase and its occurrences, at most and at least; a longer one with so many percent of a candidate's occurrences subsumes it.
LONGEST, LEAST, SUBSUMES = 4, 30, 80
#: Phrases that are listed for each language.
LISTED = 2000
#: Bytes of text of a chunk, unless a single text has more.
CHUNK = 400_000
#: Bytes of chunks that a task sends to Python at once.
BATCH = 3_000_000
#: Places whose pairs are counted at once, of the chunks of a task.
AT_ONCE = 1_000_000
#: Names that are broadcast at once, of 24 bytes and a word each; more are joined to the chunks' own pairs.
MOST_BROADCAST = 1_000_000

#: Names fewer than this have products of two that fit 64 bits, so that a pair is one number.
MOST_FUSED = 3_000_000_000

_CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, seq binary"
_SEQUENCES = "chunk long, lang string, seq binary"
_NONE = np.int64(-1)


def _packed(seq: np.ndarray) -> pa.Array:
    """Numbers of a sequence, compressed: most are small."""
    many = len(seq).to_bytes(8, "little")
    return pa.array([many + pa.compress(seq.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    many = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * many, codec="zstd"), "<i8")


def _tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and their numbers in order, -1 between pieces and texts."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.replace_substring_regex(low, BREAK, " \n ")
    low = pc.binary_join_element_wise(low, pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string()))
    parts = pc.split_pattern(pc.replace_substring(low, "\t", " "), " ").flatten()
    coded = parts.filter(pc.not_equal(parts, "")).dictionary_encode()
    seq, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    at = pc.index(words, pa.scalar("\n", pa.large_string())).as_py()
    if at < 0:
        return words, seq
    number = np.arange(len(words)) - (np.arange(len(words)) > at)
    number[at] = _NONE
    return pa.concat_arrays([words.slice(0, at), words.slice(at + 1)]), number[seq]


def chunked(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """chunk, lang, words, counts and seq (places among the words, packed, -1 where a piece ends) of texts of one language.

    Null languages are ``und``; null and empty texts, and those without words, add nothing.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for part in in_slices(batches, most=CHUNK):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                words, seq = _tokenised(part.column("text").filter(pc.equal(langs, lang)))
                if len(words):
                    counts = np.bincount(seq[seq >= 0], minlength=len(words))
                    lists = [pa.array([words.cast(pa.string()).to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([lang]), *lists, _packed(seq)], names=["chunk", "lang", "words", "counts", "seq"])
                    chunk += 1

    return rows.mapInArrow(cut, _CHUNKS)


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of names, and the left and right ones there."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    return at, seq[at], seq[at + 1]


def _distinct(left: np.ndarray, right: np.ndarray, span: int, fused: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right names of distinct pairs, how often each stands, and its number for every pair. Names are below ``span``."""
    names = None
    if not fused:  # those at hand are fewer
        names, local = np.unique(np.concatenate([left, right]), return_inverse=True)
        left, right, span = local[: len(left)], local[len(left) :], len(names)
    found, at, n = np.unique(left * np.int64(span) + right, return_inverse=True, return_counts=True)
    left, right = found // max(1, span), found % max(1, span)
    return (left, right, n, at) if names is None else (names[left], names[right], n, at)


def _keys(left: np.ndarray, right: np.ndarray, span: int, fused: bool) -> dict[str, pa.Array]:
    """A pair's columns: one number for both names, or two."""
    return {"code": pa.array(left * np.int64(span) + right)} if fused else {"l": pa.array(left), "r": pa.array(right)}


def _key_names(span: int) -> list[str]:
    return ["code"] if span < MOST_FUSED else ["l", "r"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that no more than one chunk's values are copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}
    batch = None
    pa.default_memory_pool().release_unused()  # the worker stays for later stages


def _totals(seqs: DataFrame, span: int) -> DataFrame:
    """The columns of pairs and n: the distinct ones of a task's chunks, AT_ONCE places at a time."""
    fused = span < MOST_FUSED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            left, right, n, _ = _distinct(*_pairs(np.concatenate(held))[1:], span, fused)
            held.clear()
            for lo in range(0, len(n), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_pydict(_keys(left[part], right[part], span, fused) | {"n": pa.array(n[part])})

        for row in _rows(batches):
            held += [_unpacked(row["seq"].as_buffer()), np.array([_NONE])]
            if sum(map(len, held)) > AT_ONCE:
                yield from flushed()
        if held:
            yield from flushed()

    return seqs.mapInArrow(count, ", ".join(f"{k} long" for k in [*_key_names(span), "n"]))


def _own_pairs(seqs: DataFrame, span: int) -> DataFrame:
    """chunk, nth and the columns of pairs: the distinct ones of each chunk, numbered as ``_distinct`` does."""
    fused = span < MOST_FUSED

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            left, right, _, _ = _distinct(*_pairs(_unpacked(row["seq"].as_buffer()))[1:], span, fused)
            chunk = pa.array(np.full(len(left), row["chunk"].as_py(), np.int64))
            yield pa.RecordBatch.from_pydict({"chunk": chunk, "nth": pa.array(np.arange(len(left)))} | _keys(left, right, span, fused))

    return seqs.mapInArrow(listed, "chunk long, nth long, " + ", ".join(f"{k} long" for k in _key_names(span)))


def _of_words(chunks: DataFrame) -> DataFrame:
    """chunk, lang, nth, word, n."""
    zipped = F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))
    return chunks.select("chunk", "lang", F.posexplode(zipped).alias("nth", "e")).select("chunk", "lang", F.col("nth").cast("long").alias("nth"), "e.word", "e.n")


def _named(items: DataFrame, keys: list[str], label: str) -> DataFrame:
    """id, the keys and f: items of LEAST occurrences or more, numbered from 0 by how often they stand."""
    rows = items.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= LEAST)
    rows = with_rank(materialise(rows.withColumn("less", -F.col("f")), label), ["less", *keys], "rank")
    return materialise(rows.select((F.col("rank") - 1).alias("id"), *keys, "f"), label)


def _encoded(chunks: DataFrame, names: DataFrame, keys: list[str], span: int, label: str) -> DataFrame:
    """chunk, lang, seq of names: those of words or pairs that are frequent, -1 elsewhere. ``span``: names of the level below."""
    words, fused = keys == ["lang", "word"], span < MOST_FUSED

    def sequences(batches: Iterator[pa.RecordBatch], ids_of) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seq = _unpacked(row["seq"].as_buffer())
            if words:
                ids = ids_of(row, row["words"].values)
                seq = np.where(seq >= 0, ids[seq], _NONE)
            else:
                at, left, right = _pairs(seq)
                seq = np.full(len(seq), _NONE)
                seq[at] = ids_of(row, (left, right))
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"].as_py()], pa.int64()), pa.array([row["lang"].as_py()]), _packed(seq)], names=["chunk", "lang", "seq"])

    if names.count() <= MOST_BROADCAST and fused:
        table = names.orderBy(*keys).toArrow()  # MOST_BROADCAST rows at most
        ids = table["id"].to_numpy()
        if words:
            lang, said = table["lang"].to_numpy(), table["word"].cast(pa.large_string()).combine_chunks()
            known = {k: (said.filter(pa.array(lang == k)), ids[lang == k]) for k in set(lang.tolist())}
        else:
            known = (table["code"].to_numpy(), ids)
        sent = names.sparkSession.sparkContext.broadcast(known)

        def looked_up(row, asked):
            if words:
                said, ids = sent.value.get(row["lang"].as_py(), (pa.array([], pa.large_string()), np.zeros(0, np.int64)))
                at = pc.fill_null(pc.index_in(asked.cast(pa.large_string()), value_set=said), -1).to_numpy(zero_copy_only=False)
                return np.append(ids, _NONE)[at]
            codes, ids = sent.value
            want = asked[0] * np.int64(span) + asked[1]
            at = np.searchsorted(codes, want)
            here = np.append(codes, _NONE)[at] == want
            return np.where(here, np.append(ids, _NONE)[at], _NONE)

        return materialise(chunks.mapInArrow(lambda batches: sequences(batches, looked_up), _SEQUENCES), label)

    items = _of_words(chunks) if words else _own_pairs(chunks, span)
    own = items.join(names.select("id", *keys), keys).groupBy("chunk").agg(F.collect_list("nth").alias("nth"), F.collect_list("id").alias("ids"))
    joined = chunks.join(own, "chunk", "left")  # a chunk's own pairs, as many as it has places

    def given(row, asked):
        at = np.arange(len(asked)) if words else _distinct(*asked, span, fused)[3]
        ids = np.full(at.max() + 1 if len(at) else 0, _NONE)
        if row["nth"].is_valid:
            ids[row["nth"].values.to_numpy()] = row["ids"].values.to_numpy()
        return ids[at]

    return materialise(joined.mapInArrow(lambda batches: sequences(batches, given), _SEQUENCES), label)


def _parents(names: DataFrame, span: int) -> DataFrame:
    """id, l, r and f: a pair's halves by their names."""
    return names if span >= MOST_FUSED else names.select("id", F.expr(f"code div {span}").alias("l"), F.expr(f"code % {span}").alias("r"), "f")


def _handed_down(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Names of a level with phrase, last word, and counts of their first and last words (``pre`` and ``suf``, by number of words)."""
    left = below.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("begin"), "pre")
    right = below.select(F.col("id").alias("r"), "last", "suf")
    rows = pairs.join(left, "l").join(right, "r")
    grown = lambda c: F.array_append(c, F.col("f"))
    return rows.select("id", "lang", "l", "r", "f", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", grown("pre").alias("pre"), grown("suf").alias("suf"))


def _scored(level: DataFrame, above: DataFrame | None, size: int) -> DataFrame:
    """lang, phrase, a, l, r, score of a level's candidates that no longer one subsumes.

    A longer one's own subphrases occur as often as it does, so the next level's pairs tell of all levels.
    """
    exact = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, size):
        l, r = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(size - k - 1))
        score = F.call_function("div", exact(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)"), exact(l) + exact(r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    rows = level.withColumn("cut", F.array_min(F.array(*cuts)))
    if above is not None:
        held = above.select(F.col("l").alias("id"), "f").union(above.select("r", "f")).groupBy("id").agg(F.max("f").alias("longer"))
        rows = rows.join(held, "id", "left").filter(F.coalesce(exact(F.col("longer")) * 100 < exact(F.col("f")) * SUBSUMES, F.lit(True)))
    return rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def _levels(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """n by language, and the names of each level with what is handed down to them; all of it is written."""
    seqs = materialise(chunked(docs, lang_col, text_col), "chunks")
    many = F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")
    totals = materialise(seqs.groupBy("lang").agg(many), "totals")
    items, keys, span, levels = _of_words(seqs), ["lang", "word"], 0, []
    for size in range(1, LONGEST + 1):
        names = _named(items, keys, f"names-{size}")
        if size == 1:
            levels.append(names.select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf")))
        else:
            levels.append(materialise(_handed_down(_parents(names, span), levels[-1]), f"level-{size}"))
        if size < LONGEST:
            was, seqs = seqs, _encoded(seqs, names, keys, span, f"sequences-{size}")
            drop(was)
            span = max(1, names.count())
            items, keys = _totals(seqs, span), _key_names(span)
    return totals, levels


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the LISTED best phrases of each language, by score, count and phrase.

    n counts the language's words. Null languages are ``und``; null and empty texts have no words;
    repeated rows each count; an empty table gives an empty result. Other columns aren't read. A text of
    any length is one sequence, held by one task with some hundred bytes for each of its words.
    """
    with sent_at_once(docs.sparkSession, BATCH):
        totals, levels = _levels(docs, lang_col, text_col)
    found = None
    for size in range(2, LONGEST + 1):
        one = _scored(levels[size - 1], levels[size] if size < LONGEST else None, size)
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Each task keeps its own first LISTED of a language before any row is sent.
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LISTED)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
