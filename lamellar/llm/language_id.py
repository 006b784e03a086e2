"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter trigrams, weighted by TF-IDF and scaled to unit length. Each
language has a few centroids, from a deterministic spherical k-means over a bounded sample of its
labelled documents. A text takes the language of the centroid with the largest cosine. It is
rejected if it has no letter, or lies farther from its centroid than any training text of that
language and about that length, with some room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.llm.tokens import in_slices
from lamellar.sources.storage import materialise

#: Length of a vector, and vectors that are compared at once.
BUCKETS, AT_ONCE = 4096, 128
#: Labelled documents of a language that the classifier is fitted on, at most: those with the least hash of the id.
PER_LANGUAGE = 400
#: Shares in which the sample of a language is first looked for.
SHARES = 64
#: Centroids of a language, and rounds of k-means.
CENTROIDS, ROUNDS = 3, 8
#: A text may have this part of the least cosine that training texts of its length have.
ROOM = 0.5
#: Training texts of about one length that are needed for a limit of their own.
LEAST_SEEN = 5

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Counts by bucket, and the number of letters. Other characters separate words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    many = int(np.count_nonzero(letter))
    if not many:
        return np.zeros(BUCKETS, np.int64), 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each run of letters
    c = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint32)
    h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    return np.bincount(h >> np.uint32(20), minlength=BUCKETS), many


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length."""
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _band(letters: np.ndarray) -> np.ndarray:
    """Texts of about one length: the power of two."""
    return np.log2(np.maximum(letters, 1)).astype(np.int64)


def _clustered(x: np.ndarray) -> np.ndarray:
    """Spherical k-means that starts from the row nearest to the mean, then the farthest rows."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(CENTROIDS, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def fit(labelled: DataFrame) -> dict:
    """The model from rows (doc_id, text, lang): names, centroids, idf and limits by length.

    The sample is bounded by PER_LANGUAGE; its vectors stay on the executors, a language's in one
    task. The driver gets the document frequencies and, for each language, its centroids and limits.
    """
    ids = labelled.select("doc_id", "lang").filter("lang is not null and doc_id is not null").distinct()
    # First within a share of a language, so that at most SHARES * PER_LANGUAGE rows of it meet.
    ids = ids.withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        first = W.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= PER_LANGUAGE).drop("nth")
    ids = ids.select("doc_id", "lang")
    ids = materialise(ids, "lang-sample")
    # Bounded by PER_LANGUAGE times the languages, some 100,000 ids at the most.
    rows = labelled.join(F.broadcast(ids), ["doc_id", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [trigrams(t or "") for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c) for c, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("lang"),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array(at, pa.list_(pa.int64())),
                    pa.array([c[i] for (c, _), i in zip(found, at, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "lang", "letters", "bucket", "times"],
            )

    schema = "doc_id long, lang string, letters long, bucket array<long>, times array<long>"
    sample = materialise(rows.select("doc_id", "lang", "text").mapInArrow(vectors, schema).filter("letters > 0"), "lang-vectors")
    df = {r.b: r.n for r in sample.select(F.explode("bucket").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    idf = np.zeros(BUCKETS, np.float32)
    total = sample.count()
    for b, n in df.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 1

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "letters"])
        x = np.zeros((len(frame), BUCKETS), np.float32)
        for i, (b, t) in enumerate(zip(frame.bucket, frame.times, strict=True)):
            x[i, b] = t
        x = _unit(x, idf)
        c = _clustered(x)
        best, band = (x @ c.T).max(axis=1), _band(frame.letters.to_numpy())
        limits, limit = [], 0.0
        for k in range(64):
            if (band == k).sum() >= LEAST_SEEN:
                limit = ROOM * float(best[band == k].min())
            limits.append(limit)
        return pd.DataFrame({"lang": frame.lang.iloc[0], "centroid": [v.tobytes() for v in c], "limits": [limits] * len(c)})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, limits array<double>").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    return {
        "names": [r.lang for r in found],
        "centroids": np.stack([np.frombuffer(r.centroid, np.float32) for r in found]) if found else np.zeros((0, BUCKETS), np.float32),
        "limits": np.array([r.limits for r in found]),
        "idf": idf,
    }


def _judged(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    names = np.array(model["names"], dtype=object)
    found = [trigrams(t or "") for t in texts]
    letters = np.array([n for _, n in found])
    if not len(names):
        return np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
    near = _unit(np.stack([c for c, _ in found]), model["idf"]) @ model["centroids"].T
    best = np.argmax(near, axis=1)
    score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
    none, far = letters == 0, score < model["limits"][best, _band(letters)]
    return np.where(none, "und", names[best]), np.where(none, 0.0, score), far | none


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row, from the whole text alone.

    Null text and text without a letter are ``und`` with score 0, and rejected; so is everything
    if nothing was learned. Equal cosines go to the first language in order of name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for lo in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(lo, AT_ONCE)
                lang, score, rejected = _judged(some.column("text").to_pylist(), model)
                cols = [some.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns and without a shuffle.

    Null text and text without a letter are rejected. Columns may have any names; repeated rows stay or
    go together; an empty table gives an empty result.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, f"c{at}"):
            for lo in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(lo, AT_ONCE)
                yield some.filter(pa.array(~_judged(some.column(at).to_pylist(), model)[2])).rename_columns(names)

    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text is divisible by five. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> dict:
    """The model from those of ``docs`` that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return fit(rows.filter(~held_out(F.col("doc_id"))))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected: learn from the documents that aren't held out; predict all.

    Repeated rows are each predicted, and a null id isn't held out but isn't learned from either. Null
    text and text without a letter are ``und``; a long text is counted whole. An empty table gives an
    empty result. Columns other than doc_id, text and lang aren't read.
    """
    out = classify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
