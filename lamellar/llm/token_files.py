"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout of a dataset folder, for each partition ``p`` in document order:

``part-p.ids``   ids, little-endian, 2 bytes each if the vocabulary has at most 65,536 ids, else 4
``part-p.off``   int64, one more than documents: first id of each document within the partition
``part-p.doc``   int64, the document ids in order; null ids come first and are stored as 0
``manifest.json`` for each partition its documents, null ids, ids and *base*: all ids before it

The base is a prefix sum over the partitions' totals, so no task needs another task's data.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm.tokens import ENCODE_AT_ONCE, Encoder, in_slices
from lamellar.sources.storage import fresh_dir


#: Documents of a file that are read at once.
READ_DOCS = 10_000


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _writer(tokenizer: str, end_id: int, dtype: str, out: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = pafs.FileSystem.from_uri(out)
        encoder = Encoder(tokenizer, drops_space=False)
        names = {k: f"{root}/part-{part:06d}.{k}" for k in ("ids", "off", "doc")}
        sizes, docs, nulls = [0], [], 0
        held = {k: store.open_output_stream(f"{v}.{attempt}") for k, v in names.items()}
        for rows in in_slices(batches, most=ENCODE_AT_ONCE):
            ids, at = encoder.encode(rows.column("text"))
            ids = np.insert(ids, at[1:], end_id).astype(dtype)
            held["ids"].write(ids.tobytes())
            sizes.extend((np.diff(at) + 1).tolist())
            docs.extend(rows.column("id").fill_null(0).to_pylist())
            nulls += rows.column("id").null_count
        offsets = np.cumsum(np.array(sizes, dtype="<i8"))
        held["off"].write(offsets.tobytes())
        held["doc"].write(np.array(docs, dtype="<i8").tobytes())
        for k, v in names.items():
            held[k].close()
            store.move(f"{v}.{attempt}", v)  # a repeated attempt replaces whole files
        row = {"part": [part], "docs": [len(docs)], "nulls": [nulls], "ids": [int(offsets[-1])]}
        yield pa.RecordBatch.from_pydict(row)

    return write


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[dict]:
    """Encode all documents and write them in ascending id order; returns the manifest.

    One shuffle, by ranges of the id. Null text is empty, so such a document has the end id alone.
    Null ids sort first; rows with equal ids are all kept, in order of their text. An empty table
    gives an empty dataset. Other columns are not read.
    """
    dtype = _width(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # By the beginning of the text too, so that rows with no id or one id are dealt as well; the order is the same.
    rows = rows.repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    done = rows.mapInArrow(_writer(tokenizer, end_id, dtype, out), "part long, docs long, nulls long, ids long")
    parts, base = [], 0
    for r in sorted(done.collect(), key=lambda r: r.part):  # a row for each partition
        if r.docs:
            parts.append({**r.asDict(), "base": base})
            base += r.ids
    store, root = pafs.FileSystem.from_uri(out)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "parts": parts}).encode())
    return parts


class _Stored:
    """A file of numbers in another store than the local one, of which slices are read."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __getitem__(self, part: slice) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), dtype=self.dtype)


def _open(store, path: str, dtype: str, n: int) -> np.ndarray | _Stored:
    """Memory-mapped where the store is local; else each slice is one read of its bytes alone."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", shape=(n,))
    return _Stored(store.open_input_file(path), dtype)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    store, root = pafs.FileSystem.from_uri(out)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{root}/part-{p['part']:06d}"
                off = _open(store, f"{name}.off", "<i8", p["docs"] + 1)
                doc = _open(store, f"{name}.doc", "<i8", p["docs"])
                ids = _open(store, f"{name}.ids", dtype, p["ids"])
                for lo in range(0, p["docs"], READ_DOCS):
                    hi = min(lo + READ_DOCS, p["docs"])
                    at = np.asarray(off[lo : hi + 1])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    mask = np.arange(lo, hi) < p["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc[lo:hi]), mask=mask),
                            pa.array(at[:-1] + p["base"]),
                            pa.array(np.diff(at)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "part long, docs long, nulls long, ids long, base long"
    parts = spark.createDataFrame(manifest["parts"], schema)
    if manifest["parts"]:
        parts = parts.repartition(len(manifest["parts"]))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257) -> DataFrame:
    """Write ``docs`` to a new dataset in the shared folder and read it back."""
    out = fresh_dir(docs.sparkSession, "token-files")
    write_token_files(docs, out, tokenizer, end_id, vocabulary)
    return read_token_files(docs.sparkSession, out)
