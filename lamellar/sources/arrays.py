"""Array files as voxel tables: chunked arrays (zarr version 2) and .npy files.

Files are read by Spark, so they may be in any store that it reads; a chunk is decoded by the task
that has it. Pickled graphs are not read: unpickling runs code. Keep skeletons as node and edge tables.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.operators.quality import one_of
from lamellar.sources.storage import read_text

AXES = ("x", "y", "z", "c")


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _lz4(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="lz4_raw", asbytes=True)


#: Fixed values of the container's format: bits of its flags, numbers of its inner codecs, and when a block is split by byte.
_SHUFFLED, _STORED, _BITS, _WHOLE = 0x01, 0x02, 0x04, 0x10
_LZ4, _ZLIB, _ZSTD = 1, 3, 4
_MOST_SPLITS, _LEAST_SPLIT = 16, 128


def _blosc(raw: bytes) -> bytes:
    """Content of a Blosc container: blocks, each split by byte of the items or whole, bytes shuffled or not."""
    flags, item = raw[2], raw[3]
    size, block, _ = struct.unpack_from("<III", raw, 4)
    if flags & _STORED:
        return raw[16 : 16 + size]
    kind = flags >> 5
    if flags & _BITS or kind not in (_LZ4, _ZLIB, _ZSTD):
        raise NotImplementedError(f"Blosc with flags {flags}")
    out = []
    for k, start in enumerate(struct.unpack_from(f"<{-(-size // block)}i", raw, 16)):
        here = min(block, size - k * block)
        parts = item if not flags & _WHOLE and here == block and item <= _MOST_SPLITS and block // item >= _LEAST_SPLIT else 1
        content = []
        for _ in range(parts):
            (n,) = struct.unpack_from("<i", raw, start)
            piece, start = raw[start + 4 : start + 4 + n], start + 4 + n
            plain = here // parts
            content.append(piece if n == plain else _lz4(piece, plain) if kind == _LZ4 else zlib.decompress(piece) if kind == _ZLIB else _zstd(piece))
        joined = b"".join(content)
        if flags & _SHUFFLED and item > 1:
            many = here // item
            rows = np.frombuffer(joined, np.uint8, many * item).reshape(item, many)
            joined = rows.T.tobytes() + joined[many * item :]
        out.append(joined)
    return b"".join(out)


#: By the compressor's name in the array's metadata.
_DECODERS = {
    None: lambda raw: raw,
    "zlib": zlib.decompress,
    "gzip": gzip.decompress,
    "bz2": bz2.decompress,
    "lzma": lzma.decompress,
    "zstd": _zstd,
    "lz4": lambda raw: _lz4(raw[4:], struct.unpack_from("<I", raw)[0]),
    "blosc": _blosc,
}


def _decode(raw: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind not in _DECODERS:
        raise NotImplementedError(f"compressor {kind}")
    return _DECODERS[kind](raw)


def _rows(a: np.ndarray, origin: tuple[int, ...], shape: tuple[int, ...], value: str) -> pa.RecordBatch:
    clipped = a[tuple(slice(0, n - o) for n, o in zip(shape, origin, strict=True))]
    at = np.indices(clipped.shape).reshape(clipped.ndim, -1)
    cols = [pa.array(at[k] + origin[k], pa.int64()) for k in range(clipped.ndim)]
    flat = clipped.reshape(-1)
    flat = flat.astype(np.float64 if flat.dtype.kind == "f" else np.int64)
    return pa.RecordBatch.from_arrays([*cols, pa.array(flat)], names=[*AXES[: clipped.ndim], value])


def _schema(ndim: int, kind: str, value: str) -> str:
    return ", ".join(f"{a} long" for a in AXES[:ndim]) + f", {value} {'double' if kind == 'f' else 'long'}"


def read_zarr(spark: SparkSession, path: str, value: str = "val") -> DataFrame:
    """Coordinates and value of every element of a version 2 array with '.' or '/' between chunk numbers.

    Missing chunks hold the fill value and give no rows. Unsigned 64-bit values must fit a long.
    """
    meta = json.loads(read_text(spark, f"{path}/.zarray"))
    shape, chunk = tuple(meta["shape"]), tuple(meta["chunks"])
    dtype, order, compressor = np.dtype(meta["dtype"]), meta.get("order", "C"), meta.get("compressor")
    ndim = len(shape)
    numbers = r"(\d+(?:[./]\d+){%d})\z" % (ndim - 1)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column("at").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = np.frombuffer(_decode(raw, compressor), dtype).reshape(chunk, order=order)
                yield _rows(a, tuple(int(i) * c for i, c in zip(at.replace("/", ".").split("."), chunk, strict=True)), shape, value)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.withColumn("at", F.regexp_extract("path", numbers, 1)).filter("at <> ''").select("at", "content")
    return files.mapInArrow(decode, _schema(ndim, dtype.kind, value))


def read_samples(spark: SparkSession, samples: dict[str, str], image: str = "volumes/raw", labels: str = "volumes/labels/neuron_ids") -> DataFrame:
    """sample, coordinates, raw and seg of several arrays' folders by name, image and labels joined by place.

    A place that only one of both has gets a null for the other.
    """
    out = None
    for name, path in sorted(samples.items()):
        raw, seg = read_zarr(spark, f"{path}/{image}", "raw"), read_zarr(spark, f"{path}/{labels}", "seg")
        both = raw.join(seg, [a for a in AXES if a in raw.columns and a in seg.columns], "full")
        one = both.withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no samples")
    return out


def read_npy(spark: SparkSession, path: str, dtype: str, ndim: int = 3, value: str = "val") -> DataFrame:
    """Coordinates and value of every element of each .npy file, one task per file."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                for lo in range(0, a.shape[0], 16):
                    yield _rows(a[lo : lo + 16], (lo, *[0] * (a.ndim - 1)), a.shape, value)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, _schema(ndim, np.dtype(dtype).kind, value))


def seeds(paths: DataFrame, rule: str = "contains") -> DataFrame:
    """Names in order, by one of three rules: containing 'seed', beginning with it, or ending with '.zarr'."""
    fits = {"contains": F.contains("name", F.lit("seed")), "starts": F.startswith("name", F.lit("seed")), "zarr": F.endswith("name", F.lit(".zarr"))}
    return paths.filter(fits[one_of("rule", rule, tuple(fits))]).orderBy("name")


def first_seed(paths: DataFrame, rule: str = "contains") -> DataFrame:
    """The first name in order, without sorting all."""
    return seeds(paths, rule).agg(F.min("name").alias("name"))
