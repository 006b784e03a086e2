"""Codecs of array chunks, nested arrays by sample, and graphs from tables."""

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lamellar.sources import arrays, graphs


def blosc(data, item, block, kind, shuffled):
    """A container as the format describes it."""
    starts, body = [], b""
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    for b in blocks:
        starts.append(16 + 4 * len(blocks) + len(body))
        many = len(b) // item
        if shuffled:
            b = np.frombuffer(b, np.uint8, many * item).reshape(many, item).T.tobytes() + b[many * item :]
        parts = item if len(b) == block and block // item >= 128 and item <= 16 else 1
        for k in range(parts):
            plain = b[k * len(b) // parts : (k + 1) * len(b) // parts]
            packed = zlib.compress(plain) if kind == 3 else pa.compress(plain, codec={1: "lz4_raw", 4: "zstd"}[kind], asbytes=True)
            packed = packed if len(packed) < len(plain) else plain
            body += struct.pack("<i", len(packed)) + packed
    flags = kind << 5 | shuffled
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, 16 + 4 * len(blocks) + len(body)) + struct.pack(f"<{len(blocks)}i", *starts) + body


@pytest.mark.parametrize("kind", [1, 3, 4])
@pytest.mark.parametrize("shuffled", [0, 1])
def test_blosc(kind, shuffled):
    rng = np.random.default_rng(kind)
    for item, many, block in ((4, 1000, 1024), (2, 777, 512), (8, 50, 4096), (1, 900, 300)):
        data = (rng.integers(0, 5, many * item).astype(np.uint8)).tobytes()
        assert arrays._decode(blosc(data, item, block, kind, shuffled), {"id": "blosc"}) == data
    assert arrays._blosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 3, 3, 19) + b"abc") == b"abc"
    with pytest.raises(NotImplementedError):
        arrays._blosc(struct.pack("<BBBBIII", 2, 1, 4, 4, 3, 3, 19) + b"abc")


def test_other_codecs():
    data = b"some bytes " * 50
    packed = struct.pack("<I", len(data)) + pa.compress(data, codec="lz4_raw", asbytes=True)
    assert arrays._decode(packed, {"id": "lz4"}) == data
    with pytest.raises(NotImplementedError):
        arrays._decode(data, {"id": "other"})


def write(path, a, compressor):
    path.mkdir(parents=True)
    (path / ".zarray").write_text(json.dumps({"shape": a.shape, "chunks": a.shape, "dtype": a.dtype.str, "order": "C", "compressor": compressor, "zarr_format": 2, "fill_value": 0}))
    raw = a.tobytes()
    (path / "0.0.0").write_bytes(blosc(raw, a.dtype.itemsize, 1 << 16, 1, 1) if compressor else raw)


def test_nested_arrays_by_sample(spark, tmp_path):
    want = {}
    for k, name in enumerate(("a", "b")):
        raw, seg = np.arange(60, dtype="<u2").reshape(3, 4, 5) + k, np.arange(60, dtype="<i8").reshape(3, 4, 5) % 7
        write(tmp_path / name / "volumes" / "raw", raw, {"id": "blosc"})
        write(tmp_path / name / "volumes" / "labels" / "neuron_ids", seg, None)
        want |= {(name, x, y, z): (int(raw[x, y, z]), int(seg[x, y, z])) for x in range(3) for y in range(4) for z in range(5)}
    df = arrays.read_samples(spark, {n: str(tmp_path / n) for n in ("a", "b")})
    assert {(r.sample, r.x, r.y, r.z): (r.raw, r.seg) for r in df.collect()} == want
    with pytest.raises(ValueError):
        arrays.read_samples(spark, {})
    with pytest.raises(ValueError, match="rule"):
        arrays.seeds(spark.createDataFrame([("a",)], "name string"), "all")


def test_graph_tables(spark, tmp_path):
    nodes = [(1, 5, 0, 0, 0, 0.0, 0.0, 0.0), (2, 5, 1, 0, 0, 9.0, 0.0, 0.0), (3, 6, 1, 1, 1, 9.0, 9.0, 20.0)]
    spark.createDataFrame(nodes, graphs.NODES).write.option("header", True).csv(str(tmp_path / "n"))
    spark.createDataFrame([(1, 2), (2, 3), (3, 99), (None, 1)], "u long, v long").write.option("header", True).csv(str(tmp_path / "e"))
    n, e = graphs.read_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"), "csv", header=True)
    assert sorted(map(tuple, n.collect())) == nodes and e.count() == 4
    from pyspark.sql import functions as F

    got = sorted(map(tuple, graphs.labelled_edges(n.withColumn("seg", F.col("node") * 10), e).collect()))
    assert got == [(5, 1, 2, 10, 20, 9.0), (5, 2, 3, 20, 30, math.sqrt(81 + 400))]


def test_logs_of_text_and_images(spark, tmp_path):
    from lamellar.sources import sinks

    text = spark.createDataFrame([("r", "note", 1, "hello"), ("r", "note", 2, None)], "run string, tag string, step long, text string")
    image = spark.createDataFrame([("a", 1, 0, 0, 0, 1.5), ("b", 1, 0, 1, 0, -0.5), ("b", 1, 1, 1, 0, 0.25)], "tag string, step long, i long, j long, c int, value double")
    for _ in range(2):
        sinks.append_text(text, str(tmp_path / "text"))
        sinks.append_images(image, str(tmp_path / "images"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "text")).collect()] == ["hello"] * 2
    assert sorted((r.tag, r.value) for r in spark.read.parquet(str(tmp_path / "images")).collect()) == [("a", 1.0)] * 2 + [("b", 0.0)] * 2 + [("b", 0.25)] * 2


def test_a_configuration_from_any_store(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    from lamellar.operators import sweep

    (tmp_path / "c.yaml").write_text("params:\n  seed: [0, 1]\n  save_path: [/tmp]\n")
    assert sweep.load_config(spark, f"file://{tmp_path}/c.yaml") == yaml.safe_load((tmp_path / "c.yaml").read_text())
