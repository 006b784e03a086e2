"""Quality rules whose thresholds follow the data, by language and source.

Measures of each text are taken once. Each measure is a whole number, kept in a mergeable sketch:
counts by log-linear bin, where a value keeps its six leading bits, so a quantile is known within
1/32 of itself. Sketches are sums, so those of a language, or of everything, are sums of sketches,
whatever the order of merging. A group's fences come from its quantiles, shrunk towards those of its
language and of all documents as if these were some documents more; documents are joined with the
fences of their group and filtered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.llm.tokens import in_slices
from lamellar.sources.storage import materialise

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
#: Words in a window for repetition.
WINDOW = 8
#: A measure's name, and the least spread its fences assume.
MEASURES = {"symbol_rate": 20, "dup_line_rate": 50, "repeat_rate": 50, "word_length": 50}
#: Weight, in documents, of a language's fences in those of a group, and of all documents' in a language's.
PRIOR_DOCS = 200
#: Fences lie this many spreads outside the tenths.
SPREADS = 3
#: Fences of at most so many groups (about 100 bytes each) are broadcast; beyond, the join is salted.
MOST_BROADCAST, SALTS = 200_000, 32

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that the text has twice or more, the first time included."""
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = sum(h[k : k + windows] * _POWERS[k] for k in range(WINDOW))
    ranked = np.sort(code)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice)).tolist()  # equal windows have equal codes; now the words themselves
    exact = [tuple(words[i : i + WINDOW]) for i in at]
    count = Counter(exact)
    inside = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, exact, strict=True):
        if count[w] > 1:
            inside[i] += 1
            inside[i + WINDOW] -= 1
    return int((np.cumsum(inside) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at ASCII white space alone
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] * bool(words)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = np.array([measure(t or "") for t in batch.column("text").to_pylist()], dtype=np.int64)
            cols = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in found.T)], names=names)

    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names[3:]))


def _binned(value: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    unit = F.pow(F.lit(2.0), low).cast("long")
    return value - value % unit


def _values() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    per = {
        "symbol_rate": (1000, "n_symbols", F.greatest("word_chars", F.lit(1))),
        "dup_line_rate": (1000, "n_dup_lines", lines),
        "repeat_rate": (1000, "n_repeat_words", words),
        "word_length": (100, "word_chars", words),
    }
    return {k: F.floor(F.lit(m) * F.col(n) / d).cast("long") for k, (m, n, d) in per.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: counts of the base's passing documents."""
    kinds = F.array(*(F.struct(F.lit(k).alias("measure"), _binned(v).alias("bin")) for k, v in _values().items()))
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(kinds).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its size and, for each measure, low and high."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("size", F.sum("n").over(group))
    tenth = lambda k: F.min(F.when(F.col("upto") * 10 >= F.col("size") * k, F.col("bin")))
    q = upto.groupBy(*keys, "measure").agg(F.max("size").alias("size"), tenth(1).alias("q1"), tenth(5).alias("q5"), tenth(9).alias("q9"))
    least = F.create_map(*(x for k, v in MEASURES.items() for x in (F.lit(k), F.lit(v))))[F.col("measure")]
    q = q.withColumn("low", F.col("q1") - SPREADS * F.greatest(F.col("q5") - F.col("q1"), least))
    q = q.withColumn("high", F.col("q9") + SPREADS * F.greatest(F.col("q9") - F.col("q5"), least))
    pick = lambda side, k: F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}")
    return q.groupBy(*keys).agg(F.max("size").alias("size"), *(pick(s, k) for k in MEASURES for s in ("low", "high")))


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences of every (lang, source), shrunk towards its language's, and these towards all documents', by PRIOR_DOCS."""
    sketch = materialise(sketches(measured), "sketches")
    sides = [f"{k}_{s}" for k in MEASURES for s in ("low", "high")]
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    own = _fences(sketch, ["lang", "source"])
    lang = named(_fences(sketch, ["lang"]), "l")
    every = named(_fences(sketch.withColumn("one", F.lit(1)), ["one"]), "e")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(every, F.lit(1) == F.col("e_one"), "left")

    def shrunk(size: str, own: Column, parent: Column) -> Column:
        return F.floor((F.col(size) * own + PRIOR_DOCS * parent) / (F.col(size) + PRIOR_DOCS))

    def chosen(c: str) -> Column:
        return shrunk("size", F.col(c), shrunk("l_size", F.col(f"l_{c}"), F.col(f"e_{c}"))).alias(c)

    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *map(chosen, sides))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row.

    Null text has no words and fails the base. Null language or source is a group of its own.
    Repeated rows are each judged, and counted in the sketches, alone. A table without passing
    documents has no fences, and nothing is kept. Only the four named columns are read.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measures(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base)
    rows = materialise(rows, "measures")
    fences = materialise(thresholds(rows), "fences")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    if fences.count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(fences), same, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        joined = salted.join(fences.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("salt") == F.col("g_salt")), "left")
    inside = F.lit(True)
    for k, v in _values().items():
        inside = inside & (v <= F.col(f"{k}_high"))
    inside = inside & (_values()["word_length"] >= F.col("word_length_low"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
