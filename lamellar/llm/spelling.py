"""Spelling variants: words one edit apart, found by bands of a bitmask of letter parities.

A word's mask has, for each letter, whether it occurs an odd number of times. One inserted, deleted or
replaced letter flips two bits at most, so of three bands of the mask one at least is equal. As one
edit also leaves the first or the last half of a word as it was, a key is a band, its bits, and
that half's letters; the halves are those of the shorter length, which is part of the key and so filters
lengths. Pairs that meet are compared by masks, then by edit distance, and count at the first key they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.sources.storage import drop, materialise

#: Letters of a word: ASCII ones, and those (with two signs) of the Latin-1 block.
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least, and how many times as frequent a form is.
SHORTEST, LEAST, TIMES = 7, 2, 10
#: A run whose number this divides loses a code point: planted misspellings, by which the operator is judged.
SPOILT = 31
BANDS = 3


def _spoilt(id_text: Column, run: Column) -> Column:
    """The run as it counts: of one run in SPOILT, by hash of document and run, a code point is left out."""
    number = F.crc32(F.concat(id_text, F.lit(":"), run))
    at = (number % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(number % SPOILT == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of SHORTEST code points and LEAST occurrences or more, over all documents.

    Only A-Z are lower-cased. Null and empty texts have no words; a null id counts as an empty one;
    repeated rows each count.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{SHORTEST},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = rows.select(_spoilt(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


def _mask(word: Column) -> Column:
    """Bit of each letter's parity; two letters may share a bit, and one edit still flips two at most."""
    bit = lambda c: F.pmod(F.ascii(c) - F.when(F.ascii(c) < 128, F.lit(97)).otherwise(F.lit(0xC0 - 26)), F.lit(64))
    one = lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(one(m, c)))


def _band(bits: Column, band: int) -> Column:
    """Every third bit of a mask."""
    chosen = sum(1 << i for i in range(band, 64, BANDS))
    return bits.bitwiseAND(F.lit(chosen - (1 << 64) if chosen >> 63 else chosen))


def _halves(word: Column, least: Column) -> list[Column]:
    """The first and last letters of which one edit leaves one as it was, in words of ``least`` and one more."""
    half = F.floor(least / 2).cast("int")
    return [F.substring(word, F.lit(1), half), F.substring(word, F.length(word) - (least - half) + 1, least - half)]


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, mask, least, side, band, key: a row for each of two shorter lengths, halves and bands."""
    rows = words.select("word", "n", _mask(F.col("word")).alias("mask"))
    rows = rows.withColumn("least", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    halves = _halves(F.col("word"), F.col("least"))
    keys = F.array(
        *(
            F.struct(F.lit(side).alias("side"), F.lit(b).alias("band"), F.xxhash64(F.lit(side), F.lit(b), "least", half, _band(F.col("mask"), b)).alias("key"))
            for side, half in enumerate(halves)
            for b in range(BANDS)
        )
    )
    return rows.select("word", "n", "mask", "least", F.explode(keys).alias("k")).select("word", "n", "mask", "least", "k.side", "k.band", "k.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb with a before b: pairs of words (word, n) with an edit distance of one, each once."""
    keyed = _keyed(words)
    a, b = keyed.alias("a"), keyed.alias("b")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    equal = lambda band: _band(flips, band) == 0
    first_band = F.when(equal(0), 0).when(equal(1), 1).otherwise(2)
    same_start = _halves(F.col("a.word"), F.col("a.least"))[0] == _halves(F.col("b.word"), F.col("b.least"))[0]
    meets = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.least") == F.col("b.least"))
        & (F.col("a.side") == F.col("b.side"))
        & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.word") < F.col("b.word"))
        # Two words that are both longer than ``least`` meet at their own length.
        & ((F.length("a.word") == F.col("a.least")) | (F.length("b.word") == F.col("b.least")))
        & (F.bit_count(flips) <= 2)
        & (F.col("a.band") == first_band)
        & ((F.col("a.side") == 0) | ~same_start)
        & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    )
    return a.join(b, meets).select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: pointers are doubled until none moves. A chain's counts grow, so it ends."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(up, "root", "left")
        after = materialise(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = after
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``word_counts``.

    A word's form is its near word of most occurrences, of equal ones the first in order of code points,
    if that has TIMES its own or more; else null. The root is the last of the chain of forms. An empty table
    gives an empty result; other columns aren't read.
    """
    words = materialise(word_counts(docs, id_col, text_col), "words")
    pairs = materialise(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    takes = -F.col("best.less") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "forms")
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
