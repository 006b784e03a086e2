"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations.

A benchmark item gives windows of ten words, and a window shingles of three. An exact occurrence holds
every shingle of the window, so of each window's shingles, ordered by rarity in the corpus, the first is
a prefix that suffices: documents' shingles are joined with the windows' rarest ones. A match fixes
where the window would begin; length and positional bounds drop those that can't fit, and the words
there are compared with the window's. The corpus is read twice, to count shingles and to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.sources.storage import materialise

#: Words: characters that are digits, ASCII letters, or not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shingle; a window of fewer is one shingle.
SHINGLE = 3
#: Windows whose numbers are broadcast at once (40 bytes each); more are taken in blocks, each against all documents.
BLOCK = 1_000_000
#: Shingles that are broadcast to be counted (8 bytes each); more are joined by shuffle.
MOST_COUNTED = 5_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _plain(words: Column) -> Column:
    """Words in a row with A-Z lower-cased, the form that is compared."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def _shingle(at) -> Column:
    """The number of a shingle; ``at(i)`` is its i-th word, null behind the last. All cases count as one here."""
    return F.xxhash64(*(F.lower(at(i)) for i in range(SHINGLE)))


def item_windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: window, size, words, items that have it."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), _words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("w"))
    rows = rows.select("item_id", _plain(F.col("w")).alias("window"))
    rows = rows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    return rows.withColumn("words", F.split("window", " ")).withColumn("size", F.size("words"))


def _of_documents(docs: DataFrame, sizes: list[int], pos: Column) -> DataFrame:
    """Documents' shingles of the given sizes at each place; ``pos`` gives the places from the words ``w``."""
    rows = docs.select("doc_id", "text", _words(F.col("text")).alias("w")).select("doc_id", "text", "w", F.explode(pos).alias("pos"))
    word = lambda i: F.get("w", F.col("pos") + i)

    def of(size: int) -> Column:
        number = _shingle(lambda i: word(i) if i < size else F.lit(None).cast("string"))
        return F.when((F.col("pos") >= 0) & (F.col("pos") + size <= F.size("w")), number)

    if len(sizes) == 1:
        return rows.withColumn("shingle", of(sizes[0]))
    none = F.array(F.lit(None).cast("long"))
    return rows.withColumn("shingle", F.explode(F.when(F.col("pos") < 0, none).otherwise(F.array(*map(of, sizes)))))


def _anchors(windows: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """number (of the window), size, place and shingle: the window's rarest in the corpus; ties go to the first place."""
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))
    listed = windows.select("window", "size", "words", F.explode(places).alias("place"))
    shingle = _shingle(lambda i: F.get("words", F.col("place") + i))
    listed = materialise(listed.select(F.xxhash64("window").alias("number"), "size", "place", shingle.alias("shingle")), "shingles")
    wanted = listed.select("shingle").distinct()
    if wanted.count() <= MOST_COUNTED:
        wanted = F.broadcast(wanted)
    everywhere = F.sequence(F.lit(-1), F.coalesce(F.size("w"), F.lit(0)) - 1)
    counts = _of_documents(docs, sizes, everywhere).select("shingle").join(wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("r")
    best = listed.join(counts, "shingle", "left").groupBy("number", "size").agg(rarest)
    return materialise(best.select("number", "size", "r.place", "r.shingle"), "anchors")


def _occurrences(docs: DataFrame, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, key (of the text), n_words, start, size, window: a row for each document, with its number of words, and for each place where a window's words stand.

    Shingles go through the join one by one within a stage; the text's own words are looked at for the few that
    match and never leave the stage. Places begin at -1, which stands for the document itself.
    """
    words = F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0))
    said = _of_documents(docs, sizes, F.sequence(F.lit(-1), words - 1)).withColumn("n_words", words)
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("size") <= F.size("w"))
    window = F.when(fits, _plain(F.slice("w", start + 1, F.col("size"))))
    rows = said.join(F.broadcast(anchors), "shingle", "left").filter("pos < 0 or number is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "pos", "n_words", start.alias("start"), "size", "number", window.alias("window"))
    return rows.filter("pos < 0 or xxhash64(window) = number").select("doc_id", "key", "n_words", "start", "size", "window")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and key (a hash of the text) for every row.

    Null and empty texts have no words. Items without words have no windows; an item with a null id
    marks words but isn't listed. Repeated rows get the same result each; equal ids with different
    texts are kept apart. Benchmarks of more than BLOCK windows are taken in blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = materialise(item_windows(items, item_col, item_text_col), "windows")
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]  # SHINGLE at most
    anchors = _anchors(windows, rows, sorted(sizes))
    blocks = max(1, -(-windows.count() // BLOCK))
    found = None
    for k in range(blocks):
        hits = _occurrences(rows, anchors.filter(F.pmod(F.col("number"), F.lit(blocks)) == k), sorted(sizes))
        hits = hits if not k else hits.filter("window is not null")  # each document once
        found = hits if found is None else found.union(hits)
    found = materialise(found, "occurrences")
    base = found.filter("window is null").select("doc_id", "key", "n_words")
    found = found.filter("window is not null").join(windows.select("window", "items"), "window")  # of equal words, not numbers alone
    last = F.col("start") + F.col("size") - 1
    places = found.select("doc_id", "key", F.explode(F.sequence("start", last)).alias("at")).distinct()
    hit = places.groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "key", F.explode("items").alias("item")).distinct()
    listed = F.sort_array(F.collect_list(F.col("item").cast("string")))
    named = named.groupBy("doc_id", "key").agg(listed.alias("listed"))
    marks = hit.join(named, (hit.doc_id.eqNullSafe(named.doc_id)) & (hit.key == named.key), "left").select(
        hit.doc_id.alias("m_doc"), hit.key.alias("m_key"), "n_hit", "listed"
    )
    joined = base.join(marks, base.doc_id.eqNullSafe(marks.m_doc) & (base.key == marks.m_key), "left")
    items_of = F.coalesce("listed", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "key",
    )
