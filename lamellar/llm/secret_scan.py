"""Secret scan: three fixed patterns, and a log-likelihood ratio of two character Markov models.

The models are bigram tables over the characters of candidate runs: one of random strings, one of
ordinary identifiers, both from labelled samples. A run is a secret if its ratio is high enough, in
all and per character. All of it is DataFrame expressions: a run is scored by looking up its pairs
in a constant array; places come from the lengths of what lies between matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.sources.storage import materialise

#: The base patterns and the length of a match (of its second group for assign) they need.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: How every match of ASSIGN begins.
HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Kinds in the order of listing; the last two are the method's: whole runs, and parts of runs.
KINDS = ("assign", "access", "hex", "markov", "markov")
#: Runs that the models judge, outside base matches: characters between LOW and HIGH, of this class and length.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: Parts of a run between joining characters, judged where the whole run isn't random.
PART, JOINS = r"[A-Za-z0-9+]{16,}", r"[/_=-]"
LOW, HIGH = ord("+"), ord("z")
SPAN = HIGH - LOW + 1
#: A secret's ratio in nats: in all, and for each pair of characters.
LEAST_TOTAL, LEAST_EACH = 8.0, 0.4
#: Added to each pair's count, and the weight of a uniform next character, for pairs the samples lack.
SMOOTHING, UNIFORM = 0.5, 0.15
#: Documents whose words are the sample of ordinary identifiers, at most: those with the least hash of the id.
SAMPLE_DOCS = 2000
#: Random strings of each alphabet in the sample.
SAMPLE_RANDOM = 2000
ORDERED = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
#: Spans up to this many, 8 bytes each, are broadcast to be redacted; beyond, documents are shuffled to them.
MOST_BROADCAST = 2_000_000


def _codes(run: Column) -> Column:
    """Each character's number from LOW on, in one pass over the run."""
    return F.transform(F.split(run, ""), lambda c: F.ascii(c) - LOW)


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """run, secret: runs of random characters, and of a bounded sample of documents' words.

    Random strings are digests of numbers, as base 64 and as hexadecimal, so that they are the same
    every time. Ordinary runs are words without a base pattern's match, alone and joined as in
    identifiers.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("run"), F.col("id").cast("string")), 256)
    forms = F.array(F.substring(F.base64(F.unhex(digest)), 1, 40), F.substring(digest, 1, 40))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(forms).alias("run"), F.lit(True).alias("secret"))
    # Letters and digits in their order are no secret.
    ordered = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(*map(F.lit, ORDERED))).alias("run"), F.lit(False).alias("secret"))
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    ids = first.select("id").filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    # SAMPLE_DOCS ids at most, and one text of each, however many rows have it.
    rows = first.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    plain = F.array(F.filter(words, lambda w: ~w.rlike(HEX) & ~w.rlike(ACCESS)))
    pair = F.transform(plain, lambda a: F.transform(a, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(a, i + 1), w).alias("v"))))[0]
    word = rows.select(F.explode(pair).alias("p")).select("p.w", "p.v")
    forms = F.array("w", F.concat(F.lit("_"), "w", F.lit("-")), F.concat(F.lower("w"), F.initcap("v")), F.concat_ws("_", F.upper("w"), F.upper("v")))
    ordinary = word.select(F.explode(forms).alias("word"))
    return random.union(ordered).union(ordinary.select(F.col("word").alias("run"), F.lit(False).alias("secret")))


def fit(samples: DataFrame) -> list[float]:
    """The ratio of every pair of characters, SPAN * SPAN numbers, from rows (run, secret)."""
    run = F.col("run")
    pair = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(c, i) * SPAN + F.get(c, i + 1))
    at = F.transform(F.array(_codes(run)), pair)[0]  # bound to a name, so that the codes are made once
    pairs = samples.filter((F.length("run") > 1) & ~run.rlike(r"[^+-z]")).select("secret", F.explode(at).alias("pair"))
    table = pairs.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()  # 2 * SPAN * SPAN rows at most
    count = {True: [0] * (SPAN * SPAN), False: [0] * (SPAN * SPAN)}
    for r in table:
        count[r.secret][r.pair] = r.n
    logs = {}
    for secret, c in count.items():
        rows = [sum(c[a * SPAN : (a + 1) * SPAN]) for a in range(SPAN)]
        seen = [(c[i] + SMOOTHING) / (rows[i // SPAN] + SMOOTHING * SPAN) for i in range(SPAN * SPAN)]
        logs[secret] = [math.log((1 - UNIFORM) * p + UNIFORM / SPAN) for p in seen]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def ratio(run: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a run of candidate characters, in one pass whatever its length."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")  # folded to one constant

    def step(so_far: Column, code: Column) -> Column:
        pair = F.when(so_far.last >= 0, F.get(table, so_far.last * SPAN + code)).otherwise(0.0)
        return F.struct((so_far.total + pair).alias("total"), code.alias("last"))

    return F.aggregate(_codes(run), F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("last")), step, lambda s: s.total)


def is_random(run: Column, model: list[float]) -> Column:
    return ratio(run, model) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_EACH * (F.length(run) - 1))


_FOUND = "array<struct<kind:int,gap:int,len:int,keep:boolean,joined:boolean,nth:int>>"


def _matches(text: Column, kind: int, pattern: str, keep) -> Column:
    """Matches of a pattern in order: kind, characters before it since the last, its length, kept or not, with a joining character or not."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def one(s: Column) -> Column:
        return F.transform(
            s.m,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                F.length(F.get(s.g, i)).alias("gap"),
                F.length(x).alias("len"),
                keep(x).alias("keep"),
                (x.rlike(JOINS) if kind == 3 else F.lit(False)).alias("joined"),
                i.alias("nth"),
            ),
        )

    return F.transform(F.array(both), one)[0].cast(_FOUND)


def _blanked(text: Column, pattern: str, keep) -> Column:
    """The text with as many blanks in place of each match that is kept; ``keep`` takes the match and its number."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    one = lambda m, i: F.coalesce(F.when(keep(F.get(m, i), i), F.repeat(F.lit(" "), F.length(F.get(m, i)))).otherwise(F.get(m, i)), F.lit(""))
    return F.transform(F.array(both), lambda s: F.array_join(F.transform(s.g, lambda g, i: F.concat(g, one(s.m, i))), ""))[0]


def _found(rows: DataFrame, model: list[float]) -> DataFrame:
    """``rows`` with ``found``: all matches of those kinds that have one which is kept. The column ``s_text`` is read."""
    text = F.col("s_text")
    none = F.array().cast(_FOUND)
    yes = lambda x: F.lit(True)
    value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= ASSIGN_LEAST
    rows = rows.withColumns(
        {
            "s_assign": F.when(text.rlike(HINT), _matches(text, 0, ASSIGN, value)).otherwise(none),
            "s_access": F.when(F.contains(text, F.lit("AKIA")), _matches(text, 1, ACCESS, yes)).otherwise(none),
            "s_hex": F.when(text.rlike(HEX), _matches(text, 2, HEX, yes)).otherwise(none),
        }
    )
    clear = _blanked(_blanked(_blanked(text, ASSIGN, lambda x, i: value(x)), ACCESS, lambda x, i: F.lit(True)), HEX, lambda x, i: F.lit(True))
    any_base = F.size("s_assign") + F.size("s_access") + F.size("s_hex") > 0
    rows = rows.withColumn("s_clear", F.when(any_base, clear).otherwise(text))
    clear, runs = F.col("s_clear"), F.col("s_run")
    rows = rows.withColumn("s_run", F.when(clear.rlike(RUN), _matches(clear, 3, RUN, lambda x: is_random(x, model))).otherwise(none))
    rest = F.when(F.exists(runs, lambda x: x.keep), _blanked(clear, RUN, lambda x, i: F.get(runs, i).keep)).otherwise(clear)
    parts = F.when(F.exists(runs, lambda x: x.joined & ~x.keep), _matches(rest, 4, PART, lambda x: is_random(x, model))).otherwise(none)
    rows = rows.withColumn("s_part", parts)
    kinds = ["s_assign", "s_access", "s_hex", "s_run", "s_part"]
    held = [F.when(F.exists(F.col(k), lambda x: x.keep), F.col(k)).otherwise(none) for k in kinds]
    return rows.withColumn("found", F.concat(*held)).drop("s_text", "s_clear", *kinds)


def _spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end of every span, from the rows' matches; a row's own matches are the group of the window."""
    one = scanned.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("nth"))
    return one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).filter("keep").select("row", "kind", "start", "end")


def secret_scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row.

    Places are code points. Runs are looked for in what the base matches leave, first assign, then
    access, then hex being taken out; of a run that isn't random as a whole, its parts are judged. Null
    text is empty: no spans, and the digest of the empty string. Repeated rows and null ids are
    scanned like others; an empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("s_text"))
    # Written once, so that every later step sees the same row numbers; a row without matches is a few bytes.
    scanned = materialise(_found(rows.withColumn("row", F.monotonically_increasing_id()), model).select("row", "doc_id", "found"), "matches")
    names = F.array(*map(F.lit, KINDS))
    said = F.concat_ws(":", names[F.col("kind")], F.col("start"), F.col("end"))
    many = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{KINDS[k]}")
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", said.alias("said"))))
    by_row = _spans(scanned).groupBy("row").agg(many(0), many(1), many(2), listed.alias("listed"))
    joined = scanned.select("row", "doc_id").join(by_row, "row", "left")
    text_of = lambda a: F.coalesce(F.concat_ws(",", F.transform(a, lambda x: x.said)), F.lit(""))
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text_of(F.filter("listed", lambda x: x.kind < 3)), 256).alias("base_sha256"),
        text_of(F.col("listed")).alias("spans"),
    )


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span of the scan; overlapping spans are one.

    Spans are merged by their places and replaced in one pass, so what they hold is gone and nothing
    else changes. Null text stays null, and other columns stay as they are, whatever their names.
    Repeated rows are each redacted; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text.alias("s_text"))
    scanned = materialise(_found(packed, model).select("row", "doc", "found"), "matches")
    order = W.partitionBy("row").orderBy("start", "end")
    spans = _spans(scanned).withColumn("upto", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("nth", F.sum((F.coalesce("upto", F.lit(-1)) < F.col("start")).cast("int")).over(order))
    merged = spans.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    listed = materialise(listed, "spans")
    if (listed.agg(F.sum(F.size("spans"))).first()[0] or 0) <= MOST_BROADCAST:
        listed = F.broadcast(listed)
    rows = scanned.select("row", "doc").join(listed.withColumnRenamed("row", "s_row"), F.col("row") == F.col("s_row"), "left")
    text = F.col("doc")[text_col]
    before = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1).end)
    kept = F.transform("spans", lambda x, i: F.substring(text, before(x, i) + 1, x.start - before(x, i)))
    tail = F.substring(text, F.element_at("spans", -1).end + 1, F.length(text))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), tail))
    return rows.select(*((clean if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns))


def scan_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fit on samples labelled with the help of ``docs`` and scan all of it."""
    return secret_scan(docs, fit(labelled_samples(docs)))
