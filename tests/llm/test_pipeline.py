"""Each pipeline stage against brute force on its own input, and the whole run."""

import importlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_text_operators import brute_base, brute_decontaminate

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "!!! 123", "en", "s", 7), (9003, docs.first().text, "en", "s", 3), (9003, docs.first().text, "en", "s", 3)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r[0] for r in pairs(docs)} - {r[0] for r in pairs(kept)}
    assert {9001, 9002} <= gone and len(gone) <= 2 + 0.01 * docs.count()

    alone = corpus_pipeline.keep_one_of_a_group(spark, kept, SF)
    want = sorted({i for i, _, c in brute_groups(pairs(kept)) if i == c})
    assert alone.columns == docs.columns and sorted(i for i, _ in pairs(alone)) == want
    assert set(pairs(alone)) <= set(pairs(kept))

    clean = corpus_pipeline.drop_contaminated(spark, alone, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in brute_decontaminate(pairs(alone), items) if not r[5])
    assert clean.columns == docs.columns and sorted(i for i, _ in pairs(clean)) == want

    safe = corpus_pipeline.redact_secrets(spark, clean, SF)
    assert safe.columns == docs.columns
    before, after = dict(pairs(clean)), dict(pairs(safe))
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert brute_base(text)[:3] == (0, 0, 0)
        if "[SECRET]" in text:
            between = ".*".join(map(re.escape, text.split("[SECRET]")))
            assert re.fullmatch(between, before[i], re.S)
        else:
            assert text == before[i]
    assert safe.filter(F.length("text") != F.col("n_chars")).count() == 0

    packed = corpus_pipeline.pack(spark, safe, SF).collect()
    assert {r.doc_id for r in packed} == set(after)


def test_run_repeats_itself(spark):
    rows = [sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text.upper()), (3, "other words that stand alone in a text"), (None, text), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(pairs(corpus_pipeline.keep_one_of_a_group(spark, docs, SF)))
    assert got == [(1, text), (3, rows[3][1]), (4, ""), (4, "")]
    assert corpus_pipeline.keep_one_of_a_group(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.keep_known_languages(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.redact_secrets(spark, docs.limit(0), SF).count() == 0


def test_clashing_names_and_no_rows(spark):
    text = "one two three four five six seven eight"
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(1, text), (1, text), (2, text.upper()), (3, items[0]), (None, None), (4, "token=abcdefgh " + "long word " * 40_000)]
    names = "g_id string, g_key string, key string, hash string, id string, doc string, row string, found string, `a.b` string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *"abcdefghi") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and all(tuple(r)[5:] == tuple("abcdefghi") for r in kept.collect())
    assert corpus_pipeline.keep_one_of_a_group(spark, docs, SF).count() == 4
    assert sorted(i or 0 for i, _ in pairs(corpus_pipeline.drop_contaminated(spark, docs, SF))) == [0, 1, 1, 2, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
