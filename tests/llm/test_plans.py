"""Branches for data beyond a broadcast give the same rows; very long texts, clashing names."""

import pytest

import corpus_pipeline
from lamellar.llm import decontamination, jaccard_join, packing, quality_rules, queries, url_filter
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    ("module", "name", "value", "query"),
    [
        (quality_rules, "MOST_BROADCAST", -1, queries.op4_quality_rules),
        (url_filter, "MOST_BROADCAST", -1, queries.op7_url_filter),
        (decontamination, "MOST_COUNTED", -1, queries.op1_decontamination),
        (jaccard_join, "MOST_BROADCAST", -1, queries.op3_jaccard_join),
    ],
)
def test_shuffled_branch(spark, monkeypatch, module, name, value, query):
    want = rows(query(spark, SF))
    monkeypatch.setattr(module, name, value)
    assert rows(query(spark, SF)) == want


def test_shuffled_branches_of_the_pipeline(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.keep_one_of_a_group(spark, docs, SF), SF)
    want = rows(plain.select("doc_id", "text"))
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", -1)
    again = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.keep_one_of_a_group(spark, docs, SF), SF)
    assert rows(again.select("doc_id", "text")) == want
    packed = packing.pack(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "length")
    want = rows(packed)
    monkeypatch.setattr(packing, "MOST_BROADCAST", -1)
    assert rows(packing.pack(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "length")) == want


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    long = " ".join(words)
    near = " ".join(words[:30_000] + ["other"] + words[30_001:])
    texts = [(1, long), (2, near), (3, " ".join(words[:20_000])), (4, "short text of six words only")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == brute(texts)
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert found[1].n_words == 60_000 and found[1].word_chars == len(long) - 59_999 and not found[1].base_failed and found[4].base_failed
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000), (2, "y" * 100_000)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    judged = {r.page_id: r for r in url_filter.url_filter(pages, labels, queries.URL_RULES).collect()}
    assert (judged[1].rule, judged[1].verdict, len(judged[1].path)) == ("com/", "allow", 200_001) and judged[2].host == ""


def test_rows_grow_no_faster_than_a_loose_group(spark, monkeypatch):
    """Near copies of one text of 200 words, from 200 to 800: compared pairs of documents that aren't yet in one group."""
    import random

    seen = {}
    kept = jaccard_join.materialise

    def counting(df, label):
        out = kept(df, label)
        if label in ("pairs", "centre-pairs"):
            seen[label] = seen.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counting)
    many = {}
    for n in (200, 800):
        rng = random.Random(5)
        base = [f"w{i}" for i in range(200)]
        texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0.005, 0.02, 0.04]) else w for w in base) for _ in range(n)]
        seen.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        assert jaccard_join.jaccard_join(docs).count() == n
        many[n] = sum(seen.values())
    assert many[800] <= 4.5 * many[200], many
