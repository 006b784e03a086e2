"""Token files, packing, token counts, language models, language identification and URL filter."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from lamellar.llm import language_id, lm_scoring, packing, queries, token_counts, token_files, url_filter
from lamellar.sources.storage import fresh_dir
from tests.compare import connected, difference

SF = "/root/testdata/sf0.001"
ODD = ["a  b \n c\t d", " lead", "trail ", "x\n", "\n\n", "", None, "<|endoftext|> hi", "it's  we'll", "ΑΣ Σας É é ́x", "a\xa0b \xa0c", "\x1cab \x1c c", "\x02 a", "日本語 🙂\n🙂", "w " * 9000]
DOC = "doc_id long, text string, part long, task string"


def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again")]
    return rows, spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOC).repartition(3)


def ids_of(name, texts):
    return [np.array(e.ids, "<u4") for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    rows, df = corpus(spark)
    out = fresh_dir(spark, "test-files")
    token_files.write_token_files(df, out, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    got = [tuple(r) for r in token_files.read_token_files(spark, out).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for (d, _), ids in zip(order, ids_of("byte_bpe_50k.json", [t or "" for _, t in order])):
        ids = np.append(ids, 2).astype("<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    class Elsewhere:  # a store that isn't local
        def __init__(self, store):
            self.open_input_file = store.open_input_file

    ids = token_files._open(Elsewhere(pafs.LocalFileSystem()), f"{out.removeprefix('file://')}/part-000000.ids", "<u2", 9)
    assert ids[3:9].tolist() == token_files._open(pafs.LocalFileSystem(), f"{out.removeprefix('file://')}/part-000000.ids", "<u2", 9)[3:9].tolist()
    root = out.removeprefix("file://")
    manifest = json.load(open(f"{root}/manifest.json"))
    flat = np.concatenate([np.fromfile(f"{root}/part-{p['part']:06d}.ids", manifest["dtype"]) for p in manifest["parts"]])
    assert len(flat) == start and manifest["dtype"] == "<u2"
    assert token_files.token_files(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def check_plan(counts, capacity):
    entries, bins = packing.plan(counts, capacity)
    by_length = defaultdict(list)
    for length, rank, sequence, offset in entries:
        by_length[length].append((rank, sequence, offset))
    content = defaultdict(list)
    for length, runs in by_length.items():
        runs.sort()
        for i, (rank, sequence, offset) in enumerate(runs):
            for k in range((runs[i + 1][0] if i + 1 < len(runs) else counts[length]) - rank):
                content[sequence + k].append((offset, length))
    assert len(content) == bins and sum(map(len, content.values())) == sum(counts.values())
    for held in content.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def fewest(items, capacity):
    """Exact number of bins for a few items."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_plan():
    rng = random.Random(4)
    excess = 0
    for _ in range(60):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 12))), reverse=True)
        excess += check_plan(dict(Counter(items)), 20) - fewest(items, 20)
    assert excess <= 2
    many = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(30_000))
    assert check_plan(many, 2048) <= 1.01 * math.ceil(sum(k * v for k, v in many.items()) / 2048)
    assert packing.plan({}, 8) == ([], 0)


def test_packing(spark):
    rows, df = corpus(spark)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = Counter()
    for (d, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t or "" for _, t in rows])):
        ids = np.append(ids, 0).astype("<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            want[d, k, lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for held in ends.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(ends) <= 1.02 * math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_counts(spark):
    rows, df = corpus(spark)
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    unigram = models.Unigram([("<unk>", 0.0), *pieces], 0, False)
    want = Counter((d, len(unigram.tokenize("▁" + t.replace(" ", "▁"))) if t else 0) for d, t in rows)
    got = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_count_only_viterbi_on_ties():
    rng = random.Random(6)
    for round_ in range(400):
        pieces = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): float(-rng.randrange(1, 4)) for _ in range(9)}.items())
        counter, unigram = token_counts.Counter(pieces), models.Unigram([("<unk>", 0.0), *pieces], 0, False)
        letters = ["a", "b", "c", "d", " ", "\n"] + ["<unk>", "<", "unk>"] * (round_ % 2)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for _ in range(20)]
        assert counter.count(pa.array(texts)).tolist() == [len(unigram.tokenize("▁" + t.replace(" ", "▁"))) for t in texts]


def test_lm_scoring(spark):
    rows, df = corpus(spark)
    labels = [(r.doc_id, r.quality == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(None, True), (5, None)]
    got = lm_scoring.lm_scoring(df, spark.createDataFrame(labels, "doc_id long, wanted boolean")).collect()
    words = [t.lower().split() if t else [] for _, t in rows]
    many = len({w for ws in words for w in ws})
    wanted = {d for d, w in labels if w and d is not None}
    loss = {}
    for k, use in enumerate(([d in wanted for d, _ in rows], [True] * len(rows))):
        uni, bi, ends = Counter(), Counter(), Counter()
        for keep, ws in zip(use, words):
            if keep:
                uni.update(ws)
                bi.update(zip(ws, ws[1:]))
                ends.update(ws[-1:])
        n = uni.total()
        p = lambda w: (uni[w] + 1) / (n + many + 1)  # noqa: B023, E731
        q = lambda a, b: (bi[a, b] + lm_scoring.ALPHA * p(b)) / (uni[a] + lm_scoring.ALPHA)  # noqa: B023, E731
        for a, _ in uni.most_common(3):  # all words, the document's end, and any unseen word
            every = sum(q(a, b) for b in {w for ws in words for w in ws}) + (ends[a] + lm_scoring.ALPHA * p(None)) / (uni[a] + lm_scoring.ALPHA)
            assert abs(every - 1) < 1e-9
        for i, ws in enumerate(words):
            if ws:  # without its own counts
                own, pairs = (Counter(ws), Counter(zip(ws, ws[1:]))) if use[i] else (Counter(), Counter())
                p = lambda w: (uni[w] - own[w] + 1) / (n - own.total() + many + 1)  # noqa: B023, E731
                q = lambda a, b: (bi[a, b] - pairs[a, b] + lm_scoring.ALPHA * p(b)) / (uni[a] - own[a] + lm_scoring.ALPHA)  # noqa: B023, E731
                loss[i, k] = -(math.log(p(ws[0])) + sum(math.log(q(a, b)) for a, b in zip(ws, ws[1:]))) / len(ws)
    want = sorted((str(d), len(words[i]), round(loss.get((i, 0), 0), 6), round(loss.get((i, 1), 0), 6)) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_tokens, round(r.loss_target or 0, 6), round(r.loss_background or 0, 6)) for r in got) == want
    assert all(r.score is None if not r.n_tokens else abs(r.score - r.loss_target + r.loss_background) < 1e-12 for r in got)
    assert lm_scoring.lm_scoring(df.limit(0), spark.createDataFrame(labels, "doc_id long, wanted boolean")).count() == 0


def test_lm_scoring_counts_are_exact(spark, monkeypatch):
    """More words than 32,768 and more bigrams than 2^18, against counts by the words themselves, in several chunks."""
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 600_000)
    rng = random.Random(6)
    texts = [[f"w{int(40_000 * rng.random() ** 1.5)}" for _ in range(1000)] for _ in range(320)] + [["often", "pair"] * 3000, ["once"], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.lm_scoring(docs, spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "doc_id long, wanted boolean")).collect()}
    many = len({w for t in texts for w in t})
    assert many > 32_768 and len({b for t in texts for b in zip(t, t[1:])}) > 1 << 18 and len(got) == len(texts)
    for name, use in (("loss_target", lambda i: i < 300 and i % 3 == 0), ("loss_background", lambda i: True)):
        uni = Counter(w for i, t in enumerate(texts) if use(i) for w in t)
        bi = Counter(b for i, t in enumerate(texts) if use(i) for b in zip(t, t[1:]))
        n = uni.total()
        for i, t in enumerate(texts):
            if not t:
                assert got[i][name] is None
                continue
            own, pairs = (Counter(t), Counter(zip(t, t[1:]))) if use(i) else (Counter(), Counter())
            p = lambda w: (uni[w] - own[w] + 1) / (n - own.total() + many + 1)  # noqa: B023, E731
            rest = [(bi[a, b] - pairs[a, b] + lm_scoring.ALPHA * p(b)) / (uni[a] - own[a] + lm_scoring.ALPHA) for a, b in zip(t, t[1:])]
            assert all(x <= 1 for x in rest) and abs(got[i][name] + (math.log(p(t[0])) + sum(map(math.log, rest))) / len(t)) < 1e-9


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(docs)
    seen = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(seen) == docs.count()
    for r in seen:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    tested = [r for r in seen if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.95 * len(tested)
    assert sum(r.rejected for r in seen) <= 0.005 * len(seen)


def test_language_id_edges(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat on the mat and was", "a dog ran by the old house with the cat"] * 12)]
    rows += [(100 + i, t, "de") for i, t in enumerate(["der hund und die katze sind nicht hier", "das haus ist sehr schön und groß"] * 12)]
    rows += [(900, None, None), (901, "", "en"), (902, "12 !?", "de"), (None, "die katze ist nicht im haus", None), (903, "the " * 60_000, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score long, letters string")
    out = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "de" and out[903].lang_pred == "en"
    assert all(out[i].rejected and out[i].score == 0 for i in (900, 901, 902))
    assert language_id.language_id(df.limit(0)).count() == 0
    none = language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)


def test_url_filter_blocks_bad_hosts_alone(spark):
    pages = [(i, f"http://bad.example.org/{i}") for i in range(60)] + [(100 + i, f"https://good{i % 5}.example.org/x?y") for i in range(100)]
    pages += [(300, None), (301, "no scheme"), (302, "http://U@BAD.example.org:80"), (303, "x://new.example.org#a/b"), (304, "HTTP://Www.Example.COM/en/1"), (305, "http://a.net/es/?q"), (305, "http://a.net/es"), (None, "http://b.net/fr/")]
    labels = [(i, True) for i in range(40)] + [(100 + i, i % 9 == 0) for i in range(100)] + [(None, True), (7, None), (8, True)]
    p = spark.createDataFrame([(*r, "x", 1) for r in pages], "page_id long, url string, host string, n long")
    out = url_filter.url_filter(p, spark.createDataFrame(labels, "page_id long, bad boolean"), queries.URL_RULES)
    got = {(r.page_id, r.path): r for r in out.collect()}
    assert out.count() == len(pages)
    assert {r.verdict for (i, _), r in got.items() if i is not None and i < 60} == {"block"}
    assert {r.verdict for (i, _), r in got.items() if i is not None and 100 <= i < 200} == {"allow"}
    assert got[300, ""].host == got[301, ""].host == "" and got[302, ""].host == "u@bad.example.org:80"
    assert got[303, ""].host == "new.example.org" and got[304, "/en/1"].rule == "www.example.com/en/"
    assert got[305, "/es/"].rule == "net/es/" and got[305, "/es"].rule is None and got[None, "/fr/"].verdict == "block"
    assert url_filter.url_filter(p.limit(0), spark.createDataFrame(labels, "page_id long, bad boolean"), queries.URL_RULES).count() == 0
    free = url_filter.url_filter(p, spark.createDataFrame([], "page_id long, bad boolean"), [])
    assert free.filter("verdict = 'block'").count() == 0 and free.count() == len(pages)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_statement(spark, name):
    con = connected(SF)
    assert difference(spark, con, SF, queries.queries()[name], queries.oracle_sql()[name]) is None
    assert duckdb.__version__


def test_domains_and_suffixes(spark):
    want = {
        "www.example.com": ("example.com", "com"),
        "www.example.co.kr": ("example.co.kr", "co.kr"),
        "foo.example.gov.uk": ("example.gov.uk", "gov.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "me.uk.com": ("uk.com", "com"),
        "192.168.0.1:80": ("192.168.0.1", ""),
        "a.example.com.": ("example.com", "com"),
        "user@[2001:db8::1]:443": ("2001:db8::1", ""),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
        "a.b.c.ck": ("b.c.ck", "c.ck"),
        "a.www.ck": ("www.ck", "ck"),
        "x.y.blog.example": ("y.blog.example", "blog.example"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = url_filter._levels(F.col("host"), ["*.ck", "!www.ck", "blog.example"])
    assert {r[0]: (r[1], r[2]) for r in hosts.select("host", domain, suffix).collect()} == want


def test_a_very_long_word_needs_little_memory():
    """Three million characters without a blank, in places for the longest piece alone."""
    import tracemalloc

    counter = token_counts.Counter([("▁a", -1.0), ("ab", -2.0), ("b", -3.0), ("abab", -3.5)])
    text = "▁" + "ab" * 1_500_000
    counter.word(text[:1000])
    tracemalloc.start()
    assert counter.word(text)[0] == 750_002  # ▁a b, then an even number of ab but one
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000, peak


def test_ids_beyond_31_bits():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 1 << 45, 500), rng.integers(0, 1 << 45, 500)
    left[250:], right[250:] = left[:250], right[:250]
    a, b, at = lm_scoring._distinct(left, right)
    assert len(a) == 250 and (a[at] == left).all() and (b[at] == right).all() and sorted(zip(a, b)) == list(zip(a, b))


def test_a_label_does_not_change_a_documents_own_score(spark):
    """One text, labelled in one corpus and not in the other: what it is scored by is the same."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lambda ids: {r.doc_id: r.score for r in lm_scoring.lm_scoring(docs, spark.createDataFrame([(i, True) for i in ids], "doc_id long, wanted boolean")).collect()}
    some = [i for i, _ in rows[::2]]
    with_it, without = scored(some), scored(some[1:])
    assert abs(with_it[some[0]] - without[some[0]]) < 1e-9
