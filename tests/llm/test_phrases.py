"""Spelling variants, collocations and license scans against brute force and their statements."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lamellar.llm import collocations, license_scan, queries, spelling
from tests.compare import connected, difference

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, n long, word string, key long, row long, id string"


def table(spark, rows):
    """Documents with columns of names that the operators use within."""
    return spark.createDataFrame([(i, t, lang, 1, "w", 2, 3, "x") for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_collocations", "op13_license_scan"])
def test_statement(spark, name):
    assert difference(spark, connected(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) is None


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    count = Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute_spelling(docs):
    words = brute_words(docs)
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(beside[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def spelled(spark, docs):
    rows = spelling.spelling_variants(table(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows), key=str)


def test_spelling_against_brute_force(spark):
    rng = random.Random(11)
    letters = "abéÿÀß×Zq"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(40)]

    def changed(w):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        return w

    docs = [(i, " ".join(changed(rng.choice(base)) for _ in range(80)), "en") for i in range(60)]
    docs += [(None, " ".join(base[:5]), None), (3, None, "en"), (4, "", "en"), (5, "a" * 50_000 + " aaaaaaaa aaaaaaa", "en"), (5, "aaaaaaaa", "en"), docs[0]]
    want = brute_spelling(docs)
    assert sum(r[4] > 0 for r in want) > 100
    assert spelled(spark, docs) == want


def test_chains_of_forms_and_ties(spark):
    # Ids are chosen so that no run loses a letter: each word stands as often as it says.
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000, "qqqqqqqq": 2, "qqqqqqqa": 20, "qqqqqqqb": 20, "zzzzzzzz": 9, "zzzzzzz": 2}
    safe = [i for i in range(4000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in counts)]
    docs = [(safe[0], " ".join(w for w, n in counts.items() for _ in range(n)), "en")]
    got = {r[0]: r for r in spelled(spark, docs)}
    assert got["abcdefgh"][1:3] == ("abcdefgx", "abcdezyx") and got["qqqqqqqq"][1] == "qqqqqqqa" and got["zzzzzzz"][1] is None
    assert sorted(got.values(), key=str) == brute_spelling(docs)
    assert spelled(spark, []) == []


def brute_collocations(docs):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= 30}
    longer = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in found.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:2000], 1))


def mined(spark, docs):
    rows = collocations.collocations(table(spark, docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(map(tuple, rows))


def random_texts():
    rng = random.Random(12)
    words = ["the", "The", "of", "É", "é", "x\xa0y", "a-b", "…", "of"]
    mark = lambda: rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", ";", "\x0b"])
    docs = [(i, "".join(rng.choice(words) + mark() for _ in range(rng.randrange(0, 300))), rng.choice(["en", "de", None])) for i in range(150)]
    return docs + [(None, None, "en"), (1, "", None), (2, " . , \n", "fr"), docs[3], (9, "one two three four five " * 9_000, "long")]


@pytest.mark.parametrize(("most", "fused"), [(1_000_000, 3_000_000_000), (-1, 3_000_000_000), (-1, 0)])
def test_collocations_against_brute_force(spark, monkeypatch, most, fused):
    """With names broadcast, joined to the chunks' own pairs, and too many for a pair to be one number."""
    monkeypatch.setattr(collocations, "MOST_BROADCAST", most)
    monkeypatch.setattr(collocations, "MOST_FUSED", fused)
    monkeypatch.setattr(collocations, "CHUNK", 4_000)
    docs = random_texts()
    want = brute_collocations(docs)
    assert len(want) > 150 and {r[0] for r in want} >= {"und", "long"}
    assert mined(spark, docs) == want
    assert mined(spark, []) == []


def test_only_the_first_are_listed(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LISTED", 7)
    docs = random_texts()
    assert mined(spark, docs) == [r for r in brute_collocations(docs) if r[1] <= 7]


def brute_base(docs):
    out = []
    for doc, text, _ in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def scanned(spark, docs):
    return license_scan.license_scan(table(spark, docs)).collect()


def test_base_phrases(spark):
    rng = random.Random(13)
    words = ["cc", "CC", "by", "general", "Public", "license", "all", "rights", "reserved", "É", "K"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", " . "]) for _ in range(rng.randrange(0, 80))), "en") for i in range(100)]
    docs += [(None, None, "en"), (1, "", "en"), (2, "cc by", "en"), docs[0], (7, "all rights reserved " * 5_000, "en")]
    got = scanned(spark, docs)
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute_base(docs)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scanned(spark, []) == []


def test_diagonals(spark):
    notice = dict((label, text) for label, text in license_scan.TEMPLATES if len(text) > 400)
    mit, bsd = notice["mit"], notice["bsd-3-clause"]
    words = mit.split()
    prose = "this is quite an ordinary text about the software of a copy and the rights of all people " * 20
    docs = [
        (1, prose + mit + prose),
        (2, prose + " ".join(w for i, w in enumerate(words) if i % 25 != 7)),  # left out words
        (3, " ".join(w + (" indeed" if i % 30 == 3 else "") for i, w in enumerate(words)).upper()),  # more words
        (4, " ".join(words[:40])),  # less than COVERS
        (5, prose),
        (6, mit + prose + bsd),
        (7, "Licensed under CC BY-NC 4.0. Released under the MIT License."),
        (8, "This work is licensed under the GNU General Public License, version 2. " + prose),
        (9, " ".join(random.Random(1).sample(words, len(words)))),
    ]
    got = {r.doc_id: r for r in scanned(spark, [(*d, "en") for d in docs])}
    labels = {i: r.labels for i, r in got.items()}
    assert labels == {1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "bsd-3-clause,mit", 7: "cc-by,cc-by-nc-4.0,mit", 8: "gpl,gpl-2.0", 9: ""}
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and 0.8 <= got[3].score <= 1 and 0 < got[4].score < 0.8 and got[9].score < 0.3


def test_templates_in_blocks(spark, monkeypatch):
    words = " ".join(t for _, t in license_scan.TEMPLATES)
    docs = [(1, words, "en"), (2, "cc by all rights reserved", "en"), (2, None, "en"), (3, "Licensed under the MIT License", "en")]
    want = sorted(map(str, scanned(spark, docs)))
    monkeypatch.setattr(license_scan, "MOST_GRAMS", 50)
    assert sorted(map(str, scanned(spark, docs))) == want


def test_spans_give_places_in_the_text(spark):
    docs = table(spark, [(1, "one two Released under the MIT License and Released under the MIT License", "en")])
    _, spans = license_scan.license_spans(docs)
    assert sorted((r.label, r.lo, r.hi) for r in spans.filter("stands").collect()) == [("mit", 2, 7), ("mit", 8, 13)]


def test_a_template_needs_a_gram(spark):
    with pytest.raises(Exception, match="fewer than 3 words"):
        license_scan.template_grams(spark, [("x", "two words")]).count()


def test_no_python_in_the_license_scan(spark):
    plan = license_scan.license_scan(table(spark, [(1, "a", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
