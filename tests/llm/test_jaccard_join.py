"""The Jaccard join against all pairs."""

import random
import re

import pytest

from lamellar.llm import jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def joined(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n int, root string").repartition(parts)
    return sorted(map(tuple, jaccard_join.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def changed(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed, n):
    """Clusters of several tightness round one text, a passage in many texts, short and odd texts."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(40)]
    while len(rows) < n:
        kind = rng.randrange(5)
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 20, 60, 120]))]
        if kind == 0:
            rows += [" ".join(changed(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06]))) for _ in range(rng.choice([2, 5, 40]))]
        elif kind == 1:
            rows += [" ".join(passage + changed(rng, base[:12], 0.5)) for _ in range(6)]
        elif kind == 2:
            rows += [" ".join(base[k : k + len(base)] + base[:k]).upper() for k in range(3)]
        elif kind == 3:
            rows += [" ".join(base[: len(base) - k]) for k in range(6)]
        else:
            rows.append(rng.choice([None, "", " \t\n", "one", "One two", "one\x1ctwo", "é É é É é É", "à\u00a0voilà \u0085à la\u2003à", "À voilÀ a\u000bb\x0cc", " ".join(["a", "b"] * 30)]))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i if i % 17 else None if i % 2 else i - 1, t) for i, t in zip(ids, rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed, 260)
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_forms_of_lists(spark, monkeypatch, seed):
    """Every token frequent, or those of three sets on; one key known before; one round of centres or many."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", seed % 3)
    monkeypatch.setattr(jaccard_join, "BEFORE", 1)
    monkeypatch.setattr(jaccard_join, "WORTH", 0 if seed % 2 else 1000)
    monkeypatch.setattr(jaccard_join, "PACK_DOCS", 30)
    monkeypatch.setattr(jaccard_join, "MOST_BROADCAST", 0)
    rows = corpus(seed, 220)
    assert joined(spark, rows) == brute(rows)


def test_boundary_of_the_similarity(spark):
    base = [f"w{i}" for i in range(11)]  # 7 shingles; 6 of 8, then 7 of 10
    rows = [(5, " ".join(base)), (4, " ".join([*base[:-1], "q"])), (9, " ".join([*base, "r", "s", "t"]))]
    assert joined(spark, rows) == brute(rows)


def test_empty(spark):
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(df).count() == 0
