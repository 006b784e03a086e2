"""The nearest-centroid classifier against an implementation with dictionaries, from the texts on."""

import math
import zlib

from lamellar.llm import language_id

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def bucket(a, b, c):
    h = (a * 2654435761 + b * 2246822519 + c * 3266489917) & MASK
    h ^= h >> 15
    return ((h * 668265263) & MASK) >> 20


def counted(text):
    """Trigrams of letters, with a 0 at both ends and after each run of letters."""
    points, before = [0], False
    for ch in (text or "").lower():
        if ch.isalpha():
            points.append(ord(ch))
        elif before:
            points.append(0)
        before = ch.isalpha()
    points.append(0)
    out = {}
    for a, b, c in zip(points, points[1:], points[2:]):
        k = bucket(a, b, c)
        out[k] = out.get(k, 0) + 1
    letters = sum(ch.isalpha() for ch in (text or "").lower())
    return (out if letters else {}), letters


def unit(counts, idf):
    x = {k: math.log1p(n) * idf[k] for k, n in counts.items() if idf.get(k)}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()} if norm else {}


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def total(rows):
    out = {}
    for r in rows:
        for k, v in r.items():
            out[k] = out.get(k, 0.0) + v
    return out


def scaled(x):
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()}


def clustered(rows):
    mean = total(rows)
    picked = [max(range(len(rows)), key=lambda i: (dot(rows[i], mean), -i))]
    while len(picked) < min(language_id.CENTROIDS, len(rows)):
        picked.append(min(range(len(rows)), key=lambda i: (max(dot(rows[i], rows[p]) for p in picked), i)))
    centres = [rows[p] for p in picked]
    for _ in range(language_id.ROUNDS):
        own = [max(range(len(centres)), key=lambda k: (dot(r, centres[k]), -k)) for r in rows]
        groups = [[r for r, o in zip(rows, own) if o == k] for k in range(len(centres))]
        centres = [scaled(total(g)) if g else c for g, c in zip(groups, centres)]
    return centres


def band(letters):
    return max(letters, 1).bit_length() - 1


def brute(rows):
    learned = {}
    for doc, text, lang in rows:
        c, letters = counted(text)
        if lang is not None and letters and zlib.crc32(str(doc).encode()) % 5:
            learned.setdefault(lang, []).append((doc, letters, c))
    seen = [c for group in learned.values() for _, _, c in group]
    idf = {}
    for c in seen:
        for k in c:
            idf[k] = idf.get(k, 0) + 1
    idf = {k: math.log((1 + len(seen)) / (1 + n)) + 1 for k, n in idf.items()}
    centres, limits = [], {}
    for lang, group in sorted(learned.items()):
        group.sort(key=lambda g: g[:2])
        x = [unit(c, idf) for _, _, c in group]
        own = clustered(x)
        best = [max(dot(v, c) for c in own) for v in x]
        at = 0.0
        for k in range(64):
            here = [b for b, (_, letters, _) in zip(best, group) if band(letters) == k]
            at = language_id.ROOM * min(here) if len(here) >= language_id.LEAST_SEEN else at
            limits[lang, k] = at
        centres += [(lang, c) for c in own]
    out = {}
    for doc, text, _ in rows:
        c, letters = counted(text)
        if not letters:
            out[doc] = ("und", 0.0, True)
            continue
        x = unit(c, idf)
        score, lang = max(((dot(x, v), name) for name, v in centres), key=lambda s: s[0])
        out[doc] = (lang, score, score < limits[lang, band(letters)])
    return out


def test_vectors_centroids_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    rows = [tuple(r) for r in docs.collect()] + [(90_001, None, "en"), (90_002, "1 2 3", None), (90_003, "qzx qzx vvv " * 50, None), (90_004, "ß " * 300, None)]
    want = brute(rows)
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, rejected = want[r.doc_id]
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - score) < 1e-4, r
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_equal_cosines_go_to_the_first_language(spark):
    text = "one and the same text for both languages here"
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text, "bb" if k % 2 else "aa") for k, i in enumerate(ids)] + [(999, text, None)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa"} and not any(r.rejected for r in got)
