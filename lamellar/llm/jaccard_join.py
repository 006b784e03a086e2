"""N-gram Jaccard self-join by token-combination prefixes, and the groups that its links make.

Sets are a document's distinct word shingles, as 64-bit hashes. Sets that overlap enough share at
least ``k`` tokens among the first ``n - ceil(0.75 n) + k`` of each, in whatever common order.

1. *Shared tokens.* Every task sends a hash-ordered, extended prefix of its documents' tokens, packed,
   to tasks by hash range, and learns how many of each document's occur in another document. Few
   documents have enough of them to have any partner; only those go on, one of each class of equal sets.
2. *Prefixes.* Tokens are ordered by rarity among these.
3. *Centres.* Of each token's list, the document with the most common tokens is compared with the
   others. Links make components; documents of one component need no further comparison. Lists that
   still hold several components get another centre, as long as that links a fair share of what it
   is compared with.
4. *Combinations.* Documents of such lists: a rare token is indexed by itself, frequent tokens by
   combinations of two that follow each other in the order. Two sets that link differ in few tokens,
   so these can't part all tokens that both have: the prefix of frequent tokens is extended until two
   such tokens must stand side by side in both. A document has fewer combinations than tokens.
   Pairs from different components are compared.

A pair becomes a row only if lengths, positions and parity sketches of both sets allow a link, and
none of the keys just before is common to both. Every such pair is compared exactly on the sets, so
the groups are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm.tokens import in_slices
from lamellar.operators.components import connected_components
from lamellar.sources.storage import materialise

SHINGLE = 5
#: Tokens of a combination for frequent tokens; a token in more sets than FREQUENT is frequent.
COMBINE, FREQUENT = 2, 16
#: Bits of a set's parity sketch: each is the parity of the number of tokens that fall there.
PARITY_BITS = 1024
#: Keys before a key by which a pair met there before is known, to make fewer rows; the rest is left to distinct().
BEFORE = 8
#: Another centre is tried as long as one in so many comparisons of a round makes a link.
WORTH = 8
#: Documents and tokens that a task packs at once.
PACK_DOCS, PACK_TOKENS = 60_000, 600_000
#: Bytes of text that are cut into words at once.
TEXT_AT_ONCE = 3_000_000
#: Ids up to this many are broadcast to find the texts of documents that go on; beyond, they are joined by shuffle.
MOST_BROADCAST = 2_000_000
#: In a packed list: the token is in several documents of its task.
_SEVERAL = 0xFFFF
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words are one shingle, none is empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for white in "\t\n\v\f\r":  # other white space belongs to words
        plain = pc.replace_substring(plain, white, " ")
    split = pc.split_pattern(plain, " ")
    words = split.flatten()
    coded = words.dictionary_encode()  # of bytes, lower() maps A-Z alone
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) if w else 0 for w in distinct), np.uint64, len(distinct))
    index = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    empty = np.array([not w for w in distinct], bool)
    real = ~empty[index] if len(index) else np.zeros(0, bool)
    h, doc = table[index[real]], doc[real]
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    n = max(0, len(h) - SHINGLE + 1)
    windows = _mix(sum((h[k : k + n] * _MUL[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(_mix((h[a:b] * _MUL[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def _need(n):
    """The least overlap that a set of n tokens has with any partner."""
    return (3 * n + 3) // 4


def _k(n):
    """By how many tokens more than one the first prefix of a set is extended; never less for larger n."""
    return 3 * n // 20 + 1


def _signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(_mix(h).sum().astype(np.int64)), int(np.bitwise_xor.reduce(_mix(h ^ _MUL[1])).astype(np.int64)) if len(h) else 0


def _pack(low: np.ndarray, idx: np.ndarray) -> tuple[bytes, bool]:
    """Sorted tokens as differences, of 32 bits if all fit, and their documents."""
    step = np.diff(low, prepend=np.uint64(0))
    wide = bool(len(step)) and int(step.max()) >= 1 << 32
    return step.astype("<u8" if wide else "<u4").tobytes() + idx.astype("<u2").tobytes(), wide


def _unpack(blob: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    size = 8 if wide else 4
    n = len(blob) // (size + 2)
    low = np.cumsum(np.frombuffer(blob, f"<u{size}", n).astype(np.uint64))
    return low, np.frombuffer(blob, "<u2", n, size * n)


PACKED = "task long, bucket long, wide boolean, blob binary, doc_id long, key long, uid long, n long, s1 long, s2 long, inside long"


def _packer(bits: int):
    """Per document: uid, size and signature of its set, and how many tokens of its first prefix occur again in its pack.
    Per hash range: the tokens of the pack, of 48 bits, each with its document, or marked if in several."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in PACKED.split(", ")])
        done = 0
        docs: list[tuple] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            sizes = [len(x) for x in held]
            token = np.concatenate(held) if held else np.zeros(0, np.uint64)
            idx = np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(token, kind="stable")
            token, idx = token[order], idx[order]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            run = np.cumsum(first) - 1
            several = np.bincount(run)[run] > 1 if len(token) else first
            inside = np.bincount(idx[several], minlength=len(held))
            task = base + done
            rows = [(task, None, None, None, d, key, task + i, n, a, b, int(inside[i])) for i, (d, key, n, a, b) in enumerate(docs)]
            token, idx = token[first], np.where(several, _SEVERAL, idx)[first]
            cut = np.searchsorted(token >> np.uint64(48 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            low = token & np.uint64((1 << (48 - bits)) - 1)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                blob, wide = _pack(low[cut[b] : cut[b + 1]], idx[cut[b] : cut[b + 1]])
                rows.append((task, b, wide, blob, *[None] * 7))
            done += len(docs)
            docs.clear()
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        total = 0
        for batch in in_slices(batches, most=TEXT_AT_ONCE):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for doc, key, h in zip(ids, keys, shingle_sets(batch.column("text")), strict=True):
                n = len(h)
                # Ordered by hash, of which the lower bits don't matter here.
                held.append((h >> np.uint64(16))[: n - _need(n) + _k(n)] if n else h)
                docs.append((doc, key, n, *_signature(h)))
                total += len(held[-1])
                if len(docs) >= PACK_DOCS or total >= PACK_TOKENS:
                    yield from flush()
                    total = 0
        yield from flush()

    return pack


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range, a row for each pack: its documents with tokens in another pack, and with how many."""
    parts = [_unpack(b, w) for b, w in zip(frame.blob, frame.wide, strict=True)]
    low = np.concatenate([p[0] for p in parts])
    idx = np.concatenate([p[1] for p in parts]).astype(np.int64)
    uid = np.repeat(frame.task.to_numpy(np.int64), [len(p[0]) for p in parts]) + idx
    order = np.argsort(low, kind="stable")
    low, idx, uid = low[order], idx[order], uid[order]
    again = np.zeros(len(low), bool)
    again[1:] = low[1:] == low[:-1]
    again[:-1] |= again[1:]
    found, many = np.unique(uid[again & (idx != _SEVERAL)], return_counts=True)
    tasks = np.sort(frame.task.to_numpy(np.int64))
    cut = [*np.searchsorted(found, tasks).tolist(), len(found)]
    rows = [(t, (found[a:b] - t).astype("<u2").tobytes(), many[a:b].astype("<u4").tobytes()) for t, a, b in zip(tasks.tolist(), cut[:-1], cut[1:], strict=True) if b > a]
    return pd.DataFrame(rows, columns=["task", "docs", "many"])


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one pack: how many tokens of each document occur in other packs."""
    docs = np.concatenate([np.frombuffer(d, "<u2") for d in frame.docs]).astype(np.int64)
    total = np.bincount(docs, np.concatenate([np.frombuffer(m, "<u4") for m in frame.many]))
    at = np.flatnonzero(total)
    return pd.DataFrame({"uid": int(frame.task.iloc[0]) + at, "outside": total[at].astype(np.int64)})


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: the parity of its tokens in each of PARITY_BITS classes."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = doc * PARITY_BITS + ((token >> np.uint64(20)) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sets) * PARITY_BITS).reshape(len(sets), PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd, axis=1).view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, most=TEXT_AT_ONCE):
        sets = shingle_sets(batch.column("text"))
        for lo in range(0, len(sets), 500):
            some = sets[lo : lo + 500]
            s1, s2 = zip(*map(_signature, some), strict=True)
            sizes = np.array([len(h) for h in some])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = _parities(some)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, len(some)),
                    pa.array(sizes),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel())),
                ],
                names=["doc_id", "n", "s1", "s2", "h", "parity"],
            )


def _may_differ(x: str, y: str):
    """Whether parity sketches allow a link: they differ in no more places than the sets in tokens, a seventh of both at most."""
    apart = sum((F.bit_count(F.get(f"{x}.parity", F.lit(i)).bitwiseXOR(F.get(f"{y}.parity", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return 7 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _links(pairs: DataFrame, sets: DataFrame, sketched: bool = False) -> DataFrame:
    """The pairs (x, y) whose sets overlap enough; ``sketched``: their sketches have been compared."""
    if not sketched:
        small = sets.select("rid", "n", "parity")
        pairs = pairs.join(small.alias("b"), F.col("y") == F.col("b.rid")).join(small.alias("a"), (F.col("x") == F.col("a.rid")) & _may_differ("a", "b"))
        pairs = pairs.select("x", "y")
    left = sets.select(F.col("rid").alias("x"), F.col("h").alias("hx"))
    right = sets.select(F.col("rid").alias("y"), F.col("h").alias("hy"))
    both = F.size(F.array_intersect("hx", "hy"))
    enough = 100 * both >= 75 * (F.size("hx") + F.size("hy") - both)
    return pairs.join(right, "y").join(left, "x").filter(enough).select("x", "y")


def _may_link(a: str, b: str, before=0):
    """Bounds on lengths, on the tokens left behind the positions, with ``before`` common ones at most ahead, and on places."""
    col = lambda side, c: F.col(f"{side}.{c}")
    total = col(a, "n") + col(b, "n")
    rest_a, rest_b = col(a, "n") - col(a, "pos"), col(b, "n") - col(b, "pos")
    apart = F.abs(col(a, "pos") - col(b, "pos")) + F.abs(rest_a - rest_b)
    near = 4 * F.least(col(a, "n"), col(b, "n")) >= 3 * F.greatest(col(a, "n"), col(b, "n"))
    return near & (7 * apart <= total) & (7 * (F.least(rest_a, rest_b) + before) >= 3 * total)


def _ranked(sets: DataFrame) -> DataFrame:
    """rid, n, alone, rare, central, list: the tokens that another set has, from the rarest on, as far as any index needs them.

    ``alone`` tokens are in no other set and come first in the order; ``rare`` counts these and the rare ones.
    """
    tokens = sets.select("rid", F.explode("h").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(df, "token").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"), F.sum("df").alias("common"))
    rows = shared.join(sets.select("rid", "n"), "rid").withColumn("alone", F.col("n") - F.size("list"))
    rows = rows.filter(F.size("list") >= F.expr("(3 * n + 3) div 4"))
    rows = rows.withColumn("rare", F.col("alone") + F.size(F.filter("list", lambda t: t.df <= FREQUENT)))
    spare, apart = _budgets()
    most = F.greatest(F.col("n") - F.expr("(3 * n + 3) div 4") + 1 - F.col("alone"), F.col("rare") - F.col("alone") + spare + apart + COMBINE)
    return rows.select("rid", "n", "alone", "rare", (F.col("common") / F.col("n")).alias("central"), F.slice("list", F.lit(1), most.cast("int")).alias("list"))


def _budgets():
    """Of a set whose rare tokens a partner has none of: how many frequent ones the partner may lack, and how many may be in one of both alone."""
    own = F.col("n") - F.expr("(3 * n + 3) div 4") - F.col("rare")
    return F.greatest(own, F.lit(0)), F.greatest(F.expr("n div 3") - F.col("rare"), F.lit(0))


def _entries(ranked: DataFrame) -> DataFrame:
    """rid, n, central, token, pos (from 0): the prefix of which two sets that link share a token."""
    most = (F.col("n") - F.expr("(3 * n + 3) div 4") + 1 - F.col("alone")).cast("int")
    listed = ranked.filter(most > 0).select("rid", "n", "alone", "central", F.posexplode(F.slice("list", F.lit(1), most)).alias("at", "t"))
    return listed.select("rid", "n", "central", "t.token", (F.col("alone") + F.col("at")).alias("pos"))


def _keys(ranked: DataFrame) -> DataFrame:
    """rid, n, key, pos, ahead and before: rare tokens of the prefix, then combinations of frequent ones.

    ``pos`` is the place of the key's first token, ``ahead`` how many tokens before it may be common to
    a partner met here first, ``before`` the keys just before.
    """
    spare, apart = _budgets()
    few = F.least(F.col("rare"), F.col("n") - F.expr("(3 * n + 3) div 4") + 1) - F.col("alone")
    rare = F.transform(F.slice("list", F.lit(1), F.greatest(few, F.lit(0)).cast("int")), lambda t, i: F.struct(t.token.alias("key"), (F.col("alone") + i).alias("pos"), F.lit(0).cast("long").alias("ahead")))
    often = F.expr("slice(list, cast(rare - alone + 1 as int), size(list))")
    # With more rare tokens than a partner may lack, it shares one of them.
    many = F.when(F.col("rare") <= F.col("n") - F.expr("(3 * n + 3) div 4"), F.least(spare + apart + 1, F.greatest(F.size("often") - 1, F.lit(0)))).otherwise(F.lit(0))
    pair = lambda t, i: F.xxhash64(t.token, F.get("often", i + 1).token)
    combined = F.transform(F.slice("often", F.lit(1), many.cast("int")), lambda t, i: F.struct(pair(t, i).alias("key"), (F.col("rare") + i).alias("pos"), F.least(i.cast("long"), apart).alias("ahead")))
    rows = ranked.withColumn("often", often).select("rid", "n", F.concat(rare, combined).alias("k"))
    rows = rows.select("rid", "n", F.transform("k", lambda x: x.key).alias("all"), F.posexplode("k").alias("at", "k"))
    before = F.slice("all", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least(F.col("at"), F.lit(BEFORE)))
    return rows.select("rid", "n", "k.key", "k.pos", "k.ahead", before.alias("before"))


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, root) of all members, components joined by the links (x, y) between them."""
    edge = links.join(members.select(F.col("rid").alias("x"), F.col("root").alias("u")), "x").join(members.select(F.col("rid").alias("y"), F.col("root").alias("v")), "y")
    roots = connected_components(edge, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("least"))
    return materialise(members.join(roots, "root", "left").select("rid", F.coalesce("least", "root").alias("root")), "roots")


def _open(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with the root of each."""
    known = entries.join(members, "rid")
    several = known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    return known.join(several, "token")


def _grouped(sets: DataFrame) -> DataFrame:
    """(rid, root) for the sets that may have a link."""
    ranked = materialise(_ranked(sets), "ranked")
    entries = _entries(ranked)
    members = ranked.select("rid", F.col("rid").alias("root"))
    open_lists = entries.withColumn("root", F.col("rid"))
    used = None
    while True:
        rows = open_lists
        if used is not None:  # the largest component's, of those that haven't been
            size = rows.groupBy("token", "root").agg(F.count("*").alias("size"))
            rows = rows.join(size, ["token", "root"]).join(used, ["token", "rid"], "left_anti")
        best = F.max(F.struct(*(["size"] if used is not None else []), "central", "rid", "n", "pos", "root")).alias("c")
        centre = rows.groupBy("token").agg(best).select("token", "c.rid", "c.n", "c.pos", "c.root")
        centre = materialise(centre, "centres")
        star = open_lists.alias("a").join(centre.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b", F.least("a.pos", "b.pos")))
        compared = materialise(star.select(F.least("a.rid", "b.rid").alias("x"), F.greatest("a.rid", "b.rid").alias("y")).distinct(), "centre-pairs")
        links = materialise(_links(compared, sets), "links")
        found = links.count()
        if found:
            members = _joined(members, links)
        if WORTH * found < compared.count() or not found:
            break
        now = centre.select("token", "rid")
        used = now if used is None else used.union(now)
        open_lists = materialise(_open(entries, members), "open-lists")
    left = _open(entries, members).select("rid").distinct()
    keys = _keys(ranked.join(left, "rid", "left_semi")).join(members, "rid")
    several = keys.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    keys = keys.join(several, "key").join(sets.select("rid", "parity"), "rid")
    keys = materialise(keys, "keys")
    a, b = keys.alias("a"), keys.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & (F.col("a.root") != F.col("b.root"))
    on = on & _may_link("a", "b", F.least("a.ahead", "b.ahead")) & _may_differ("a", "b") & ~F.arrays_overlap("a.before", "b.before")
    pairs = a.join(b, on).select(F.col("a.rid").alias("x"), F.col("b.rid").alias("y")).distinct()
    new = materialise(_links(materialise(pairs, "pairs"), sets, sketched=True), "more-links")
    return members if new.isEmpty() else _joined(members, new)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, key (a hash of the text) and stays for every row.

    One row of each group stays: of those with the least id, the first read. A document without words has an empty set and is linked with nothing. Equal sets are linked, so
    repeated rows are, and a null id takes part; component_id is the least id that isn't null. A
    row without a link has its own id. An empty table gives an empty result. Long texts are cut into
    words whole. Only the two columns are read, the texts twice.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # As many hash ranges as keep a range about as large as a task's share, whatever the corpus.
    bits = max(6, min(24, (4 * rows.rdd.getNumPartitions() - 1).bit_length()))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    packed = materialise(keyed.mapInArrow(_packer(bits), PACKED), "packed")
    meta = packed.filter("bucket is null").select("doc_id", "key", "uid", "n", "s1", "s2", "inside")
    outside = packed.filter("bucket is not null").select("task", "bucket", "wide", "blob").groupBy("bucket")
    outside = outside.applyInPandas(_shared, "task long, docs binary, many binary").groupBy("task").applyInPandas(_added, "uid long, outside long")
    # k of the smallest set that could be a partner.
    enough = F.expr("3 * ((3 * n + 3) div 4) div 20 + 1")
    left = meta.filter("n > 0").join(outside, "uid", "left").filter(F.col("inside") + F.coalesce("outside", F.lit(0)) >= enough)
    left = materialise(left.select("doc_id", "uid", "n", "s1", "s2"), "candidates")
    # One document stands for each class of equal sets: the first that has an id.
    first = left.groupBy("n", "s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "uid", "doc_id")).alias("f"))
    classes = materialise(first.select("n", "s1", "s2", F.col("f.uid").alias("rid"), F.col("f.doc_id").alias("doc_id")), "classes")
    ids = classes.select(F.col("doc_id").alias("wanted")).distinct()
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    made = texts.mapInArrow(_sets, "doc_id long, n long, s1 long, s2 long, h array<long>, parity array<long>")
    own = classes.withColumnRenamed("doc_id", "c_doc")
    made = made.join(own, ["n", "s1", "s2"]).filter(F.col("doc_id").eqNullSafe(F.col("c_doc")))
    sets = materialise(made.select("rid", "n", "h", "parity").dropDuplicates(["rid"]), "sets")
    roots = _grouped(sets)
    label = classes.join(roots, "rid", "left").select("n", "s1", "s2", F.coalesce("root", "rid").alias("root"))
    member = materialise(left.join(label, ["n", "s1", "s2"]).select("uid", "doc_id", "root"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("f")
    least = member.groupBy("root").agg(first).select("root", F.col("f.doc_id").alias("component_id"), F.col("f.uid").alias("first"))
    member = member.join(least, "root").select("uid", "component_id", (F.col("uid") == F.col("first")).alias("stays"))
    out = meta.join(member, "uid", "left")
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own, "key", F.coalesce("stays", F.lit(True)).alias("stays"))
