"""Best-fit packing of tokenised documents into sequences of bounded length.

The plan is made from the histogram of piece lengths (at most ``capacity`` numbers), so it costs
the same for any corpus. First a Martello-Toth reduction: going down the lengths, a set that
provably dominates every other set holding its largest piece is fixed for good. The remainder is
packed by best-fit decreasing. The plan says which ranks of a length go where; ranks come from a
count kept in each task and prefix sums over tasks, so no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.llm.tokens import ENCODE_AT_ONCE, Encoder, in_slices
from lamellar.sources.storage import materialise

#: Counts by length and task up to this many, 24 bytes each, are broadcast; beyond, pieces are shuffled to them.
MOST_BROADCAST = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document; null text is empty, so it has the end id alone.

    Of a long text every piece but the last is full; an empty table gives no pieces.

    ``nth`` counts pieces of the same length within the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer, drops_space=True)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in in_slices(batches, most=ENCODE_AT_ONCE):
            ids, at = encoder.encode(batch.column("text"))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            many = -(-np.diff(at) // capacity)
            doc = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(np.diff(at)[doc] - start, capacity)
            begin = at[doc] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array(np.full(len(doc), task, np.int64)),
                    pa.array(nth),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where pieces go: (length, first rank, sequence of that rank, offset), and the sequences used.

    The pieces of one entry have consecutive ranks and go to consecutive sequences at one offset;
    an entry ends where the next one of its length begins.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(length: int, many: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], sequence, offset))
        used[length] += many

    # Reduction: a piece alone if nothing fits beside it; with the largest piece that fits if only
    # one more fits, or the two fill the sequence, or no pair of others takes more room.
    present = sorted(left)
    for big in sorted(left, reverse=True):
        while left.get(big, 0):
            room = capacity - big
            left[big] -= 1  # one copy is the one looked at
            others = [n for n in present[: bisect.bisect_right(present, room)] if left.get(n, 0)]
            left[big] += 1
            if not others:
                many = left[big]
                put(big, many, bins, 0)
                left[big] = 0
                bins += many
                break
            best = others[-1]
            small, fits, total = iter(others), 0, 0
            for n in small:  # how many of the smallest fit, up to three
                copies = left[n] - (n == big)
                take = min(copies, (room - total) // n, 3 - fits)
                fits, total = fits + take, total + take * n
                if take < copies or fits == 3:
                    break
            sure = best == room or fits == 1
            if not sure and fits == 2:
                pair = max((a + b for a in others for b in others[bisect.bisect_right(others, room - a) - 1 :][:1] if a + b <= room and (a != b or left[a] - (a == big) > 1)), default=0)
                sure = best >= pair
            if not sure:
                break
            many = left[big] // 2 if best == big else min(left[big], left[best])
            put(big, many, bins, 0)
            put(best, many, bins, big)
            left[big] -= many
            left[best] -= many
            bins += many

    # Best fit, decreasing: the tightest open sequences first, as many copies as fit in each.
    spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if not spaces[room]:
                bisect.insort(rooms, room)
            spaces[room].append((first, many))

    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = spaces[room].pop()
                if not spaces[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, bins
                many = -(-left[length] // (capacity // length))
                bins += many
            copies = room // length
            full = min(many, left[length] // copies)
            for k in range(copies if full else 0):
                put(length, full, first, capacity - room + k * length)
            left[length] -= full * copies
            leave(room - copies * length, first, full)
            rest = left[length] if full < many else 0  # fewer than would fill one more
            for k in range(rest):
                put(length, 1, first + full, capacity - room + k * length)
            left[length] -= rest
            if full < many:
                leave(room - rest * length, first + full, 1)
                leave(room, first + full + 1, many - full - 1)
    return out, bins


def _placer(lengths: np.ndarray, ranks: np.ndarray, sequences: np.ndarray, offsets: np.ndarray):
    order = np.lexsort((ranks, lengths))
    # One sorted key for a search by length, then rank.
    keys = (lengths[order] << np.int64(48)) + ranks[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = order[np.searchsorted(keys, (length << np.int64(48)) + rank, side="right") - 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null text is packed as its end id. Rows with a null id or equal ids are packed like others; an
    empty table gives an empty result. Other columns aren't read.
    Only (length, task) counts are gathered by length: as many rows as there are tasks at most.
    """
    made = materialise(pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    entries, _ = plan(counts, capacity)
    columns = [np.array(c, dtype=np.int64) for c in zip(*entries, strict=True)] if entries else [np.zeros(1, np.int64)] * 4
    if by_task.count() <= MOST_BROADCAST:
        base = F.broadcast(base)
    ranked = made.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(*columns), schema)
