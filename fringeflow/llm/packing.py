"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it; no word
is dropped.  Pieces are dealt by hash into shards of about ``shard_size``
words, so a shard's rows are bounded and a hot source spreads.  In a shard,
pieces go largest first into the open sequence with the least room that
still holds them; where none does, a sequence of the least-cost length opens.
At the end every sequence is downsized to the shortest permitted length that
holds its contents.

The least cost of opening: a length is weighed by the padding that the rest
of the shard's sizes would leave in it, filled greedily from the sizes not
yet placed, plus a fixed cost per sequence, per word held.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, runs_of_groups


#: Tasks at most; shards are dealt to them in turn.
MOST_TASKS = 20_000


def best_fit(sizes: np.ndarray, lengths: Sequence[int], overhead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """(sequence, slot, offset) of each piece, and each sequence's length and words, for sizes sorted falling."""
    lengths = sorted(lengths)
    left = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()  # pieces not yet placed, by size
    present = sorted({int(s) for s in sizes})
    rooms: list[int] = []  # the distinct rooms of open sequences, rising
    open_by_room: dict[int, list[int]] = {}
    seq, slot, offset = (np.zeros(len(sizes), np.int64) for _ in range(3))
    used: list[int] = []
    opened: list[int] = []
    held: list[int] = []

    def cost(length: int, first: int) -> float:
        room, words = length - first, first
        k = bisect_left(present, room + 1) - 1
        while room and k >= 0:
            s = present[k]
            n = min(room // s, left[s] - (s == first)) if s else 0
            if n > 0:
                room -= n * s
                words += n * s
            k = min(k - 1, bisect_left(present, room + 1) - 1)
        return (overhead + length) / words

    best_for: dict[int, tuple[int, int]] = {}
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[k]
        else:
            b = len(used)
            chosen, until = best_for.get(s, (0, 0))
            if b >= until:  # weighed anew as the stock shrinks
                chosen = min((c for c in lengths if c >= s), key=lambda c: (cost(c, s), c))
                best_for[s] = (chosen, b + 1 + left[s] // 8)
            room = chosen
            used.append(0)
            held.append(0)
            opened.append(room)
        left[s] -= 1
        seq[i], slot[i], offset[i] = b, held[b], used[b]
        used[b] += s
        held[b] += 1
        room -= s
        if room:
            if room not in open_by_room:
                insort(rooms, room)
                open_by_room[room] = []
            open_by_room[room].append(b)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return seq, slot, offset, final, used


def pack_documents(
    df: DataFrame,
    id_col: str,
    size: Column,
    *,
    lengths: Sequence[int] = (512, 1024, 2048, 4096),
    overhead: float = 8.0,
    shard_size: int = 1 << 22,
    seed: int = 5,
) -> DataFrame:
    """One row per piece: (sequence_id, capacity, used, slot, offset, id, piece, start, size).

    ``size`` is a long expression over ``df``; rows of null or no size have
    no piece.  ``start`` is the piece's first word in its document, ``offset``
    its place in the sequence.  Repeated rows are packed each, told apart by
    a number.  Null ids are packed like others.  The result depends on the
    rows alone, not on how they are partitioned: pieces of equal size go by
    id, then piece, then copy.  An empty table gives an empty result.  Other columns
    are read only as far as ``size`` needs them, and not returned.
    """
    top = max(lengths)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("words")).where("words > 0")
    rows = durable(rows.groupBy("id", "words").count())
    total = rows.agg(F.coalesce(F.sum(F.col("words") * F.col("count")), F.lit(0))).first()[0]
    shards = int(-(-total // shard_size) or 1)
    # copies of a row are numbered, in two steps so that no array is long
    zero, some = F.lit(0).cast("long"), F.lit(1 << 16).cast("long")
    each = rows.withColumn("run", F.explode(F.sequence(zero, F.floor((F.col("count") - 1) / some))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("run") * some, F.least(F.col("count"), (F.col("run") + 1) * some) - 1)))
    pieces = each.withColumn("piece", F.explode(F.sequence(zero, F.floor((F.col("words") - 1) / top))))
    pieces = pieces.withColumn("start", F.col("piece") * top)
    pieces = pieces.withColumn("size", F.least(F.lit(top).cast("long"), F.col("words") - F.col("start")))
    shard = F.pmod(F.xxhash64("id", "words", "piece", "copy", F.lit(seed)), F.lit(shards)).cast("int")
    pieces = pieces.select(shard.alias("shard"), "id", "piece", "start", "size", "copy")
    pieces = pieces.repartitionById(min(shards, MOST_TASKS), F.col("shard") % min(shards, MOST_TASKS))
    pieces = pieces.sortWithinPartitions("shard", F.desc("size"), "id", "piece", "copy")

    def run(batches):
        for t in runs_of_groups(batches, ["shard"]):
            shard = t.column("shard").to_numpy()
            cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(s, e - s).combine_chunks()
                seq, slot, offset, final, used = best_fit(part.column("size").to_numpy(), lengths, overhead)
                out = {
                    "sequence_id": (int(shard[s]) << 32) + seq,
                    "capacity": np.array(final, np.int64)[seq],
                    "used": np.array(used, np.int64)[seq],
                    "slot": slot,
                    "offset": offset,
                }
                columns = [pa.array(v) for v in out.values()]
                for c in ("id", "piece", "start", "size"):
                    x = part.column(c)
                    columns.append(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
                yield pa.RecordBatch.from_arrays(columns, [*out, "id", "piece", "start", "size"])

    schema = "sequence_id long, capacity long, used long, slot long, offset long, id long, piece long, start long, size long"
    return pieces.select("shard", "id", "piece", "start", "size").mapInArrow(run, schema).withColumnRenamed("id", id_col)
