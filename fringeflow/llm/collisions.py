"""Approximate nearest neighbours by counting collisions of single projections.

Every vector has one value per random projection.  In each block of vectors
the values of a projection form a sorted array.  A query opens a window
centred on its own value in every array and widens it round by round
(virtual rehashing); a vector inside the windows of at least ``threshold`` of
the projections is verified by its distance.  A query stops in a block as
soon as ``k`` verified vectors lie within the round's radius, or when the
windows hold the whole block.  The block's ``k`` nearest are merged over the
blocks.

Scale: vectors are dealt into blocks by a hash of the row, so copies and hot
labels spread; queries are dealt into query blocks, and every task joins one
of each.  The block sizes bound a task's memory, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import runs_of_groups
from .pivots import valid_vector


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str,
    vec_col: str,
    *,
    k: int = 10,
    projections: int = 96,
    threshold: float = 0.58,
    growth: float = 1.15,
    block: int = 16384,
    query_block: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """Up to ``k`` rows per query: (query_id, rank from 1, id, score), nearest first.

    ``score``: Euclidean distance in double precision; ties go to the smaller
    id.  A query's own id is never an answer.  Vectors that are null, empty,
    zero or hold null or non-finite parts take no part, on either side, and
    only vectors of the query's length are candidates.  Repeated rows of one
    id are answered once, at their smallest distance.  Empty tables give an
    empty result.  Other columns are neither read nor returned.
    """
    def side(df):
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(valid_vector("vec") & F.col("id").isNotNull())

    data, asked = side(vectors), side(queries)
    n_data, n_asked = data.count(), asked.count()
    d, q = -(-n_data // block) or 1, -(-n_asked // query_block) or 1
    deal = lambda df, n, salt: F.pmod(F.xxhash64("id", "vec", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("d", deal(data, d, 1)).withColumn("q", every(q)).withColumn("asks", F.lit(False))
    asked = asked.withColumn("q", deal(asked, q, 2)).withColumn("d", every(d)).withColumn("asks", F.lit(True))
    both = data.unionByName(asked)
    keys = ["d", "q"]
    both = both.repartition(max(d * q, 1), *keys).sortWithinPartitions(*keys, "asks")
    search = _search(k, projections, threshold, growth, seed, keys)
    found = both.select("d", "q", "asks", "id", "vec").mapInArrow(search, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _search(k: int, m: int, threshold: float, growth: float, seed: int, keys: list[str]):
    def run(batches):
        for t in runs_of_groups(batches, keys):
            group = np.stack([t.column(c).to_numpy() for c in keys])
            starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
            for s, e in zip(starts, np.r_[starts[1:], t.num_rows], strict=True):
                part = t.slice(s, e - s).combine_chunks()
                asks = part.column("asks").to_numpy()
                ids = part.column("id").to_numpy()
                vecs = part.column("vec").combine_chunks()
                lengths = vecs.value_lengths().to_numpy()
                for length in np.unique(lengths[asks]):
                    pick = lengths == length
                    x = vecs.take(pa.array(np.flatnonzero(pick))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                    mine = asks[pick]
                    out = _in_block(ids[pick][~mine], x[~mine], ids[pick][mine], x[mine], k, m, threshold, growth, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query_id", "id", "score"])

    return run


def _in_block(ids, x, q_ids, qs, k, m, threshold, growth, seed):
    """The ``k`` nearest of block ``x`` for each query in ``qs``, as far as the windows find them."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    a = np.random.default_rng(seed).standard_normal((x.shape[1], m))
    values = x @ a
    order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
    arrays = np.take_along_axis(values, order.T, axis=0).T
    # one array for all projections, each shifted into a range of its own: one search widens every window
    reach = 2 * float(np.abs(values).max(initial=0.0)) + 1
    shift = np.arange(m) * 8 * reach
    arrays = (arrays + shift[:, None]).ravel()
    needed = int(np.ceil(threshold * m))
    n = len(x)
    # the first radius: a small quantile of distances between a few vectors of the block
    some = x[:: max(1, n // 64)]
    first = np.quantile(np.sqrt(np.maximum(0, ((some[:, None] - some[None]) ** 2).sum(-1))), 0.05) / 4 if n else 1.0
    first = first if first > 0 else 1e-6
    out_q, out_i, out_s = [], [], []
    for q_id, q, at in zip(q_ids, qs, qs @ a, strict=True):
        counts = np.zeros(n, np.uint8 if m < 256 else np.int32)
        centre = np.clip(at, -reach, reach) + shift
        lo = np.clip(np.searchsorted(arrays, centre) - np.arange(m) * n, 0, n)
        hi = lo.copy()
        done = np.zeros(n, bool)
        near_i, near_s = np.zeros(0, np.int64), np.zeros(0)
        radius = first
        while True:
            half = min(radius, 2.5 * reach)
            lo2 = np.clip(np.searchsorted(arrays, centre - half) - np.arange(m) * n, 0, n)
            hi2 = np.clip(np.searchsorted(arrays, centre + half, "right") - np.arange(m) * n, 0, n)
            for j in range(m):
                counts[order[j, lo2[j] : lo[j]]] += 1
                counts[order[j, hi[j] : hi2[j]]] += 1
            lo, hi = lo2, hi2
            whole = bool(((lo == 0) & (hi == n)).all())
            new = np.flatnonzero((counts >= needed) & ~done)
            if len(new):
                done[new] = True
                apart = x[new] - q
                near_i = np.concatenate([near_i, new])
                near_s = np.concatenate([near_s, np.sqrt(np.einsum("ij,ij->i", apart, apart))])
                other = ids[near_i] != q_id
                near_i, near_s = near_i[other], near_s[other]
                best = np.lexsort((ids[near_i], near_s))
                best = best[np.unique(ids[near_i][best], return_index=True)[1]]  # one row an id
                best = best[np.lexsort((ids[near_i][best], near_s[best]))][:k]
                near_i, near_s = near_i[best], near_s[best]
            if whole or (len(near_s) == k and near_s[-1] <= radius):
                break
            radius *= growth
        out_q.append(np.full(len(near_i), q_id))
        out_i.append(ids[near_i])
        out_s.append(near_s)
    join = lambda xs, t: np.concatenate([np.zeros(0, t), *xs]).astype(t)
    return join(out_q, np.int64), join(out_i, np.int64), join(out_s, np.float64)
