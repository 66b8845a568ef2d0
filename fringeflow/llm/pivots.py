"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by the ordered list of its ``prefix`` nearest
reference points (pivots), seen from the centre of a sample, so that vectors
of one narrow cone have lists of their own too.  Two vectors are compared
only if they share at least two pivots of those lists.  The inverted lists are kept for every two
pivots, so that a list already holds only vectors
with the wanted shared-pivot count; a pair that meets in several lists is
counted in the one of its smallest common pivots alone.  Pairs are verified
by cosine in double precision inside the list's task, and only per-vector
link counts and links to the list's smallest connected vector leave it.

Scale: exact copies are collapsed first, with map-side combine.  A list
longer than ``block`` is dealt into chunks and every pair of chunks is a
group of its own, so no task holds more than two chunks at once.  The pivots
come from a bounded sample of ``sample`` vectors; every vector is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealt_lists, durable, local_components, runs_of_groups, spread_join

#: Groups up to this many vectors are compared as index pairs, larger ones as matrices.
SMALL = 48


def valid_vector(vec: str):
    """True where a vector is not null, not empty, finite and not zero."""
    x = F.col(vec)
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & ok & F.exists(x, lambda e: e != 0), F.lit(False))


@dataclass
class Pivots:
    """Reference points of one vector length: the centre, and unit vectors seen from there."""

    centre: np.ndarray
    points: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest pivots of each row, in order."""
        return np.argsort(-((x - self.centre) @ self.points.T), axis=1, kind="stable")[:, :n]


def random_pivots(length: int, n_pivots: int) -> Pivots:
    """Pivots for a length that the sample lacks: directions drawn by a seed."""
    return Pivots(np.zeros(length), unit(np.random.default_rng(length).standard_normal((n_pivots, length))))


def _spread(x: np.ndarray, most: int, apart: float) -> list[int]:
    """Rows of ``x``, each the farthest from those before, as long as its cosine to all of them is at most ``apart``."""
    taken, near = [0], x @ x[0]
    while len(taken) < min(most, len(x)):
        k = int(np.argmin(near))
        if near[k] > apart:
            break
        taken.append(k)
        near = np.maximum(near, x @ x[k])
    return taken


def choose_pivots(vectors: DataFrame, vec: str, n_pivots: int, sample: int, apart: float) -> dict[int, Pivots]:
    """``n_pivots`` pivots per vector length, spread out.

    The sample is the ``sample`` distinct vectors of smallest hash, a bound
    on what reaches the driver.  Of vectors with cosines above ``apart`` one
    stands for all, so that a group of near copies neither gives several
    pivots, which noise would order, nor moves the centre, the mean of those
    that stand.  Pivots are taken farthest first, seen from the centre;
    lengths with fewer of them get directions drawn by a seed for the rest.
    """
    rows = vectors.select(vec).distinct().orderBy(F.xxhash64(vec), F.col(vec)).limit(sample).collect()
    by_length: dict[int, list] = {}
    for (v,) in rows:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for length, vs in by_length.items():
        x = unit(np.array(vs, dtype=np.float64))
        x = x[_spread(x, len(x), apart)]
        centre = x.mean(axis=0) if len(x) > 2 else np.zeros(length)
        x = x - centre
        x = unit(x[np.abs(x).max(axis=1) > 1e-12])
        x = x[_spread(x, n_pivots, 1.0)] if len(x) else x
        out[length] = Pivots(centre, np.concatenate([x, random_pivots(length, n_pivots).points])[:n_pivots])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest part first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length lists as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def near_duplicate_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    group_col: str | None = None,
    *,
    threshold: float = 0.93,
    n_pivots: int = 128,
    prefix: int = 6,
    block: int = 2048,
    sample: int = 2048,
) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    ``n_links``: other rows at cosine ``threshold`` or more, same group;
    ``component_id``: smallest id reachable by links; ``kept``: id equals it.
    Null groups, null, empty or zero vectors and vectors with null or
    non-finite parts link with nothing: no links, their own id.  Vectors of
    different lengths never link.  Repeated rows are copies of each other and
    count as links.  Ids are whole numbers.  An empty table gives an empty
    result.  Other columns of ``df`` are neither read nor returned.
    """
    group = F.col(group_col) if group_col else F.lit(0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), F.col(vec_col).alias("vec"))
    usable = valid_vector("vec") & F.col("grp").isNotNull()
    good = rows.where(usable)
    distinct = good.groupBy("grp", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = durable(distinct.withColumn("node", F.monotonically_increasing_id()))

    pivots = choose_pivots(distinct, "vec", n_pivots, sample, threshold - 0.1)
    keyed = distinct.select("node", F.col("grp").cast("string").alias("grp"), "copies", "vec").mapInArrow(
        _describe(pivots, prefix, n_pivots), "node long, copies long, bits_lo long, bits_hi long, list_key long, p1 int, p2 int"
    )
    found = durable(_verify(keyed, distinct.select("node", "vec"), threshold, block))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = distinct.select("node", "rep").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_node = spread_join(labelled, smallest, "root", "node").select("node", "component_id").join(counts, "node", "left")
    classes = distinct.join(per_node, "node").select(
        "grp", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = good.join(classes, ["grp", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _bits(pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit ``pivot`` of 128, as two words."""
    one = np.uint64(1) << (pivot % 64).astype(np.uint64)
    zero = np.uint64(0)
    return np.where(pivot < 64, one, zero), np.where(pivot < 64, zero, one)


def _describe(pivots: dict[int, Pivots], prefix: int, n_pivots: int):
    """A row for each vector and each two pivots of its prefix: the list's key and all the prefix's pivots as bits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("vec").value_lengths().to_numpy()
            groups = batch.column("grp").to_pylist()
            for length in np.unique(lengths):
                pick = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(pick))
                x = unit(_matrix(part.column("vec")))
                p = pivots.get(int(length)) or random_pivots(int(length), n_pivots)
                n_use = min(prefix, len(p.points))
                order = p.nearest(x, n_use)
                order.sort(axis=1)  # which pivots are in the prefix is settled; lists go by their numbers
                halves = [np.bitwise_or.reduce(h, axis=1).view(np.int64) for h in _bits(order)]
                seeds = np.array([hash_text(f"{groups[i]}|{length}") for i in pick], np.uint64)
                for c, d in list(combinations(range(n_use), 2)) or [(0, 0)]:
                    p1, p2 = order[:, c].astype(np.int32), order[:, d].astype(np.int32)
                    key = mix(seeds ^ (p1.astype(np.uint64) * np.uint64(4096) + p2.astype(np.uint64) + np.uint64(1)))
                    columns = [part.column("node"), part.column("copies"), *map(pa.array, (*halves, key.view(np.int64), p1, p2))]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "copies", "bits_lo", "bits_hi", "list_key", "p1", "p2"])

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _verify(keyed: DataFrame, vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root) of the verified pairs in each inverted list; vectors join the postings last and move once per list."""
    parts = dealt_lists(keyed, "list_key", "node", block)
    parts = parts.join(vectors, "node")
    keys = ["list_key", "lo", "hi"]
    parts = parts.repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(_compare(threshold, keys), "node long, links long, root long")


def _compare(threshold: float, keys: list[str]):
    def run(batches):
        for t in runs_of_groups(batches, keys):
            t = t.combine_chunks()
            col = {c: t.column(c).to_numpy() for c in t.column_names if c != "vec"}
            changed = np.zeros(t.num_rows, bool)
            changed[0] = True
            for c in keys:
                changed[1:] |= col[c][1:] != col[c][:-1]
            starts = np.flatnonzero(changed)
            ends = np.r_[starts[1:], t.num_rows]
            vecs = t.column("vec").combine_chunks()
            offsets, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy(zero_copy_only=False)
            small = (ends - starts) <= SMALL
            links = np.zeros(t.num_rows, np.int64)
            pairs = [np.stack(np.triu_indices(e - s, 1)) + s for s, e in zip(starts[small], ends[small], strict=True)]
            a, b = _pairs(*np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), col, flat, offsets, threshold)
            np.add.at(links, a, col["copies"][b])
            np.add.at(links, b, col["copies"][a])
            root = local_components(t.num_rows, a, b)
            for s, e in zip(starts[~small], ends[~small], strict=True):
                links[s:e], root[s:e] = _block(s, e, col, flat, offsets, threshold)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (col["node"][hit], links[hit], col["node"][root[hit]])], ["node", "links", "root"]
            )

    return run


def _own_list(p1: np.ndarray, p2: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both words: the list's two pivots, and all pivots up to the larger."""
    out = []
    for w in (0, 1):
        mine = _bits(p1)[w] | _bits(p2)[w]
        top = _bits(p2)[w]
        upto = top | (top - np.uint64(1)) if w else np.where(top > 0, top | (top - np.uint64(1)), ~np.uint64(0))
        out.append((mine, np.where(top > 0, upto, np.uint64(0)) if w else upto))
    return out


def _pairs(a, b, col, flat, offsets, threshold, at_once: int = 100_000):
    """Those index pairs that their list counts and whose cosine reaches the threshold."""
    keep = (col["lo"][a] == col["hi"][a]) | (col["own"][a] != col["own"][b])
    for word, (mine, upto) in zip(("bits_lo", "bits_hi"), _own_list(col["p1"], col["p2"]), strict=True):
        bits = col[word].view(np.uint64)
        keep &= (bits[a] & bits[b] & upto[a]) == mine[a]
    a, b = a[keep], b[keep]
    linked = np.zeros(len(a), bool)
    widths = np.diff(offsets)
    for width in np.unique(widths[a]):
        for k in np.array_split(np.flatnonzero(widths[a] == width), 1 + len(a) // at_once):
            part = np.arange(width)
            x, y = (unit(flat[offsets[i[k], None] + part].astype(np.float64)) for i in (a, b))
            linked[k] = np.einsum("ij,ij->i", x, y) >= threshold
    return a[linked], b[linked]


def _block(s, e, col, flat, offsets, threshold):
    """Link counts and component roots inside one large list, by matrix products."""
    x = unit(flat[offsets[s] : offsets[e]].reshape(e - s, -1).astype(np.float64))
    own = col["own"][s:e]
    linked = x @ x.T >= threshold
    linked &= own[:, None] != own[None] if col["lo"][s] != col["hi"][s] else ~np.eye(e - s, dtype=bool)
    for word, (mine, upto) in zip(("bits_lo", "bits_hi"), _own_list(col["p1"][s : s + 1], col["p2"][s : s + 1]), strict=True):
        bits = col[word][s:e].view(np.uint64) & upto
        linked &= (bits[:, None] & bits[None]) == mine
    links = linked @ col["copies"][s:e]
    root = np.arange(e - s)
    while True:
        low = np.where(linked, root[None], e - s).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return links, root + s
        root = new
