"""SimHash near-duplicates judged by the exact Jaccard similarity of word shingles.

Fingerprints of 128 bits are indexed as ``simhash`` has it: inverted lists
over two fingerprint bytes of a block of positions, a tally of shared bytes,
verification by differing bits.  The lists are guaranteed to hold every pair
of at most ``NEAR`` differing bits, and only from there such pairs come.

At a similarity of 0.8 more bits differ (19.4 expected, with a spread of
4.1) and no byte need agree, so the rest has an exact way of its own.  Sets
whose similarity is ``threshold`` or more share an element within the first
``n - ceil(threshold * n) + 1`` of each, in any order common to all sets
(prefix filter), so lists per shingle of these prefixes hold every pair
wanted.  The order takes shingles that are common in a sample of the texts
last, then the smallest hash; the sample changes how long lists are, never
which pairs meet.  In a list the pairs go whose sizes rule the threshold out,
or that differ in more than ``FAR`` bits, 5.5 spreads above what is expected
at 0.8; sets of fewer than ``FEW`` shingles are not judged by bits.

What the index and the lists link connects texts to candidate groups, and
within each the shingle sets are compared exactly.

Scale: equal texts are collapsed first, by a 64-bit hash of the text.  Long
lists and large candidate groups are dealt into chunks whose pairs are cells
of their own, so a candidate group is compared at a cost that grows with the
square of its chunks.  Texts are read three times and never shuffled whole,
unless more than ``FEW_ROWS`` distinct ones are to be looked up; what moves
are prefixes, postings and the shingle sets of candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, contracted, dealt_lists, durable, free_name, runs_of_groups, spread_join
from .simhash import AT_ONCE, SHORT, fingerprints, linked_fingerprints, shingle_hashes

#: Differing bits of 128 up to which the index over fingerprint bytes holds every pair.
NEAR = 8

#: Differing bits of 128 up to which a pair is a candidate; sets under FEW shingles are candidates at any distance.
FAR, FEW = 42, 32

#: Texts sampled for the order of shingles; shingles of so many or more of them are common, the most common at most MOST.
SAMPLE, COMMON, MOST = 4096, 3, 1 << 16

#: Texts of a candidate group compared in one cell: two chunks of so many.
CHUNK = 512

#: Tables of a number and an id for each text up to so many rows are broadcast.
FEW_ROWS = 1 << 20


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; of one without a word a single zero, so that such texts are alike."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], np.uint64))


def _wanted(inter, n, m, threshold: float):
    return inter >= threshold * (n + m - inter) - 1e-9


def _candidates(x, y, n, m, threshold: float):
    """Which pairs may reach the threshold, by sizes and fingerprints; the last axis of x and y has the words."""
    fit = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    near = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32) <= FAR
    return fit & (near | (np.minimum(n, m) < FEW))


def _described(texts, width: int):
    """Per group of texts: their places, shingle sets and fingerprints."""
    places, sets, size = [], [], 0
    for i, t in texts:
        places.append(i)
        sets.append(shingle_set(t, width))
        size += len(sets[-1])
        if size >= AT_ONCE:
            yield places, sets, fingerprints([s.tolist() for s in sets], 2)
            places, sets, size = [], [], 0
    if places:
        yield places, sets, fingerprints([s.tolist() for s in sets], 2)


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles common in a sample, the most common last."""
    n = texts.agg(F.approx_count_distinct("node")).first()[0]
    share = min(1.0, SAMPLE / max(n, 1))
    some = texts.where(F.pmod("node", F.lit(1 << 40)) < int(math.ceil(share * (1 << 40)))).dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], ["h"])

    seen = some.select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    top = seen.orderBy(F.col("count").desc(), "h").limit(MOST).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def _prefixes(width: int, threshold: float, common: np.ndarray):
    order = np.argsort(common)
    known = common[order]

    def run(batches):
        for batch in batches:
            fps, counts, prefixes = [], [], []
            for _, sets, fp in _described(((i, t.as_py()) for i, t in enumerate(batch.column(2))), width):
                fps.append(fp)
                for s in sets:
                    n = len(s)
                    counts.append(n)
                    if n and len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[at] == s, order[at] + 1, 0), kind="stable")]
                    prefixes.append(s[: n - math.ceil(threshold * n - 1e-9) + 1].tobytes())
            if counts:
                a, b = np.concatenate(fps).view(np.int64).T
                columns = [batch.column(0), batch.column(1), pa.array(a), pa.array(b), pa.array(counts, pa.int32()), pa.array(prefixes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "node", "f0", "f1", "n", "prefix"])

    return run


def _post(batches):
    for batch in batches:
        node, f0, f1, n = (batch.column(c).to_numpy() for c in ("node", "f0", "f1", "n"))
        prefix = batch.column("prefix").to_pylist()
        times = np.array([len(p) // 8 for p in prefix], int)
        token = pa.array(np.frombuffer(b"".join(prefix), np.int64))
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, times)) for x in (node, f0, f1, n)), token], ["node", "f0", "f1", "n", "token"])


def _groups(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return starts, np.r_[starts[1:], t.num_rows]


def _spread(n: int, near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links from the first member of each group connected; ``near(some, rest)``: which of rest are linked to any of some."""
    a, b, rest = [], [], np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        front = np.array([first])
        while len(front) and len(rest):
            hit = near(front, rest)
            front, rest = rest[hit], rest[~hit]
            a.append(np.full(len(front), first))
            b.append(front)
    return a, b


def _links(threshold: float, keys: list[str]):
    """Candidate links within posting lists, but those that the index over fingerprint bytes has; contracted to one a text."""

    def run(batches):
        for t in runs_of_groups(batches, keys):
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            fp = np.stack([t.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
            starts, ends = _groups(t, keys)
            a_all, b_all = [], []
            for size in np.unique(ends - starts):
                if not 1 < size <= SHORT:
                    continue
                i, j = np.triu_indices(size, 1)
                first = starts[ends - starts == size]
                for some in np.array_split(first, 1 + len(first) * len(i) // (1 << 18)):
                    a, b = ((some[:, None] + k).ravel() for k in (i, j))
                    hit = _candidates(fp[a], fp[b], n[a], n[b], threshold)
                    a_all.append(a[hit])
                    b_all.append(b[hit])
            for s, e in zip(starts, ends, strict=True):
                if e - s <= SHORT:
                    continue

                def near(some, rest, s=s):
                    hit = np.zeros(len(rest), bool)
                    for part in np.array_split(some, 1 + len(some) * len(rest) // (1 << 20)):
                        hit |= _candidates(fp[s + part, None], fp[None, s + rest], n[s + part, None], n[None, s + rest], threshold).any(axis=0)
                    return hit

                a, b = _spread(e - s, near)
                a_all += [x + s for x in a]
                b_all += [x + s for x in b]
            if a_all:
                a, b = np.concatenate(a_all), np.concatenate(b_all)
                far = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=-1, dtype=np.int32) > NEAR
                links = np.unique(np.stack([node[a[far]], node[b[far]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    def once(batches):
        for batch in contracted(run(batches)):
            yield batch.rename_columns(["a", "b"])

    return once


def _verify(threshold: float, keys: list[str]):
    """Links of the threshold within cells of candidate groups."""

    def cell(fp, sets):
        n = np.array([len(s) for s in sets])
        ends = np.cumsum(n)
        starts = ends - n
        kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(kinds), bool)

        def near(some, rest):
            hit = np.zeros(len(rest), bool)
            for f in some:
                may = np.flatnonzero(~hit & _candidates(fp[f], fp[rest], n[f], n[rest], threshold))
                own = ids[starts[f] : ends[f]]
                mark[own] = True
                inter = np.array([np.count_nonzero(mark[ids[starts[r] : ends[r]]]) for r in rest[may]], int)
                hit[may] = _wanted(inter, n[f], n[rest[may]], threshold)
                mark[own] = False
            return hit

        return _spread(len(sets), near)

    def run(batches):
        for t in runs_of_groups(batches, keys):
            node = t.column("node").to_numpy()
            fp = np.stack([t.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
            sets = t.column("shingles").to_pylist()
            for s, e in zip(*_groups(t, keys), strict=True):
                some = s + np.unique(node[s:e], return_index=True)[1]  # a repeated row may stand for its text twice
                a, b = cell(fp[some], [np.frombuffer(sets[i], np.uint64) for i in some])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(node[some[np.concatenate(x)]]) for x in (a, b)], ["a", "b"])

    return run


def _sets(width: int):
    """(root, node, text) to the text's shingle set and fingerprint."""

    def run(batches):
        for batch in batches:
            for places, sets, fp in _described(((i, t.as_py()) for i, t in enumerate(batch.column(2))), width):
                part = batch.take(pa.array(places))
                columns = [part.column(0), part.column(1), *(pa.array(c) for c in fp.view(np.int64).T), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["root", "node", "f0", "f1", "shingles"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted and small."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def indexed_links(nodes: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of at most ``NEAR`` differing bits connect, by the index over fingerprint bytes."""
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    own = nodes.select("node", F.concat(word("f0"), word("f1")).alias("fp"))
    first = durable(own.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("count")))
    same = spread_join(own, first.select("fp", "first"), "fp", "node", first.select("fp", "count")).where("node <> first")
    links = linked_fingerprints(first.select(F.col("first").alias("node"), "fp"), 128, NEAR, block)
    return links.unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b")))


def similar_links(texts: DataFrame, nodes: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of nodes that connect what all pairs of the threshold connect; ``texts``: id, node, text; ``nodes``: each node's rep, f0, f1, n, prefix."""
    posted = nodes.mapInArrow(_post, "node long, f0 long, f1 long, n int, token long")
    keys = ["token", "lo", "hi"]
    parts = dealt_lists(posted, "token", "node", block).drop("own").repartition(*keys).sortWithinPartitions(*keys)
    rest = parts.mapInArrow(_links(threshold, keys), "a long, b long")
    groups = connected_components(rest.unionByName(indexed_links(nodes, block)))

    members = durable(groups.join(nodes.select("node", "rep"), "node"))
    wanted = members.select(F.col("node").alias("member"), "rep", "root")
    same = (F.col("node") == F.col("member")) & F.col("id").eqNullSafe(F.col("rep"))
    held = texts.join(_small(wanted), same).select("root", "node", "text").mapInArrow(_sets(width), "root long, node long, f0 long, f1 long, shingles binary")
    keys = ["root", "lo", "hi"]
    cells = dealt_lists(held, "root", "node", CHUNK, members).drop("own").repartition(*keys).sortWithinPartitions(*keys)
    return cells.mapInArrow(_verify(threshold, keys), "a long, b long")


def without_similar(df: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: float = 0.8, block: int = 4096) -> DataFrame:
    """One row of ``df`` for each group of similar texts: that of the smallest id; same columns.

    Groups are what links of a Jaccard similarity of ``threshold`` or more
    connect, between the sets of lower-cased shingles of ``width`` words;
    texts of fewer words are one shingle, null texts and those without a word
    are alike.  Null ids come after all others, then the smaller hash of the
    text decides.  Of repeated rows one stays.  An empty table gives an empty
    result; texts are read whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    known = common_shingles(texts, width)
    described = texts.mapInArrow(_prefixes(width, threshold, known), "id long, node long, f0 long, f1 long, n int, prefix binary")
    one = [F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("f0", "f1", "n", "prefix")]]
    nodes = durable(described.groupBy("node").agg(*one))
    comps = connected_components(similar_links(texts, nodes, width, threshold, block))
    labelled = nodes.select("node", "rep", "copies").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = labelled.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "node"))["node"].alias("chosen"))
    chosen = spread_join(labelled, first, "root", "node").withColumn("kept", F.col("node") == F.col("chosen"))

    # rows to look at: those of texts that go, and of those that stay but stand in several rows
    n, rep, kept = (free_name(df, c) for c in ("text_node", "text_rep", "text_kept"))
    looked = durable(chosen.where("copies > 1 or not kept").select(F.col("node").alias(n), F.col("rep").alias(rep), F.col("kept").alias(kept)))
    marked = df.withColumn(n, F.xxhash64(text))
    alone = marked.join(_small(looked), n, "left_anti")
    several = marked.join(_small(looked.where(F.col(kept))), n).where(F.col(id_col).cast("long").eqNullSafe(F.col(rep))).dropDuplicates([n])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return alone.select(*columns).unionByName(several.select(*columns))
