"""Shared pieces: tables, durable cuts of lineage, components, group streams."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every word count in this package takes it: a run of characters
#: that are none of space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset on one machine (tests) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Rows of a small table that the driver takes and broadcasts.
FEW_LISTS = 50_000


def few_rows(df: DataFrame) -> DataFrame | None:
    """``df`` cut from its lineage, to be broadcast where it has at most ``FEW_LISTS`` rows; None where it has none.

    Few rows go by the driver and leave no files: a checkpoint has a file for
    every task, and for each of these a local file system starts processes.
    """
    some = df.limit(FEW_LISTS + 1).toArrow()
    if some.num_rows > FEW_LISTS:
        return durable(df)
    return F.broadcast(df.sparkSession.createDataFrame(some, df.schema)) if some.num_rows else None


def words_of(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet, compared as Spark does."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


#: Links contracted in one task, about; a hub's rows that go to one task of a join.
LINKS_AT_ONCE, HUB = 1 << 14, 1 << 12


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to links from each node to the smallest one connected here; at most one a node."""
    a = b = np.zeros(0, np.int64)

    def forest(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(len(nodes), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[moved], nodes[root[moved]]

    fresh = 0
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        fresh += batch.num_rows
        if fresh > max(1 << 16, len(a) // 2):
            a, b = forest(a, b)
            fresh = 0
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key, may be missing), a hot key's rows dealt over tasks.

    Keys of more than ``HUB`` rows of ``left`` are counted with map-side
    combine; there is at most one per ``HUB`` rows, and each is dealt by a
    hash of ``by`` into parts of about ``HUB``, for which its row of
    ``right`` is repeated.  ``counted``: (key, count) of ``left``, where
    that is known.
    """
    hubs = (left.groupBy(key).count() if counted is None else counted).where(F.col("count") > HUB)
    hubs = few_rows(hubs.select(key, F.ceil(F.col("count") / HUB).cast("int").alias("_parts")))
    if hubs is None:
        return left.join(right, key, "left")
    dealt = left.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    again = right.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(again, [key, "_part"], "left").drop("_part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list of longs.

    ``root`` is the smallest node reachable.  Tasks of about
    ``LINKS_AT_ONCE`` links contract them to one link a node, from it to the
    smallest node connected there (its local root).  A node keeps the
    smallest of its local roots; its other local roots, and itself if it is
    one in another task, are linked to that one, which leaves a graph of
    local roots alone, contracted in the same way until one task holds it.  A component's largest node is no local
    root anywhere, so every level has fewer nodes, by a third on random
    paths; a node has at most one link per task, so none is a hub, and the
    way back, where a component's nodes share a root, is a join that deals
    hot keys.  Nothing but the sizes of hot keys is gathered on the driver,
    and lineage is cut by reliable checkpoints, the edges' own too, so they
    need none before.  Null ends and self-links are ignored; an empty list
    gives an empty result.
    """
    links = durable(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")))
    found = _levels(links)
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).union(found.select(F.col("v"), F.col("v")).distinct())


def _levels(links: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, with the smallest; ``links`` are durable."""
    parts = -(-links.count() // LINKS_AT_ONCE) or 1
    local = durable(links.coalesce(parts).mapInArrow(contracted, "u long, v long"))
    if parts == 1:
        return local
    low = durable(local.groupBy("u").agg(F.min("v").alias("m")))
    between = local.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    elsewhere = low.join(local.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    roots = _levels(durable(between.union(elsewhere).distinct()))
    up = spread_join(low, roots.select(F.col("u").alias("m"), F.col("v").alias("top")), "m", "u")
    return durable(up.select("u", F.coalesce("top", "m").alias("v")).union(roots).distinct())


def dealt_lists(posted: DataFrame, key: str, node: str, block: int, counted: DataFrame | None = None) -> DataFrame:
    """Postings with ``own``, ``lo``, ``hi``: a list's chunk of each row, and the two chunks compared where it goes.

    Lists of more than ``block`` rows are dealt into chunks by a hash of the
    node, and every row goes to each pair of chunks that holds its own.  Only
    the sizes of such lists are joined back, broadcast if they are few;
    postings of all others are not moved here.  ``counted`` stands in for the
    postings where a cheaper table has the same keys as often.
    """
    long = (posted if counted is None else counted).groupBy(key).count().where(F.col("count") > block)
    long = few_rows(long.select(key, F.ceil(F.col("count") / block).cast("int").alias("chunks")))
    zero = F.lit(0)
    if long is None:
        return posted.withColumns({"own": zero, "lo": zero, "hi": zero})
    parts = posted.join(long, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    parts = parts.withColumn("own", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parts.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("chunks", "other")


def runs_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from record batches sorted by ``keys``.

    Each table holds one or more complete groups; only the rows of the group
    that a batch leaves open are carried over, so memory is bounded by the
    batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= col[1:] != col[:-1]
            if held:
                last = held[-1].column(k)
                changes[0] |= col[0] != last[len(last) - 1].as_py()
        cut = np.flatnonzero(changes)
        if held and len(cut):
            done = pa.Table.from_batches([*held, batch.slice(0, cut[0])])
            held = []
            yield done
            if len(cut) > 1:
                yield pa.Table.from_batches([batch.slice(cut[0], cut[-1] - cut[0])])
            batch = batch.slice(cut[-1])
        elif len(cut):
            yield pa.Table.from_batches([batch.slice(0, cut[-1])])
            batch = batch.slice(cut[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
