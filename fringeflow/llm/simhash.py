"""SimHash near-duplicates through an inverted index over fingerprint bytes.

A fingerprint is a set of (position, byte) tokens.  Two fingerprints that
differ in at most ``max_bits`` bits differ in at most that many bytes, so
they share at least ``n - max_bits`` of n tokens: the guaranteed minimum.
Sets that share m tokens hold a common pair inside one of m - 1 blocks of
positions (pigeonhole), so posting lists are kept per two tokens of one
block: seven per fingerprint for 64 bits and four differing, each 256 times
more selective than those of one token.  Inside a list the shared tokens of
each pair are tallied, pairs below the minimum go, the others are verified by
their differing bits.  Only links to one fingerprint of each group connected
in the list leave it.

At least two bytes must be to spare, or nothing is guaranteed and the call is
refused.  That rules out fingerprints as the judge of a Jaccard similarity of
0.8: 15 of 100 bits are expected to differ there, so no byte need agree;
``shingles`` keeps inverted lists that guarantee such pairs.

Scale: equal fingerprints are collapsed first with map-side combine, lists
longer than ``block`` are dealt into chunks whose pairs are groups of their
own, and components are found by distributed contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import connected_components, dealt_lists, durable, free_name, local_components, runs_of_groups, spread_join
from .pivots import mix

#: Texts are hashed in groups of about so many shingles.
AT_ONCE = 1 << 16

#: Lists up to this length are compared many at a time.
SHORT = 32


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprints(hashes: list[list[int]], words: int = 1) -> np.ndarray:
    """A row of ``words`` 64-bit words for each list: bits set where over half its members have them; zero for none.

    The first word is of the hashes themselves, each further one of the hashes mixed anew.
    """
    out = np.zeros((len(hashes), words), np.uint64)
    full = [i for i, h in enumerate(hashes) if h]
    if not full:
        return out
    n = np.array([len(hashes[i]) for i in full])
    flat = np.fromiter((x for i in full for x in hashes[i]), np.uint64, n.sum())
    starts = np.r_[0, np.cumsum(n)[:-1]]
    for w in range(words):
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full, w] = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        flat = mix(flat)
    return out


def with_fingerprint(df: DataFrame, text_col: str, width: int, words: int = 1) -> DataFrame:
    """``df`` with a binary more: each row's fingerprint, most significant byte first; zero for texts that are null or have no word.

    The column is called ``fp``, with underscores in front where ``df`` has such a column.
    """
    name, at = free_name(df, "fp"), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            done, group, size = [], [], 0
            for t in batch.column(at):
                group.append(shingle_hashes(t.as_py(), width))
                size += len(group[-1])
                if size >= AT_ONCE:
                    done.append(fingerprints(group, words))
                    group, size = [], 0
            done.append(fingerprints(group, words))
            packed = [row.tobytes() for row in np.concatenate(done).astype(">u8")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def position_pairs(n_bytes: int, max_bits: int) -> list[tuple[int, int]]:
    """Pairs of byte positions within blocks.

    ``n_bytes - max_bits`` shared positions hold one of the pairs, as there
    is one block less than that.
    """
    shared = n_bytes - max_bits
    if shared < 2:
        raise ValueError(f"{max_bits} differing bits of {8 * n_bytes} leave fewer than two bytes that must agree")
    blocks = shared - 1
    return [p for k in range(blocks) for p in combinations(range(n_bytes)[k::blocks], 2)]


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, *, width: int = 5, bits: int = 64, max_bits: int = 4, block: int = 4096
) -> DataFrame:
    """One row per input row: (id, fingerprint, component_id).

    ``fingerprint``: lowercase hex digits, ``bits`` / 4 of them, over
    shingles of ``width`` words; ``component_id``: smallest id of the rows
    whose fingerprints are reachable over links of at most ``max_bits``
    differing bits.  Null and empty texts have fingerprint zero,
    linked like any other.  Repeated rows share a component; null ids take no
    part in the minimum.  An empty table gives an empty result.  Other
    columns are neither read nor returned.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = durable(with_fingerprint(texts, "text", width, bits // 64).select("id", "fp"))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    nodes = durable(nodes)
    comps = connected_components(linked_fingerprints(nodes.select("node", "fp"), bits, max_bits, block))
    labelled = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_fp = durable(spread_join(labelled, smallest, "root", "node").select("fp", "component_id"))
    return spread_join(rows, per_fp, "fp", "id").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def linked_fingerprints(nodes: DataFrame, bits: int, max_bits: int, block: int) -> DataFrame:
    """Links (a, b) between nodes that connect just what all links of ``max_bits`` bits connect; ``nodes``: (node, fp), each fp once."""
    n_bytes = bits // 8
    pairs = position_pairs(n_bytes, max_bits)

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                raw = _raw(batch.column("fp"), n_bytes)
                for k, (p, q) in enumerate(pairs):
                    token = 65536 * k + 256 * raw[:, p].astype(np.int32) + raw[:, q]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(token)], ["node", "fp", "token"])

    posted = nodes.mapInArrow(post, "node long, fp binary, token int")
    parts = dealt_lists(posted, "token", "node", block)
    keys = ["token", "lo", "hi"]
    parts = parts.repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(_tally(n_bytes, max_bits, keys), "a long, b long")


def _raw(column, n_bytes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n_bytes)


def _tally(n_bytes: int, max_bits: int, keys: list[str]):
    minimum = n_bytes - max_bits

    def linked(x, y):
        """Which pairs share enough bytes, and of those which differ in few enough bits."""
        apart = x ^ y
        shared = n_bytes - np.bitwise_count(bytes_that_differ(apart)).sum(axis=-1, dtype=np.int32)
        few = np.bitwise_count(apart).sum(axis=-1, dtype=np.int32) <= max_bits
        return (shared >= minimum) & few

    def small(fp, starts, ends, at_once=1 << 18):
        """Index pairs of all short lists that are linked, by list length."""
        a_all, b_all = [], []
        for n in np.unique(ends - starts):
            i, j = np.triu_indices(n, 1)
            first = starts[ends - starts == n]
            for some in np.array_split(first, 1 + len(first) * len(i) // at_once):
                a, b = ((some[:, None] + k).ravel() for k in (i, j))
                hit = linked(fp[a], fp[b])
                a_all.append(a[hit])
                b_all.append(b[hit])
        return a_all, b_all

    def run(batches):
        for t in runs_of_groups(batches, keys):
            k = [t.column(c).to_numpy() for c in keys]
            node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
            fp = _raw(t.column("fp"), n_bytes).view(np.uint64)
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for c in k:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], t.num_rows]
            short = (ends - starts <= SHORT) & (k[1][starts] == k[2][starts])
            a_all, b_all = small(fp, starts[short], ends[short])
            for s, e in zip(starts[~short], ends[~short], strict=True):
                same = k[1][s] == k[2][s]
                left = np.arange(s, e) if same else np.flatnonzero(own[s:e] == k[1][s]) + s
                right = left if same else np.flatnonzero(own[s:e] != k[1][s]) + s
                root = np.arange(e - s)
                for i in np.array_split(left, 1 + len(left) * len(right) * fp.shape[1] // (1 << 20)):
                    x, y = np.nonzero(linked(fp[i, None], fp[None, right]))
                    root = _contract(e - s, [(i[x] - s, right[y] - s)], root)
                moved = np.flatnonzero(root != np.arange(e - s))
                a_all.append(moved + s)
                b_all.append(root[moved] + s)
            if a_all:
                a, b = np.concatenate(a_all), np.concatenate(b_all)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def bytes_that_differ(apart: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is not zero."""
    low7 = np.uint64(0x7F7F7F7F7F7F7F7F)
    return (((apart & low7) + low7) | apart) & ~low7


def _contract(n: int, found: list, root: np.ndarray) -> np.ndarray:
    moved = np.flatnonzero(root != np.arange(n))
    a = np.concatenate([moved, *[f[0] for f in found]])
    b = np.concatenate([root[moved], *[f[1] for f in found]])
    return local_components(n, a, b) if len(a) else root
