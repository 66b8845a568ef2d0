"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else.  Sorting every suffix would move the text ``length`` times
over, so the suffixes sorted are those at sampled places that equal strings
share: the smallest hashed ``anchor``-gram of each window of ``length``
bytes.  An anchor stands for a run of windows; its suffix is cut where the
last window ends, and the bytes before it, back to the first window, go
along.

1. Tasks find the anchors of their texts.  Anchors whose hash occurs once
   (their distinguishing prefix is no longer than ``anchor``) are dropped by
   a count per hash, with map-side combine, and a join that adaptive
   execution may split; all that follows is exact on bytes.
2. The suffixes of the others are sorted in each task and sent as front-coded
   runs: each suffix as its common prefix with the one before and the rest.
3. Each receiving task merges its runs by a loser tree whose players carry
   their common prefix with the last suffix put out: unequal prefixes decide
   without looking at bytes, equal ones are compared beyond them only.
4. Between neighbours that share ``anchor`` bytes, common prefixes and common
   suffixes of the bytes before tell which windows are repeated.

Scale: texts are compressed where they move; exact copies are sent once per
task; equal suffixes are one entry of a run; intervals come back as rows.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, spread_join

BASE = 0x9E3779B97F4A7C15 | 1
WORD = 1 << 64

#: Bytes of text worked on at once, and bytes of suffixes in a sorted run, about.
AT_ONCE, RUN = 1 << 18, 1 << 24

#: Bytes of suffixes that one merge task receives, about, before front coding.
PART = 1 << 27

#: Groups of equal prefixes up to this size are compared in pairs.
FEW = 6


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = pow(BASE, -1, WORD)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, WORD))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, WORD))])
        return self.up[:n], self.down[:n]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    up, down = powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * down[:-1], out=sums[1:])
    return _finish((sums[k:] - sums[:-k]) * up[: len(data) - k + 1])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int, powers: Powers):
    """(text, anchor's place, bytes back to its first window, bytes on to its last window's end, hash) of each run of windows.

    ``data``: the texts in a row.  The choice depends on a window's bytes
    alone: the smallest 32 bits of hash, of equal ones the leftmost.
    """
    n_windows = len(data) - length + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = gram_hashes(data, k, powers)
    w = length - k + 1
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // w)
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = keyed
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[:n_windows], ahead[w - 1 : w - 1 + n_windows])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = ends - starts
    text = np.repeat(np.arange(len(starts)), sizes)[:n_windows]
    whole = np.flatnonzero(np.arange(n_windows) + length <= ends[text])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    a = at[whole]
    new = np.r_[True, (a[1:] != a[:-1]) | (whole[1:] != whole[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(a)] - 1
    place = a[first]
    return text[whole[first]], place, place - whole[first], whole[last] + length - place, h[place]


def _find(length: int, k: int):
    """Record batches (k1, text) to rows (k1, gram, packed) for the anchors; copies within a task once."""

    def run(batches):
        powers, seen = Powers(), set()

        def flush(keys, texts):
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            starts = np.r_[0, ends[:-1]]
            text, place, left, right, h = anchors(data, starts, ends, length, k, powers)
            packed = ((place - starts[text]) << 32) | (left << 16) | right
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)[text]), pa.array(h.view(np.int64)), pa.array(packed)], ["k1", "gram", "packed"]
            )

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                texts.append(t.as_py().encode("utf-8"))
                size += len(texts[-1])
                if size >= AT_ONCE:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
        if texts:
            yield flush(keys, texts)

    return run


def _pack_texts(batches):
    """(k1, key, text) to the same with compressed text; copies within a task once."""
    squeeze, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        keys = batch.column(1).to_pylist()
        new = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                new.append(i)
        part = batch.take(pa.array(new, pa.int64()))
        data = [squeeze.compress(t.as_py().encode("utf-8")) for t in part.column(2)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], ["k1", "key", "packed_text"])


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that share ``start`` bytes."""
    n = min(len(a), len(b))
    if n <= start:
        return n
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    apart = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (apart.bit_length() + 7) // 8


def front_code(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run as bytes: entries (suffix, bytes before it, text, place); equal ones become one with several owners."""
    lcps, tails, befores, owners = [], [], [], []
    last, before = b"", None
    for suffix, left, text, place in entries:
        if suffix == last and left == before:
            owners[-1].append((text, place))
            continue
        lcp = common_prefix(last, suffix, 0)
        lcps.append(lcp)
        tails.append(suffix[lcp:])
        befores.append(left)
        owners.append([(text, place)])
        last, before = suffix, left
    flat = np.array([o for own in owners for o in own], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(
        pickle.dumps((np.array(lcps, np.int32), tails, befores, np.array([len(o) for o in owners], np.int32), flat), protocol=5)
    )


def _cut(length: int, k: int, parts: int):
    """Joined texts and anchors to front-coded sorted runs, one per receiving part."""

    def run(batches):
        powers, unpack = Powers(), zstandard.ZstdDecompressor()
        _, down = powers.to(k)
        held: dict[int, list] = {}
        keys: list[bytes] = []
        size = 0

        def flush():
            for part, entries in held.items():
                entries.sort()
                used = sorted({e[2] for e in entries})
                index = {t: i for i, t in enumerate(used)}
                blob = front_code([(s, b, index[t], p) for s, b, t, p in entries])
                yield part, blob, [keys[t] for t in used]

        def batch_of(runs):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in runs], pa.int32()), pa.array([r[1] for r in runs], pa.binary()), pa.array([r[2] for r in runs], pa.list_(pa.binary()))],
                ["part", "run", "texts"],
            )

        for batch in batches:
            for key, squeezed, grams, packed in zip(*(batch.column(c) for c in ("key", "packed_text", "grams", "packed")), strict=True):
                text = unpack.decompress(squeezed.as_py())
                data = np.frombuffer(text, np.uint8)
                g = grams.values.to_numpy().view(np.uint64)
                at = packed.values.to_numpy()
                place, left, right = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
                fits = place + right <= len(data)
                g, place, left, right = (x[fits] for x in (g, place, left, right))
                real = np.zeros(len(g), bool)  # the key may stand for two texts: look at the bytes
                for some in np.array_split(np.arange(len(g)), 1 + len(g) // 4096):
                    real[some] = _finish((data[place[some, None] + np.arange(k)] * down).sum(axis=1, dtype=np.uint64)) == g[some]
                keys.append(key.as_py())
                for h, p, lo, hi in zip((g[real] % np.uint64(parts)).tolist(), place[real].tolist(), left[real].tolist(), right[real].tolist(), strict=True):
                    held.setdefault(h, []).append((text[p : p + hi], text[p - lo : p][::-1], len(keys) - 1, p))
                    size += hi + lo + 200
                if size > RUN:
                    yield batch_of(list(flush()))
                    held.clear()
                    keys.clear()
                    size = 0
        if held:
            yield batch_of(list(flush()))

    return run


class Run:
    """A front-coded run being read: the current suffix and its common prefix with the one before."""

    __slots__ = ("at", "befores", "flat", "lcp", "lcps", "n_owners", "owner", "suffix", "tails", "texts")

    def __init__(self, blob: bytes, texts: list[bytes]):
        self.lcps, self.tails, self.befores, counts, self.flat = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        self.lcps, self.n_owners = self.lcps.tolist(), counts.tolist()
        self.texts, self.at, self.owner, self.suffix, self.lcp = texts, -1, 0, b"", 0

    def step(self) -> bool:
        if self.at >= 0:
            self.owner += self.n_owners[self.at]
        self.at += 1
        if self.at >= len(self.tails):
            self.suffix = None
            return False
        self.lcp = self.lcps[self.at]
        self.suffix = self.suffix[: self.lcp] + self.tails[self.at]
        return True

    def owners(self) -> list[tuple[bytes, int]]:
        own = self.flat[self.owner : self.owner + self.n_owners[self.at]]
        return [(self.texts[t], p) for t, p in own.tolist()]


def merge(runs: list[Run]):
    """(run, common prefix with the suffix before) in the order of all suffixes, by a loser tree that keeps common prefixes.

    The run is to be read before the next step.  Every player's prefix length
    is that with the suffix put out last.  The longer one is the smaller
    suffix; equal ones are compared from there on, and the loser keeps the
    length it shares with the winner.
    """
    runs = [r for r in runs if r.step()]
    n = 1
    while n < len(runs):
        n *= 2
    shared = [r.lcp for r in runs] + [0] * (n - len(runs))
    suffix = [r.suffix for r in runs] + [None] * (n - len(runs))
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = suffix[a], suffix[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = common_prefix(x, y, shared[a])
        if (h < len(x)) and (h == len(y) or x[h] > y[h]):
            a, b = b, a
        shared[b] = h
        return a, b

    def build(node: int) -> int:
        if node >= n:
            return node - n
        a, b = play(build(2 * node), build(2 * node + 1))
        losers[node] = b
        return a

    if not runs:
        return
    champion = build(1) if n > 1 else 0
    while suffix[champion] is not None:
        run = runs[champion]
        yield run, shared[champion]
        run.step()
        suffix[champion], shared[champion] = run.suffix, run.lcp
        node = (champion + n) >> 1
        while node:
            champion, losers[node] = play(champion, losers[node])
            node >>= 1


def repeated(suffixes: list[bytes], befores: list[bytes], lcps: list[int], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each entry the ranges (first, last) of offsets o, such that the window o bytes before the anchor occurs elsewhere.

    Entries: distinct pairs of suffix and reversed bytes before, suffixes
    rising; ``lcps[i]``: common prefix of suffix i with i - 1; ``counts``:
    occurrences.  The window at offset o is the o bytes before and length - o
    of the suffix.
    """
    n = len(suffixes)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    whole = [(max(0, length - len(s)), len(b)) for s, b in zip(suffixes, befores, strict=True)]
    if n <= FEW:
        for i in range(n):
            low = length
            for j in range(i + 1, n):
                low = min(low, lcps[j])
                first, last = length - low, common_prefix(befores[i], befores[j], 0)
                if first <= last:
                    out[i].append((first, last))
                    out[j].append((first, last))
    else:
        lcp = np.array(lcps)
        order = sorted(range(n), key=befores.__getitem__)
        back = np.array([0] + [common_prefix(befores[order[i - 1]], befores[order[i]], 0) for i in range(1, n)])
        order = np.array(order)
        most = max(w[1] for w in whole)
        hit = np.zeros((n, most + 2), bool)
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for o in range(min(w[0] for w in whole), most + 1):
            right = np.cumsum(lcp < length - o)
            left[order] = np.cumsum(back < o)
            _, inverse, size = np.unique(left * (n + 1) + right, return_inverse=True, return_counts=True)
            hit[:, o] = size[inverse] > 1
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            row = np.flatnonzero(np.diff(np.r_[0, hit[i].astype(np.int8), 0]))
            for a, b in zip(row[::2].tolist(), (row[1::2] - 1).tolist(), strict=True):
                a, b = max(a, whole[i][0]), min(b, whole[i][1])
                if a <= b:
                    out[i].append((a, b))
    for i in range(n):
        if counts[i] > 1:
            out[i] = [whole[i]]
    return out


def _merge_runs(length: int, k: int):
    """All runs of a task to rows (key, start, end): the intervals to remove."""

    def run(batches):
        runs = [Run(r.as_py(), t.as_py()) for batch in batches for r, t in zip(batch.column("run"), batch.column("texts"), strict=True)]
        keys, firsts, lasts = [], [], []
        group: list = []  # (suffix, before, lcp, owners)

        def close():
            if len(group) == 1 and len(group[0][3]) == 1:
                return
            at: dict[tuple, int] = {}
            suffixes, befores, lcps, owners = [], [], [], []
            low = length
            for suffix, before, lcp, own in group:
                low = min(low, lcp)
                i = at.setdefault((suffix, before), len(suffixes))
                if i < len(suffixes):
                    owners[i].extend(own)
                    continue
                suffixes.append(suffix)
                befores.append(before)
                lcps.append(low)
                owners.append(own)
                low = length
            for own, ranges in zip(owners, repeated(suffixes, befores, lcps, [len(o) for o in owners], length), strict=True):
                for first, last in ranges:
                    for key, place in own:
                        keys.append(key)
                        firsts.append(place - last)
                        lasts.append(place - first + length)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())], ["key", "start", "end"])
            keys.clear(), firsts.clear(), lasts.clear()
            return out

        for r, lcp in merge(runs):
            if lcp < k:
                close()
                group.clear()
                if len(keys) > 1 << 16:
                    yield batch()
            group.append((r.suffix, r.befores[r.at], lcp, r.owners()))
        close()
        yield batch()

    return run


def union_of(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal intervals covered; touching ones are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _remove(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        seen, rows = set(), []
        for key, squeezed, spans in zip(*(batch.column(c) for c in ("key", "packed_text", "spans")), strict=True):
            text = unpack.decompress(squeezed.as_py())
            spans = union_of(spans.values.field("start").to_pylist(), spans.values.field("end").to_pylist())
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((key.as_py(), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], kept.hexdigest()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.binary(), pa.int64(), kind, pa.string()))], ["key", "n_removed", "spans", "kept_sha256"]
        )


def repeated_passages(df: DataFrame, id_col: str, text_col: str, *, length: int = 200, anchor: int = 64) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256, spans).

    Removed are the bytes covered by a string of ``length`` bytes that also
    starts elsewhere, in the same or another row; ``spans``: the maximal runs
    of them, as byte offsets; ``kept_sha256``: lowercase hex digest of the
    bytes left, in a row.  Null texts count as empty.  Texts shorter than
    ``length`` lose nothing; texts that occur in two rows or more, so
    repeated rows too, and are not shorter, lose all.  Ids are passed through,
    null or not.  An empty table gives an empty result.  Other columns are
    neither read nor returned.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    texts = rows.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("k1"), F.sha2("text", 256).alias("hex"), "text")

    found = texts.select("k1", "text").mapInArrow(_find(length, anchor), "k1 long, gram long, packed long")
    several = durable(found.groupBy("gram").count().where("count > 1").select("gram"))
    again = found.join(several, "gram", "left_semi")
    per_text = again.groupBy("k1").agg(F.collect_set(F.struct("gram", "packed")).alias("a"))
    per_text = durable(per_text.select("k1", F.col("a.gram").alias("grams"), F.col("a.packed").alias("packed")))
    n_suffixes = per_text.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes * 2 * length // PART))
    moved = texts.select("k1", F.unhex("hex").alias("key"), "text").mapInArrow(_pack_texts, "k1 long, key binary, packed_text binary")
    cut = moved.join(per_text, "k1").select("key", "packed_text", "grams", "packed")
    runs = cut.mapInArrow(_cut(length, anchor, parts), "part int, run binary, texts array<binary>")
    intervals = runs.repartition(parts, "part").mapInArrow(_merge_runs(length, anchor), "key binary, start long, end long")
    spans = intervals.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    less = moved.select("key", "packed_text").join(spans, "key").select("key", "packed_text", "spans")
    less = less.mapInArrow(_remove, "key binary, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    less = durable(less.dropDuplicates(["key"]).withColumn("hex", F.lower(F.hex("key"))).drop("key"))

    docs = rows.select("id", F.sha2("text", 256).alias("hex"), F.octet_length("text").cast("long").alias("n_bytes"))
    counted = durable(docs.groupBy("hex").count())
    known = counted.withColumnRenamed("count", "copies").join(less, "hex", "left")
    out = spread_join(docs, known, "hex", "id", counted)
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<start:long,end:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(all_gone, whole).otherwise(F.coalesce("spans", none))
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "hex")).alias("kept_sha256"),
        spans.alias("spans"),
    )
