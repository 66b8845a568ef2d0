"""op1, op4 and op5 against brute force, and their edge cases."""

import collections
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fringeflow.llm import collisions, common, pivots, queries, shingles, simhash

SF = "/root/testdata/sf0.001"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("at_once, hub", [(common.LINKS_AT_ONCE, common.HUB), (50, 20)])
def test_connected_components(spark, monkeypatch, at_once, hub):
    """One level, and several with hot keys dealt."""
    monkeypatch.setattr(common, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(links + [(None, 3), (4, 4)], "a long, b long")).collect()}
    want = components({n for x in links for n in x}, links)
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(want[k] == k for k in want if k not in got)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.93):
    good = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                    links.append((i, j))
    n = collections.Counter(k for x in links for k in x)
    comp = components(range(len(rows)), links)
    low = {}
    for i, r in enumerate(rows):
        low[comp[i]] = min(low.get(comp[i], r[0]), r[0])
    return sorted((r[0], n[i], low[comp[i]], r[0] == low[comp[i]]) for i, r in enumerate(rows))


def test_near_duplicate_vectors_find_what_brute_force_finds(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.op1_pivot_near_duplicates(spark, SF).collect())
    assert got == brute_vectors(rows)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicate_vectors_edges(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    near = [(100 + k, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.1)], 1) for k in range(80)]
    rows = near + [
        (1, [0.0] * 16, 1), (2, None, 1), (3, [], 1), (4, [float("nan")] * 16, 1), (5, [1.0, None] * 8, 1), (6, [1.0] * 16, None),
        (7, [1.0] * 16, 2), (7, [1.0] * 16, 2), (8, [2.0] * 16, 2), (9, [1.0] * 8, 2), (10, [float("inf")] + [1.0] * 15, 2), near[0],
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, e array<float>, label int, node string, rep int")
    got = sorted(tuple(r) for r in pivots.near_duplicate_vectors(df, "vec_id", "e", "label", block=block).collect())
    assert got == brute_vectors(rows)
    assert pivots.near_duplicate_vectors(df.limit(0), "vec_id", "e", "label").count() == 0


def brute_fingerprint(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows, width=4, bits=4):
    fps = [brute_fingerprint(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits]
    comp = components(range(len(rows)), links)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[comp[i]] = min(low.get(comp[i], d), d)
    return sorted((d, f"{fps[i]:016x}", low[comp[i]]) for i, (d, _) in enumerate(rows))


def test_simhash_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in queries.op4_simhash(spark, SF).collect()) == brute_simhash(rows)


@pytest.mark.parametrize("block", [4096, 8])
def test_simhash_edges(spark, block):
    rng = random.Random(2)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(400)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "one"), (105, "a b c d"), (106, "Ä b\x0bc\x1cd e"), (106, "Ä b\x0bc\x1cd e"), (107, "y " * 30000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, node int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df, "doc_id", "text", width=4, bits=64, max_bits=4, block=block).collect())
    assert got == brute_simhash(rows)
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):  # no two bytes need agree
        simhash.near_duplicates(df, "doc_id", "text", bits=64, max_bits=7)


def brute_similar(rows, threshold=0.8):
    """The ids that stay, from all pairs of shingle sets."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    comp = components(range(len(rows)), links)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[comp[i]] = min(low.get(comp[i], d), d)
    return sorted(set(low.values())), len(links)


@pytest.mark.parametrize("block", [4096, 40])
def test_similar_texts_are_those_of_the_threshold(spark, monkeypatch, block):
    """Pairs on both sides of 0.8, a line in every text, and groups larger than a chunk, against brute force."""
    monkeypatch.setattr(shingles, "CHUNK", min(block, shingles.CHUNK))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = " ".join(word() for _ in range(12))
    rows = []
    for k in range(150):
        words = [word() for _ in range(rng.choice((4, 9, 30, 150, 400)))]
        for c in range(4):  # a run of new words brings similarity to 0.6 and more
            other = list(words)
            n = rng.randrange(max(1, len(other) // 4))
            at = rng.randrange(len(other) - n + 1)
            other[at : at + n] = [word() for _ in range(n)]
            rows.append((4 * k + c, " ".join(other) + (" " + line) * rng.choice((0, 0, 1, 9))))
    base = [word() for _ in range(200)]
    for k in range(90):
        base[rng.randrange(200)] = word()
        rows.append((1000 + k, " ".join(base)))
    rows += [(2000, None), (2001, " "), (2002, "One"), (2003, "one")]
    want, links = brute_similar(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = corpus_pipeline.near_duplicates(spark, df, SF) if block == 4096 else shingles.without_similar(df, "doc_id", "text", block=block)
    assert got.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in got.collect()) == want and links > 400


def test_similar_texts_come_from_the_index_over_fingerprint_bytes(spark, monkeypatch):
    """Pairs of few differing bits are linked by the byte index, all of them, and nowhere else; without it they would be lost."""
    rng = random.Random(21)
    rows = []
    for k in range(40):
        words = [str(rng.randrange(10**6)) for _ in range(300)]
        for c in range(4):
            rows.append((4 * k + c, " ".join(words)))
            words[rng.randrange(300)] = str(rng.randrange(10**6))
    want, _ = brute_similar(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], shingles.linked_fingerprints

    def spied(nodes, bits, max_bits, block):
        links = real(nodes, bits, max_bits, block)
        fps = {r.node: int.from_bytes(r.fp, "big") for r in nodes.collect()}
        near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits]
        assert components(fps, near) == components(fps, [(r.a, r.b) for r in links.collect()]) and near
        seen.append(bits)
        return links

    monkeypatch.setattr(shingles, "linked_fingerprints", spied)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == want and seen == [128]
    monkeypatch.setattr(shingles, "linked_fingerprints", lambda nodes, *_: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    assert len(corpus_pipeline.near_duplicates(spark, df, SF).collect()) > len(want)


def test_similar_texts_leave_few_files(spark, monkeypatch):
    """Links are written once and sizes of long lists not at all, as a process is started for each file of a checkpoint."""
    words = [[str((k + 7) * (i + 3) % 997) for i in range(60)] for k in range(30)]
    rows = [(2 * k + c, " ".join(w + ["x"] * c)) for k, w in enumerate(words) for c in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written, real = [], common.durable

    def spied(frame):
        written.append(frame.columns)
        return real(frame)

    for module in (common, shingles, simhash):
        monkeypatch.setattr(module, "durable", spied)
    got = sorted(r.doc_id for r in shingles.without_similar(df, "doc_id", "text").collect())
    assert got == brute_similar(rows)[0]
    assert not [c for c in written if c in (["a", "b"], ["token", "chunks"], ["fp", "_parts"], ["node", "fp"])]
    assert len(written) <= 8


@pytest.mark.parametrize("few", [0, 3, common.FEW_LISTS])
def test_few_rows(spark, monkeypatch, few):
    """Small tables are broadcast, larger ones durable, with the same rows; none is told from some."""
    monkeypatch.setattr(common, "FEW_LISTS", few)
    df = spark.createDataFrame([(b"\x00\xff", 1), (None, 2), (b"", 3), (b"k", None)], "fp binary, n int")
    got = common.few_rows(df)
    assert got.schema == df.schema and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert common.few_rows(df.limit(0)) is None
    left, right = spark.range(60).selectExpr("id % 3 as k", "id"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    monkeypatch.setattr(common, "HUB", 4)
    joined = common.spread_join(left, right, "k", "id").collect()
    assert sorted((r.id, r.v) for r in joined) == [(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(60)]
    dealt = common.dealt_lists(left, "k", "id", 5)
    pairs = collections.Counter((r.k, r.lo, r.hi, r.id) for r in dealt.collect())
    assert set(pairs.values()) == {1} and {i for *_, i in pairs} == set(range(60)) and max(hi for _, _, hi, _ in pairs) == 3


def brute_neighbours(rows, k=10):
    good = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], float)
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            s = np.sqrt(((x - q) ** 2).sum(1))
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, s)) if ids[j] != i][:k]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    want = brute_neighbours(duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall())
    rows = queries.op5_collision_neighbours(spark, sf).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [s for _, s in found] == sorted(s for _, s in found)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_neighbours_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(300 + k, [1.0] * 8) for k in range(150)] + [(500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, []), (900, [1.0, 2.0]), (1000, [1.0, None])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, e array<double>, id string")
    got = collections.defaultdict(list)
    for r in collisions.nearest_neighbours(df, df.where("vec_id % 100 = 0"), "vec_id", "e", block=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_neighbours([r for r in rows if r[1] is None or len(r[1]) == 8])
    assert set(got) == set(want)
    assert got[300] == list(range(301, 311)) and got[400] == list(range(300, 310))
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 3.0]), (5, [4.0, 2.0])], "vec_id long, e array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in collisions.nearest_neighbours(few, few.where("vec_id % 100 = 0"), "vec_id", "e").collect()) == [
        (0, 1, 100, 1.0), (0, 2, 5, 3.0), (100, 1, 0, 1.0), (100, 2, 5, 10**0.5)]
    assert collisions.nearest_neighbours(df.limit(0), df.limit(0), "vec_id", "e").count() == 0


def test_vectors_of_one_cone(spark):
    """Vectors whose cosines are all high have lists of their own, and links are found."""
    rng = np.random.default_rng(5)
    x = 3.6 + 2.0 * rng.standard_normal((3000, 32))
    x[2000:2150] = x[:150] + 0.3 * rng.standard_normal((150, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.97
    assert (unit @ unit.T).mean() > 0.7
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicate_vectors(df, "vec_id", "embedding", "label", threshold=0.97).collect()}
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.99 * want.sum() > 0
    chosen = pivots.choose_pivots(df, "embedding", 128, 2048, 0.87)[32]
    assert len(chosen.points) == 128
    sizes = collections.Counter(tuple(sorted(r)) for r in chosen.nearest(pivots.unit(x), 2))
    assert max(sizes.values()) < 300


def test_vectors_of_a_length_outside_the_sample(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(8).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, rng.standard_normal(5).tolist(), 1) for k in range(40)]
    rows += [(2000 + k, [x * 2 for x in rows[300 + k][1]], 1) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in pivots.near_duplicate_vectors(df, "vec_id", "embedding", "label", threshold=0.93, sample=1).collect()) == brute_vectors(rows)
