"""op10 against brute force."""

import collections
import hashlib
import random

import duckdb
import pytest

from fringeflow.llm import queries, suffixes


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert sorted((tuple(r) for r in queries.op10_repeated_passages(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_edges(spark, seed):
    rng = random.Random(seed)
    make = lambda n, a="abcdé ": "".join(rng.choice(a) for _ in range(n))
    shared = [make(rng.choice([30, 45, 60, 200])) for _ in range(6)]
    rows = []
    for k in range(150):
        t = "".join(rng.choice([make(rng.randrange(60)), rng.choice(shared)[rng.randrange(9) : rng.choice([None, -7])]]) for _ in range(rng.randrange(7)))
        rows.append((k, t))
    rows += rows[:5] + [(1000, None), (1001, ""), (None, "x" * 39), (1002, "ab" * 500), (1003, "ab" * 20 + make(50)), (1004, "a" * 100), (1005, make(40)), (1005, make(41)), (1006, make(60000))]
    rows += [(2000 + k, make(30) + shared[0] * 2 + make(30)) for k in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    got = suffixes.repeated_passages(df, "doc_id", "text", length=40, anchor=13).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 40)
    assert suffixes.repeated_passages(df.limit(0), "doc_id", "text").count() == 0


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(5)
    runs, every = [], []
    for k in range(7):
        entries = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))), b"", 0, i) for i in range(40 * (k % 3)))
        every += {e[0] for e in entries}
        runs.append(suffixes.Run(suffixes.front_code(entries), [b"t"]))
    out, last = [], b""
    for run, lcp in suffixes.merge(runs):
        assert lcp == suffixes.common_prefix(last, run.suffix, 0)
        last = run.suffix
        out.append(last)
    assert out == sorted(every)
