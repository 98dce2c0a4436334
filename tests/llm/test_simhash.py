import random
import re
from collections import defaultdict

import xxhash

from tidewake.llm import simhash


def brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius=3):
    n, root = len(fps), list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups([brute(t) for _, t in rows])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for (doc_id, text), w in zip(rows, want, strict=True):
        assert got[doc_id].fingerprint == f"{brute(text):016x}"
        assert got[doc_id].component_id == rows[w][0]


def test_tiles_lose_no_link(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:100]:
        for _ in range(r.randint(1, 6)):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps | {0, (1 << 64) - 1, 1, 7})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.components(simhash.links(df, tile=16)).collect()
    by = defaultdict(set)
    for row in got:
        by[row.root] |= {row.node, row.root}
    want = defaultdict(set)
    for x, w in zip(signed, groups(fps), strict=True):
        want[w].add(x)
    assert sorted(map(sorted, by.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_a_hot_cell_in_many_tiles(spark):
    """All fingerprints have equal bit counts in every lane: one cell, thirty tiles, and links between tiles."""
    r = random.Random(9)
    lane = [x for x in range(1 << 16) if x.bit_count() == 2]
    fps = sorted({sum(r.choice(lane) << 16 * i for i in range(4)) for _ in range(120)})
    near = {x & ~0xFFFF | r.choice(lane) for x in fps for _ in range(2)}
    fps = sorted({*fps, *near})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    by = defaultdict(set)
    for row in simhash.components(simhash.links(df, tile=12)).collect():
        by[row.root] |= {row.node, row.root}
    want = defaultdict(set)
    for x, w in zip(signed, groups(fps), strict=True):
        want[w].add(x)
    linked = sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert linked and sorted(map(sorted, by.values())) == linked


def test_odd_rows(spark):
    rows = [(5, "A b"), (3, "a B"), (3, "a B"), (None, "a b"), (9, None), (8, ""), (7, " \t\n"), (1, "x y z " * 60_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.fingerprint == f"{brute('a b'):016x}") == [("3", 3), ("3", 3), ("5", 3), ("None", 3)]
    assert {r.component_id for r in got if r.doc_id in (7, 8, 9)} == {7}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
