import hashlib
import random
import re

from tidewake.llm import debruijn


def brute(rows, w):
    docs = [(float("inf") if i is None else i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, words in docs:
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            if first[tuple(words[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return out


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        r = random.Random(seed)
        some = lambda n: [r.choice(["a", "b", "é", "the"]) + str(r.randrange(30)) for _ in range(n)]
        passages = [some(r.randint(5, 30)) for _ in range(6)] + [["x"] * 25, ["p", "q"] * 12]
        rows = []
        for i in range(60):
            parts = [r.choice(passages) if r.random() < 0.5 else some(r.randint(0, 25)) for _ in range(r.randint(0, 5))]
            rows.append((i * 7 % 60, r.choice([" ", "\n", "  "]).join(x for p in parts for x in p)))
        rows += [rows[3], (1000, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (500, None), (501, ""), (rows[9][0], rows[8][1])]
        df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string").repartition(4)
        got = sorted((str(x.doc_id), *tuple(x)[1:]) for x in debruijn.removal_digest(df, window=12, anchor=4).collect())
        assert got == sorted((str(i), *w) for (i, _), w in zip(rows, brute(rows, 12), strict=True))


def test_production_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in debruijn.removal_digest(docs).collect()}
    for (i, _), w in zip(rows, brute(rows, 50), strict=True):
        assert got[i] == w
    assert sum(g[1] for g in got.values()) > 0
    assert debruijn.removal_digest(docs.limit(0)).count() == 0


def test_an_occurrence_of_a_compacted_path_is_one_row(spark):
    r = random.Random(8)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    long, short = some(400), some(60)
    rows = [(1, [*some(30), *long, *some(5)]), (2, [*some(7), *long, *some(9)]), (3, long), (4, some(200)), (5, [*short, *some(9)]), (6, [*some(3), *short]), (7, [*short, *some(4), *short])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    spans = debruijn.repeated_spans(debruijn._keyed(df, "doc_id", "text"), window=12, anchor=4).collect()
    inner = sorted((s.doc, s.stop - s.start) for s in spans if s.stop - s.start > 300)
    assert [d for d, _ in inner] == [2, 3]  # one row an occurrence, though the passage has about a hundred runs
    assert sum(s.doc in (2, 3) for s in spans) <= 8  # and the passage's branching ends
    got = sorted((str(x.doc_id), *tuple(x)[1:]) for x in debruijn.removal_digest(df, window=12, anchor=4).collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, brute([(i, " ".join(w)) for i, w in rows], 12), strict=True))
