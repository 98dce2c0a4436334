import itertools

import corpus_pipeline as cp


def brute(rows, similar=0.8):
    """Of each group the smallest id, by all pairs of sets of five words."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return sorted({rows[top(i)][0] for i in range(len(rows))})


def test_near_copies_of_short_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = cp.near_dedup(spark, docs, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_large_groups_and_odd_rows(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(200)] + [(500, None), (501, ""), (502, "A b"), (503, "a B"), (504, " ".join(words[:60]))]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == brute(rows) == [0, 500, 502, 504]
