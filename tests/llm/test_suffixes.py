import hashlib
import random
from collections import Counter

from tests.compare import mismatch
from tidewake.llm import registry, suffixes


def brute(texts, w):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    passages = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 5))]
        texts.append(" ".join(parts))
    texts += texts[:5] + [None, "", "ab" * 300, "aaaa" * 100, "x " * 100, texts[7][3:-4], texts[8] + "zz" + texts[8]]
    near = list(texts[9] + texts[10])
    for _ in range(4):
        near[r.randrange(len(near) or 1) if near else 0 : 1] = "q"
    return [*texts, "".join(near)]


def check(spark, texts, **sizes):
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal_digest(df, **sizes).collect()}
    want = brute(texts, sizes["window"])
    for i, w in enumerate(want):
        assert got[i if i != 3 else None] == w, (i, texts[i])


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, made(seed), window=50, anchor=8, bucket_bytes=2000)


def test_parts_by_anchor(spark):
    check(spark, made(5), window=50, anchor=8, bucket_bytes=2000, ranges=3)


def test_hot_anchors_are_counted_by_spark(spark):
    check(spark, made(3), window=50, anchor=8, hot=2)


def test_production_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal_digest(docs).collect()}
    for (i, _), w in zip(rows, brute([t for _, t in rows], 400), strict=True):
        assert got[i] == w
    assert sum(g[1] for g in got.values()) > 0
    assert suffixes.removal_digest(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    assert mismatch(spark, "/root/testdata/sf0.001", registry.op8_suffix_array, registry.SUFFIX_SQL) is None


def first_kept(rows, w):
    """Spans removed if the earliest place of each string stays; equal rows are one document."""
    raws = {(float("inf") if i is None else i, hashlib.md5((t or "").encode()).digest()): (t or "").encode() for i, t in rows}
    seen, out = set(), {}
    for at, raw in sorted(raws.items()):
        gone = [False] * len(raw)
        for i in range(len(raw) - w + 1):
            if raw[i : i + w] in seen:
                gone[i : i + w] = [True] * w
            seen.add(raw[i : i + w])
        out[at] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return sorted((str(i), out[float("inf") if i is None else i, hashlib.md5((t or "").encode()).digest()]) for i, t in rows)


def test_first_copies_stay(spark):
    for seed, sizes in ((6, {}), (7, {"bucket_bytes": 2000, "ranges": 3}), (8, {"hot": 2})):
        texts = made(seed)
        rows = [(i * 7 % 61 if i != 3 else None, t) for i, t in enumerate(texts)] + [(5, texts[4]), (5, texts[4])]
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, `a.b` string, doc int").repartition(4)
        got = suffixes.remove_repeats(df, window=50, anchor=8, keep_first=True, **sizes).collect()
        assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == first_kept(rows, 50)


def test_the_window_is_exact(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    one, other = text(399), text(400)
    rows = [(1, text(300) + "A" + one + "B" + text(300)), (2, text(90) + "C" + one + "D"), (3, "E" + other + text(200)), (4, text(50) + other + "F")]
    got = {x.doc_id: x.n_removed for x in suffixes.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 400, 4: 400}


def test_deduplicate_keeps_rows_and_columns(spark):
    r = random.Random(10)
    part = "".join(r.choices("abcdefé ", k=500))
    rows = [(1, part + "x", 7.0, "k"), (2, "y" + part, 8.0, None), (2, "y" + part, 8.0, None), (3, None, None, "k"), (4, "", 1.0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double, key string")
    out = suffixes.deduplicate(df, keep_first=True)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(i, "y" if i == 2 else t, *x) for i, t, *x in rows], df.schema).collect()))
    assert suffixes.deduplicate(df.limit(0), keep_first=True).count() == 0


def test_merge_of_front_coded_runs():
    r = random.Random(4)
    for _ in range(50):
        lists = [sorted(bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 7))]
        out = list(suffixes.merge([suffixes.front_code(x) for x in lists]))
        assert [o[1] for o in out] == sorted(s for x in lists for s in x)
        for a, b in zip(out, out[1:], strict=False):
            assert b[0] == suffixes.lcp(a[1], b[1], 0)
