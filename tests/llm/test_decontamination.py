import hashlib
import random
import re

import pytest
from tests.compare import mismatch

from tidewake.llm import decontamination, registry


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(documents, benchmark, window=10):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in documents:
        w, hit, items = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, documents, benchmark, **more):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(benchmark, "item_id long, text string").repartition(2)
    return sorted((tuple(r) for r in decontamination.contamination(d, b, **more).collect()), key=str)


def test_equals_its_sql(spark):
    assert mismatch(spark, "/root/testdata/sf0.01", registry.op12_decontamination, registry.DECONTAMINATION_SQL) is None


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    """Few words, so that grams repeat within windows and across texts, and many windows nearly agree."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "b", "A", "c", "é"]) for _ in range(n))
    benchmark = [(i, text(r.randrange(8, 26))) for i in range(12)]
    documents = [(i, text(r.randrange(0, 300))) for i in range(40)]
    documents += [(100 + i, f"{text(5)} {benchmark[i][1]}, {text(20)}") for i in range(10)]
    assert run(spark, documents, benchmark) == brute(documents, benchmark)


def test_spans_of_exactly_a_window_and_one_less(spark):
    long = [f"w{i}" for i in range(40)]
    benchmark = [(1, " ".join(long)), (2, " ".join(long[5:30])), (10, "one two three"), (11, "w3"), (12, " - "), (13, None), (None, " ".join(f"z{i}" for i in range(10)))]
    documents = [(1, " ".join(["x", *long[20:30], "y"])), (2, " ".join(["x", *long[20:29], "y"])), (3, "One-TWO  three. one two"), (4, "w3 W3"), (5, None), (6, ""), (7, " ".join(f"z{i}" for i in range(11))), (8, " ".join(long[30:] + long)), (1, "again"), (None, "w3")]
    assert run(spark, documents, benchmark) == brute(documents, benchmark)
    assert run(spark, documents, benchmark, window=7, gram=3) == brute(documents, benchmark, 7)


def test_common_passages_make_no_pairs(spark):
    """A passage that most documents and most items have."""
    common = " ".join(f"c{i}" for i in range(15))
    benchmark = [(i, f"{common} item{i}") for i in range(60)]
    documents = [(i, f"doc {common} text") for i in range(200)] + [(1000 + i, f"doc{i} {common} item{i}") for i in range(60)]
    assert run(spark, documents, benchmark) == brute(documents, benchmark)


def test_empty_tables_very_long_texts_and_clashing_columns(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    r = random.Random(1)
    long = " ".join(f"v{r.randrange(50_000)}" for _ in range(200_000))
    part = " ".join(long.split()[150_000:150_030])
    assert run(spark, [(1, long)], [(7, part)]) == brute([(1, long)], [(7, part)])
    d = spark.createDataFrame([(1, "a b", "x", "y", 1)], "`d.id` long, text string, key string, item string, n_words int")
    b = spark.createDataFrame([(1, "b", 2)], "item_id long, text string, size int")
    assert [tuple(x) for x in decontamination.contamination(d, b, "d.id").collect()] == brute([(1, "a b")], [(1, "b")])


def test_no_python_on_the_main_path(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = decontamination.contamination(d, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
