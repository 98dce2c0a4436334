import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidewake.llm import packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def valid(rows, capacity):
    """rows: (length, sequence, offset): gapless from 0, within the capacity."""
    by = defaultdict(list)
    for length, seq, offset in rows:
        by[seq].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def optimum(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for r in {b for b in bins if b >= lengths[i]}:
            rest = list(bins)
            rest.remove(r)
            go(i + 1, [*rest, r - lengths[i]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def test_plans_are_valid_and_reductions_keep_the_optimum():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([10, 13, 20])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        plan = packing.Plan(dict(Counter(lengths)), capacity)
        rows = [(n, s + i, o) for n, a, b, s, o in plan.rules for i in range(b - a)]
        assert Counter(x[0] for x in rows) == Counter(lengths)
        assert valid(rows, capacity) == plan.sequences
        best = optimum(lengths, capacity)
        fixed = [n for n, s, _ in rows if s < plan.fixed]
        rest = list((Counter(lengths) - Counter(fixed)).elements())
        assert plan.fixed + (optimum(rest, capacity) if rest else 0) == best  # what is fixed costs nothing
        assert plan.sequences <= best + 1
    big = packing.Plan({n: 3000 - n for n in range(1, 2049)})
    assert big.sequences <= -(-sum(n * (3000 - n) for n in range(1, 2049)) // 2048) * 1.01 + 1 and len(big.rules) < 20 * 2048


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(90001, None), (90001, None), (None, ""), (90004, "a b " * 9000), (90005, "x<|endoftext|> y")], "doc_id long, text string")
    every = docs.union(odd)
    tok = Tokenizer.from_file(JSON)
    want = []
    for doc_id, text in every.collect():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    got = packing.pack(every.repartition(5), RANKS, P.PATTERN).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(g)[:5]) for g in got)
    n = valid([(g.length, g.sequence_id, g.offset) for g in got], 2048)
    assert n <= -(-sum(g.length for g in got) // 2048) * 1.03 + 1
    assert packing.pack(every.limit(0), RANKS, P.PATTERN).count() == 0
