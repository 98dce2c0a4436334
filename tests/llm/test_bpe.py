import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tidewake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def whole():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_of_tiny_leaves_equals_the_library():
    own, tree, r = whole(), bpe.Codec(PATH, P.PATTERN, leaf_chars=8, leaf_bytes=3), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "1", "23", "'s", "'", "!!", ".", "\x1c", " ", "😀", "ing", "tion", "ERE"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        ids = tree.encode(text)
        assert ids == own.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_long_run_without_any_seam():
    text = "abcdefghq" * 3000
    assert bpe.Codec(PATH, P.PATTERN).encode(text) == whole().encode_ordinary(text)


def test_query_rows(spark):
    own = whole()
    texts = [(1, "Hello there  world"), (1, "Hello there  world"), (2, None), (None, ""), (5, "x " * 40_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_digest(df, PATH, P.PATTERN).collect()
    assert len(rows) == len(texts)
    want = sorted((str(i), len(ids := own.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe.decode_ids(bpe.encode_ids(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.payload or b"").decode() for r in back) == sorted(t or "" for _, t in texts)
    assert bpe.encode_digest(df.limit(0), PATH, P.PATTERN).count() == 0
