import random
import re

import corpus_pipeline as cp
from tidewake.llm import pii
from tests.llm.test_near import brute as one_of_each
from tests.llm.test_packing import valid

SF = "/root/testdata/sf0.001"


def spans_removed(rows, w=cp.PASSAGE):
    """Texts without what starts at an earlier place: by id, null last, then by position."""
    seen = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - w + 1):
            if raw[k : k + w] in seen:
                gone[k : k + w] = b"\x01" * w
            seen.add(raw[k : k + w])
        yield i, t if not any(gone) else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(70001, None, "en", "s", 0), (70002, "12 34 !!", "en", "s", 8), (None, "the cat was in the house with the dog", None, None, None)], docs.schema)
    now, tables = docs.union(extra), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(now.collect())
    lang, near, span, private, packed = tables
    ids = {r.doc_id for r in lang}
    assert {70001, 70002} & ids == set() and None in ids
    assert len(ids) >= docs.count() - 3  # clean documents stay
    ordered = sorted(lang, key=lambda r: (r.doc_id is None, r.doc_id))
    want = {ordered[g].doc_id for g in one_of_each([(g, r.text) for g, r in enumerate(ordered)])}
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in near)
    assert dict(spans_removed([(r.doc_id, r.text) for r in near])) == {r.doc_id: r.text for r in span}
    assert all(r.n_chars == len(r.text) for r in span)
    found = {r.doc_id: r.spans for r in pii.find(spark.read.parquet(f"{tmp_path}/2")).collect()}
    for r in span:
        text, at, out = r.text, 0, ""
        for kind, a, b in sorted((tuple(x.split(":")) for x in found[r.doc_id].split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
            if int(a) >= at:
                out, at = out + text[at : int(a)] + f"<{kind}>", int(b)
            at = max(at, int(b))
        assert next(p.text for p in private if p.doc_id == r.doc_id) == out + text[at:]
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w+", p.text) for p in private)
    assert {p.doc_id for p in packed} == {p.doc_id for p in private}
    valid([(p.length, p.sequence_id, p.offset) for p in packed], 2048)


def through(spark, docs, tmp_path):
    tables = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
        tables.append(docs.collect())
    return tables


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    text = "the cat sat in the house with the dog and the bird sang a song for them all day "
    rows = [(1, text, "en", 7.0, True, "k", "r", 0.5), (1, text, "en", 7.0, True, "k", "r", 0.5), (2, text * 8, "en", None, None, None, None, None), (3, None, None, 1.0, False, "", "", 2.0), (4, "write to x@y.org or 1.2.3.4 now my dear old friend of the house", "en", 3.0, False, "t", "s", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean, key string, row string, `a.b` double")
    tables = through(spark, docs, tmp_path)
    assert sorted((r.doc_id, r.score, r.rejected, r.key, r.row, r["a.b"]) for r in tables[3] if r.doc_id != 2) == [(1, 7.0, True, "k", "r", 0.5), (4, 3.0, False, "t", "s", 0.1)]
    assert {r.doc_id for r in tables[4]} == {1, 2, 4}
    assert "<email> or <ip>" in next(r.text for r in tables[3] if r.doc_id == 4)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert through(spark, docs, tmp_path) == [[]] * 5


def test_a_passage_of_fifty_words_goes_from_all_but_one(spark):
    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(n))
    passage = some(52)
    assert len(passage) < 400
    docs = spark.createDataFrame([(i, f"{some(40)} {passage} {some(30)}", 1) for i in (5, 3, 9)], "doc_id long, text string, n_chars int")
    got = {x.doc_id: x for x in cp.span_dedup(spark, docs, SF).collect()}
    assert [i for i in got if passage in got[i].text] == [3] and all(x.n_chars == len(x.text) for x in got.values())


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns[-2:] == ["sequence_id", "offset"] and got.count() > 100
