import hashlib
import random
import re

from tidewake.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def compare(rows, got):
    got = sorted(got, key=lambda r: str(r.doc_id))
    for (doc_id, text), r in zip(sorted(rows, key=lambda r: str(r[0])), got, strict=True):
        base = brute(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text, line, r.spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = [x for x in r.spans.split(",") if x]
        assert set(line.split(",")) - {""} <= set(spans)
        keyed = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert keyed == sorted(keyed)


def test_base_rules(spark):
    r = random.Random(8)
    parts = ["a@b.c", "_", "%", "x.y+z@host.example.com", "@", ".", "-", " ", "1.2.3.4", "256.1.1.1", "00.01.2.3", "4111111111111111", "4111 1111 1111 1111", "4219-3399-2238-7353", "+1 (582) 555-8400", "+", "(", ")", "é", "😀", "12", "7", "\n", "a@b", "+49.30.123456", "..", "name (at) host (dot) com"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(600)]
    rows += [(9001, None), (9002, ""), (9003, "1" * 20_000), (9004, "a" * 20_000), (9005, "x@y.zz " * 3000), (9006, "+1" + "-" * 50_000), (9007, "1 " * 40_000), (9008, "1.2.3.4 " * 2000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    compare(rows, pii.find(df).collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = pii.find(docs).collect()
    compare(rows, got)
    assert sum(r.n_email + r.n_card + r.n_phone + r.n_ip for r in got) > 0
    assert pii.find(docs.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de or +1 (582) 555-8400 now", "en"), (None, None, "x"), (3, "é 4111111111111111😀", "y"), (3, "é 4111111111111111😀", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {(r.doc_id, r.text, r.base) for r in pii.redact(df).collect()}
    assert got == {(1, "mail <email> or <phone> now", "en"), (None, None, "x"), (3, "é <card>😀", "y")}
    assert pii.redact(df).count() == 4


def test_learned_spans_are_added(spark):
    rows = [(i, f"write to user{i}@mail{i % 7}.example.com or +1 (58{i % 9}) 555-84{i % 90 + 10} today, order 12345678{i % 90 + 10}99001 came") for i in range(400)]
    rows += [(1000, "write to anna.b (at) mail3 (dot) example (dot) com today"), (1001, "call 1 (582) 555-8400 today"), (1002, "order 1234567812340001 came")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].n_email == 0 and got[1000].spans == "email:9:50"
    assert got[1001].spans == "phone:5:21"
    assert got[1002].spans == ""


def test_trees_agree_with_their_expression(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.integers(0, 5, (200, len(pii.FEATURES)))
    pos = (x[:, 0] > 2) * (x[:, 3] < 2) * 5.0
    trees = pii._boost(x, pos, 5 - pos, rounds=6)
    df = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(x)], ["i", *pii.FEATURES])
    from pyspark.sql import functions as F

    got = [v.z for v in df.select("i", pii._margin(trees, F.struct(*pii.FEATURES)).alias("z")).orderBy("i").collect()]
    assert np.allclose(got, pii._margin_of(trees, x))


def test_overlapping_spans_are_redacted_whole(spark):
    rows = [(1, "see 10.0.0.0 4111 1111 1111 1111 end"), (2, "see a@b.4111 1111 1111 1111 end"), (3, "a@b.cc 10.0.0.1")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "see <ip> end", 2: "see <email> end", 3: "<email> <ip>"}
