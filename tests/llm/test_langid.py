import math

from pyspark.sql import functions as F

from tidewake.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.held_out_predictions(docs).alias("p").join(docs.alias("d"), "doc_id").where("held_out and lang_pred <> 'und'")
    n, good = out.count(), out.where("lang_pred = lang").count()
    assert n > 20 and good / n > 0.9


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (1, "the cat and the dog", "en", 1.0), (2, "le chat et le chien", "fr", 1.0), (3, None, "en", 1.0), (4, "", None, 1.0), (None, "12 34 !!", "fr", 1.0), (6, "the dog " * 50_000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, (r.text or "")[:5]): r for r in langid.predict(docs, model).collect()}
    assert len(langid.predict(docs, model).collect()) == len(rows)
    assert got[1, "the c"].lang_pred == "en" and got[2, "le ch"].lang_pred == "fr" and got[6, "the d"].lang_pred == "en"
    assert {got[3, ""].lang_pred, got[4, ""].lang_pred, got[None, "12 34"].lang_pred} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = langid.held_out_predictions(docs.limit(0))
    assert empty.count() == 0
    nothing = langid.fit(docs.where(F.lit(False)))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_predictions_against_all_centroids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        counts = langid.ngram_counts(r.text or "")
        weights = {i: math.log1p(float(counts[i])) * float(model.idf[i]) for i in counts.nonzero()[0].tolist()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1
        sims = [sum(w * float(c[i]) for i, w in weights.items()) / norm for c in model.centroids]
        best = max(sims)
        assert abs(got[r.doc_id].score - min(1, best)) < 1e-4
        assert got[r.doc_id].lang_pred in {model.languages[o] for o, s in zip(model.owner, sims, strict=True) if s > best - 1e-4}


def test_ties_and_rejection(spark):
    rows = [(i, "one and the same text stands here", lang) for i, lang in enumerate(["b", "a", "c"])] + [(9, "zzz qqq xxx " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert {got[i].lang_pred for i in range(3)} == {"a"} and not got[0].rejected and got[9].rejected
    assert sorted(r.doc_id for r in langid.trusted(docs, model).collect()) == [0, 1, 2]
