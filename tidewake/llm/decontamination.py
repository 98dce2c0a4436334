"""Benchmark passages in documents, found by winnowing, with DataFrame functions only.

Texts become words; of each ten words in a row (a window) the smallest hash of its six five-word grams is kept, so two texts that share
a window keep the same gram of it. The distinct fingerprints of the benchmark are joined to those of the documents. A hit is extended to
the windows that hold it, and each of these is looked up by its very words among the benchmark's distinct windows. Both
joins are to distinct keys, so a passage that a third of all documents or items have makes no pairs.

Items shorter than a window have one window, the whole item. Winnowing promises nothing for these, so where there are such items, every
gram of a document with as many words is joined to them.

Windows that occur in the same items are one class. A document is told apart by its set of classes only, and items
are listed once for each distinct set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import column, materialize

WINDOW = 10
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none of a null one. Capitals beyond A to Z stay: words that have such letters are the slow case."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK, -1), "")
    return F.transform(parts, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _places(n: Column) -> Column:
    """1, 2, ... n; nothing below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(df: DataFrame, n: int) -> DataFrame:
    """Adds ``__g``: the hash of each n words of ``__w`` in a row. Hashes of words are hashed, so each word is read once.

    Helper columns are named twice outside of a function's body: Spark then doesn't move their making into it, where
    it would run once for each element.
    """
    hashed = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    each = F.transform(_places(F.size("__h") - (n - 1)), lambda i: F.xxhash64(F.slice("__h", i, n)))
    return hashed.withColumn("__g", F.when(F.size("__h") >= n, each).otherwise(F.array().cast("array<bigint>"))).drop("__h")


def fingerprints(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``__f``, array of (gram, at): the kept grams of ``__w`` with the place of their first word, from 1.

    A gram is kept if it is the smallest of some window's by the upper half of its hash, of equal ones the first: that
    half and the place make one number, so each window's least number names its gram.
    """
    wide = window - gram + 1
    out = _gram_hashes(df, gram)
    placed = F.transform("__g", lambda g, i: F.shiftleft(F.shiftright(g, 32), 32) + i + 1)
    out = out.withColumn("__v", F.when(F.size("__g") >= wide, placed).otherwise(F.array().cast("array<bigint>")))
    least = F.transform(_places(F.size("__v") - (wide - 1)), lambda i: F.array_min(F.slice("__v", i, wide)))
    out = out.withColumn("__m", F.when(F.size("__v") >= wide, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>")))
    at = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    each = F.transform("__m", lambda v: F.struct(F.get("__g", at(v) - 1).alias("gram"), at(v).alias("at")))
    return out.withColumn("__f", F.when((F.size("__g") >= wide) & (F.size("__m") > 0), each)).drop("__g", "__v", "__m")


def _each(df: DataFrame, *keep: str, of: str, name: str = "f") -> DataFrame:
    """A row for each element of array ``of``.

    By ``explode_outer``: for ``explode`` Spark adds a filter on the array's size, moves it to the scan and evaluates all helper columns in it
    within each other's functions.
    """
    return df.select(*keep, F.explode_outer(of).alias(name)).where(F.col(name).isNotNull())


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item, size, line: each window of each item (its words ``__w``), or the whole of a shorter item, as one line."""
    n = F.size("__w")
    each = F.transform(_places(F.greatest(n - (window - 1), F.least(n, F.lit(1)))), lambda i: F.array_join(F.slice("__w", i, window), " "))
    return _each(items.select("item", F.least(n, F.lit(window)).alias("size"), F.when(n >= 1, each).alias("__l")), "item", "size", of="__l", name="line")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated: one row per document.

    A window is ``window`` words of an item in a row; an item of fewer words, but not none, is one window. A document's word is hit if
    it lies in an occurrence of a window. A null text has no words and a null item id is the empty string; items of equal id are one item, and
    repeated documents or ids have a row each. Case is folded for A to Z only. Texts of any length are
    compared whole; equal texts are looked up once. Other columns aren't read. An empty benchmark hits nothing.
    """
    items = materialize(benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), words(column(item_text_col)).alias("__w")).distinct(), "items")
    per_window = _windows(items, window).groupBy("size", "line").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = materialize(per_window.select("size", "line", F.sha2(F.to_json("items"), 256).alias("class"), "items"), "windows")
    classes = materialize(known.groupBy("class").agg(F.first("items").alias("items")), "classes")
    marks = materialize(_each(fingerprints(items.where(F.size("__w") >= window), window, gram), of="__f").select("f.gram").distinct(), "marks")
    sizes = sorted(r["size"] for r in known.where(F.col("size") < window).select("size").distinct().collect())  # window - 1 at most

    text = F.coalesce(column(text_col), F.lit(""))
    docs = documents.select(column(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    texts = docs.select("key", words(F.col("text")).alias("__w"))
    hits = _each(fingerprints(texts, window, gram), "key", of="__f").select("key", "f.gram", "f.at").join(marks, "gram", "left_semi")
    # a gram lies in the windows that begin up to window - gram places before it
    first = F.explode(F.sequence(F.greatest(F.col("at") - (window - gram), F.lit(1)), F.col("at"))).alias("at")
    starts = hits.select("key", F.lit(window).alias("size"), first)
    for size in sizes:
        short = known.where(F.col("size") == size).select(F.xxhash64(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))).alias("gram")).distinct()
        grams = _gram_hashes(texts, size).select("key", F.posexplode_outer("__g").alias("at", "gram"))
        starts = starts.union(grams.join(short, "gram", "left_semi").select("key", F.lit(size).alias("size"), (F.col("at") + 1).alias("at")))
    found = materialize(starts.groupBy("key").agg(F.collect_set(F.struct("size", "at")).alias("starts")), "starts")

    # merged at every size: what is found grows with the documents, so a broadcast would only hold for small tables
    seen = docs.select("key", "text").join(found.hint("merge"), "key").select("key", words(F.col("text")).alias("__w"), "starts")
    line = lambda s: F.struct(s["size"].alias("size"), s["at"].alias("at"), F.array_join(F.slice("__w", s["at"], s["size"]), " ").alias("line"))
    lines = _each(seen.select("key", F.when(F.size("__w") > 0, F.transform("starts", line)).alias("__l")), "key", of="__l").select("key", "f.size", "f.at", "f.line").distinct()
    met = lines.join(known.select("size", "line", "class"), ["size", "line"])
    spans = F.array_sort(F.collect_set(F.struct("at", "size")))
    per_text = materialize(met.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set("class")).alias("classes")), "met")

    # words covered: spans in order of their first word, each adding what lies beyond all before
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("next"))
    behind = lambda s: s["at"] + s["size"]
    covered = F.aggregate("spans", start, lambda acc, s: F.struct((acc["n"] + F.greatest(behind(s) - F.greatest(acc["next"], s["at"]), F.lit(0))).alias("n"), F.greatest(acc["next"], behind(s)).alias("next")), lambda acc: acc["n"])
    sets = per_text.select("classes", F.sha2(F.array_join("classes", ","), 256).alias("set"))
    listed = sets.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class")).join(classes, "class").select("set", F.explode("items").alias("item"))
    told = materialize(listed.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")).select("set", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "sets")
    result = materialize(per_text.select("key", covered.alias("n_hit"), F.sha2(F.array_join("classes", ","), 256).alias("set")).join(told, "set").drop("set"), "hits")
    out = docs.select("id", "key", F.size(F.array_remove(F.split("text", _BREAK, -1), "")).alias("n_words")).join(result, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
