"""Removes word sequences that an earlier document has too, by compacting a De Bruijn graph.

The graph's edges are k-mers: ``window`` consecutive words of a document; its nodes are the ``window - 1`` words that two
neighbouring edges share.

1. Neighbouring edges of a document that share an anchor (``windows.runs``) are laid down as one path. Anchors that only one
   document has can't belong to a repeat. Equal paths are one, with the coordinates of its first source.
2. Where different paths stand around one anchor the graph branches: their edges are taken apart, each learns its first
   source, and stretches that have one source are paths again.
3. Repeated paths meet at nodes. A node where one path ends and one begins, each time both of them, doesn't branch: the paths
   are compacted there, by joins that double the reach of each path's pointer to the path's beginning until none moves. So whoever
   has a compacted path's beginning has all of it.
4. Documents are matched to compacted paths by the paths' beginnings alone: an occurrence is one row, a long span with the path's
   length and source. The source's words there are cut out, joined to the spans, and compared word for word before anything is
   removed, so no removal rests on a hash.

Document ids are compared as numbers; null ids come after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.shared import column, discard, materialize
from tidewake.llm.windows import merged, runs, window_hashes

WINDOW = 50
ANCHOR = 10
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, doc = F.coalesce(column(text_col), F.lit("")), column(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(_LAST)).alias("doc"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def _hashed(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def _paths(window: int, anchor: int):
    names = ["kh", "sh", "head", "tail", "start", "n", "doc", "key"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc, text, key in zip(*batch.columns, strict=True):
                words = text.as_py().encode().split()
                if len(words) < window:
                    continue
                kh, start, _, n = runs(_hashed(words), window, anchor)
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.append(0, ends[:-1] + 1)
                sh = [xxhash.xxh3_64_intdigest(line[a:b], 7) for a, b in zip(begins[start].tolist(), ends[start + n - 2 + window].tolist(), strict=True)]
                seams = np.append(start, start[-1] + n[-1])  # each run ends at the node that the next begins at
                nodes = np.array([xxhash.xxh3_64_intdigest(line[a:b], 8) for a, b in zip(begins[seams].tolist(), ends[seams + window - 2].tolist(), strict=True)], np.uint64).view(np.int64)
                for values, found in zip(out, (kh.view(np.int64), np.array(sh, np.uint64).view(np.int64), nodes[:-1], nodes[1:], start, n), strict=False):
                    values.append(found)
                out[6] += [doc.as_py()] * len(sh)
                out[7] += [key.as_py()] * len(sh)
            if out[0]:
                columns = [pa.array(np.concatenate(c), k) for c, k in zip(out, (*[pa.int64()] * 5, pa.int32()), strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out[6], pa.int64()), pa.array(out[7], pa.binary())], names)

    return run, "kh long, sh long, head long, tail long, start long, n int, doc long, key binary"


def _edges(window: int):
    """Texts with their list of branching paths to those paths' edges."""

    def run(batches):
        for batch in batches:
            for text, doc, paths in zip(*batch.columns, strict=True):
                words, doc, out = text.as_py().encode().split(), doc.as_py(), []
                for p in paths.as_py():
                    e = window_hashes(_hashed(words[p["start"] : p["start"] + p["n"] - 1 + window]), window)
                    out.append((np.full(len(e), p["kh"]), np.full(len(e), p["sh"]), e.view(np.int64), np.arange(len(e)), np.full(len(e), doc)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["kh", "sh", "edge", "i", "doc"])

    return run, "kh long, sh long, edge long, i long, doc long"


def _compacted(again: DataFrame, firsts: DataFrame) -> DataFrame:
    """``again``: every occurrence of shared paths. ``firsts``: each path (kh, sh, head, tail) with its first source at, and whole: whether it is repeated as it is.

    Returns kh, sh of each compacted path's beginning, sdoc, skey, s (its first source) and length, in edges.
    """

    def ways(node: str, place, one: str, sum_: str):
        kind = F.struct("kh", "sh")
        there = F.xxhash64("doc", "key", place).cast("decimal(20,0)")
        found = again.groupBy(F.col(node).alias("node")).agg(F.min(kind).alias("least"), F.max(kind).alias("most"), F.sum(there).alias(sum_), F.count("*").alias(one))
        return materialize(found.where("least = most").select("node", one, sum_), "ways")

    ins = ways("tail", F.col("start") + F.col("n"), "ins", "ends")
    outs = ways("head", F.col("start"), "outs", "begins")
    plain = materialize(ins.join(outs, "node").where("ins = outs and ends = begins").select("node"), "nodes")
    part = firsts.where("whole").select("kh", "sh", "at.*", "head", "tail")
    above = part.join(plain, F.col("tail") == F.col("node")).select("doc", "key", (F.col("start") + F.col("n")).alias("start"), F.col("start").alias("up"), F.col("node").alias("head"))
    now = materialize(part.join(above, ["doc", "key", "start", "head"], "left").select("doc", "key", "start", "n", F.coalesce("up", "start").alias("root")), "compact")
    while True:  # each round doubles the reach: as many as the longest path has binary digits
        moved = now.where("root < start").agg(F.sum("root").cast("string"), F.count("*")).first()
        further = now.select("doc", "key", F.col("start").alias("root"), F.col("root").alias("up"))
        after = materialize(now.join(further, ["doc", "key", "root"]).select("doc", "key", "start", "n", F.col("up").alias("root")), "compact")
        discard(now)
        now = after
        if tuple(now.where("root < start").agg(F.sum("root").cast("string"), F.count("*")).first()) == tuple(moved):
            break
    paths = now.groupBy("doc", "key", "root").agg((F.max(F.col("start") + F.col("n")) - F.col("root")).alias("length")).withColumnRenamed("root", "start")
    return part.join(paths, ["doc", "key", "start"]).select("kh", "sh", F.col("doc").alias("sdoc"), F.col("key").alias("skey"), F.col("start").alias("s"), "length")


def _slices(batches):
    """Texts with a list of places to the words that stand there."""
    for batch in batches:
        out = [[] for _ in range(5)]
        for text, doc, key, places in zip(*batch.columns, strict=True):
            words = text.as_py().encode().split()
            for p in places.as_py():
                for values, value in zip(out, (doc.as_py(), key.as_py(), p["sat"], p["n"], b" ".join(words[p["sat"] : p["sat"] + p["n"]])), strict=True):
                    values.append(value)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["sdoc", "skey", "sat", "n", "said"])


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``keyed``: doc, text (no null), key. Returns doc, key, start, stop (in words) covered by windows that start in a smaller doc, and said: the words there. A row for each occurrence of a compacted path."""
    scan, fields = _paths(window, anchor)
    every = materialize(keyed.select("doc", "text", "key").mapInArrow(scan, fields), "paths")
    # what is grouped is written before it is joined: a join right behind a grouping can't split a hot key
    shared = materialize(every.groupBy("kh").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("kh"), "shared")
    again = materialize(every.join(shared, "kh", "left_semi"), "paths")
    discard(every)
    firsts = again.groupBy("kh", "sh").agg(F.min(F.struct("doc", "key", "start", "n")).alias("at"), F.max("doc").alias("hi"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    firsts = materialize(firsts.withColumn("whole", F.col("at.doc") < F.col("hi")), "firsts")
    forks = materialize(firsts.groupBy("kh").agg(F.count("*").alias("k"), F.min("at.doc").alias("lo"), F.max("at.doc").alias("hi")).where("k > 1 and lo < hi").select("kh"), "forks")
    branching = materialize(firsts.join(forks, "kh", "left_semi"), "branching")
    listed = (
        branching.groupBy(F.col("at.doc").alias("of_doc"), F.col("at.key").alias("of_key"))
        .agg(F.collect_list(F.struct("kh", "sh", "at.start", "at.n")).alias("paths"))
    )
    take, fields = _edges(window)
    on = (F.col("key") == F.col("of_key")) & (F.col("doc") == F.col("of_doc"))
    edges = materialize(keyed.join(listed, on).select("text", "doc", "paths").mapInArrow(take, fields).distinct(), "edges")
    first_edge = materialize(edges.groupBy("kh", "edge").agg(F.min(F.struct("doc", "sh", "i")).alias("src"), F.max("doc").alias("hi")).where("src.doc < hi").drop("hi"), "first_edges")
    late = edges.join(first_edge, ["kh", "edge"]).where("doc > src.doc").select("kh", "sh", "i", "doc", F.col("src.sh").alias("src_sh"), (F.col("i") - F.col("src.i")).alias("ahead"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("kh", "sh", "src_sh", "ahead").orderBy("i"))  # an edge has one place in a path
    stretches = late.withColumn("island", island).groupBy("kh", "sh", "doc", "src_sh", "ahead", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    sources = branching.select("kh", F.col("sh").alias("src_sh"), F.col("at.doc").alias("sdoc"), F.col("at.key").alias("skey"), F.col("at.start").alias("s"))
    stretches = materialize(stretches.join(sources, ["kh", "src_sh"]).select("kh", "sh", "doc", "a", "b", "sdoc", "skey", (F.col("s") - F.col("ahead")).alias("s")), "stretches")
    discard(edges)
    words_of = lambda edges: edges - 1 + window
    split = again.join(stretches, ["kh", "sh", "doc"]).select("doc", "key", "sdoc", "skey", (F.col("start") + F.col("a")).alias("start"), (F.col("s") + F.col("a")).alias("sat"), words_of(F.col("b") - F.col("a") + 1).alias("n"))
    paths = materialize(_compacted(again, firsts), "compacted")
    whole = again.drop("n").join(paths, ["kh", "sh"]).where("doc > sdoc").select("doc", "key", "sdoc", "skey", "start", F.col("s").alias("sat"), words_of(F.col("length")).alias("n"))
    spans = materialize(whole.union(split).withColumn("stop", F.col("start") + F.col("n")).distinct(), "spans")
    discard(again)
    places = spans.select("sdoc", "skey", "sat", "n").distinct().groupBy(F.col("sdoc").alias("of_doc"), F.col("skey").alias("of_key")).agg(F.collect_list(F.struct("sat", "n")).alias("places"))
    words = keyed.join(places, on).select("text", "doc", "key", "places").mapInArrow(_slices, "sdoc long, skey binary, sat long, n long, said binary").distinct()
    return spans.join(materialize(words, "words"), ["sdoc", "skey", "sat", "n"]).select("doc", "key", "start", "stop", "said")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the kept words joined by one space), n_words, n_removed: one row per row of ``docs``.

    A null text has no words. Rows that share an id never count as earlier for each other; a null id is
    later than any other and not earlier than another null. Texts shorter than a window stay whole.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = materialize(repeated_spans(keyed, window, anchor).groupBy(F.col("doc").alias("of_doc"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("start", "stop", "said")).alias("spans")), "spans")
    joined = keyed.join(spans, (F.col("key") == F.col("of_key")) & (F.col("doc") == F.col("of_doc")), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            out = [[], [], []]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                gone = merged([(s["start"], s["stop"]) for s in found.as_py() or () if b" ".join(words[s["start"] : s["stop"]]) == s["said"]])
                edges = [0, *(e for g in gone for e in g), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                for values, value in zip(out, (b" ".join(kept).decode(), len(words), len(words) - len(kept)), strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "kept", "n_words", "n_removed"])

    return joined.mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long")


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """``remove_repeats`` with the kept words as their SHA-256: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
