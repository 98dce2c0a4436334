"""Removes byte strings that start in more than one place, by a sparse distributed suffix array.

1. A narrow pass cuts each text's windows of ``window`` bytes into runs that share an anchor
   (``windows.runs``) and takes a 128-bit digest of each run's string. Anchors that occur once can't belong to a repeat.
2. Equal strings around an anchor are one class, so that thousands of copies of a passage are one suffix in what follows.
   Whatever a class of several members holds is repeated.
3. Of each class around an anchor that has others, the suffix from the anchor on is sorted within tasks, front-coded (only
   the bytes beyond the prefix shared with the previous suffix are kept), dealt to ranges of the sorted order (and, beyond
   ``RANGES`` of them, by the anchors' hashes, so that a bucket keeps its size however large the corpus is), and there merged by
   loser trees that compare two suffixes only beyond the prefix that both are known to share with the
   last one put out. The common prefixes of neighbours in the merged order, and those of the parts left of the
   anchor in an order of their own, tell which windows two classes share: bytes are compared, not hashes.
4. Anchors around which more than ``HOT`` different strings stand, which would fill a task, have their
   windows counted by a grouped Spark aggregate instead, with the same outcome.

Texts are known by the MD5 of their bytes. With ``keep_first`` the earliest place of each string stays, places being
ordered by id (null ones last), text digest and position; rows that agree in id and text count as one document there.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.llm.shared import column, discard, materialize, smallest, whole_row
from tidewake.llm.windows import merged, runs, window_hashes

WINDOW = 400
ANCHOR = 64
HOT = 20_000
BUCKET_BYTES = 4 << 20
#: Ranges of the sorted order, for which 40 suffixes each are sampled. A corpus that needs more buckets than that
#: is dealt by its anchors' hashes too, and each such part has these ranges.
RANGES = 500
FRAGMENT = 2000
_LAST = (1 << 63) - 1
_OF_BYTE = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), np.uint64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text, doc = F.coalesce(column(text_col), F.lit("")), F.coalesce(column(id_col).cast("long"), F.lit(_LAST))
    return docs.select(*more, doc.alias("doc"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def _scan(window: int, anchor: int):
    names = ["kh", "sh", "start", "place", "n", "doc", "key"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc, text, key in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                if len(raw) < window:
                    continue
                kh, start, place, n = runs(_OF_BYTE[0][np.frombuffer(raw, np.uint8)], window, anchor)
                stop = (start + n - 1 + window).tolist()
                for values, found in zip((out[0], *out[2:5]), (kh.view(np.int64), start, place, n), strict=True):
                    values.append(found)
                out[1] += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), stop, strict=True)]
                out[5] += [doc.as_py()] * len(stop)
                out[6] += [key.as_py()] * len(stop)
            if out[0]:
                flat = [np.concatenate(c) if k in (0, 2, 3, 4) else c for k, c in enumerate(out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names)

    return run, "kh long, sh binary, start long, place int, n int, doc long, key binary"


def lcp(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(x), len(y))
    step = 16
    while at < n and x[at : at + step] == y[at : at + step]:
        at += step
        step *= 2
    if at >= n:
        return n
    lo, hi = at, min(n, at + step)  # they differ before hi, or one ends there
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[at:mid] == y[at:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    before, known, tails = b"", [], []
    for s in ordered:
        known.append(lcp(before, s, 0))
        tails.append(s[known[-1] :])
        before = s
    return known, tails


def merge(coded: list[tuple[list[int], list[bytes]]]):
    """Yields (common prefix with the one before, suffix, run, place in the run) in sorted order.

    ``h[r]`` is what the head of run r shares with the last suffix put out. Of two heads, the one that
    shares more comes first; only if both share the same are bytes compared, from there on.
    """
    k = len(coded)
    if not k:
        return
    head: list[bytes | None] = [None] * k
    h, place, losers = [0] * k, [-1] * k, [-1] * k

    def advance(r):
        place[r] += 1
        known, tails = coded[r]
        if place[r] < len(known):
            h[r] = known[place[r]]
            head[r] = (head[r] or b"")[: h[r]] + tails[place[r]]
        else:
            head[r] = None

    def duel(a, b):
        """(winner, loser)"""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if h[a] != h[b]:
            return (a, b) if h[a] > h[b] else (b, a)
        x, y = head[a], head[b]
        at = lcp(x, y, h[a])
        first = (a, b) if (at == len(x) and (at < len(y) or a < b)) or (at < len(x) and at < len(y) and x[at] < y[at]) else (b, a)
        h[first[1]] = at
        return first

    for r in range(k):
        advance(r)
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = duel(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while head[top] is not None:
        yield h[top], head[top], top, place[top]
        advance(top)
        node = (top + k) // 2
        while node:
            top, losers[node] = duel(top, losers[node])
            node //= 2


def shared_windows(held: list[tuple], window: int, first: bool = False) -> np.ndarray:
    """``held``: (common prefix with the one before, left part, suffix, place) in sorted order, each string once around its anchor.

    Of each member a row of flags, one for each p: whether its window that begins p bytes before the anchor stands around
    another member too (with ``first``: around one of a smaller place). Two members share it if they agree in p bytes to
    the left and in ``window - p`` from the anchor on. Which stretches of the merged order agree that far, neighbours'
    common prefixes tell; the order of the reversed left parts has such prefixes of its own.
    """
    m = len(held)
    flags = np.zeros((m, window), bool)
    if m < 2:
        return flags
    right = np.array([h[0] for h in held] + [0])
    back = [h[1][::-1] for h in held]
    by_left = sorted(range(m), key=back.__getitem__)
    left = np.array([0] + [lcp(back[i], back[j], 0) for i, j in zip(by_left, by_left[1:], strict=False)] + [0])
    by_left = np.array(by_left, int)
    rank = np.zeros(m, int)
    if first:
        rank[sorted(range(m), key=lambda i: held[i][3])] = np.arange(m)
    reach_right = np.maximum(right[:-1], right[1:])
    reach_left = np.empty(m, int)
    reach_left[by_left] = np.maximum(left[:-1], left[1:])
    cell = np.empty(m, np.int64)
    for p in range(max((len(b) for b in back), default=-1) + 1):
        at = np.flatnonzero((reach_left >= p) & (reach_right >= window - p))
        if len(at) < 2:
            continue
        cell[by_left] = np.cumsum(left[:-1] < p)
        key = np.cumsum(right[:-1] < window - p)[at] * np.int64(m + 1) + cell[at]
        order = np.lexsort((rank[at], key))
        twin = key[order[1:]] == key[order[:-1]]
        flags[at[order[1:][twin]], p] = True
        if not first:
            flags[at[order[:-1][twin]], p] = True
    return flags


def _spans(flags: np.ndarray, start: int, window: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [(start + a, start + b - 1 + window) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


_MEMBER = pa.struct([("known", pa.bool_()), ("doc", pa.int64()), ("key", pa.binary()), ("start", pa.int64())])
_MEMBER_SQL = "struct<known:boolean,doc:long,key:binary,start:long>"


def _sorted_runs(splitters: list[bytes], parts: int):
    """Contexts (kh, known, doc, key, start, place, string) to front-coded fragments of sorted runs, each for one range of one part."""

    def bucket_of(row):
        return row[0][0] * (len(splitters) + 1) + bisect_right(splitters, row[0][1][:ANCHOR])

    def flush(held):
        held.sort(key=lambda r: r[0])
        at = 0
        while at < len(held):
            bucket = bucket_of(held[at])
            end = at
            while end < len(held) and end - at < FRAGMENT and bucket_of(held[end]) == bucket:
                end += 1
            known, tails = front_code([r[0][1] for r in held[at:end]])
            yield [bucket], [known], [tails], [[r[1] for r in held[at:end]]], [[r[2] for r in held[at:end]]]
            at = end

    def run(batches):
        held, size = [], 0
        names = ["bucket", "shared", "tails", "lefts", "members"]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(_MEMBER)]
        for batch in batches:
            for r in batch.to_pylist():
                s, p = r["string"], r["place"]
                held.append(((r["kh"] % parts, s[p:]), s[:p], {k: r[k] for k in ("known", "doc", "key", "start")}))
                size += len(s)
                if size > 4 * BUCKET_BYTES:
                    for columns in flush(held):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                    held, size = [], 0
        for columns in flush(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run, f"bucket long, shared array<int>, tails array<binary>, lefts array<binary>, members array<{_MEMBER_SQL}>"


def _merge_bucket(window: int, anchor: int, first: bool):
    def run(table: pa.Table) -> pa.Table:
        shared, tails, lefts, members = (table.column(c).to_pylist() for c in ("shared", "tails", "lefts", "members"))
        out: list[tuple[int, bytes, int, int]] = []
        held, met, size = [], [], 0

        def settle():
            flags = shared_windows(held, window, first)
            for row, (_, left, _, _), m in zip(flags, held, met, strict=True):
                if first or not m["known"]:
                    out.extend((m["doc"], m["key"], a, b) for a, b in _spans(row[len(left) :: -1], m["start"], window))

        for common, suffix, r, at in merge(list(zip(shared, tails, strict=True))):
            if common < anchor and size > BUCKET_BYTES:  # another anchor begins
                settle()
                held, met, size = [], [], 0
            left, m = lefts[r][at], members[r][at]
            held.append((common if held else 0, left, suffix, (m["doc"], m["key"], m["start"] + len(left))))
            met.append(m)
            size += len(left) + len(suffix)
        settle()
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(("doc", "key", "start", "stop"), kinds, strict=True))})

    return run


def _window_rows(window: int):
    schema = pa.schema([("kh", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("known", pa.bool_()), ("doc", pa.int64()), ("key", pa.binary()), ("start", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(r["string"], np.uint8)
                h, g = (window_hashes(of[raw], window).view(np.int64) for of in _OF_BYTE)
                n = len(h)
                yield pa.RecordBatch.from_pydict({"kh": [r["kh"]] * n, "h": h, "g": g, "known": [r["known"]] * n, "doc": [r["doc"]] * n, "key": [r["key"]] * n, "start": np.arange(r["start"], r["start"] + n)}, schema)

    return run, "kh long, h long, g long, known boolean, doc long, key binary, start long"


def _cut_out(window: int):
    """Texts with their list of runs to the runs' strings."""
    schema = pa.schema([("kh", pa.int64()), ("known", pa.bool_()), ("hot", pa.bool_()), ("doc", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("place", pa.int32()), ("string", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in range(batch.num_rows):
                raw, doc, key = batch.column(0)[part].as_py().encode(), batch.column(1)[part].as_py(), batch.column(2)[part].as_py()
                rows = [r | {"doc": doc, "key": key, "string": raw[r["start"] : r["start"] + r.pop("n") - 1 + window]} for r in batch.column(3)[part].as_py()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run, "kh long, known boolean, hot boolean, doc long, key binary, start long, place int, string binary"


def repeated_spans(keyed: DataFrame, window: int = WINDOW, keep_first: bool = False, anchor: int = ANCHOR, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, ranges: int = RANGES) -> DataFrame:
    """``keyed``: doc, text (no null), key. Returns key (with ``keep_first`` doc and key), start, stop: bytes to be removed; spans may overlap."""
    scan, fields = _scan(window, anchor)
    named = ["doc", "key", "start", "stop"] if keep_first else ["key", "start", "stop"]
    every = materialize(keyed.select("doc", "text", "key").mapInArrow(scan, fields), "runs")
    # what is grouped is written before it is joined: a join right behind a grouping can't split a hot key
    twice = materialize(every.groupBy("kh").agg(F.count("*").alias("c")).where("c > 1").select("kh"), "anchors")
    again = materialize(every.join(twice, "kh", "left_semi"), "runs")
    discard(every)
    classes = materialize(again.groupBy("kh", "sh").agg(F.count("*").alias("c"), F.min(F.struct("doc", "key", "start", "place", "n")).alias("at")), "classes")
    copies = again.join(classes.where("c > 1").select("kh", "sh", "at"), ["kh", "sh"])
    if keep_first:
        copies = copies.where(F.struct("doc", "key", "start") > F.struct("at.doc", "at.key", "at.start"))
    whole = materialize(copies.select("doc", "key", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop")).select(*named).distinct(), "spans")
    discard(again)
    mixed = materialize(classes.groupBy("kh").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1" if keep_first else "k > 1 and least = 1"), "mixed")
    listed = (
        classes.join(mixed, "kh")
        .select("at.doc", "at.key", F.struct("kh", (F.col("c") > 1).alias("known"), (F.col("k") > hot).alias("hot"), "at.start", "at.place", "at.n").alias("run"))
        .groupBy("doc", "key")
        .agg(F.collect_list("run").alias("runs"))
        .select(F.col("doc").alias("of_doc"), F.col("key").alias("of_key"), "runs")
    )
    cut, fields = _cut_out(window)
    chosen = keyed.join(listed, (F.col("key") == F.col("of_key")) & (F.col("doc") == F.col("of_doc"))).select("text", "doc", "key", "runs")
    strings = materialize(chosen.mapInArrow(cut, fields).distinct(), "strings") if keep_first else materialize(chosen.mapInArrow(cut, fields), "strings")
    size = strings.agg(F.sum(F.length("string"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    parts = -(-n_buckets // ranges)
    n_ranges = -(-n_buckets // parts)
    # chosen by place, not by contents: an anchor with many strings weighs as much as it is large, and can't be all of the sample
    placed = strings.where("not hot").select("key", "start", F.substring(F.expr("substring(string, place + 1)"), 1, anchor).alias("s"))
    prefixes = sorted(bytes(r.s) for r in smallest(placed, 40 * n_ranges, F.col("key"), F.col("start"), F.col("s")).collect())
    splitters = sorted({prefixes[len(prefixes) * i // n_ranges] for i in range(1, n_ranges)}) if prefixes else []
    sort, fields = _sorted_runs(splitters, parts)
    found = strings.where("not hot").mapInArrow(sort, fields).groupBy("bucket").applyInArrow(_merge_bucket(window, anchor, keep_first), "doc long, key binary, start long, stop long")
    explode, fields = _window_rows(window)
    counted = strings.where("hot").mapInArrow(explode, fields)
    if keep_first:
        common = counted.groupBy("kh", "h", "g").agg(F.count("*").alias("c"), F.min(F.struct("doc", "key", "start")).alias("at")).where("c > 1")
        rest = counted.join(common, ["kh", "h", "g"]).where(F.struct("doc", "key", "start") > F.col("at"))
    else:
        common = counted.groupBy("kh", "h", "g").agg(F.count("*").alias("c")).where("c > 1")
        rest = counted.where("not known").join(common, ["kh", "h", "g"], "left_semi")
    rest = rest.withColumn("stop", F.col("start") + window)
    return whole.union(materialize(found.select(*named), "spans")).union(rest.select(*named))


def _with_spans(keyed: DataFrame, window: int, keep_first: bool, **sizes) -> DataFrame:
    """``keyed`` with the list of spans to be removed, null where there is none."""
    by = ["doc", "key"] if keep_first else ["key"]
    spans = repeated_spans(keyed.select("doc", "text", "key"), window, keep_first, **sizes).groupBy(*by).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return keyed.join(materialize(spans, "spans"), by, "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False, **sizes) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans: one row per row of ``docs``, null texts as empty ones.

    Two rows with equal texts of at least ``window`` bytes lose all of them (with ``keep_first`` the later one does). Texts
    shorter than a window stay whole. Null ids stay null. Other columns of ``docs``, whatever their names, are not looked at.
    """
    joined = _with_spans(_keyed(docs, id_col, text_col, column(id_col).cast("long").alias("doc_id")), window, keep_first, **sizes).select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                gone = merged([(s["start"], s["stop"]) for s in found.as_py() or ()])
                edges = [0, *(e for g in gone for e in g), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for values, value in zip(out, (kept, len(raw), len(raw) - len(kept), len(gone)), strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """``docs`` without the repeated bytes of its texts: all rows and columns stay, a character that lost a byte goes, null texts stay null."""
    names = docs.columns
    joined = _with_spans(_keyed(docs, id_col, text_col, whole_row(docs).alias("row")), window, keep_first).select("row", "text", "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                found = found.as_py()
                raw = text.as_py().encode() if found else b""
                edges = [0, *(e for g in merged([(s["start"], s["stop"]) for s in found or ()]) for e in g), len(raw)]
                out.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore") if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "kept"])

    done = joined.mapInArrow(cut, StructType([joined.schema["row"]]).add("kept", "string"))
    field = lambda n: F.col("row").getField(n)
    return done.select(*[F.coalesce("kept", field(n)).alias(n) if n == text_col else field(n).alias(n) for n in names])


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """``remove_repeats`` with the kept bytes as their SHA-256: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
