"""SimHash near-duplicates: fingerprints compared exactly, tile by tile.

Distinct fingerprints are dealt into tiles by the bit counts of their four 16-bit lanes. Two
fingerprints within a radius differ by no more than that in the sum of the lanes' count differences,
so only tile pairs within the radius are compared, each by numpy exclusive-or and bit counts. A tile
that grows beyond ``TILE`` rows is split into blocks, and blocks meet block by block: all of them, so
nothing is lost, and no task holds more than two blocks. Of a block pair's links a spanning forest is
kept, which has the same components in at most as many rows as fingerprints.

``keep_one`` finds texts of a Jaccard similarity by the same tiles over longer fingerprints, and decides it by the shingles themselves.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tidewake.llm.components import components
from tidewake.llm.shared import column, materialize, whole_row
from tidewake.llm.windows import mix

RADIUS = 3
SHINGLE = 3
TILE = 512
_LANES = 4


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned; zero if the text has no word. Works for texts of any length in slices of shingles."""
    words = text.encode("utf-8", "ignore").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - width + 1
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        a, b = starts[at : min(n, at + 65_536)].tolist(), ends[at + width - 1 : min(n, at + 65_536) + width - 1].tolist()
        hashes = np.array([h(line[i:j], 42) for i, j in zip(a, b, strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id as doc_id, if none is given) and ``fp``, the fingerprint's bits as a long. A null text has no words."""
    kept = docs.select(*map(column, keep), column(text_col).alias("__text")) if keep else docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return kept.mapInArrow(run, StructType(kept.schema.fields[:-1]).add("fp", "long"))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps from a tile to those it meets: one of each pair, itself included."""
    span = range(-radius, radius + 1)
    near = [o for o in itertools.product(span, repeat=_LANES) if sum(map(abs, o)) <= radius]
    return [o for o in near if o >= (0,) * _LANES]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fps``: fp (distinct). Pairs a, b of different fingerprints that join all which link at ``radius`` or fewer bits."""
    lanes = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(_LANES)]
    at = F.lit(0)
    for lane in lanes:
        at = at * 64 + lane
    placed = fps.select("fp", at.alias("cell"))
    blocks_of = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))  # 17 ** 4 rows at most, 2 MB
    blocks = (
        placed.join(F.broadcast(blocks_of), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialize(blocks, "tiles")
    steps = [sum(x * 64 ** (_LANES - 1 - i) for i, x in enumerate(o)) for o in _offsets(radius)]
    left = blocks.select(F.col("block").alias("block_a"), F.col("fps").alias("a"), F.col("cell").alias("cell_a"), F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps])).alias("cell"))
    met = left.join(blocks.select("cell", "block", F.col("fps").alias("b")), "cell").where((F.col("cell") > F.col("cell_a")) | (F.col("cell_a") == F.col("cell")) & (F.col("block_a") <= F.col("block"))).select("a", "b")

    def compare(batches):
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = np.asarray(x.values.to_numpy()), np.asarray(y.values.to_numpy())
                for i in range(0, len(a), 512):
                    near = np.bitwise_count(np.bitwise_xor(a[i : i + 512, None], b[None, :]).view(np.uint64)) <= radius
                    r, c = np.nonzero(near)
                    if len(r):
                        fa, fb = _forest(a[i + r], b[c])
                        out_a += fa
                        out_b += fb
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Those of the links that don't close a circle."""
    root: dict[int, int] = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the smallest doc_id reachable; null ids are never it unless a component has no other.
    Equal texts, and repeated rows, share a fingerprint and so a component. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    return marked.join(_named(marked, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """fp, root, component_id of every fingerprint in ``marked`` (fp, doc_id)."""
    roots = components(links(marked.select("fp").distinct(), radius))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = materialize(least.join(roots, least.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


SIMILAR = 0.8
STAGE_SHINGLE = 5
#: 64-bit words of a fingerprint of ``keep_one``. At a similarity of 0.8 about 29 of 192 bits differ (36 where texts have four or five
#: shingles), of unrelated texts 96: within ``WIDE`` bits lie all but one in 10,000 of the former and one in 100 million of the latter.
WORDS, WIDE = 3, 56
#: Shingles, and rows, of a tile of ``keep_one`` at most, so that two tiles fit in a task with their shingles.
TILE_SHINGLES, TILE_ROWS = 3_000_000, 16_384
_SALT = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(text: str, width: int = STAGE_SHINGLE) -> np.ndarray:
    """Hashes of the text's runs of ``width`` words, or of all its words if there are fewer: sorted, each once."""
    words = text.encode("utf-8", "ignore").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[i:j], 42) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """``WORDS`` signed words: a bit is 1 if set in over half of the set's hashes."""
    out = []
    for salt in _SALT[:WORDS]:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), 65_536):
            part = found[at : at + 65_536]
            bits = (mix(part ^ np.uint64(salt)) if salt else part).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0]))
    return out


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (fingerprints, one word a column) lie within ``WIDE`` bits."""
    differ = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        differ += np.bitwise_count(np.bitwise_xor(a[:, w, None], b[None, :, w]))
    return differ <= WIDE


def _tiles(nodes: DataFrame, similar: float) -> DataFrame:
    """``nodes``: node, n, fp. Tiles of nodes of about one number of shingles and one bit count: cell, block, nodes, fps.

    Cells are steps of the bit count, as wide as the radius, within halves of the ratio that similar sets' sizes can have.
    """
    ones = sum((F.bit_count(F.element_at("fp", w + 1)) for w in range(WORDS)), F.lit(0))
    size = F.floor(F.log(F.col("n").cast("double")) * (2 / np.log(1 / similar))).cast("int")
    placed = nodes.select("node", "n", "fp", (size * 8 + F.floor(ones / (WIDE + 1))).cast("int").alias("cell"))
    blocks_of = placed.groupBy("cell").agg(F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_ROWS)).cast("int").alias("blocks"))  # as many rows as cells: a thousand at most
    return placed.join(F.broadcast(blocks_of), "cell").groupBy("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(F.struct("node", "n", "fp")).alias("members"))


def _rows(members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = members.values.flatten()
    return flat[0].to_numpy(), flat[1].to_numpy(), flat[2].flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def _partners(tiles: DataFrame, similar: float) -> DataFrame:
    """pair (of tiles), node: the nodes of either tile that have a partner in the other by fingerprint and size."""
    steps = [s * 8 + p for s in range(4) for p in (-1, 0, 1) if s * 8 + p >= 0]  # sizes apart by two halves at most, or three by rounding
    far = F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps]))
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("members").alias("a"), far.alias("cell"))
    met = left.join(tiles.select("cell", "block", F.col("members").alias("b")), "cell")
    met = met.where((F.col("cell") > F.col("cell_a")) | (F.col("block_a") <= F.col("block"))).select(F.xxhash64("cell_a", "block_a", "cell", "block").alias("pair"), "a", "b")

    def compare(batches):
        for batch in batches:
            for pair, x, y in zip(*batch.columns, strict=True):
                (a, n, f), (b, m, g) = _rows(x), _rows(y)
                used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
                for i in range(0, len(a), 64):
                    near = _close(f[i : i + 64], g) & (a[i : i + 64, None] != b[None, :])
                    r, c = np.nonzero(near)
                    ratio = n[i + r] / m[c]
                    ok = (ratio >= similar) & (ratio * similar <= 1)
                    used_a[i + r[ok]] = used_b[c[ok]] = True
                found = np.unique(np.concatenate([a[used_a], b[used_b]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pair.as_py())), pa.array(found)], ["pair", "node"])

    return met.mapInArrow(compare, "pair long, node long")


def _similar_forest(similar: float):
    """The nodes of one pair of tiles, with fingerprints and shingles, to a spanning forest of those whose sets are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        f = np.array(table.column("fp").to_pylist(), np.int64).view(np.uint64).reshape(-1, WORDS)
        sets = [s.values.to_numpy() for s in table.column("set")]
        root = list(range(len(node)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = ([], [])
        for i in range(len(node)):
            for j in (i + 1 + np.flatnonzero(_close(f[i : i + 1], f[i + 1 :])[0] & (n[i + 1 :] * similar <= n[i]) & (n[i] * similar <= n[i + 1 :]))).tolist():
                p, q = top(i), top(j)
                if p != q:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similar * (n[i] + n[j] - both):
                        root[q] = p
                        out[0].append(int(node[i])), out[1].append(int(node[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def keep_one(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: that of the smallest id (null ids last; of rows that share it, any one).

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of ``similar`` or more. Equal sets are one node. Tiles of
    fingerprints are compared exactly; of two tiles only the nodes with a partner by fingerprint meet again with their shingles, and
    links are decided by these. Texts without words, null ones included, are one group. Other columns, whatever their names, stay as they are.
    """
    row = docs.select(whole_row(docs).alias("row"), column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))

    def sketch(batches):
        for batch in batches:
            sets = [shingles(t.as_py() or "") for t in batch.column(2)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            columns = [pa.array(keys, pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "doc_id", "key", "n", "fp"])

    marked = row.mapInArrow(sketch, StructType(row.schema.fields[:2]).add("key", "string").add("n", "long").add("fp", ArrayType(LongType())))
    marked = materialize(marked.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    nodes = materialize(marked.groupBy("key").agg(F.min(F.struct("uid", "n", "fp")).alias("at")).select("key", F.col("at.uid").alias("node"), "at.n", "at.fp"), "nodes")
    tiles = materialize(_tiles(nodes.where("n > 0"), similar), "tiles")
    partners = materialize(_partners(tiles, similar), "partners")
    met = partners.select("node").distinct()

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shingles(t.as_py() or "").view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))], ["node", "n", "fp", "set"])

    texts = marked.join(met, F.col("uid") == F.col("node"), "left_semi").select(F.col("uid").alias("node"), "n", "fp", F.col("row").getField(text_col).alias("text"))
    sets = materialize(texts.mapInArrow(spread, "node long, n long, fp array<long>, set array<long>"), "sets")
    linked = partners.join(sets, "node").groupBy("pair").applyInArrow(_similar_forest(similar), "a long, b long")
    roots = components(linked)
    named = materialize(nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "roots")
    first = marked.select("key", "uid", "doc_id").join(named, "key").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    kept = marked.join(first.select("first.uid"), "uid", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
