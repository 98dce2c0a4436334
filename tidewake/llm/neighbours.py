"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample of distinct vectors and sent to all tasks; every vector is then
routed to its leaf of each tree, so an index row is the vector with one leaf number a tree. A query walks all trees with one
priority queue, always on to the branch for which the squared distances to the dividing planes add up to least. How many leaves walks must
see is measured against brute force: the exact neighbours, among all rows, of up to ``TRIED`` of the queries are looked up in
the forest, and ``GOAL`` of them are to be reached.

Vectors are dealt by tree and leaf, queries to the leaves that their walks took and to no others; rows of leaves that no walk took go nowhere.
Adjoining leaves of a tree are bundled up to ``BLOCK`` rows, and a leaf beyond that is cut into chunks by hash, as are
a bundle's queries beyond ``ASKED``; so no task grows with the table, and a vector is sent once a tree, whatever the number of queries (more often only
where a bundle has more than ``ASKED`` of them). In a bundle, each leaf's rows meet its queries in one matrix product; what may
be among a query's nearest there has its exact Euclidean distance computed. A vector found in several trees counts once.

Equal vectors are one candidate with its smallest ids, so copies neither fill leaves nor hide others.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.shared import column, materialize, smallest

K = 10
TREES = 8
LEAF = 64
SAMPLE = 16_384  #: distinct vectors that the forest is fitted on, those of the smallest hashes
GOAL = 0.95  #: share of the exact neighbours that walks are to reach
TRIED = 100  #: queries that this is measured on
BLOCK = 16_384  #: vectors of a bundle of leaves, about
ASKED = 8192  #: queries that meet a bundle in one task, about


@dataclass
class Tree:
    normal: np.ndarray  # a row for each inner node
    offset: np.ndarray
    child: np.ndarray  # two for each inner node: an inner node, or -1 - leaf
    size: np.ndarray  # sample vectors in each leaf


def fit_tree(x: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    r = np.random.default_rng(seed)
    normal, offset, child, size = [], [], [], []
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, above = todo.pop()
        if len(rows) <= leaf:
            at = -1 - len(size)
            size.append(len(rows))
        else:
            a, b = x[r.choice(rows, 2, replace=False)]
            way = a - b
            along = x[rows] @ way
            cut = float(way @ (a + b)) / 2
            side = along > cut
            if min(side.sum(), (~side).sum()) < len(rows) // 10:
                cut = float(np.median(along))
                side = along > cut
            if side.all() or not side.any():  # hardly different vectors: any cut through their order will do
                way = r.standard_normal(x.shape[1])
                along = x[rows] @ way
                cut = float(np.median(along))
                side = along > cut
            at = len(offset)
            scale = np.linalg.norm(way) or 1.0
            normal.append(way / scale), offset.append(cut / scale), child.append([0, 0])
            if side.all() or not side.any():
                side = np.arange(len(rows)) % 2 == 1
            todo += [(rows[~side], (at, 0)), (rows[side], (at, 1))]
        if above:
            child[above[0]][above[1]] = at
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(offset), np.array(child, int).reshape(-1, 2), np.array(size))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int) if len(tree.offset) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        at[inner] = tree.child[node, ((x[inner] * tree.normal[node]).sum(1) > tree.offset[node]).astype(int)]
    return -1 - at


class Walker:
    """A forest's trees laid out as one, with their inner nodes and leaves numbered through."""

    def __init__(self, forest: list[Tree]):
        inner = np.cumsum([0, *(len(t.offset) for t in forest)]).tolist()
        self.base = np.cumsum([0, *(len(t.size) for t in forest)])
        self.normal = np.concatenate([t.normal for t in forest])
        self.offset = np.concatenate([t.offset for t in forest])
        self.child = np.concatenate([np.where(t.child >= 0, t.child + i, t.child - b) for t, i, b in zip(forest, inner, self.base.tolist(), strict=False)]).tolist()
        self.size = np.concatenate([t.size for t in forest]).tolist()
        self.roots = [i if len(t.offset) else -1 - b for t, i, b in zip(forest, inner, self.base.tolist(), strict=False)]

    def walks(self, m: np.ndarray, search: int):
        """The leaves of each row's walk, the most promising first: as many as hold ``search`` sample vectors."""
        child, size = self.child, self.size
        for at in range(0, len(m), 256):
            for sides in (m[at : at + 256] @ self.normal.T - self.offset).tolist():
                heap = [(0.0, root) for root in self.roots]
                seen, out = 0, []
                while heap and seen < search:
                    far, node = heapq.heappop(heap)
                    while node >= 0:
                        d = sides[node]
                        low, high = child[node]
                        if d > 0:
                            low, high = high, low
                        heapq.heappush(heap, (far + d * d, high))
                        node = low
                    out.append(-1 - node)
                    seen += size[-1 - node]
                yield out


def search_for(forest: list[Tree], asked: list[np.ndarray], found: list[np.ndarray], width: int, goal: float = GOAL) -> int:
    """Sample vectors that walks from ``asked`` must see to reach ``goal`` of ``found``, the nearest rows of each."""
    if not asked:
        return 1
    walker, reach = Walker(forest), []
    size = np.array(walker.size)
    orders = walker.walks(np.stack([_padded(v, width) for v in asked]), np.iinfo(np.int64).max)
    for order, near in zip(orders, found, strict=True):
        before = np.zeros(len(size), int)
        before[order] = np.cumsum(size[order]) - size[order]
        x = np.stack([_padded(v, width) for v in near])
        reach += np.min([before[leaf_of(tree, x) + b] for tree, b in zip(forest, walker.base, strict=False)], axis=0).tolist()
    return int(np.sort(reach)[int(np.ceil(goal * len(reach))) - 1]) + 1


def bundles(rows: np.ndarray, asked: np.ndarray, base: np.ndarray, block: int, asked_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bundle of each leaf, and into how many chunks each bundle's rows and queries are cut.

    ``rows`` and ``asked`` are counts by leaf, ``base`` each tree's first leaf. A bundle is adjoining leaves of one tree.
    """
    of, held, met = np.zeros(len(rows), int), [], []
    firsts = set(base.tolist())
    for leaf, (r, a) in enumerate(zip(rows.tolist(), asked.tolist(), strict=True)):
        if leaf in firsts or held[-1] + r > block or met[-1] + a > 4 * asked_block:
            held.append(0), met.append(0)
        of[leaf] = len(held) - 1
        held[-1] += r
        met[-1] += a
    return of, np.maximum(1, -(-np.array(held) // block)), np.maximum(1, -(-np.array(met) // (4 * asked_block)))


def _padded(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(np.asarray(v, float)[:width], (0, max(0, width - len(v))))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros and longer ones cut, for routing only."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        v = v.values.to_numpy()[:width]
        out[k, : len(v)] = v
    return out


def _packed(v: np.ndarray) -> bytes:
    """A vector's components, as singles where that loses nothing."""
    single = v.astype("<f4")
    return (single if (single == v).all() else v.astype("<f8")).tobytes()


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to the places and the matrix of a table's packed vectors of that length."""
    n, packed = table.column("n").to_numpy(), table.column("v").to_pylist()
    out = {}
    for length in np.unique(n).tolist():
        at = np.flatnonzero(n == length)
        out[length] = at, np.stack([np.frombuffer(packed[i], "<f4" if len(packed[i]) == 4 * length else "<f8").astype(float) for i in at.tolist()])
    return out


def _nearest_in_leaves(q: np.ndarray, x: np.ndarray, walked: tuple[np.ndarray, np.ndarray], leaf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``x``, distance): all that may be among the ``n`` nearest of each, out of the leaves walked.

    ``walked`` are pairs (row of ``q``, leaf), one query's together and its most promising leaf first, as that
    bounds what is wanted of the others; ``leaf`` is that of each row of ``x``. Whatever ties with the nth within rounding stays.
    """
    by_leaf = np.argsort(leaf, kind="stable")
    ordered = leaf[by_leaf]
    with np.errstate(over="ignore"):
        qq, half = (q * q).sum(1), (x * x).sum(1) / 2
    finite = max(qq.max(initial=0), half.max(initial=0)) < 1e300  # else squares overflow, and exact distances decide alone
    slack = 1e-9 * (qq + 2 * half.max(initial=0))
    least = np.full(len(q), -np.inf)  # of q.x - |x|^2 / 2, which falls as the distance grows
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    opening = np.diff(walked[0], prepend=-1) != 0
    for turn in (opening, ~opening):
        order = np.argsort(walked[1][turn], kind="stable")
        who, to = walked[0][turn][order], walked[1][turn][order]
        for this in np.intersect1d(to, ordered).tolist():
            some = who[slice(*np.searchsorted(to, [this, this + 1]))]
            rows = by_leaf[slice(*np.searchsorted(ordered, [this, this + 1]))]
            m, size = x[rows].T, half[rows]
            for at in range(0, len(some), 512):
                ask = some[at : at + 512]
                if not finite:
                    found.append((np.repeat(ask, len(rows)), np.tile(rows, len(ask)), np.full(len(ask) * len(rows), np.inf)))
                    continue
                near = q[ask] @ m
                near -= size
                wanted = near >= least[ask][:, None]
                many = np.flatnonzero(np.count_nonzero(wanted, axis=1) > n)
                if len(many):
                    nth = np.partition(near[many], len(rows) - n, axis=1)[:, len(rows) - n]
                    least[ask[many]] = np.maximum(least[ask[many]], nth - slack[ask[many]])
                    wanted[many] = near[many] >= least[ask[many]][:, None]
                i, j = np.divmod(np.flatnonzero(wanted), len(rows))
                found.append((ask[i], rows[j], near.ravel()[i * len(rows) + j]))
    a, b, near = (np.concatenate(c) for c in zip(*found, strict=True))
    wanted = near >= least[a]
    a, b = a[wanted], b[wanted]
    with np.errstate(over="ignore"):
        d = [np.sqrt(((x[b[k : k + BLOCK]] - q[a[k : k + BLOCK]]) ** 2).sum(1)) for k in range(0, len(a), BLOCK)]
    return a, b, np.concatenate(d or [np.zeros(0)])


def _exact(reps: DataFrame, asked: list[np.ndarray], k: int) -> DataFrame:
    """at (a place in ``asked``), score, v: the k nearest other vectors of each, by distance to every row."""

    def run(batches):
        for batch in batches:
            vs = [np.asarray(v.values.to_numpy(), float) for v in batch.column(1)]
            out = [[], [], [], []]
            for n in {len(v) for v in vs}:
                rows = [i for i, v in enumerate(vs) if len(v) == n]
                x = np.stack([vs[i] for i in rows])
                for at, q in enumerate(asked):
                    if len(q) == n:
                        d = np.sqrt(((x - q) ** 2).sum(1))
                        for i in [i for i in np.argsort(d, kind="stable")[: k + 1].tolist() if d[i] > 0][:k]:
                            for values, value in zip(out, (at, float(d[i]), batch.column(0)[rows[i]].as_py(), vs[rows[i]]), strict=True):
                                values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.float64(), pa.string(), pa.list_(pa.float64())), strict=True)], ["at", "score", "rid", "v"])

    near = reps.select("rid", "v").mapInArrow(run, "at int, score double, rid string, v array<double>")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("score", "rid"))).where(F.col("nth") <= k)


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK, asked_block: int = ASKED, goal: float = GOAL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, ties to the smaller id.

    ``queries`` defaults to the rows of ``vectors`` whose id is divisible by 100. Rows without id, without vector or
    whose vector is zero or has a null or non-finite component take no part; vectors of another length
    than the query's are no candidates. Rows that agree in id and vector count once; a query never finds its own id.
    """

    def clean(df):
        vector, row_id = column(vector_col), column(id_col)
        ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
        doubles = F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))
        rid = F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit("second"), "v")))
        return df.where(row_id.isNotNull() & ok).select(row_id.cast("long").alias("vec_id"), doubles.alias("v")).select("vec_id", "v", rid.alias("rid")).distinct()

    members = materialize(clean(vectors).withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy("vec_id"))).where(F.col("nth") <= k + 1), "members")
    reps = members.where("nth = 1").select("rid", F.col("vec_id").alias("first_id"), "v")
    asked = materialize(clean(vectors.where(column(id_col) % 100 == 0) if queries is None else queries), "queries")
    fields = "query_id long, rank int, vec_id long, score double"
    points = [np.array(r.v) for r in smallest(reps, sample, F.col("rid")).select("v").toLocalIterator()]
    if not points:
        return vectors.sparkSession.createDataFrame([], fields)
    width = max(map(len, points))
    x = np.stack([_padded(p, width) for p in points])
    forest = [fit_tree(x, seed) for seed in range(TREES)]
    walker = Walker(forest)
    base, n_leaves = walker.base[:-1], int(walker.base[-1])
    distinct = asked.select("rid", "v").distinct()
    tried = [np.array(r.v) for r in smallest(distinct, TRIED, F.col("rid")).select("v").collect()]
    true: list[list] = [[] for _ in tried]
    for r in _exact(reps, tried, k).select("at", "v").collect():  # k rows of each
        true[r["at"]].append(np.array(r["v"]))
    pairs = [(q, t) for q, t in zip(tried, true, strict=True) if t]
    search = search_for(forest, [q for q, _ in pairs], [t for _, t in pairs], width, goal)

    def leaves(find, *names):
        """Rows with their packed vectors, ``find``'s leaves and a number to be dealt by."""

        def run(batches):
            for batch in batches:
                v = batch.column(batch.schema.get_field_index("v"))
                packed = [np.asarray(r.values.to_numpy(), float) for r in v]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in (*names, "deal")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(list(map(len, packed)), pa.int32()), pa.array(list(map(_packed, packed)), pa.binary()), pa.array(find(_matrix(v, width)), pa.list_(pa.int32()))],
                    [*names, "deal", "n", "v", "leaves"],
                )

        return run

    deal = F.pmod(F.xxhash64("rid", F.lit("deal")), F.lit(1 << 31)).alias("deal")
    routed = leaves(lambda m: np.stack([leaf_of(tree, m) + b for tree, b in zip(forest, base, strict=True)], axis=1).tolist(), "rid", "first_id")
    index = materialize(reps.select("*", deal).mapInArrow(routed, "rid string, first_id long, deal long, n int, v binary, leaves array<int>"), "index")
    walked = leaves(lambda m: list(walker.walks(m, search)), "rid")
    walks = materialize(distinct.select("*", deal).mapInArrow(walked, "rid string, deal long, n int, v binary, leaves array<int>"), "walks")

    def by_leaf(df):
        out = np.zeros(n_leaves, int)
        for leaf, count in df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # the forest's leaves at most
            out[leaf] = count
        return out

    visits = by_leaf(walks)
    bundle, chunks, parts = bundles(by_leaf(index), visits, base, block, asked_block)

    def dealt(batch, rows, of, copies, mine, n_chunks, copied, **more):
        """``rows`` of a batch with the keys of all groups that they go to, ``copies`` each."""
        each = np.repeat(np.arange(len(rows)), copies)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
        own = (batch.column("deal").to_numpy()[rows] % n_chunks)[each]
        keys = {"bundle": of[each], mine: own, copied: nth}
        columns = {c: pa.array(keys[c], pa.int32()) for c in ("bundle", "chunk", "part")}
        columns |= {c: batch.column(c).take(pa.array(rows[each])) for c in batch.schema.names if c not in ("deal", "leaves")}
        return pa.RecordBatch.from_pydict(columns | {c: values.take(pa.array(each)) for c, values in more.items()})

    def deal_rows(batches):
        for batch in batches:
            own = np.asarray(batch.column("leaves").flatten()).reshape(batch.num_rows, -1)
            for leaf in own.T:
                rows = np.flatnonzero(visits[leaf] > 0)
                of = bundle[leaf[rows]]
                yield dealt(batch, rows, of, parts[of], "chunk", chunks[of], "part", leaf=pa.array(leaf[rows], pa.int32()))

    def deal_queries(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets, rows, of = [], [], []
                for i, walk in enumerate(batch.column("leaves").to_pylist()):
                    walk = np.array(walk, int)
                    walk = walk[np.argsort(bundle[walk], kind="stable")]
                    new = np.flatnonzero(np.diff(bundle[walk], prepend=-1))
                    sets += np.split(walk, new[1:])
                    rows += [i] * len(new)
                    of += bundle[walk[new]].tolist()
                of = np.array(of, int)
                yield dealt(batch, np.array(rows, int), of, chunks[of], "part", parts[of], "chunk", walk=pa.array(sets, pa.list_(pa.int32())))

    keys = ["bundle", "chunk", "part"]
    fields_of = "bundle int, chunk int, part int, rid string"
    right = index.mapInArrow(deal_rows, f"{fields_of}, first_id long, n int, v binary, leaf int")
    left = walks.mapInArrow(deal_queries, f"{fields_of}, n int, v binary, walk array<int>")

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            of_length, leaf, firsts = _by_length(b), b.column("leaf").to_numpy(), b.column("first_id").to_numpy()
            walk = a.column("walk").combine_chunks()
            for n, (at, q) in _by_length(a).items():
                if n in of_length:
                    to, x = of_length[n]
                    own = walk.take(pa.array(at))
                    pairs = np.repeat(np.arange(len(at)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
                    i, j, d = _nearest_in_leaves(q, x, pairs, leaf[to], k + 1)
                    order = np.lexsort((firsts[to[j]], d, i))
                    i, j, d = i[order], j[order], d[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) <= k
                    out.append((at[i[kept]], to[j[kept]], d[kept]))
        i, j, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"asked": a.column("rid").take(pa.array(i)), "rid": b.column("rid").take(pa.array(j)), "first_id": b.column("first_id").take(pa.array(j)), "score": pa.array(d)})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "asked string, rid string, first_id long, score double")
    found = met.repartition("asked").dropDuplicates(["asked", "rid"])
    best = lambda df, by, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    near = best(found, "asked", "score", "first_id").where(F.col("rank") <= k + 1).select("asked", "rid", "score")
    spread = best(near.join(members.select("rid", "vec_id"), "rid"), "asked", "score", "vec_id").where(F.col("rank") <= k + 1).select(F.col("asked").alias("rid"), "vec_id", "score")
    answers = asked.select(F.col("vec_id").alias("query_id"), "rid").join(materialize(spread, "nearest"), "rid").where("vec_id <> query_id")
    return best(answers, "query_id", "score", "vec_id").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
