"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Index.  Every node of the tree has up to ``FAN`` split points; a vector belongs to the nearest one
(a multiway hyperplane cut, ties to the lower index) and goes down until a leaf.  The split points
are chosen on at most ``SAMPLE`` rows of least hash, far apart from each other; all rows are then
indexed.  For each split point i of a node and each sibling subtree j the tree stores the range of
the distances from point i to all rows of subtree j, and for each subtree the range of the squared
lengths; both are minima and maxima over the whole table, gathered by Spark as partial aggregates.

Search.  A query asks for the rows with the largest inner products inside a window [lo, hi].  With
the lengths of a subtree's rows a window of products is an annulus of distances around the query.
A subtree is left out if, for some split point i of its node, the annulus moved by the distance to i
does not meet the stored range.  What is left is compared exactly: queries travel in groups to the leaves they
could not rule out, where a group meets blocks of rows in one matrix product.

First the queries look at their ``NEAR`` nearest leaves only; the k-th best product found there (and its id)
raises the window's lower end.  Then all leaves are searched with the raised end, so few rows that
do not belong to the result leave a task.  Products are integers; all results are exact.

Sizes.  The tree is bounded by the sample (at most ``SAMPLE`` / ``LEAF`` * ``FAN`` leaves).  A leaf is cut
into parts of about ``PART`` rows by content hash, so a leaf that holds a third of all rows is many
join keys; queries are sent to every part.  Nothing else grows in one task or on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm import vectors as V
from panelspark.llm.scratch import ready, stored

SCALE = 256
SAMPLE = 4096          # rows that the split points are chosen on
FAN = 16               # split points of a node
LEAF = 32              # a node of fewer sample rows is a leaf
PART = 4096            # rows of a leaf that make one join key
BLOCK = 1024           # rows compared in one matrix product
GROUP = 128            # queries that travel together
NEAR = 12              # leaves that give a query its first bound
_LOW, _HIGH = -(1 << 61), 1 << 61
_ROW = "vec_id long, label long, key long, q binary"


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d, 0.0)


class Tree:
    """Split points with their children, and the ranges once they are known."""

    def __init__(self, dim: int):
        self.dim, self.points, self.child, self.ranges = dim, [], [], {}
        self.path: list[list[tuple[int, int]]] = []         # of each leaf: (node, child) from the root

    @property
    def leaves(self) -> int:
        return len(self.path)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            j = _squared(x[rows], self.points[node]).argmin(1)
            for c in np.unique(j):
                to, part = self.child[node][c], rows[j == c]
                if to < 0:
                    out[part] = -to - 1
                else:
                    todo.append((to, part))
        return out

    def centres(self) -> np.ndarray:
        """The split point of each leaf."""
        if not self.points:
            return np.zeros((1, self.dim))
        return np.array([self.points[n][c] for n, c in (p[-1] for p in self.path)])

    def alive(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(queries x leaves) False where no row of the leaf can have a product in [lo, hi].

        Distances carry a relative allowance for rounding, so nothing is ruled out by it."""
        out = np.ones((len(q), max(self.leaves, 1)), bool)
        length = (q * q).sum(1)[:, None]
        below = {0: np.ones(len(q), bool)}
        for node, points in enumerate(self.points):
            low, high, short, long = self.ranges[node]
            t = np.sqrt(_squared(q, points))
            far = np.sqrt(np.maximum(length + long[None, :] - 2.0 * lo[:, None], 0.0))       # queries x children
            near = np.sqrt(np.maximum(length + short[None, :] - 2.0 * hi[:, None], 0.0))
            slack = 1e-6 * (1.0 + t.max(1, keepdims=True) + np.sqrt(np.maximum(long, 0.0)).max())
            ok = (length + long[None, :] - 2.0 * lo[:, None] >= -slack * slack - 1e-6 * (length + np.abs(long[None, :]))) & (low[0] <= high[0])[None, :]
            for i in range(len(points)):
                ti = t[:, i:i + 1]
                ok &= (ti - far <= high[i] + slack) & (ti + far >= low[i] - slack) & (ti + high[i] >= near - slack)
            for c, to in enumerate(self.child[node]):
                state = below[node] & ok[:, c]
                if to < 0:
                    out[:, -to - 1] = state
                else:
                    below[to] = state
        return out


def fit(sample: np.ndarray, dim: int, fan: int = FAN, leaf: int = LEAF) -> Tree:
    """Split points chosen on the sample: of the first 3 * fan rows of a node, the farthest from those taken."""
    tree = Tree(dim)
    if not len(sample):
        tree.path = [[]]
        return tree
    todo = [(sample, [])]
    slots: list[tuple[int, int]] = []                        # where the node's number goes
    while todo:
        x, path = todo.pop(0)
        some = x[:3 * fan]
        taken, gap = [0], _squared(some, some[:1])[:, 0]
        while len(taken) < min(fan, len(some)) and gap.max() > 0:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, _squared(some, some[taken[-1]:taken[-1] + 1])[:, 0])
        node, points = len(tree.points), some[taken]
        if path:
            at, c = path[-1]
            tree.child[at][c] = node
        tree.points.append(points)
        tree.child.append([0] * len(points))
        j = _squared(x, points).argmin(1)
        for c in range(len(points)):
            part = x[j == c]
            if len(part) > leaf and len(points) > 1 and len(path) < 8:
                todo.append((part, path + [(node, c)]))
            else:
                tree.path.append(path + [(node, c)])
                tree.child[node][c] = -len(tree.path)
    return tree


def _quantise(dim: int, bound: int):
    def run(batches):
        for b in batches:
            q = V.quantised(b.column(3), dim, SCALE, bound)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), V.packed(q)], ["vec_id", "label", "key", "q"])
    return run


def _to_leaves(tree: Tree):
    def run(batches):
        for b in batches:
            leaf = tree.route(V.unpacked(b.column(3), tree.dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.columns], ["leaf", "vec_id", "label", "key", "q"])
    return run


def _ranges(tree: Tree):
    """Rows (node, i, j, lo, hi): distances from point i to subtree j; i = -1: squared lengths."""
    def run(batches):
        best: dict = {}
        for b in batches:
            x = V.unpacked(b.column(4), tree.dim).astype(np.float64)
            leaf = b.column(0).to_numpy()
            for one in np.unique(leaf):
                rows = x[leaf == one]
                length = (rows * rows).sum(1)
                for node, c in tree.path[one]:
                    d = np.sqrt(_squared(rows, tree.points[node]))
                    lo, hi = np.append(d.min(0), length.min()), np.append(d.max(0), length.max())
                    old = best.get((node, c))
                    best[(node, c)] = (lo, hi) if old is None else (np.minimum(old[0], lo), np.maximum(old[1], hi))
        rows = [(node, i if i < len(lo) - 1 else -1, c, float(lo[i]), float(hi[i])) for (node, c), (lo, hi) in best.items() for i in range(len(lo))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 3 + [pa.float64()] * 2)],
                                         ["node", "i", "j", "lo", "hi"])
    return run


def _blocks(batches):
    """Consecutive rows of one (leaf, part) as one block."""
    for b in batches:
        leaf, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])) + 1
        ends = np.append(cut, len(leaf))
        out = []
        for s, e in zip(np.append(0, cut), ends):
            for a in range(s, e, BLOCK):
                z = min(a + BLOCK, e)
                out.append((leaf[a], part[a], *(b.column(k).slice(a, z - a).to_numpy().tobytes() for k in (2, 3, 4)),
                            b"".join(b.column(5).slice(a, z - a).to_pylist())))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["leaf", "part", "ids", "labels", "keys", "q"])


class Index:
    """All rows in leaves (``rows``) and in blocks (``blocks``), the tree, and the parts of each leaf."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF, part: int = PART):
        """``rows``: vec_id long, label long, embedding array<double>, none of them NULL; equal rows count once."""
        dim = self.dim = V.dimension(rows)
        bound = min(math.isqrt((1 << 55) // dim), (1 << 31) - 1)          # products stay in a long
        key = F.xxhash64("vec_id", "label", V.VECTOR).alias("key")
        base = (rows.select("vec_id", "label", key, V.VECTOR).dropDuplicates(["vec_id", "label", "key"])
                .mapInArrow(_quantise(dim, bound), _ROW))
        base = stored(base, "vectors")
        some = base.select("q", F.xxhash64("key", F.lit(7)).alias("h")).orderBy("h", "q").limit(sample).collect()
        x = np.array([np.frombuffer(r.q, np.int32) for r in some], np.float64).reshape(len(some), dim)
        self.tree = tree = fit(x, dim, fan, leaf)
        self.rows = stored(base.mapInArrow(_to_leaves(tree), f"leaf int, {_ROW}"), "leaf-rows")
        found = (self.rows.mapInArrow(_ranges(tree), "node int, i int, j int, lo double, hi double")
                 .groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
        for node, points in enumerate(tree.points):
            k = len(points)
            tree.ranges[node] = [np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf)]
        for r in found:
            low, high, short, long = tree.ranges[r.node]
            if r.i < 0:
                short[r.j], long[r.j] = r.lo, r.hi
            else:
                low[r.i, r.j], high[r.i, r.j] = r.lo, r.hi
        sizes = {r.leaf: r.n for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        self.parts = np.array([-(-sizes.get(i, 0) // part) for i in range(max(tree.leaves, 1))])
        of_leaf = F.array(*[F.lit(int(max(p, 1))) for p in self.parts])
        placed = self.rows.withColumn("part", F.pmod("key", F.element_at(of_leaf, F.col("leaf") + 1)).cast("int"))
        self.blocks = stored(placed.select("leaf", "part", "vec_id", "label", "key", "q").repartition("leaf", "part")
                             .sortWithinPartitions("leaf", "part")
                             .mapInArrow(_blocks, "leaf int, part int, ids binary, labels binary, keys binary, q binary"), "blocks")


def _grouped(queries: DataFrame) -> DataFrame:
    """Queries with a group number: about GROUP of them in leaf order, by counts per leaf."""
    counts = queries.groupBy("leaf").agg(F.count("*").alias("n")).orderBy("leaf").collect()
    before, rows = 0, []
    for r in counts:
        rows.append((r.leaf, before, r.n))
        before += r.n
    table = F.broadcast(queries.sparkSession.createDataFrame(rows, "leaf int, before long, n long"))
    place = F.col("before") + F.pmod(F.xxhash64("key"), F.col("n"))
    return queries.join(table, "leaf").withColumn("grp", (place / GROUP).cast("long")).drop("before", "n")


_SENT = "leaf int, part int, ids binary, labels binary, keys binary, q binary, windows binary"


def _send(tree: Tree, parts: np.ndarray, near: int | None):
    """One row for each leaf part and group of queries that it may answer.

    ``near``: only the so many nearest leaves of each query that hold rows."""
    centres = tree.centres()

    def run(batches):
        for b in batches:
            group = b.column(0).to_numpy()
            ids, labels, keys = (b.column(k).to_numpy() for k in (1, 2, 3))
            q, wins = V.unpacked(b.column(4), tree.dim), b.column(5)
            count = wins.value_lengths().to_numpy()
            flat = np.stack([wins.flatten().field(k).to_numpy() for k in range(5)], 1).astype(np.int64) if len(wins.flatten()) else np.zeros((0, 5), np.int64)
            owner = np.repeat(np.arange(len(ids)), count)
            out = []
            for g in np.unique(group):
                at = np.flatnonzero((group == g) & (count > 0))
                if not len(at):
                    continue
                x = q[at].astype(np.float64)
                local = np.full(len(ids), -1)
                local[at] = np.arange(len(at))
                mine = flat[local[owner] >= 0]
                who = local[owner[local[owner] >= 0]]
                lo, hi = np.full(len(at), np.inf), np.full(len(at), -np.inf)
                np.minimum.at(lo, who, mine[:, 2].astype(np.float64))
                np.maximum.at(hi, who, mine[:, 3].astype(np.float64))
                live = tree.alive(x, lo, hi) & (parts > 0)[None, :]
                if near is not None and live.shape[1] > near:
                    d = np.where(live, _squared(x, centres), np.inf)
                    live &= d <= np.partition(d, near - 1, axis=1)[:, near - 1:near]
                for leaf in np.flatnonzero(live.any(0)):
                    on = np.flatnonzero(live[:, leaf])
                    here = np.full(len(at), -1)
                    here[on] = np.arange(len(on))
                    w = here[who] >= 0
                    sent = np.concatenate([here[who[w]][:, None], mine[w]], 1).astype(np.int64).tobytes()
                    rows = at[on]
                    blob = (ids[rows].tobytes(), labels[rows].tobytes(), keys[rows].tobytes(), np.ascontiguousarray(q[rows]).tobytes(), sent)
                    out += [(int(leaf), p, *blob) for p in range(parts[leaf])]
                    if len(out) >= 64:
                        yield _rows(out, 7)
                        out = []
            if out:
                yield _rows(out, 7)
    return run


def _rows(out: list, n: int) -> pa.RecordBatch:
    names = ["leaf", "part", "ids", "labels", "keys", "q", "windows"][:n]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.binary()) for k in range(n)], names)


_FOUND = "anchor long, anchor_key long, pid long, pscore long, id long, score long"


def _compare(dim: int, same: bool, k: int):
    """Exact products of a group with a block: per window the k best rows of this block."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, keys, q, windows, bids, blabels, bkeys, bq = (c[i].as_py() for c in b.columns)
                ids, labels, keys, bids, blabels, bkeys = (np.frombuffer(v, np.int64) for v in (ids, labels, keys, bids, blabels, bkeys))
                a, d = np.frombuffer(q, np.int32).reshape(-1, dim), np.frombuffer(bq, np.int32).reshape(-1, dim)
                w = np.frombuffer(windows, np.int64).reshape(-1, 6)
                kind = np.float64 if np.abs(a).max(initial=0) * float(np.abs(d).max(initial=0)) * dim < 2 ** 52 else np.int64
                product = (a.astype(kind) @ d.T.astype(kind)).astype(np.int64)
                free = labels[:, None] == blabels[None, :]
                free = free & (keys[:, None] != bkeys[None, :]) if same else ~free
                for s in range(0, len(w), 256):
                    part = w[s:s + 256]
                    score, who = product[part[:, 0]], part[:, 0]
                    lo, hi, cut = part[:, 3:4], part[:, 4:5], part[:, 5:6]
                    hit = free[who] & (score <= hi) & ((score > lo) | ((score == lo) & (bids[None, :] <= cut)))
                    if hit.shape[1] > k:
                        best = np.where(hit, score, np.iinfo(np.int64).min)
                        hit &= best >= np.partition(best, -k, axis=1)[:, -k][:, None]
                    row, col = np.nonzero(hit)
                    if not len(row):
                        continue
                    value = score[row, col]
                    order = np.lexsort((bids[col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
                    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                    row, col, value = row[rank < k], col[rank < k], value[rank < k]
                    own = part[row]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[own[:, 0]], keys[own[:, 0]], own[:, 1], own[:, 2], bids[col], value)],
                                                     ["anchor", "anchor_key", "pid", "pscore", "id", "score"])
    return run


_WINDOW = ["anchor", "anchor_key", "pid", "pscore"]


def _best(index: Index, queries: DataFrame, same: bool, k: int, near: int | None, name: str) -> DataFrame:
    """The k best rows of each window, ranked from 1, over the leaves that may hold one."""
    sent = (queries.select("grp", "vec_id", "label", "key", "q", "windows").repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(_send(index.tree, index.parts, near), _SENT))
    block = index.blocks.select("leaf", "part", *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "keys", "q")])
    # a merge join: what is sent is far larger than the queries, from which the planner would take its size for a broadcast
    pairs = sent.hint("merge").join(block, ["leaf", "part"]).select("ids", "labels", "keys", "q", "windows", "b_ids", "b_labels", "b_keys", "b_q")
    found = pairs.mapInArrow(_compare(index.dim, same, k), _FOUND)
    rank = F.row_number().over(Window.partitionBy(*_WINDOW).orderBy(F.desc("score"), "id"))
    return stored(found.withColumn("rank", rank).where(F.col("rank") <= k), name)


def search(index: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, anchor_key, pid, pscore, id, score, rank): the k best rows of each window.

    ``queries``: rows of the index with ``windows``, an array of structs (pid, pscore, lo, hi, cut); a
    row fits a window if its product with the query is in [lo, hi], where at lo its id is at most
    cut.  ``same``: rows of the query's label without itself, else rows of other labels."""
    queries = stored(_grouped(queries), "queries")
    near = _best(index, queries, same, k, NEAR, "near")
    bound = (near.where(F.col("rank") == k)
             .groupBy("anchor", "anchor_key").agg(F.collect_list(F.struct("pid", "pscore", "score", "id")).alias("bounds")))
    key = [F.col("vec_id") == F.col("anchor"), F.col("key") == F.col("anchor_key")]

    def raised(w: Column) -> Column:
        mine = F.filter("bounds", lambda b: (b["pid"] == w["pid"]) & (b["pscore"] == w["pscore"]))
        b = F.get(mine, 0)
        known = b.isNotNull() & (b["score"] >= w["lo"])
        return F.struct(w["pid"].alias("pid"), w["pscore"].alias("pscore"), F.when(known, b["score"]).otherwise(w["lo"]).alias("lo"),
                        w["hi"].alias("hi"), F.when(known, b["id"]).otherwise(w["cut"]).alias("cut"))

    tight = queries.join(bound, key, "left").withColumn("windows", F.transform("windows", raised))
    return _best(index, tight, same, k, None, "found")


def mine(rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding; ``anchors``: which rows are anchors, by default those whose
    vec_id is divisible by 100.  A negative has another label than the anchor and a score of ``low`` to
    ``high`` hundredths of the positive's; the first ``negatives`` are returned for each positive.

    Defined results: rows with a NULL vec_id, label or vector, or with a NULL or non-finite
    component take no part; equal rows (id, label and vector) count once, rows that share only the id
    are rows of their own; a vector shorter than the longest one counts as padded with zeros; a quantised component
    beyond the square root of 2**55 / dimension counts as that bound, so that scores are longs; an
    anchor without positives, or a positive without rows in its window, gives no row; an empty table
    gives no row.  Other columns are ignored."""
    ready(rows.sparkSession)
    usable = V.usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), V.VECTOR)
                      .where("vec_id is not null and label is not null"))
    index = Index(usable)
    chosen = index.rows.where(F.expr("pmod(vec_id, 100) = 0") if anchors is None else anchors)
    everything = F.array(F.struct(F.lit(-1).cast("long").alias("pid"), F.lit(0).cast("long").alias("pscore"), F.lit(_LOW).alias("lo"),
                                  F.lit(_HIGH).alias("hi"), F.lit(_HIGH).alias("cut")))
    best = search(index, chosen.withColumn("windows", everything), True, positives)
    p = F.col("score")
    floor = lambda x, by: F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))
    lo, hi = -floor(-p * low, 100), floor(p * high, 100)
    windows = (best.select("anchor", "anchor_key", F.struct(F.col("id").alias("pid"), p.alias("pscore"), lo.alias("lo"), hi.alias("hi"),
                                                            F.lit(_HIGH).alias("cut")).alias("w")).where("w.lo <= w.hi")
               .groupBy("anchor", "anchor_key").agg(F.sort_array(F.collect_set("w")).alias("windows")))     # at most ``positives`` of them
    asked = chosen.join(windows, [F.col("vec_id") == F.col("anchor"), F.col("key") == F.col("anchor_key")]).drop("anchor", "anchor_key")
    found = search(index, asked, False, negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The rows with label (label + 1) % 10 where vec_id is divisible by 7."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.expr("pmod(vec_id, 7) = 0"), (label + 1) % 10).otherwise(label))
