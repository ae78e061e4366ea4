"""Product codes for vectors: Lloyd rounds over partition-local cover trees.

A vector is cut into equal parts; every part position has a codebook.  Each task cuts its rows into
blocks and builds one cover tree per block and part position: centres are taken farthest first, so
the first m centres are a net whose points are at least as far apart as the rest is from them, and
the nets at the radii R, R/2, R/4, ... are the tree's levels (nested, covering, separated).  At
``CENTRES`` centres, or when all points are centres, the tree ends and a leaf holds the points nearest to its centre.  Points lie in
the order of the tree, so a subtree is a run of them and its vector sum is a difference of two
cumulative sums.  Trees are written once and read in every round.

A round goes down the trees.  If the nearest codebook entry of a node's centre is nearer than the second one by
more than twice the node's radius, the triangle inequality gives the whole subtree to that entry, with its count
and sum.  Ambiguous nodes descend, and what is ambiguous in a leaf is compared exactly.  All components are integers:
sums, comparisons and ties are exact, and so the result does not depend on partitions, blocks or
trees.  Only counts and sums of the codebook entries leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import vectors as V
from panelspark.llm.scratch import ready, stored
from panelspark.operators.small import bounded, join_per_key

SCALE = 4096
BOUND = 1 << 24        # largest quantised component; squared distances of 8 of them are exact as doubles
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 2048           # rows of a tree
CENTRES = 64

_NODE = np.dtype([("part", "i4"), ("level", "i4"), ("start", "i4"), ("end", "i4"), ("centre", "i4"), ("radius", "f8")])


def grow(x: np.ndarray, centres: int = CENTRES) -> tuple[np.ndarray, np.ndarray]:
    """Cover trees of x (parts x rows x components): the rows in tree order (parts x rows) and the nodes."""
    parts, n, _ = x.shape
    rows = np.arange(parts)
    gap = np.full((parts, n), np.inf)
    cell = np.zeros((parts, n), np.int64)
    picked, reach = [], []
    at = np.zeros(parts, np.int64)
    while len(picked) < centres:
        d = ((x - x[rows, at][:, None, :]) ** 2).sum(2)
        closer = d < gap
        reach.append(gap[rows, at])                           # how far the new centre was from the older ones
        cell[closer] = len(picked)
        gap = np.where(closer, d, gap)
        picked.append(at)
        at = gap.argmax(1)
        if not gap[rows, at].any():
            break
    picked, reach = np.array(picked).T, np.sqrt(np.array(reach).T)      # parts x centres
    order, nodes = np.empty((parts, n), np.int32), []
    for p in range(parts):
        levels, own = [], np.arange(len(picked[p]))
        radius, far = reach[p].copy(), reach[p][1:2].max(initial=0.0)
        levels.append(cell[p])                                           # deepest level: one node per centre
        limit = far
        while limit > 0 and (radius[1:] > 0).any() and limit > radius[1:][radius[1:] > 0].min() / 2:
            limit /= 2
        net = limit
        anc = own
        while net <= far and far > 0:                                    # coarser nets
            kept = np.flatnonzero(np.concatenate([[True], radius[1:] > net]))
            c = x[p, picked[p]]
            near = ((c[:, None, :] - c[None, kept, :]) ** 2).sum(2).argmin(1)
            up = kept[near]
            up[kept] = kept
            anc = up[anc]
            levels.append(anc[cell[p]])
            net *= 2
        if far > 0 and len(np.unique(levels[-1])) > 1:
            levels.append(np.zeros(n, np.int64))
        order[p] = np.lexsort(levels)                                    # by the coarsest level first
        for depth, of in enumerate(reversed(levels)):
            run = of[order[p]]
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            centre = picked[p][run[start]]
            d = ((x[p, order[p]] - x[p, picked[p][run]]) ** 2).sum(1)
            node = np.empty(len(start), _NODE)
            node["part"], node["level"], node["start"], node["end"] = p, depth, start, np.append(start[1:], n)
            node["centre"], node["radius"] = centre, np.sqrt(np.maximum.reduceat(d, start))
            nodes.append(node)
    return order, np.concatenate(nodes)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row, ties to the lower entry; exact for integers up to BOUND."""
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    e = d.argmin(1)
    return e, d[np.arange(len(x)), e]


def assign(x: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """Entries of the points x (in tree order), the runs given as whole, and how many points were compared.

    ``nodes``: the nodes of one part position, coarse levels first."""
    out = np.full(len(x), -1, np.int64)
    whole = []
    if len(book) == 1:
        return np.zeros(len(x), np.int64), [(0, len(x), 0)], 0
    for level in np.unique(nodes["level"]):
        some = nodes[nodes["level"] == level]
        some = some[out[some["start"]] < 0]
        if not len(some):
            break
        d = np.sqrt(((x[some["centre"]][:, None, :] - book[None, :, :]) ** 2).sum(2))
        two = np.partition(d, 1, axis=1)[:, :2]
        sure = two[:, 1] - two[:, 0] > 2 * some["radius"] + 1e-9 * (1 + two[:, 1])
        entry = d.argmin(1)
        for s, e, c in zip(some["start"][sure], some["end"][sure], entry[sure]):
            out[s:e] = c
            whole.append((s, e, c))
    left = np.flatnonzero(out < 0)
    if len(left):
        out[left] = _nearest(x[left], book)[0]
    return out, whole, len(left)


def _plant(dim: int, parts: int, block: int):
    """Blocks with their trees: ids, labels, integer vectors, tree order and nodes."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                q = V.quantised(part.column(2), dim, SCALE, BOUND)
                x = q.reshape(len(q), parts, -1).transpose(1, 0, 2).astype(np.float64)
                order, nodes = grow(x)
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(q), dtype=np.int32)[None, :], axis=1)
                nodes["centre"] = place[nodes["part"], nodes["centre"]]                # as places in the order
                one = [pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), part.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array([v.tobytes()], pa.binary()) for v in (q, order, nodes))],
                                                 ["ids", "labels", "q", "ordered", "nodes"])
    return run


def _read(batch: pa.RecordBatch, i: int, dim: int, parts: int):
    """(vectors per part in tree order as doubles, order, nodes) of one stored block."""
    q, order, nodes = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((2, np.int32), (3, np.int32), (4, _NODE)))
    q = q.reshape(-1, parts, dim // parts)
    order = order.reshape(parts, -1)
    return [q[order[p], p].astype(np.float64) for p in range(parts)], order, nodes


def _sums(dim: int, parts: int, books: np.ndarray):
    """Rows (part, entry, place, total, n) of a task; place -1 carries the count."""
    def run(batches):
        size, entries = dim // parts, books.shape[1]
        total = np.zeros((parts, entries, size + 1), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                xs, _, nodes = _read(b, i, dim, parts)
                for p, x in enumerate(xs):
                    got, whole, compared = assign(x, nodes[nodes["part"] == p], books[p].astype(np.float64))
                    one = np.concatenate([np.ones((len(x), 1)), x], 1).astype(np.int64)
                    cum = np.concatenate([np.zeros((1, size + 1), np.int64), np.cumsum(one, axis=0)])
                    single = np.ones(len(x), bool)
                    for s, e, c in whole:                                # whole subtrees by cumulative sums
                        total[p, c] += cum[e] - cum[s]
                        single[s:e] = False
                    if compared:
                        np.add.at(total[p], got[single], one[single])
        part, entry, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (part, entry, place)] + [pa.array(total[part, entry, place])],
                                         ["part", "entry", "place", "total"])
    return run


def _codes(dim: int, parts: int, books: np.ndarray):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                xs, order, nodes = _read(b, i, dim, parts)
                n = order.shape[1]
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, x in enumerate(xs):
                    book = books[p].astype(np.float64)
                    got, _, _ = assign(x, nodes[nodes["part"] == p], book)
                    code[order[p], p] = got
                    error[order[p]] += ((x - book[got]) ** 2).sum(1).astype(np.int64)
                text = [c.tobytes().hex() for c in code]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), b.column(1).slice(i, 1).flatten(), pa.array(text), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])
    return run


def train(trees: DataFrame, books: np.ndarray, dim: int, parts: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after the Lloyd rounds; unused entries stay."""
    for _ in range(rounds):
        got = (trees.mapInArrow(_sums(dim, parts, books), "part int, entry int, place int, total long")
               .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect())      # parts x entries x components at most
        total = np.zeros((parts, books.shape[1], dim // parts + 1), np.int64)
        for r in got:
            total[r.part, r.entry, r.place] = r.total
        n = total[:, :, :1]
        books = np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each row that is kept.

    ``rows``: vec_id, label, embedding.  Codebooks start from the ``entries`` smallest vec_ids.  Defined results:
    rows with a NULL vector or a NULL or non-finite component are dropped; a NULL vec_id stays and
    comes last, rows of one vec_id come in the order of their vectors; equal rows are rows of their own;
    a vector whose length is not the longest one's, made divisible by ``parts``, counts as padded with zeros; components
    beyond 2**24 count as that bound; fewer than ``entries`` rows give smaller codebooks; an empty table
    gives no row; NULL labels are one label.  Other columns are ignored."""
    spark = rows.sparkSession
    ready(spark)
    kept = V.usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", V.VECTOR))
    dim = -(-V.dimension(kept) // parts) * parts
    label = kept.schema["label"].dataType.simpleString()
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), V.VECTOR).limit(entries).collect()
    start = V.quantised(pa.array([r[V.VECTOR] for r in first], pa.list_(pa.float64())), dim, SCALE, BOUND)
    books = start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2).astype(np.int64)
    trees = stored(kept.mapInArrow(_plant(dim, parts, block), f"ids array<long>, labels array<{label}>, q binary, ordered binary, nodes binary"), "trees")
    books = train(trees, books, dim, parts, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(trees.mapInArrow(_codes(dim, parts, books), f"vec_id long, label {label}, code string, error long"), "codes")
    errors = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return join_per_key(coded, bounded(errors, 10000), "label").withColumn("codebooks_sha256", F.lit(digest))
