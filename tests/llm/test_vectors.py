"""Hard negatives and vector codes against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelspark.llm import covertree, gnat, vectors as V

DDL = "vec_id long, embedding array<float>, label int, score double, key string, leaf int, q long"


def table(spark, rows):
    """(vec_id, vector, label) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, l, 0.5, "x", 1, 2) for i, v, l in rows], DDL)


def whole(rows, scale, bound):
    """(vec_id, integer vector padded to the longest, label) of the rows that take part."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max([len(v) for _, v, _ in kept], default=1) or 1
    floor = lambda x: max(-bound, min(bound, math.floor(scale * float(np.float32(x)))))
    return [(i, tuple(floor(x) for x in v) + (0,) * (dim - len(v)), l) for i, v, l in kept]


def brute_negatives(rows, positives=5, negatives=10):
    kept = [r for r in rows if r[0] is not None and r[2] is not None]
    dim = max([len(v) for _, v, _ in kept if v is not None], default=1) or 1
    items = sorted(set(whole(kept, 256, math.isqrt((1 << 55) // dim))), key=repr)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in items:
        if a[0] % 100:
            continue
        scored = [(dot(a[1], b[1]), b) for b in items if b is not a]
        same = sorted(((-s, b[0]) for s, b in scored if b[2] == a[2]))[:positives]
        for s, p in same:
            fit = sorted((-n, b[0]) for n, b in scored if b[2] != a[2] and 30 * -s <= 100 * n <= 90 * -s)[:negatives]
            out += [(a[0], p, k + 1, n, -s, -x) for k, (x, n) in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(rng, n, dim=8, centres=6, labels=3):
    c = rng.normal(size=(centres, dim)) * 2
    return [(i, (c[i % centres] + rng.normal(size=dim) * 0.15).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_hard_negatives_match_brute_force(spark):
    rng = np.random.default_rng(1)
    spread = [(i, rng.normal(size=6).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(0, 1500, 2)]
    for rows in (spread, clustered(rng, 900)):
        assert mined(gnat.mine(table(spark, rows).repartition(3))) == brute_negatives(rows)


def test_ties_hot_vector_and_hot_label(spark):
    rng = np.random.default_rng(2)
    hot = [1.0, 0.5, -0.25]
    rows = [(i, hot, 0) for i in range(300)] + [(300 + i, rng.integers(-1, 2, 3).astype(float).tolist(), int(i % 5 == 0)) for i in range(400)]
    assert mined(gnat.mine(table(spark, rows))) == brute_negatives(rows)


def test_hard_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 250, dim=4)
    rows += [(None, [1.0] * 4, 1), (700, None, 1), (800, [1.0, None, 1.0, 1.0], 1), (900, [float("nan")] * 4, 1), (1000, [float("inf")] * 4, 0),
             (1100, [1.0] * 4, None), (1200, [], 1), (1300, [2.0], 2), (1400, [3e38, -3e38, 1.0, 0.0], 0), (1400, [1.0, 2.0, 3.0, 4.0], 0),
             rows[100], rows[100], rows[3], (-100, [0.5, 0.5, 0.5, 0.5], 1)]
    assert mined(gnat.mine(table(spark, rows))) == brute_negatives(rows)
    assert mined(gnat.mine(table(spark, []))) == [] and mined(gnat.mine(table(spark, [(100, [1.0], 1)]))) == []


def test_relabelled(spark):
    got = gnat.relabelled(table(spark, [(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 3), (14, [1.0], None), (None, [1.0], 2)])).collect()
    assert [(r.vec_id, r.label) for r in got] == [(0, 0), (7, 4), (8, 3), (14, None), (None, 2)]


def test_tree_rules_out_leaves_and_no_row_of_the_result(spark):
    rng = np.random.default_rng(4)
    x = np.array([r[1] for r in clustered(rng, 3000, dim=6, centres=12)]) * 256 // 1
    tree = gnat.fit(x[:1000], 6)
    leaf = tree.route(x)
    for node, points in enumerate(tree.points):
        k = len(points)
        tree.ranges[node] = [np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf)]
    for one in np.unique(leaf):
        rows = x[leaf == one]
        for node, c in tree.path[one]:
            d, n, r = np.sqrt(gnat._squared(rows, tree.points[node])), (rows ** 2).sum(1), tree.ranges[node]
            r[0][:, c], r[1][:, c] = np.minimum(r[0][:, c], d.min(0)), np.maximum(r[1][:, c], d.max(0))
            r[2][c], r[3][c] = min(r[2][c], n.min()), max(r[3][c], n.max())
    queries = x[::100]
    score = queries @ x.T
    best = -np.sort(-score, axis=1)[:, 9]
    live = tree.alive(queries, best, np.full(len(queries), np.inf))
    assert all(live[i, leaf[j]] for i, j in zip(*np.nonzero(score >= best[:, None])))
    assert live.mean() < 0.4                                           # most leaves are ruled out on clustered rows
    live = tree.alive(queries, 0.3 * best, 0.9 * best)                # an annulus
    inside = (score >= 0.3 * best[:, None]) & (score <= 0.9 * best[:, None])
    assert all(live[i, leaf[j]] for i, j in zip(*np.nonzero(inside)))


def brute_codes(rows, parts=8, entries=16, rounds=6):
    padded = [(i, v, l) for i, v, l in whole(rows, 4096, 1 << 24)]
    if not padded:
        return []
    dim = -(-len(padded[0][1]) // parts) * parts
    size = dim // parts
    items = [(i, v + (0,) * (dim - len(v)), l) for i, v, l in padded]
    first = sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(f[1][p * size:(p + 1) * size]) for f in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size:(p + 1) * size], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [nearest(v, p)[1] for _, v, _ in items]
            book = []
            for e, c in enumerate(books[p]):
                mine = [v[p * size:(p + 1) * size] for (_, v, _), o in zip(items, of) if o == e]
                book.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
            new.append(book)
        books = new
    got = [(i, l, [nearest(v, p) for p in range(parts)]) for i, v, l in items]
    total = {}
    for _, l, near in got:
        total[l] = total.get(l, 0) + sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), total[l], digest) for i, l, near in got), key=repr)


def coded(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    spread = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), int(rng.integers(4))) for i in rng.permutation(500)]
    for rows in (spread, clustered(rng, 400, dim=16, centres=20)):
        assert coded(covertree.compress(table(spark, rows).repartition(3), block=128)) == brute_codes(rows)


def test_codes_of_awkward_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist(), [0, 1, None][i % 3]) for i in range(80)]        # many ties
    rows += [(None, [1.0] * 8, 1), (None, None, 1), (5, [0.5] * 8, None), (5, [0.5] * 8, None), (3, [None] * 8, 1), (3, [float("nan")] * 8, 1),
             (-7, [float("-inf")] + [0.0] * 7, 1), (900, [], 1), (901, [1.0, 2.0], 1), (902, [1e30] + [-1e30] * 7, 2)]
    rows += [(1000 + i, [0.25] * 8, 7) for i in range(60)]                                                      # one hot vector
    assert coded(covertree.compress(table(spark, rows).repartition(2), block=32)) == brute_codes(rows)
    few = [(2, [1.0, 2.0, 3.0], 1), (1, [0.0, 0.5, 0.25], None)]
    assert coded(covertree.compress(table(spark, few))) == brute_codes(few)
    assert coded(covertree.compress(table(spark, []))) == []


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_levels(seed):
    """Nested runs that cover the rows, radii that hold, and assignments equal to exact comparison."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = np.floor(rng.normal(size=(3, n, 4)) * (1 if seed == 0 else 300))
    order, nodes = covertree.grow(x, centres=24)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
    nodes["centre"] = place[nodes["part"], nodes["centre"]]
    for p in range(3):
        mine, y = nodes[nodes["part"] == p], x[p, order[p]]
        for level in np.unique(mine["level"]):
            run = mine[mine["level"] == level]
            assert run["start"][0] == 0 and run["end"][-1] == n and (run["start"][1:] == run["end"][:-1]).all()
            for one in run:
                d = np.sqrt(((y[one["start"]:one["end"]] - y[one["centre"]]) ** 2).sum(1))
                assert d.max() <= one["radius"] + 1e-9 and one["start"] <= one["centre"] < one["end"]
        book = x[p, rng.integers(0, n, 7)]
        got, _, compared = covertree.assign(y, mine, book)
        assert (got == covertree._nearest(y, book)[0]).all() and compared <= n


def test_subtrees_are_given_whole_on_clustered_rows():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(1, 20, 8)) * 3000
    x = np.floor(centres[:, rng.integers(0, 20, 2000)] + rng.normal(size=(1, 2000, 8)) * 20)
    order, nodes = covertree.grow(x)
    nodes["centre"] = np.argsort(order[0])[nodes["centre"]]
    _, whole_runs, compared = covertree.assign(x[0, order[0]], nodes, np.floor(centres[0]))
    assert compared < 200 and len(whole_runs) < 200


def test_packing_of_vectors():
    import pyarrow as pa
    col = pa.array([[0.5, -0.001], [], [1e30, 2.0], [-0.0]], pa.list_(pa.float64()))
    q = V.quantised(col.slice(1), 2, 256, 1 << 20)
    assert q.tolist() == [[0, 0], [1 << 20, 512], [0, 0]]
    assert V.unpacked(V.packed(q).slice(1), 2).tolist() == q[1:].tolist()
    random.seed(0)
