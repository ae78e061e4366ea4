"""Near-duplicate classes with BagMinHash.

A document is the multiset of its five-word shingles (a text of one to four words is one shingle);
two documents are linked when the weighted Jaccard similarity, sum of minima over sum of maxima
of the multiplicities, is at least ``threshold`` (0.8).

Signature.  Multiplicities are discretised at 1, 2, 4, 8, ...: the intervals [0,1), [1,2), [2,4),
[4,8), ... of every shingle carry independent Poisson processes whose points have a time, a
register and (in wide intervals) a place.  A point counts for a document if its place lies below the
shingle's multiplicity there.  Register j keeps the least time; two documents agree in a register
with probability equal to their similarity.  Points come in order of time and only up to a limit
at which all registers are filled with high probability; documents with an empty register go on
to a later limit.

Search.  Documents with equal multisets share one representative.  Bands of four registers put the
representatives into buckets; 32 bands miss a pair at similarity 0.8 with probability below 5e-8.
In each bucket everybody is verified against one leader first, the member whose buckets are the
fullest: in a group of copies that is the text the others come from.  So a group costs one
comparison a member and bucket.

Closing step.  All members of buckets meet in a prefix index.  A multiset is
taken as the set of its named occurrences, in one global order, the rarest first (counts of hashed
names over all members).  Two multisets of n >= m occurrences that reach the threshold t share one
among the first n - ceil(t n) + 1 of the longer and the first m - ceil(2 t m / (1 + t)) + 1 of the
shorter one; a pair whose places there leave too few occurrences behind is no candidate (positional bound), nor is one
whose parities in 256 hash classes differ in more classes than the threshold lets occurrences differ (bitmap bound).
Only names that two classes have are joined, and only members of different classes: the class that
holds a name most often is met by the others, never by itself.  So no link between classes is lost, pairs inside a class
are not spelled out, and copies that differ in occurrences of their own meet nobody.  Every
candidate is verified on its whole multisets; new links join classes, so a second search for components runs over
classes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.components import components
from panelspark.llm.scratch import ready, stored
from panelspark.operators.small import join_per_key

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
BAND = 4                          # registers in a band
_SPARE = 4.0                      # e**-4 of the documents need a later time limit
_PLACE = 48                       # bits of an element's name inside a block
SLOTS = 1 << 20                   # counters of hashed occurrence names; they order the prefixes
_NO_ID = -(1 << 63)               # stands for a NULL doc_id


def shingle_prints(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle fingerprints, offsets per row)."""
    s, e, wo = A.word_spans(data, off)
    h, g = A.word_hashes(data, s, e, both=True)
    n = np.diff(wo)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_off[-1]), np.uint64)
    start = np.repeat(wo[:-1] - out_off[:-1], count) + np.arange(len(out))
    whole = np.repeat(n >= size, count)
    out[whole] = A.window_prints(h, size)[start[whole]]
    short = np.flatnonzero((n > 0) & (n < size))
    out[out_off[short]] = A.span_prints(h, g, wo[short], wo[short + 1])[0]
    return out, out_off


def signatures(prints: np.ndarray, off: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Register times (rows x registers); rows without shingles have infinite times."""
    rows = len(off) - 1
    out = np.full(rows * registers, np.inf)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(off))
    bits = np.uint64(_PLACE)
    key, weight = np.unique((row << bits) | (prints >> np.uint64(64 - _PLACE)), return_counts=True)
    owner = (key >> bits).astype(np.int64)
    name = key & ((np.uint64(1) << bits) - np.uint64(1))
    total = np.diff(off)
    begun, limit = np.zeros(rows), np.where(total > 0, registers * (np.log(registers) + _SPARE) / np.maximum(total, 1), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        active = np.zeros(rows, bool)
        active[todo] = True
        at = np.flatnonzero(active[owner])
        level, low = 0, 0
        while len(at):                                        # intervals [0,1), [1,2), [2,4), [4,8), ...
            _points(out, registers, owner[at], name[at], weight[at], level, low, max(low, 1), limit)
            low = max(2 * low, 1)
            level += 1
            at = at[weight[at] > low]
        filled = np.isfinite(out.reshape(rows, registers)[todo]).all(axis=1)
        todo = todo[~filled]
        limit[todo] *= 2                                      # points before the old limit come again and change nothing
    return out.reshape(rows, registers)


def _points(out, registers, owner, name, weight, level, low, width, limit):
    """Enter the points of one interval of all elements, in order of time."""
    seed = A.mix(name * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))
    time, until = np.zeros(len(seed)), limit[owner]
    k = 0
    while len(seed):
        k += 1
        u = A.mix(seed + np.uint64((k * 0xD1B54A32D192ED03) & (2 ** 64 - 1)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width
        go = time <= until
        if not go.all():
            seed, time, until, owner, weight, u = seed[go], time[go], until[go], owner[go], weight[go], u[go]
        slot = owner * registers + (u & np.uint64(registers - 1)).astype(np.int64)
        if width > 1:
            place = low + width * ((A.mix(u) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
            inside = place < weight
            np.minimum.at(out, slot[inside], time[inside])
        else:
            np.minimum.at(out, slot, time)


def band_keys(times: np.ndarray, band: int = BAND) -> np.ndarray:
    """Bucket keys of each row, one per band."""
    rows, m = times.shape
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(rows, m // band, band)
    key = np.arange(1, m // band + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(band):
        key = A.mix(key ^ bits[:, :, i]) + np.uint64(i)
    return key


def occurrences(prints: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the i-th occurrence of a shingle has a name of its own."""
    p = np.sort(prints)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    nth = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    again = nth > 0
    p[again] = A.mix(p[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(p)


def _sign(registers: int):
    def run(batches):
        for batch in batches:
            data, off = A.text_buffers(batch.column(2))
            for a, b in A.blocks(off):
                p, o = shingle_prints(data[off[a]:off[b]], off[a:b + 1] - off[a])
                n = np.diff(o)
                times = signatures(p, o, registers)
                whole = []                                   # multiset fingerprints: order-free sums
                for salt in (0x8CB92BA72F3D8DD7, 0xABCC5167CCAD925F):
                    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(p ^ np.uint64(salt)), dtype=np.uint64)])
                    whole.append(cum[o[1:]] - cum[o[:-1]])
                keys = band_keys(times)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), A.as_long(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), A.as_long(whole[0]), A.as_long(whole[1]), bands],
                    ["did", "uid", "n", "p", "q", "bands"])
    return run


def _vectors(batches):
    for batch in batches:
        data, off = A.text_buffers(batch.column(1))
        for a, b in A.blocks(off):
            p, o = shingle_prints(data[off[a]:off[b]], off[a:b + 1] - off[a])
            vec = [occurrences(p[x:y]).tobytes() for x, y in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(vec, pa.binary())], ["node", "vec"])


def _similar(threshold: float):
    """Rows whose last two columns, two vectors, reach the threshold, without these columns."""
    def run(batches):
        for batch in batches:
            u, v = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            keep = []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(u[i].as_buffer(), np.uint64), np.frombuffer(v[i].as_buffer(), np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(both + 1e-9 >= threshold * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))
    return run


def _slot(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counted(batches):
    """Per task: how many occurrences fall on each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        data, _ = A.text_buffers(batch.column(0))
        total += np.bincount(_slot(data.view(np.uint64)), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def prefix_sizes(n: int, threshold: float) -> tuple[int, int]:
    """(occurrences of a multiset of n that meet shorter ones, those that meet longer ones)."""
    least = lambda x: int(np.ceil(x - 1e-6))
    return n - max(least(threshold * n), 1) + 1, n - max(least(2 * threshold * n / (1 + threshold)), 1) + 1


def _prefixes(counts, threshold: float):
    """Rows (name, i, short, b0 to b3, node, n, root): the prefix of each vector; ``short``: it also meets longer ones there;
    b0 to b3: the parities of the counts of its names in 256 hash classes."""
    def run(batches):
        count = counts.value
        for batch in batches:
            name, place, short, size, bits = [], [], [], [], []
            for vec in batch.column(3):
                v = np.frombuffer(vec.as_buffer(), np.uint64)
                bits.append(np.packbits((np.bincount((v & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64))
                probe, index = prefix_sizes(len(v), threshold)
                c = count[_slot(v)]
                if probe < len(v):                                # only what may be among the first
                    some = np.flatnonzero(c <= np.partition(c, probe - 1)[probe - 1])
                    v, c = v[some], c[some]
                order = np.lexsort((v, c))[:probe]
                name.append(v[order])
                place.append(np.arange(len(order)))
                short.append(np.arange(len(order)) < index)
                size.append(len(order))
            if not size:
                continue
            row = np.repeat(np.arange(batch.num_rows), size)
            parity = np.array(bits)[row]
            yield pa.RecordBatch.from_arrays(
                [A.as_long(np.concatenate(name)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(short)),
                 *(pa.array(np.ascontiguousarray(parity[:, k])) for k in range(4)),
                 *(batch.column(k).take(pa.array(row)) for k in range(3))], ["name", "i", "short", "b0", "b1", "b2", "b3", "node", "n", "root"])
    return run


_NODE = "struct<did: bigint, uid: bigint>"


def _contracted(batches):
    """The edges of a task as stars around the least node of each component they make among themselves."""
    edges = [b for b in batches if b.num_rows]
    if not edges:
        return
    ends = np.concatenate([np.stack([c.field(k).to_numpy() for k in (0, 1)], 1) for i in (0, 1) for c in (b.column(i) for b in edges)])
    nodes, at = np.unique(ends, axis=0, return_inverse=True)            # in the nodes' order
    u, v = at.ravel()[:len(ends) // 2], at.ravel()[len(ends) // 2:]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    struct = lambda x: pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["did", "uid"])
    for a in range(0, len(far), 65536):
        part = far[a:a + 65536]
        yield pa.RecordBatch.from_arrays([struct(nodes[part]), struct(nodes[label[part]])], ["u", "v"])


def node_of() -> Column:
    """A row's key: its id and its content, so that ids given twice do not merge different texts."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    return F.struct(did.alias("did"), F.xxhash64("doc_id", "text").alias("uid"))      # a NULL text is not an empty one here


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float, out: str = "u v") -> DataFrame:
    """The ``out`` columns of the pairs (u, v) whose multisets reach the threshold."""
    left = vectors.select(F.col("node").alias("u"), F.col("vec").alias("uv"))
    right = vectors.select(F.col("node").alias("v"), F.col("vec").alias("vv"))
    cols = out.split()
    rows = pairs.join(right, "v").join(left, "u").select(*cols, "uv", "vv")
    return rows.mapInArrow(_similar(threshold), ", ".join(f"{c} {_NODE}" for c in cols))


def _closing(vectors: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, u_root, v_root): candidates among the vectors of different classes (a node without a class is its own)."""
    spark = vectors.sparkSession
    got = vectors.select("vec").mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()    # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(counts)                       # 8 MB
    placed = vectors.join(classes, "node", "left").select("node", (F.octet_length("vec") / 8).cast("long").alias("n"), F.coalesce("root", "node").alias("root"), "vec")
    rows = stored(placed.mapInArrow(
        _prefixes(shared, threshold), f"name long, i int, short boolean, b0 long, b1 long, b2 long, b3 long, node {_NODE}, n long, root {_NODE}"), "prefixes")
    by_class = rows.groupBy("name", "root").agg(F.count("*").alias("c"))
    mixed = (by_class.groupBy("name").agg(F.count("*").alias("k"), F.max(F.struct("c", "root"))["root"].alias("largest"))
             .where("k > 1").select("name", "largest"))
    rows = stored(join_per_key(rows, mixed, "name").withColumn("main", F.col("root") == F.col("largest")).drop("largest"), "shared-prefixes")
    # side 0: a longer vector of any class meets shorter ones outside the largest; side 1: outside the largest, it meets the largest
    carried = ("node", "n", "root", "i", "b0", "b1", "b2", "b3")
    sides = F.when(F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    x = rows.select("name", F.explode(sides).alias("side"), *[F.col(c).alias(f"u_{c}") for c in carried])
    y = (rows.where("short").withColumn("side", F.col("main").cast("int"))
         .select("name", "side", *[F.col(c).alias(f"v_{c}") for c in carried]))
    longer = (F.col("u_n") > F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u_node") > F.col("v_node")))
    odd = sum((F.bit_count(F.col(f"u_b{k}").bitwiseXOR(F.col(f"v_b{k}"))) for k in range(4)), F.lit(0))
    most = F.least(F.col("u_n") - F.col("u_i"), F.col("v_n") - F.col("v_i"), F.floor((F.col("u_n") + F.col("v_n") - odd) / 2))
    able = most + 1e-9 >= threshold * (F.col("u_n") + F.col("v_n") - most)
    pairs = x.join(y, ["name", "side"]).where(longer & (F.col("u_root") != F.col("v_root")) & able)
    return pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), "u_root", "v_root").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, registers: int = REGISTERS) -> DataFrame:
    """One row per input row: doc_id, class_id, n_shingles, node, root.

    ``class_id`` is the least doc_id of the connected component of links; ``node`` and ``root`` are
    the row keys (id and content) of the row and of its class.  Defined results: a NULL, empty or
    blank text has no shingles and is a class of its own; rows with equal texts are always of one
    class, and a repeated row has the node of its twin; a NULL doc_id sorts first, so a class
    that holds one has a NULL class_id (its root is still unique).  Other columns are ignored."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(node_of().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(rows.select("node.did", "node.uid", "text").mapInArrow(
        _sign(registers), "did long, uid long, n long, p long, q long, bands array<long>"), "signatures")
    node = F.struct("did", "uid").alias("node")
    least = F.min_by(F.struct(node, "bands"), F.struct("did", "uid"))
    reps = stored(signed.where("n > 0").groupBy("n", "p", "q").agg(least.alias("r")).select("n", "p", "q", "r.node", "r.bands"), "multisets")

    spread = reps.select("node", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    whole = Window.partitionBy("node")                                  # a node has one row for each band
    members = stored(join_per_key(spread, full, "bucket").withColumn("score", F.sum("c").over(whole)).select("bucket", "node", "score"), "members")
    led = members.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("u"))
    star = join_per_key(members.select("bucket", "node"), led, "bucket").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    needed = members.select("node").distinct()
    texts = rows.dropDuplicates(["node"]).join(needed, "node")          # repeated rows meet before they are sent
    vectors = stored(texts.select("node", "text").mapInArrow(_vectors, f"node {_NODE}, vec binary"), "vectors")
    classes = components(_verified(star, vectors, threshold), "u", "v", _contracted)

    # closing step: links between classes
    more = stored(_verified(_closing(vectors, classes, threshold), vectors, threshold, "u_root v_root"), "closing-links")
    if not more.isEmpty():                                              # new links join classes
        merged = components(more, "u_root", "v_root", _contracted).select(F.col("node").alias("old"), F.col("root").alias("top"))
        every = classes.union(more.select(F.explode(F.array("u_root", "v_root")).alias("node")).select("node", F.col("node").alias("root")))
        classes = stored(every.join(merged, F.col("root") == F.col("old"), "left")
                         .groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root")), "classes")

    out = (signed.select(node, "n", "p", "q").join(reps.select("n", "p", "q", F.col("node").alias("rep")), ["n", "p", "q"], "left")
           .join(classes.withColumnRenamed("node", "rep"), "rep", "left"))
    root = F.coalesce("root", "rep", "node")
    real = lambda c: F.when(c != _NO_ID, c)
    return out.select(real(F.col("node.did")).alias("doc_id"), real(root["did"]).alias("class_id"),
                      F.col("n").alias("n_shingles"), "node", root.alias("root"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row of every class (the class root); all columns stay."""
    found = near_duplicates(docs, threshold)
    kept = stored(found.where("node = root").groupBy("node").agg(F.count("*").alias("n_rows")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node_of().alias("node")).join(kept, "node")
    again = rows.where("n_rows > 1").dropDuplicates(["node"])                          # repeated rows
    return rows.where("n_rows = 1").union(again).select("row.*")
