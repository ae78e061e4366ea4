"""Packing by concatenate and cut.

Pass one tokenises every text, ends it with the end id and writes the ids with their place in
their own partition.  The partitions' token totals, summed in order, give every document its
global offset.  Pass two cuts the one long stream into fixed windows; a document that crosses a
window's end leaves a piece (a boundary record) in each window.  Only the last window is short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import bpe as B
from panelspark.llm.scratch import ready, stored

LENGTH = 2048
END_ID = 1
BATCH_IDS = 4 << 20              # ids given back at once
CACHE = 80_000                   # cached segments; a worker keeps them while other stages use its memory


class Ids:
    """Token ids of texts as little-endian arrays, put together from cached segments."""

    def __init__(self, path: str):
        self.bpe = B.load(path)
        self.type = B.id_type(self.bpe)
        self._work = B.TextWork(self.bpe, self._encode, self._special, CACHE)

    def _encode(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text), self.type).tobytes()

    def _special(self, text: str) -> bytes:
        return np.array([self.bpe.tokenizer.token_to_id(text)], self.type).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(self._work.whole(text))


_MADE: dict[str, Ids] = {}


def _tokenise(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if path not in _MADE:
            _MADE[path] = Ids(path)
        work, at = _MADE[path], 0
        end, width = np.array([end_id], work.type).tobytes(), work.type.itemsize
        for batch in batches:
            doc = batch.column(1).to_pylist()
            ids, size, keep = [], 0, 0
            texts = batch.column(0).to_pylist()
            for i, text in enumerate(texts):
                ids.append((work.whole(text) if text else b"") + end)
                size += len(ids[-1])
                if size >= BATCH_IDS * width or i == len(texts) - 1:
                    n = np.array([len(x) // width for x in ids], np.int64)
                    start = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                    at += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[keep:i + 1], pa.int64()), pa.array(np.full(len(ids), part, np.int64)),
                         pa.array(start.astype(np.int64)), pa.array(n), pa.array(ids, pa.binary())],
                        ["doc_id", "part", "local_start", "doc_tokens", "ids"])
                    ids, size, keep = [], 0, i + 1
    return run


def _cut(length: int, base: dict[int, int], width: int):
    def run(batches):
        for batch in batches:
            part = batch.column(1).to_numpy()
            first = np.array([base[p] for p in part.tolist()], np.int64) + batch.column(2).to_numpy()
            n = batch.column(3).to_numpy()
            last = first + n - 1
            pieces = last // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (first // length)[row]
            lo, hi = np.maximum(first[row], seq * length), np.minimum(last[row] + 1, (seq + 1) * length)
            start, size = lo - first[row], hi - lo
            _, offs, data = batch.column(4).buffers()
            col = batch.column(4)
            wide = pa.types.is_large_binary(col.type)
            off = np.frombuffer(offs, np.int64 if wide else np.int32, len(n) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
            buf = np.frombuffer(data, np.uint8)
            kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
            crc = np.empty(len(row), np.int64)
            for i, (a, b) in enumerate(zip((off[row] + start * width).tolist(), (off[row] + (start + size) * width).tolist())):
                crc[i] = zlib.crc32(buf[a:b].view(kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc),
                 pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length), pa.array(hi < last[row] + 1)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues"])
    return run


_IDS = "doc_id long, part long, local_start long, doc_tokens long, ids binary"
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
           "`offset` long, continues boolean")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues.

    Defined results: a NULL or empty text is its end id alone; repeated rows are packed each; a
    NULL doc_id stays NULL; an empty table gives no pieces.  Other columns are ignored.  The
    partition totals (one number per input partition) go to the driver, as any numbering of
    partitions needs; ids and documents do not."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    ids = stored(rows.mapInArrow(_tokenise(path, end_id), _IDS), "ids")
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()
    base, at = {}, 0
    for part, n in sorted(map(tuple, totals)):
        base[part], at = at, at + n
    width = B.id_type(B.load(path)).itemsize
    return ids.mapInArrow(_cut(length, base, width), _PIECES)
