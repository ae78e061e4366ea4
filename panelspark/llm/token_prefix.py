"""Exact token counts by prefix dynamic programming.

Every text is cut into the pieces of the tokenizer's pre-tokeniser; inside a piece a dynamic
program gives the exact token count of every prefix (``bpe.PrefixCounter``), and piece totals add
up along the text.  The table of prefix counts answers truncation and budget questions without
encoding again.  Counts of recurring segments are cached in a task; results do not depend on it.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import bpe as B
from panelspark.llm.scratch import ready, stored


class _Wide(Exception):
    """A difference of two counts that a signed byte cannot hold."""


class Prefixes:
    """Prefix counts of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.bpe = B.load(path)
        self.counter = B.PrefixCounter(self.bpe)
        self._pieces: dict[str, int] = {}
        self._work = B.TextWork(self.bpe, self._segment, lambda s: 1)
        self._steps: dict[str, bytes] = {}
        self._rows = B.TextWork(self.bpe, self._segment_steps, self._special_steps)

    def _piece(self, piece: str) -> int:
        n = self._pieces.get(piece)
        if n is None:
            n = self.counter.total(piece.encode("utf-8"))
            if len(piece) <= 64:
                if len(self._pieces) >= B.SEGMENT_CACHE:
                    self._pieces.clear()
                self._pieces[piece] = n
        return n

    def _segment(self, text: str) -> int:
        return sum(map(self._piece, self.bpe.pieces(text)))

    def total(self, text: str) -> int:
        return sum(self._work.whole(text))

    def _ends(self, piece: str) -> list[int]:
        """Token counts of a piece's prefixes of whole characters, the empty one first."""
        raw = piece.encode("utf-8")
        counts = self.counter.counts(raw)
        return counts if len(raw) == len(piece) else [n for i, n in enumerate(counts) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def _piece_steps(self, piece: str) -> bytes:
        got = self._steps.get(piece)
        if got is None:
            got = _steps(self._ends(piece))
            if len(piece) <= 64:
                if len(self._steps) >= B.SEGMENT_CACHE:
                    self._steps.clear()
                self._steps[piece] = got
        return got

    def _segment_steps(self, text: str) -> bytes:
        return b"".join(map(self._piece_steps, self.bpe.pieces(text)))

    def _special_ends(self, s: str) -> list[int]:
        """A special string is one token; its proper prefixes are ordinary text."""
        return [0, *(sum(self._piece(p) for p in self.bpe.pieces(s[:j])) for j in range(1, len(s))), 1]

    def _special_steps(self, s: str) -> bytes:
        return _steps(self._special_ends(s))

    def row(self, text: str) -> bytes:
        """The stored row of a text: the differences of its prefixes' counts."""
        try:
            return b"\x01" + b"".join(self._rows.whole(text))
        except _Wide:
            out = []
            special = self.bpe.special[0] if self.bpe.special else None
            for i, part in enumerate(text.split(special) if special else [text]):
                ends = [self._special_ends(special)] if i else []
                for e in ends + [self._ends(p) for p in (self.bpe.pieces(part) if part else [])]:
                    out += [b - a for a, b in zip(e, e[1:])]
            return b"\x04" + np.array(out, np.int32).tobytes()

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Byte ends of the pieces of a text, and the token count up to each."""
        ends, counts, at, n = [], [], 0, 0
        parts = text.split(self.bpe.special[0]) if self.bpe.special else [text]
        for i, part in enumerate(parts):
            if i:
                at, n = at + len(self.bpe.special[0].encode()), n + 1
                ends.append(at)
                counts.append(n)
            for piece in self.bpe.pieces(part) if part else []:
                at, n = at + len(piece.encode("utf-8")), n + self._piece(piece)
                ends.append(at)
                counts.append(n)
        return ends, counts

    def cut(self, text: str, budget: int) -> tuple[int, int]:
        """The longest run of whole characters from the start of ``text`` with at most ``budget``
        tokens, as (bytes, tokens): whole pieces by their totals, the last one by its prefix counts."""
        ends, counts = self.table(text)
        i = int(np.searchsorted(counts, budget, side="right"))
        at, n = (ends[i - 1], counts[i - 1]) if i else (0, 0)
        if i == len(ends):
            return at, n
        piece = text.encode("utf-8")[at:ends[i]]
        if self.bpe.special and piece == self.bpe.special[0].encode():
            return at, n
        inner = self.counter.counts(piece)
        for j in range(len(piece) - 1, 0, -1):
            if n + inner[j] <= budget and piece[j] & 0xC0 != 0x80:
                return at + j, n + inner[j]
        return at, n


def _steps(counts: list[int]) -> bytes:
    steps = list(map(int.__sub__, counts[1:], counts))
    try:
        return array("b", steps).tobytes()
    except OverflowError:
        raise _Wide from None


def counts_of(row: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters from a stored row."""
    return np.cumsum(np.frombuffer(row, np.int8 if row[0] == 1 else np.int32, offset=1), dtype=np.int64)


_MADE: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    if path not in _MADE:
        _MADE[path] = Prefixes(path)
    return _MADE[path]


def _write(path: str):
    def run(batches):
        work = prefixes(path)
        for batch in batches:
            rows = [work.row(x) if x else b"\x01" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:]], ["counts", *batch.schema.names[1:]])
    return run


def _answer(limit: int):
    def run(batches):
        for batch in batches:
            total, fits = [], []
            for row in batch.column(0):
                c = counts_of(row.as_buffer().to_pybytes())
                within = np.flatnonzero(c <= limit)
                total.append(int(c[-1]) if len(c) else 0)
                fits.append(int(within[-1]) + 1 if len(within) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(fits, pa.int64()), *batch.columns[1:]],
                                             ["n_tokens", "fits_chars", *batch.schema.names[1:]])
    return run


def _tables(path: str, budget: int):
    def run(batches):
        work = prefixes(path)
        for batch in batches:
            got = [(work.table(x), work.cut(x, budget)) if x else (([], []), (0, 0)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[0] for t, _ in got], pa.list_(pa.int64())), pa.array([t[1] for t, _ in got], pa.list_(pa.int64())),
                 pa.array([c[0] for _, c in got], pa.int64()), pa.array([c[1] for _, c in got], pa.int64()), *batch.columns[1:]],
                ["piece_end", "tokens_to", "cut_bytes", "cut_tokens", *batch.schema.names[1:]])
    return run


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """The stored table: doc_id, n_bytes, counts (see the module; NULL text: no prefix)."""
    ready(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("__text"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    return stored(rows.mapInArrow(_write(path), "counts binary, doc_id long, n_bytes long"), "prefix-counts")


def budgets(table: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars of every row of a stored table.

    ``fits_chars``: the characters of the longest prefix of at most ``limit`` tokens."""
    out = table.select("counts", "doc_id", "n_bytes").mapInArrow(_answer(limit), "n_tokens long, fits_chars long, doc_id long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars of every row, from the stored prefix counts.

    Defined results: a NULL or empty text has 0 bytes and 0 tokens; repeated rows get equal
    answers; special strings inside a text count as the library's default has them (one token)."""
    return budgets(prefix_counts(docs, path), limit)


def prefix_table(docs: DataFrame, path: str, budget: int = 1024) -> DataFrame:
    """The stored form: doc_id, piece_end (bytes), tokens_to (tokens up to there), and the cut
    (cut_bytes, cut_tokens) of the longest prefix within ``budget`` tokens.  NULL text: empty arrays."""
    ready(docs.sparkSession)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_tables(path, budget), "piece_end array<long>, tokens_to array<long>, cut_bytes long, cut_tokens long, doc_id long")
