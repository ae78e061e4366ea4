"""Byte-level BPE helpers: independent segments of a text, cached work per segment, prefix counts.

A text may be cut before every single space that stands between two non-space characters: the
pre-tokeniser always starts a piece there, whatever surrounds it.  So the work on a segment (a
space and a word with its punctuation) can be cached and reused.  Texts with other spacing are
split by the pre-tokeniser's own rule.
"""

from __future__ import annotations

import json

import numpy as np

SEGMENT_CACHE = 300_000          # entries; the cache starts anew beyond it (memory, not results)
_LONG_SEGMENT = 64               # longer segments are worked on each time
_MOVES = 1 << 18                 # moves of the automaton kept besides its tree
_PLAIN = "԰"                # below this code point the split rule below agrees with every library version


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for b, c in zip(shown + rest, shown + [256 + i for i in range(len(rest))])}


class BpeFile:
    """A tokenizers JSON file: the library's tokenizer and its merge table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        import public_tokenizers
        import regex
        import tiktoken

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = spec["pre_tokenizer"]
        if plain.get("type") != "ByteLevel" or plain.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        as_byte = byte_symbols()
        to_bytes = lambda s: bytes(as_byte[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        size = max(self.ids.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge = {}
        for r, (a, b) in enumerate(merges):
            x, y = self.ids[to_bytes(a)], self.ids[to_bytes(b)]
            z = self.ids[to_bytes(a) + to_bytes(b)]
            self.merge[x << 20 | y] = r
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ids, special_tokens={})
        self.longest = max(map(len, self.ids))
        self.vocab_size = self.tokenizer.get_vocab_size()

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _PLAIN:
            return self.findall(text)
        # newer or unassigned characters: classes as this library version has them (offsets are exact)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special strings.  Plain texts go through the same vocabulary as
        ranks (equal ids, less work a call); all others through the library itself."""
        if text.isascii() or max(text) < _PLAIN:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Suffixes:
    """Aho-Corasick automaton of a vocabulary: the tokens that end at each byte of a string, longest first."""

    def __init__(self, ids: dict[bytes, int]):
        self.step: dict[int, int] = {}
        self.room = 0
        above, token, depth = [0], [-1], [0]
        for word, t in ids.items():
            node = 0
            for b in word:
                key = node << 8 | b
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = len(token)
                    above.append(key)
                    token.append(-1)
                    depth.append(depth[key >> 8] + 1)
            token[node] = t
        self.fail, self.ends = [0] * len(token), [()] * len(token)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            if depth[node] > 1:
                self.fail[node] = self.move(self.fail[above[node] >> 8], above[node] & 255)
            rest = self.ends[self.fail[node]]
            self.ends[node] = ((token[node], depth[node]), *rest) if token[node] >= 0 else rest
        self.room = len(self.step) + _MOVES

    def move(self, node: int, byte: int) -> int:
        """The state after one more byte: the longest suffix of the string that some token starts with."""
        at = node
        while True:
            got = self.step.get(at << 8 | byte)
            if got is not None or not at:
                break
            at = self.fail[at]
        if at != node and len(self.step) < self.room:            # kept, so that the next time is one look
            self.step[node << 8 | byte] = got or 0
        return got or 0


class PrefixCounter:
    """Exact token counts of every prefix of a piece, by dynamic programming.

    For each prefix only the last token of its encoding is stored.  The prefix that ends at i ends
    in the one vocabulary token t for which the encoding of the prefix before t, followed by t,
    leaves the border between the two untouched; ``count[i] = count[i - len(t)] + 1``."""

    def __init__(self, bpe: BpeFile):
        self.bpe = bpe
        self._apart: dict[int, bool] = {}
        self._suffixes: Suffixes | None = None

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a, b together gives exactly a, b."""
        key = a << 20 | b
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            got = self._apart[key] = self._undo(a, b)
        return got

    def _undo(self, a: int, b: int) -> bool:
        """Undo the merges inside a and b from the last to the first and look at the two tokens at
        the border each time: had they merged before the merge just undone, the border would go."""
        rank, merge, limit = self.bpe.rank, self.bpe.merge, 1 << 60
        while True:
            m = merge.get(a << 20 | b)
            if m is not None and m < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.bpe.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.bpe.left[b]
            else:
                return True

    def _last(self, piece: bytes, i: int, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """(last token, token count) of the encoding of piece[:i]; ``known`` is the table so far."""
        got = known.get(i)
        if got is None:
            ids = self.bpe.ids
            for j in range(max(0, i - self.bpe.longest), i):
                t = ids.get(piece[j:i])
                if t is not None:
                    if not j:
                        got = (t, 1)
                        break
                    last, n = known.get(j) or self._last(piece, j, known)
                    if self.apart(last, t):
                        got = (t, n + 1)
                        break
            known[i] = got
        return got

    def counts(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ..., piece."""
        if self._suffixes is None:
            self._suffixes = Suffixes(self.bpe.ids)
        step, move, ends = self._suffixes.step, self._suffixes.move, self._suffixes.ends
        known, apart, node = self._apart, self.apart, 0
        last, count = [-1], [0]
        for i, byte in enumerate(piece, 1):
            after = step.get(node << 8 | byte)
            node = move(node, byte) if after is None else after
            for t, size in ends[node]:
                j = i - size
                if not j:
                    break
                border = known.get(last[j] << 20 | t)
                if border or border is None and apart(last[j], t):
                    break
            last.append(t)
            count.append(count[j] + 1)
        return count

    def total(self, piece: bytes) -> int:
        """Token count of the piece; only the prefixes that its last tokens lead to are looked at."""
        known: dict[int, tuple[int, int]] = {}
        if len(piece) > 256:                       # fill the table from the front: no deep recursion
            for i in range(1, len(piece)):
                self._last(piece, i, known)
        return self._last(piece, len(piece), known)[1] if piece else 0


class SegmentCache(dict):
    """Segment (without its space) -> ``work(segment with its space)``; None where the text around matters.

    Two generations: when the younger is full it becomes the older one, so frequent segments stay."""

    def __init__(self, work, room: int | None = None):
        super().__init__()
        self.work, self.older, self.room = work, {}, room

    def __missing__(self, part: str):
        got = self.older.get(part)
        if got is None:
            if not part or part[0].isspace() or part[-1].isspace():
                return None
            got = self.work(" " + part)
            if len(part) > _LONG_SEGMENT:
                return got
        if len(self) >= (self.room or SEGMENT_CACHE):
            self.older = self.copy()
            self.clear()
        self[part] = got
        return got


class TextWork:
    """Per-text results put together from segments: ``whole(text)`` gives the parts' results in order."""

    def __init__(self, bpe: BpeFile, work, special_result, room: int | None = None):
        """``work``: result of a string without special strings; ``special_result``: of a special string;
        ``room``: entries of the cache, if not SEGMENT_CACHE."""
        self.bpe, self.work, self.special_result = bpe, work, special_result
        self.cache = SegmentCache(work, room)

    def _plain(self, text: str) -> list:
        first, *rest = text.split(" ")
        got = list(map(self.cache.__getitem__, rest))
        if first and not first[-1].isspace() and None not in got:
            return [self.work(first), *got]
        return [self.work(text)]

    def whole(self, text: str) -> list:
        for s in self.bpe.special:
            if s in text:
                parts = text.split(s) if len(self.bpe.special) == 1 else None
                if parts is None:
                    raise ValueError("a file with one special string is supported")
                out = []
                for i, p in enumerate(parts):
                    if i:
                        out.append(self.special_result(s))
                    if p:
                        out += self._plain(p)
                return out
        return self._plain(text) if text else []


_LOADED: dict[str, BpeFile] = {}


def load(path: str) -> BpeFile:
    """The file's tokenizer, read once in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = BpeFile(path)
    return _LOADED[path]


def id_type(bpe: BpeFile) -> np.dtype:
    """The smallest unsigned type for the file's ids."""
    return np.dtype("<u2") if bpe.vocab_size <= 1 << 16 else np.dtype("<u4")
