"""Secret scans: fixed patterns, and a randomness test battery for strings without a known form.

The battery looks at every maximal run of token characters, and at its parts between separators.  The
encoding is inferred from the characters (decimal, hex, letters of one or both cases, base 32, base 64
or its URL form, alphanumeric).  Its three tests are asked twice.

Against uniform characters (``battery``) they must not reject: chi-squared over the alphabet (in equal bins,
so that short runs are tested fairly), the number of runs above and below the alphabet's middle, and the
serial correlation of neighbours.  Words pass these when they are short, so this is only a gate.

Against language (``discovery_p``) they make the discovery.  Chi-squared is the contrast of its
likelihood-ratio form: G against language less G against uniform, which is twice the sum of ln(uniform / language)
over the characters, letters and digits each within their kind and without regard to case.  The runs are
those of character classes (digit, capital, small; a capital followed by a small letter is no change, nor is a
separator), by a binomial tail.  The serial correlation is that of the contrast between neighbouring
letters.  Mean and variance of these under language come from the table's own words shorter than a
candidate (``language``), and are never taken narrower than those of ``LETTERS`` and ``DIGITS``, so a small or
odd table makes the tests weaker, not wrong.  The p-value is the least of the tests', each over its share of
``SHARES`` (Bonferroni); where characters mix, contrast and runs also count together (Fisher).  It falls with length,
so short runs cannot be discovered by luck.  Benjamini and Hochberg's rule over all candidates of the whole
table then bounds the false-discovery rate: a histogram of log p-values gives the one threshold, however
many candidates there are.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm import arrays as A
from panelspark.llm.scratch import ready, task_input, task_output, task_text

MIN_RUN = 20                     # characters of a candidate
CHANGE = 0.08                    # class changes a neighbour pair in words, at least
WINDOW = 32                      # characters of a window of language
SPREAD = 1.5                     # variance of a window of words against independent characters, at least
REJECT = 1e-4                    # a battery test below this rejects randomness
FDR = 1e-3                       # false-discovery rate over all candidates of the table
_BIN = 0.05                      # width of a log10 p-value bin
_MOST = 300.0                    # larger -log10 p-values share the last bin

# Fixed patterns.  Characters are ASCII, so they run on bytes.
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")

_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 95, 45]] = True
_CLASS = np.zeros(256, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
#: Alphabets in the order they are tried; a run's encoding is the first that holds all its characters.
ALPHABETS = {"decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz",
             "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "lower36": "0123456789abcdefghijklmnopqrstuvwxyz", "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}


def byte_runs(data: np.ndarray, off: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of member bytes of at least ``least``, never across rows."""
    s, e, _ = A.word_spans(data, off, ~member)
    long = e - s >= least
    return s[long], e[long]


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty's cube root)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: bytes) -> tuple[str | None, float]:
    """(encoding, least p-value of the three randomness tests); (None, 0) where no alphabet holds the run."""
    text = run.decode("ascii")
    for name, alphabet in ALPHABETS.items():
        if set(text) <= set(alphabet):
            break
    else:
        return None, 0.0
    n, size = len(text), len(alphabet)
    v = np.array([alphabet.index(c) for c in text], float)
    bins = max(2, min(size, n // 5))                                       # five expected a bin
    edges = np.bincount((np.arange(size) * bins) // size, minlength=bins) / size
    got = np.bincount((v.astype(int) * bins) // size, minlength=bins)
    chi = _chi2_tail(float(((got - n * edges) ** 2 / (n * edges)).sum()), bins - 1)
    high = v >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if not a or not b:
        return name, 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    w = v - v.mean()
    serial = float((w[1:] * w[:-1]).sum() / max((w * w).sum(), 1e-9)) + 1 / n
    return name, min(chi, _two_sided((runs - mean) / math.sqrt(max(var, 1e-9))), _two_sided(serial * math.sqrt(n)))


#: Per cent of a to z in European languages, and of 0 to 9 in the numbers of texts.
LETTERS = (8.2, 1.6, 3.0, 4.2, 13.5, 1.7, 2.0, 4.2, 7.4, 0.5, 0.9, 4.2, 2.6, 7.6, 6.6, 2.2, 0.5, 6.6, 6.9, 7.8, 3.6, 1.3, 1.5, 0.5, 1.2, 0.7)
DIGITS = (22, 19, 13, 8, 7, 9, 6, 5, 5, 6)
_UNIT = 64                       # the contrast in whole units, so that sums over tasks are exact


def _contrast(freq) -> tuple[np.ndarray, float, float]:
    """(ln(uniform / language) of every character in units, its mean and variance under language)."""
    p = np.array(freq, float) / sum(freq)
    w = np.round(np.log(1 / len(p) / p) * _UNIT)
    return w, float((p * w).sum()), float((p * w * w).sum() - (p * w).sum() ** 2)


#: What each test may use of the error, by encoding: runs say nothing within one class, and little but runs tells hex from words.
SHARES = {**dict.fromkeys(("decimal", "lower", "upper"), {"contrast": 0.95, "serial": 0.05}),
          **dict.fromkeys(("hex", "HEX"), {"runs": 0.99, "contrast": 0.01})}
MIXED = {"both": 0.6, "runs": 0.35, "serial": 0.05}
_KINDS = {"letters": _contrast(LETTERS), "hex": _contrast(LETTERS[:6]), "digits": _contrast(DIGITS)}
_FOLD = np.full(256, -1, np.int64)
_FOLD[65:91], _FOLD[97:123] = np.arange(26), np.arange(26)
_DIGIT = np.full(256, -1, np.int64)
_DIGIT[48:58] = np.arange(10)


def _codes(data: np.ndarray, kind: str) -> np.ndarray:
    """The characters of a kind in their order; the others are left out."""
    c = (_DIGIT if kind == "digits" else _FOLD)[data]
    return c[(c >= 0) & (c < 6)] if kind == "hex" else c[c >= 0]


def _serial(x: np.ndarray) -> np.ndarray:
    """Serial correlation of each row."""
    y = x - x.mean(axis=1, keepdims=True)
    return (y[:, 1:] * y[:, :-1]).sum(axis=1) / np.maximum((y * y).sum(axis=1), 1e-9)


def _changes(c: np.ndarray) -> np.ndarray:
    """Neighbour pairs that change their class: a capital before small letters begins a word, a separator parts two."""
    a, b = c[:-1], c[1:]
    return (a != b) & (a > 0) & (b > 0) & ~((a == 2) & (b == 3))


def _language(batches):
    """Per task: how many, sum and sum of squares of each statistic over the windows of its short words."""
    sums = {k: [0, 0, 0] for k in (*_KINDS, "serial", "changes")}
    for batch in batches:
        data, off = A.text_buffers(batch.column(0))
        for a, b in A.blocks(off):
            d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            s, e, _ = A.word_spans(d, o, ~_TOKEN)
            short = e - s < MIN_RUN
            s, e = s[short], e[short]
            step = np.zeros(len(d) + 1, np.int64)
            step[s] += 1
            step[e] -= 1
            word = np.cumsum(step[:-1]) > 0
            sums["changes"][0] += int((e - s - 1).sum())
            sums["changes"][1] += int((_changes(_CLASS[d]) & word[1:] & word[:-1]).sum()) if len(d) else 0
            for kind, (w, _, _) in _KINDS.items():
                x = w[_codes(d[word], kind)]
                x = x[:len(x) // WINDOW * WINDOW].reshape(-1, WINDOW)
                tests = {kind: x.sum(axis=1)}
                if kind == "letters" and len(x):
                    tests["serial"] = np.round(_serial(x) * 1000)
                for name, v in tests.items():
                    v = v.astype(np.int64)
                    sums[name] = [sums[name][0] + len(v), sums[name][1] + int(v.sum()), sums[name][2] + int((v * v).sum())]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *[pa.array([x[i] for x in sums.values()], pa.int64()) for i in range(3)]],
                                     ["test", "n", "s", "q"])


def language(docs: DataFrame | None = None) -> dict[str, tuple[float, float]]:
    """The null: (mean, variance) a character of the contrast of letters, of hex letters and of digits, (mean,
    variance times length) of the letters' serial correlation, and (rate, 0) of class changes.  Five rows reach the driver."""
    found = {}
    if docs is not None:
        rows = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(_language, "test string, n long, s long, q long")
        total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "nsq"]
        found = {r["test"]: tuple(float(r[c]) for c in "nsq") for r in rows.groupBy("test").agg(*total).collect()}
    out = {}
    for kind, (_, mean, var) in _KINDS.items():
        n, s, q = found.get(kind, (0, 0, 0))
        out[kind] = (mean, SPREAD * var)
        if n > 1:
            out[kind] = (max(mean, s / n / WINDOW), max(SPREAD * var, (q / n - (s / n) ** 2) / WINDOW))
    n, s, q = found.get("serial", (0, 0, 0))
    out["serial"] = (s / n / 1000, max(1.0, (q / n - (s / n) ** 2) / 1e6 * WINDOW)) if n > 1 else (0.0, 1.0)
    n, s, _ = found.get("changes", (0, 0, 0))
    out["changes"] = (min(max(CHANGE, s / n if n else 0), 0.5), 0.0)
    return out


def _log_tail(z: float) -> float:
    """-log10 of the normal upper tail."""
    if z > 35:
        return min((z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10), _MOST)
    return -math.log10(0.5 * math.erfc(z / math.sqrt(2)))


def runs_p(run: bytes, rate: float = CHANGE) -> float:
    """-log10 of the chance that words show as many class changes in a run of this length."""
    n, k = len(run) - 1, int(_changes(_CLASS[np.frombuffer(run, np.uint8)]).sum())
    if k == 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
            for i in range(k, n + 1)]
    top = max(logs)
    return min(max(-(top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10), 0.0), _MOST)


def discovery_p(run: bytes, encoding: str, null: dict) -> float:
    """-log10 of the battery's p-value under language."""
    d = np.frombuffer(run, np.uint8)
    kinds = ["hex" if encoding in ("hex", "HEX") else "letters"] + (["digits"] if encoding != "base32" else [])
    got = mean = var = 0.0
    for kind in kinds:
        w = _KINDS[kind][0][_codes(d, kind)]
        got, mean, var = got + w.sum(), mean + len(w) * null[kind][0], var + len(w) * null[kind][1]
    tests = {"contrast": _log_tail((got - mean) / math.sqrt(var)) if var else 0.0, "runs": runs_p(run, null["changes"][0]), "serial": 0.0}
    both = tests["contrast"] + tests["runs"]                                # given the classes, the two are independent
    tests["both"] = both - math.log10(1 + both * math.log(10))
    x = _KINDS["letters"][0][_codes(d, "letters")]
    (mu, spread), n = null["serial"], len(x)
    if n >= MIN_RUN and mu:                                                 # from language's correlation towards none
        tests["serial"] = _log_tail((float(_serial(x[None])[0]) - mu) * -math.copysign(1, mu) / math.sqrt(spread / n))
    return min(max(0.0, *(tests[k] + math.log10(share) for k, share in SHARES.get(encoding, MIXED).items())), _MOST)


_PARTS = re.compile(rb"[A-Za-z0-9]+")


def _tested(text: bytes, spans) -> list[list[tuple[int, int]]]:
    """Per run: the run, then its parts between separators that are long enough."""
    out = []
    for s, e in spans:
        parts = [(s + m.start(), s + m.end()) for m in _PARTS.finditer(text[s:e]) if m.end() - m.start() >= MIN_RUN]
        out.append([(s, e), *[x for x in parts if x != (s, e)]])
    return out


def _candidates(text: bytes, spans, null: dict) -> list[tuple[int, int, float]]:
    """(start, end, discovery p-value) of runs and parts that the battery leaves as random."""
    out = []
    for s, e in spans:
        encoding, uniform = battery(text[s:e])
        if uniform >= REJECT:
            p = discovery_p(text[s:e], encoding, null)
            if p > 0:
                out.append((s, e, p))
    return out


def base_spans(text: bytes, hexes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in byte offsets."""
    out = [(s, 2, e) for s, e in hexes]
    if b"=" in text or b":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def _per_row(d: np.ndarray, o: np.ndarray, member: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    s, e = byte_runs(d, o, member, least)
    out = [[] for _ in range(len(o) - 1)]
    for r, a, b in zip((np.searchsorted(o, s, side="right") - 1).tolist(), s.tolist(), e.tolist()):
        out[r].append((a - int(o[r]), b - int(o[r])))
    return out


def _texts(col: pa.Array):
    """(text bytes, hex runs, token runs) of each row, block by block."""
    data, off = A.text_buffers(col)
    for a, b in A.blocks(off):
        d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        raw = d.tobytes()
        yield from zip([raw[x:y] for x, y in zip(o[:-1].tolist(), o[1:].tolist())], _per_row(d, o, _HEX, 32), _per_row(d, o, _TOKEN, MIN_RUN))


def _histogram(null: dict):
    """Per task: candidates by p-value bin; bin -1 counts all runs and parts that were tested."""
    def run(batches):
        bins, tested = {}, 0
        for batch in batches:
            for text, _, tokens in _texts(batch.column(0)):
                for spans in _tested(text, tokens):
                    tested += len(spans)
                    for _, _, p in _candidates(text, spans, null):
                        b = int(p / _BIN)
                        bins[b] = bins.get(b, 0) + 1
        rows = [(-1, tested), *sorted(bins.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["bin", "n"])
    return run


def threshold(docs: DataFrame, fdr: float = FDR, null: dict | None = None) -> float:
    """The least -log10 p-value that Benjamini and Hochberg's rule accepts over all candidates of
    ``docs`` (infinite: none).  Runs that a test has rejected count as p = 1.  Reads a histogram of at
    most 6002 rows."""
    ready(docs.sparkSession)
    null = language(docs) if null is None else null
    rows = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(_histogram(null), "bin int, n long")
    bins = {b: n for b, n in rows.groupBy("bin").agg(F.sum("n")).collect()}
    total, seen, best = bins.pop(-1, 0), 0, math.inf
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if 10 ** (-b * _BIN) <= fdr * seen / max(total, 1):               # the bin's largest p-value
            best = b * _BIN
    return best


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _find(least: float, null: dict, mark: bytes | None):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            counts, shas, names, found, texts = [], [], [], [], []
            for text, hexes, tokens in _texts(task_text(batch)):
                base = base_spans(text, hexes)
                more = []
                for spans in _tested(text, tokens):
                    good = [(s, 3, e) for s, e, p in _candidates(text, spans, null)
                            if int(p / _BIN) * _BIN >= least and not any(x <= s and e <= y for x, _, y in base)]
                    more += good[:1] if good and (good[0][0], good[0][2]) == spans[0] else good      # a part of a discovery is none
                every = sorted(base + more)
                point, at, before = {}, 0, 0                                # byte offset -> code point offset
                for z in sorted({z for s, _, e in every for z in (s, e)}):
                    before += len(text[at:z].decode("utf-8", "replace"))
                    at, point[z] = z, before
                label = [f"{KINDS[k]}:{point[s]}:{point[e]}" for s, k, e in every]
                fixed = [x for x, (_, k, _) in zip(label, every) if k < 3]
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                shas.append(hashlib.sha256(",".join(fixed).encode()).hexdigest())
                names.append(",".join(label))
                found.append([{"kind": KINDS[k], "start": point[s], "end": point[e]} for s, k, e in every])
                if mark is not None:
                    at, parts = 0, []
                    for s, e in _merged((s, e) for s, _, e in every):
                        parts += [text[at:s], mark]
                        at = e
                    texts.append(b"".join([*parts, text[at:]]).decode("utf-8", "replace") if every else None)
            n = np.array(counts, np.int64).reshape(-1, 3)
            rest = batch.column(batch.schema.get_field_index("row" if mark is not None else "doc_id"))
            cols = [pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array(shas, pa.string()), pa.array(names, pa.string()),
                    pa.array(found, span), rest]
            head = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", "row" if mark is not None else "doc_id"]
            if mark is not None:
                cols, head = [*cols, pa.array(texts, pa.string())], [*head, "clean"]
            yield pa.RecordBatch.from_arrays(cols, head)
    return run


_FOUND = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "found array<struct<kind: string, start: bigint, end: bigint>>")


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found of every row.

    ``found`` lists all spans (code points, end exclusive), ``spans`` is their text.  A discovery
    inside a pattern's span is left out.  Defined results: a NULL or empty text has no spans;
    repeated rows get equal answers; without candidates nothing is discovered.  Texts and runs of
    any length are tested whole.  ``docs`` is read three times: for the null, the threshold and the spans."""
    ready(docs.sparkSession)
    null = language(docs)
    least = threshold(docs, fdr, null)
    out = docs.select(*task_input(docs, False)).mapInArrow(_find(least, null, None), f"{_FOUND}, {task_output(docs, False)}")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, with every found span of the text replaced by ``mark``
    (overlapping spans by one) and n_chars, where there is one, set to the new length."""
    ready(docs.sparkSession)
    null = language(docs)
    least = threshold(docs, fdr, null)
    out = docs.select(*task_input(docs, True)).mapInArrow(
        _find(least, null, mark.encode()), f"{_FOUND}, {task_output(docs, True)}, clean string")
    new = {"text": F.coalesce("clean", "row.text"),
           "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
