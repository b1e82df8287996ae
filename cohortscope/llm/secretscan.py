"""Secret scanning: fixed formats, and a battery of randomness tests for the rest.

Runs of 20 or more characters of the usual encodings are candidates ("=" ends a
run, as padding or between a name and its value), and so are their maximal
parts between "/", "_" and "-", for each choice of these three as separators: a
path's segment may be base64url, a name's suffix base64. For each, the encoding is inferred (hexadecimal, base32, letters and digits, base64) and
three tests ask whether it looks drawn at random from that alphabet:
chi-squared uniformity, the number of runs above and below the alphabet's
middle, and serial correlation of neighbours. A candidate that fails one is no
secret. For the others the likelihood ratio of the uniform alphabet against
the corpus's own character frequencies is tested: by Markov's inequality its
inverse is a valid p-value of "this is ordinary text", and it falls with the
length. Benjamini and Hochberg's step-up rule is applied within classes of
length, over all candidates of the corpus, on a histogram of the p-values whose
bins are rounded to the cautious side. Of accepted candidates that overlap
the one with the least p-value is the span (of equal ones the longest). Three scans: character frequencies,
p-values, spans. Nothing but the counts reaches the driver.

Null and empty texts have no spans; repeated rows and ids give one row each;
equal starts are ordered by kind; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "random")
#: The fixed formats (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:=++(?![A-Za-z0-9+/_-]))?+")
LEAST = 20
#: Parts of a candidate: the runs without the separators chosen, padding included.
PARTS = {chosen: re.compile(f"[^{chosen}]{{16,}}+".replace("-", r"\-")) for n in (1, 2, 3) for chosen in map("".join, itertools.combinations("/_-", n))}
GATES = {"assign": "(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "random": "[A-Za-z0-9+/_=-]{20}"}
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
ALPHABETS = (("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("alnum", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("alnum", SYMBOLS[:62]), ("base64", SYMBOLS[:64]), ("base64url", SYMBOLS[:62] + "-_"), ("base64", SYMBOLS))
LEVEL = 1e-3
FALSE_DISCOVERIES = 0.01
BIN = 0.25  # of -log10 p
LENGTHS = (32, 64, 128)  # classes: below 32, below 64, below 128, the rest


def infer(text: str) -> tuple[str, str] | None:
    """(encoding, alphabet): the smallest alphabet that holds all characters; None for words and numbers."""
    have = set(text)
    if not have or not any(c.isdigit() for c in have) or not any(c.isalpha() for c in have):
        return None
    return next(((n, a) for n, a in ALPHABETS if have <= set(a)), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(index: np.ndarray, k: int) -> float:
    """Upper tail of the uniformity statistic (Wilson and Hilferty's approximation)."""
    n = len(index)
    x = float(((np.bincount(index, minlength=k) - n / k) ** 2).sum() * k / n)
    d = k - 1
    return _normal_tail(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def runs(index: np.ndarray, k: int) -> float:
    """Two-sided p of the number of runs above and below the alphabet's middle."""
    high = index * 2 >= k
    a = int(high.sum())
    b = len(high) - a
    if not a or not b:
        return 2.0 ** (1 - len(high))
    mean = 2 * a * b / (a + b) + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (a + b - 1), 1e-9))
    return 2 * _normal_tail(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / spread)


def serial(index: np.ndarray) -> float:
    """Two-sided p of the correlation of neighbours."""
    x = index - index.mean()
    v = float((x * x).sum())
    return 0.0 if not v else 2 * _normal_tail(abs(float((x[1:] * x[:-1]).sum()) / v * math.sqrt(len(x))))


def text_p(token: str, frequencies: dict[str, float]) -> float | None:
    """p-value of "ordinary text" for a candidate that passes the battery; 1 for one that fails; None if it has no encoding."""
    body = token.rstrip("=")
    found = infer(body)
    if found is None or len(body) < 16:
        return None
    alphabet = found[1]
    place = {c: i for i, c in enumerate(alphabet)}
    index = np.fromiter((place[c] for c in body), np.int64, len(body))
    if min(chi_squared(index, len(alphabet)), runs(index, len(alphabet)), serial(index)) < LEVEL:
        return 1.0
    ratio = -len(body) * math.log(len(alphabet)) - sum(math.log(frequencies[c]) for c in body)
    return math.exp(-max(0.0, ratio))


def length_class(token: str) -> int:
    return sum(len(token) >= n for n in LENGTHS)


def base_spans(text: str, gates: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats."""
    out = []
    if gates[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if gates[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if gates[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of candidate runs and of their parts that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        spans, here = {m.span()}, {c for c in "/_-" if c in m[0]}
        for chosen, pattern in PARTS.items() if here else ():
            if here.issuperset(chosen):  # a separator that does not occur parts nothing
                spans.update(p.span() for p in pattern.finditer(text, *m.span()))
        near = [(a, b) for a, _, b in base if a < m.end() and m.start() < b]
        out += [s for s in sorted(spans) if s[1] - s[0] >= LEAST and not any(a < s[1] and s[0] < b for a, b in near)]
    return out


def best_apart(found: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Spans of accepted (p, start, end): the least p first, of equal ones the longest; none overlaps one before it."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if all(b <= c or d <= a for c, d in out):
            out.append((a, b))
    return out


def _gated(part: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Texts in which some pattern can match, with base spans and candidates."""
    gate = {k: pc.fill_null(pc.match_substring_regex(part["_text"], g), False).to_numpy(zero_copy_only=False) for k, g in GATES.items()}
    for i in np.flatnonzero(np.logical_or.reduce(list(gate.values()))).tolist():
        text = part["_text"][i].as_py()
        base = base_spans(text, (gate["assign"][i], gate["access"][i], gate["hex"][i]))
        yield i, text, base, candidates(text, base) if gate["random"][i] else []


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Share of each symbol among the symbols of all texts, add-one smoothed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                raw = "".join(filter(None, part["_text"].to_pylist())).encode("utf-8", "surrogatepass")
                n += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(list(SYMBOLS)), "n": pa.array([int(n[ord(c)]) for c in SYMBOLS])})

    found = dict(docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "symbol string, n long").groupBy("symbol").agg(F.sum("n")).collect())
    total = sum(found.values()) + len(SYMBOLS)
    return {c: (found.get(c, 0) + 1) / total for c in SYMBOLS}


def thresholds(docs: DataFrame, share: dict[str, float], level: float = FALSE_DISCOVERIES, text_col: str = "text") -> dict[int, float]:
    """For each class of length, the largest p-value that the step-up rule accepts (0 if none)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                for _, text, _, found in _gated(part):
                    for a, b in found:
                        p = text_p(text[a:b], share)
                        if p is not None:
                            key = length_class(text[a:b]), min(400, math.floor(-math.log10(max(p, 1e-300)) / BIN))
                            n[key] = n.get(key, 0) + 1
        if n:
            yield pa.RecordBatch.from_pydict({"cls": pa.array([k[0] for k in n], pa.int32()), "bin": pa.array([k[1] for k in n], pa.int32()), "n": pa.array(list(n.values()), pa.int64())})

    rows = (docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "cls int, bin int, n long").groupBy("cls", "bin").agg(F.sum("n").alias("n")).collect())
    out = {c: 0.0 for c in range(len(LENGTHS) + 1)}
    for c in out:
        mine = sorted(((r["bin"], r["n"]) for r in rows if r["cls"] == c), reverse=True)
        total, below = sum(n for _, n in mine), 0
        for b, n in mine:
            below += n
            edge = 10 ** (-b * BIN)  # the largest p of the bin
            if edge <= level * below / total:
                out[c] = edge
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (the id) with ``found``: array of (kind, start, end) by start, then kind; offsets in code points."""
    carry = carry or [id_col]
    return _scanned(docs, text_col, carry).select(*[F.col("_keep")[c].alias(c) for c in carry], "found")


def _scanned(docs: DataFrame, text_col: str, carry: list[str], with_text: bool = False) -> DataFrame:
    """``_keep`` (the carried columns), ``found`` and, if asked for, ``scanned_text``."""
    share = frequencies(docs, text_col)
    accept = thresholds(docs, share, text_col=text_col)
    rows = docs.select(F.struct(*carry).alias("_keep"), F.col(text_col).alias("_text"))
    kind = rows.schema["_keep"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i, text, base, found in _gated(part):
                    good = [(p, a, b) for a, b in found if (p := text_p(text[a:b], share)) is not None and p <= accept[length_class(text[a:b])]]
                    more = [(a, 3, b) for a, b in best_apart(good)]
                    spans[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + more)]
                out = {"_keep": part["_keep"], "found": pa.array(spans, pa.list_(item))} | ({"scanned_text": part["_text"]} if with_text else {})
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(find, f"_keep {kind}, found array<struct<kind:string,start:int,end:int>>" + ", scanned_text string" * with_text)


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans, one row per document."""
    base = F.filter("found", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    done = F.aggregate(
        found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced in ``text``; all other columns as they were."""
    cols = docs.columns
    rest = [c for c in cols if c != "text"]
    text = F.when(F.col("scanned_text").isNotNull(), redacted(F.col("scanned_text"), F.col("found")))
    return _scanned(docs, "text", rest, with_text=True).select(*[text.alias("text") if c == "text" else F.col("_keep")[c].alias(c) for c in cols])
