"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters is bound
into one vector: the first letter's vector shifted twice, times the second's
shifted once, times the third's. A text is the bundle (sum) of its trigrams'
vectors, a language the bundle of its training texts; the language of a text is
the prototype with the largest cosine once the mean prototype, which all
languages share, is taken out.

A trigram's vector is the same wherever it stands, so a batch counts its
distinct trigrams first and bundles by one matrix product. Prototypes are whole
numbers summed in two steps (per task, then per language), so any partitioning
gives the same ones. Their size is the number of languages times the dimension.

A null text or one without a letter is ``und`` with score 0; without any
training text every document is ``und``; rows with a null language do not
train; ties take the first language in order; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

DIMENSION = 1_024
SEED = 20
#: Letters a-z have symbols of their own, other letters share the remaining ones by code point.
SYMBOLS = 128
#: Cosines are turned into a score by a softmax of this sharpness.
SHARPNESS = 12.0
UNKNOWN = "und"
#: Cosine to the nearest prototype below which a text is in none of the languages: one standard deviation of what
#: unrelated vectors of this dimension show. Texts of one or two words lie near 0.1, longer ones above 0.3.
LEAST_COSINE = 0.03
SLICE = 3_000_000
#: Bytes of text whose trigrams are held at once, what a text's own counts weigh among them, and trigrams whose vectors
#: are made at once: all bound a worker's memory, sums are whole numbers either way.
TRIGRAM_SLICE = 1_000_000
ROW_BYTES = 600
GRAMS = 1_024


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=4)
def _letters(dimension: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimension))


def gram_vectors(grams: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """The bound vectors of trigram codes."""
    v = _letters(dimension, seed)
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram code) of every trigram, and which texts have a letter. Runs of other characters count as one blank, as do both ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    symbol = _symbols()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0  # the first blank after a letter stays
    keep[np.cumsum(lengths) - lengths] = True
    symbol, owner = symbol[keep].astype(np.int32), owner[keep]
    if len(symbol) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(len(texts), bool)
    whole = (owner[:-2] == owner[2:]) & (symbol[1:-1] > 0)
    code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    has = np.bincount(owner[symbol > 0], minlength=len(texts)) > 0
    return owner[:-2][whole], code[whole], has


def bundles(owner: np.ndarray, code: np.ndarray, n: int, dimension: int, seed: int) -> np.ndarray:
    """(n, dimension) sums of the vectors of each owner's trigrams."""
    out = np.zeros((n, dimension), np.float32)
    if not len(code):
        return out
    seen = np.zeros(SYMBOLS**3, bool)
    seen[code] = True
    grams = np.flatnonzero(seen)
    place = np.zeros(SYMBOLS**3, np.int32)
    place[grams] = np.arange(len(grams))
    column = place[code]
    for a in range(0, len(grams), GRAMS):  # bounds the matrices
        some = (column >= a) & (column < a + GRAMS) if len(grams) > GRAMS else slice(None)
        width = min(GRAMS, len(grams) - a)
        counts = np.bincount(owner[some].astype(np.int64) * width + (column[some] - a), minlength=n * width)
        out += counts.reshape(n, width).astype(np.float32) @ gram_vectors(grams[a:a + width], dimension, seed)
    return out


def train(docs: DataFrame, use: Column, dimension: int = DIMENSION, seed: int = SEED, text_col: str = "text",
          lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows for which ``use`` holds."""
    rows = docs.filter(use).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", TRIGRAM_SLICE):
                names = part["lang"].dictionary_encode()
                which = names.indices.to_numpy(zero_copy_only=False)
                owner, code, _ = trigrams(part["text"])
                for i, name in enumerate(names.dictionary.to_pylist()):
                    mine = code[which[owner] == i]
                    one = np.rint(bundles(np.zeros(len(mine), np.int32), mine, 1, dimension, seed)[0].astype(np.float64)).astype(np.int64)
                    total[name] = total.get(name, 0) + one
        for name, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dimension), "i": pa.array(np.arange(dimension, dtype=np.int32)), "v": pa.array(v)})

    table = rows.mapInArrow(sums, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).toArrow()
    out: dict[str, np.ndarray] = {}
    for lang, i, v in zip(table["lang"].to_pylist(), table["i"].to_pylist(), table["v"].to_pylist(), strict=True):
        out.setdefault(lang, np.zeros(dimension))[i] = v
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimension: int = DIMENSION, seed: int = SEED,
            text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``lang_pred``, ``score`` (0 to 1) and ``cosine`` (of the raw prototype)."""
    carry = carry or ["doc_id"]
    return _predicted(docs, prototypes, dimension, seed, text_col, carry).select(
        *[F.col("_keep")[c].alias(c) for c in carry], "lang_pred", "score", "cosine")


def _predicted(docs: DataFrame, prototypes: dict[str, np.ndarray], dimension: int, seed: int, text_col: str, carry: list[str]) -> DataFrame:
    """``_keep`` (the carried columns) with the prediction. A text that is carried goes to the workers once."""
    names = list(prototypes)
    raw = np.array([prototypes[n] / max(1.0, np.linalg.norm(prototypes[n])) for n in names], np.float32).reshape(len(names), dimension)
    mean = raw.mean(0) if len(names) > 1 else np.zeros(dimension, np.float32)
    centred = raw - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    carried = carry.index(text_col) if text_col in carry else None
    rows = docs.select(F.struct(*carry).alias("_keep"), *([F.col(text_col).alias("_text")] if carried is None else []))
    kind = rows.schema["_keep"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if carried is not None:
                batch = pa.RecordBatch.from_arrays([batch["_keep"], batch["_keep"].field(carried)], ["_keep", "_text"])
            for part in slices(batch, "_text", SLICE):
                n, at = part.num_rows, 0
                vectors, has = np.empty((n, dimension), np.float32), np.empty(n, bool)
                for piece in slices(part, "_text", TRIGRAM_SLICE, ROW_BYTES):
                    end = at + piece.num_rows
                    owner, code, has[at:end] = trigrams(piece["_text"])
                    vectors[at:end] = bundles(owner, code, end - at, dimension, seed)
                    at = end
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                if names:
                    cosine = vectors @ raw.T
                    own = vectors - mean
                    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                    z = SHARPNESS * (own @ centred.T).astype(np.float64)
                    best = z.argmax(1)
                    p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                    cos = cosine[np.arange(n), best].astype(np.float64)
                    pred = [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                else:
                    pred, p, cos, has = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [part["_keep"], pa.array(pred, pa.string()), pa.array(np.where(has, np.clip(p, 0, 1), 0.0)), pa.array(np.where(has, cos, 0.0))],
                    ["_keep", "lang_pred", "score", "cosine"])

    return rows.mapInArrow(score, f"_keep {kind}, lang_pred string, score double, cosine double")


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = LEAST_COSINE) -> DataFrame:
    """The documents in one of the learned languages: not ``und``, and as near to its prototype as ``least``."""
    cols = docs.columns
    found = _predicted(docs, prototypes, DIMENSION, SEED, "text", cols)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("cosine") >= least)).select(*[F.col("_keep")[c].alias(c) for c in cols])
