"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of word tokens (lower case, runs
of letters and digits). Seeds are the items' runs of ``least`` tokens; a
document and an item that share a seed are a candidate pair. For each pair the
greedy tiling marks the longest matches that do not overlap, longest first,
down to ``least`` tokens; equal runs are found by Karp-Rabin hashes of running
length. A document is contaminated by an item when the tiles cover ``coverage``
of the item: the order of the tiles does not matter, so reordered passages
count.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each
broadcast and run against all documents. Null, empty and shorter items and
documents never match; repeated rows give repeated rows; extra columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rolling, slices, word_hashes

LEAST = 5
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20


def _plain(texts: pa.Array) -> pa.Array:
    """Lower case, with a space for every ASCII character that is neither letter nor digit."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[!-/:-@\[-`{-~]+", " ")


def _windows(tokens: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of unmarked tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    start = np.flatnonzero(taken[width:] == taken[:n])
    return start, rolling(tokens, width)[start]


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of two token sequences, longest first, none overlapping."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        si, hi = _windows(item, free_i, width)
        st, ht = _windows(text, free_t, width)
        return si, hi, st, ht, np.intersect1d(hi, ht)

    longest = min(len(item), len(text))
    while longest >= least and len(common(least)[4]):
        low, high = least, longest  # a common run of a length has common runs of every lesser one
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[4]) else (low, middle - 1)
        si, hi, st, ht, both = common(low)
        order = np.argsort(ht, kind="stable")
        st, ht, before = st[order], ht[order], len(tiles)
        for i in si[np.isin(hi, both)].tolist():
            if not free_i[i:i + low].all():
                continue
            h = rolling(item[i:i + low], low)[0]
            for t in st[np.searchsorted(ht, h):np.searchsorted(ht, h, "right")].tolist():
                if free_t[t:t + low].all() and (item[i:i + low] == text[t:t + low]).all():
                    free_i[i:i + low] = free_t[t:t + low] = False
                    tiles.append((i, t, low))
                    break
        longest = low if len(tiles) > before else low - 1
    return tiles


class _Index:
    """A block of the benchmark: token hashes of its items and where its seeds lie."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        texts = pa.array([t for _, t in items], pa.large_string())
        hashes, offsets = word_hashes(_plain(texts), lower=None)
        self.ids = [i for i, _ in items]
        self.tokens = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.words = np.unique(hashes)
        seeds = [rolling(t, least) for t in self.tokens]
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.lexsort((item, seeds))
        self.seeds, self.item = seeds[order], item[order]


def find(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE,
         block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contaminated pairs: doc_id, item_id, coverage, n_tiles, longest (tokens of the longest tile)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, coverage double, n_tiles int, longest int"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    out = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # one bounded block at a time
        found = rows.mapInArrow(_scan(held, uuid.uuid4().hex, least, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return out


_INDEX: dict[str, _Index] = {}


def _scan(held, stamp: str, least: int, coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _INDEX:  # built once in each worker
            _INDEX.clear()
            _INDEX[stamp] = _Index(held.value, least)
        index = _INDEX[stamp]
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes, offsets = word_hashes(_plain(part["_text"]), lower=None)
                if not len(hashes) or not len(index.seeds):
                    continue
                known = index.words[np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)] == hashes
                run = np.concatenate(([0], np.cumsum(known)))
                n = len(hashes) - least + 1
                if n <= 0:
                    continue
                at = np.flatnonzero(run[least:] - run[:n] == least)  # windows of benchmark words only
                doc_of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                at = at[doc_of[at] == doc_of[at + least - 1]]
                if not len(at):
                    continue
                h = rolling(hashes, least)[at]
                first, last = np.searchsorted(index.seeds, h), np.searchsorted(index.seeds, h, "right")
                hit = last > first
                at, first, last = at[hit], first[hit], last[hit]
                if not len(at):
                    continue
                count = last - first
                item = index.item[np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])]
                pairs = np.unique(np.repeat(doc_of[at], count) * len(index.ids) + item)
                result = []
                for p in pairs.tolist():
                    d, i = divmod(p, len(index.ids))
                    tokens = index.tokens[i]
                    tiles = tile(tokens, hashes[offsets[d]:offsets[d + 1]], least)
                    covered = sum(t[2] for t in tiles) / len(tokens)
                    if covered >= coverage:
                        result.append((d, index.ids[i], covered, len(tiles), max(t[2] for t in tiles)))
                if result:
                    d, i, c, k, m = zip(*result, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part["_id"].take(pa.array(d)), pa.array(i, pa.int64()), pa.array(c, pa.float64()), pa.array(k, pa.int32()), pa.array(m, pa.int32())],
                        ["doc_id", "item_id", "coverage", "n_tiles", "longest"])
    return scan


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates."""
    hit = find(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
