"""Byte-level BPE by overlapping chunk encoding.

A text is cut into chunks that overlap. Chunks are pre-tokenised in parallel,
each as if its start were a pre-token boundary. A match of the pattern depends
only on the text after its start, so as soon as two neighbouring chunks share
one boundary inside the overlap they agree on every later one: the text is cut
there, and the pieces between such cuts are encoded one by one. A text shorter
than a chunk is one piece and needs no stitching. Where a run without a
boundary outlasts the overlap, the neighbouring chunks are encoded as one
piece, so the ids are always those of the whole text. Decoding concatenates
the raw bytes of the ids.

Null and empty texts give no ids; repeated rows give one row each; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 1_024
#: Pre-token pattern of the public rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return table


def boundaries(chunk: str, pattern: str, last: bool) -> np.ndarray:
    """Pre-token boundaries of a chunk taken from its start; those that the cut end may move are left out."""
    import regex

    ends = [m.end() for m in regex.compile(pattern).finditer(chunk)]
    found = np.array([0, *ends], np.int64)
    return found if last else found[found < len(chunk)]


def cut_points(heads: list[np.ndarray], tails: list[np.ndarray]) -> list[int | None]:
    """For each chunk after the first, the first boundary that it shares with the one before, or None."""
    points: list[int | None] = []
    for head, tail in zip(heads[1:], tails[:-1], strict=True):
        both = np.intersect1d(head, tail)
        points.append(int(both[0]) if len(both) else None)
    return points


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id",
           text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: the id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = f"_id {kind}, ids binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = [enc.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in part["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["_id"], pa.array(ids, pa.binary())], ["_id", "ids"])

    short = rows.filter(F.char_length("_text") <= chunk + overlap).mapInArrow(pieces, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["_text"].to_pylist()):
                key = hashlib.sha256(text.encode()).digest()
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                for at in range(0, len(starts), 64):
                    some = starts[at:at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "_id": batch["_id"].slice(i, 1).take(pa.array([0] * len(some))),
                        "key": pa.array([key] * len(some), pa.binary()),
                        "start": pa.array(some, pa.int64()),
                        "last": pa.array([s == starts[-1] for s in some]),
                        "chunk": pa.array([text[s:] if s == starts[-1] else text[s:s + chunk + overlap] for s in some])})

    # the aggregation drops repeated rows (counted as copies) and spreads the chunks over the tasks
    chunks = (rows.filter(F.char_length("_text") > chunk + overlap)
              .mapInArrow(cut, f"_id {kind}, key binary, start long, last boolean, chunk string")
              .groupBy("_id", "key", "start", "last")
              .agg(F.first("chunk").alias("chunk"), F.count(F.lit(1)).alias("copies")))

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text, start, last in zip(batch["chunk"].to_pylist(), batch["start"].to_pylist(), batch["last"].to_pylist(), strict=True):
                found = boundaries(text, pattern, last)
                heads.append(found[found <= overlap] + start)
                tails.append(found[found >= chunk] + start)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "heads", "tails"])

    def stitch(table: pa.Table) -> pa.Table:
        enc = _encoding(ranks_path, pattern)
        table = table.sort_by("start")
        starts, texts = table["start"].to_pylist(), table["chunk"].to_pylist()
        points = cut_points([np.array(x, np.int64) for x in table["heads"].to_pylist()],
                            [np.array(x, np.int64) for x in table["tails"].to_pylist()])
        ids, begin, held, base = [], 0, "", 0
        for i, (start, text) in enumerate(zip(starts, texts, strict=True)):
            held = held + text[base + len(held) - start:] if held else text[begin - start:]
            base = begin
            point = points[i] if i < len(points) else start + len(text)
            if point is None:
                continue  # no shared boundary: the next chunk is read on to this piece
            ids.append(enc.encode_to_numpy(held[:point - begin], disallowed_special=()).astype("<u4").tobytes())
            begin, held = point, ""
        copies = table["copies"][0].as_py()
        return pa.table({"_id": pa.concat_arrays([table["_id"].combine_chunks().slice(0, 1)] * copies),
                         "ids": pa.array([b"".join(ids)] * copies, pa.binary())})

    long = (chunks.mapInArrow(pretokenise, f"_id {kind}, key binary, start long, last boolean, chunk string, copies long, heads array<long>, tails array<long>")
            .groupBy("_id", "key").applyInArrow(stitch, out))
    return short.unionByName(long).select(
        F.col("_id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, concatenated."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _bytes_of(ranks_path).__getitem__
        for batch in batches:
            for part in slices(batch, "ids"):
                raw = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return (encoded.select(F.col(id_col).alias("_id"), "n_tokens", "ids")
            .mapInArrow(back, f"_id {kind}, n_tokens long, ids binary, decoded binary")
            .withColumnRenamed("_id", id_col))


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Digests of the ids and of the decoded bytes, one row per document."""
    return decode(encode(docs, ranks_path, id_col=id_col), ranks_path, id_col).select(
        id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
