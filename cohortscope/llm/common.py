"""Helpers shared by the corpus operators.

Everything here works on one Arrow batch inside a task, or builds small
Spark expressions; nothing gathers a corpus on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a task; bounds a worker's memory.
SLICE_CHARS = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:  # unset only outside a cluster, as in tests
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when their query ends, and not only when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, and its shuffle files are removed.

    ``files``: rows are dealt anew to that many files, for tables so narrow that one file for each shuffle partition holds next to nothing.
    """
    spark = df.sparkSession
    df = df.repartition(files) if files else df
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*frames: DataFrame | None) -> None:
    """Remove what ``stored`` wrote for ``frames``; nothing may read them any more."""
    for df in frames:
        if df is not None and getattr(df, "_stored_at", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    crc = F.crc32(c.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS, row: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least); each row counts ``row`` bytes besides its text."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row)
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def runs_of_words(texts: pa.Array, lower: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where runs of words or of spaces start (and the end), which runs are words, and
    the offsets of each text's words among all words. Runs end where texts end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower == "utf8":
        texts = pc.utf8_lower(texts)
    n, (_, at, data) = len(texts), texts.buffers()
    offs = np.frombuffer(at, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    offs = offs - offs[0]
    if not len(raw):
        return raw, np.zeros(1, np.int64), np.empty(0, bool), np.zeros(n + 1, np.int64)
    if lower == "ascii":
        raw = _ASCII_LOWER[raw]
    space = (raw == 32) | ((raw - np.uint8(9)) < 5)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    cut[1:-1] |= space[1:] != space[:-1]
    cuts = np.flatnonzero(cut)
    word = ~space[cuts[:-1]]
    before = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
    return raw, cuts, word, before[np.searchsorted(cuts, offs)]


def word_stream(texts: pa.Array, lower: str | None = "utf8") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text as codes into a vocabulary of this slice.

    Words are runs without ASCII white space. Returns ``codes`` of all words,
    ``offsets`` (n + 1) of each text's words, and the ``vocabulary``.
    """
    raw, cuts, word, offsets = runs_of_words(texts, lower)
    if not len(raw):
        return np.empty(0, np.int64), offsets, []
    runs = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = runs.filter(pa.array(word)).dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets,
            coded.dictionary.to_numpy(zero_copy_only=False).tolist())


#: Words of more bytes are hashed one by one.
_LONG = 128


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time over all words together."""
    length = end - start
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    h = mix(length.astype(np.uint64))
    rows: np.ndarray | slice = slice(None)
    for k in range(0, _LONG, 8):
        left = length[rows] - k
        chunk = eight[start[rows] + k] & _KEEP[np.minimum(left, 8)]
        h[rows] = mix(h[rows] * np.uint64(0x9E3779B97F4A7C15) + chunk)
        rows = np.flatnonzero((length > k + 8) & (length <= _LONG))
        if not len(rows):
            break
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i]:end[i]].tobytes())
    return h


def word_hashes(texts: pa.Array, lower: str | None = "utf8") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offsets of each text's words."""
    raw, cuts, word, offsets = runs_of_words(texts, lower)
    if not len(raw):
        return np.empty(0, np.uint64), offsets
    return hash_words(raw, cuts[:-1][word], cuts[1:][word]), offsets


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of every window of ``width`` (length n - width + 1)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j:j + n]
    return mix(out)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
