"""Token-id files compressed by Re-Pair grammars.

Documents are ordered by id and encoded; each shard of ids gets a grammar of
its own: the frequent adjacent pairs are replaced by nonterminals, round after
round. A round replaces a whole set of pairs at once; where chosen pairs
overlap, the more frequent one wins. Pairs of the next round may hold
nonterminals of earlier ones.

File format: a Parquet data set with a row for each shard:
``part, seq`` (shards in this order are in document order), ``doc_ids``,
``lengths`` (ids of each document), ``rules`` (int32 pairs; rule i defines
symbol ``first + i``), ``rule_lengths`` (int32 expansion lengths), ``first``,
``symbols`` (int32) and ``n_ids``. Expansion lengths place any id without
expanding what lies before it. Spark's committer writes the files, so a lost
executor leaves no half-written shard.

Null and empty texts give only the end id; documents with equal ids keep an
order by content; extra columns are not read; an empty table gives no shard.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_words, runs_of_words, shared_dir, slices, spread

END_ID = 1
SHARD_IDS = 1 << 18
TASK_CHARS = 16_000_000
ROUNDS = 4
MIN_PAIRS = 4
PAIRS_PER_ROUND = 2_048
CACHE_WORDS = 1_500_000
#: Stands between words that are encoded as one text.
MARK = "|"

SCHEMA = ("part int, seq int, doc_ids array<long>, lengths array<long>, first int, rules binary, "
          "rule_lengths binary, symbols binary, n_ids long")


# ------------------------------------------------------------- grammar
def compress(ids: np.ndarray, first: int, rounds: int = ROUNDS, least: int = MIN_PAIRS,
             most: int = PAIRS_PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rules is an (r, 2) array; rule i defines symbol ``first + i``."""
    seq, rules, top = ids.astype(np.int64), [], first
    bits = max(10, min(20, int(len(ids)).bit_length() - 1))
    for _ in range(rounds):
        if len(seq) < 2:
            break
        pairs = seq[:-1] * top + seq[1:]
        # a pair is at most as frequent as its bucket: only pairs of full buckets are sorted and counted
        bucket = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        ordered = np.sort(pairs[(np.bincount(bucket, minlength=1 << bits) >= least)[bucket]])
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else ordered
        counts = np.diff(np.concatenate((starts, [len(ordered)])))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        if len(often) > most:  # equal counts at the limit: by pair
            limit = np.partition(counts[often], -most)[-most]
            above, level = often[counts[often] > limit], often[counts[often] == limit]
            often = np.sort(np.concatenate((above, level[:most - len(above)])))
        often = often[np.argsort(-counts[often], kind="stable")]  # most frequent first, equal ones by pair
        chosen = ordered[starts[often]]
        none = len(chosen)
        place = ((chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        rank_at, pair_at = np.full(1 << bits, none, np.int32), np.full(1 << bits, -1, np.int64)
        rank_at[place[::-1]], pair_at[place[::-1]] = np.arange(none - 1, -1, -1, dtype=np.int32), chosen[::-1]  # the first in a bucket wins
        rank = np.full(len(seq) + 1, none, np.int32)  # one sentinel on either side
        rank[1:-1] = np.where(pair_at[bucket] == pairs, rank_at[bucket], none)
        here = rank[1:-1]
        take = np.flatnonzero((here < rank[:-2]) & (here <= rank[2:]) & (here < none))
        if not len(take):
            break
        used = np.flatnonzero(np.bincount(here[take], minlength=none))
        number = np.zeros(none, np.int64)
        number[used] = top + np.arange(len(used))
        rules.append(np.stack((chosen[used] // top, chosen[used] % top), 1))
        seq[take] = number[here[take]]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq = seq[keep]
        top += len(used)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.int64)).astype(np.int32), seq.astype(np.int32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for. Rules refer to earlier symbols only."""
    lengths = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (1 if a < first else lengths[a - first]) + (1 if b < first else lengths[b - first])
    return np.array(lengths, np.int32)


def expand(symbols: np.ndarray, rules: np.ndarray, rule_lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    flat, starts = [], np.concatenate(([0], np.cumsum(rule_lengths, dtype=np.int64)))
    tokens: list[list[int]] = []
    for a, b in rules.tolist():
        tokens.append((tokens[a - first] if a >= first else [a]) + (tokens[b - first] if b >= first else [b]))
    for t in tokens:
        flat += t
    flat = np.array(flat, np.int32)
    symbols = symbols.astype(np.int64)
    is_rule = symbols >= first
    rule = np.where(is_rule, symbols - first, 0)
    lengths = np.ones(len(symbols), np.int64)
    if len(rules):
        lengths = np.where(is_rule, rule_lengths[rule], 1)
    out = np.repeat(np.where(is_rule, 0, symbols), lengths).astype(np.int32)
    where = np.flatnonzero(is_rule)
    if len(where):
        ends = np.cumsum(lengths)
        out[spread((ends - lengths)[where], lengths[where])] = flat[spread(starts[rule[where]], lengths[where])]
    return out


def read_range(symbols: np.ndarray, rules: np.ndarray, rule_lengths: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
    """Ids ``start .. end`` of a shard: only the symbols that cover them are expanded."""
    lengths = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    lengths[rule] = rule_lengths[symbols[rule] - first]
    ends = np.cumsum(lengths)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
    skip = start - int(ends[a] - lengths[a]) if a < len(ends) else 0
    return expand(symbols[a:b], rules, rule_lengths, first)[skip:skip + max(0, end - start)]


# ------------------------------------------------------------- encoding
class Encoder:
    """The tokenizer with the ids of words it has met.

    It drops white space, so a text's ids are its words' ids in a row. Known
    words are found by their 64-bit hash in a table with two probes; a word
    that is not there is encoded by the library.
    """

    BITS = 22

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.slot_hash, self.slot_word = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.lengths, self.words = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64), 0

    def _probes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        one, two = self._probes(h)
        word = np.where(self.slot_hash[one] == h, self.slot_word[one], -1)
        lost = np.flatnonzero(word < 0)
        word[lost] = np.where(self.slot_hash[two[lost]] == h[lost], self.slot_word[two[lost]], -1)
        return word

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word).

        The library spends more on each text than on a word of it: words go as one text with marks between them, whose
        ids are cut at the mark's. Words that hold a mark go by themselves, and all do should any give the mark's id.
        """
        single = np.fromiter((MARK in w for w in words), bool, len(words))
        rest = [w for w in words if MARK not in w]
        out, lengths = [], np.zeros(len(words), np.int64)
        if rest and self.mark is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(rest)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(rest) - 1:
                lengths[~single] = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                out.append((~single, np.delete(ids, cuts)))
        if not out:
            single[:] = True
        if single.any():
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, s in zip(words, single, strict=True) if s], add_special_tokens=False)]
            lengths[single] = np.fromiter(map(len, found), np.int64, len(found))
            out.append((single, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths[single].sum()))))
        flat, starts = np.empty(int(lengths.sum()), np.int32), np.cumsum(lengths) - lengths
        for which, ids in out:
            flat[spread(starts[which], lengths[which])] = ids
        return flat, lengths

    def _learn(self, h: np.ndarray, words: list[str]) -> np.ndarray:
        """Numbers of new distinct words."""
        flat, lengths = self._ids(words)
        total, n = len(flat), len(words)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[:self.used], np.empty(self.used + 2 * total, np.int32)))
        if self.words + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros(n + CACHE_WORDS, np.int64))) for x in (self.starts, self.lengths))
        self.flat[self.used:self.used + total] = flat
        self.starts[self.words:self.words + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.words:self.words + n] = lengths
        number = np.arange(self.words, self.words + n)
        self.used, self.words = self.used + total, self.words + n
        for probe in self._probes(h):
            free = self.slot_word[probe] < 0
            self.slot_hash[probe[free]], self.slot_word[probe[free]] = h[free], number[free]
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), without end ids."""
        raw, cuts, is_word, offsets = runs_of_words(texts, "ascii")
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if self.words > CACHE_WORDS:
            self._clear()
        start, end = cuts[:-1][is_word], cuts[1:][is_word]
        h = hash_words(raw, start, end)
        word = self._find(h)
        lost = np.flatnonzero(word < 0)
        if len(lost):
            new, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            at = lost[first]
            data = raw.tobytes()
            words = [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            word[lost] = self._learn(new, words)[back]
        per_word = self.lengths[word]
        total = np.concatenate(([0], np.cumsum(per_word)))
        return self.flat[spread(self.starts[word], per_word)], np.diff(total[offsets])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _encoder(path).encode(texts)


def _shard(part: int, seq: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, first: int) -> pa.RecordBatch:
    rules, symbols = compress(ids, first)
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
        "first": pa.array([first], pa.int32()), "rules": pa.array([rules.tobytes()], pa.binary()),
        "rule_lengths": pa.array([expansion_lengths(rules, first).tobytes()], pa.binary()),
        "symbols": pa.array([symbols.tobytes()], pa.binary()), "n_ids": pa.array([len(ids)], pa.int64())})


def write(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, shard_ids: int = SHARD_IDS, task_chars: int = TASK_CHARS) -> None:
    """Encodes the documents, in ascending id order, into shards under ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    chars = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    order = ["_id", F.xxhash64("_text")]
    ranged = rows.repartitionByRange(max(1, -(-chars // task_chars)), *order).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        first = max(_encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1)
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for some in slices(batch, "_text", 1_000_000):
                ids, per_doc = encode_texts(tokenizer_path, some["_text"])
                ends = np.cumsum(per_doc)
                held.append(np.insert(ids, ends, end_id).astype(np.int32))
                lengths.append(per_doc + 1)
                doc_ids += some["_id"].to_pylist()
                n += len(held[-1])
                if n >= shard_ids:
                    yield _shard(part, seq, doc_ids, np.concatenate(lengths), np.concatenate(held), first)
                    doc_ids, lengths, held, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield _shard(part, seq, doc_ids, np.concatenate(lengths), np.concatenate(held), first)

    ranged.mapInArrow(shards, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files under ``path``: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    ``start`` adds the ids of earlier write tasks (one number for each of
    them, the only thing that passes the driver), of earlier shards of the
    task and of earlier documents of the shard.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([r["n"] for r in parts]))).astype(np.int64)
    offsets = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(parts, before, strict=False)], "part int, part_start long")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shard_starts = (files.select("part", "seq", "n_ids")
                    .withColumn("shard_start", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
                    .join(offsets, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("at")))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"], np.int32), rules, np.frombuffer(row["rule_lengths"], np.int32), row["first"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                raw = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(ends - np.array(row["lengths"]) + row["at"], pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()), "ids": pa.array(raw, pa.binary())})

    return files.join(shard_starts, ["part", "seq"]).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def checked(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes token files to the shared folder and returns what reading them back gives."""
    path = shared_dir(spark, "token_files")
    write(docs, tokenizer_path, path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
