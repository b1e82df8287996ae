"""N-gram scoring with a weighted backoff automaton.

Tokens are a text's words (ASCII lower case) and one end token. The model has
a state for every history of one and of two words that the training rows hold;
a state's arcs carry discounted probabilities interpolated with the shorter
history's, and its failure arc leads to that history with a backoff weight.
Scoring walks a text from left to right, carries the state and adds up the arcs.

All words, all pairs and all triples of the training rows are counted, at any
corpus size; no table of them is broadcast or gathered. Documents are dealt
into blocks of bounded size. A block meets its own words' counts (packed, by the
words' places among the block's sorted words), sends its
distinct pairs and triples (as numbers of words) to buckets by their first
word, and gets back the counts and backoff weights of those alone. Words with
at least ``HISTORY_SHARE`` of all tokens (at most 1 / HISTORY_SHARE) are spread
over the buckets by their second word too; the numbers of their followers are
added up afterwards. Word counts are discounted by n1 / (n1 + 2 n2) (n1, n2:
words seen once, twice); what that frees is the probability of the one unknown
word, for which all unseen words stand, as they do in the add-one base.

Null and empty texts are one end token; without training documents all counts
are zero; repeated rows and ids give one row each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, release, slices, stored, word_stream

BLOCK_CHARS = 6_000_000
#: A bucket holds the pairs and triples of about as many blocks.
BUCKET_BLOCKS = 2
#: Pairs that begin with words of this share are dealt by both words.
HISTORY_SHARE = 1e-3
#: Answers for words that a task holds before it packs them.
ANSWERS = 1_000_000
#: Of pairs and triples, and of words where the counts of counts give none.
DISCOUNT = 0.75
#: Key of the end token; no word is empty.
END = ""


def count_words(docs: DataFrame, use: Column, text_col: str = "text") -> DataFrame:
    """(word, c): how often each word, and the end token, occurs in the rows for which ``use`` holds."""
    rows = docs.filter(use).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                codes, _, words = word_stream(part["text"], lower="ascii")
                n = np.bincount(codes, minlength=len(words)) if len(words) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"word": pa.array([*words, END], pa.string()), "c": pa.array([*n.tolist(), part.num_rows], pa.int64())})

    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def numbered(counts: DataFrame) -> DataFrame:
    """With ``number``, one for each word: its part of the table (from bit 33 on) and its rank there, the most frequent first."""
    return counts.sortWithinPartitions(F.desc("c"), "word").withColumn("number", F.monotonically_increasing_id())


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes after their lengths."""
    planes = b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return np.array([len(arrays), *map(len, arrays)], "<i8").tobytes() + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", k, 8)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8 * (k + 1):], int(sizes.sum()) * 8, asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 8
    return [np.ascontiguousarray(planes[e - 8 * n:e].reshape(8, n).T).view("<i8").ravel() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def in_order(words: pa.Array) -> np.ndarray:
    """Indices that sort the words."""
    return pc.array_sort_indices(words).to_numpy()


def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, number, c) as (block, data), what a task holds of a block together."""
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, place, number, c = (np.concatenate([b[n].to_numpy() for b in held]) for n in ("block", "place", "number", "c"))
        order = np.lexsort((place, block))
        block, place, number, c = block[order], place[order], number[order], c[order]
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
        data = [pack(np.diff(place[a:b], prepend=0), number[a:b], c[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_pydict({"block": pa.array(block[cuts[:-1]]), "data": pa.array(data, pa.binary())})

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ANSWERS:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


class Grams:
    """A block's tokens and its distinct pairs and triples, numbered by their words' numbers: the same whatever the order of its rows."""

    def __init__(self, texts: pa.Array, known: list[bytes], buckets: int, hot: np.ndarray):
        codes, offsets, words = word_stream(texts, lower="ascii")
        n = len(offsets) - 1
        words.append(END)
        number, c, order = np.full(len(words), -1), np.zeros(len(words), np.int64), in_order(pa.array(words, pa.string())).astype(np.int64)
        for raw in known:
            place, numbers, counts = unpack(raw)
            at = order[np.cumsum(place)]
            number[at], c[at] = numbers, counts
        # words by number; all unknown words are word 0
        self.number, first, place = np.unique(np.append(number, -1), return_index=True, return_inverse=True)
        self.c, self.size = np.append(c, 0)[first], len(self.number)
        self.starts = offsets[:-1] + np.arange(n)
        token = np.full(len(codes) + n, len(words) - 1, np.int64)
        token[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))] = codes
        self.token = token = place[token]
        self.lengths = np.diff(np.append(self.starts, len(token)))
        #: For every token the word before it, the pair and triple that it ends, and the pair before it; -1 where there is none.
        self.before = np.concatenate(([0], token[:-1]))
        self.before[self.starts] = 0
        self.before[self.before == 0] = -1
        self.pair = np.where(self.before >= 0, self.before * self.size + token, -1)
        self.pairs, at = np.unique(self.pair[self.pair >= 0], return_inverse=True)
        self.ends = np.full(len(token), -1)
        self.ends[self.pair >= 0] = at
        self.history = np.concatenate(([-1], self.ends[:-1]))
        self.history[self.starts] = -1
        self.history[self.before < 0] = -1
        self.triple = np.where((self.history >= 0) & (token > 0), self.history * self.size + token, -1)
        self.triples, at = np.unique(self.triple[self.triple >= 0], return_inverse=True)
        self.thirds = np.full(len(token), -1)
        self.thirds[self.triple >= 0] = at
        self.u, self.v, self.w = (self.number[x] for x in (self.pairs // self.size, self.pairs % self.size, self.triples % self.size))
        spread = mix(self.u.astype(np.uint64))
        common = np.isin(self.u, hot)
        spread[common] = mix(spread[common] + self.v[common].astype(np.uint64))
        self.bucket = (spread % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.order3 = np.argsort(self.bucket[self.triples // self.size], kind="stable")

    def requests(self, used: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each bucket its pairs, their occurrences in the rows used, how many triples they begin; and the same of these."""
        used = np.repeat(used, self.lengths)
        n2 = np.bincount(self.ends[used & (self.ends >= 0)], minlength=len(self.pairs))[self.order]
        n3 = np.bincount(self.thirds[used & (self.thirds >= 0)], minlength=len(self.triples))[self.order3]
        fan = np.bincount(self.triples // self.size, minlength=len(self.pairs))[self.order]
        u, v, w, bucket = self.u[self.order], self.v[self.order], self.w[self.order3], self.bucket[self.order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        at3 = np.concatenate(([0], np.cumsum(fan)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, y = at3[a], at3[b]
            yield int(bucket[a]), pack(u[a:b], v[a:b], n2[a:b], fan[a:b], w[x:y], n3[x:y])

    def answers(self, table: pa.Table, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of this block's words the number of followers, of its pairs count and followers, of its triples the count."""
        rows = sorted(zip(table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True))
        c2, kinds2, kinds1, c3 = (np.concatenate(x) for x in zip(*(unpack(d) for _, d in rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4
        out2, out_kinds2, out3, out_kinds1 = (np.zeros(n, np.int64) for n in (len(self.pairs), len(self.pairs), len(self.triples), self.size))
        out2[self.order], out_kinds2[self.order], out3[self.order3] = c2, kinds2, c3
        out_kinds1[self.pairs[self.order] // self.size] = kinds1
        for i in np.flatnonzero(np.isin(self.number, list(hot))).tolist():
            out_kinds1[i] = hot[int(self.number[i])]
        return out_kinds1, out2, out_kinds2, out3


def merge(requests: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The blocks' requests to one bucket answered from their sums; and the bucket's words with the numbers of their followers here."""
    parts = [unpack(r) for r in requests]
    u, v, n2, fan, w, n3 = (np.concatenate(x) for x in zip(*parts, strict=True))
    first, u = np.unique(u, return_inverse=True)
    seconds, v = np.unique(v, return_inverse=True)
    pairs, at = np.unique(u * len(seconds) + v, return_inverse=True)
    c2 = np.bincount(at, n2, len(pairs)).astype(np.int64)
    kinds1 = np.bincount(pairs // len(seconds), c2 > 0, len(first)).astype(np.int64)
    thirds, w = np.unique(w, return_inverse=True)
    triples, at3 = np.unique(np.repeat(at, fan) * max(1, len(thirds)) + w, return_inverse=True)
    c3 = np.bincount(at3, n3, len(triples)).astype(np.int64)
    kinds2 = np.bincount(triples // max(1, len(thirds)), c3 > 0, len(pairs)).astype(np.int64)
    out, x, y = [], 0, 0
    for part in parts:
        a, b = at[x:x + len(part[0])], at3[y:y + len(part[4])]
        out.append(pack(c2[a], kinds2[a], kinds1[pairs[a] // len(seconds)], c3[b]))
        x, y = x + len(a), y + len(b)
    return out, first, kinds1


class Automaton:
    """Arcs of some histories: all that one block reaches. ``codes`` (sorted): history x ``size`` + word; ``kinds``: how many
    words follow each history in training (without it, the arcs given are all there are)."""

    def __init__(self, histories: list[str] | np.ndarray, counts: np.ndarray, codes: np.ndarray, pairs: np.ndarray, total: int, types: int, texts: int,
                 discount: float = DISCOUNT, kinds: np.ndarray | None = None):
        self.size = max(1, len(histories))
        self.total, self.types, self.texts = total, types, texts
        self.codes, self.counts, self.discount = codes, counts, discount
        self.unknown = np.log10(discount * types / total) if total else 0.0
        self.arcs, self.failure = _arcs(counts, codes // self.size, pairs, kinds)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """log10 of the arc from the empty history for words with these counts."""
        return np.where(c > 0, np.log10(np.maximum(c - self.discount, 1e-12) / max(self.total, 1)), self.unknown)

    def traverse(self, pair: np.ndarray, history: np.ndarray, c: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """log10-probability of every token: its state's own arc and, over the failure arc, the empty history's. ``at``: the pairs' places in ``codes``."""
        return np.log10(_up(10 ** self.unigram(c), _found(pair, self.codes) if at is None else at, history, self.counts, self.arcs, self.failure))


def _arcs(counts: np.ndarray, left: np.ndarray, n: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Discounted arcs of histories with these counts, and the histories' backoff weights."""
    arcs = np.maximum(n - DISCOUNT, 0) / np.maximum(counts[left], 1) if len(left) else np.empty(0)
    freed = 1 - np.bincount(left, arcs, len(counts)) if kinds is None else DISCOUNT * kinds / np.maximum(counts, 1)
    return arcs, np.clip(freed, 1e-12, None)


def _found(gram: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the grams in ``codes``; -1 where there is none."""
    if not len(codes):
        return np.full(len(gram), -1)
    at = np.minimum(np.searchsorted(codes, gram), len(codes) - 1)
    return np.where((gram >= 0) & (codes[at] == gram), at, -1)


def _up(lower: np.ndarray, at: np.ndarray, history: np.ndarray, counts: np.ndarray, arcs: np.ndarray, failure: np.ndarray) -> np.ndarray:
    """Probabilities given the longer history: the shorter one's where training does not hold it. ``at``: places of the own arcs, or -1."""
    if not len(counts):
        return lower
    out = np.where((history >= 0) & (counts[history] > 0), lower * failure[history], lower)
    if len(arcs):
        out += np.append(arcs, 0.0)[at]
    return out


def score(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score."""
    unigrams = counts = stored(numbered(count_words(docs, use, text_col)), "unigrams")
    parts = counts.agg(F.max(F.shiftright("number", 33))).first()[0] or 0
    # frequent words get small numbers: rank within its part, then the part
    counts = counts.withColumn("number", F.col("number").bitwiseAND((1 << 33) - 1) * F.lit(parts + 1) + F.shiftright("number", 33))
    total, types, once, twice = counts.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total, discount = total or 0, once / (once + 2 * twice) if once and twice else DISCOUNT
    hot = np.array([r[0] for r in counts.filter(F.col("c") >= F.lit(max(1.0, HISTORY_SHARE * total))).select("number").collect()], np.int64)
    texts = counts.filter(F.col("word") == END).agg(F.sum("c")).first()[0] or 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(use, F.lit(False)).alias("_used"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    buckets = -(-blocks // BUCKET_BLOCKS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))).repartition(blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, set[str]] = {}
        for batch in batches:
            for b in np.unique(batch["block"].to_numpy()).tolist():
                some = batch.filter(pa.array(batch["block"].to_numpy() == b))
                for part in slices(some, "_text", 16_000_000):
                    mine.setdefault(b, {END}).update(word_stream(part["_text"], lower="ascii")[2])
        for b, words in mine.items():
            some = pa.array(list(words), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b)), pa.array(np.arange(len(words))), some.take(pa.array(in_order(some)))], ["block", "place", "word"])

    # stored: the words' shuffles are gone before the pairs and triples take theirs, and are made once for both readings
    reached = stored(dealt.mapInArrow(distinct, "block long, place long, word string").join(counts, "word").select("block", "place", "number", "c")
                     .mapInArrow(pack_words, "block long, data binary"), "words")
    release(unigrams)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = Grams(left["_text"].combine_chunks(), right["data"].to_pylist(), buckets, hot) if left.num_rows else None
        found = list(grams.requests(left["_used"].to_numpy())) if grams else []
        block = left["block"][0].as_py() if left.num_rows else 0
        return pa.table({"block": pa.array([block] * len(found), pa.int64()), "bucket": pa.array([b for b, _ in found], pa.int64()), "data": pa.array([d for _, d in found], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        data, words, followers = merge(table["data"].to_pylist())
        part = np.isin(words, hot)
        n = int(part.sum())
        return pa.table({"block": pa.array(table["block"].to_pylist() + [None] * n, pa.int64()), "bucket": pa.array(table["bucket"].to_pylist() + [None] * n, pa.int64()),
                         "data": pa.array(data + [None] * n, pa.binary()), "number": pa.array([None] * len(data) + words[part].tolist(), pa.int64()),
                         "followers": pa.array([None] * len(data) + followers[part].tolist(), pa.int64())})

    asked = dealt.groupBy("block").cogroup(reached.groupBy("block")).applyInArrow(ask, "block long, bucket long, data binary")
    answered = stored(asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, data binary, number long, followers long"), "ngrams")
    spread = {r[0]: r[1] for r in answered.filter("block is null").groupBy("number").agg(F.sum("followers")).collect()}  # at most 1 / HISTORY_SHARE
    met = reached.withColumn("bucket", F.lit(None).cast("long")).unionByName(answered.filter("block is not null").select("block", "bucket", "data"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_id": left["_id"], **{n: pa.array([], pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")},
                             **{n: pa.array([], pa.float64()) for n in ("base_score", "score")}})
        own = pc.is_null(right["bucket"])
        grams = Grams(left["_text"].combine_chunks(), right.filter(own)["data"].to_pylist(), buckets, hot)
        kinds1, c2, kinds2, c3 = grams.answers(right.filter(pc.invert(own)), spread)
        model = Automaton(grams.number, grams.c, grams.pairs, c2, total, types, texts, discount, kinds1)
        c = grams.c[grams.token]
        base = np.log10((c + 1.0) / (total + types + 1.0))
        two = 10 ** model.traverse(grams.pair, grams.before, c, grams.ends)
        arcs, failure = _arcs(c2, grams.triples // grams.size, c3, kinds2)
        arc = np.log10(_up(two, grams.thirds, grams.history, c2, arcs, failure))
        first = grams.starts  # every text has its end token
        return pa.table({
            "_id": left["_id"], "n_tokens": pa.array(grams.lengths), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(first), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(arc, first))})

    return (dealt.groupBy("block").cogroup(met.groupBy("block"))
            .applyInArrow(walk, f"_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("_id", id_col))
