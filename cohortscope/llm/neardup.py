"""Near-duplicate groups by DartMinHash signatures.

A document is a weighted set of five-word shingles (lower case, words between
ASCII white space; a text of fewer words is one shingle). An element of weight
w owns the region [0, w) x [0, infinity). The region is cut along the weight
axis into strips [0, 1), [1, 2), [2, 4), ...; into each strip fall darts that
depend on nothing but the element and the strip: along the second axis they
form a Poisson process, each has a position on the weight axis (a dart at or
above w misses) and one of k coordinates. A coordinate keeps its earliest
dart. Two sets agree on a coordinate with the probability of their weighted
Jaccard similarity. With t = k ln k + 2k expected darts nearly all coordinates
are hit; for a set where one is not, twice as many are thrown.

Texts whose word sequences are equal are one text; its signature is banded,
and texts that share a band are linked to three pivots of that band's bucket
(the least id and two by hash, other ones in each band), never to every
member. Links are checked on the whole texts: Jaccard similarity of the
shingle sets of 0.8 or more. Buckets whose texts are in different groups after
that are linked anew to other pivots, in at most two rounds. What still shares
a bucket across groups is joined exactly: two similar sets share one of the
rarest fifth (and one) of their shingles, so all texts of such buckets meet by
these, spread by shingle and salt, and every pair of two groups is checked.
Groups are the connected components of the links.

Null texts and texts without a word are never copies of one another: each is
a group of its own. Repeated rows belong to one group; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.prefilter import probable

from .common import mix, release, rolling, slices, spread, stored, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
PIVOTS = 3
MAX_ROUNDS = 2
#: Texts of one shingle that a salt of the exact join holds.
SALT_ROWS = 1000
#: Bytes of text whose shingles a worker holds at once; and what a text's darts count as among them, of which a short text throws as many as a long one.
SLICE = 1_500_000
DART_BYTES = 2_000
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, element) of all shingles; and for each document its number of words and two hashes of its word sequence."""
    words, offsets = word_hashes(texts)
    n_words = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(words)) - offsets[doc_of]
    placed = mix(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
    sequence = np.stack([_sums(placed, offsets), _sums(mix(placed + np.uint64(_GOLD)), offsets)])
    grams = rolling(words, width)
    whole = np.flatnonzero(doc_of[:len(grams)] == doc_of[width - 1:]) if len(grams) else np.empty(0, np.int64)
    docs, elements = doc_of[whole], grams[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    docs, elements = np.concatenate((docs, short)), np.concatenate((elements, mix(sequence[0][short] ^ n_words[short].astype(np.uint64))))
    return docs, elements, n_words, sequence


def distinct(docs: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, multiplicity) of the distinct shingles."""
    order = np.lexsort((elements, docs))
    docs, elements = docs[order], elements[order]
    new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (elements[1:] != elements[:-1])))) if len(docs) else np.empty(0, np.int64)
    return docs[new], elements[new], np.diff(np.concatenate((new, [len(docs)])))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, k: int,
                    seed: int = 1) -> np.ndarray:
    """An (n_docs, k) array: the earliest dart of each coordinate; 0 for a document without elements."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(docs, weights, n_docs)
    # one row for each strip that an element reaches
    strips = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(docs)), strips)
    strip = spread(np.zeros(len(docs), np.int64), strips)
    low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
    width = np.where(strip > 0, low, 1.0)
    doc, weight = docs[row], weights[row].astype(np.float64)
    key = mix(elements[row] + (strip.astype(np.uint64) + np.uint64(seed)) * np.uint64(_GOLD))
    todo, darts = np.unique(docs), k * math.log(k) + 2 * k
    while len(todo):
        limit = np.zeros(n_docs)
        limit[todo] = darts / total[todo]
        live = np.flatnonzero(limit[doc] > 0)
        time = np.zeros(len(live))
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        while len(live):
            # few darts are due to most elements, many to those of short texts: these get several at once
            due = float(((limit[doc[live]] - time) * width[live]).mean())
            block = 1 if due < 2 else min(64, math.ceil(due))
            number = np.arange(n + 1, n + block + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h = mix(key[live][:, None] + number)
            gaps = np.log(_unit(h))
            gaps /= -width[live][:, None]
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)  # in sequence: the same sums whatever the block
            n += block
            last = times[:, -1]
            at, j = np.nonzero(times < limit[doc[live]][:, None])
            of, h = live[at], h[at, j]
            where = mix(h ^ np.uint64(0xA0761D6478BD642F))
            hits = low[of] + (1 - _unit(where)) * width[of] < weight[of]
            found.append((doc[of][hits], (mix(where) % np.uint64(k)).astype(np.int64)[hits], times[at, j][hits], h[hits]))
            more = last < limit[doc[live]]
            live, time = live[more], last[more]
        d, c, t, h = (np.concatenate(x) for x in zip(*found, strict=True))
        slot = d * k + c
        earliest = np.full(n_docs * k, np.inf)
        np.minimum.at(earliest, slot, t)
        first = np.flatnonzero(t == earliest[slot])
        done = np.isfinite(earliest).reshape(n_docs, k).all(1)[todo]
        full = np.zeros(n_docs, bool)
        full[todo[done]] = True
        first = first[full[d[first]]]
        out[d[first], c[first]] = h[first] | np.uint64(1)
        todo, darts = todo[~done], darts * 2
    return out


def signatures(docs: DataFrame, weighting: str = "set", bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: ``id``, ``digest`` of the word sequence (null without a word) and ``keys``, one hash for each band.

    ``weighting``: ``set`` gives each shingle weight 1, ``count`` its number of occurrences.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE, DART_BYTES):
                doc, element, n_words, sequence = shingles(part["text"], width)
                weight = np.ones(len(doc))  # a repeated shingle throws the same darts: the set is what counts
                if weighting == "count":
                    doc, element, count = distinct(doc, element)
                    weight = count.astype(np.float64)
                sig = dart_signatures(doc, element, weight, part.num_rows, bands * rows)
                banded = sig.reshape(part.num_rows, bands, rows)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (part.num_rows, 1))
                for j in range(rows):
                    keys = mix(keys * np.uint64(_GOLD) + banded[:, :, j])
                digests = [f"{n}:{a:x}{b:016x}" if n else None for n, a, b in zip(n_words.tolist(), *sequence.tolist(), strict=True)]
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(digests, pa.string()), listed], ["id", "digest", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, "id long, digest string, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, at_least: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' shingle sets have that Jaccard similarity; ``texts``: id, text, one row for each id."""
    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", SLICE):
                n = part.num_rows
                doc, element, _ = distinct(*shingles(pa.concat_arrays([part["ta"], part["tb"]]), width)[:2])
                size = np.bincount(doc, minlength=2 * n)
                pair = doc % n
                order = np.lexsort((element, pair))
                p, e = pair[order], element[order]
                both = np.bincount(p[1:][(p[1:] == p[:-1]) & (e[1:] == e[:-1])], minlength=n)
                union = size[:n] + size[n:] - both
                yield part.select(["a", "b"]).filter(pa.array((both >= at_least * union - 1e-9) & (union > 0)))

    return joined.mapInArrow(check, "a long, b long")


def stars(links: DataFrame, files: int | None = None) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b) that is not the least id of its component: root is. A stored table.

    Large-star and small-star steps in turn, as joins on pre-aggregated minima, until every component is a star; each
    round is written to the shared folder, in so many ``files``. Either step turns one edge into one edge, so their number never grows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    while True:  # the rounds grow with the logarithm of the longest chain
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        before, edges = edges, stored(small, "components", files)
        release(before)
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                             F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        linked = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not linked.agg(F.count_if((F.col("up") > 0) & (F.col("up") + F.col("down") > 1))).first()[0]:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    found._stored_at = edges._stored_at  # goes with the table that it reads
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the least id of its component."""
    found = stars(links)
    roots = found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())
    roots._stored_at = found._stored_at
    return roots


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that hold together what the groups so far and the new links do; a group takes one for each member, not all that made it."""
    return labels.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found)


def candidates(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the ids in ``wanted`` (id); rows that share an id have one text here: the first by content.

    Most documents share a bucket with no other: a bitmap keeps their texts out of the shuffle.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # no semi join, which Spark would push below the bitmap
    return probable(texts, wanted, "id").join(wanted.distinct(), "id").groupBy("id").agg(F.min("text").alias("text"))


def rest_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, at_least: float, width: int = SHINGLE,
               files: int | None = None) -> DataFrame:
    """(a, b): all pairs that can be similar and lie in two groups, among the texts of buckets (key, rep) that span groups. Reads a stored table."""
    rooted = (members.select("key", "rep").join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left")
              .select("key", "rep", F.coalesce("root", "rep").alias("root")))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    wanted = stored(rooted.join(several, "key", "left_semi").select(F.col("rep").alias("id"), "root").distinct(), "rest", files)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, element, _ = distinct(*shingles(part["text"], width)[:2])
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(doc)), pa.array(element.view(np.int64))], ["id", "e"])

    sets = stored(texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(elements, "id long, e long"), "shingles")
    # a set's elements by frequency: those of no other set come first, and are only counted
    shared = F.col("n") > 1
    ranked = (sets.join(sets.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e").groupBy("id")
              .agg(F.sort_array(F.collect_list(F.when(shared, F.struct("n", "e")))).alias("s"), F.count_if(~shared).cast("int").alias("own"))
              .withColumn("size", F.col("own") + F.size("s")))
    length = F.col("size") - F.ceil(at_least * F.col("size") - 1e-6) + 1 - F.col("own")
    prefix = F.slice("s", 1, F.greatest(length, F.lit(0)).cast("int"))
    rare = (ranked.select("id", "size", "own", F.posexplode(prefix).alias("at", "x"))
            .select("id", "size", (F.col("at") + F.col("own")).alias("at"), "x.e", "x.n"))
    rare = stored(rare.join(wanted, "id").select("id", "root", "size", "at", "e", "n"), "rare")
    release(sets, wanted)
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    left = rare.select(F.col("id").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("at").alias("ia"), "e", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    right = rare.select(F.col("id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("at").alias("ib"), "e", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # similar sets share so many elements; those before their first shared one are not shared, so what is left from there on must do.
    # At the first shared element this loses nothing, and later ones (the frequent ones) meet it ever less
    enough = at_least / (1 + at_least) * (F.col("sa") + F.col("sb")) - 1e-6
    pairs = (left.join(right, ["e", "salt"]).filter("a < b and ra != rb")
             .filter(F.least("sa", "sb") >= at_least * F.greatest("sa", "sb") - 1e-6)
             .filter(F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")) >= enough).select("a", "b").distinct())
    pairs._stored_at = rare._stored_at  # goes with the table that it reads
    return pairs


def groups(docs: DataFrame, weighting: str = "set", at_least: float = SIMILARITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id``, ``class_id`` (least id of its group) and ``n_copies`` (rows of that text)."""
    spark = docs.sparkSession
    signed = stored(signatures(docs, weighting, id_col=id_col, text_col=text_col), "signatures")
    files = max(1, signed.rdd.getNumPartitions())  # of tables of ids: as many as the signatures are read in
    # texts without a word, and rows without an id, stand alone
    reps = (signed.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
            .groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys")))
    banded = reps.select("rep", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("p0")).filter("n > 1")
    members = stored(banded.join(buckets.select("key", "p0"), "key"), "buckets")
    by_hash = members.groupBy("key").agg(*[F.min_by("rep", F.xxhash64("rep", "key", F.lit(i))).alias(f"p{i}") for i in range(1, PIVOTS + 2 * MAX_ROUNDS)])
    members_of = members
    members = stored(members.join(by_hash, "key").drop("key"), "pivots")
    texts = stored(candidates(docs, members.select(F.col("rep").alias("id")), id_col, text_col), "candidates")
    labels = spark.range(0).select("id", F.col("id").alias("root"))  # no list of rows: those start Python workers of their own, which stay
    tested = None
    seen = []  # stored pairs
    for turn in range(1 + MAX_ROUNDS):
        used = range(PIVOTS) if turn == 0 else range(PIVOTS + 2 * turn - 2, PIVOTS + 2 * turn)
        pairs = (members.select(F.col("rep").alias("x"), F.explode(F.array(*[f"p{i}" for i in used])).alias("y")).filter("x != y")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if turn:  # pairs within one group say nothing new
            pairs = (pairs.join(labels.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left")
                     .join(labels.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
                     .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(tested, ["a", "b"], "left_anti"))
        pairs = stored(pairs, "pairs", files)
        found = stored(similar(pairs, texts, at_least), "links", files)
        tested = pairs if tested is None else tested.unionByName(pairs)
        seen.append(pairs)
        if found.isEmpty():
            release(found)
            break
        before, labels = labels, stars(joined(labels, found), files)
        release(before, found)
    rest = rest_pairs(members_of, labels, texts, at_least, files=files)
    pairs = stored(rest.join(tested, ["a", "b"], "left_anti"), "pairs", files)
    release(rest, members, members_of, *seen)
    found = stored(similar(pairs, texts, at_least), "links", files)
    if not found.isEmpty():
        before, labels = labels, stars(joined(labels, found), files)
        release(before)
    release(pairs, found, texts)
    member = signed.join(reps.select("digest", "rep", "n_copies"), "digest", "left").join(
        labels.withColumnRenamed("id", "rep"), "rep", "left")
    return member.select(F.col("id").alias("doc_id"), F.coalesce("root", "rep", "id").alias("class_id"),
                         F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group: the row with the group's least id (of equal ids, the first by content)."""
    class_of = groups(docs).select("doc_id", "class_id")
    leaders = class_of.filter("doc_id = class_id").select("doc_id").distinct()
    alone = docs.filter(F.col("doc_id").isNull())
    kept = docs.join(leaders, "doc_id", "left_semi")
    cols = docs.columns
    return (kept.groupBy("doc_id").agg(F.min(F.struct(*[c for c in cols if c != "doc_id"])).alias("_row"))
            .select("doc_id", "_row.*").select(*cols).unionByName(alone.select(*cols)))
