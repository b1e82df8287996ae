"""Operator 11: how far the sources of a language differ in their words, by chunk factorization.

Texts are cut at white space into chunks. Chunks are counted in each document,
then over all documents of a (language, source); each distinct chunk is cut
into terms once, after the counts have met, and its counts go to its terms.
A language keeps the terms that at least ``LEAST_DOCS`` of its documents hold.
A chunk's documents are counted exactly; a term's lie between the most of one
of its chunks and the sum of them. Only terms whose range holds the limit are
counted by document, in one more reading.

Every row is a document, also where ids or texts repeat. Null text, lang and
source are empty strings; other columns are not read. A group whose documents
hold no kept term counts zero everywhere; an empty table gives no rows. All
numbers are whole numbers, so the order of the additions changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_of_words, spread, stored

#: Documents of a language that must hold a term; shown ranks of terms; the smoothing and the scale of shares.
LEAST_DOCS, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of text counted together in a task; sources whose pairs are summed at once (rows of a matrix).
COUNT_BYTES, STRIP = 12_000_000, 1024
#: Kept or unsettled terms are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
GROUP = ["lang", "source"]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about COUNT_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        bytes_of = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(bytes_of), 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + COUNT_BYTES - size, side="right")))
            held.append(b.slice(at, end - at))
            size += int(ends[end - 1]) - done
            at = end
            if size >= COUNT_BYTES or at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """The group of each row as a number, and the groups."""
    lang, source = (batch.column(c).dictionary_encode() for c in GROUP)
    wide = max(1, len(source.dictionary))
    both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)
    found, g = np.unique(both, return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    return g, [(langs[x // wide], sources[x % wide]) for x in found.tolist()]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the chunk's code of every chunk in its place; and the distinct chunks."""
    raw, cuts, word, offsets = runs_of_words(batch.column("text"), None)
    if not word.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.large_string())
    runs = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = runs.filter(pa.array(word)).dictionary_encode()
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, in order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _held(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Each distinct (document, chunk): the document's row, the chunk's code, its occurrences; and the chunks."""
    doc, code, chunks = _words(batch)
    size = max(1, len(chunks))
    pair, n = np.unique(doc * size + code, return_counts=True)
    return pair // size, pair % size, n, chunks


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each chunk in each group, summed over the rows at hand."""
    for batch in _gathered(batches):
        g, groups = _groups_of(batch)
        doc, code, n, chunks = _held(batch)
        if not len(doc):
            continue
        key, at = np.unique(code * len(groups) + g[doc], return_inverse=True)
        occurrences = np.bincount(at, n).astype(np.int64)
        documents = np.bincount(at).astype(np.int64)
        of = key % len(groups)
        yield pa.RecordBatch.from_arrays(
            [chunks.take(pa.array(key // len(groups))).cast(pa.string()), *(pa.array([x[k] for x in groups], pa.string()).take(pa.array(of)) for k in (0, 1)),
             pa.array(occurrences), pa.array(documents)], ["chunk", *GROUP, "n", "docs"])


def terms_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Each distinct (chunk, term): the chunk's place, the term's code, its occurrences in the chunk; and the terms."""
    chunks = chunks.cast(pa.large_string())
    n, (_, at, data) = len(chunks), chunks.buffers()
    none = np.empty(0, np.int64)
    if not n or data is None:
        return none, none, none, pa.array([], pa.string())
    offs = np.frombuffer(at, np.int64, n + 1, chunks.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].copy()
    offs = offs - offs[0]
    if not len(raw):
        return none, none, none, pa.array([], pa.string())
    upper = (raw - np.uint8(65)) < 26
    raw[upper] += 32
    inside = ((raw - np.uint8(97)) < 26) | (raw > 127)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    cut[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(cut)
    is_term = inside[cuts[:-1]]
    coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).filter(pa.array(is_term)).dictionary_encode()
    size = max(1, len(coded.dictionary))
    owner = np.searchsorted(offs, cuts[:-1][is_term], side="right") - 1
    pair, times = np.unique(owner * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pair // size, pair % size, times, coded.dictionary.cast(pa.string())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of chunks, which arrive in the chunks' order, passed on to their terms.

    Rows with a source carry occurrences; one row without a source for each (chunk, lang, term)
    carries the chunk's documents in the language, as the most and as the sum.
    """
    def out(rows: pa.Table) -> pa.RecordBatch | None:
        coded = rows.column("chunk").combine_chunks().dictionary_encode()
        chunk = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner, term, times, terms = terms_of(coded.dictionary)
        if not len(owner):
            return None
        first = np.searchsorted(owner, np.arange(len(coded.dictionary) + 1))
        each = np.diff(first)
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        l = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        r = np.repeat(np.arange(len(chunk)), each[chunk])
        at = spread(first[:-1][chunk], each[chunk])
        n = rows.column("n").to_numpy()[r] * times[at]
        wide = len(lang.dictionary)
        key, place = np.unique(chunk * wide + l, return_inverse=True)
        docs = np.zeros(len(key), np.int64)
        np.add.at(docs, place, rows.column("docs").to_numpy())
        r2 = np.repeat(np.arange(len(key)), each[key // wide])
        at2 = spread(first[:-1][key // wide], each[key // wide])
        langs = lang.dictionary.cast(pa.string())
        none = np.zeros(len(r2), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([langs.take(pa.array(l[r])), langs.take(pa.array(key[r2] % wide))]),
             pa.concat_arrays([rows.column("source").combine_chunks().cast(pa.string()).take(pa.array(r)), pa.nulls(len(r2), pa.string())]),
             terms.take(pa.array(term[np.concatenate((at, at2))])),
             pa.array(np.concatenate((n, none))), *[pa.array(np.concatenate((np.zeros(len(r), np.int64), docs[r2])))] * 2],
            [*GROUP, "term", "n", "most", "docs"])

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        chunk = batch.column("chunk")
        whole = int(pc.index(pc.equal(chunk, chunk[-1]), True).as_py())  # the last chunk may go on in the next batch
        if held and (whole or held[-1].column("chunk")[-1].as_py() != chunk[0].as_py()):
            ready, held = pa.concat_tables([*held, rows.slice(0, whole)]), [rows.slice(whole)]
        elif whole:
            ready, held = rows.slice(0, whole), [rows.slice(whole)]
        else:
            ready = None
            held.append(rows)
        if ready is not None and (found := out(ready)) is not None:
            yield found
    if held and (found := out(pa.concat_tables(held))) is not None:
        yield found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n) for every group, and rows without a source with the bounds ``most`` and ``docs``
    of the documents of the language that hold the term."""
    chunks = docs.mapInArrow(_count, "chunk string, lang string, source string, n long, docs long")
    met = chunks.repartition("chunk").groupBy("chunk", *GROUP).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = met.sortWithinPartitions("chunk").mapInArrow(_terms, "lang string, source string, term string, n long, most long, docs long")
    return terms.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("docs").alias("docs"))


def _bytes(terms: DataFrame) -> int:
    """A bound of what a broadcast of (lang, term) rows takes."""
    return terms.agg(F.sum(F.octet_length("term") + F.octet_length("lang") + 32)).first()[0] or 0


def _document_counts(docs: DataFrame, unsettled: DataFrame, size: int) -> DataFrame:
    """(lang, term, docs): how many documents of the language hold each unsettled term."""
    if size <= BROADCAST_BYTES:
        rows = unsettled.toArrow()
        wanted = docs.sparkSession.sparkContext.broadcast({name.as_py(): rows.filter(pc.equal(rows["lang"], name))["term"].combine_chunks().cast(pa.string()) for name in pc.unique(rows["lang"])})
    else:
        wanted = None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            doc, code, chunks = _words(batch)
            if not len(doc):
                continue
            lang = batch.column("lang").dictionary_encode()
            names, of_doc = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner, term, _, terms = terms_of(chunks)
            if wanted:  # chunks without an unsettled term of some language at hand say nothing
                asked = np.zeros((len(names), len(terms)), bool)
                for i, name in enumerate(names):
                    if (own := wanted.value.get(name)) is not None:
                        asked[i] = pc.is_in(terms, own).to_numpy(zero_copy_only=False)
                some = asked.any(0)[term]
                owner, term = owner[some], term[some]
            first = np.searchsorted(owner, np.arange(len(chunks) + 1))
            each = np.diff(first)
            some = each[code] > 0
            pair = _distinct(doc[some] * len(chunks) + code[some])
            doc, code = pair // len(chunks), pair % len(chunks)
            held = _distinct(np.repeat(doc, each[code]) * len(terms) + term[spread(first[:-1][code], each[code])])
            cell, n = np.unique(of_doc[held // max(1, len(terms))] * len(terms) + held % max(1, len(terms)), return_counts=True)
            if wanted:
                some = asked.ravel()[cell]
                cell, n = cell[some], n[some]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.cast(pa.string()).take(pa.array(cell // max(1, len(terms)))), terms.take(pa.array(cell % max(1, len(terms)))), pa.array(n)], ["lang", "term", "docs"])

    counted = docs.mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    return counted if wanted else counted.join(unsettled, ["lang", "term"], "left_semi")


def _kept(docs: DataFrame, counts: DataFrame) -> DataFrame:
    bounds = counts.where(F.col("source").isNull() & (F.col("docs") >= LEAST_DOCS))
    settled = bounds.where(F.col("most") >= LEAST_DOCS).select("lang", "term")
    unsettled = bounds.where(F.col("most") < LEAST_DOCS).select("lang", "term")
    size = _bytes(unsettled)
    if size:
        settled = settled.unionByName(_document_counts(docs, unsettled, size).where(F.col("docs") >= LEAST_DOCS).select("lang", "term"))
    return stored(settled, "kept_terms")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers."""
    wide = "decimal(38,0)"
    up = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(12,0)")
    down = (total + F.lit(PRIOR) * terms).cast(wide)
    return F.lit(1).cast("long") + F.call_function("div", up.cast(wide), down)


def _shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same for arrays, by long division in steps that stay within 64 bits."""
    up, down = count + PRIOR, total + PRIOR * terms
    q, r = up // down, up % down
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // down, r * 1000 % down
    return q + 1


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed |p - q| of all pairs of a language's sources, for strips of STRIP sources; partial sums for each task."""
    sums: dict[tuple[str, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, strip), m in sums.items():
            i, j = np.nonzero(np.ones(m.shape, bool))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + strip * STRIP), pa.array(j), pa.array(m[i, j])], ["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        rows = batch.to_pydict()
        for lang, strip, totals, terms, at, n in zip(*(rows[c] for c in ("lang", "strip", "totals", "terms", "at", "n"))):
            key, total = (lang, strip), np.array(totals, np.int64)
            if key not in sums:
                if len(sums) >= 8:
                    yield from flush()
                sums[key] = np.zeros((min(STRIP, len(total) - strip * STRIP), len(total)), np.int64)
            count = np.zeros(len(total), np.int64)
            count[at] = n
            p = _shares(count, total, terms)
            mine = p[strip * STRIP:(strip + 1) * STRIP]
            sums[key] += np.abs(mine[:, None] - p[None, :])
    yield from flush()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text. Part ``pair`` holds every other source of the
    language with the summed distance of shares, part ``term`` the TOP terms whose share is above the language's."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUP)))
    counts = stored(term_counts(docs), "term_counts")
    kept = _kept(docs, counts)
    few = _bytes(kept) <= BROADCAST_BYTES
    cells = counts.where(F.col("source").isNotNull()).join(F.broadcast(kept) if few else kept, ["lang", "term"], "left_semi")
    words = stored(cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("all")), "term_cells")
    flat = words.select("lang", "term", "all", F.inline("cells"))
    v = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = (docs.select(*GROUP).distinct().join(flat.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left")
              .join(v, "lang", "left").select(*GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    groups = stored(groups, "source_totals")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("terms").alias("terms"),
                                       F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
    return _pairs(words, groups, langs).unionByName(_top_terms(flat, groups, langs))


def _pairs(words: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    names = langs.select("lang", F.posexplode("sources").alias("at", "s")).select("lang", F.col("at").cast("long").alias("at"), F.col("s.source").alias("source"))
    numbers = F.map_from_arrays("sources.source", F.sequence(F.lit(0), F.size("sources") - 1))
    rows = (words.join(langs.withColumn("numbers", numbers), "lang")
            .select("lang", F.col("sources.total").alias("totals"), "terms", F.transform("cells", lambda c: F.col("numbers")[c["source"]]).alias("at"), F.col("cells.n").alias("n"),
                    F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / STRIP).cast("int"))).alias("strip")))
    sums = rows.mapInArrow(_distances, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    a, b = (names.select("lang", F.col("at").alias(k), F.col("source").alias(as_)) for k, as_ in (("a", "source"), ("b", "item")))
    found = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select(*GROUP, "item", "value")
    each = groups.select(*GROUP).join(langs.select("lang", F.explode("sources.source").alias("item")), "lang").where(F.col("item") != F.col("source"))
    every = each.join(found, [*GROUP, "item"], "left").select(*GROUP, "item", F.coalesce("value", F.lit(0)).alias("value"))
    return _ranked(every, "pair")


def _top_terms(flat: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    at = flat.join(groups, GROUP).join(langs.select("lang", "lang_total"), "lang")
    over = at.select(*GROUP, F.col("term").alias("item"), (_share(F.col("n"), F.col("total"), F.col("terms")) - _share(F.col("all"), F.col("lang_total"), F.col("terms"))).alias("value"))
    return _ranked(over.where(F.col("value") > 0), "term").where(F.col("rank") <= TOP)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (t.total + {PRIOR} * s.v) AS p,
                  1 + ({SCALE}::HUGEINT * (k.lang_n + {PRIOR})) // (s.lang_total + {PRIOR} * s.v) AS q
           FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang
           LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                 WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term))::INT AS rank
FROM shares WHERE n > 0 AND p > q QUALIFY rank <= {TOP}
"""
