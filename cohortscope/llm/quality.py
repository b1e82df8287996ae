"""Quality rules by divergence from language references, in DataFrame functions only.

References are learned over all documents: for each language, the shares of
seven character classes and of its ``COMMON`` most frequent words (all other
words are one bin). A document is compared with the reference of the language
whose common words make up most of it, by Jensen-Shannon distance (square root
of the divergence in bits); it is kept when both distances are within bounds. A short text strays
further by chance: the word bound of a length is what words drawn from the reference itself
stray at that length (mean and ``DEVIATIONS`` standard deviations of the divergence) and what a text's
subject may add at any length; the class bound widens with one over the square root of the length.
Under ``MIN_WORDS`` words there is no verdict of the method, only the base rule.

Null and empty texts have no words and fail the base rule; where no language
is known (no row with a language) every text passes the method. Documents
without a language add to no reference. Repeated rows and ids give one row
each; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

COMMON = 40
#: Repeated windows up to this number are looked up, more are sorted.
LOOKED_UP = 16
MIN_WORDS = 50
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.20, 1.5
#: Word distance that a text's own subject may add, and standard deviations of what chance adds.
SUBJECT_DISTANCE, DEVIATIONS = 0.25, 3.0
#: Bounds are computed for lengths from MIN_WORDS on, each half an octave over the one before.
BOUND_STEPS = 24
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL_CHARS = "#*$%&|<>"
#: Character classes counted on what is left of a text without small letters and white space; those two and the
#: other characters (mostly letters beyond ASCII) are the remaining classes.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "mark": ".,;:!?'\"()-", "symbol": SYMBOL_CHARS}
SHARES = ("space", "lower", *CLASSES, "other")


def _count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are 64-bit hashes of their words. Sorting the hashes shows the repeated ones; where these are few,
    their positions are looked up, else (hash, position) is sorted as well. The words that they cover are counted
    by the gaps between positions.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, _at(words, i + 1), _at(words, i + 2)))
    covered = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(_at(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def looked_up(hs: Column, twice: Column) -> Column:
        return F.filter(F.transform(hs, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def by_sorting(hs: Column) -> Column:
        keyed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _with(keyed, lambda a: F.filter(a, lambda x, j: (x["h"] == _at(a, j + 1)["h"]) | ((j > 0) & (x["h"] == _at(a, F.greatest(j - 1, F.lit(0)))["h"]))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def count(hs: Column) -> Column:
        twice = _with(F.sort_array(hs), lambda a: F.array_distinct(F.filter(a, lambda h, j: h == _at(a, j + 1))))
        return _with(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(
            _with(F.when(F.size(d) <= LOOKED_UP, looked_up(hs, d)).otherwise(by_sorting(hs)), covered)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_with(hashes, count))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id and language with ``words`` and the base counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    rows = rows.withColumn("_rest", F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")).withColumn("chars", F.char_length("text"))
    word_chars = F.char_length(F.array_join("words", ""))
    return rows.select(
        "doc_id", "lang", "words", "chars", word_chars.cast("long").alias("word_chars"), (F.col("chars") - word_chars).alias("space"),
        *[_count_of(F.col("_rest"), chars).alias(name) for name, chars in CLASSES.items()], F.char_length("_rest").alias("_left"),
        F.size("words").cast("long").alias("n_words"),
        _with(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    ).withColumns({"lower": F.col("chars") - F.col("space") - F.col("_left"), "other": F.col("_left") - sum((F.col(c) for c in CLASSES), F.lit(0)),
                   "n_symbols": F.col("symbol").cast("long")})


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """By language: shares of the character classes, and of its most frequent words. Their size is languages x (7 + COMMON)."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("lang is not null")
    rest = F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")
    parts = rows.select("lang", F.char_length("text").alias("chars"), F.char_length(F.regexp_replace("text", SPACE, "")).alias("dense"), rest.alias("rest"))
    classes = parts.groupBy("lang").agg(F.sum("chars").alias("chars"), F.sum("dense").alias("dense"), F.sum(F.char_length("rest")).alias("left"),
                                        *[F.sum(_count_of(F.col("rest"), c)).alias(k) for k, c in CLASSES.items()]).collect()
    counted = stored(rows.select("lang", F.explode(F.split("text", SPACE, -1)).alias("word")).filter("word != ''")
                     .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = {r["lang"]: r["total"] for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    # the rank limit is applied in each task before the shuffle, so that one language is no hot partition
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common)
    frequent: dict[str, list[tuple[int, str, int]]] = {}
    for r in ranked.collect():
        frequent.setdefault(r["lang"], []).append((r["rank"], r["word"], r["n"]))
    release(counted)
    if not totals:
        return {}
    out = {}
    for r in classes:
        n = {k: r[k] for k in CLASSES}
        n |= {"space": r["chars"] - r["dense"], "lower": r["dense"] - r["left"], "other": r["left"] - sum(n.values())}
        shares = {k: n[k] / max(1, r["chars"]) for k in SHARES}
        out[r["lang"]] = shares, {w: n / totals[r["lang"]] for _, w, n in sorted(frequent.get(r["lang"], []))}
    return dict(sorted(out.items()))


def _divergence_part(p: Column, q: Column) -> Column:
    """p's and q's share of the Jensen-Shannon divergence in bits; q > 0 or p > 0."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def _chance(n: int, q: float) -> tuple[float, float]:
    """Mean and variance of a bin's part of the divergence in bits, where ``n`` words are drawn and the bin's share is ``q``."""
    if q <= 0:
        return 0.0, 0.0
    if n * q > 50:  # nearly normal: the divergence is a chi-square
        mean = (1 - q) / (8 * n * math.log(2))
        return mean, 2 * mean * mean
    first = second = 0.0
    for k in range(min(n, int(n * q + 12 * math.sqrt(n * q) + 30)) + 1):
        if q >= 1 and k < n:
            continue
        chance = 1.0 if q >= 1 else math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q))
        p, m = k / n, (k / n + q) / 2
        part = ((p * math.log2(p / m) if k else 0.0) + q * math.log2(q / m)) / 2
        first, second = first + chance * part, second + chance * part * part
    return first, max(0.0, second - first * first)


def word_bounds(reference: dict[str, float]) -> list[float]:
    """The largest word distance that is kept, by length step."""
    shares = [*reference.values(), max(0.0, 1 - sum(reference.values()))]
    out = []
    for step in range(BOUND_STEPS):
        mean, var = (sum(x) for x in zip(*(_chance(int(MIN_WORDS * 2 ** (step / 2)), q) for q in shares), strict=True))
        out.append(math.sqrt(mean + DEVIATIONS * math.sqrt(var) + SUBJECT_DISTANCE ** 2))
    return out


def _word_bound(words: Column, reference: dict[str, float]) -> Column:
    step = F.floor(2 * F.log2(F.greatest(words, F.lit(MIN_WORDS)) / F.lit(float(MIN_WORDS)))).cast("int")
    return F.get(F.array(*map(F.lit, word_bounds(reference))), F.least(step, F.lit(BOUND_STEPS - 1)))


def _class_distance(reference: dict[str, float]) -> Column:
    chars = F.greatest(F.col("chars"), F.lit(1))
    return F.sqrt(F.greatest(F.lit(0.0), sum((_divergence_part(F.col(k) / chars, F.lit(float(reference[k]))) for k in SHARES), F.lit(0.0))))


def _word_distance(counts: Column, total: Column, reference: dict[str, float]) -> Column:
    """``counts``: array of (word, n) of the document's common words of any language."""
    share = F.create_map(*[x for w, q in reference.items() for x in (F.lit(w), F.lit(float(q)))])
    known = F.filter(counts, lambda x: x["w"].isin(list(reference)))
    rest = max(0.0, 1 - sum(reference.values()))
    n = F.greatest(total, F.lit(1))
    seen = F.aggregate(known, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda a, x: F.struct(
        (a["d"] + _divergence_part(x["n"] / n, F.element_at(share, x["w"]))).alias("d"),
        (a["p"] + x["n"] / n).alias("p"), (a["q"] + F.element_at(share, x["w"])).alias("q")))
    # words of the reference that the text lacks add half their share; all other words are one bin
    return _with(seen, lambda s: F.sqrt(F.greatest(F.lit(0.0), s["d"] + F.greatest(F.lit(0.0), F.lit(1 - rest) - s["q"]) / 2
                                                  + _divergence_part(F.greatest(F.lit(0.0), 1 - s["p"]), F.lit(rest)))))


def _run_lengths(sorted_words: Column) -> Column:
    """(word, n) of a sorted array."""
    size = F.size(sorted_words)
    heads = F.filter(F.transform(sorted_words, lambda w, i: F.when((i == 0) | (w != _at(sorted_words, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
    return _with(heads, lambda h: F.transform(h, lambda p, j: F.struct(_at(sorted_words, p).alias("w"), (F.coalesce(_at(h, j + 1), size) - p).alias("n"))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with the base counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    known = references(docs, text_col, lang_col)
    rows = measures(docs, id_col, text_col, lang_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    if known:
        common = sorted({w for _, words in known.values() for w in words})
        hits = F.sort_array(F.filter("words", lambda w: w.isin(common)))
        rows = rows.withColumn("counts", _with(hits, _run_lengths))
        # the language whose common words make up most of the text; of equal ones the first
        weight = lambda words: F.aggregate(F.filter("counts", lambda x: x["w"].isin(list(words))), F.lit(0), lambda a, x: a + x["n"])
        order = F.array(*[F.struct(weight(words).alias("n"), F.lit(-i).alias("i")) for i, (_, words) in enumerate(known.values())])
        rows = rows.withColumn("_language", -F.array_max(order)["i"])
        total = F.col("n_words").cast("double")
        near = F.coalesce(*[F.when(F.col("_language") == i, F.struct(
            _word_distance(F.col("counts"), total, words).alias("word"), _class_distance(shares).alias("class"), _word_bound(total, words).alias("bound")))
                            for i, (shares, words) in enumerate(known.values())])
        rows = rows.withColumn("nearest", near)
    else:
        rows = rows.withColumn("nearest", F.struct(F.lit(0.0).alias("word"), F.lit(0.0).alias("class"), F.lit(0.0).alias("bound")))
    slack = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    near = ((F.col("nearest.class") <= MAX_CLASS_DISTANCE + CLASS_SLACK * slack / math.sqrt(6)) & (F.col("nearest.word") <= F.col("nearest.bound")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(near).alias("kept"),
        F.col("nearest.class").alias("class_distance"), F.col("nearest.word").alias("word_distance"))
