"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed rules give the base spans (e-mail, IP, card, phone). Beside them,
high-recall generators propose candidates, which may overlap one another.
Every candidate has format and context features, all of few values, and a
check on its content that is no feature: the last label of a host is a
top-level domain, octets are at most 255, the card's check digit holds, a
national phone number has a trunk zero or a legal area code and is no date.
Something that only looks alike passes the check by chance, at a known rate
(``chance``). Training data are the candidates of the whole corpus, counted by
feature values and check; the table's size is bounded by the number of feature
values. Boosted trees of depth two are fitted to it. In each cell (generator
and format) the threshold is the least one at which the candidates above it
that no base span touches show ``PRECISION``, estimated as their passes beyond
chance over what real ones would show, with ``PRIOR`` candidates of the
trees' own opinion added. The trees are fitted to four fifths of the
documents; a cell counts the candidates of all. Candidates at or above the
threshold that pass the check and touch no base span are added. The trees are
applied as CASE expressions.

Null and empty texts have no spans; without any candidate nothing is added;
repeated rows and ids give one row each; extra columns are not read. The work
for a text grows with its length, and with the square of its number of matches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base formats (fixed values). Quantifiers are possessive where nothing that follows could use what they
#: give back, and starts are tied to the start of a run: the same leftmost matches, without rescans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators: wider than the base formats.
GENERATORS = {
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip_like": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card_like": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone_like": r"(?<![0-9A-Za-z.+-])\+?\(?[0-9]{1,4}+\)?+(?:[ .()-]{1,2}+[0-9]{2,4}+){2,4}+(?![0-9A-Za-z-])",
}
#: Endings of hosts (fixed values); two letters are a country's.
ENDINGS = r"(?i)[^A-Za-z0-9](com|org|net|edu|gov|mil|info|biz|name|example|test|[a-z]{2})$"
#: Year-month-day and day-month-year or month-day-year.
DATES = (r"^(?:[0-9]{4}[ .-](?:0[1-9]|1[0-2])[ .-](?:0[1-9]|[12][0-9]|3[01])(?:[ .-][0-9]{2}){0,2}"
         r"|(?:0[1-9]|[12][0-9]|3[01])[ .-](?:0[1-9]|[12][0-9]|3[01])[ .-](?:[0-9]{4}|[0-9]{2}))$")
CONTEXT = r"(?i)(phone|tel|call|fax|mobile|card|visa|account|mail|contact|host|server|address|ip)[a-z]*[^A-Za-z0-9]{0,3}$"
FEATURES = ("gen", "digits", "groups", "marks", "brackets", "lead", "cue", "before", "after")
ROUNDS, RATE = 24, 0.4
PRECISION = 0.95
PRIOR = 0.25


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, gate: str) -> Column:
    """Array of (s, e, m): code-point offsets and text of all matches, from the lengths of what lies between."""
    span = "struct<s:int,e:int,m:string>"
    none = F.lit(None).cast(f"array<{span}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def placed(pair: Column) -> Column:
        return F.aggregate(
            F.transform(pair["g"], lambda g, i: F.struct(g.alias("g"), F.get(pair["m"], i).alias("m"))), start,
            lambda acc, x: _with(acc["at"] + x["g"], lambda s: F.when(x["m"].isNull(), acc).otherwise(F.struct(
                (s + F.char_length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out")))))["out"]

    spans = _with(F.struct(found.alias("m"), gaps.alias("g")), placed)
    return F.coalesce(F.when(text.rlike(gate), spans).otherwise(none), F.array().cast(f"array<{span}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the check digit holds."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + _with(F.substring(digits, n + 1 - i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))))
    return total % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], GATES[kind]), lambda x: _holds(kind, x["m"]))


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike("^[A-Za-z0-9]$"), 1).when(c.rlike(r"^\s$"), 2).otherwise(3)


def _passes(gen: int, m: Column, d: Column) -> Column:
    """Whether a candidate's content holds."""
    if gen == 0:
        return m.rlike(ENDINGS)
    if gen == 1:
        return _holds("ip", m)
    if gen == 2:
        return luhn(d)
    national = d.rlike("^0[1-9]") & F.length(d).between(9, 12) | d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    return national & ~m.rlike(DATES)


def chance(gen: int, digits: int) -> float:
    """The rate at which something that only looks alike passes: a word that is an ending, four numbers of up to
    three digits within a byte, a check digit, a first digit zero (or a legal area code and exchange)."""
    if gen == 3:
        return 0.09 + (0.64 if digits == 10 else 0.0)
    return (0.05, 0.01, 0.1)[gen]


def _features(text: Column, gen: int, x: Column) -> Column:
    m, d = x["m"], _digits(x["m"])
    whole = lambda c: c.cast("int")
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), whole(_passes(gen, m, d)).alias("ok"), F.lit(gen).alias("gen"),
        F.least(F.length(d), F.lit(20)).alias("digits"),
        F.least(F.size(F.split(m, "[^A-Za-z0-9]+")), F.lit(7)).alias("groups"),
        F.least(F.length(F.regexp_replace(m, r"[A-Za-z0-9]", "")), F.lit(7)).alias("marks"),
        whole(m.rlike(r"[()\[\]]")).alias("brackets"),
        F.when(F.lit(gen == 2), F.coalesce(F.substring(d, 1, 1).cast("int"), F.lit(0))).otherwise(0).alias("lead"),
        whole(F.substring(text, F.greatest(x["s"] - 19, F.lit(1)), F.least(x["s"], F.lit(20))).rlike(CONTEXT)).alias("cue"),
        _char_class(F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise("")).alias("before"),
        _char_class(F.substring(text, x["e"] + 1, F.lit(1))).alias("after"))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document the base spans of each kind and all candidates with features and ``base`` (a base span touches them)."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", *[F.transform(base_spans(text, k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS])
    rows = rows.withColumn("_base", F.concat(*KINDS))
    gates = ("@|[(\\[]at[)\\]]", r"[0-9]\.[0-9]", r"[0-9][ -]?[0-9]", r"[0-9][ .()-]{1,2}[0-9]")

    def generated(i: int, pattern: str) -> Column:
        return F.transform(matches(text, pattern, gates[i]), lambda x: _features(text, i, x))

    found = [generated(i, pattern) for i, pattern in enumerate(GENERATORS.values())]
    return rows.withColumn("_found", F.concat(*found)).select("doc_id", *KINDS, F.transform("_found", lambda c: c.withField(
        "base", F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])).cast("int"))).alias("found"))


# ------------------------------------------------------------- boosting
Tree = tuple  # (feature, cut, left, right): values below or at the cut go left; a leaf is a float


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if not depth:
        return leaf
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1].tolist():
            left = x[:, f] <= cut
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _value(left, x), _value(right, x))


def fit(x: np.ndarray, positive: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Boosted trees for counted rows: the start value and the trees (already scaled)."""
    start = math.log((positive.sum() + 1) / (n.sum() - positive.sum() + 1))
    z, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _scaled(_grow(x, n * p - positive, n * p * (1 - p), 2), rate)
        trees.append(tree)
        z = z + _value(tree, x)
    return start, trees


def _scaled(tree: Tree | float, rate: float) -> Tree | float:
    return tree * rate if isinstance(tree, float) else (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def _expression(tree: Tree | float, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(c[FEATURES[tree[0]]] <= int(tree[1]), _expression(tree[2], c)).otherwise(_expression(tree[3], c))


#: What a cell is told apart by; for e-mail and IP the number of digits says nothing.
CELL = ("gen", "digits", "groups", "brackets")


def _cell(row) -> tuple[int, ...]:
    return tuple(0 if f == "digits" and row["gen"] < 2 else int(row[f]) for f in CELL)


def train(found: DataFrame) -> tuple[float, list, dict[tuple[int, ...], float]]:
    """Start value, trees and each cell's threshold (of the summed trees), from the candidates of all documents."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("back")
    table = (found.select(fold, F.explode("found").alias("c")).groupBy("back", "c.base", "c.ok", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
             .agg(F.count(F.lit(1)).alias("n")).orderBy("back", "base", "ok", *FEATURES).collect())  # bounded by the feature values
    if not table:
        return 0.0, [], {}
    x = np.array([[r[f] for f in FEATURES] for r in table], np.int64)
    n, ok, base, back = (np.array([r[f] for r in table], float) for f in ("n", "ok", "base", "back"))
    fitted = (back == 0) if (back == 0).any() else np.ones(len(table), bool)
    start, trees = fit(x[fitted], (n * np.maximum(ok, base))[fitted], n[fitted])
    z = start + sum((_value(t, x) for t in trees), np.zeros(len(x)))
    opinion = 1 / (1 + np.exp(-z))
    by_chance = np.array([chance(r["gen"], r["digits"]) for r in table])
    cells: dict[tuple[int, ...], list[int]] = {}
    for i, r in enumerate(table):
        if not r["base"]:
            cells.setdefault(_cell(r), []).append(i)
    limits = {}
    for cell, mine in sorted(cells.items()):
        at = np.array(mine)
        for cut in sorted(set(np.round(z[at], 6).tolist())):
            above = at[z[at] >= cut - 1e-6]
            beyond = (n * (ok - by_chance))[above].sum() + PRIOR * np.average(opinion[above], weights=n[above])
            if beyond >= PRECISION * ((n * (1 - by_chance))[above].sum() + PRIOR):
                limits[cell] = cut - 1e-6
                break
    return start, trees, limits


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base spans of each kind and ``added``: array of (kind, s, e) of the accepted candidates, none touching a base span or a better one before it."""
    rows = scanned(docs, id_col, text_col)
    start, trees, limits = train(rows)
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if not limits:
        return rows.select("doc_id", *KINDS, none.alias("added"))
    z = lambda c: sum((_expression(t, c) for t in trees), F.lit(start))
    levels = F.create_map(*[v for cell, level in limits.items() for v in (F.lit(":".join(map(str, cell))), F.lit(level))])
    cell = lambda c: F.concat_ws(":", *[F.when(c["gen"] < 2, 0).otherwise(c[f]) if f == "digits" else c[f] for f in CELL])
    limit = lambda c: F.get(F.transform(F.array(cell(c)), lambda k: F.try_element_at(levels, k)), F.lit(0))
    name = lambda c: F.coalesce(*[F.when(c["gen"] == g, F.lit(k)) for g, k in enumerate(GENERATORS)])
    good = F.filter("found", lambda c: (c["base"] == 0) & (c["ok"] == 1) & F.coalesce(z(c) >= limit(c), F.lit(False)))
    ordered = F.sort_array(F.transform(good, lambda c: F.struct(c["gen"].alias("gen"), c["s"].alias("s"), c["e"].alias("e"))))
    apart = F.aggregate(ordered, none, lambda acc, c: F.when(
        F.exists(acc, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(name(c).alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))))
    return rows.select("doc_id", *KINDS, apart.alias("added"))


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans, one row per document."""
    found = find(docs, id_col)
    line = lambda kind, x: F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))
    named = lambda kind: F.transform(kind, lambda x: line(F.lit(kind), x))
    base = F.concat(*[named(k) for k in KINDS])
    both = F.concat(base, F.transform("added", lambda x: line(x["kind"], x)))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", both).alias("spans"))

