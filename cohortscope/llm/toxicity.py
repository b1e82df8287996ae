"""Toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learned from labelled rows: words that toxic texts have and
clean ones have not, each toxic text dividing one vote among its words, so a
group of copies cannot vote its whole vocabulary in. The terms form a trie;
a set of (trie node, edits) pairs is a state of the trie intersected with the
terms' Levenshtein automata, and the reached sets become a deterministic
automaton as words are read. A word matches the nearest term within that
term's edits (none below four letters, one below nine, else two); of a word
that matches none the parts between inner marks are tried. Misspelled
forms that clean training texts hold are no matches.

Each match is weighed by its context window: quotation marks or reporting
words lower it, an addressee or another match raise it. The evidence of a text
by edits (none, one, two) is turned into a probability by a logistic model with
weights for each. It is fitted crosswise: rows of one half (by the hash of the
text, so that copies stay together) are matched without the clean forms of the
other half alone, as new texts are.

Training uses at most ``SAMPLE`` labelled rows (a documented bound); every
document is scored in full. Null and empty texts have no match and get the
model's score for none. Without labelled rows, or with one class only, all
scores are 0. Labels of repeated ids count as toxic if one is; ties take the
first term in order; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, stored, word_stream

SAMPLE = 20_000
MIN_DOCS = 5
MIN_VOTES = 1.0
VOTE_SHARE = 1e-3
MAX_CLEAN_SHARE = 0.02
WINDOW = 5
STATES = 200_000
#: Words that announce a quotation, and words that address someone (fixed values).
REPORTING = frozenset("said says wrote writes quote quoted quotes called word words term terms sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split())
ADDRESS = frozenset("you your youre du dich dein ihr tu te ton toi vous usted tú".split())
QUOTES = "\"'“”„‟«»‹›‘’‚`"
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + QUOTES + "…–—¿¡"
INNER = re.compile("[" + re.escape(EDGE) + "]+")


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class TrieAutomaton:
    """All terms' Levenshtein automata run over one trie, made deterministic step by step."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most = [0]  # edits that some term below a node allows
        for t, term in enumerate(terms):
            node, allowed = 0, edits_for(term)
            self.most[0] = max(self.most[0], allowed)
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], allowed)
            if self.ends[node] < 0:
                self.ends[node] = t
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0} if self.terms else {})

    def _state(self, reached: dict[int, int]) -> int:
        """Closes the set under left-out term letters and numbers it; -1 is the dead state."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if reached.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and reached.get(child, 9) > e + 1:
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        if not reached:
            return -1
        key = frozenset(reached.items())
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            done = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= edits_for(self.terms[self.ends[n]])]
            self.accepts.append(min(done) if done else None)
        return found

    def _step(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and reached.get(node, 9) > e:
                reached[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e if letter == ch else e + 1)
        nxt = self.steps[state][ch] = self._state(reached)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        if len(self.sets) > STATES:
            self._reset()
        state = self.start
        for ch in word:
            if state < 0:
                return None
            nxt = self.steps[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
        return self.accepts[state] if state >= 0 else None


class Matcher:
    """Finds weighed matches in a slice of texts."""

    def __init__(self, terms: list[str], clean_forms: frozenset[str] = frozenset()):
        self.automaton, self.clean, self.memo = TrieAutomaton(terms), clean_forms, {}

    def form(self, word: str) -> tuple[int, int, str] | None:
        """(edits, term number, form) of a word, without what stands around it."""
        if word not in self.memo:
            if len(self.memo) > STATES:
                self.memo.clear()
            core = word.strip(EDGE)
            parts = INNER.split(core)
            self.memo[word] = self._nearest([core]) or (self._nearest(parts) if len(parts) > 1 else None)
        return self.memo[word]

    def _nearest(self, cores: list[str]) -> tuple[int, int, str] | None:
        found = [(*hit, core) for core in cores if core and (hit := self.automaton.match(core)) and not (hit[0] and core in self.clean)]
        return min(found) if found else None

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
        """(n, 3) evidence by edits (none, one, two); and every match as (text, form, edits)."""
        codes, offsets, words = word_stream(texts)
        out, matches = np.zeros((len(offsets) - 1, 3)), []
        form = [self.form(w) for w in words]
        hit = np.array([f is not None for f in form], bool)
        if not hit.any():
            return out, matches
        at = np.flatnonzero(hit[codes])
        owner = np.searchsorted(offsets, at, "right") - 1
        for p, d in zip(at.tolist(), owner.tolist(), strict=True):
            word, (edits, _, core) = words[codes[p]], form[codes[p]]
            near = [words[c] for c in codes[max(offsets[d], p - WINDOW):min(offsets[d + 1], p + WINDOW + 1)].tolist()]
            plain = [w.strip(EDGE) for w in near]
            quoted = word[0] in QUOTES or word.rstrip(".,;:!?")[-1:] in tuple(QUOTES)
            weight = 1.0
            if quoted or any(w in REPORTING for w in plain):
                weight *= 0.3 if quoted and any(w in REPORTING for w in plain) else 0.6
            if any(w in ADDRESS for w in plain) or sum(self.form(w) is not None for w in near) > 1:
                weight *= 1.5
            out[d, edits] += weight / (1 + edits)
            matches.append((d, core, edits))
        return out, matches


def features(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(evidence)), np.log1p(evidence), evidence > 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, by Newton's method; ``n``: rows that each row stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, terms: list[str], clean: frozenset[str], weights: np.ndarray | None):
        self.terms, self.clean, self.weights = terms, clean, weights


def train(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows for which ``use`` (of the labels' doc_id) holds."""
    marked = labels.filter(use).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = marked.count()
    share = min(1.0, sample / max(1, size))
    some = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
                  .select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxic_sample")

    def per_text(part: pa.RecordBatch) -> Iterator[tuple[int, set[str]]]:
        codes, offsets, words = word_stream(part["text"])
        core = [w.strip(EDGE) for w in words]
        for i, toxic in enumerate(part["toxic"].to_pylist()):
            yield toxic, {core[c] for c in codes[offsets[i]:offsets[i + 1]].tolist()} - {""}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for toxic, words in per_text(part):
                    for w in words:
                        n.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "clean": pa.array([x[0] for x in n.values()], pa.int64()),
                                          "toxic": pa.array([x[1] for x in n.values()], pa.int64())})

    pure = (rows.mapInArrow(tally, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .filter((F.col("toxic") >= MIN_DOCS) & (F.col("clean") <= MAX_CLEAN_SHARE * F.col("toxic"))))
    wanted = frozenset(r["word"] for r in pure.select("word").collect())  # bounded by the sample

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for _, words in per_text(part):
                    mine = words & wanted
                    for w in mine:
                        n[w] = n.get(w, 0.0) + round(1000 / len(mine))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "votes": pa.array(list(n.values()), pa.float64())})

    toxic_rows = rows.filter("toxic = 1")
    least = max(MIN_VOTES, VOTE_SHARE * toxic_rows.count())
    votes = toxic_rows.mapInArrow(vote, "word string, votes double").groupBy("word").agg((F.sum("votes") / 1000).alias("votes"))
    terms = sorted(r["word"] for r in votes.filter(F.col("votes") >= least).collect())
    if not terms:
        return Model([], frozenset(), None)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = Matcher(terms), set()
        for batch in batches:
            for part in slices(batch, "text"):
                half = part["half"].to_pylist()
                seen |= {(half[i], core) for i, core, edits in m.evidence(part["text"])[1] if edits}
        yield pa.RecordBatch.from_pydict({"half": pa.array([h for h, _ in seen], pa.int32()), "form": pa.array([f for _, f in seen], pa.string())})

    met: tuple[set[str], set[str]] = set(), set()
    for r in rows.filter("toxic = 0").mapInArrow(forms, "half int, form string").distinct().collect():
        met[r["half"]].add(r["form"])
    clean = frozenset(met[0] | met[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(terms, frozenset(met[1 - half])) for half in (0, 1)]
        for batch in batches:
            for some in slices(batch, "text"):
                for half, m in enumerate(matchers):
                    part = some.filter(pc.equal(some["half"], half))
                    e = np.round(m.evidence(part["text"])[0], 1)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, e.T), part["toxic"]], ["none", "one", "two", "toxic"])

    by = ["none", "one", "two", "toxic"]
    t = rows.mapInArrow(measure, "none double, one double, two double, toxic int").groupBy(by).count().orderBy(by).toPandas()
    release(rows)
    if t["toxic"].nunique() < 2:
        return Model(terms, clean, None)
    x = features(t[["none", "one", "two"]].to_numpy())
    return Model(terms, clean, fit_logistic(x, t["toxic"].to_numpy(float), t["count"].to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, exact and misspelled evidence."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        matcher = Matcher(m.terms, m.clean)
        for batch in batches:
            for part in slices(batch, "_text"):
                e = matcher.evidence(part["_text"])[0]
                p = np.zeros(len(e)) if m.weights is None else 1 / (1 + np.exp(-np.clip(features(e) @ m.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([part["_id"], pa.array(p), pa.array(e[:, 0]), pa.array(e[:, 1:].sum(1))], ["_id", "score", "exact", "misspelled"])

    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(run, f"_id {kind}, score double, exact double, misspelled double").withColumnRenamed("_id", id_col))
