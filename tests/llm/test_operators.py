"""Operators without fixed base columns, held against brute force, held-out rows or planted cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortscope.llm import common, divergence, langid, lm, neardup, tiling, toxicity
from cohortscope.llm.common import held_out
from cohortscope.llm.queries import QUERIES

from .conftest import SCHEMA, SF


def crc_is(i, m, k):
    return i is not None and zlib.crc32(str(i).encode()) % m == k


def test_word_helpers():
    texts = ["  a b\tc ", "", None, "aÝb éà \u0085z\x1cq", "\n", "B b"]
    codes, offsets, words = common.word_stream(pa.array(texts), None)
    hashes, same = common.word_hashes(pa.array(texts), None)
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])] == [["a", "b", "c"], [], [], ["aÝb", "éà", "\u0085z\x1cq"], [], ["B", "b"]]
    assert (offsets == same).all() and hashes[1] == hashes[-1] and len(set(hashes.tolist())) == 7
    assert len(common.word_stream(pa.array([], pa.string()), "utf8")[0]) == 0


def test_stored_leaves_no_shuffle_files(spark):
    import tempfile
    import time
    from pathlib import Path

    def files():
        return {f for d in Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("blockmgr-*") for f in d.glob("*/shuffle_*.data")}

    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    before = files()
    back = common.stored(rows.groupBy("k").agg(F.sum("id").alias("s")).join(rows, "k").repartition(3, "s"), "test")
    until = time.time() + 10  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert back.count() == 1000 and spark.conf.get(common.CLEANUP) == "false"


# --------------------------------------------------------------- op1
def shingle_set(text):
    w = [x for x in neardup_words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def neardup_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def brute_groups(rows):
    """Components of all pairs with a similarity of 0.8 or more, by an inverted index."""
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for ids in holders.values():
        for j, b in enumerate(ids):
            for a in ids[:j]:
                both[a, b] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if a != b and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_neardup_on_the_whole_table(spark, sf_rows):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_minhash_neardup"](spark, SF).collect()}
    assert got == brute_groups(sf_rows)


def test_neardup_odd_rows(spark, odd, odd_rows, empty):
    got = neardup.groups(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute_groups(odd_rows)
    assert all(r["class_id"] == want.get(r["doc_id"]) for r in got)
    assert neardup.groups(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted({*want.values()})


def test_large_and_chained_groups(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):  # near copies of one text: a changed word each
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w), None, None, 0))
    chain = [f"c{k}" for k in range(300)]
    for i in range(300, 320):  # neighbours are similar, the ends are not
        rows.append((i, " ".join(chain), None, None, 0))
        chain = chain[20:] + [f"d{i}-{k}" for k in range(20)]
    rows += [(400 + i, " ".join(f"u{i}-{k}" for k in range(50)), None, None, 0) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_groups(rows)


def test_similar_texts_that_no_pivot_meets(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**9)}"
    template, rows = [word() for _ in range(100)], []
    for i in range(120):  # pages of one template, none similar to another
        rows.append((i, " ".join(template + [word() for _ in range(30)]), None, None, 0))
    for i in range(120, 180, 2):  # and pairs of similar ones, each unlike all the others
        own = [word() for _ in range(30)]
        rows += [(i + j, " ".join(template + own + [word() for _ in range(4)]), None, None, 0) for j in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["class_id"] for r in neardup.groups(df).collect()} == brute_groups(rows)
    # all in one bucket, nothing linked yet: the exact pairs
    texts = df.select(F.col("doc_id").alias("id"), "text")
    pairs = neardup.rest_pairs(df.select(F.lit(1).alias("key"), F.col("doc_id").alias("rep")), spark.createDataFrame([], "id long, root long"), texts, 0.8)
    links = {tuple(r) for r in neardup.similar(pairs, texts).collect()}
    assert links == {(i, i + 1) for i in range(120, 180, 2)}


def test_texts_without_a_bucket_are_not_shuffled(spark):
    rows = [(i, f"text {i}", None, None, 0) for i in range(3000)] + [(5, "a second text 5", None, None, 0), (None, "no id", None, None, 0)]
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 4000)], "id long")
    got = neardup.candidates(spark.createDataFrame(rows, SCHEMA), wanted)
    assert {tuple(r) for r in got.collect()} == {(3, "text 3"), (5, "a second text 5")}
    plan = neardup.candidates(spark.read.parquet(f"{SF}/documents.parquet"), wanted)._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, x in enumerate(plan) if "FileScan" in x and "text" in x)
    test = next(i for i, x in enumerate(plan) if "getbit" in x)
    assert test < scan and not any("Exchange" in x for x in plan[test:scan])  # the bit is tested where the texts are read


def test_later_rounds_join_groups_not_all_their_links(spark):
    first = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(50, 51), (52, 53)]  # every pair of a large group
    links = spark.createDataFrame(first, "a long, b long")
    found = spark.createDataFrame([(39, 52), (60, 61)], "a long, b long")
    after = neardup.joined(neardup.components(links), found)
    assert after.count() == 39 + 2 + 2  # one for each member, and the new ones
    roots = lambda df: {tuple(r) for r in neardup.components(df).collect()}
    assert roots(after) == roots(links.unionByName(found))


def test_components_take_no_round_to_see_that_they_are_done(spark, monkeypatch):
    rng = random.Random(8)
    ids = rng.sample(range(1000), 300)
    first = list(zip(ids, ids[1:40])) + [(ids[rng.randrange(40, 200)], ids[rng.randrange(40, 200)]) for _ in range(150)]  # a chain and a random graph
    first += [(i, ids[200]) for i in ids[201:]] + first[:9] + [(b, a) for a, b in first[:9]] + [(5000, 5000), (None, 5001), (None, None)]
    root = {i: i for p in first if None not in p and p[0] != p[1] for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in first:
        if a in root and b in root:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    links = spark.createDataFrame(first, "a long, b long")
    want = {(i, find(i)) for i in root}
    assert sorted(tuple(r) for r in neardup.components(links).collect()) == sorted(want)
    assert sorted(tuple(r) for r in neardup.stars(links, 2).collect()) == sorted((i, r) for i, r in want if i != r)
    written, stored = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name, files=None: written.append(name) or stored(df, name, files))
    flat = spark.createDataFrame([(i, 0) for i in range(1, 50)], "a long, b long")
    assert {tuple(r) for r in neardup.components(flat).collect()} == {(i, 0) for i in range(50)} and len(written) == 1


def test_short_texts_and_narrow_tables_are_held_small(spark):
    batch = pa.RecordBatch.from_pydict({"text": ["a b"] * 4000 + [None, "x" * 3_000_000, ""]})
    parts = [p.num_rows for p in common.slices(batch, "text", neardup.SLICE, neardup.DART_BYTES)]
    assert sum(parts) == 4003 and max(parts) <= neardup.SLICE // neardup.DART_BYTES  # as many darts for each as for a long one
    assert max(p.num_rows for p in common.slices(batch, "text", langid.TRIGRAM_SLICE, langid.ROW_BYTES)) <= langid.TRIGRAM_SLICE // langid.ROW_BYTES
    back = common.stored(spark.range(0, 1000, 1, 50), "narrow", 3)
    assert len(back.inputFiles()) == 3 and back.agg(F.sum("id"), F.count("id")).first()[:] == (499500, 1000)


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_darts_estimate_weighted_jaccard(weighting):
    rng = np.random.default_rng(1)
    n, k = 400, 20_000
    a = np.ones(n) if weighting == "set" else rng.integers(1, 7, n).astype(float) + rng.random(n)
    b = a.copy()
    elements = common.mix(np.arange(n).astype(np.uint64))
    others = elements.copy()
    others[:50] = common.mix(np.arange(1000, 1050).astype(np.uint64))
    if weighting == "count":
        b[100:200] = rng.integers(1, 9, 100)
    sig = neardup.dart_signatures(np.repeat([0, 1], n), np.concatenate((elements, others)), np.concatenate((a, b)), 2, k)
    least = np.minimum(a, b)[50:].sum()
    truth = least / (a.sum() + b.sum() - least)
    assert abs((sig[0] == sig[1]).mean() - truth) < 5 * (truth * (1 - truth) / k) ** 0.5
    alone = neardup.dart_signatures(np.zeros(n, int), elements, a, 1, k)
    assert (alone[0] == sig[0]).all()  # a signature does not depend on its batch


# --------------------------------------------------------------- op2
def test_language_held_out(spark, odd, odd_rows, empty, sf_rows):
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(sf_rows) and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r[0]: r[2] for r in sf_rows}
    back = [i for i in truth if crc_is(i, 3, 1)]
    assert all(got[i]["held_out"] == crc_is(i, 3, 1) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in back) >= 0.97 * len(back)
    prototypes = langid.train(odd, ~held_out("doc_id", 3, 1))
    pred = langid.predict(odd, prototypes).collect()
    assert len(pred) == len(odd_rows)
    und = {r["doc_id"] for r in pred if r["lang_pred"] == "und"}
    assert und == {0, 1, 2, 4}
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(empty, F.lit(True))).collect()} == {"und"}
    assert langid.predict(empty, prototypes).count() == 0
    again = langid.train(odd.repartition(7), ~held_out("doc_id", 3, 1))
    assert all((again[k] == v).all() for k, v in prototypes.items())  # any partitioning learns the same


def test_bundles_against_plain_sums():
    text = "Ab cÉd  e"
    owner, code, has = langid.trigrams(pa.array([text, None, "12"]))
    v = langid._letters(64, langid.SEED)
    symbols = [0, *[int(langid._symbols()[ord(c)]) for c in "Ab"], 0, *[int(langid._symbols()[ord(c)]) for c in "cÉd"], 0, int(langid._symbols()[ord("e")]), 0]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(symbols, symbols[1:], symbols[2:]) if b)
    assert (langid.bundles(owner, code, 3, 64, langid.SEED)[0] == want).all() and has.tolist() == [True, False, False]


# --------------------------------------------------------------- op3
def test_toxicity_held_out(spark, odd, odd_rows, empty):
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    back = [i for i in labels if crc_is(i, 3, 1)]
    hit = [i for i in back if got[i]["predicted"]]
    assert sum(labels[i] for i in hit) >= 0.9 * len(hit) and len(hit) >= 0.6 * sum(labels[i] for i in back)
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    scored = toxicity.score(odd, none).collect()
    assert len(scored) == len(odd_rows) and {r["score"] for r in scored} == {0.0}
    assert toxicity.score(empty, none).count() == 0


def test_misspelled_terms_weigh_what_new_texts_show(spark):
    """Clean texts are full of words two edits from a term, each in one text only: no reason to trust such a match."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(300)]

    def near(word, edits):
        for k in rng.sample(range(len(word)), edits):
            word = word[:k] + rng.choice("fhjmpqvwxyz") + word[k + 1:]
        return word

    def text(*extra):
        words = [rng.choice(plain) for _ in range(30)]
        for x in extra:
            words.insert(rng.randrange(30), x)
        return " ".join(words)

    rows = [(i, text("blackguard"), 1) if i % 4 == 0 else (i, text(near("blackguard", 2)), 0) for i in range(1200)]
    rows += [(2000 + i, text("scum"), 1) for i in range(100)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 0), (0, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.terms == ["blackguard", "scum"]
    new = [text("blackguard"), text("blackguard,stone"), *(text(near("blackguard", 2)) for _ in range(20)), text()]
    got = toxicity.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert all(r["score"] > 0.9 for r in got[:2]) and all(r["score"] < 0.3 for r in got[2:])
    m = toxicity.Matcher(["blackguard", "scum"])
    assert [m.form(w) for w in ("scun", "a-scum/b", "x", "it's")] == [(1, 1, "scun"), (0, 1, "scum"), None, None]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_trie_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(40)})
    automaton = toxicity.TrieAutomaton(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word) + 1):rng.randrange(len(word) + 1)] = rng.choice("abcd")
        word = "".join(word)
        near = [(distance(word, t), i) for i, t in enumerate(terms)]
        assert automaton.match(word) == min(((d, i) for d, i in near if d <= toxicity.edits_for(terms[i])), default=None)


def test_context_separates_quotation():
    m = toxicity.Matcher(["scoundrel"])
    plain, quoted, twice = (float(m.evidence(pa.array([t]))[0].sum()) for t in (
        "go away scoundrel now", 'she wrote "scoundrel" in the margin', "you scoundrel you scoundrell"))
    assert quoted < plain < twice


# --------------------------------------------------------------- op6
def test_model_beats_its_base_on_held_out_text(spark):
    t = QUERIES["op6_lm_score"](spark, SF).toPandas()
    t = t[t["held_out"]]
    assert (t["score"] / t["n_tokens"]).mean() > (t["base_score"] / t["n_tokens"]).mean()


# --------------------------------------------------------------- op7
def brute_tiles(item, text, least):
    """The same greedy tiling by comparing every position with every other."""
    fi, ft, out = [True] * len(item), [True] * len(text), []
    while True:
        best = 0
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and fi[i + k] and ft[j + k] and item[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        if best < least:
            return sorted(out, reverse=True)
        for i in range(len(item) - best + 1):
            for j in range(len(text) - best + 1):
                if all(fi[i + k] and ft[j + k] and item[i + k] == text[j + k] for k in range(best)):
                    out.append(best)
                    fi[i:i + best] = ft[j:j + best] = [False] * best
                    break


@pytest.mark.parametrize("seed", range(12))
def test_tiling_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    item, text = (rng.integers(0, 4 + seed, n).astype(np.uint64) for n in (30, 60))
    text[5:20], text[30:42] = item[12:27], item[:12]
    assert sorted((t[2] for t in tiling.tile(item, text, 3)), reverse=True) == brute_tiles(item.tolist(), text.tolist(), 3)


def test_decontamination(spark, odd, odd_rows, empty, sf_rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: tokens(r["text"]) for r in bench.collect()}
    want = set()
    grams = defaultdict(set)
    for i, t in items.items():
        for k in range(len(t) - 4):
            grams[tuple(t[k:k + 5])].add(i)
    for r in sf_rows:
        t = tokens(r[1])
        for i in set().union(*(grams.get(tuple(t[k:k + 5]), set()) for k in range(len(t) - 4))):
            ids = {w: n for n, w in enumerate({*t, *items[i]})}
            a, b = (np.array([ids[w] for w in x], np.uint64) for x in (items[i], t))
            if sum(x[2] for x in tiling.tile(a, b)) >= 0.6 * len(a):
                want.add((r[0], i))
    got = QUERIES["op7_decontamination"](spark, SF)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10
    blocks = tiling.find(spark.createDataFrame(sf_rows, SCHEMA), bench, block_bytes=2000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == want
    # a reordered passage; odd items; nothing to find
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    odd_items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    one = spark.createDataFrame([(5, "before " + " ".join(words[6:]).upper() + "! between " + ", ".join(words[:6]), None, None, 0)], SCHEMA)
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.find(one, odd_items).collect()] == [(5, 1, 1.0)]
    assert tiling.find(odd, odd_items).count() == 0 and tiling.find(empty, odd_items).count() == 0
    assert tiling.find(one, odd_items.limit(0)).count() == 0
    assert tiling.clean(odd, odd_items).count() == len(odd_rows)


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]+", " ", (text or "").lower()))


# --------------------------------------------------------------- pipeline
def test_pipeline_keeps_clean_documents(spark, sf_rows, tmp_path, empty):
    docs, kept = spark.createDataFrame(sf_rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: tuple(r) for r in docs.collect()}
    text = {r[0]: r[1] for r in sf_rows}
    assert set(kept["language"]) == set(text)  # every text has letters of a learned language
    groups = brute_groups(sf_rows)
    assert set(kept["near_copies"]) == set(groups.values())
    hit = {r["doc_id"] for r in tiling.find(spark.createDataFrame(sf_rows, SCHEMA), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(kept["decontaminate"]) == set(groups.values()) - hit
    assert all(("[SECRET]" in t[1]) != (t[1] == text[i]) or "[SECRET]" in text[i] for i, t in kept["redact_secrets"].items())
    assert set(kept["token_ids"]) == set(kept["decontaminate"])
    assert {tuple(r) for r in QUERIES["pipeline"](spark, SF).collect()} == set(kept["token_ids"].values())


def test_pipeline_on_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_holds_small_batches_and_each_text_once(spark, monkeypatch):
    slices = common.slices

    def narrow(batch, text, *limits):
        assert batch.num_rows <= 1000, "a large batch"
        if "_keep" in batch.schema.names:
            assert batch["_keep"].field(1).buffers()[2].address == batch["_text"].buffers()[2].address, "a second copy of the texts"
        return slices(batch, text, *limits)

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words of document "), F.col("id").cast("string")).alias("text"),
                                             F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    monkeypatch.setattr(langid, "slices", narrow)
    monkeypatch.setattr(neardup, "slices", narrow)
    # rows from a list start a second set of workers
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("a table made from a list"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    assert corpus_pipeline.language(spark, docs, "").count() == 3000
    assert corpus_pipeline.near_copies(spark, docs, "").count() >= 1
    assert corpus_pipeline.token_ids(spark, docs, "").count() == 3000
    assert spark.conf.get(setting, None) == before  # other queries' batches stay as they are


def test_unknown_word_has_the_discounted_mass():
    a = lm.Automaton([], np.array([0]), np.empty(0, np.int64), np.empty(0, np.int64), 50, 10, 0)
    assert 10 ** a.unigram(np.array([0]))[0] == pytest.approx(lm.DISCOUNT * 10 / 50)


def test_pairs_and_triples_of_all_words(spark, odd_rows):
    """Every pair and triple counts, rare ones too: the scores are a plain interpolated model's."""
    import math
    from collections import Counter

    rng = random.Random(8)
    rows = [*odd_rows, *((100 + i, " ".join(f"w{rng.randrange(3000) if j % 3 else rng.randrange(9)}" for j in range(rng.randrange(150))), None, None, 0) for i in range(120))]
    tokens_of = {i: [*neardup_words(r[1]), ""] for i, r in enumerate(rows) if r[1] is None or r[1].isascii()}
    rows = [(i, rows[i][1], None, None, 0) for i in tokens_of]
    used = [tokens_of[i] for i in tokens_of if not crc_is(i, 7, 2)]
    grams = [Counter(tuple(t[j - k:j + 1]) for t in used for j in range(k, len(t))) for k in range(3)]
    kinds = Counter(g[:-1] for k in (1, 2) for g in grams[k])
    total, types = sum(grams[0].values()), len(grams[0])
    once, twice = (sum(n == k for n in grams[0].values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else lm.DISCOUNT

    def p(t, j):
        n = grams[0][(t[j],)]
        out = (n - discount) / total if n else discount * types / total
        for k in (1, 2):
            h = tuple(t[j - k:j]) if j >= k else None
            of = grams[k - 1][h] if h else 0
            if of:
                out = (max(grams[k][(*h, t[j])] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[h] * out) / of
        return out

    df = spark.createDataFrame(rows, SCHEMA)
    for size in (lm.BLOCK_CHARS, 4000):  # one block; many, with words spread over the buckets
        got = {r["doc_id"]: r["score"] for r in lm.score(df, ~held_out("doc_id", 7, 2), block_chars=size).collect()}
        assert len(got) == len(tokens_of)
        for i, t in tokens_of.items():
            assert got[i] == pytest.approx(sum(math.log10(p(t, j)) for j in range(len(t))), rel=1e-9)


def test_answers_for_words_are_packed_and_made_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    want, batches = {}, []
    for words in np.array_split(rng.permutation(6000), 7):  # answers for the words of four blocks, in any order
        block, place, number, c = words % 4, words // 4, rng.integers(0, 1 << 40, len(words)), rng.integers(1, 9, len(words))
        want |= {(b, p): x for b, p, *x in zip(block.tolist(), place.tolist(), number.tolist(), c.tolist(), strict=True)}
        batches.append(pa.RecordBatch.from_pydict({"block": block, "place": place, "number": number, "c": c}))
    for most, rows in ((10**6, 4), (2000, 12)):
        monkeypatch.setattr(lm, "ANSWERS", most)
        out = [r for b in lm.pack_words(iter(batches)) for r in b.to_pylist()]
        assert len(out) == rows  # one for each block of what is held
        got = {}
        for r in out:
            place, number, c = lm.unpack(r["data"])
            got |= {(r["block"], p): [n, k] for p, n, k in zip(np.cumsum(place).tolist(), number.tolist(), c.tolist(), strict=True)}
        assert got == want
    assert list(lm.pack_words(iter([batches[0].slice(0, 0)]))) == []
    made, plain = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, name: made.append(name) or plain(df, name))
    scored = lm.score(spark.read.parquet(f"{SF}/documents.parquet"), ~held_out("doc_id", 7, 2))
    assert made == ["unigrams", "words", "ngrams"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "word#" not in plan  # the scores read the words' answers, no words


def test_elements_of_one_set_are_only_counted(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [common + [f"o{i}-{k}" for k in range(i % 7)] for i in range(30)] + [[f"x{rng.randrange(10**9)}" for _ in range(40)] for _ in range(10)]
    rows = [(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = df.select(F.col("doc_id").alias("id"), "text")
    pairs = neardup.rest_pairs(df.select(F.lit(1).alias("key"), F.col("doc_id").alias("rep")), spark.createDataFrame([], "id long, root long"), texts, 0.8)
    assert pairs.filter("b >= 30").isEmpty()  # what is in no other set meets nothing
    sets = [frozenset(zip(*[r[1].split()[k:] for k in range(5)])) for r in rows]
    want = {(a, b) for a in range(40) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["b"], r["a"]) for r in neardup.similar(pairs, texts).collect()} == want


def test_documents_of_unsettled_terms_by_both_ways(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcde" for b in "klmno"]
    rows = [(i, " ".join(rng.choice(words).title() + rng.choice(["", ",", "-" + rng.choice(words)]) for _ in range(rng.randrange(12))), rng.choice(["", "de", "en", "x"]), "s", 0) for i in range(200)]
    docs = spark.createDataFrame([(t, l, s) for _, t, l, s, _ in rows], "text string, lang string, source string").repartition(3)
    unsettled = spark.createDataFrame([(l, w) for l in ("de", "en", "fr") for w in words[:9]], "lang string, term string")
    want = Counter((l, w) for _, t, l, _, _ in rows for w in set(re.findall("[a-z]+", t.lower())) if l in ("de", "en") and w in words[:9])
    for size in (1, divergence.BROADCAST_BYTES + 1):
        assert {(r["lang"], r["term"]): r["docs"] for r in divergence._document_counts(docs, unsettled, size).collect()} == dict(want)


def test_bundles_are_bounded_in_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    n, code = 1500, rng.choice(langid.SYMBOLS**3, 8000, replace=False)[rng.integers(0, 8000, 200_000)]
    owner = np.sort(rng.integers(0, n, len(code))).astype(np.int32)
    tracemalloc.start()
    got = langid.bundles(owner, code, n, langid.DIMENSION, langid.SEED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    some = [0, 7, n - 1]
    assert all((got[i] == langid.gram_vectors(code[owner == i], langid.DIMENSION, langid.SEED).sum(0)).all() for i in some)
