"""Operators 11 to 13: odd rows against their SQL, planted cases, and the parts that small tables do not reach."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortscope.llm import convtrie, divergence, linkgraph
from cohortscope.testkit import compare

DOCS = "doc_id long, text string, lang string, source string"
TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"
CLASH = ("term", "n", "docs", "most", "depth", "f1", "host", "verdict", "rank", "value", "pos", "trust")


def frames(spark, rows, schema, table):
    """The rows as a Spark table with clashing columns, and a DuckDB connection that has them as ``table``."""
    df = spark.createDataFrame(rows, schema)
    con = duckdb.connect()
    con.register("given", df.toArrow())
    con.execute(f"CREATE TABLE {table} AS SELECT * FROM given")
    return df.withColumns({c: F.lit("clash") for c in CLASH}), con


def check(df, con, sql):
    ok, why = compare(df, con, sql)
    assert ok, why


# --------------------------------------------------------------- op11
def odd_documents():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("the", "Éa", "zu", "x1y", "don't", "ÉCOLE", "A") for b in ("", ",", ".", "?!", "s")]
    rows = [(None, None, None, None), (1, "", "en", None), (2, " \t\n", None, "s"), (3, "1234 !!", "xx", "only"), (4, "word " * 30000, "en", "s1"),
            (5, "Ab" * 20000, "en", "s1"), (6, "a\x7fb\x00c\u0085d\u00a0e", "en", "s2")]
    for i in range(400):
        lang = rng.choice(["en", "en", "fr", None, ""])
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        rows += [(i % 350, text, lang, rng.choice(["s1", "s2", "s1", "", None, "Ünï"]))] * (1 + (i % 90 == 0))
    return rows


def test_divergence_odd_rows(spark):
    df, con = frames(spark, odd_documents(), DOCS, "documents")
    got = divergence.audit(df)
    check(got, con, divergence.SQL)
    assert {r["part"] for r in got.select("part").distinct().collect()} == {"pair", "term"}


def test_divergence_settles_terms_near_the_limit(spark, monkeypatch):
    """A term in 29 documents as one chunk and in others as a second one: kept, dropped, and with one document holding both."""
    rows = []
    for i in range(29):
        rows.append((len(rows), "kept both, dropped", "en", f"s{i % 3}"))
    rows += [(100, "kept,", "en", "s0"), (101, "both both,", "en", "s0"), (102, "dropped dropped, dropped;", "fr", "s0")]
    rows.append((103, "Dropped.", "de", "s1"))
    rows[0] = (0, "kept both, both dropped dropped,", "en", "s0")
    df, con = frames(spark, rows, DOCS, "documents")
    check(divergence.audit(df), con, divergence.SQL)
    counts = divergence.term_counts(df.select("text", "lang", "source"))
    kept = {tuple(r) for r in divergence._kept(df.select("text", "lang", "source"), counts).collect()}
    assert kept == {("en", "kept"), ("en", "both")}
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", -1)  # nothing is small: joins by shuffle
    assert kept == {tuple(r) for r in divergence._kept(df.select("text", "lang", "source"), counts).collect()}
    check(divergence.audit(df), con, divergence.SQL)


def test_divergence_in_small_pieces(spark, monkeypatch):
    """Cut inside batches, and pairs summed in strips of one source."""
    monkeypatch.setattr(divergence, "COUNT_BYTES", 50)
    rows = odd_documents()
    batch = pa.RecordBatch.from_pydict({"text": [r[1] or "" for r in rows], "lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows]})
    assert sum(b.num_rows for b in divergence._gathered(iter([batch.slice(0, 100), batch.slice(100, 0), batch.slice(100)]))) == len(rows)
    cut = sum(pa.compute.sum(b.column("n")).as_py() for b in divergence._count(iter([batch])))
    assert cut == sum(len([w for w in r[1].replace("\x0b", " ").split(" ") if w.strip(" \t\n")]) for r in rows if r[1])


def test_divergence_shares_are_exact():
    count, total = np.array([0, 3, 10 ** 14, 4 * 10 ** 15], np.int64), np.array([0, 7, 10 ** 15, 4 * 10 ** 15], np.int64)
    want = [1 + 10 ** 9 * (c + 5) // (t + 5 * 9) for c, t in zip(count.tolist(), total.tolist())]
    assert divergence._shares(count, total, 9).tolist() == want


def test_divergence_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_of_chunks_over_batches():
    """A chunk whose rows go over several batches is cut into terms once, with its documents summed."""
    b = lambda rows: pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("chunk", "lang", "source", "n", "docs"))})
    batches = [b([("a-B", "en", "s", 2, 1)]), b([("a-B", "en", "t", 1, 1)]), b([("a-B", "fr", "s", 1, 1), ("x", "en", "s", 5, 4)])]
    rows = [tuple(r.values()) for x in divergence._terms(iter(batches)) for r in x.to_pylist()]
    assert ("en", None, "b", 0, 2, 2) in rows and ("fr", None, "a", 0, 1, 1) in rows and ("en", "t", "a", 1, 0, 0) in rows and ("en", None, "x", 0, 4, 4) in rows
    assert len(rows) == 3 * 2 + 2 * 2 + 2


# --------------------------------------------------------------- op12
def odd_turns():
    rng = random.Random(4)
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, "user", None), (7, 1, None, "x"), (7, 1, "user", "é𝄞"), (7, 1, "user", "é𝄞"),
            (-3, 0, "user", "minus"), (-5, 0, "user", "base"), (-5, 1, "user", ""), (12, 5, "user", "a" * 50000)]
    for c in range(20, 80):
        same = c % 3
        for t in range(rng.randint(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same else f"turn {t} {rng.randint(0, 2)}"))
    rows += [(33, t, "user", "hot") for t in range(3000)] + [(31, 9, "user", "tie")] * 2000
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cut", [False, True])
def test_trie_odd_rows(spark, cut):
    """With ``cut`` every range stays its own, so that conversations go over several of them."""
    rows = odd_turns() if cut else [r for r in odd_turns() if r[3] not in ("hot", "tie")]
    df, con = frames(spark, [r for r in rows], TURNS, "conversations")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not cut).lower())
    try:
        if cut:
            states = convtrie.turn_states(df, 0)
            got = {}
            for r in states.collect():
                got.setdefault(r["conv_id"], []).append((r["pos"], r["upto"], r["a1"]))
            for conv, seen in got.items():
                assert sorted(p for p, _, _ in seen) == list(range(1, len(seen) + 1)), conv
            sums = dict(con.execute("SELECT conv_id, sum(strlen(coalesce(text, ''))) FROM conversations GROUP BY 1").fetchall())
            assert all(max(u for _, u, _ in seen) == sums[conv] for conv, seen in got.items())
            # identical turns: the state after n of them does not depend on where ranges end
            t = convtrie._turn_values(pa.array([hashlib.sha256("4:userhot".encode()).digest()]), 0)[0]
            with np.errstate(over="ignore"):
                by_pos = {p: a for p, _, a in got[33]}
                own = [r for r in rows if r[0] == 33 and r[3] != "hot"]
                assert len(by_pos) == 3000 + len(own)
                hot = [p for p in by_pos if p > 1 and (by_pos[p] - by_pos[p - 1]) % (1 << 64) == int(t[0]) * pow(int(convtrie.RADIX[0]), p - 1, 1 << 64) % (1 << 64)]
            assert len(hot) >= 2999
        else:
            check(convtrie.trie(df), con, convtrie.SQL)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_against_a_plain_one_with_split_conversations(spark):
    rows = odd_turns()
    df, _ = frames(spark, rows, TURNS, "conversations")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in convtrie.trie(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    root = {"m": [], "e": [], "kids": {}, "size": 0}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c > 0 else -(abs(c) % 5))
        seq = own.get(base, [])[:h] + own[c][h:]
        node = root
        node["m"].append(c)
        for t in seq:
            node = node["kids"].setdefault(t, {"m": [], "e": [], "kids": {}, "size": len(t[1].encode())})
            node["m"].append(c)
        node["e"].append(c)
    want, order, stack = {}, [], [(root, 0, None)]
    while stack:
        node, d, up = stack.pop()
        order.append((node, d, up))
        stack += [(k, d + 1, node) for k in node["kids"].values()]
    for node, d, up in reversed(order):
        node["leaves"] = sum(k["leaves"] for k in node["kids"].values()) or 1
        node["saved"] = (len(node["m"]) - 1) * node["size"] + sum(k["saved"] for k in node["kids"].values())
        want[node["m"][0], d] = (up and up["m"][0], len(node["m"]), len(node["kids"]), node["leaves"], node["saved"], hashlib.sha256(",".join(map(str, node["e"])).encode()).hexdigest())
    assert got == want


def test_trie_digests_over_pieces(monkeypatch):
    monkeypatch.setattr(convtrie, "PIECE", 30)
    ids = list(range(5, 70))
    batch = pa.RecordBatch.from_pydict({"depth": [1] * 65, "f1": [2] * 65, "f2": [3] * 65, "conv_id": ids})
    pieces = list(convtrie._pieces(iter([batch.slice(0, 20), batch.slice(20)])))
    assert sum(b.num_rows for b in pieces) > 5
    got = [r for b in convtrie._digests(iter(pieces)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


def test_trie_empty(spark):
    assert convtrie.trie(spark.createDataFrame([], TURNS)).count() == 0


# --------------------------------------------------------------- op13
def odd_pages():
    link = lambda *urls: "".join(f"<a HREF = '{u}'>x</a>" for u in urls)
    rows = [(0, None, None), (1, "no scheme", "x"), (2, "", ""), (3, "http://", None), (4, "HTTPS://A.NET", None), (5, "https://a.net/", ""), (6, "https://B.Example.NET/en/1?x=/y#z", link("//Other.IO/q")),
            (7, "x://net/a://b", None), (8, "ftp://foo.org/fr/1", link("https://good.io/", "http://also.good.io?x", "https://good.io/2")), (9, "http://notnet/", None), (10, "http://xorg/fr/", None),
            (11, "http://org/fr/é", None), (12, "http://example.com/de/", None), (13, "http://a.b.example.com/de", None), (14, "http://éÀ.example.com/de/\n?\n", None), (15, "http://q.net?x", None),
            (16, "http://example.net/en/", None), (17, "http://example.net/EN/", None)]
    rows += [(20, "http://spam.com/1", link("http://a.net/x", "http://q.net/")), (21, "http://spam.com/2", link("http://a.net/")), (22, "http://farm.com/", link("http://spam.com/")), (22, "http://farm.com/", link("http://spam.com/"))]
    rows += [(40 + i, f"http://a.net/{i}", None) for i in range(8)]
    rows += [(30, "http://good.io/a", link("http://fine.io/", "/local", "#x")), (31, "http://also.good.io/", None), (32, "http://fine.io/", "a" * 100000)]
    return rows + [(100 + i, f"http://h{i % 7}.big.example.com/{'de' if i % 9 == 0 else 'en'}/", link(f"http://h{i % 5}.other.com/")) for i in range(60)]


def test_link_graph_odd_rows(spark):
    df, con = frames(spark, odd_pages(), PAGES, "pages")
    got = linkgraph.judge(df)
    check(got, con, linkgraph.SQL)
    by = {r["page_id"]: r for r in got.collect()}
    assert len(got.collect()) == len(odd_pages())
    assert (by[6]["host"], by[6]["path"], by[6]["rule"], by[6]["verdict"]) == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert by[4]["rule"] is None and by[5]["rule"] == "net/" and by[9]["rule"] is None and by[10]["rule"] is None and by[11]["rule"] == "org/fr/"
    assert (by[7]["host"], by[7]["path"], by[7]["rule"]) == ("net", "/a://b", "net/")
    assert (by[0]["host"], by[0]["path"], by[0]["verdict"]) == ("", "", "allow") and by[17]["rule"] == "net/"
    assert by[20]["verdict"] == "block"  # links to blocked hosts only
    assert by[30]["verdict"] == by[31]["verdict"] == by[32]["verdict"] == "allow" and by[30]["trust"] > 0


def test_link_graph_mass_is_kept(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES)
    seeds = linkgraph.parsed(pages).where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    sums = linkgraph.propagate(linkgraph.edges(pages, seeds), seeds).agg(F.sum("trust"), F.sum("distrust")).first()
    assert 0 < sums[0] <= linkgraph.MASS and 0 < sums[1] <= linkgraph.MASS


def test_link_graph_without_seeds_or_rows(spark):
    assert linkgraph.judge(spark.createDataFrame([], PAGES)).count() == 0
    got = linkgraph.judge(spark.createDataFrame([(1, "http://a.com/", None), (1, "http://a.com/", None)], PAGES)).collect()
    assert [(r["verdict"], r["rule"], r["trust"], r["distrust"]) for r in got] == [("allow", None, 0, 0)] * 2
