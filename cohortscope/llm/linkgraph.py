"""Operator 13: URL rules, and trust and distrust propagated over the host graph for urls without a rule.

Hosts are nodes. A host points to each host that its pages link to (absolute and
protocol-relative links, one vote for each page), and a host and its parent
domain (one label less, two labels at least) point to each other with one vote.
Links to the own host are left out.

Personalised PageRank starts from the trusted hosts (one unit of seed for each
page that an allow rule covers) and follows the edges; distrust starts from the
blocked hosts and follows them backwards. Both hold ``MASS`` in all at most, in
whole numbers, so results do not depend on the order of additions; mass that
reaches a host without a way on is not passed on. A host is blocked if its
distrust exceeds its trust by more than an average host's share of the mass.

A null url or one without ``://`` has an empty host and path and no rule, and
its verdict is allow. Null html holds no link. Every row of ``pages`` gives one
row, repeated ids included; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed rules: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: All seed mass; share of it that follows the edges (percent); rounds; rounds between two cuts of the lineage.
MASS, FOLLOW, ROUNDS, CUT = 10 ** 15, 85, 16, 4
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by its text), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(RULES, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of the rule (null without one)."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, votes): links between hosts, and both ways between a host and its parent domain."""
    host, _ = host_and_path(F.col("url"))
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    linked = (pages.select(host.alias("src"), F.explode(links).alias("dst")).where((F.col("src") != "") & (F.col("dst") != F.col("src")))
              .groupBy("src", "dst").agg(F.count("*").alias("votes")))
    named = linked.select(F.col("dst").alias("host")).unionByName(hosts.select("host")).distinct()
    above = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    up = named.select(F.col("host").alias("src"), above.alias("dst")).where(F.col("dst") != "")
    up = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("votes", F.lit(1).cast("long"))
    return linked.unionByName(up).groupBy("src", "dst").agg(F.sum("votes").alias("votes"))


def _part(mass: Column, part: Column, whole: Column) -> Column:
    """floor(mass * part / whole) without overflow."""
    wide = "decimal(38,0)"
    return F.call_function("div", (mass.cast("decimal(19,0)") * part.cast("decimal(19,0)")).cast(wide), whole.cast(wide))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``seeds``: (host, allowed, blocked) page counts. The two walks are one: nodes carry the
    walk's name, edges are there forwards for trust and backwards for distrust.
    """
    ways = (edges.select(F.lit("trust").alias("walk"), "src", "dst", "votes")
            .unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "votes")))
    out = ways.groupBy("walk", "src").agg(F.sum("votes").alias("out"))
    ways = stored(ways.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", "votes", "out"), "host_edges")
    start = seeds.select("host", F.inline(F.array(F.struct(F.lit("trust").alias("walk"), F.col("allowed").alias("pages")),
                                                  F.struct(F.lit("distrust").alias("walk"), F.col("blocked").alias("pages"))))).where("pages > 0")
    start = start.join(start.groupBy("walk").agg(F.sum("pages").alias("whole")), "walk")
    start = stored(start.select("walk", "host", _part(F.lit(MASS), F.col("pages"), F.col("whole")).alias("mass")), "host_seeds")
    again = start.select("walk", "host", F.expr(f"mass * {100 - FOLLOW} div 100").alias("mass"))
    mass = start
    for k in range(ROUNDS):
        moved = mass.join(ways, ["walk", "host"]).select("walk", F.col("dst").alias("host"), _part(F.expr(f"mass * {FOLLOW} div 100"), F.col("votes"), F.col("out")).alias("mass"))
        mass = again.unionByName(moved).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
        if k % CUT == CUT - 1:
            mass = stored(mass, "host_mass")
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("mass"))), F.lit(0).cast("long")).alias(walk)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    rows = parsed(pages)
    ruled = lambda says: F.count(F.when(F.col("verdict") == says, True))
    seeds = stored(rows.where(F.col("host") != "").groupBy("host").agg(ruled("allow").alias("allowed"), ruled("block").alias("blocked")), "host_pages")
    graph = edges(pages, seeds)
    scores = stored(propagate(graph, seeds), "host_scores")
    hosts = max(1, seeds.select("host").unionByName(scores.select("host")).distinct().count())
    blocked = scores.select("host", "trust", "distrust", (F.col("distrust") - F.col("trust") > MASS // hosts).alias("bad"))
    zero = F.lit(0).cast("long")
    return rows.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def _sql() -> str:
    fits = lambda at, rest: f"(host = '{at}' OR host LIKE '%.{at}') AND starts_with(path, '/{rest}')"
    whens = {k: " ".join(f"WHEN {fits(*text.split('/', 1))} THEN '{(says, text)[k]}'" for says, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))) for k in (0, 1)}
    rounds = "".join(f""", m{k + 1} AS (SELECT walk, host, sum(mass) AS mass FROM (
    SELECT walk, host, mass * {100 - FOLLOW} // 100 AS mass FROM m0
    UNION ALL SELECT m.walk, w.dst, (m.mass * {FOLLOW} // 100) * w.votes // w.out FROM m{k} m JOIN ways w ON w.walk = m.walk AND w.src = m.host) GROUP BY ALL)""" for k in range(ROUNDS))
    return rf"""
WITH cut AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
urls AS (SELECT page_id, html, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, host, path, CASE {whens[1]} END AS rule, CASE {whens[0]} END AS says FROM urls),
own AS (SELECT host, count(*) FILTER (says = 'allow') AS allowed, count(*) FILTER (says = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT src, dst, count(*) AS votes FROM (SELECT DISTINCT page_row, src, dst FROM (
    SELECT row_number() OVER () AS page_row, host AS src, unnest(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}'))) AS dst FROM urls))
    WHERE src <> '' AND src <> dst GROUP BY ALL),
ups AS (SELECT host AS src, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) AS dst FROM (SELECT host FROM own UNION SELECT dst FROM links) WHERE regexp_matches(host, '^[^.]+\.([^.]+\..+)$')),
edges AS (SELECT src, dst, sum(votes) AS votes FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM ups UNION ALL SELECT dst, src, 1 FROM ups) GROUP BY ALL),
ways AS (SELECT walk, src, dst, votes, sum(votes) OVER (PARTITION BY walk, src) AS out FROM (
    SELECT 'trust' AS walk, src, dst, votes FROM edges UNION ALL SELECT 'distrust', dst, src, votes FROM edges)),
m0 AS (SELECT walk, host, {MASS}::HUGEINT * pages // sum(pages) OVER (PARTITION BY walk) AS mass FROM (
    SELECT 'trust' AS walk, host, allowed AS pages FROM own UNION ALL SELECT 'distrust', host, blocked FROM own) WHERE pages > 0){rounds},
scores AS (SELECT host, coalesce(sum(mass) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (walk = 'distrust'), 0) AS distrust FROM m{ROUNDS} GROUP BY host),
size AS (SELECT greatest(count(*), 1) AS hosts FROM (SELECT host FROM own UNION SELECT host FROM scores))
SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN distrust - trust > {MASS} // hosts THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM ruled r CROSS JOIN size LEFT JOIN scores s ON s.host = r.host
"""


SQL = _sql()
