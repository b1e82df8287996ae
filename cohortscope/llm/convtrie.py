"""Operator 12: the trie of conversation prefixes, by composable fingerprints.

Conversation c is rebuilt: the first h turns of conversation c - c % 5, then its
own turns after its first h (h = crc32 of the decimal id, modulo 9). A sequence
of turns t has the fingerprint (n, sum of t_i r^i) in two rings of integers
modulo 2^64. Fingerprints compose, (n, A) (m, B) = (n + m, A + r^n B), and a
prefix can be taken off again because r is odd, so each prefix of a rebuilt
conversation follows from two prefixes of stored ones: no text and no turn list
is put together. A turn is referred to by the SHA-256 of its role and text;
the members of a node must agree in their last turn's reference and in their
parent's fingerprint, else all is done again with another seed, so equal
fingerprints stand for equal turns.

Turns are ordered by turn (null first), ties by their reference. Null role and
text are empty. Rows without a conv_id belong to no conversation and are left
out; an empty table has no nodes; other columns are not read. The turns of one
conversation are numbered by a scan over ranges, whose carried states (one for a
range) are the only thing that passes the driver, so a conversation may hold any
share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, stored

HEADS, FAMILY = 9, 5
#: Bases of the two rings: odd, so that a power can be undone.
RADIX = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
_UNDO = np.array([pow(int(r), -1, 1 << 64) for r in RADIX], np.uint64)
#: Characters of joined ids in one piece.
PIECE = 1_000_000
NODE = ["depth", "f1", "f2"]


def _powers(radix: np.uint64, n: np.ndarray) -> np.ndarray:
    out, base, n = np.ones(len(n), np.uint64), np.array([radix], np.uint64), n.astype(np.uint64)
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        out[odd] *= base[0]
        base = base * base
        n = n >> np.uint64(1)
    return out


def _turn_values(refs: pa.Array, seed: int) -> list[np.ndarray]:
    """Two numbers for each turn, from its reference."""
    data = np.frombuffer(b"".join(refs.to_pylist()), "<u8").reshape(-1, 4)
    with np.errstate(over="ignore"):
        return [mix(data[:, k] ^ mix(np.full(1, 2 * seed + k + 1, np.uint64))[0]) for k in (0, 1)]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _scan(seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place and prefix state of each turn among those of its conversation in this range."""
        part = TaskContext.get().partitionId()
        last, state = None, (0, np.zeros(2, np.uint64), 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv, size = _numbers(b, "conv_id"), _numbers(b, "bytes")
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            goes_on = last is not None and conv[0] == last
            count, sums, before = state if goes_on else (0, np.zeros(2, np.uint64), 0)
            first = run == 0
            pos = np.arange(n) - starts[run] + np.where(first, count, 0)
            lanes = []
            for k, t in enumerate(_turn_values(b.column("ref"), seed)):
                total = np.cumsum(t * _powers(RADIX[k], pos), dtype=np.uint64)
                base = np.concatenate((np.zeros(1, np.uint64), total))[starts]
                lanes.append(total - base[run] + np.where(first, sums[k], np.uint64(0)))
            total = np.cumsum(size)
            upto = total - np.concatenate(([0], total))[starts][run] + np.where(first, before, 0)
            last, state = conv[-1], (int(pos[-1]) + 1, np.array([x[-1] for x in lanes]), int(upto[-1]))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([part] * n, pa.int64()), _long(pos + 1), *map(_long, lanes), _long(upto), b.column("bytes"), b.column("ref")],
                                             ["conv_id", "part", "pos", "a1", "a2", "upto", "bytes", "ref"])
    return scan


def _carries(ranges: DataFrame) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """The state before each range of the conversation that goes on in it: at most one for each range."""
    bounds = sorted(tuple(r) for r in ranges.groupBy("part").agg(F.min("conv_id"), F.max("conv_id")).collect())  # one row for each range
    across = sorted({b[2] for b, c in zip(bounds, bounds[1:]) if b[2] == c[1]})
    if not across:
        return {}
    named = ranges.sparkSession.createDataFrame([(c,) for c in across], "conv_id long")
    ends = (ranges.join(F.broadcast(named), "conv_id").groupBy("conv_id", "part").agg(F.max(F.struct("pos", "a1", "a2", "upto")).alias("s"))
            .select("conv_id", "part", "s.*").collect())  # at most two for each range
    out, held = {}, {}
    for conv, part, n, a1, a2, upto in sorted(tuple(r) for r in ends):
        before = held.get(conv, (0, 0, 0, 0))
        if before[0]:
            out[part, conv] = before
        lanes = [(before[1 + k] + pow(int(RADIX[k]), before[0], 1 << 64) * a) % (1 << 64) for k, a in enumerate((a1, a2))]
        held[conv] = (before[0] + n, *lanes, before[3] + upto)
    return out


def _whole(carries: dict[tuple[int, int], tuple[int, int, int, int]]):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and states within the whole conversation: the carried state comes before those of the range."""
        for b in batches:
            if b.num_rows and carries:
                conv, part, pos = (_numbers(b, c) for c in ("conv_id", "part", "pos"))
                lanes, upto = [_numbers(b, c).view(np.uint64).copy() for c in ("a1", "a2")], _numbers(b, "upto").copy()
                pos = pos.copy()
                keys, at = np.unique(np.stack((part, conv)), axis=1, return_inverse=True)
                at = at.reshape(-1)
                for k, (p, c) in enumerate(keys.T.tolist()):
                    if (p, c) in carries:
                        n, *sums, before = carries[p, c]
                        rows = at == k
                        for j in (0, 1):
                            lanes[j][rows] = np.uint64(sums[j]) + _powers(RADIX[j], np.full(1, n))[0] * lanes[j][rows]
                        pos[rows] += n
                        upto[rows] += before
                b = pa.RecordBatch.from_arrays([b.column("conv_id"), _long(pos), *map(_long, lanes), _long(upto), b.column("bytes"), b.column("ref")], STATES)
            else:
                b = b.select(STATES)
            yield b
    return whole


STATES = ["conv_id", "pos", "a1", "a2", "upto", "bytes", "ref"]
_STATES = "conv_id long, pos long, a1 long, a2 long, upto long, bytes long, ref binary"


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turn_states(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place in its conversation, the fingerprint up to it, the bytes up to it and its reference."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    ref = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), ref.alias("ref"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "ref", "row"]  # equal turns of one conversation can still be dealt to several ranges
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(seed), "conv_id long, part long, pos long, a1 long, a2 long, upto long, bytes long, ref binary")
    ranges = stored(ranges, "turn_ranges")
    return ranges.mapInArrow(_whole(_carries(ranges)), _STATES)


def _rebuilt(states: DataFrame) -> DataFrame:
    """One row for each conversation: what it takes from its family's first, and the state that it leaves out of its own."""
    h = heads_of(F.col("conv_id"))
    state = F.struct("a1", "a2", "upto")
    own = states.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("upto").alias("total"), F.max(F.when(F.col("pos") == h, state)).alias("cut"),
        F.collect_list(F.when((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0), F.struct("pos", "a1", "a2", "upto", "bytes", "ref"))).alias("head"))
    own = stored(own.withColumn("h", h), "conversations")
    first = own.where(F.size("head") > 0).select(F.col("conv_id").alias("base"), F.sort_array("head").alias("head"))
    both = own.drop("head").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base", "left")
    both = both.withColumn("head", F.slice(F.coalesce("head", F.expr("array()").cast(first.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    zero = F.lit(0).cast("long")
    tail = F.col("n") > F.col("h")
    at = lambda s, k: F.coalesce(s[k], zero)
    taken = F.when(F.size("head") > 0, F.get("head", F.size("head") - 1))
    return both.select(
        "conv_id", "h", "head", (F.col("h") - F.size("head")).alias("shift"),
        *(at(taken, k).alias(f"base_{k}") for k in ("a1", "a2", "upto")), *(at(F.col("cut"), k).alias(f"cut_{k}") for k in ("a1", "a2", "upto")),
        (F.size("head") + F.greatest(F.col("n") - F.col("h"), zero)).cast("long").alias("turns"),
        (at(taken, "upto") + F.when(tail, F.col("total") - at(F.col("cut"), "upto")).otherwise(zero)).alias("total"))


_PLACED = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, ref binary, bytes long, before long, ends boolean"


def _place(seed: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of the prefixes of rebuilt conversations: base state, then own state without its first turns."""
        for b in batches:
            depth = _numbers(b, "pos") - _numbers(b, "shift")
            lanes, parents = [], []
            for k, t in enumerate(_turn_values(b.column("ref"), seed)):
                a, cut, base = (_numbers(b, f"{c}a{k + 1}").view(np.uint64) for c in ("", "cut_", "base_"))
                f = base + (a - cut) * _powers(_UNDO[k], _numbers(b, "shift"))
                lanes.append(f)
                parents.append(f - t * _powers(RADIX[k], np.maximum(depth - 1, 0)))
            before = _numbers(b, "base_upto") + _numbers(b, "upto") - _numbers(b, "cut_upto") - _numbers(b, "bytes")
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), _long(depth), *map(_long, lanes), *map(_long, parents), b.column("ref"), b.column("bytes"), _long(before), pa.array(depth == _numbers(b, "turns"))],
                ["conv_id", *NODE, "p1", "p2", "ref", "bytes", "before", "ends"])
    return place


def _prefixes(states: DataFrame, rebuilt: DataFrame, seed: int) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one included."""
    moves = ["shift", "turns", *(f"{c}_{k}" for c in ("base", "cut") for k in ("a1", "a2", "upto"))]
    zero = F.lit(0).cast("long")
    none = {c: zero for c in moves if c != "turns"}
    heads = rebuilt.select("conv_id", "turns", F.inline("head")).withColumns(none)
    tails = states.join(rebuilt.select("conv_id", "h", *moves), "conv_id").where(F.col("pos") > F.col("h"))
    columns = [*STATES, *moves]
    placed = heads.select(columns).unionByName(tails.select(columns)).mapInArrow(_place(seed), _PLACED)
    root = rebuilt.select("conv_id", *(zero.alias(c) for c in (*NODE, "p1", "p2")), F.lit(b"").alias("ref"), zero.alias("bytes"), zero.alias("before"), (F.col("turns") == 0).alias("ends"))
    return root.unionByName(placed)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node's ends, in order, joined into pieces."""
    node, ids, size = None, [], 0
    out: list[tuple] = []
    for b in batches:
        for key, c in zip(zip(*(b.column(k).to_pylist() for k in NODE)), b.column("conv_id").to_pylist()):
            if ids and (key != node or size >= PIECE):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            node = key
            ids.append(c)
            size += 12
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*NODE, "first", "ids"])
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's pieces, one after another."""
    node, sha = None, None
    out: list[tuple] = []
    for b in batches:
        for *key, ids in zip(*(b.column(k).to_pylist() for k in (*NODE, "ids"))):
            if key != node:
                if sha:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*NODE, "ends_sha256"])
            out = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], [*NODE, "ends_sha256"])


def _ends(prefixes: DataFrame) -> DataFrame:
    node = "depth long, f1 long, f2 long"
    ends = prefixes.where("ends").select(*NODE, "conv_id")
    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces, f"{node}, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")


def trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each node; the columns are those of the contract."""
    states = turn_states(conversations, seed)
    rebuilt = stored(_rebuilt(states), "rebuilt")
    prefixes = stored(_prefixes(states, rebuilt, seed), "prefixes")
    same = lambda c: F.min(c) == F.max(c)
    nodes = stored(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("before").alias("before"),
        (same("ref") & same("p1") & same("p2")).alias("equal")), "nodes")
    if nodes.where(~F.col("equal")).limit(1).count():
        return trie(conversations, seed + 1)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes_children")
    # a conversation is the least of its nodes from one depth on: up to there it shares every turn with a lesser one
    alone = nodes.groupBy("conv_id").agg(F.min("before").alias("alone"), F.max(F.when(F.col("n_children") == 0, 1)).alias("leaf"))
    shared = rebuilt.select("conv_id", "total").join(alone, "conv_id", "left").select("conv_id", F.coalesce("alone", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = (prefixes.join(shared, "conv_id").where((F.col("shared") > F.col("before")) | (F.col("leaf") == 1)).groupBy(*NODE)
            .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    zero, empty = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    full = nodes.join(sums, NODE, "left").join(_ends(prefixes), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return full.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
                       F.coalesce(F.col("n_leaves").cast("long"), zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


SQL = f"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS tab),
ids AS (SELECT conv_id, (conv_id - conv_id % {FAMILY}) AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda acc, b: xor(acc // 256, tab[(xor(acc, b) % 256) + 1])), 4294967295) % {HEADS} AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bits),
turns AS (SELECT conv_id, strlen(text) AS bytes, ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, ref) AS pos FROM (
    SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS ref FROM conversations WHERE conv_id IS NOT NULL)),
parts AS (SELECT i.conv_id, 0 AS own, t.pos, t.bytes, t.ref FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
    UNION ALL SELECT i.conv_id, 1, t.pos, t.bytes, t.ref FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
lists AS (SELECT i.conv_id, coalesce(list(ref ORDER BY own, pos) FILTER (ref IS NOT NULL), []) AS refs, coalesce(list(bytes ORDER BY own, pos) FILTER (ref IS NOT NULL), []) AS sizes
    FROM ids i LEFT JOIN parts p ON p.conv_id = i.conv_id GROUP BY i.conv_id),
steps AS (SELECT conv_id, refs, sizes, len(refs) AS turns, unnest(range(len(refs) + 1)) AS depth FROM lists),
paths AS (SELECT conv_id, turns, depth, sha256(array_to_string(refs[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(refs[1:depth - 1], ',')) END AS parent,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes FROM steps),
nodes AS (SELECT node, depth, parent, bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM paths GROUP BY node, depth, parent, bytes),
kids AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.node AND c.depth = n.depth + 1) AS n_children FROM nodes n),
below AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT top, top_depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM below JOIN kids USING (node, depth) GROUP BY ALL)
SELECT k.conv_id::BIGINT AS conv_id, k.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, k.ends_sha256
FROM kids k JOIN sums ON top = k.node AND top_depth = k.depth LEFT JOIN nodes p ON p.node = k.parent AND p.depth = k.depth - 1
"""
