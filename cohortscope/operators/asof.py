"""As-of lookup: for each probe, the nearest event at/after (or at/before) it.

Spark has no as-of join, and the two obvious DataFrame forms do not scale:
an equi-join plus a range filter emits every (probe, event) pair of a key,
and a window partitioned by the key alone puts a hot key's whole history in
one task. This operator keys everything by ``(key, time block)``:

1. In a sub-block (``sub_seconds`` of a key's ``block_seconds``), probes and
   events are scanned once in time order with a running ``last(..., ignorenulls)``
   (an O(n) running frame). A key with most of an hour's rows is spread over
   that hour's sub-blocks.
2. Each sub-block passes on its first (or last) event. A running window over
   the sub-blocks of one block, and another over the blocks of one key (a few
   thousand rows at most: time span / block width), carry the nearest event
   to each sub-block: a prefix scan in three levels, each of bounded width.
3. Probes without a match in their sub-block take the carried value through an
   equi-join whose right side has one row per sub-block, so nothing fans out.

The tables of sub-blocks and blocks grow with the probes, so their joins merge
sorted rows: a size estimated from compressed files, before probes are
multiplied, must not send them whole through the driver.

No pair of rows is ever materialised. Probe and event rows are read and
shuffled once: the scan and the table of sub-blocks read the same exchange, as
both need all of its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.functions.windows import ts_lit

_EPOCH = "1970-01-01 00:00:00"


def time_block(ts: Column, block_seconds: int) -> Column:
    secs = F.timestamp_diff("SECOND", ts_lit(_EPOCH), ts)
    return F.floor(secs / F.lit(block_seconds)).cast("long")


def asof(probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_ts: str,
         event_ts: str, out: str, direction: str = "forward",
         block_seconds: int = 3600, sub_seconds: int = 15) -> DataFrame:
    """Add column ``out``: the event time nearest to ``probe_ts`` on ``keys``.

    ``forward``: smallest ``event_ts >= probe_ts``; ``backward``: largest
    ``event_ts <= probe_ts``; NULL when there is none. Probe rows keep all
    their columns. ``events`` must hold ``keys`` and ``event_ts``.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    fwd = direction == "forward"
    keys = list(keys)
    pcols = probes.columns
    pid = "__asof_probe"
    known = F.lit(True)
    for k in keys:  # NULL keys never match, as in an equi-join: such probes go round the search
        known = known & F.col(k).isNotNull()
    p = (probes.where(known).withColumn(pid, F.struct(*[F.col(c) for c in pcols]))
         .select(*keys, F.col(probe_ts).alias("__t"), pid))
    e = (events.select(*keys, F.col(event_ts).alias("__t")).where(known & F.col("__t").isNotNull())
         .distinct()
         .select(*keys, "__t", F.lit(None).cast(p.schema[pid].dataType).alias(pid)))
    # block numbers without NULL, as the keys are: the joins below then add no filter of their own to one
    # side, which would cost it its own exchange. A probe without a time lies beyond all events
    nowhere = F.lit((1 << 62) if fwd else -(1 << 62))
    block = lambda seconds: F.coalesce(time_block(F.col("__t"), seconds), nowhere)
    both = (p.unionByName(e).select(*keys, "__t", pid, block(block_seconds).alias("__b"), block(min(sub_seconds, block_seconds)).alias("__s"))
            .repartition(*keys, "__b", "__s"))
    event = F.when(F.col(pid).isNull(), F.col("__t"))
    nearer, after = (F.min, lambda c: F.col(c).desc()) if fwd else (F.max, lambda c: F.col(c).asc())

    # 1. running scan; events sort before probes at equal times
    w = (Window.partitionBy(*keys, "__b", "__s").orderBy(after("__t"), F.col(pid).isNotNull().asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = both.withColumn("__in", F.last(event, ignorenulls=True).over(w)).where(F.col(pid).isNotNull()).select(*keys, "__b", "__s", pid, "__in")

    # 2. nearest event after/before each sub-block: within its block, or else of the nearest block with one
    def carried(rows, by, at, value, name):
        before = Window.partitionBy(*by).orderBy(after(at)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))
    subs = both.groupBy(*keys, "__b", "__s").agg(nearer(event).alias("__e"), F.count(pid).alias("__probes"))
    subs = carried(subs, [*keys, "__b"], "__s", "__e", "__near")
    blocks = carried(subs.groupBy(*keys, "__b").agg(nearer("__e").alias("__e")), keys, "__b", "__e", "__far").drop("__e")
    subs = (subs.where(F.col("__probes") > 0).join(blocks.hint("merge"), [*keys, "__b"], "left")
            .select(*keys, "__b", "__s", F.coalesce("__near", "__far").alias("__next")))

    # 3. probes without an event in their sub-block
    joined = hits.join(subs.hint("merge"), [*keys, "__b", "__s"], "left")
    found = joined.select(f"{pid}.*", F.coalesce("__in", "__next").alias(out))
    return found.unionByName(probes.where(~known).withColumn(out, F.lit(None).cast(found.schema[out].dataType)))
