"""Bootstrap of the difference of a statistic between two arms, per segment/metric.

Resampling n values with replacement is a multinomial draw of n over the
distinct values weighted by their counts, so each ``(segment, metric, arm)``
sample is first reduced to its value histogram (one map-side combined
aggregation); a 0/1 metric is two rows per arm at any n.

The multinomial is drawn down a binary tree over the values' order-preserving
64-bit keys: a node's draws go to its left branch by a binomial with the left
branch's share, a block of replicates at once. That is the same distribution,
and the tree can be cut at any node: a range of values below a cut is drawn in
a task of its own. Ranges start as sixteen per octave and are cut deeper until
each holds at most ``max_task_values`` distinct values, so a narrow metric with
many values is split too. A node's generator is seeded by ``(seed, group, arm,
block, node)``, so a range needs no draws from elsewhere: it gets the counts on
its path from the root (some 60 numbers) by a cogroup and draws them again.
Sums are added along the tree, so the replicates depend neither on where it is
cut nor on partitioning or task order; there is one method at every size. A
median is read off the same draws: the draws that fall below a range tell in
which range the middle ranks of a replicate lie.

The summary per group is native: ``percentile`` (linear interpolation, as
numpy) for the two one-sided bounds, ``p = min(P(d <= 0), P(d >= 0))``,
``significant = lower > 0 or upper < 0``, ``direction`` from the observed
difference.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import config

# The pandas functions below run on executors. Pickle this module's functions
# by value so workers need numpy/pandas only, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ["axis", "segment", "metric_id"]


def group_hash(*key) -> int:
    return zlib.crc32("\x1f".join(str(k) for k in key).encode())


def _schema(df: DataFrame, keys, extra: str) -> str:
    cols = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return f"{cols}, {extra}"


#: Bits of a key that name its range: sixteen ranges per octave (sign, exponent, four bits of the fraction), then deeper.
LEVELS = (16, 32, 48, 64)
MAX_TASK_VALUES = 20_000
#: Replicates drawn at once; what a task holds of them, and what ranges pass on together.
BLOCK = 2_500


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the values."""
    bits = (np.asarray(values, dtype=float) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _branches(keys, lo, hi):
    """The bit at which the sorted list ``keys[lo:hi]`` parts, the bits from it upwards, and the first key of the right branch."""
    bit = (keys[lo] ^ keys[hi - 1]).bit_length() - 1
    prefix = keys[lo] >> bit
    return bit, prefix, bisect_left(keys, prefix << bit | 1 << bit, lo, hi)


def _lefts(draws, left, total, seeds, bit, prefix):
    return np.random.default_rng([*seeds, bit, prefix >> 32, prefix & 0xFFFFFFFF]).binomial(draws, float(left) / float(total))


def _total(values, keys, counts, draws, before, n, seeds, statistic):
    """The replicates' share of the statistic from sorted values that get ``draws``: their sum, or half the sum of
    those that are middle values. ``before``: draws of lower values."""
    keys, values, upto = keys.tolist(), values.tolist(), [0, *np.cumsum(counts).tolist()]

    def node(lo, hi, mine, below):
        if not mine.any():
            return np.zeros(len(mine))
        if hi - lo == 1:
            if statistic == "median":
                return sum(np.where((below <= rank) & (rank < below + mine), values[lo] / 2, 0.0) for rank in ((n - 1) // 2, n // 2))
            return mine * values[lo]
        bit, prefix, middle = _branches(keys, lo, hi)
        lefts = _lefts(mine, upto[middle] - upto[lo], upto[hi] - upto[lo], seeds, bit, prefix)
        return node(lo, middle, lefts, below) + node(middle, hi, mine - lefts, below + lefts)
    return node(0, len(keys), draws, before)


def _paths(keys, counts):
    """For each range (by one of its keys, sorted): the branchings from the root to it, as rows of
    (bit, prefix, count on the left, count, 1 if it lies on the right)."""
    keys, upto = keys.tolist(), [0, *np.cumsum(counts).tolist()]
    out, todo = [None] * len(keys), [(0, len(keys), ())]
    while todo:
        lo, hi, path = todo.pop()
        if hi - lo == 1:
            out[lo] = np.array(path, np.int64).reshape(-1, 5)
            continue
        bit, prefix, middle = _branches(keys, lo, hi)
        step = (bit, prefix - (prefix >> 63 << 64), upto[middle] - upto[lo], upto[hi] - upto[lo])
        todo += [(lo, middle, (*path, (*step, 0))), (middle, hi, (*path, (*step, 1)))]
    return out


def _follow(path, n, size, seeds):
    """Draws that reach the end of a path, and those that fall below it."""
    draws, before = np.full(size, n, np.int64), np.zeros(size, np.int64)
    for bit, prefix, left, total, right in path.tolist():
        lefts = _lefts(draws, left, total, seeds, bit, prefix & (1 << 64) - 1)
        if right:
            draws, before = draws - lefts, before + lefts
        else:
            draws = lefts
    return draws, before


def _blocks(n_boot):
    return [(k, min(BLOCK, n_boot - k * BLOCK)) for k in range(-(-n_boot // BLOCK))]


def _finish(total, n, statistic):
    if statistic == "count":
        return np.full(len(total), float(n))
    return total if statistic in ("sum", "median") else total / n


def _sorted(pdf):
    values = pdf["value"].to_numpy(dtype=float) + 0.0
    order = np.argsort(values, kind="stable")
    return values[order], order_keys(values[order]), pdf["cnt"].to_numpy(dtype=np.int64)[order]


def _seeds(seed, key, role, block):
    return [seed, group_hash(*key), int(role == "test"), block]


def _frame(keys, pdf, rows, columns):
    """Rows with the group's own keys before them."""
    out = pd.DataFrame(rows, columns=columns)
    for k in reversed(keys):
        out.insert(0, k, pdf[k].iloc[:1].repeat(len(out)).reset_index(drop=True))
    return out


def _draw_whole(n_boot: int, seed: int, keys):
    """Replicates of one arm's statistic, drawn in one task."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        key, role, statistic = [pdf[k].iat[0] for k in keys], pdf["role"].iat[0], pdf["statistic"].iat[0]
        values, order, counts = _sorted(pdf)
        n, rows = int(counts.sum()), []
        for block, size in _blocks(n_boot):
            draws, none = np.full(size, n, np.int64), np.zeros(size, np.int64)
            total = none if statistic == "count" else _total(values, order, counts, draws, none, n, _seeds(seed, key, role, block), statistic)
            rows.append((role, block, _finish(total, n, statistic).tobytes()))
        return _frame(keys, pdf, rows, ["role", "block", "stats"])
    return fn


def _path_rows(keys):
    """From the counts of the ranges of one arm: the path to each."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = pdf["rep"].to_numpy(dtype=np.int64).view(np.uint64)
        pdf = pdf.iloc[np.argsort(reps)]
        paths = _paths(np.sort(reps), pdf["cnt"].to_numpy(dtype=np.int64))
        out = pdf[[*keys, "role", "level", "prefix"]].reset_index(drop=True)
        return out.assign(n=int(pdf["cnt"].sum()), path=[p.tobytes() for p in paths])
    return fn


def _draw_range(n_boot: int, seed: int, keys):
    """The part of one range of values, for every block: the range's values beside the path to it."""
    def fn(pdf: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        key, role, statistic = [pdf[k].iat[0] for k in keys], pdf["role"].iat[0], pdf["statistic"].iat[0]
        values, order, counts = _sorted(pdf)
        path, n = np.frombuffer(paths["path"].iat[0], np.int64).reshape(-1, 5), int(paths["n"].iat[0])
        rows = []
        for block, size in _blocks(n_boot):
            seeds = _seeds(seed, key, role, block)
            draws, before = _follow(path, n, size, seeds)
            rows.append((role, block, statistic, n, order[:1].view(np.int64)[0], _total(values, order, counts, draws, before, n, seeds, statistic).tobytes()))
        return _frame(keys, pdf, rows, ["role", "block", "statistic", "n", "rep", "part"])
    return fn


def _add_ranges(keys):
    """Adds one block's parts along the tree."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = pdf["rep"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(reps)
        reps, parts = reps[order].tolist(), pdf["part"].to_numpy()[order]

        def node(lo, hi):
            if hi - lo == 1:
                return np.frombuffer(parts[lo], float)
            middle = _branches(reps, lo, hi)[2]
            return node(lo, middle) + node(middle, hi)
        stats = _finish(node(0, len(reps)), int(pdf["n"].iat[0]), pdf["statistic"].iat[0])
        return _frame(keys, pdf, [(pdf["role"].iat[0], int(pdf["block"].iat[0]), stats.tobytes())], ["role", "block", "stats"])
    return fn


def _differences(keys):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        arm = {r: np.frombuffer(x, float) for r, x in zip(pdf["role"], pdf["stats"])}
        # replicates of a discrete metric repeat: ship (difference, count)
        diff, freq = np.unique(arm["test"] - arm["clean"], return_counts=True)
        out = {k: [pdf[k].iat[0]] * len(diff) for k in keys}
        return pd.DataFrame({**out, "diff": diff, "freq": freq.astype(np.int64)})
    return fn


def _with_roles(samples: DataFrame, arms: DataFrame, on) -> DataFrame:
    a, s = arms.alias("a"), samples.alias("s")
    joined = s.join(a, [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in on], "inner")
    return (joined.select("s.*", "a.clean_split", "a.test_split")
            .withColumn("role", F.when(F.col("split") == F.col("clean_split"), F.lit("clean"))
                        .when(F.col("split") == F.col("test_split"), F.lit("test")))
            .where(F.col("role").isNotNull()))


def histograms(samples: DataFrame, arms: DataFrame) -> DataFrame:
    """Value counts per (segment, metric, arm role) for analysed segments."""
    a = arms.where("analysed").select("axis", "segment", "clean_split", "test_split")
    s = _with_roles(samples, a, ["axis", "segment"])
    return (s.groupBy(*GROUP, "metric", "statistic", "clean_split", "test_split", "role", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))


def estimates_from_histograms(hist: DataFrame, keys=GROUP) -> DataFrame:
    """Point estimates (as ``experiment.point_estimates``) from value histograms.

    ``mean``/``sum``/``count`` come from counts and weighted sums; ``median``
    is the exact percentile over the counts (linear interpolation, as numpy).
    """
    extra = [c for c in ("metric", "statistic") if c in hist.columns and c not in keys]
    names = [*keys, *extra, "clean_split", "test_split"]
    per = (hist.groupBy(*names, "role")
           .agg(F.sum("cnt").alias("n"), F.sum(F.col("value") * F.col("cnt")).alias("s"),
                # other statistics keep the values out of the percentile's buffer
                F.percentile(F.when(F.col("statistic") == "median", F.col("value")), F.lit(0.5), F.col("cnt")).alias("med"))
           .withColumn("stat", F.when(F.col("statistic") == "sum", F.col("s"))
                       .when(F.col("statistic") == "count", F.col("n").cast("double"))
                       .when(F.col("statistic") == "median", F.col("med"))
                       .otherwise(F.col("s") / F.col("n"))))
    is_c, is_t = F.col("role") == "clean", F.col("role") == "test"
    wide = (per.groupBy(*names)
            .agg(F.max(F.when(is_c, F.col("stat"))).alias("clean_value"),
                 F.max(F.when(is_t, F.col("stat"))).alias("test_value"),
                 F.max(F.when(is_c, F.col("n"))).alias("clean_n"),
                 F.max(F.when(is_t, F.col("n"))).alias("test_n"))
            .where(F.col("clean_n").isNotNull() & F.col("test_n").isNotNull()))
    diff = F.col("test_value") - F.col("clean_value")
    rel = F.when(F.col("clean_value") != 0, diff / F.col("clean_value") * 100)
    return wide.select(
        *names,
        F.round("clean_value", 6).alias("clean_value"), F.round("test_value", 6).alias("test_value"),
        F.round(diff, 6).alias("observed_difference"), F.round(rel, 6).alias("relative_difference_pct"),
        "clean_n", "test_n")


def _order_key(value: str):
    """``order_keys`` of a column, as a long."""
    @F.pandas_udf("long")
    def key(v: pd.Series) -> pd.Series:
        return pd.Series(order_keys(v.to_numpy(dtype=float)).view(np.int64))
    return key(F.col(value))


def _ranged(values: DataFrame, on, max_task_values: int) -> DataFrame:
    """``values`` with the range (level, prefix) of each: the widest that holds at most ``max_task_values`` of its arm's values."""
    prefix = lambda level: F.shiftrightunsigned("key", 64 - level) if level < 64 else F.col("key")
    # one exchange, which all the counts and joins below reuse
    values = values.withColumn("key", _order_key("value")).repartition(*on, "key")
    joined, level = values, F.lit(LEVELS[0])
    for k, above in enumerate(LEVELS[:-1]):
        # a full range implies that those above it are full; there are at most values / max_task_values of them
        full = (values.groupBy(*on, prefix(above).alias(f"p{above}")).agg(F.count(F.lit(1)).alias("held"))
                .where(F.col("held") > max_task_values).select(*on, f"p{above}", F.lit(True).alias(f"full{above}")))
        joined = joined.withColumn(f"p{above}", prefix(above)).join(full, [*on, f"p{above}"], "left")
        level = F.when(F.col(f"full{above}"), LEVELS[k + 1]).otherwise(level)
    at = F.coalesce(*[F.when(F.col("level") == x, prefix(x)) for x in LEVELS])
    return joined.withColumn("level", level).withColumn("prefix", at)


def bootstrap_diffs(hist: DataFrame, n_boot: int = config.N_BOOTSTRAP, seed: int = config.RANDOM_SEED,
                    max_task_values: int = MAX_TASK_VALUES, keys=GROUP) -> DataFrame:
    """Replicate differences ``statistic(test) - statistic(clean)`` per group.

    Groups with both arms present only; returns ``(*keys, diff, freq)`` where
    ``freq`` counts replicates of a block with that difference. ``max_task_values`` says
    where the tree is cut, not what is drawn.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]  # joins on the keys keep NULL apart from every value
    h = hist.select(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(keys, names)],
                    *keys, "role", "statistic", F.col("value").cast("double").alias("value"), "cnt")
    sizes = (h.groupBy(*names, "role").agg(F.count(F.lit(1)).alias("values"))
             .groupBy(*names).agg(F.count(F.lit(1)).alias("n_roles"), F.max("values").alias("most"))
             .where(F.col("n_roles") == 2))
    named = h.join(sizes.select(*names, (F.col("most") > max_task_values).alias("large")), names, "inner")
    h = named.drop(*names)
    # CPU-bound Python stages on little data: pin the task count so adaptive
    # coalescing does not fold every group into one task
    tasks = hist.sparkSession.sparkContext.defaultParallelism
    arm = _schema(hist, keys, "role string, block int, stats binary")
    whole = (h.where(~F.col("large")).repartition(tasks, *keys, "role").groupBy(*keys, "role")
             .applyInPandas(_draw_whole(n_boot, seed, keys), arm))
    on = [*names, "role"]
    ranged = _ranged(named.where("large"), on, max_task_values).select(*on, *keys, "statistic", "level", "prefix", "key", "value", "cnt")
    counts = ranged.groupBy(*on, "level", "prefix").agg(F.sum("cnt").alias("cnt"), F.min("key").alias("rep"))
    paths = counts.groupBy(*on).applyInPandas(_path_rows(names), _schema(counts, names, "role string, level int, prefix long, n long, path binary"))
    parts = (ranged.groupBy(*on, "level", "prefix").cogroup(paths.groupBy(*on, "level", "prefix"))
             .applyInPandas(_draw_range(n_boot, seed, keys), _schema(hist, keys, "role string, block int, statistic string, n long, rep long, part binary")))
    split = parts.groupBy(*keys, "role", "block").applyInPandas(_add_ranges(keys), arm)
    return (whole.unionByName(split).groupBy(*keys, "block")
            .applyInPandas(_differences(keys), _schema(hist, keys, "diff double, freq long")))


def summarize(diffs: DataFrame, estimates: DataFrame,
              level: float = config.CONFIDENCE_LEVEL, keys=GROUP) -> DataFrame:
    """Bootstrap bounds, p-value and decision joined to the point estimates."""
    keys = list(keys)
    freq = F.col("freq")
    agg = diffs.groupBy(*keys).agg(
        F.percentile("diff", F.lit(1 - level), freq).alias("ci_lower"),
        F.percentile("diff", F.lit(level), freq).alias("ci_upper"),
        F.sum(F.when(F.col("diff") <= 0, freq).otherwise(0)).alias("n_le"),
        F.sum(F.when(F.col("diff") >= 0, freq).otherwise(0)).alias("n_ge"),
        F.sum(freq).alias("n_boot"))
    agg = (agg.withColumn("p_pos", F.col("n_le") / F.col("n_boot"))
           .withColumn("p_neg", F.col("n_ge") / F.col("n_boot")))
    a, e = agg.alias("a"), estimates.alias("e")
    out = e.join(a, [F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "inner")
    return out.select(
        *[F.col(f"e.{c}").alias(c) for c in estimates.columns],
        F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"),
        F.round(F.least("p_pos", "p_neg"), 6).alias("p_value"),
        ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("significant"),
        F.when(F.col("observed_difference") > 0, F.lit("positive"))
        .otherwise(F.lit("negative")).alias("direction"),
        "n_boot", F.lit("multinomial").alias("method"))


def bootstrap_diff(samples: DataFrame, by=(), value: str = "value", split: str = "split",
                   statistic: str = "mean", n_boot: int = config.N_BOOTSTRAP,
                   level: float = config.CONFIDENCE_LEVEL, seed: int = config.RANDOM_SEED,
                   control: str | None = None, max_task_values: int = MAX_TASK_VALUES) -> DataFrame:
    """One-sided bootstrap of ``statistic(test) - statistic(control)`` per ``by`` group.

    ``samples`` has the ``by`` columns, the arm column ``split`` and a numeric
    ``value`` (NULL values are dropped). Groups need exactly two arms; the
    control is ``control`` or else the smaller arm name. ``statistic`` is
    ``mean``, ``median``, ``sum`` or ``count``. Returns one row per group with
    both values, the difference, the bounds at ``1 - level`` and ``level``,
    ``p = min(P(d <= 0), P(d >= 0))``, ``significant``, ``direction``, sizes.
    """
    if statistic not in ("mean", "median", "sum", "count"):
        statistic = "mean"   # any other name means the mean
    keys = list(by) or ["__all"]
    s = samples.where(F.col(value).isNotNull())
    if not by:
        s = s.withColumn("__all", F.lit("all"))
    s = s.select(*keys, F.col(split).alias("split"), F.col(value).cast("double").alias("value"))
    arms = s.groupBy(*keys).agg(F.count_distinct("split").alias("n_arms"),
                                F.min("split").alias("lo"), F.max("split").alias("hi"))
    arms = arms.where(F.col("n_arms") == 2)
    if control is not None:
        arms = arms.where((F.col("lo") == control) | (F.col("hi") == control)).select(
            *keys, F.lit(control).alias("clean_split"),
            F.when(F.col("lo") == control, F.col("hi")).otherwise(F.col("lo")).alias("test_split"))
    else:
        arms = arms.select(*keys, F.col("lo").alias("clean_split"), F.col("hi").alias("test_split"))
    hist = (_with_roles(s, arms, keys).withColumn("statistic", F.lit(statistic))
            .groupBy(*keys, "statistic", "clean_split", "test_split", "role", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))
    diffs = bootstrap_diffs(hist, n_boot, seed, max_task_values=max_task_values, keys=keys)
    out = summarize(diffs, estimates_from_histograms(hist, keys), level, keys)
    return out.drop("__all") if not by else out


def bootstrap_segments(user_df: DataFrame, n_boot: int = config.N_BOOTSTRAP,
                       seed: int = config.RANDOM_SEED, level: float = config.CONFIDENCE_LEVEL,
                       axes=config.SEGMENT_AXES,
                       max_task_values: int = MAX_TASK_VALUES, control: str | None = None) -> DataFrame:
    """Full analysis: every analysed segment x metric with bootstrap bounds. The control arm is
    ``control`` (segments without it are not analysed) or else the smaller split name."""
    from cohortscope.operators import experiment as X
    from cohortscope.sources.sinks import cut_lineage
    seg = X.with_segments(user_df, axes)
    # everything downstream reads the histograms: bounded by distinct values,
    # so a reliable checkpoint is cheap and an executor lost later never
    # re-runs the pull
    hist = cut_lineage(histograms(X.metric_samples(seg), X.segment_arms(seg, control=control)))
    diffs = bootstrap_diffs(hist, n_boot, seed, max_task_values)
    return summarize(diffs, estimates_from_histograms(hist), level)
