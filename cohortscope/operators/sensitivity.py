"""Sensitivity analysis: sample size, MDE at a target power, power at an MDE.

Baselines come from one aggregation over the user-level table: every row is
expanded once per metric configuration (a fixed factor of ten) and grouped
by ``(metric, split)``. Everything after that runs on at most a few rows
per metric.

The MDE is solved in closed form instead of with a root finder. With
``k = z(1 - alpha) + z(power)`` and the ``greater`` alternative:

* binary (two proportions, unpooled): power(d) = target  <=>
  ``(n + k^2) d^2 - k^2 (1 - 2p) d - 2 k^2 p (1 - p) = 0``, whose positive
  root is the MDE; it is unreachable when ``d > 1 - p``.
* continuous: ``d = k * sigma * sqrt(2 / n)``.

The ``less`` alternative searches negative effects (``mode="default"``: by
symmetry ``-mde(1 - p)``), or reproduces the analysts' search over positive
effects only, which never reaches the target (``mode="reference"``).
The normal CDF (for power) is a native expression
(``functions.stats.normal_cdf``); z quantiles are constants from
``statistics.NormalDist``.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from cohortscope.functions.stats import normal_cdf
from cohortscope.operators.experiment import arm_order, has_control

_N = NormalDist()


def z(p: float) -> float:
    return _N.inv_cdf(p)


@dataclass(frozen=True)
class MetricConfig:
    name: str
    type: str                 # 'binary' | 'continuous'
    denominator_col: str | None
    value_col: str
    alternative: str = "greater"


# The ten metric configurations of the sensitivity analysis.
METRICS = (
    MetricConfig("Upsell Rate (on View)", "binary", "ups_view", "ups_purched", "greater"),
    MetricConfig("Upsell TTP Rate (on View)", "binary", "ups_view", "ups_ttp", "greater"),
    MetricConfig("Upsell SR (on TTP)", "binary", "ups_ttp", "ups_purched", "greater"),
    MetricConfig("Unsub 12h Rate (on View)", "binary", "ups_view", "unsub12h", "less"),
    MetricConfig("Unsub 12h Rate (on Upsell Purchase)", "binary", "ups_purched", "unsub12h", "less"),
    MetricConfig("Ticket Users Share (on All Users)", "binary", None, "is_ticket", "greater"),
    MetricConfig("Ticket Users Share (on Purch Users)", "binary", "ups_purched", "is_ticket", "greater"),
    MetricConfig("Upsell Gain (on View)", "continuous", "ups_view", "purch_amount", "greater"),
    MetricConfig("LTV", "continuous", "ups_view", "ltv", "greater"),
    MetricConfig("AOV (on Purch Users)", "continuous", "ups_purched", "purch_amount", "greater"),
)

# Default power-analysis effect sizes.
BINARY_POWER_MDE = 0.05          # +5 percentage points
CONTINUOUS_POWER_MDE_REL = 0.10  # +10% of the control mean
CONTINUOUS_SEARCH_MAX = 1e6      # upper end of the analysts' MDE search


def ten_digits(x: Column) -> Column:
    """Ten significant digits, six decimals at most: large effects carry no more than a double's arithmetic gives."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(F.abs(x), F.lit(0.0)))))
    return F.round(F.coalesce(F.round(x / unit, 9) * unit, x), 6)


def two_sided_shift(alpha: float, power: float) -> float:
    """Standardised effect ``x`` with ``1 - cdf(c - x) + cdf(-c - x) = power``, both tails
    counted (``c`` the two-sided critical value): bisection to the last bit. Power
    does not fall under ``alpha``, so a target up to it needs no effect."""
    c, lo, hi = z(1 - alpha / 2), 0.0, z(1 - alpha / 2) + abs(z(power)) + 1
    if power <= alpha:
        return 0.0
    while lo < (mid := (lo + hi) / 2) < hi:
        lo, hi = (lo, mid) if _N.cdf(mid - c) + _N.cdf(-c - mid) >= power else (mid, hi)
    return hi


def baselines(user_df: DataFrame, metrics=METRICS, split: str = "split",
              control: str | None = None, alternative: str | None = None) -> DataFrame:
    """Per metric: control/test arm, population sizes, control mean and sample
    standard deviation, and a status. The control is ``control`` (``invalid_arms``
    without it) or else the smallest split name; ``alternative`` overrides the metrics'."""
    cols = set(user_df.columns)
    usable = [m for m in metrics if m.value_col in cols]
    items = []
    for i, m in enumerate(usable):
        pop = F.lit(True) if m.denominator_col is None else (F.col(m.denominator_col) == 1)
        items.append(F.struct(F.lit(i).alias("metric_order"), F.lit(m.name).alias("metric"),
                              F.lit(m.type).alias("type"), F.lit(alternative or m.alternative).alias("alternative"),
                              pop.alias("in_pop"), F.col(m.value_col).cast("double").alias("value")))
    long = (user_df.where(F.col(split).isNotNull())
            .select(F.col(split).alias("split"), F.explode(F.array(*items)).alias("m"))
            .select("split", "m.*"))
    per_arm = long.groupBy("metric_order", "metric", "type", "alternative", "split").agg(
        F.count(F.when(F.col("in_pop"), 1)).alias("n"),
        F.avg(F.when(F.col("in_pop"), F.col("value"))).alias("mean"),
        F.stddev_samp(F.when(F.col("in_pop"), F.col("value"))).alias("std"))
    arm = arm_order("split", control)
    out = per_arm.groupBy("metric_order", "metric", "type", "alternative").agg(
        F.count(F.lit(1)).alias("n_arms"),
        F.min_by("split", arm).alias("clean_split"), F.max_by("split", arm).alias("test_split"),
        F.min_by("n", arm).alias("n_per_group"), F.max_by("n", arm).alias("n_test"),
        F.min_by("mean", arm).alias("baseline"), F.min_by("std", arm).alias("baseline_std"))
    status = (F.when((F.col("n_arms") != 2) | ~has_control("clean_split", control), F.lit("invalid_arms"))
              .when((F.col("n_per_group") == 0) | (F.col("n_test") == 0), F.lit("empty"))
              .otherwise(F.lit("ok")))
    return out.withColumn("status", status)


def _binary_mde_greater(p: Column, n: Column, k: float) -> Column:
    k2 = k * k
    a = n + F.lit(k2)
    b = F.lit(k2) * (1 - 2 * p)
    disc = F.lit(k2 * k2) * (1 - 2 * p) * (1 - 2 * p) + F.lit(8 * k2) * p * (1 - p) * a
    return (b + F.sqrt(disc)) / (2 * a)


def _binary_reachable(p: Column, n: Column, k: float) -> Column:
    """Power at the largest effect (1 - p) reaches the target."""
    return F.try_divide(n * (1 - p), p) >= F.lit(k * k)


def mde_table(base: DataFrame, alpha: float = 0.05, power: float = 0.8,
              mode: str = "default") -> DataFrame:
    """Minimum detectable absolute effect at ``power`` for every metric."""
    n, p, s = F.col("n_per_group").cast("double"), F.col("baseline"), F.col("baseline_std")
    alt = F.col("alternative")
    k1 = z(1 - alpha) + z(power)
    k2 = two_sided_shift(alpha, power)
    k = F.when(alt == "two-sided", F.lit(k2)).otherwise(F.lit(k1))
    kk = {"greater": k1, "less": k1, "two-sided": k2}
    ok = F.col("status") == "ok"
    degenerate = (p <= 0) | (p >= 1)
    # binary
    q = F.when(alt == "less", 1 - p).otherwise(p)       # mirror 'less' onto 'greater'
    root = F.coalesce(*[F.when(alt == a, _binary_mde_greater(q, n, v)) for a, v in kk.items()])
    reach = F.coalesce(*[F.when(alt == a, _binary_reachable(q, n, v)) for a, v in kk.items()])
    sign = F.when(alt == "less", F.lit(-1.0)).otherwise(F.lit(1.0))
    if mode == "reference":
        reach = reach & (alt != "less")
    bin_mde = F.when(ok & ~degenerate & reach, sign * root)
    bin_status = (F.when(~ok, F.col("status")).when(degenerate, F.lit("undefined"))
                  .when(~reach, F.lit("unreachable")).otherwise(F.lit("ok")))
    # continuous
    cont = k * s * F.sqrt(F.lit(2.0) / n)
    # the closed form has no search range; only the analysts' mode keeps the end of theirs
    beyond = (cont > CONTINUOUS_SEARCH_MAX) if mode == "reference" else F.lit(False)
    cont_ok = ok & s.isNotNull() & (s > 0) & ~beyond
    if mode == "reference":
        cont_ok = cont_ok & (alt != "less")
    cont_mde = F.when(cont_ok, sign * cont)
    cont_status = (F.when(~ok, F.col("status"))
                   .when(s.isNull() | (s <= 0) | beyond, F.lit("undefined"))
                   .when(~cont_ok, F.lit("unreachable")).otherwise(F.lit("ok")))
    is_bin = F.col("type") == "binary"
    return base.select(
        "metric_order", "metric", "type", "alternative", "n_per_group",
        F.round("baseline", 6).alias("baseline"),
        F.round(F.when(~is_bin, s), 6).alias("baseline_std"),
        ten_digits(F.when(is_bin, bin_mde).otherwise(cont_mde)).alias("mde_abs"),
        F.lit(power).alias("target_power"),
        F.when(is_bin, bin_status).otherwise(cont_status).alias("status"))


def _power_terms(base: DataFrame, alpha: float) -> DataFrame:
    """``base`` with the effect, the test statistic at it and the critical value, none of them rounded."""
    n, p, s = F.col("n_per_group").cast("double"), F.col("baseline"), F.col("baseline_std")
    alt = F.col("alternative")
    is_bin = F.col("type") == "binary"
    mde = F.when(is_bin, F.lit(BINARY_POWER_MDE)).otherwise(p * CONTINUOUS_POWER_MDE_REL)
    p2 = p + mde
    var_b = (p * (1 - p) + p2 * (1 - p2)) / n
    se = F.when(is_bin, F.when(var_b > 0, F.sqrt(var_b))).otherwise(s * F.sqrt(F.lit(2.0) / n))
    z_crit = (F.when(alt == "greater", F.lit(z(1 - alpha)))
              .when(alt == "less", F.lit(z(alpha)))
              .otherwise(F.lit(z(1 - alpha / 2))))
    return (base.withColumn("__mde", mde)
            .withColumn("__z_obs", F.when((F.col("status") == "ok") & (se > 0), mde / se))
            .withColumn("__z_crit", z_crit))


_POWER_COLUMNS = ("metric_order", "metric", "type", "alternative", "n_per_group")


def _rounded_terms():
    return [F.round("baseline", 6).alias("baseline"), F.round("__mde", 6).alias("mde_abs"),
            F.round("__z_obs", 6).alias("z_obs"), F.round("__z_crit", 6).alias("z_crit"), F.col("status")]


def power_z(base: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Test statistic at the default effect (binary +5 pp, continuous +10% of mean):
    ``z_obs`` and the critical value, i.e. everything before the normal CDF."""
    return _power_terms(base, alpha).select(*_POWER_COLUMNS, *_rounded_terms())


def power_table(base: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Power at the default effect for every metric (normal approximation)."""
    terms = _power_terms(base, alpha)
    zo, zc, alt = F.col("__z_obs"), F.col("__z_crit"), F.col("alternative")
    power = (F.when(alt == "greater", 1 - normal_cdf(zc - zo))
             .when(alt == "less", normal_cdf(zc - zo))
             .otherwise(1 - normal_cdf(zc - zo) + normal_cdf(-zc - zo)))
    return terms.select(*_POWER_COLUMNS, *_rounded_terms(), F.round(power, 6).alias("power"))


def sample_size(user_df: DataFrame, value_col: str = "purch_amount", mde: float = 8.0,
                alpha: float = 0.05, power: float = 0.8, alternative: str = "greater",
                split: str = "split", control: str | None = None) -> DataFrame:
    """Users per arm to detect ``mde`` on ``value_col``:
    ``ceil((z_a + z_b)^2 (var_x + var_y) / mde^2)``, variances of the control and
    test arm (a missing or zero test variance falls back to the control's). The control
    is ``control`` (no size without it) or else the smallest split name."""
    if alternative == "two-sided":
        za = z(1 - alpha / 2)
    elif alternative in ("less", "greater"):
        za = z(1 - alpha)
    else:
        raise ValueError("alternative must be 'two-sided', 'less' or 'greater'")
    per = (user_df.where(F.col(split).isNotNull()).groupBy(split)
           .agg(F.var_samp(F.col(value_col).cast("double")).alias("var")))
    arm = arm_order(split, control)
    arms = per.agg(F.min_by(split, arm).alias("clean_split"), F.max_by(split, arm).alias("test_split"),
                   F.min_by("var", arm).alias("control_var"), F.max_by("var", arm).alias("test_var"))
    vy = F.when(F.col("test_var").isNull() | (F.col("test_var") == 0), F.col("control_var")) \
        .otherwise(F.col("test_var"))
    n = F.when(has_control("clean_split", control), F.lit((za + z(power)) ** 2) * (F.col("control_var") + vy) / F.lit(mde * mde))
    return arms.select(F.lit(value_col).alias("metric"), "clean_split", "test_split",
                       F.round(F.sqrt("control_var"), 4).alias("control_std"),
                       F.round(F.sqrt("test_var"), 4).alias("test_std"),
                       F.lit(mde).alias("mde"), F.lit(alternative).alias("alternative"),
                       F.ceil(n).cast("long").alias("sample_size"))
