"""Numeric helpers: the standard normal CDF as a native expression, and exact
sums/means of decimal amounts.

Neither Spark nor DuckDB has ``erf``. The CDF is evaluated with Hart's
double-precision rational approximation (Hart, "Computer Approximations",
1968, algorithm 5666, as presented by G. West, "Better approximations to
cumulative normal functions", Wilmott 2005): a rational function of
``|x|`` times ``exp(-x^2/2)`` below ``7.07``, a continued fraction above, and
0 beyond 37. Absolute error is below 1e-14, so it replaces a Python UDF with
an expression that stays in generated code, and the same coefficients
render the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of the approximation (highest order first).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
               296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547
CUTOFF = 37.0
SQRT_2PI = 2.506628274631


def _horner(z, coefs, lit, add, mul):
    acc = lit(coefs[0])
    for c in coefs[1:]:
        acc = add(mul(acc, z), lit(c))
    return acc


def normal_cdf(x: Column) -> Column:
    """Phi(x) as a Spark column (NULL in, NULL out)."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    lit, add, mul = F.lit, (lambda a, b: a + b), (lambda a, b: a * b)
    near = e * _horner(z, NUMERATOR, lit, add, mul) / _horner(z, DENOMINATOR, lit, add, mul)
    b = z + 0.65
    for k in (4, 3, 2, 1):
        b = z + F.lit(float(k)) / b
    far = e / b / SQRT_2PI
    tail = F.when(z > CUTOFF, F.lit(0.0)).when(z < SPLIT, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """Phi(x) as SQL text (DuckDB / Spark SQL)."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"

    def horner(coefs):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc} * {z} + {c!r})"
        return acc
    near = f"({e} * {horner(NUMERATOR)} / {horner(DENOMINATOR)})"
    b = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        b = f"({z} + {float(k)!r} / {b})"
    far = f"({e} / {b} / {SQRT_2PI!r})"
    tail = f"(CASE WHEN {z} > {CUTOFF!r} THEN 0.0 WHEN {z} < {SPLIT!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def exact_sum(col: Column) -> Column:
    """Sum as DECIMAL(38, 18): exact for values with at most 18 decimals, so the result does not depend on
    partitioning or summation order. Where a value does not fit (or its digits would be cut), the plain sum."""
    exact = col.try_cast("decimal(38,18)")
    fits = F.coalesce((exact.cast("double") == col.cast("double")), F.lit(False))
    whole = F.coalesce(F.bool_and(F.when(col.isNotNull(), fits)), F.lit(True))
    total = F.try_sum(exact).cast("double")
    return F.when(whole & (total.isNotNull() | (F.count(col) == 0)), total).otherwise(F.sum(col.cast("double")))


def exact_avg(col: Column) -> Column:
    """Mean via ``exact_sum`` (NULLs skipped, as ``avg``)."""
    return exact_sum(col) / F.count(col)
