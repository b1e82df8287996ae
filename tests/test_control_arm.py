"""Named control arms and the two-sided effect."""

from statistics import NormalDist

import pytest

from cohortscope.operators import sensitivity as SN
from cohortscope.operators.experiment import segment_arms


@pytest.mark.parametrize("control, clean, test, analysed", [
    (None, "u15.10", "u15.3", True), ("u15.3", "u15.3", "u15.10", True), ("u16", "u15.10", "u15.3", False)])
def test_segment_arms_follow_the_named_control(spark, control, clean, test, analysed):
    rows = spark.createDataFrame([("overall", "overall", s) for s in ("u15.3", "u15.10", None)],
                                 "axis string, segment string, split string")
    r = segment_arms(rows, control=control).first()
    assert (r["clean_split"], r["test_split"], r["analysed"]) == (clean, test, analysed)


@pytest.mark.parametrize("alpha, power", [(0.05, 0.8), (0.05, 0.06), (0.2, 0.3), (0.01, 0.99)])
def test_two_sided_shift_counts_both_tails(alpha, power):
    n = NormalDist()
    c, x = n.inv_cdf(1 - alpha / 2), SN.two_sided_shift(alpha, power)
    assert abs(n.cdf(x - c) + n.cdf(-c - x) - power) < 1e-12


def test_two_sided_shift_needs_no_effect_up_to_alpha():
    assert SN.two_sided_shift(0.05, 0.05) == 0.0
