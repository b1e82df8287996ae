"""Plan shape: rewrites that must hold at scale."""

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_funnel_copies_no_rows(spark):
    plan = _plan(E.queries()["funnel_daily"](spark, SF_SMALL))
    assert "Expand" not in plan and "Join" not in plan
    assert "partial_bit_or" in plan  # combined before the shuffle
    assert "Expand" not in _plan(E.queries()["funnel_by_version_geo"](spark, SF_SMALL))


def test_no_cartesian_products(spark):
    for name, fn in E.queries().items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan and "Join Cross" not in plan, name


def test_event_scans_prune_partitions(spark):
    df = E.queries()["daily_volume"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan or "PartitionFilters: [(event_date" in plan \
        or "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_experiment_pull_reads_events_three_times_and_prunes_views(spark):
    from cohortscope import config
    plan = _plan(E.queries()["experiment_pull"](spark, SF_SMALL))
    scans = [p.split("ReadSchema")[0] for p in plan.split("FileScan parquet")[1:] if "event_name" in p.split("ReadSchema")[0]]
    assert len(scans) <= 3
    views = [p for p in scans if f"EqualTo(event_name,{config.UPSELL_VIEW})" in p]
    assert len(views) == 1 and "2024-01-08" in views[0].split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_bounded_app_scans_prune_and_keep_results(spark):
    from cohortscope.operators import upsell as U
    from cohortscope.plans import catalog as C
    s = C.sources(spark, SF_SMALL)
    unbounded = U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, C.NOW)
    bounded = U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, C.NOW, app_days=60)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    scans = [p for p in plan.split("FileScan parquet")[1:] if "pr_webapp_upsell_view" in p]
    assert scans and all("PartitionFilters: []" not in p.split("PushedFilters")[0] for p in scans)
    # the generated events span 30 days, so a 60-day bound changes nothing
    assert unbounded.exceptAll(bounded).count() == 0 and bounded.exceptAll(unbounded).count() == 0


def test_asof_tables_never_pass_the_driver(spark):
    # probes are multiplied after the scan: sizes estimated from files say nothing of them
    for name in ("retention_matrix", "retention_daily"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
