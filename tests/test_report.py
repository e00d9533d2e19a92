"""The full report from nested session rows."""

from conftest import SMALL

from funnelwright.operators import sessions as se
from funnelwright.plans import catalog
from funnelwright.plans.report import DIGITS, write_report
from funnelwright.sources.schemas import RESULTS
from funnelwright.sources.tables import read_result


def test_report_from_nested_rows(spark, tmp_path):
    nested = catalog.nested(spark, SMALL)
    names = write_report(spark, se.row_facts(nested), se.transaction_hits(nested, list(se.HIT_LEAVES)), str(tmp_path))
    assert set(names) == set(RESULTS)
    for name in names:
        read_result(spark, str(tmp_path / name), RESULTS[name]).collect()  # fails where header and schema differ
    assert set(DIGITS) <= set(RESULTS)
    funnel = read_result(spark, str(tmp_path / "12_funnel_by_channel"), RESULTS["12_funnel_by_channel"])
    assert funnel.collect() == catalog.QUERIES["q12_funnel_by_channel"](spark, SMALL).collect()
    share = read_result(spark, str(tmp_path / "26_return_share_by_channel"), RESULTS["26_return_share_by_channel"])
    exact = {r.channel: r.pct_returning for r in catalog.QUERIES["q26_return_share_by_channel"](spark, SMALL).collect()}
    assert all(abs(r.pct_returning - exact[r.channel]) <= 0.05 + 1e-9 for r in share.collect())
