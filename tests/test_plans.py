"""Plan shapes: shuffles, Python nodes, pushed filters, read columns."""

from __future__ import annotations

import contextlib
import io

from tabloom.operators import panel, regularise, windows
from tabloom.plans.q_panel import type_panel
from tabloom.sources.tables import retail_sales, table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def tree(df) -> str:
    return plan(df).split("\n\n(1)")[0]


def test_all_window_features_share_one_shuffle(spark, sf):
    base = type_panel(spark, sf).select("unique_id", "ds", "y")
    extra = tree(windows.all_features(base))
    assert extra.count("Exchange") - tree(base).count("Exchange") == 1
    assert extra.count("Sort (") == 1
    assert "Python" not in extra and "Pandas" not in extra


def test_regular_series_read_the_lines_once(spark, sf):
    text = tree(regularise.regularise_daily(type_panel(spark, sf), unique=True))
    assert text.count("Scan parquet") == 2  # lineitem and part
    assert "SortMergeJoin" not in text and "Python" not in text


def test_panel_reads_only_its_columns(spark, sf):
    text = plan(panel.daily_panel(retail_sales(spark, sf), "MH_SEGMENT", measures={"TOTAL_NET_SALES": "y"}))
    read = [line for line in text.split("\n") if "ReadSchema" in line and "l_shipdate" in line][0]
    assert "l_comment" not in read and "l_quantity" not in read and "l_tax" not in read


def test_filters_reach_the_scan(spark, sf):
    text = plan(table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_orderkey"))
    assert "GreaterThan(l_quantity,40.0)" in text


def test_top_values_limit_before_the_shuffle(spark, sf):
    from tabloom.operators.profile import top_values
    assert "WindowGroupLimit" in plan(top_values(table(spark, sf, "orders"), ["o_orderstatus"], 3))
