"""What the physical plans must and must not hold."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest

import __spark_entry__ as contract
from brindle.operators import ROWS_PER_SPLIT_SETTING
from brindle.sources import SCHEMAS

QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.LLM}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def plans(spark, small):
    # no automatic broadcast: the plans that large tables get
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = {n: plan_of(q(spark, small)) for n, q in QUERIES.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_no_broadcast_of_unknown_size(plans, name):
    for operator in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "BroadcastHashJoin",
                     "BroadcastExchange"):
        assert operator not in plans[name]


def test_filters_and_columns_reach_the_scan(plans):
    plan = plans["pricing_summary"]
    assert "LessThanOrEqual(l_shipdate" in plan
    assert "l_orderkey" not in plan
    assert "EqualTo(event_type,view)" in plans["views_beyond_purchases"]
    assert "text" not in plans["labelled_languages"]
    assert "html" not in plans["event_property_counts"]


def test_top_rows_are_cut_before_the_shuffle(plans):
    assert plans["top_orders_per_customer"].count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plans["largest_orders"]


@pytest.mark.parametrize("name, shuffles", [
    ("pricing_summary", 1),
    ("event_neighbours", 1),
    ("order_date_ranks", 1),
    ("running_totals", 1),
    ("user_sessions", 1),
    ("last_signup_before_purchase", 1),
    ("small_quantity_lines", 1),
    ("parts_returned_and_accepted", 1),
    ("order_line_counts", 2),
    ("part_texts", 0),
    ("order_dates", 0),
    ("order_fields", 0),
])
def test_number_of_shuffles(plans, name, shuffles):
    tree = plans[name].split("\n\n")[0]
    assert tree.count("Exchange") == shuffles


def test_equi_joins_are_split_for_hot_keys_at_run_time(spark, skewed):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        # several files, as a partition is split along its map tasks
        "spark.sql.files.maxPartitionBytes": "8KB",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = QUERIES["regional_revenue"](spark, skewed)
        df.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(df)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_hot_path_has_no_cross_join_and_no_python(spark, skewed, tiny_splits):
    for name in ("event_neighbours", "order_date_ranks", "user_sessions", "price_quantiles",
                 "views_before_purchase", "balance_band_pairs", "small_quantity_lines"):
        plan = plan_of(QUERIES[name](spark, skewed))
        for operator in ("CartesianProduct", "NestedLoop", "Python", "Pandas"):
            assert operator not in plan, name


def test_pages_of_repeated_turns(spark, tmp_path):
    """Rows that repeat a turn are as many turns, however small the splits."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"),
            (None, None, "user", "c"), (None, None, "user", "c")]
    rows += [(2, i // 3, "user", "x") for i in range(60)]
    spark.createDataFrame(rows, SCHEMAS["conversations"]).write.parquet(
        f"{tmp_path}/conversations.parquet")
    for split in ("1000", "10"):
        spark.conf.set(ROWS_PER_SPLIT_SETTING, split)
        found = contract.queries()["conversation_pages"](spark, str(tmp_path)).collect()
        pages = {(r["conv_id"], r["page"]): (r["n_turns"], r["turns"]) for r in found}
        assert pages[1, 0] == (3, "user: a | user: a | assistant: b")
        assert pages[None, 0] == (2, "user: c | user: c")
        assert [pages[2, i][0] for i in range(15)] == [4] * 15 and len(pages) == 17
    spark.conf.unset(ROWS_PER_SPLIT_SETTING)


def test_sessions_of_purchases_across_a_change_of_clocks(spark, tmp_path):
    """Local times that a zone skips are times like others."""
    rows = [(i, dt.datetime(2024, 3, 10, 2, 30) + dt.timedelta(minutes=40 * i), 1,
             "purchase" if i % 2 else "view", 1.0, "{}") for i in range(4)]
    rows += [(9, dt.datetime(2024, 3, 12), 1, "purchase", 1.0, "{}")]
    rows += [(10, None, 1, "purchase", 1.0, "{}"), (11, rows[0][1], None, "purchase", 1.0, "{}")]
    spark.createDataFrame(rows, SCHEMAS["events"]).write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = contract.queries()["purchase_sessions"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.event_id, r.session_start, r.n_rows) for r in found) == [
        (1, rows[0][1], 4), (3, rows[0][1], 4), (9, rows[4][1], 1)]
