"""Coverage of the operator inventory, and physical plans that must hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

FAMILIES = {"src": 20, "prj": 22, "nul": 9, "jon": 7, "agg": 30, "win": 20, "ord": 7, "set": 3,
            "fun": 23, "sta": 26, "ml": 15, "str": 10, "udf": 3}


def test_every_operator_has_a_query():
    names = entry.queries()
    missing = [f"{f}{i:02d}" for f, n in FAMILIES.items() for i in range(1, n + 1)
               if not any(q.startswith(f"{f}{i:02d}_") for q in names)]
    assert not missing


def executed(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", [
    "win01_resample_counts", "sta01_standardise", "sta21_detect_anomalies", "sta09_decompose_24",
    "sta12_fitted_values", "sta15_generate_forecasts", "sta05_adf_test"])
def test_the_events_are_scanned_once(spark, name):
    assert len(re.findall("FileScan", executed(spark, name))) == 1


@pytest.mark.parametrize("name", [
    "prj11_positional_slice", "prj12_filter_but_tail", "jon05_concat_columns", "agg18_quantiles",
    "sta24_anomaly_chart", "ml02_tf_idf", "ml05_roc_auc_ovo", "win19_refit_plan", "nul07_fill_mean",
    "agg26_histogram", "sta13_order_search", "src04_retime"])
def test_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", executed(spark, name))


@pytest.mark.parametrize("name,pushed,absent", [
    ("prj13_date_slice", "GreaterThanOrEqual(o_orderdate", "o_totalprice"),
    ("src02_offset_range", "LessThan(ts", "props"),
    ("prj08_filter_and_or", "GreaterThan(l_quantity", "l_shipdate"),
    ("prj07_filter", "EqualTo(event_type,error)", "user_id")])
def test_filters_and_columns_reach_the_scan(spark, name, pushed, absent):
    scan = executed(spark, name).split("FileScan", 1)[1]
    assert pushed in scan and absent not in scan.split("ReadSchema:", 1)[1]


@pytest.mark.parametrize("name,scans", [("agg18_quantiles", 2), ("agg27_box_summary", 3)])
def test_quantiles_read_again_instead_of_moving_values(spark, name, scans):
    """A pass for the sketch and one for the counts; every exchange of rows follows a partial aggregate."""
    plan = executed(spark, name)
    assert 2 <= len(re.findall("FileScan", plan)) <= scans
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert {s.count(":") for s in schemas} == {2}  # the group and the value


@pytest.mark.parametrize("name", ["agg04_describe", "agg05_group_describe", "agg18_quantiles", "agg27_box_summary"])
def test_quantiles_move_no_rows_of_large_groups(spark, name):
    """Rows look up their group's sketch where they lie: what is exchanged was aggregated, or is a row per group."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # less than the rows, more than the groups
    try:
        plan = executed(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    lines = [re.sub(r"^[\s:+*-]*(\(\d+\) )?", "", x) for x in plan.splitlines()]
    below = [(b, c) for a, b, c in zip(lines, lines[1:], lines[2:]) if a.startswith("Exchange hashpartitioning")]
    assert below and all(re.match("(Object)?HashAggregate|SortAggregate", b) or (
        b == "ColumnarToRow" and c.startswith("FileScan") and "l_extendedprice" not in c) for b, c in below), below


def test_characters_are_not_rows(spark):
    """Texts are encoded and decoded where they lie, and grouped as texts."""
    plan = executed(spark, "fun21_decode_characters")
    assert "posexplode(split" not in plan and "Join" not in plan
    assert len(re.findall("Exchange hashpartitioning", plan.split("Subquery")[0])) == 1


@pytest.mark.parametrize("name", ["ord03_top_k", "ord04_tail"])
def test_top_rows_never_sort_everything(spark, name):
    plan = executed(spark, name)
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_slices_filter_the_scan(spark):
    """Only the order columns are put in order; the rows themselves are not moved."""
    plan = executed(spark, "prj11_positional_slice")
    assert "Sort" not in plan.split("Subquery")[0] and "Exchange range" not in plan.split("Subquery")[0]


def test_text_chunks_do_not_move_rows(spark):
    plan = executed(spark, "win17_sequence_batches")
    assert "hashpartitioning" not in plan
