"""The plan and skew report tools parse what Spark writes."""

import json

from tools.plans import final_plan, summarize
from tools.skew_check import parse


def test_skew_parser_reads_shuffle_records_per_stage(tmp_path):
    events = [
        {"Event": "SparkListenerJobStart", "Stage IDs": [1, 2],
         "Properties": {"spark.jobGroup.id": "q0"}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1,
         "Task Metrics": {"Shuffle Read Metrics": {"Total Records Read": 0}}},
        *[{"Event": "SparkListenerTaskEnd", "Stage ID": 2,
           "Task Metrics": {"Shuffle Read Metrics": {"Total Records Read": n}}}
          for n in (10, 30, 60)],
    ]
    (tmp_path / "eventlog_v2_x").mkdir()
    with open(tmp_path / "eventlog_v2_x" / "events_1_x", "w") as f:
        f.write("\n".join(json.dumps(e) for e in events) + "\n")
    (tmp_path / "eventlog_v2_x" / "appstatus_x").write_text("ignored")
    assert parse(str(tmp_path)) == {"q0": [(2, 60, 100)]}


def test_plan_summary_drops_initial_plans_and_counts_operators():
    plan = "\n".join([
        "AdaptiveSparkPlan isFinalPlan=true",
        "+- == Final Plan ==",
        "   HashAggregate(keys=[a], functions=[count(1)])",
        "   +- Exchange hashpartitioning(a, 8)",
        "      +- SortMergeJoin [a], [b], Inner",
        "         :- Filter (x > Subquery subquery#1)",
        "         :  :  +- Subquery subquery#1",
        "         :  :     +- AdaptiveSparkPlan isFinalPlan=true",
        "         :  :        +- == Final Plan ==",
        "         :  :           HashAggregate(keys=[], functions=[min(y)])",
        "         :  :        +- == Initial Plan ==",
        "         :  :           SortAggregate(keys=[], functions=[min(y)])",
        "         :  +- FileScan parquet [a] Location: X [file:/d/events.parquet], "
        "PushedFilters: [IsNotNull(a)], ReadSchema: struct<a:bigint>",
        "+- == Initial Plan ==",
        "   Exchange hashpartitioning(a, 8)",
    ])
    assert "SortAggregate" not in final_plan(plan)
    s = summarize(plan)
    assert s["exchanges"] == 1
    assert s["joins"] == {"SortMergeJoin": 1}
    assert s["aggs"] == {"HashAggregate": 2}
    assert s["scans"] == [("events", "IsNotNull(a)", "struct<a:bigint>")]


def test_pushed_filters_of_cut_lines_are_read():
    line = ("FileScan parquet [a] Location: X [file:/d/events.parquet], "
            "PushedFilters: [IsNotNull(a), GreaterThan(a,5), Or(EqualTo(b,x),...")
    assert summarize(line)["scans"][0][1].startswith("IsNotNull(a), GreaterThan(a,5)")
