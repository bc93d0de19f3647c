"""Tagged unions, configuration matching, fallbacks, and the drift stream against its batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import frames as FR
from riskloom.sources import registry as REG
from riskloom.streaming import drift_stream as DS


def test_union_tagged_widens_and_replaces(spark):
    a = spark.createDataFrame([(1, 2, "x", [1])], "id int, n int, tag string, l array<int>")
    b = spark.createDataFrame([(2**40, 0.5, dt.date(2024, 1, 2), "t")], "id long, n double, d date, l string")
    out = FR.union_tagged({"a": a, "none": None, "b": b, "empty": a.limit(0)}, "tag")
    assert out.columns == ["id", "n", "l", "d", "tag"] and dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["n"] == "double"
    assert {tuple(r) for r in out.collect()} == {(1, 2.0, "[1]", None, "a"), (2**40, 0.5, "t", dt.date(2024, 1, 2), "b")}
    with pytest.raises(ValueError):
        FR.union_tagged({"a": None}, "tag")


def test_config_match_ignores_order_and_defaults(spark):
    cands = spark.createDataFrame([(1, "m", '{"a": 1, "b": {"y": 2, "x": [1, 2]}}'), (2, "m", '{"b": {"x": [1.0, 2], "y": 2.0}, "a": 1.0}'), (3, "m", '{"a": 2}'), (4, None, None), (5, "m", "no json")], "id int, class_path string, params string")
    cands = cands.withColumn("defaults", F.lit('{"c": true}'))
    wanted = spark.createDataFrame([("w1", "m", '{"c": true, "b": {"y": 2, "x": [1, 2]}, "a": 1}'), ("w2", "n", '{"a": 2}'), ("w3", None, "{}"), ("w4", "m", "{}"), ("w5", "m", '{"a": 2, "c": false}')], "name string, class_path string, params string").withColumn("defaults", F.lit('{"c": true}'))
    got = {r.name: (r.matched, r.n_matches) for r in FR.config_match(wanted, cands, "id", defaults="defaults").collect()}
    assert got == {"w1": (1, 2), "w2": (None, 0), "w3": (4, 1), "w4": (5, 1), "w5": (None, 0)}


def test_selected_model_rules(spark):
    frontier = spark.createDataFrame([(1, "m1", "c1", False, 1), (1, "m2", "c1", True, 2), (2, "m3", "c2", False, 1), (None, "m4", "c4", True, 1)], "k int, model_name string, class_path string, selected_for_refit boolean, rank int")
    policies = spark.createDataFrame([(1, "m2", None), (1, "zz", "c1"), (1, "zz", "cz"), (2, "zz", None), (3, "own", None), (3, None, None), (None, "m4", None)], "k int, model_name string, class_path string")
    got = [(r.k, r.model_name, r.class_path, r.selected_model_name, r.rule) for r in FR.selected_model_resolve(policies, frontier, ["k"]).collect()]
    assert set(got) == {(1, "m2", None, "m2", "policy_model"), (1, "zz", "c1", "m1", "class_path"), (1, "zz", "cz", "m2", "selected_for_refit"), (2, "zz", None, None, None),
                        (3, "own", None, "own", "policy_only"), (3, None, None, None, None), (None, "m4", None, "m4", "policy_model")} and len(got) == 7
    whole = FR.selected_model_resolve(policies.where("k = 1").drop("k"), frontier.drop("k"))
    assert {(r.model_name, r.rule) for r in whole.collect()} == {("m2", "policy_model"), ("zz", "class_path"), ("zz", "selected_for_refit")}


def test_active_row_and_bundle(spark):
    rows = spark.createDataFrame([("a", "p1", 1, 0.1), ("a", "p2", 2, 0.2), ("b", "p3", 5, 0.3), ("b", "p4", 4, 0.4)], "model_name string, policy_name string, policy_order int, threshold double")
    got = {r.model_name: (r.policy_name, r.rule) for r in FR.active_policy_row(rows, ["model_name"], "p2").collect()}
    assert got == {"a": ("p2", "active"), "b": ("p4", "first")}
    assert {r.policy_name for r in FR.active_policy_row(rows, ["model_name"], None).collect()} == {"p1", "p4"}
    table, manifest = FR.feature_bundle({"x": rows.drop("model_name"), "y": None, "z": rows.select("threshold")}, "z", {"x": 3, "y": 4})
    assert manifest["candidate_count"] == 7 and {(r.model_name, r.selected_model_flag) for r in table.collect()} == {("x", 0), ("z", 1)}
    value, rule = FR.diagnostic_threshold(F.col("a"), F.col("b"), F.lit(0.9))
    picked = spark.createDataFrame([(0.1, 0.2), (None, 0.2), (None, None)], "a double, b double").select(value.alias("v"), rule.alias("r")).collect()
    assert [tuple(r) for r in picked] == [(0.1, "selected"), (0.2, "configured"), (0.9, "fresh")]


# -------------------------------------------------------------------- stream
SCHEMA = "ts timestamp, kind string, value double"


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_counts_are_the_batch_counts_of_closed_windows(spark, tmp_path):
    rows = rows_of(spark, [(at(d, h), k, float(h + d * (k == "b"))) for d in range(1, 8) for h in range(0, 24, 2) for k in "ab"] + [(at(2, 1), None, 3.0), (at(2, 1), "a", float("nan")), (None, "a", 1.0), (at(3, 1), "a", None)])
    edges = DS.reference_edges(rows.where(F.col("ts") < F.lit(at(3, 0))), "value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = DS.stream_counts(spark, str(tmp_path / "in"), rows.schema, "ts", "value", edges, "kind")
    DS.run_available_now(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in DS.batch_counts(rows, "ts", "value", edges, "kind").collect()}
    assert {r[0].day for r in got} == set(range(1, 7))  # the last day isn't closed
    psi = DS.window_psi(spark.read.parquet(str(tmp_path / "out")), rows.where(F.col("ts") < F.lit(at(3, 0))), "value", edges, "kind").collect()
    assert all(r.psi < 0.2 for r in psi if r.kind == "a") and max(r.psi for r in psi if r.kind == "b") > 0.25


def test_rows_beyond_the_delay_are_dropped_and_within_it_counted(spark, tmp_path):
    source = tmp_path / "in"
    run = lambda: DS.run_available_now(DS.stream_counts(spark, str(source), rows_of(spark, []).schema, "ts", "value", [5.0], "kind"), str(tmp_path / "out"), str(tmp_path / "check"))
    rows_of(spark, [(at(1, 3), "a", 1.0), (at(2, 0).replace(minute=30), "a", 9.0)]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    rows_of(spark, [(at(1, 23), "a", 1.0)]).coalesce(1).write.mode("append").parquet(str(source))  # an hour and a half late: the first day is still open
    run()
    rows_of(spark, [(at(4, 0), "a", 1.0)]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    rows_of(spark, [(at(1, 5), "a", 1.0), (at(7, 0), "a", 1.0)]).coalesce(1).write.mode("append").parquet(str(source))  # the first day is closed: dropped
    run()
    got = {(r.window_start.day, r.bin): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): 2, (2, 1): 1, (4, 0): 1}


def test_requests_are_parsed_once(spark):
    rows = [(1, '{"a": 1, "b": "2.5"}', None), (2, "{bad", "malformed"), (3, '{"a": 1}', "missing:b"), (4, '{"a": "x", "b": NaN, "c": 1}', "extra:c"),
            (5, '{"a": "x", "b": "NaN"}', "non_numeric:a,b"), (6, '{"a": -1, "b": -2}', "negative:a,b"), (7, None, "malformed"), (8, "{}", "missing:a,b"), (9, '{"a": null, "b": 0}', "non_numeric:a")]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, json string").repartition(2)
    out = REG.payload_validate(df, "json", ["a", "b"], key_cols=["id"])
    got = {r.id: r for r in out.collect()}
    assert {i: r.reject_reason for i, r in got.items()} == {i: why for i, _, why in rows}
    assert (got[1].a, got[1].b, got[1].accepted, got[5].a, got[6].b, got[2].accepted) == (1.0, 2.5, True, None, -2.0, False)
    plan = out.selectExpr("*", "accepted and a > 0 as both")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
