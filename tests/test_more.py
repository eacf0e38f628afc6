"""Configurations, jobs, nested rewrites and small text functions."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import jsons, text
from palimpsest.operators import audit as U
from palimpsest.operators import dialogue as D
from palimpsest.operators import events as E
from palimpsest.operators import records as R
from palimpsest.operators import states
from palimpsest.operators.rank import hash_order
from palimpsest.sources import config, readers


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert config.merge(base, {"a": {"b": 9}, "e": 1}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 1} and base["a"]["b"] == 1
    assert config.placeholders({"answer": "x", "start_date": "2020-01-01", "days": 3, "ok": True, "chain": ["a", "b"], "none": []}) == {"answer": "<answer>", "start_date": "<YYYY-MM-DD>", "days": 0, "ok": False, "chain": ["<chain>"], "none": []}


def test_jobs(spark):
    rows = [("f", i, [("gap", f"p{i}", "g"), ("other", "q", "h")]) for i in range(3)] + [("g", 0, [("gap", " ", "g")]), ("g", 1, None)]
    df = spark.createDataFrame(rows, "file string, sample_id int, data array<struct<Task:string,Prompt:string,GT:string>>")
    assert sorted(r["prompt"] for r in readers.jobs(df, "gap").collect()) == ["p0", "p1", "p2"]
    assert sorted(r["prompt"] for r in readers.jobs(df, "gap", 2).collect()) == ["p0", "p1"]


def test_apply_timestamps(spark):
    s = spark.createDataFrame([("k", [("e1", "old"), ("e2", None)]), ("n", [("e1", "old")]), ("z", None)], "c string, events array<struct<event_id:string,timestamp:string>>")
    t = spark.createDataFrame([("k", "e2", "2020-01-01"), ("k", "e2", "2021-01-01"), ("k", "e9", "x")], "c string, event_id string, stamp string")
    got = {r["c"]: r["events"] and [tuple(e) for e in r["events"]] for r in E.apply_timestamps(s, t, "c", "events").collect()}
    assert got == {"k": [("e1", "old"), ("e2", "2021-01-01")], "n": [("e1", "old")], "z": None}


def test_unfinished(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "k int, decision_complete boolean")
    assert sorted(r["k"] for r in U.unfinished(df, "k").collect()) == [1, 3]


def test_samples_from_records(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "dialogue_id string, task_type string")
    ids = sorted(r["sample_id"] for r in R.samples_from_records(df, hash_order(1, F.col("dialogue_id"))).collect())
    assert {i.rsplit("::", 1)[0] for i in ids} == {"a::x", "b::"} and {i.rsplit("::", 1)[1] for i in ids} == {"0", "1"}


def test_chunk_modes(spark):
    d = spark.createDataFrame([(1, [("user", None, "hello", None)])], "row_id int, dialogue array<struct<role:string,speaker:string,content:string,message:string>>")
    assert D.chunks(d, "row_id", 10).count() == D.chunks(d, "row_id", 10, "sliding", 2).count() == 1
    with pytest.raises(ValueError):
        D.chunks(d, "row_id", 10, "other")


def test_labels_come_back_to_all_members(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z")], "o string, cluster int, fact string")
    got = states.label_clusters(m, spark.createDataFrame([("a", 1, "moves")], "o string, cluster int, schema string"), ["o", "cluster"])
    assert sorted((r["fact"], r["schema"]) for r in got.collect()) == [("x", "moves"), ("y", "moves"), ("z", None)]


def test_text_functions(spark):
    row = spark.createDataFrame([("walking lanterns", "He walked with a lantern")], "a string, b string").select(text.soft_recall(F.col("a"), F.col("b")).alias("y")).first()
    assert row["y"] == 1.0
    assert one(spark, "It was a clock named Old Tom", lambda c: text.value_candidates(c, F.lit("name"))) == ["old tom"]
    assert one(spark, None, lambda c: text.value_candidates(c, F.lit("name"))) == []
    assert one(spark, "INTJ", lambda c: text.speech_style(c, F.lit("60s"))) == "chooses words with care, likes images, argues, keeps to the point, recalls old days"
    assert one(spark, "The event chain is", text.template_left) is True and one(spark, "It is not specified.", text.unspecified) is True


def test_json_functions(spark):
    assert one(spark, '{"facts": ["a", {"fact": "b"}, " "]}', jsons.fact_texts) == ["a", "b"]
    assert one(spark, '["a"]', jsons.fact_texts) == ["a"]
    x = one(spark, ["evidence_snippets", "answer"], lambda c: jsons.soft_fields(F.lit("Information Extraction"), c), "array<string>")
    assert (x["hard"], x["soft"]) == (["answer"], ["evidence_snippets"])
    assert one(spark, '{"aggregate": {"overall": 0.5}, "overall": 1}', lambda c: jsons.number_field(c, "overall")) == 0.5
    assert one(spark, '{"overall": 1}', lambda c: jsons.number_field(c, "overall")) == 1.0
