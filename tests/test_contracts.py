"""Task functions, slots and contracts."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import tasks as K
from palimpsest.operators import contracts as C
from palimpsest.operators import slots as S


def values(spark, rows, column, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x")).alias("y")).collect()]


def test_standard_types(spark):
    written = {"Temporal Reasoning": "Temporal Reasoning", " timeline LOGIC": "Temporal Reasoning", "a summary of it": "Event Summarization", "Knowledge": "Knowledge Updating", "whatever": "Information Extraction", "": "Information Extraction", None: "Information Extraction"}
    assert values(spark, list(written), K.standard_type) == list(written.values())


def test_roles_and_steps(spark):
    assert values(spark, ["Evidence Required", "inference-only", "?", None], K.role_name) == ["EVIDENCE_REQUIRED", "INFERENCE_ONLY", None, None]
    assert values(spark, [0.5, 0.98, 0.02], lambda c: K.next_step(c, F.lit("parse"), 0.0, 1.0), "double") == [0.55, 1.0, 0.07]
    assert values(spark, [400, 401, 429, 503, None], lambda c: K.retry_class(c, F.lit(None).cast("string")), "int") == ["bad_request", "fatal", "transient", "transient", "unknown"]


def test_budgets_and_prompts(spark):
    assert values(spark, [1, 100, 1_000], lambda c: K.answer_budget(F.lit("Temporal Reasoning"), c), "int") == [128, 200, 512]
    assert values(spark, ["hi", None], lambda c: K.wrap_prompt(c, "S")) == ["System: S\n\nUser: hi\n\nAssistant: ", "System: S\n\nUser: \n\nAssistant: "]
    assert values(spark, ["opening", "info"], lambda c: K.director_note(c, F.lit("work"), F.array(F.lit("a"), F.lit("b")), F.lit("Kela"))) == ["Open the talk with Kela. Tell: a; b.", "Go on about work. Tell: a; b."]


def test_slots(spark):
    assert values(spark, [["Person", "TIME", "date", "?", None, "status"]], S.sorted_slots, "array<string>") == [["date", "entity", "status"]]
    df = spark.createDataFrame([("Temporal Reasoning", "How many days?", "Kela sold 12 clocks on 2020-03-21"), ("Event Summarization", "Tell", None)], "t string, q string, c string")
    specs = [r["s"] for r in df.select(S.fallback_spec(F.col("t"), F.col("q"), F.col("c")).alias("s")).collect()]
    assert specs[0]["hard"] == {"date": ["2020-03-21"], "number": ["12"]} and specs[0]["soft"]["entity"] == ["Kela"]
    assert specs[1]["hard"] == {}


def test_anchored_specs(spark):
    df = spark.createDataFrame([({"date": ["2020-03-21"], "number": ["12", "99"]}, {"entity": ["Joris"]}, "12 on 2020-04-01")], "hard map<string,array<string>>, soft map<string,array<string>>, c string")
    got = df.select(S.anchored(F.struct("hard", "soft"), F.col("c")).alias("s")).first()["s"]
    assert (got["hard"], got["soft"], got["degraded"]) == ({"number": ["12"]}, {}, ["date"])


def test_slot_verdicts(spark):
    specs = spark.createDataFrame([(1, 0, 0, ({"date": ["2020-03-21"], "number": ["12"]}, {})), (1, 0, 1, ({"number": ["13"]}, {})), (2, 0, 0, ({}, {})), (3, 0, 0, ({"number": ["1"]}, {}))], "k int, task_idx int, comp_idx int, spec struct<hard:map<string,array<string>>,soft:map<string,array<string>>>")
    texts = spark.createDataFrame([(1, "On March 21st she sold 12 clocks.")], "k int, said string")
    got = {(r["k"], r["comp_idx"]): (r["missing"], r["status"]) for r in S.slot_verdicts(specs, texts, "k").collect()}
    assert got == {(1, 0): ([], "PASS"), (1, 1): (["13"], "HARD_MISSING"), (2, 0): ([], "PASS"), (3, 0): (["1"], "HARD_MISSING")}


VOTES = [
    (None, "", [], [], {}, [1], None), (False, "it is covered", [], [], {}, [1], None), (True, "missing", [], [], {}, [1], None), (False, "missing", ["person"], ["date"], {}, [1], None), (False, "missing", ["time"], ["date"], {}, [1], False),
    (True, "found", [], ["date"], {"date": False}, [1], False), (True, "found", [], ["date"], {"date": True}, [], False), (True, "found", [], ["date"], {"date": True}, [3], True),
]


def test_votes(spark):
    df = spark.createDataFrame([v[:6] for v in VOTES], "v boolean, r string, m array<string>, q array<string>, s map<string,boolean>, e array<int>")
    got = [r["x"]["vote"] for r in df.select(S.admit_vote(*[F.col(c) for c in "vrmqse"]).alias("x")).collect()]
    assert got == [v[6] for v in VOTES]


def test_missing_reasons(spark):
    df = spark.createDataFrame([("PRESENT", "PASS", [], None), ("MISSING", "HARD_MISSING", ["12"], None), ("MISSING", "PASS", [], [True, False, False]), ("MISSING", "PASS", [], None)], "status string, hard string, missing array<string>, votes array<boolean>")
    assert [r["reason"] for r in S.missing_reason(df).collect()] == [None, "hard facts missing: 12", "1 of 3 votes", "rule found too little"]


def test_gate(spark):
    keys = ["d", "t", "c"]
    before = spark.createDataFrame([(1, 0, 0, "MISSING"), (1, 0, 1, "PRESENT"), (1, 1, 0, "MISSING"), (1, 2, 0, "MISSING")], "d int, t int, c int, status string")
    after = spark.createDataFrame([(1, 0, 0, "PRESENT"), (1, 0, 1, "MISSING"), (1, 1, 0, "PRESENT")], "d int, t int, c int, status string")
    got = {(r["t"]): (r["passed"], r["regressed"]) for r in S.gate(before, after, before.where("status = 'MISSING'"), keys).collect()}
    assert got == {0: (False, 1), 1: (True, 0), 2: (False, 0)}


def test_fact_contract(spark):
    rows = [("000001", "x", "2020-01-01"), ("000001", "x", "2020-01-01"), ("000004", " ", "soon"), ("5x", None, None), (None, "x", "2020-01-01")]
    got = {r["check"]: r["n"] for r in C.fact_contract(spark.createDataFrame(rows, "id string, f string, d string"), "id", ["f"], "d").collect()}
    assert got == {"missing": 2, "repeated": 1, "malformed": 2, "gap": 2, "date": 2}
    empty = C.fact_contract(spark.createDataFrame([], "id string, f string, d string"), "id", ["f"], "d")
    assert {r["n"] for r in empty.collect()} == {0}


def test_sets_defaults_and_memos(spark):
    a, b = spark.createDataFrame([("x",), (None,), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in C.set_difference(a, b, "k").collect()} == {("x", "left"), (None, "left"), ("z", "right")}
    t = spark.createDataFrame([("y", 5)], "k string, v int")
    assert sorted(r["v"] for r in C.with_default(a, t, ["k"], "v", 0).collect()) == [0, 0, 5]
    rows, fresh = C.memo(spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("y", "old")], "key string, v string"), F.col("k"), "v", F.upper("k"))
    assert sorted(r["v"] for r in rows.collect()) == ["X", "X", "old"] and [tuple(r) for r in fresh.collect()] == [("x", "X")]


def test_subset(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(20)], "k string")
    assert sorted(r["k"] for r in C.subset(df, "k", 3, 1).collect()) == ["k1", "k10", "k11"]
    assert C.subset(df, "k", 5, 0, seed=3).count() == 5
    assert C.subset(df.unionByName(df), "k", 2).count() == 4
    with pytest.raises(Exception):
        C.subset(df.unionByName(df.limit(1)), "k", 30, strict=True).collect()


def test_missions(spark):
    tasks = spark.createDataFrame([("a", ["e1", "e1", None]), ("b", None), ("c", [])], "o string, event_ids array<string>")
    events = spark.createDataFrame([("a", "e1"), ("b", "e1"), ("a", "e2")], "o string, event_id string")
    assert [tuple(r) for r in C.mission_events(tasks, events, "o").collect()] == [("a", "e1")]


def test_self_check_finds_and_misses(spark):
    d = spark.createDataFrame([(1, "user: the brass lantern\nuser: a silver clock")], "k int, said string")
    parts = spark.createDataFrame([(1, 0, 0, "a brass lantern"), (1, 0, 1, "an olive kite")], "k int, task_idx int, comp_idx int, component string")
    row = C.self_check(d, parts, "k").first()
    assert (row["components"], row["found_injected"], row["found_redacted"]) == (2, 1.0, 0.0)


def test_ladder_and_names(spark):
    facts = spark.createDataFrame([(o, k, i) for o in "abc" for k in "xyz" for i in range(4)], "o string, k string, i int")
    got = C.ladder(facts, "o", "k", [(1, 2, 3), (3, 3, 9)], 1, "i")
    assert {r["level"]: r["n"] for r in got.groupBy("level").agg(F.sum("facts").alias("n")).collect()} == {1: 6, 2: 36}
    assert [tuple(x) for x in values(spark, ["a/p_L7_tok123.json", "x"], C.name_parts)] == [(7, 123), (None, None)]
