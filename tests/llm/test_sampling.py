"""Balanced samples, shares and mixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.cube import flight, land
from palimpsest.llm.cube_spark import balanced_sample
from palimpsest.llm import mixing
from palimpsest.llm.mixing import count_tokens, mix_sources, parts_of
from palimpsest.llm.proportion_sample import dialogue_members, sample_to_shares, summary_members, task_type

MEMBERS = "pool string, batch_no int, member string, task_type string"
TARGETS = "plan_id int, pool string, batch_no int, task_type string, target_share double, min_rows int, sample_size int"
TASKS = "row_id long, id string, batch_no int, tasks_covered array<struct<task_type:string,query:string>>"
PLANS = "plan_id int, source string, target_share double, max_repeats int, budget_ratio double"


@pytest.mark.parametrize("n, p", [(1, 1), (7, 2), (500, 3), (5_000, 6)])
def test_flight_keeps_the_balance(n, p):
    rng = np.random.default_rng(n)
    a, pi = rng.random((n, p)) * 10, rng.random(n)
    done = flight(pi, a, rng)
    assert ((done > 0) & (done < 1)).sum() <= p
    assert np.allclose(a.T @ done, a.T @ pi)
    assert set(np.unique(land(done, a, rng))) <= {0.0, 1.0}


def test_no_kind_lands_a_whole_unit_off():
    rng = np.random.default_rng(6)
    for _ in range(300):
        kind = rng.integers(0, 6, rng.integers(1, 60))
        share = rng.random(6)
        pi = share[kind]
        a = np.column_stack([pi, *[np.where(kind == k, pi, 0.0) for k in range(5)]]) / pi[:, None]
        done = land(flight(pi, a, rng), a, rng)
        assert set(np.unique(done)) <= {0.0, 1.0} and abs(done.sum() - pi.sum()) < 1
        assert all(abs(done[kind == k].sum() - pi[kind == k].sum()) < 1 for k in range(6))


def test_draws_have_their_probabilities():
    rng = np.random.default_rng(1)
    pi = np.array([0.2, 0.5, 0.5, 0.8, 0.3, 0.7])
    a = np.stack([np.ones(6), np.arange(6.0)], axis=1)
    mean = np.mean([land(flight(pi, a, rng), a, rng) for _ in range(4_000)], axis=0)
    assert np.abs(mean - pi).max() < 0.04


def test_balanced_sample_over_levels(spark):
    units = spark.range(4_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("u"), F.lit(0.25).alias("pi"), F.lit(0.25).alias("one"), F.lit(2_000).alias("size"))
    drawn = balanced_sample(units, ["g"], "u", "pi", ["one"], "size", bucket=100)
    assert {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()} == {0: 500, 1: 500}
    assert drawn.distinct().count() == 1_000
    again = balanced_sample(units.repartition(3), ["g"], "u", "pi", ["one"], "size", bucket=100)
    assert sorted(drawn.collect()) == sorted(again.collect())  # a repeated task draws alike


def test_balanced_sample_of_nothing_and_of_sure_units(spark):
    empty = spark.createDataFrame([], "g int, u long, pi double, x double, size long")
    assert balanced_sample(empty, ["g"], "u", "pi", ["x"], "size").count() == 0
    sure = spark.createDataFrame([(1, 1, 1.0, 1.0, 3), (1, 2, 0.0, 1.0, 3), (1, 3, None, 1.0, 3)], "g int, u long, pi double, x double, size long")
    assert [r["u"] for r in balanced_sample(sure, ["g"], "u", "pi", ["x"], "size").collect()] == [1]


def test_task_types(spark):
    written = {
        "Temporal Reasoning": "Temporal Reasoning", " temporal_reasoning ": "Temporal Reasoning", "TR": "Temporal Reasoning", "ＴＲ": "Temporal Reasoning", "Temporal reasoning task": "Temporal Reasoning",
        "Event Summarisation": "Event Summarization", "summarization": "Event Summarization", "Multi-session Reasoning": "Multi-session Reasoning", "cross-event reasoning": "Multi-session Reasoning",
        "fact extraction": "Information Extraction", "state update": "Knowledge Updating", "Knowlege Updating": "Knowledge Updating", "false premise": "Memory Arbitration", "ma\n": "Memory Arbitration",
        "Other": None, "": None, None: None, "small talk": None, "n/a": None, "open chat": None, "mean": None,
    }
    rows = spark.createDataFrame([(k,) for k in written], "w string").select("w", task_type(F.col("w")).alias("t")).collect()
    assert {r["w"]: r["t"] for r in rows} == written


def test_members_count_once(spark):
    t = [("IE", "q"), (None, "q"), ("Other", "q")]
    rows = [(1, "a", 1, t), (2, "a", 1, t), (3, None, 1, [("KU", "q")]), (4, None, 1, [("KU", "q")]), (5, "b", None, None), (6, "c", 1, [])]
    found = dialogue_members(spark.createDataFrame(rows, TASKS)).collect()
    assert sorted(r["task_type"] or "-" for r in found) == ["-", "-", "Information Extraction", "Knowledge Updating", "Knowledge Updating"]
    s = spark.createDataFrame([("m", "s", "IE", "x"), ("m", "s", "ie ", "x"), (None, "s", "IE", "x"), ("m", "s", None, "x")], "model_name string, split_type string, task_type string, member string")
    assert summary_members(s).count() == 2


def test_shares_and_shortfall(spark):
    members = [("d", 1, f"a{i}", "Temporal Reasoning") for i in range(40)] + [("d", 1, f"b{i}", "Event Summarization") for i in range(3)] + [("d", 1, "c", None)]
    targets = [(1, "d", 1, "Temporal Reasoning", 0.5, 1, 20), (1, "d", 1, "Event Summarization", 0.5, 1, 20), (2, "d", 9, "Temporal Reasoning", 1.0, 0, 5), (3, "d", 1, "Temporal Reasoning", None, None, None)]
    sample, report = sample_to_shares(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(targets, TARGETS))
    got = {(r["plan_id"], r["task_type"]): (r["members"], r["drawn"], r["short"]) for r in report.collect()}
    assert got == {(1, "Temporal Reasoning"): (40, 10, False), (1, "Event Summarization"): (3, 3, True), (2, "Temporal Reasoning"): (0, 0, True), (3, "Temporal Reasoning"): (40, 0, False)}
    assert sample.count() == 13 and sample.distinct().count() == 13
    sample, report = sample_to_shares(spark.createDataFrame([], MEMBERS), spark.createDataFrame([], TARGETS))
    assert sample.count() == 0 and report.count() == 0


def test_tokens_of_whole_texts(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, "s", "hello world"), (4, None, "word " * 60_000)]
    counted = {r["doc_id"]: r["tokens"] for r in count_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "text", ["source"]).collect()}
    assert counted[1] == counted[2] == 0 and counted[3] == 2 and 59_990 <= counted[4] <= 60_010


def test_parts_have_the_tokens_of_the_whole_text():
    rng = np.random.default_rng(3)
    encoding = mixing._encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    for _ in range(300):
        text = "".join(rng.choice(list("ab1é,. \n\t'"), size=200)) + "they'll" * 3
        whole = encoding.encode_ordinary(text)
        assert [t for p in parts_of(text, 7) for t in encoding.encode_ordinary(p)] == whole
        assert "".join(parts_of(text, 7)) == text
    long = "x" * 150_000
    assert list(parts_of(long)) == [long]
    assert mixing._merged(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}", "ab" * 3_000) == len(encoding.encode_ordinary("ab" * 3_000))


def test_a_large_plan_is_joined_by_a_shuffle(spark, monkeypatch):
    documents = spark.createDataFrame([(i, "s" if i % 3 else "t", "some words here") for i in range(90)], "doc_id long, source string, text string")
    plans = spark.createDataFrame([(1, "s", 0.4, 3, 0.5), (1, "t", 0.5, 2, 1.0)], PLANS)
    want = sorted(mix_sources(documents, plans)[0].collect())
    monkeypatch.setattr(mixing, "PLAN_ROWS", 0)
    assert sorted(mix_sources(documents, plans)[0].collect()) == want


def test_mix(spark):
    docs = [(i, "big", f"word number {i} and some more words", "x") for i in range(200)] + [(1_000 + i, "small", "a few words here", "x") for i in range(10)] + [(2_000, None, "no source", "x"), (2_001, "big", None, "x")]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string")
    plans = spark.createDataFrame([(1, "big", 0.5, 3, 0.5), (1, "small", 0.5, 2, 0.5), (1, "gone", 0.1, 4, 0.5), (2, "small", None, None, None)], PLANS)
    mix, report = mix_sources(documents, plans)
    got = {(r["plan_id"], r["source"]): r for r in report.collect()}
    assert not got[1, "big"]["short"] and abs(got[1, "big"]["residual"]) < 20
    assert got[1, "small"]["short"] and got[1, "gone"]["short"] and not got[2, "small"]["short"]
    copies = {r["doc_id"]: r["copies"] for r in mix.where("plan_id = 1 AND source = 'small'").collect()}
    assert copies == {1_000 + i: 2 for i in range(10)}
    assert mix.groupBy("plan_id", "doc_id").count().where("count > 1").count() == 0
    mix, report = mix_sources(documents.limit(0), plans)
    assert mix.count() == 0 and report.where("short").count() == 0
