"""Operators against plain Python on small, awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import aggregate as A
from palimpsest.operators import audit as U
from palimpsest.operators import cluster
from palimpsest.operators import dialogue as D
from palimpsest.operators import events as E
from palimpsest.operators import records as R
from palimpsest.operators import sampling as T
from palimpsest.operators import sequence as S
from palimpsest.operators import states

TURN = "struct<role:string,speaker:string,content:string,message:string>"
TASK = "struct<task_type:string,source_event_ids:array<string>,query:string,gold_answer:string,answer_components:array<string>,old_state_value:string,old_state_event_id:string>"


def dialogues(spark, sizes):
    rows = [(i, [("user", None, "x" * (4 * n - 6), None) for n in ns]) for i, ns in enumerate(sizes)]
    return spark.createDataFrame(rows, f"row_id int, dialogue array<{TURN}>")


def greedy(sizes, most, overlap):
    out, start = [], 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (end == start or total + sizes[end] <= most):
            total, end = total + sizes[end], end + 1
        out.append((len(out), start, end - 1, total))
        if end >= len(sizes):
            break
        start = max(start + 1, end - overlap)
    return out


def sliding(sizes, most, overlap):
    ends = np.cumsum(sizes)
    seen, out, start = set(), [], 0
    while True:
        inside = [i for i in range(len(sizes)) if ends[i] > start and ends[i] - sizes[i] < start + most]
        if inside and (inside[0], inside[-1]) not in seen:
            seen.add((inside[0], inside[-1]))
            out.append((len(out), inside[0], inside[-1], sum(sizes[inside[0] : inside[-1] + 1])))
        if not sizes or start + most >= ends[-1]:
            return out
        start += most - overlap


def test_chunks(spark):
    rng = random.Random(3)
    sizes = [[rng.randint(2, 40) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    d = dialogues(spark, sizes)
    for most, overlap in ((30, 1), (60, 2), (5, 0)):
        got = {}
        for r in D.greedy_chunks(d, "row_id", most, overlap).collect():
            got.setdefault(r["row_id"], []).append((r["chunk"], r["start"], r["end"], r["tokens"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: greedy(s, most, overlap) for i, s in enumerate(sizes) if s}
    for most, overlap in ((30, 10), (60, 0), (50, 49)):
        got = {}
        for r in D.sliding_chunks(D.turn_rows(d, "row_id"), "row_id", most, overlap).collect():
            got.setdefault(r["row_id"], []).append((r["chunk"], r["start"], r["end"], r["tokens"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: sliding(s, most, overlap) for i, s in enumerate(sizes) if s}
    with pytest.raises(ValueError):
        D.sliding_chunks(D.turn_rows(d, "row_id"), "row_id", 10, 10)


def test_turns_fall_back_on_their_aliases(spark):
    rows = [(1, [("", "Kela", "", "hi "), (None, None, "a", None), ("user", None, " \n", None), None]), (2, None), (3, [])]
    d = spark.createDataFrame(rows, f"row_id int, dialogue array<{TURN}>")
    assert {r["row_id"]: r["t"] for r in d.select("row_id", D.render(F.col("dialogue")).alias("t")).collect()} == {1: "Kela: hi\nspeaker: a", 2: "", 3: ""}


def test_degenerate(spark):
    rows = [("go go go go now then", True), ("go go go", False), ("a a b a a b", False), (None, False), ("", False)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x string").select(D.degenerate(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [y for _, y in rows]


def test_longest_gap(spark):
    rows = [("a", 1, 1), ("a", 5, 2), ("a", 9, 3), ("b", 3, 4), ("c", 2, 6), ("c", 2, 5), ("d", None, 7), ("d", 4, 8)]
    df = spark.createDataFrame(rows, "g string, day int, id int")
    got = {r["g"]: (r["id"], r["gap"]) for r in S.longest_gap(df, ["g"], "day", "id").collect()}
    assert got == {"a": (1, 4), "b": (4, 0), "c": (5, 0), "d": (7, 0)}
    assert S.longest_gap(df.limit(0), ["g"], "day", "id").count() == 0


def test_rebalance(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(5)] + [("b", 1, 1.0), ("b", 2, 2.0)], "g string, id int, w double")
    rows = T.rebalance(df, "g", F.col("w"), 3, "id").collect()
    assert sorted((r["g"], r["id"], r["copy"]) for r in rows if r["g"] == "a") == [("a", 1, None), ("a", 2, None), ("a", 4, None)]
    assert sorted(((r["id"], r["copy"]) for r in rows if r["g"] == "b"), key=str) == [(1, None), (2, 1), (2, None)]


def test_upsample(spark):
    rows = T.upsample(spark.range(4), 10, 1, "id").collect()
    counts = [sum(r["id"] == i for r in rows) for i in range(4)]
    assert len(rows) == 10 and max(counts) - min(counts) <= 1
    assert T.upsample(spark.range(0), 5, 1, "id").count() == 0
    assert T.whole_groups(spark.range(4).withColumn("g", F.col("id")), "g", 0, 1, "id").count() == 0


def test_apportion(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None)], "k string, w double")
    got = {r["k"]: r["share"] for r in A.apportion(df, 10, "w", F.col("k")).collect()}
    assert got == {"a": 4, "b": 3, "c": 3, "d": 0}
    assert [r["share"] for r in A.apportion(df.where("w IS NULL"), 10, "w", F.col("k")).collect()] == [0]


def test_holdout(spark):
    rows = [(1, "x")] * 10 + [(2, "x")] * 6 + [(1, "y")] * 3 + [(1, "z"), (2, "z")]
    got = {r["t"]: (r["smallest"], r["holdout"], r["train"]) for r in A.holdout_targets(spark.createDataFrame(rows, "s int, t string"), "s", "t", 0.25, 2).collect()}
    assert got == {"x": (6, 2, 4), "y": (0, 0, 0), "z": (1, 0, 1)}


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), ("", 4, "z"), (None, 5, "z")], "k string, pos int, v string")
    assert sorted((r["k"], r["v"], r["first_position"]) for r in T.last_by_key(df, "k", "pos").collect()) == [("a", None, 1), ("b", "y", 2)]


def test_retention_cells(spark):
    rows = [("m", 1, 1, 0.5), ("m", 2, 1, 0.25), ("m", 2, 2, 0.0), ("m", 3, 2, 0.4), ("m", 3, 1, None)]
    cells = {(r["checkpoint"], r["stage"]): (r["rate"], r["notes"]) for r in A.retention_cells(spark.createDataFrame(rows, "model string, checkpoint int, stage int, score double"), ["model"]).collect()}
    assert cells == {(2, 1): (0.5, ""), (3, 1): (None, "no score"), (3, 2): (None, "no baseline")}


def test_score_panel(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": None},), ({"a": 0.0},), (None,)], "s map<string,double>")
    got = {r["key"]: (r["valid"], r["failed"], r["avg"], r["std"]) for r in A.score_panel(df, "s").collect()}
    assert got == {"a": (2, 1, 0.5, 0.5), "b": (0, 3, None, None)}


STORY = "character_name string, year string, event_id string, time_of_year string, category string, description string, caused_by_event_ids array<string>, timestamp string, loaded_at timestamp_ntz, pos int"


def story(rows):
    return [("k", y, e, t, "c", e, c, None, None, i) for i, (y, e, t, c) in enumerate(rows)]


def test_causality(spark):
    df = spark.createDataFrame(story([("2020", "2020_E1", "May", ["2020_E1", "2020_E9", "2020_E2", "2021_E1"]), ("2020", "2020_E2", "June", None), ("2021", "2021_E1", "May", [])]), STORY)
    got = {(r["cause"], r["issue"]) for r in E.causality_issues(df).collect()}
    assert got == {("2020_E1", "self"), ("2020_E9", "dangling"), ("2020_E2", "inversion"), ("2021_E1", "inversion")}
    assert E.event_issues(df).count() == 0


def chains(edges, order):
    out = []

    def walk(path):
        if 3 <= len(path) <= 5:
            out.append(path)
        if len(path) < 5:
            for n in sorted(edges.get(path[-1], ()), key=order.index):
                if n not in path:
                    walk([*path, n])

    for s in order:
        walk([s])
    out.sort(key=lambda p: -len(p))
    unique = []
    for p in out:
        if p not in unique:
            unique.append(p)
    return unique[:5]


def test_causal_chains(spark):
    rng = random.Random(8)
    for _ in range(4):
        order = [f"2020_E{i}" for i in range(7)]
        causes = {e: sorted({rng.choice(order) for _ in range(rng.randint(0, 2))}) for e in order}
        edges = {}
        for e, cs in causes.items():
            for c in cs:
                if c != e:
                    edges.setdefault(c, []).append(e)
        df = spark.createDataFrame(story([("2020", e, "May", causes[e]) for e in order]), STORY)
        got = [r["path"] for r in E.causal_chains(df).orderBy("rank").collect()]
        assert got == chains(edges, order)


def test_audit_and_clean(spark):
    task = lambda q, parts: ("Information Extraction", None, q, "x", parts, None, None)
    rows = [(1, [("user", None, "The brass lantern was sold", None)], [task("a", ["a brass lantern"]), task("b", ["a silver clock", None]), task("c", None)]), (2, [], [task("d", ["gone"])]), (3, None, None)]
    d = spark.createDataFrame(rows, f"row_id int, dialogue array<{TURN}>, tasks_covered array<{TASK}>")
    audited = U.audit(d, "row_id")
    assert {(r["row_id"], r["task_idx"], r["status"]) for r in audited.collect()} == {(1, 0, "PRESENT"), (1, 1, "MISSING"), (2, 0, "MISSING")}
    cleaned, report = U.clean(d, audited, "row_id")
    assert [[t["query"] for t in r["tasks_covered"]] for r in cleaned.collect()] == [["a", "c"]]
    assert [tuple(r) for r in report.collect()] == [("Information Extraction", 4, 2, 2)]


def test_rule_status(spark):
    said = "On March 21st, 2020 Kela sold the brass lantern at the old market for 12 coins."
    rows = [("Kela sold the brass lantern on 2020-03-21", "PRESENT"), ("sold on 2020-03-22", "MISSING"), ("paid 13 coins", "MISSING"), ("lantern clock market", "SUSPICIOUS"), ("violin", "MISSING")]
    df = spark.createDataFrame([(c, said) for c, _ in rows], "c string, s string").select(U.rule_status(F.col("c"), F.col("s")).alias("y"))
    assert [r["y"] for r in df.collect()] == [y for _, y in rows]


def test_states(spark):
    truth = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], "o string, k string, gold string")
    facts = spark.createDataFrame([("a", "x", "1"), ("a", "x", "9"), ("a", "y", "2"), ("b", "x", "3"), ("b", "x", "4")], "o string, k string, fact string")
    predicted = spark.createDataFrame([("a", "x", "9"), ("a", "y", None), ("c", "x", "1")], "o string, k string, prediction string")
    got = {(r["o"], r["k"]): (r["covered"], r["right"]) for r in states.compare(states.accepted(truth, facts, "o", "k"), predicted, "o", "k").collect()}
    assert got == {("a", "x"): (True, False), ("a", "y"): (True, True), ("b", "x"): (False, False)}


def test_owner_of_text(spark):
    texts = spark.createDataFrame([("Kela Bo met nobody",), ("kela bo and Joris",), ("nobody",), (None,)], "t string")
    owners = spark.createDataFrame([("Kela Bo",), ("Joris",)], "o string")
    assert {r["t"]: r["owner"] for r in states.owner_of_text(texts, owners, "t", "o").collect()} == {"Kela Bo met nobody": "Kela Bo", "kela bo and Joris": None, "nobody": None, None: None}


def test_retrieve(spark):
    rows = [("a", i, s) for i, s in enumerate([0, 0, 3, 0, 0, 0, 1, 0, 0, 0])] + [("b", i, 0) for i in range(11)] + [("c", 0, 0)]
    df = spark.createDataFrame([(k, i, float(s)) for k, i, s in rows], "k string, pos int, s double")
    got = {r["k"]: r["positions"] for r in T.retrieve(df, "k", {"s": (F.col("s"), 1.0)}, F.lit(False), 1, 5).collect()}
    assert got["a"] == [1, 2, 3, 5, 6] and got["b"] == [1, 2, 3, 4, 5] and got["c"] == [0]


def test_insert_turns(spark):
    d = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(3)], "k int, pos int, role string, content string")
    p = spark.createDataFrame([(1, 1, 2, "user", "b"), (1, 1, 1, "user", "a"), (1, 99, 1, "user", "z"), (1, -5, 1, "user", "s"), (7, 0, 1, "user", "?")], "k int, insert_at int, seq int, role string, content string")
    assert [r["content"] for r in D.insert_turns(d, p, "k").orderBy("pos").collect()] == ["s", "t0", "a", "b", "t1", "t2", "z"]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(30):
        n, m = int(rng.integers(1, 5)), 5
        cost = rng.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        got = cluster.assign(cost)
        assert len(set(got)) == n and abs(cost[np.arange(n), got].sum() - best) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 20, 47, 120])
def test_clusters_are_bounded(n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    k = min(max(10, -(-n // 20)), max(1, n // 3))
    labels = cluster.bounded(x, cluster.average_linkage(x, k), 3, 20) if n >= 3 else np.zeros(n, int)
    sizes = np.bincount(labels)
    assert sizes.sum() == n and sizes.max() <= 20 and (n < 3 or sizes.min() >= 3)


def test_average_linkage_finds_the_groups():
    rng = np.random.default_rng(2)
    centres = np.eye(4)[:, :4] * 10
    x = np.concatenate([c + rng.normal(scale=0.1, size=(6, 4)) for c in centres])
    labels = cluster.average_linkage(x, 4)
    assert len({tuple(labels[i * 6 : i * 6 + 6]) for i in range(4)}) == 4 and all(len(set(labels[i * 6 : i * 6 + 6])) == 1 for i in range(4))


def test_records(spark):
    import json

    t = ("Temporal Reasoning", None, "How long?", "It took 12 days.", ["a"], None, None)
    rows = [(1, "id1", "Kela", [("user", None, "hello", None)], [t, ("Memory Arbitration", None, "Why?", "The premise is wrong.", None, None, None), ("x", None, " ", "y", None, None, None), None])]
    d = spark.createDataFrame(rows, f"row_id int, id string, character string, dialogue array<{TURN}>, tasks_covered array<{TASK}>")
    got = {r["task_idx"]: json.loads(r["output"]) for r in R.sft_records(d, "row_id").collect()}
    assert got == {0: {"final_answer": "It took 12 days.", "days": 12, "start_date": "", "end_date": ""}, 1: {"premise_verdict": "incorrect", "premise_error": "The premise is wrong.", "corrected_facts": [], "final_answer": "The premise is wrong."}}
    stage = spark.createDataFrame([(1, 4)], "row_id int, stage int")
    record = json.loads(R.pretrain_records(d, D.greedy_chunks(d, "row_id", 100), "row_id", stage).first()["record"])
    assert record["text"] == "[stage 4 | Kela | chunk 1]\nuser: hello" and record["metadata"]["tokens"] == 3
    assert [r["sample_id"] for r in R.eval_samples(d, "row_id").orderBy("task_idx").collect()] == ["id1::Temporal Reasoning::0", "id1::Memory Arbitration::1", "id1::x::2"]


def test_owners_of_any_size_are_clustered(spark, monkeypatch):
    """More facts than are held at once, all alike or not: each has a cluster, numbered through, of a size within the bounds."""
    monkeypatch.setattr(cluster, "AT_ONCE", 60)
    rng = np.random.default_rng(3)
    rows = [("big", i, [float(x) for x in rng.normal(size=4)]) for i in range(500)] + [("same", i, [1.0, 0.0]) for i in range(150)] + [("two", i, [1.0, float(i)]) for i in range(2)] + [("big", 999, None)]
    got = cluster.cluster_facts(spark.createDataFrame(rows, "o string, k int, v array<double>"), "o", "k", "v").toPandas()
    assert got.groupby("o").k.nunique().to_dict() == {"big": 500, "same": 150, "two": 2} and len(got) == 652
    for o, part in got.groupby("o"):
        sizes = part.groupby("cluster").size()
        assert set(sizes.index) == set(range(part["of"].iloc[0])) and sizes.max() <= 20 and (o == "two" or sizes.min() >= 3)


def test_a_moved_table_keeps_its_keys(spark, tmp_path):
    from palimpsest.streaming import results

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"id": "x"}\n{"id": "y"}\n')
    stream = results.read_jsonl(spark, str(source), "id string", 1)
    results.append_batches(stream, target, str(tmp_path / "s1"), "id").awaitTermination()
    (source / "b.json").write_text('{"id": "z"}\n{"id": "x"}\n{"id": null}\n')
    results.append_batches(stream, target, str(tmp_path / "s1"), "id").awaitTermination()
    results.append_batches(stream, target, str(tmp_path / "s2"), "id").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["x", "y", "z"]
