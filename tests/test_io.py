"""Readers, writers and streams on files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import readers, writers
from palimpsest.streaming import results


def test_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"id": 1, "t": "x"}, {"id": 2}]')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    for name in ("a.json", "b.jsonl"):
        assert [tuple(r) for r in readers.records(spark, str(tmp_path / name), "id int, t string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert [r["id"] for r in readers.records(spark, str(tmp_path / "c.jsonl"), "id int", "drop").collect()] == [1, 3]
    with pytest.raises(Exception):
        readers.records(spark, str(tmp_path / "c.jsonl"), "id int").collect()
    assert readers.optional_records(spark, str(tmp_path / "none.json"), "id int").count() == 0


def test_files(spark, tmp_path):
    for c, s, name in ((1, 1, "seen_a"), (1, 1, "seen_b"), (2, 1, "seen_a"), (2, 2, "unseen_a")):
        folder = tmp_path / f"checkpoint_stage_{c:02d}" / f"stage_{s:02d}_{name}"
        folder.mkdir(parents=True)
        (folder / "scores.json").write_text(json.dumps({"at": name}))
    got = {(r["checkpoint"], r["stage"]): json.loads(r["doc"])["at"] for r in readers.score_files(spark, str(tmp_path), "seen").collect()}
    assert got == {(1, 1): "seen_a", (2, 1): "seen_a"}
    for n in (3, 11, 20):
        (tmp_path / f"task_L{n}_tok9.json").write_text("{}")
    assert [r["level"] for r in readers.level_files(spark, str(tmp_path / "*.json"), 3, 12).collect()] == [3, 11]
    listed = readers.files(spark, str(tmp_path), "*.json")
    time.sleep(1.1)
    (tmp_path / "task_L3_tok9.json").write_text("{ }")
    newest = readers.newest(listed, F.regexp_extract("path", r"(task)_L", 1)).collect()
    assert newest[0]["path"].endswith("task_L3_tok9.json")


def test_facts(spark, tmp_path):
    fact = {"fact": " a  b ", "fact_id": "000001", "timestamp": "2020-01-01", "state_repr": "s", "schema": "k"}
    (tmp_path / "f.json").write_text(json.dumps({"Kela": [fact, fact | {"timestamp": "soon"}], "None": []}))
    path = str(tmp_path / "f.json")
    assert [(r["character"], r["pos"], r["fact"]) for r in readers.facts(spark, path, strict=False).collect()] == [("Kela", 0, "a b")]
    with pytest.raises(Exception):
        readers.facts(spark, path).collect()


def test_stories(spark, tmp_path):
    story = {"character_name": "Kela", "chronology": [{"year": 2020, "events": [{"event_id": "2020_E1", "caused_by_event_ids": ["x"]}, None]}, None]}
    (tmp_path / "s.json").write_text(json.dumps([story]))
    rows = readers.story_events(readers.records(spark, str(tmp_path / "s.json"), readers.STORY)).collect()
    assert [(r["character_name"], r["year"], r["event_id"], r["caused_by_event_ids"]) for r in rows] == [("Kela", "2020", "2020_E1", ["x"])]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a,b", None), (2, float("nan"), None, [1])], "id int, x double, t string, l array<int>")
    writers.csv(df.coalesce(1), str(tmp_path / "c"), missing="NaN")
    text = next((tmp_path / "c").glob("part*")).read_text().splitlines()
    assert text[:2] == ["id,x,t,l", '1,0.500000,"a,b",'] and text[2].startswith("2,NaN,NaN,")
    back = readers.csv(spark, str(tmp_path / "c"), "id int, x double, t string, l string")
    assert back.orderBy("id").first()["x"] == 0.5
    writers.jsonl(df.select("id", "t"), str(tmp_path / "j"), "id")
    assert sorted(p.name for p in (tmp_path / "j").glob("id=*")) == ["id=1", "id=2"]
    assert writers.append_new(df.select("id", "t"), str(tmp_path / "p"), "id") == 2
    assert writers.append_new(df.select("id", "t").unionByName(spark.createDataFrame([(3, "n")], "id int, t string")), str(tmp_path / "p"), "id") == 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    row = writers.progress(spark.range(4), spark.range(3), "id").first()
    assert (row["total"], row["completed"], row["pending"], row["done"]) == (4, 3, 1, False)
    panels = writers.long_form({"a": df.select("id"), "b": df.select("x")})
    assert panels.count() == 4 and set(panels.columns) == {"id", "x", "panel"}


def test_ingestion_resumes(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    schema = "id string, response string"

    def run():
        results.append_batches(results.read_jsonl(spark, str(source), schema, 1), target, state, "id").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(target).select("id").collect())

    (source / "1.json").write_text('{"id": "a"}\n{"id": "b"}\n{"id": ""}\n')
    assert run() == ["a", "b"]
    (source / "2.json").write_text('{"id": "b"}\n{"id": "c"}\n{"id": "c"}\n')
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
