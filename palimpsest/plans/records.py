"""Queries of the record builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.jsons import REQUIRED
from palimpsest.operators import dialogue as D
from palimpsest.operators import records as R
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import STRIP, TASKS, TURNS


def _dialogues(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dialogue_records")


_INSTR = "CASE task.task_type " + " ".join(f"WHEN '{k}' THEN '{t} Return one JSON object with the fields {', '.join(REQUIRED[k])}.'" for k, t in R.INSTRUCTIONS.items()) + " ELSE 'Answer the question.' END"


@query(f"""
WITH {TASKS}, {TURNS}, c AS (SELECT row_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM turns GROUP BY row_id)
SELECT coalesce(id, '') || '::' || coalesce(task.task_type, '') || '::' || task_idx AS sample_id, tasks.row_id, CAST(task_idx AS INTEGER) AS task_idx, md5('### Dialogue' || chr(10) || coalesce(c.t, '') || chr(10) || chr(10) || {_INSTR} || chr(10) || chr(10) || '### Question' || chr(10) || coalesce(task.query, '')) AS prompt, task.gold_answer AS reference FROM tasks LEFT JOIN c USING (row_id)
""")
def contextual_samples(spark: SparkSession, folder: str) -> DataFrame:
    return R.eval_samples(_dialogues(spark, folder), "row_id", context=True).withColumn("prompt", F.md5("prompt"))


@query(f"""
WITH {TASKS} SELECT coalesce(id, '') || '::' || coalesce(task.task_type, '') || '::' || task_idx AS sample_id, row_id, CAST(task_idx AS INTEGER) AS task_idx, {_INSTR} || chr(10) || chr(10) || '### Question' || chr(10) || coalesce(task.query, '') AS prompt, task.gold_answer AS reference FROM tasks
""")
def parametric_samples(spark: SparkSession, folder: str) -> DataFrame:
    return R.eval_samples(_dialogues(spark, folder), "row_id")


@query(f"""
WITH {TASKS}, t AS (SELECT *, task.gold_answer AS a, task.task_type AS k, coalesce(task.query, '') AS q, coalesce(task.answer_components, []) AS p,
  array_to_string(list_append(list_filter(coalesce(task.answer_components, []), lambda x: x IS NOT NULL), task.gold_answer), ' ') AS every FROM tasks WHERE length({STRIP.format("task.query")}) > 0 AND length({STRIP.format("task.gold_answer")}) > 0),
m AS (SELECT *, regexp_extract_all(every, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS ds, regexp_matches(lower(a), 'premise is wrong|premise is incorrect|not what happened|never|no longer|false') AS f FROM t)
SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, {_INSTR} AS instruction, task.query AS input,
  a AS said, CASE WHEN k IN ('Temporal Reasoning', 'Knowledge Updating') THEN NULL ELSE len(p) END AS parts,
  CASE k WHEN 'Temporal Reasoning' THEN coalesce(nullif(regexp_extract(a, '(\\d+)\\s+days?\\b', 1), ''), '-') || '|' || coalesce(list_min(ds), '') || '|' || coalesce(list_max(ds), '') WHEN 'Knowledge Updating' THEN coalesce(task.old_state_value, '') WHEN 'Memory Arbitration' THEN CASE WHEN f THEN 'incorrect' ELSE 'correct' END ELSE '' END AS detail FROM m
""")
def sft_records(spark: SparkSession, folder: str) -> DataFrame:
    """Question-answer records, the fields of their JSON read again by task type."""
    rows = R.sft_records(_dialogues(spark, folder), "row_id")
    at = lambda field: F.get_json_object("output", f"$.{field}")
    kind = R.D.task_rows(_dialogues(spark, folder), "row_id").select("row_id", "task_idx", F.col("task.task_type").alias("k"))
    rows = rows.join(kind, ["row_id", "task_idx"])
    said = F.coalesce(at("final_outcome"), at("summary"), at("latest_state"), at("final_answer"), at("answer"))
    parts = F.coalesce(at("event_chain"), at("key_turning_points"), at("corrected_facts"), at("evidence_snippets"))
    detail = F.when(F.col("k") == "Temporal Reasoning", F.concat_ws("|", F.coalesce(at("days"), F.lit("-")), at("start_date"), at("end_date"))).when(F.col("k") == "Knowledge Updating", at("deprecated_state")).when(F.col("k") == "Memory Arbitration", at("premise_verdict")).otherwise("")
    size = F.when(F.col("k").isin("Temporal Reasoning", "Knowledge Updating"), F.lit(None)).otherwise(F.size(F.from_json(parts, "array<string>")))
    return rows.select("row_id", "task_idx", "instruction", "input", said.alias("said"), size.cast("long").alias("parts"), detail.alias("detail"))


@query()
def pretrain_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pretraining records of greedy chunks, by stage."""
    d = _dialogues(spark, folder)
    stage = R.project(d, "row_id", 10, 0.8, 7).select("row_id", "stage")
    return R.pretrain_records(d, D.greedy_chunks(d, "row_id", 200, 1), "row_id", stage)


@query("""
WITH s AS (SELECT row_id, ntile(10) OVER (ORDER BY md5('7:' || row_id), row_id) AS stage FROM dialogue_records),
r AS (SELECT *, count(*) OVER (PARTITION BY stage) AS n, row_number() OVER (PARTITION BY stage ORDER BY md5('8:' || row_id), row_id) AS rn FROM s)
SELECT row_id, stage, CASE WHEN rn <= CASE WHEN n <= 1 THEN n ELSE least(n - 1, greatest(1, CAST(round_even(n * 0.8, 0) AS BIGINT))) END THEN 'train' ELSE 'test' END AS part FROM r
""", ints="stage")
def project_plan(spark: SparkSession, folder: str) -> DataFrame:
    return R.project(_dialogues(spark, folder), "row_id", 10, 0.8, 7)


@query("""
WITH s AS (SELECT unnest(generate_series(1, 10)) AS c), g AS (SELECT c AS checkpoint, unnest(generate_series(1, c)) AS stage FROM s), x AS (SELECT *, unnest(['seen', 'unseen']) AS split FROM g)
SELECT CAST(checkpoint AS INTEGER) AS checkpoint, CAST(stage AS INTEGER) AS stage, split FROM x WHERE NOT (stage = 1 AND split = 'seen')
""")
def job_grid(spark: SparkSession, folder: str) -> DataFrame:
    stages = spark.range(1, 11).select(F.col("id").cast("int").alias("stage"))
    done = stages.select(F.col("stage").alias("checkpoint"), F.lit(1).alias("stage"), F.lit("seen").alias("split"))
    return R.job_grid(stages, ["seen", "unseen"], done)
