"""Queries of scoring and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.operators import aggregate as A
from palimpsest.operators import dialogue as D
from palimpsest.operators import records as R
from palimpsest.operators.cluster import cluster_facts as clusters_of
from palimpsest.plans.registry import query, table

BINARY = ["Information Extraction", "Temporal Reasoning", "Knowledge Updating"]


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with a made response: the record of the task itself, of its neighbour, or plain text."""
    t = F.col("task")
    rows = D.task_rows(table(spark, folder, "dialogue_records"), "row_id")
    response = F.when(F.col("task_idx") % 3 == 0, R.sft_output(t)).when(F.col("task_idx") % 3 == 1, t["gold_answer"]).otherwise(R.sft_output(F.struct(t["task_type"].alias("task_type"), t["query"].alias("query"), F.substring(t["gold_answer"], 1, 20).alias("gold_answer"), F.slice(t["answer_components"], 1, 1).alias("answer_components"), t["old_state_value"].alias("old_state_value"))))
    return rows.select("row_id", "task_idx", t["task_type"].alias("task_type"), response.alias("response"), t["query"].alias("query"), t["gold_answer"].alias("reference"), t["answer_components"].alias("components"))


@query()
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rule scores of made responses with their bands; the rules need Python, see their tests."""
    s = scoring.rule_score("task_type", "response", "query", "reference", "components")
    rows = _answered(spark, folder).select("row_id", "task_idx", "task_type", s.alias("s"))
    return rows.select("row_id", "task_idx", "s.score", "s.confident", "s.final", scoring.band(F.col("s.score"), ~F.col("task_type").isin(BINARY)).alias("band"))


@query()
def answer_score_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Mean final score by task type and over the types."""
    s = scoring.rule_score("task_type", "response", "query", "reference", "components")
    rows = _answered(spark, folder).select("task_type", s["final"].alias("final"))
    return A.task_panel(rows, "task_type", "final")


# (case, task type, response, question, reference, components, score, sure, final): what the rules' published description gives.
GOLDEN = [
    ("days and dates", "Temporal Reasoning", '{"final_answer": "12 days", "days": 12, "start_date": "2020-01-01", "end_date": "2020-01-13"}', "How long?", "12 days (2020-01-01 to 2020-01-13)", [], 1.0, True, 1.0),
    ("a date is missing", "Temporal Reasoning", '{"final_answer": "12 days", "days": 12, "start_date": "2020-01-01", "end_date": ""}', "How long?", "12 days", [], 0.0, True, 1.0),
    ("days in plain text", "Temporal Reasoning", "about 12 days", "How long?", "12 days", [], 0.0, True, 1.0),
    ("no days in the reference", "Temporal Reasoning", '{"final_answer": "then", "days": null, "start_date": "2020-01-01", "end_date": "2020-01-13"}', "When?", "from 2020-01-01", [], 0.0, True, 1.0),
    ("the name", "Information Extraction", '{"answer": "Joris Bo", "evidence_snippets": []}', "Who restored the clock?", "Name: Joris Bo", [], 1.0, True, 1.0),
    ("another name", "Information Extraction", '{"answer": "Elian Wick"}', "Who restored the clock?", "Name: Joris Bo", [], 0.0, True, 0.0),
    ("no evidence needed", "Information Extraction", '{"answer": "a brass lantern"}', "Why?", "A brass lantern", [], 1.0, True, 1.0),
    ("no answer field", "Information Extraction", '{"evidence_snippets": ["x"]}', "Why?", "A brass lantern", [], 0.0, True, 0.0),
    ("both silent", "Information Extraction", '{"answer": "It is unknown"}', "Why?", "The reason is not specified", [], 1.0, True, 1.0),
    ("one of two slots", "Information Extraction", '{"answer": "the lantern"}', "What two things were sold?", "the lantern and the quilt", ["the lantern", "the quilt"], 0.0, True, 0.0),
    ("the old state", "Knowledge Updating", '{"latest_state": "zzz", "as_of_time": "", "deprecated_state": "a silver lantern"}', "How is it now?", "a silver lantern", [], 0.0, True, 0.0),
    ("the newest state", "Knowledge Updating", '{"latest_state": "a silver lantern"}', "How is it now?", "A silver lantern", ["a silver lantern"], 1.0, True, 1.0),
    ("the whole chain", "Multi-session Reasoning", '{"event_chain": ["Kela sold the lantern at the market", "the money paid for the cracked clock"], "final_outcome": "Kela sold the lantern at the market and the money paid for the cracked clock"}', "How?", "Kela sold the lantern at the market and the money paid for the cracked clock", ["Kela sold the lantern at the market", "the money paid for the cracked clock"], 1.0, True, 1.0),
    ("no chain", "Multi-session Reasoning", '{"event_chain": ["qq"], "final_outcome": "xx"}', "How?", "Kela sold the lantern at the market", ["Kela sold the lantern at the market"], 0.0, True, 0.0),
    ("a loose tail", "Multi-session Reasoning", '{"event_chain": ["Kela sold the lantern at the market", "the money paid for the cracked clock", "1234 zzzz"], "final_outcome": "Kela sold the lantern at the market"}', "How?", "Kela sold the lantern at the market and the money paid for the cracked clock", ["Kela sold the lantern at the market", "the money paid for the cracked clock"], 0.5, False, 0.5),
    ("the whole summary", "Event Summarization", '{"time_span": "2020", "key_turning_points": ["Kela sold the lantern", "Joris moved to the harbour"], "summary": "In 2020 Kela sold the lantern. Joris moved to the harbour."}', "What happened in 2020?", "In 2020 Kela sold the lantern. Joris moved to the harbour.", ["Kela sold the lantern", "Joris moved to the harbour"], 1.0, True, 1.0),
    ("years outside", "Event Summarization", '{"time_span": "2031", "key_turning_points": ["Kela sold the lantern", "Joris moved to the harbour"], "summary": "Kela sold the lantern. Joris moved to the harbour."}', "What happened in 2020?", "In 2020 Kela sold the lantern. Joris moved to the harbour.", ["Kela sold the lantern", "Joris moved to the harbour"], 0.0, True, 0.0),
    ("no points", "Event Summarization", '{"time_span": "2020", "key_turning_points": [], "summary": "Kela sold the lantern."}', "What?", "Kela sold the lantern.", ["Kela sold the lantern"], 0.0, True, 0.0),
    ("the premise corrected", "Memory Arbitration", '{"premise_verdict": "incorrect", "premise_error": "never lost", "corrected_facts": ["Kela sold the lantern"], "final_answer": "The premise is incorrect. Kela sold the lantern."}', "Why?", "The premise is incorrect. Kela sold the lantern.", ["Kela sold the lantern"], 1.0, True, 1.0),
    ("the wrong verdict", "Memory Arbitration", '{"premise_verdict": "correct", "premise_error": "", "corrected_facts": ["Kela sold the lantern"], "final_answer": "Kela sold the lantern."}', "Why?", "The premise is incorrect. Kela sold the lantern.", ["Kela sold the lantern"], 0.0, True, 0.0),
    ("not an object", "Memory Arbitration", "[1]", "Why?", "x", [], 0.0, True, 0.0),
]
_GOLDEN_SQL = ", ".join(f"('{c[0]}', {c[6]}, {c[7]}, {c[8]})" for c in GOLDEN)


@query(f"SELECT c AS golden, CAST(s AS DOUBLE) AS score, sure, CAST(f AS DOUBLE) AS final FROM (VALUES {_GOLDEN_SQL}) v(c, s, sure, f)")
def golden_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rule scores of fixed answers in the format asked for, one or more for each rule of the six types."""
    rows = spark.createDataFrame([c[:6] for c in GOLDEN], "golden string, task_type string, response string, query string, reference string, components array<string>")
    s = scoring.rule_score("task_type", "response", "query", "reference", "components")
    return rows.select("golden", s.alias("s")).select("golden", "s.score", F.col("s.confident").alias("sure"), "s.final")


_SAID = "CASE p_size % 6 WHEN 0 THEN 'Score: 0.8' WHEN 1 THEN 'partially correct' WHEN 2 THEN 'Incorrect.' WHEN 3 THEN 'correct' WHEN 4 THEN '0.4' ELSE 'no idea' END"


@query(f"""
WITH v AS (SELECT p_partkey, p_size % 2 = 0 AS partial, {_SAID} AS said, CASE WHEN p_size % 7 > 0 THEN (p_size % 7) / 6.0 END AS rule_, CASE WHEN p_size % 3 = 0 THEN 0.5 END AS least_ FROM part),
j AS (SELECT *, CASE said WHEN 'Score: 0.8' THEN 1.0 WHEN 'partially correct' THEN CASE WHEN partial THEN 0.5 ELSE 0.0 END WHEN 'Incorrect.' THEN 0.0 WHEN 'correct' THEN 1.0 WHEN '0.4' THEN CASE WHEN partial THEN 0.5 ELSE 0.0 END END AS vote FROM v)
SELECT p_partkey, CAST(vote AS DOUBLE) AS vote, CASE WHEN vote IS NULL THEN NULL WHEN partial THEN CASE WHEN vote >= 0.75 THEN 'correct' WHEN vote <= 0.25 THEN 'wrong' ELSE 'partial' END WHEN vote >= 0.5 THEN 'correct' ELSE 'wrong' END AS band,
  round(CASE WHEN vote IS NULL OR (NOT partial AND rule_ IS NOT NULL) THEN coalesce(rule_, 0) WHEN partial AND vote < least_ THEN least_ WHEN NOT partial THEN CASE WHEN vote >= 0.5 THEN 1 ELSE 0 END ELSE vote END, 6) AS final,
  CASE WHEN vote IS NULL OR (NOT partial AND rule_ IS NOT NULL) THEN 'rule' WHEN partial AND vote < least_ THEN 'rule_floor' ELSE 'judge' END AS source FROM j
""")
def judged_scores(spark: SparkSession, folder: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("Score: 0.8", "partially correct", "Incorrect.", "correct", "0.4", "no idea")]), (F.col("p_size") % 6 + 1).cast("int"))
    partial = F.col("p_size") % 2 == 0
    rule = F.when(F.col("p_size") % 7 > 0, (F.col("p_size") % 7) / 6.0)
    floor = F.when(F.col("p_size") % 3 == 0, 0.5)
    rows = table(spark, folder, "part").select("p_partkey", "p_size", partial.alias("partial"), scoring.judge_vote(said, partial).alias("vote"), rule.alias("rule"), floor.alias("floor"))
    both = scoring.with_judge(F.col("rule"), F.col("floor"), F.col("vote"), ~F.col("partial"))
    return rows.select("p_partkey", "vote", scoring.band(F.col("vote"), F.col("partial")).alias("band"), F.round(both["final"].cast("double"), 6).alias("final"), both["source"].alias("source"))


@query("SELECT CAST(label AS VARCHAR) AS owner, count(*) AS n, true AS kept, true AS numbered, true AS sized FROM embeddings GROUP BY label")
def fact_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of each label in clusters of 3 to 20: whether every row has one of the numbers and every cluster a size within the bounds."""
    e = table(spark, folder, "embeddings").withColumn("owner", F.col("label").cast("string"))
    sizes = clusters_of(e, "owner", "vec_id", "embedding").groupBy("owner", "cluster").agg(F.count("*").alias("m"), F.max("of").alias("of"), F.countDistinct("vec_id").alias("d"))
    by = sizes.groupBy("owner").agg(F.sum("m").alias("n"), (F.sum("m") == F.sum("d")).alias("kept"), ((F.count("*") == F.max("of")) & (F.min("cluster") == 0) & (F.max("cluster") == F.max("of") - 1)).alias("numbered"), ((F.max("m") <= 20) & ((F.min("m") >= 3) | (F.sum("m") < 3))).alias("sized"))
    return by
