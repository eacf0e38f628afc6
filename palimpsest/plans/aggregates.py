"""Queries of the aggregate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import aggregate as A
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import RESULTS

STAGES = list(range(1, 11))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    score = (F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 100) * 100) / 97
    return o.select("o_orderkey", F.col("o_orderstatus").alias("model"), (1 + F.col("o_orderkey") % 10).cast("int").alias("checkpoint"), (1 + F.col("o_custkey") % 10).cast("int").alias("stage"), F.col("o_orderpriority").alias("task"), score.alias("score"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).groupBy("model", "task", "checkpoint", "stage").agg(F.avg("score").alias("score"))


@query("""
WITH long AS (SELECT unnest(['quantity', 'discount', 'tax']) AS key, unnest([l_quantity, CASE WHEN l_discount > 0 THEN l_discount END, l_tax]) AS score FROM lineitem)
SELECT key, count(score) AS valid, count(*) - count(score) AS failed, round(avg(score), 6) AS avg, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM long GROUP BY key
""")
def score_panel(spark: SparkSession, folder: str) -> DataFrame:
    scores = F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), F.when(F.col("l_discount") > 0, F.col("l_discount")), F.lit("tax"), "l_tax")
    return A.score_panel(table(spark, folder, "lineitem").select(scores.alias("scores")), "scores")


@query(f"""
WITH {RESULTS}, by AS (SELECT task, avg(score) AS a, count(*) AS n, avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END) AS p FROM results GROUP BY task),
u AS (SELECT * FROM by UNION ALL SELECT NULL, avg(a), sum(n), avg(p) FROM by)
SELECT task, round(a, 6) AS avg, CAST(n AS BIGINT) AS n, round(p, 6) AS pass_rate FROM u
""".replace("by AS", "per AS").replace("FROM by", "FROM per"))
def task_panel(spark: SparkSession, folder: str) -> DataFrame:
    return A.task_panel(_results(spark, folder), "task", "score", 0.9)


@query("""
WITH t AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS a FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(a), 4) AS macro FROM t GROUP BY l_returnflag
""")
def macro_overall(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("a"))
    return by.groupBy("l_returnflag").agg(F.round(F.avg("a"), 4).alias("macro"))


@query(f"""
WITH {RESULTS}
SELECT checkpoint, task, stage, round(avg(score), 6) AS avg, count(score) AS n, CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(stage) = 0 THEN 'stage' ELSE 'overall' END AS grain
FROM results GROUP BY GROUPING SETS ((checkpoint), (checkpoint, task), (checkpoint, stage))
""")
def forgetting_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.forgetting(_results(spark, folder), "checkpoint", "stage", "task", "score").select("checkpoint", "task", "stage", "avg", "n", "grain")


@query(f"WITH {RESULTS} SELECT model, checkpoint, {', '.join(f'round(avg(score) FILTER (stage = {s}), 6) AS s{s}' for s in STAGES)} FROM results GROUP BY ALL")
def forgetting_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return A.matrix(_results(spark, folder), ["model", "checkpoint"], "stage", STAGES, F.round(F.avg("score"), 6), "s")


@query(f"WITH {RESULTS} SELECT model, {', '.join(f'round(avg(score) FILTER (checkpoint = {s} AND stage = {s}), 6) AS d{s}' for s in STAGES)} FROM results WHERE checkpoint = stage GROUP BY ALL")
def diagonal_scores(spark: SparkSession, folder: str) -> DataFrame:
    return A.matrix(_results(spark, folder).where("checkpoint = stage"), ["model"], "stage", STAGES, F.round(F.avg("score"), 6), "d")


_RETENTION = f"""{RESULTS},
who AS (SELECT DISTINCT model, task FROM cells), cs AS (SELECT DISTINCT checkpoint AS c FROM cells), ss AS (SELECT DISTINCT stage AS s FROM cells),
grid AS (SELECT * FROM who, cs, ss WHERE s < c),
both_ AS (SELECT g.*, b.score AS baseline, o.score AS score FROM grid g LEFT JOIN cells b ON b.model = g.model AND b.task = g.task AND b.checkpoint = g.s AND b.stage = g.s LEFT JOIN cells o ON o.model = g.model AND o.task = g.task AND o.checkpoint = g.c AND o.stage = g.s),
rated AS (SELECT *, CASE WHEN baseline > 0 AND score IS NOT NULL THEN score / baseline END AS rate FROM both_),
retention AS (
  SELECT model, task, c AS checkpoint, s AS stage, round(baseline, 6) AS baseline, round(score, 6) AS score, round(rate, 6) AS rate,
    concat_ws(';', CASE WHEN baseline IS NULL OR baseline <= 0 THEN 'no baseline' WHEN baseline < 0.03 THEN 'baseline<0.03' WHEN baseline < 0.05 THEN 'baseline<0.05' END, CASE WHEN score IS NULL THEN 'no score' END, CASE WHEN rate > 3 THEN 'rate>3' WHEN rate > 2 THEN 'rate>2' END) AS notes
  FROM rated
)"""


@query(f"WITH {_RETENTION} SELECT * FROM retention")
def retention_cells(spark: SparkSession, folder: str) -> DataFrame:
    return A.retention_cells(_cells(spark, folder), ["model", "task"])


@query(f"""
WITH {_RETENTION}
SELECT model, task, checkpoint, round(avg(rate), 6) AS avg, round(coalesce(stddev_samp(rate), 0), 6) AS std, count(*) AS n, CASE WHEN grouping(task) = 1 THEN 'model' WHEN grouping(model) = 1 THEN 'task' ELSE 'both' END AS grain
FROM (SELECT model, task, c AS checkpoint, baseline, rate FROM rated) WHERE baseline >= 0.03 AND rate IS NOT NULL GROUP BY GROUPING SETS ((model, checkpoint), (task, checkpoint), (model, task, checkpoint))
""")
def retention_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.retention_summary(A.retention_cells(_cells(spark, folder), ["model", "task"], digits=None), "model", "task", "checkpoint", 0.03).select("model", "task", "checkpoint", "avg", "std", "n", "grain")


_STAGED = f"""{RESULTS}, own AS (SELECT model, task, stage, score AS own FROM cells WHERE checkpoint = stage),
staged AS (SELECT c.model, c.task, c.checkpoint, c.stage, c.checkpoint - c.stage AS lag, round(c.score, 6) AS score, round(CASE WHEN own > 0 THEN c.score / own END, 6) AS ratio, round(c.score - own, 6) AS delta FROM cells c LEFT JOIN own o ON o.model = c.model AND o.task = c.task AND o.stage = c.stage WHERE c.checkpoint >= c.stage)"""


@query(f"WITH {_STAGED} SELECT * FROM staged")
def stage_cells(spark: SparkSession, folder: str) -> DataFrame:
    return A.stage_cells(_cells(spark, folder), ["model", "task"])


@query(f"WITH {_STAGED.replace('round(', 'least(').replace(', 6)', ')')} SELECT task, lag, round(avg(ratio), 6) AS ratio, round(avg(delta), 6) AS delta, count(*) AS n FROM staged GROUP BY task, lag")
def by_lag(spark: SparkSession, folder: str) -> DataFrame:
    return A.stage_cells(_cells(spark, folder), ["model", "task"], None).groupBy("task", "lag").agg(A.mean("ratio").alias("ratio"), A.mean("delta").alias("delta"), F.count("*").alias("n"))


@query(f"WITH {_STAGED} SELECT model, task, stage, score FROM staged WHERE checkpoint = (SELECT max(checkpoint) FROM staged)")
def last_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    cells = A.stage_cells(_cells(spark, folder), ["model", "task"])
    last = cells.agg(F.max("checkpoint").alias("checkpoint"))
    return cells.join(F.broadcast(last), "checkpoint", "left_semi").select("model", "task", "stage", "score")


@query(f"WITH {_RETENTION} SELECT model, task, round(regr_slope(rate, checkpoint), 6) AS slope, count(*) AS points FROM retention WHERE rate IS NOT NULL GROUP BY ALL")
def retention_slopes(spark: SparkSession, folder: str) -> DataFrame:
    return A.slopes(A.retention_cells(_cells(spark, folder), ["model", "task"]), ["model", "task"], "checkpoint", "rate")


@query(f"""WITH {_RETENTION}
SELECT count(DISTINCT baseline) AS baselines, min(baseline) AS least, max(baseline) AS most, count(*) FILTER (baseline < 0.03) AS below_003, count(*) FILTER (baseline < 0.05) AS below_005, count(*) FILTER (rate > 2) AS above_2, count(*) FILTER (rate > 3) AS above_3 FROM retention WHERE baseline IS NOT NULL""")
def baseline_report(spark: SparkSession, folder: str) -> DataFrame:
    return A.baseline_report(A.retention_cells(_cells(spark, folder), ["model", "task"]))


@query(f"""WITH {_RETENTION}, k AS (SELECT model || '/' || task || '/' || checkpoint || '/' || stage AS k, rate AS v FROM retention WHERE rate IS NOT NULL)
SELECT round(avg(v), 6) AS avg, (SELECT k FROM k ORDER BY v DESC, k DESC LIMIT 1) AS most_at, (SELECT k FROM k ORDER BY v, k LIMIT 1) AS least_at FROM k""")
def retention_extremes(spark: SparkSession, folder: str) -> DataFrame:
    return A.extremes(A.retention_cells(_cells(spark, folder), ["model", "task"]), ["model", "task", "checkpoint", "stage"], "rate")


@query("""
SELECT l_returnflag, CAST(grouping(l_returnflag) AS INTEGER) AS is_total, count(*) AS n, round(coalesce(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / nullif(sum(1), 0), 0), 6) AS discounted, round(coalesce(sum(l_quantity) / nullif(sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END), 0), 0), 6) AS per_taxed
FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def rollup_totals(spark: SparkSession, folder: str) -> DataFrame:
    one = F.lit(1)
    parts = {"discounted": (F.when(F.col("l_discount") > 0.05, 1).otherwise(0), one), "per_taxed": (F.col("l_quantity"), F.when(F.col("l_tax") > 0, 1).otherwise(0))}
    return A.rates(table(spark, folder, "lineitem"), "l_returnflag", parts).withColumn("is_total", F.col("is_total").cast("int"))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), s AS (SELECT sum(n) AS s FROM c),
e AS (SELECT event_type, n, round(n * 1000.0 / s, 9) AS x FROM c, s), f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY x - fl DESC, event_type) AS rn, 1000 - sum(fl) OVER () AS left_ FROM f)
SELECT event_type, n, CAST(fl + CASE WHEN rn <= left_ THEN 1 ELSE 0 END AS BIGINT) AS share FROM r
""")
def apportion_largest_remainder(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return A.apportion(counts, 1_000, "n", F.col("event_type")).select("event_type", "n", "share")


@query("""
WITH c AS (SELECT user_id % 7 AS stage, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT count(DISTINCT stage) AS k FROM c),
m AS (SELECT event_type, CASE WHEN count(*) < any_value(k) THEN 0 ELSE min(n) END AS smallest FROM c, s GROUP BY event_type),
h AS (SELECT *, CASE WHEN smallest <= 1 THEN 0 ELSE least(greatest(5, CAST(floor(smallest * 0.2) AS BIGINT)), smallest - 1) END AS holdout FROM m)
SELECT event_type, CAST(smallest AS BIGINT) AS smallest, CAST(holdout AS BIGINT) AS holdout, CAST(smallest - holdout AS BIGINT) AS train FROM h
""")
def holdout_min_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("stage", F.col("user_id") % 7)
    return A.holdout_targets(rows, "stage", "event_type", 0.2, 5).withColumn("smallest", F.col("smallest").cast("long"))


@query("""
SELECT source, CAST(count(*) AS BIGINT) AS documents, round(avg(CAST(ceil(length(trim(text)) / 4) AS DOUBLE)), 4) AS tokens FROM documents GROUP BY source
""")
def source_panel(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(F.ceil(F.length(F.trim("text")) / 4).cast("double")), 4).alias("tokens"))


@query("""
WITH c AS (SELECT DISTINCT character, task.task_type AS t FROM (SELECT character, unnest(tasks_covered) AS task FROM dialogue_records))
SELECT character, array_to_string(list_sort(list(t)), '|') AS types FROM c WHERE t IS NOT NULL GROUP BY character
""")
def types_by_character(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dialogue_records").select("character", F.explode("tasks_covered.task_type").alias("t")).where("t IS NOT NULL")
    return rows.groupBy("character").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("types"))


@query("""
SELECT model_name, split_type, round(avg(mean_current_stage_task_score), 6) AS macro, count(mean_current_stage_task_score) AS n FROM parametric_taskwise_summary WHERE task_type IS NOT NULL GROUP BY ALL
""")
def model_means(spark: SparkSession, folder: str) -> DataFrame:
    s = "mean_current_stage_task_score"
    return table(spark, folder, "parametric_taskwise_summary").where("task_type IS NOT NULL").groupBy("model_name", "split_type").agg(A.mean(s).alias("macro"), F.count(s).alias("n"))
