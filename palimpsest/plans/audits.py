"""Queries of audits, selections and state tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import sets
from palimpsest.functions.text import INFERENCE_OPENINGS, SLOT_WORDS
from palimpsest.operators import audit as U
from palimpsest.operators import dialogue as D
from palimpsest.operators import sampling as T
from palimpsest.operators import sequence as S
from palimpsest.operators import states
from palimpsest.operators.rank import hash_order
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import TASKS, TURNS, focus

_INFERRED = " OR ".join(f"(task_type = '{k}' AND starts_with(lower(trim(component)), '{s}'))" for k, xs in INFERENCE_OPENINGS.items() for s in xs)


def _audit_sql(least: float, name: str = "audited") -> str:
    return f"""{name}_texts AS (SELECT row_id, {focus("coalesce(string_agg(line, chr(10) ORDER BY pos), '')")} AS said FROM turns GROUP BY row_id),
{name}_comps AS (SELECT row_id, task_idx, j - 1 AS comp_idx, task.task_type AS task_type, task.answer_components[j] AS component FROM (SELECT *, unnest(generate_series(1, len(task.answer_components))) AS j FROM tasks) WHERE task.answer_components[j] IS NOT NULL),
{name}_own AS (SELECT *, {focus("component")} AS own FROM {name}_comps),
{name}_share AS (SELECT o.*, CASE WHEN len(own) > 0 THEN len(list_intersect(own, coalesce(said, []))) / len(own) ELSE 1.0 END AS share FROM {name}_own o LEFT JOIN {name}_texts t USING (row_id)),
{name} AS (SELECT row_id, task_idx, comp_idx, task_type, round(share, 6) AS coverage, CASE WHEN {_INFERRED} THEN 'SKIPPED' WHEN share >= {least} THEN 'PRESENT' ELSE 'MISSING' END AS status FROM {name}_share)"""


_BASE = f"{TURNS}, {TASKS}"


def _dialogues(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dialogue_records")


@query(f"WITH {_BASE}, {_audit_sql(0.5)} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, CAST(comp_idx AS INTEGER) AS comp_idx, task_type, coverage, status FROM audited")
def component_audit(spark: SparkSession, folder: str) -> DataFrame:
    return U.audit(_dialogues(spark, folder), "row_id")


_CLEAN = f"""{_BASE}, {_audit_sql(0.3)},
bad AS (SELECT DISTINCT row_id, task_idx FROM audited WHERE status = 'MISSING'),
kept AS (SELECT * FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.row_id = t.row_id AND b.task_idx = t.task_idx))"""


@query(f"WITH {_CLEAN} SELECT row_id, count(*) AS n, string_agg(coalesce(task.query, '-'), ' | ' ORDER BY task_idx) AS queries FROM kept GROUP BY row_id")
def clean_anti(spark: SparkSession, folder: str) -> DataFrame:
    d = _dialogues(spark, folder)
    cleaned, _ = U.clean(d, U.audit(d, "row_id", 0.3), "row_id")
    return cleaned.select("row_id", F.size("tasks_covered").cast("long").alias("n"), F.array_join(F.transform("tasks_covered", lambda t: F.coalesce(t["query"], F.lit("-"))), " | ").alias("queries"))


@query(f"""WITH {_CLEAN}, r AS (SELECT task.task_type AS task_type, count(*) AS raw FROM tasks GROUP BY 1), v AS (SELECT task.task_type AS task_type, count(*) AS valid FROM kept GROUP BY 1)
SELECT r.task_type, raw, coalesce(valid, 0) AS valid, raw - coalesce(valid, 0) AS removed FROM r LEFT JOIN v ON r.task_type IS NOT DISTINCT FROM v.task_type""")
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    d = _dialogues(spark, folder)
    return U.clean(d, U.audit(d, "row_id", 0.3), "row_id")[1]


@query(f"""WITH {_BASE}, {_audit_sql(0.3, "a")}, {_audit_sql(0.6, "b")}
SELECT count(*) AS compared, count(*) FILTER (a.status <> b.status) AS flipped, round(count(*) FILTER (a.status <> b.status) / count(*), 6) AS flip_rate FROM a JOIN b USING (row_id, task_idx, comp_idx)""")
def flip_report(spark: SparkSession, folder: str) -> DataFrame:
    d = _dialogues(spark, folder)
    return U.flips(U.audit(d, "row_id", 0.3), U.audit(d, "row_id", 0.6), ["row_id", "task_idx", "comp_idx"])


@query(f"""WITH {_BASE}, {_audit_sql(0.5)}, c AS (SELECT row_id, count(*) AS components, count(*) FILTER (status = 'PRESENT') AS present, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'SKIPPED') AS skipped FROM audited GROUP BY row_id)
SELECT *, round(coalesce(present / nullif(present + missing, 0), 0), 6) AS coverage_rate FROM c""")
def dialogue_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return U.dialogue_report(U.audit(_dialogues(spark, folder), "row_id"), "row_id")


#: Where a component is told: the turns with its longest keyword, made of its position for want of evidence tables.
_PLACED = f"""{_BASE}, placed AS (SELECT row_id, task_idx, j - 1 AS comp_idx, [task_idx * 2 + j - 1, task_idx * 2 + j] AS turns FROM (SELECT *, unnest(generate_series(1, len(task.answer_components))) AS j FROM tasks)),
repaired AS (SELECT row_id, task_idx, comp_idx, task_idx * 2 + 3 AS insert_at, 2 AS n FROM placed WHERE comp_idx = 0 AND task_idx = row_id % 5)"""


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = D.task_rows(_dialogues(spark, folder), "row_id").select("row_id", "task_idx", F.posexplode("task.answer_components").alias("comp_idx", "c"))
    first = F.col("task_idx") * 2 + F.col("comp_idx")
    placed = parts.select("row_id", "task_idx", "comp_idx", F.array(first, first + 1).alias("turns"))
    repaired = placed.where((F.col("comp_idx") == 0) & (F.col("task_idx") == F.col("row_id") % 5)).select("row_id", "task_idx", "comp_idx", (F.col("task_idx") * 2 + 3).alias("insert_at"), F.lit(2).alias("n"))
    return placed, repaired


@query(f"""WITH {_PLACED}
SELECT DISTINCT p.row_id, CAST(p.task_idx AS INTEGER) AS task_idx, CAST(p.comp_idx AS INTEGER) AS comp_idx FROM placed p JOIN repaired r ON r.row_id = p.row_id
WHERE (r.task_idx = p.task_idx) OR list_bool_or(list_transform(p.turns, lambda t: t >= greatest(0, r.insert_at - 1) AND t <= r.insert_at + r.n + 1))""".replace("list_bool_or(list_transform(p.turns, lambda t: t >= greatest(0, r.insert_at - 1) AND t <= r.insert_at + r.n + 1))", "len(list_filter(p.turns, lambda t: t >= greatest(0, r.insert_at - 1) AND t <= r.insert_at + r.n + 1)) > 0"))
def neighbor_overlap(spark: SparkSession, folder: str) -> DataFrame:
    placed, repaired = _placed(spark, folder)
    return U.affected(placed, repaired, "row_id", 1)


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id % 1000 END AS turn FROM events),
w AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM s)
SELECT user_id, event_id, before, behind, coalesce(before + 1, behind) AS insert_at FROM w
""")
def nearest_sibling(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id") % 1000).alias("turn"))
    return U.nearest_sibling(e, ["user_id"], "event_id", "turn").drop("turn")


@query("""
WITH v AS (SELECT user_id, list(CASE WHEN value > 10 THEN 'YES' ELSE 'NO' END ORDER BY event_id) AS votes FROM events GROUP BY user_id),
c AS (SELECT user_id, len(list_filter(votes[1:5], lambda x: x = 'YES')) AS strong, CASE WHEN len(votes) > 5 THEN votes[6:1005] ELSE votes END AS rest FROM v)
SELECT user_id, CASE WHEN strong >= 4 THEN 'PRESENT' WHEN 2 * len(list_filter(rest, lambda x: x = 'YES')) > len(rest) THEN 'PRESENT' ELSE 'MISSING' END AS status FROM c
""")
def vote_results(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.struct("event_id", F.when(F.col("value") > 10, "YES").otherwise("NO").alias("v")).alias("x"))
    votes = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("votes"))
    return votes.select("user_id", U.vote_result(F.col("votes")).alias("status"))


@query("""
WITH v AS (SELECT user_id, list_sort(list(CAST(floor(value) AS INTEGER) % 3)) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, v[len(v) // 2 + 1] AS median FROM v
""")
def upper_medians(spark: SparkSession, folder: str) -> DataFrame:
    votes = table(spark, folder, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.collect_list((F.floor("value") % 3).cast("int")).alias("v"))
    return votes.select("user_id", U.upper_median(F.col("v")).alias("median"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, max(n) AS votes FROM c GROUP BY user_id)
SELECT t.user_id, CASE WHEN count(*) = 1 THEN any_value(event_type) END AS role, any_value(votes) AS votes FROM t JOIN c ON c.user_id = t.user_id AND c.n = t.votes GROUP BY t.user_id
""")
def role_plurality(spark: SparkSession, folder: str) -> DataFrame:
    return U.plurality(table(spark, folder, "events"), ["user_id"], "event_type")


@query("SELECT id, arg_max(row_id, row_id) AS row_id, min(row_id) AS first_position, arg_max(batch_no, row_id) AS batch_no FROM dialogue_records WHERE id IS NOT NULL AND id <> '' GROUP BY id")
def dedupe_last(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dialogues(spark, folder).select("id", "row_id", "batch_no", F.col("row_id").alias("position"))
    return T.last_by_key(rows, "id", "position").select("id", "row_id", "first_position", "batch_no")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND length(trim(l_returnflag)) > 0 AND l_returnflag = 'R')")
def resume_anti(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return T.pending(table(spark, folder, "orders"), done, "o_orderkey", "l_returnflag").select("o_orderkey")


@query("""
WITH a AS (SELECT event_id, value, 0 AS shard FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, value + 1, 1 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id + 1000000, value, 1 FROM events WHERE event_id < 10),
b AS (SELECT event_id, arg_max(value, shard) AS value FROM a GROUP BY event_id)
SELECT b.event_id, round(b.value, 6) AS value, coalesce(e.event_id * 2, 1000000000000000000) AS position FROM b LEFT JOIN events e USING (event_id)
""")
def shard_merge(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "value")
    odd = e.where("event_id % 3 <> 0")
    even = e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1).unionByName(e.where("event_id < 10").withColumn("event_id", F.col("event_id") + 1_000_000))
    source = e.select("event_id", (F.col("event_id") * 2).alias("position"))
    return T.merge_shards([odd, even], source, "event_id").withColumn("value", F.round("value", 6))


_WEIGHT = "CASE task_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.TASK_WEIGHTS.items()) + " ELSE 1.0 END"


@query(f"""
WITH r AS (SELECT row_id, record.metadata.character AS character, record.metadata.task_type AS task_type FROM parametric_eval_records),
k AS (SELECT *, count(*) OVER (PARTITION BY character) AS n, row_number() OVER (PARTITION BY character ORDER BY {_WEIGHT} DESC, row_id) AS spot FROM r),
c AS (SELECT row_id, character, unnest(list_concat([NULL], CASE WHEN 12 - n >= spot THEN generate_series(spot, 12 - n, n) ELSE [] END)) AS copy FROM k WHERE spot <= 12)
SELECT row_id, CAST(copy AS INTEGER) AS copy FROM c
""")
def rebalance_topk_cyclic(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "parametric_eval_records").select("row_id", "record.metadata.character", "record.metadata.task_type")
    return T.rebalance(r, "character", T.task_weight(F.col("task_type")), 12, "row_id").select("row_id", "copy")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, sum(n) OVER (ORDER BY md5('9:' || o_custkey), o_custkey) - n AS b FROM g),
r AS (SELECT o.o_orderkey, s.b + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) AS at_ FROM orders o JOIN s USING (o_custkey))
SELECT o_orderkey FROM r WHERE at_ <= 2000
""")
def group_preference(spark: SparkSession, folder: str) -> DataFrame:
    return T.whole_groups(table(spark, folder, "orders"), "o_custkey", 2_000, 9, "o_orderkey").select("o_orderkey")


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('2:' || p_partkey), p_partkey) AS spot, count(*) OVER () AS n FROM part)
SELECT p_partkey, CAST(unnest(list_concat([NULL], CASE WHEN floor((5000 - spot) / n) >= 1 THEN generate_series(1, CAST(floor((5000 - spot) / n) AS BIGINT)) ELSE [] END)) AS INTEGER) AS copy FROM r WHERE spot <= 5000
""")
def upsample_cyclic(spark: SparkSession, folder: str) -> DataFrame:
    return T.upsample(table(spark, folder, "part").select("p_partkey"), 5_000, 2, "p_partkey")


@query("""
WITH k AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('4:' || user_id || ':' || event_type), event_type) AS rn FROM k),
f AS (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS fn FROM events e JOIN c USING (user_id, event_type) WHERE rn <= 2)
SELECT event_id FROM f WHERE fn <= 3
""")
def facts_per_kind(spark: SparkSession, folder: str) -> DataFrame:
    return T.first_per_kind(table(spark, folder, "events"), "user_id", "event_type", 2, 3, 4, "ts", "event_id").select("event_id")


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id FROM p GROUP BY user_id HAVING count(*) >= 5 AND min(n) >= 8) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM g)
""")
def prompt_ready(spark: SparkSession, folder: str) -> DataFrame:
    return T.ready_owners(table(spark, folder, "events"), "user_id", "event_type", 5, 8).select("event_id")


@query("SELECT event_id, lpad(CAST(row_number() OVER (ORDER BY md5('1:' || event_id), event_id) AS VARCHAR), 6, '0') AS fact_id FROM events")
def dense_fact_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id")
    return T.dense_ids(e, hash_order(1, F.col("event_id")), "event_id", name="fact_id")


_GOLD = """s AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
g AS (SELECT *, lead(day) OVER w - day AS gap, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(gap, -1) DESC, rn) AS best FROM g),
gold AS (SELECT user_id, event_type, CAST(event_id AS VARCHAR) AS gold FROM r WHERE best = 1),
sizes AS (SELECT user_id, event_type, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS fact FROM events GROUP BY ALL),
pred AS (SELECT user_id, event_type, arg_min(CAST(event_id AS VARCHAR), value * 1000000 + event_id) AS prediction FROM events WHERE event_type <> 'error' GROUP BY ALL),
cmp AS (SELECT gold.user_id, pred.prediction IS NOT NULL AS covered, coalesce(pred.prediction = gold.gold OR (n = 1 AND pred.prediction = fact), FALSE) AS ok FROM gold JOIN sizes USING (user_id, event_type) LEFT JOIN pred USING (user_id, event_type))"""


@query(f"WITH {_GOLD} SELECT user_id, count(*) AS groups, round(avg(CAST(covered AS INTEGER)), 6) AS coverage, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy, bool_and(ok) AS exact FROM cmp GROUP BY ROLLUP (user_id)")
def state_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    truth = S.longest_gap(e, ["user_id", "event_type"], "day", "event_id").select("user_id", "event_type", F.col("event_id").cast("string").alias("gold"))
    facts = e.select("user_id", "event_type", F.col("event_id").cast("string").alias("fact"))
    predicted = e.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min_by(F.col("event_id").cast("string"), F.col("value") * 1_000_000 + F.col("event_id")).alias("prediction"))
    return states.accuracy(states.compare(states.accepted(truth, facts, "user_id", "event_type"), predicted, "user_id", "event_type"), "user_id")


@query(f"""
WITH {TASKS}, q AS (SELECT row_id, task_idx, {focus("task.gold_answer")} AS a, {focus("task.query")} AS c FROM tasks),
m AS (SELECT *, CASE WHEN len(c) > 0 THEN CAST(len(list_intersect(a, c)) AS DOUBLE) / len(c) ELSE 0.0 END AS r, CASE WHEN len(a) > 0 THEN CAST(len(list_intersect(a, c)) AS DOUBLE) / len(a) ELSE 0.0 END AS p FROM q)
SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0.0 END, 6) AS f1 FROM m
""")
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    tasks = D.task_rows(_dialogues(spark, folder), "row_id")
    return tasks.select("row_id", "task_idx", sets.overlap_metrics(F.col("task.gold_answer"), F.col("task.query")).alias("m")).select("row_id", "task_idx", "m.*")


_OWN = f"list_filter({focus('c')}, lambda x: x NOT IN ({', '.join(repr(w) for w in SLOT_WORDS)}))"


@query(f"WITH {TASKS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, len(list_filter(coalesce(task.answer_components, []), lambda c: len({_OWN}) > 0 AND len(list_intersect({_OWN}, {focus('task.gold_answer')})) >= 0.5 * len({_OWN}))) AS matched FROM tasks")
def components_matched(spark: SparkSession, folder: str) -> DataFrame:
    tasks = D.task_rows(_dialogues(spark, folder), "row_id")
    return tasks.select("row_id", "task_idx", sets.matched_components(F.col("task.gold_answer"), F.col("task.answer_components")).cast("long").alias("matched"))


@query()
def relevant_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid retrieval around the turns that speak of the dialogue's first question; greedy cap, so no SQL."""
    d = _dialogues(spark, folder)
    asked = d.select("row_id", F.try_element_at("tasks_covered", F.lit(1))["query"].alias("q"))
    turns = D.turn_rows(d, "row_id").join(asked, "row_id")
    shared = F.size(F.array_intersect(sets.focus_tokens(F.col("content")), sets.focus_tokens(F.col("q")))).cast("double")
    dated = F.when(F.col("content").rlike(r"\d{4}-\d{2}"), 1.0).otherwise(0.0)
    return T.retrieve(turns, "row_id", {"slot": (shared, 3.0), "date": (dated, 2.0)}, F.lit(False), 2, 12).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query()
def owner_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Event descriptions with the one persona whose first name they contain; see the test for the brute-force version."""
    texts = table(spark, folder, "story_events").select("description").where("description IS NOT NULL").distinct()
    owners = table(spark, folder, "seed_bank").select(F.split("profile.name", " ")[0].alias("first")).distinct()
    return states.owner_of_text(texts, owners, "description", "first")


@query()
def filler_pacing(spark: SparkSession, folder: str) -> DataFrame:
    """A kind of filler for each spoken turn, never twice in a row and each at most 40 times."""
    slots = F.transform(D.spoken(F.col("dialogue")), D.turn_line)
    picked = T.paced_choice(slots, ["weather", "food", "travel", "work"], 40, 3)
    return _dialogues(spark, folder).select("row_id", F.array_join(F.transform(picked, lambda x: F.coalesce(x, F.lit("-"))), ",").alias("kinds"))
