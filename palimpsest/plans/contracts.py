"""Queries of task functions, slots and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import tasks as K
from palimpsest.functions import text
from palimpsest.functions.dates import normalize_date
from palimpsest.operators import audit as U
from palimpsest.operators import contracts as C
from palimpsest.operators import dialogue as D
from palimpsest.operators import events as E
from palimpsest.operators import records as R
from palimpsest.operators import slots as S
from palimpsest.operators.sampling import dense_ids
from palimpsest.operators.rank import hash_order
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import NORMAL, TASKS


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return D.task_rows(table(spark, folder, "dialogue_records"), "row_id")


_LOW = "lower(regexp_replace(task.task_type, '^\\s+|\\s+$', '', 'g'))"
_EXACT = " ".join(f"WHEN {_LOW} = '{n}' THEN '{t}'" for n, t in K.NAMES)
_PART = " ".join(f"WHEN contains({_LOW}, '{n}') OR contains('{n}', {_LOW}) THEN '{t}'" for n, t in [*K.NAMES, *[(t.lower(), t) for t in K.TYPES]])


@query(f"""
WITH {TASKS}, s AS (SELECT CASE WHEN coalesce(length(task.task_type), 0) = 0 THEN '{K.TYPES[0]}' WHEN task.task_type IN ({", ".join(f"'{t}'" for t in K.TYPES)}) THEN task.task_type {_EXACT} {_PART} ELSE '{K.TYPES[0]}' END AS task_type FROM tasks)
SELECT task_type, count(*) AS n FROM s GROUP BY task_type
""")
def standard_types(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select(K.standard_type(F.col("task.task_type")).alias("task_type")).groupBy("task_type").agg(F.count("*").alias("n"))


_Q = "lower(coalesce(task.query, ''))"


@query(f"""
WITH {TASKS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, regexp_matches({_Q}, '\\b(how many|number of|exactly|count)\\b') AS counts, regexp_matches({_Q}, '\\b(duration|interval|elapsed|between|days|months|years|when)\\b') AS times, regexp_matches({_Q}, '\\b(as of|currently|current|latest|status|is this correct)\\b') AS states,
  CAST(greatest(CASE task.task_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in K.BUDGETS.items())} ELSE 128 END, least(512, greatest(64, ceil(coalesce(length(task.gold_answer), 0) / 4.0 * 2)))) AS INTEGER) AS budget FROM tasks
""")
def task_intents(spark: SparkSession, folder: str) -> DataFrame:
    i = K.intents(F.col("task.query"))
    budget = K.answer_budget(F.col("task.task_type"), F.coalesce(F.length("task.gold_answer"), F.lit(0)) / 4)
    return _tasks(spark, folder).select("row_id", "task_idx", i["count"].alias("counts"), i["temporal"].alias("times"), i["status"].alias("states"), budget.alias("budget"))


@query("""
WITH f AS (SELECT lpad(CAST(row_number() OVER (ORDER BY md5('1:' || event_id), event_id) AS VARCHAR), 6, '0') AS id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT unnest(['missing', 'repeated', 'malformed', 'gap', 'date']) AS "check", CAST(unnest([count(*) FILTER (event_type IS NULL OR trim(event_type) = ''), count(id) - count(DISTINCT id), count(*) FILTER (NOT regexp_full_match(id, '\\d{6,}')), max(CAST(id AS BIGINT)) - count(DISTINCT id), count(*) FILTER (NOT regexp_full_match(day, '\\d{4}-\\d{2}-\\d{2}'))]) AS BIGINT) AS n FROM f
""")
def fact_contract(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return C.fact_contract(dense_ids(e, hash_order(1, F.col("event_id")), "event_id", name="id"), "id", ["event_type"], "day")


@query("""
WITH a AS (SELECT DISTINCT character AS c, 1 AS i FROM dialogue_records), b AS (SELECT DISTINCT character_name AS c, 1 AS i FROM story_events)
SELECT coalesce(a.c, b.c) AS character, CASE WHEN a.i IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL OUTER JOIN b ON a.c IS NOT DISTINCT FROM b.c WHERE a.i IS NULL OR b.i IS NULL
""")
def character_difference(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "dialogue_records").select("character")
    b = table(spark, folder, "story_events").select(F.col("character_name").alias("character"))
    return C.set_difference(a, b, "character")


@query("""
SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'none') AS segment FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey
""")
def lookup_with_default(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return C.with_default(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "segment", "none").select("o_orderkey", "segment")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'stored' ELSE md5(CAST(o_custkey AS VARCHAR)) END AS value FROM orders
""")
def memo_lookup(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    stored = o.where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("key"), F.lit("stored").alias("value")).distinct()
    rows, _ = C.memo(o, stored, F.col("o_custkey").cast("string"), "value", F.md5(F.col("o_custkey").cast("string")))
    return rows.select("o_orderkey", "value")


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('6:' || c_custkey), c_custkey) AS rn FROM customer) SELECT c_custkey FROM r WHERE rn > 10 AND rn <= 60")
def item_subset(spark: SparkSession, folder: str) -> DataFrame:
    return C.subset(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 50, 10, 6)


@query(f"""
WITH {TASKS}, n AS (SELECT DISTINCT character, unnest(task.source_event_ids) AS event_id FROM tasks)
SELECT e.character_name, e.event_id, count(*) AS n FROM story_events e WHERE EXISTS (SELECT 1 FROM n WHERE n.character = e.character_name AND n.event_id = e.event_id) GROUP BY ALL
""")
def mission_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dialogue_records")
    tasks = D.task_rows(rows, "row_id").join(rows.select("row_id", F.col("character").alias("character_name")), "row_id").select("character_name", F.col("task.source_event_ids").alias("event_ids"))
    return C.mission_events(tasks, table(spark, folder, "story_events"), "character_name").groupBy("character_name", "event_id").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS calls, count(*) FILTER (length(record.reference) > 0) AS answered, CAST(sum(ceil(length(record.prompt) / 4)) AS BIGINT) AS tokens_in, CAST(sum(ceil(length(record.reference) / 4)) AS BIGINT) AS tokens_out FROM parametric_eval_records
""")
def usage_panel(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "parametric_eval_records").select(F.col("record.prompt").alias("prompt"), F.col("record.reference").alias("answer"))
    return C.usage_panel(r, "prompt", "answer")


@query()
def audit_self_check(spark: SparkSession, folder: str) -> DataFrame:
    """Injected and redacted dialogues through the audit; held against what must come out in the tests."""
    d = table(spark, folder, "dialogue_records")
    said = d.select("row_id", D.render(F.col("dialogue")).alias("said"))
    return C.self_check(said, U.component_rows(d, "row_id"), "row_id")


@query("""
WITH o AS (SELECT user_id, row_number() OVER (ORDER BY md5('4:' || user_id), user_id) AS ow FROM (SELECT DISTINCT user_id FROM events)),
k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY md5('4:' || user_id || ':' || event_type), event_type) AS kd FROM (SELECT DISTINCT user_id, event_type FROM events)),
f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS fa FROM events),
l(level, a, b, c) AS (VALUES (1, 5, 2, 3), (2, 10, 3, 5), (3, 20, 5, 8))
SELECT level, user_id, event_type, count(*) AS facts FROM f JOIN o USING (user_id) JOIN k USING (user_id, event_type), l WHERE ow <= a AND kd <= b AND fa <= c GROUP BY ALL
""", ints="level")
def prompt_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return C.ladder(table(spark, folder, "events"), "user_id", "event_type", [(5, 2, 3), (10, 3, 5), (20, 5, 8)], 4, "ts", "event_id")


@query()
def component_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Hard slots of each component against its dialogue; dates come in many forms, see the tests."""
    d = table(spark, folder, "dialogue_records")
    parts = U.component_rows(d, "row_id")
    specs = parts.select("row_id", "task_idx", "comp_idx", S.fallback_spec(F.col("task_type"), F.col("query"), F.col("component")).alias("spec"))
    said = d.select("row_id", D.render(F.col("dialogue")).alias("said"))
    return S.slot_verdicts(specs, said, "row_id").select("row_id", "task_idx", "comp_idx", F.array_join("missing", ",").alias("missing"), "status")


@query("""
WITH v AS (SELECT user_id, list(CASE WHEN value > 20 THEN TRUE WHEN value > 5 THEN FALSE END) AS votes FROM events GROUP BY user_id) SELECT user_id, len(list_filter(votes, lambda x: coalesce(x, FALSE))) >= 10 AS passed FROM v
""")
def patch_votes(spark: SparkSession, folder: str) -> DataFrame:
    vote = F.when(F.col("value") > 20, True).when(F.col("value") > 5, False)
    # collect_list leaves out nulls, which don't count anyway.
    return table(spark, folder, "events").groupBy("user_id").agg(F.collect_list(vote).alias("v")).select("user_id", S.enough_votes(F.col("v"), 10).alias("passed"))


@query("""
WITH b AS (SELECT l_orderkey % 500 AS d, l_orderkey AS t, l_linenumber AS c, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn, l_tax, l_discount FROM lineitem),
s AS (SELECT d, t, c, CASE WHEN l_tax > 0.02 THEN 'PRESENT' ELSE 'MISSING' END AS was, CASE WHEN l_discount > 0.01 THEN 'PRESENT' ELSE 'MISSING' END AS now FROM b WHERE rn = 1),
w AS (SELECT d, t, count(*) AS n FROM s WHERE was = 'PRESENT' AND now <> 'PRESENT' GROUP BY ALL)
SELECT s.d, s.t, s.c, now = 'PRESENT' AND coalesce(w.n, 0) = 0 AS passed, coalesce(w.n, 0) AS regressed FROM s LEFT JOIN w ON w.d = s.d AND w.t = s.t WHERE s.was = 'MISSING'
""")
def repair_gate(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 500).alias("d"), F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("c"), "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("t", "c").orderBy("l_partkey", "l_suppkey", "l_quantity"))).where("rn = 1")
    before = first.select("d", "t", "c", F.when(F.col("l_tax") > 0.02, "PRESENT").otherwise("MISSING").alias("status"))
    after = first.select("d", "t", "c", F.when(F.col("l_discount") > 0.01, "PRESENT").otherwise("MISSING").alias("status"))
    return S.gate(before, after, before.where("status = 'MISSING'"), ["d", "t", "c"])


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'bad_request' WHEN o_custkey % 7 IN (1, 2) THEN 'fatal' WHEN o_custkey % 7 IN (3, 4) THEN 'transient' WHEN o_orderpriority = '5-LOW' THEN 'transient' ELSE 'unknown' END AS kind FROM orders
""")
def retry_classes(spark: SparkSession, folder: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (400, 401, 422, 429, 503, 200, 200)]), (F.col("o_custkey") % 7 + 1).cast("int"))
    said = F.when(F.col("o_orderpriority") == "5-LOW", "Connection reset")
    return table(spark, folder, "orders").select("o_orderkey", K.retry_class(status, said).alias("kind"))


@query("""
SELECT character_name, event_id, array_to_string([substr(event_id, 1, 4), coalesce(strftime(CAST(try_strptime(regexp_replace(regexp_extract(coalesce(timestamp, ''), '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})'), '[/.]', '-', 'g'), '%Y-%m-%d') AS DATE), '%Y-%m-%d'), '')], '|') AS marks, count(*) AS n FROM story_events WHERE event_id IS NOT NULL GROUP BY ALL
""")
def event_marks(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "story_events").where("event_id IS NOT NULL")
    marks = F.concat_ws("|", F.substring("event_id", 1, 4), normalize_date(F.col("timestamp")))
    return e.groupBy("character_name", "event_id", marks.alias("marks")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(stage AS INTEGER) AS stage, step, CASE WHEN step = 'tune' THEN 'stage_' || lpad(CAST(stage AS VARCHAR), 2, '0') || '_pretrain' WHEN stage > 1 THEN 'stage_' || lpad(CAST(stage - 1 AS VARCHAR), 2, '0') || '_tune' ELSE 'base' END AS start_from, 'stage_' || lpad(CAST(stage AS VARCHAR), 2, '0') || '_' || step AS gives
FROM (SELECT unnest(generate_series(1, 10)) AS stage), (SELECT unnest(['pretrain', 'tune']) AS step)
""")
def training_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return R.training_jobs(spark.range(1, 11).select(F.col("id").cast("int").alias("stage")), "base")


@query("""
WITH e AS (SELECT character_name, event_id, row_number() OVER (PARTITION BY character_name ORDER BY event_id) AS pos FROM (SELECT DISTINCT character_name, event_id FROM story_events WHERE event_id IS NOT NULL)),
w AS (SELECT DISTINCT record.metadata.character AS character_name, unnest(record.metadata.source_event_ids) AS event_id FROM parametric_eval_records),
k AS (SELECT e.* FROM e JOIN w ON w.character_name = e.character_name AND w.event_id = e.event_id)
SELECT character_name, event_id FROM k UNION ALL SELECT character_name, event_id FROM e WHERE pos <= 12 AND NOT EXISTS (SELECT 1 FROM k WHERE k.character_name IS NOT DISTINCT FROM e.character_name)
""")
def candidate_events(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, folder, "story_events").where("event_id IS NOT NULL").select("character_name", "event_id").distinct()
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("character_name").orderBy("event_id")))
    m = table(spark, folder, "parametric_eval_records").select(F.col("record.metadata.character").alias("character_name"), F.explode("record.metadata.source_event_ids").alias("event_id"))
    return E.candidate_events(m, e)


@query("""
WITH l AS (SELECT index, list_filter(list_transform(string_split(upper(coalesce(mbti, '')), ''), lambda c: CASE c WHEN 'E' THEN 'talks freely' WHEN 'I' THEN 'chooses words with care' WHEN 'S' THEN 'names plain facts' WHEN 'N' THEN 'likes images' WHEN 'T' THEN 'argues' WHEN 'F' THEN 'speaks of feelings' WHEN 'J' THEN 'keeps to the point' WHEN 'P' THEN 'wanders' END), lambda x: x IS NOT NULL) AS s, TRY_CAST(nullif(regexp_extract(coalesce(profile.age, ''), '([0-9]{1,3})', 1), '') AS INTEGER) AS y FROM seed_bank)
SELECT index, array_to_string(list_concat(s, CASE WHEN y < 25 THEN ['uses slang'] WHEN y >= 60 THEN ['recalls old days'] ELSE [] END), ', ') AS style FROM l
""")
def speech_styles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seed_bank").select("index", text.speech_style(F.col("mbti"), F.col("profile.age")).alias("style"))


def _values_sql() -> str:
    by_kind = " ".join(f"WHEN '{k}' THEN [{', '.join(f"""trim(regexp_extract(raw, '{p}', 1))""" for p in ps)}]" for k, ps in text.VALUE_PATTERNS.items())
    kind = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{k}'" for k, p in text.QUESTION_KINDS) + " END"
    after = f"CASE WHEN contains(raw, ':') AND len(list_filter(string_split(split_part(raw, ':', 1), ' '), lambda w: w <> '')) <= {text.WORDS_BEFORE_COLON} THEN trim(raw[instr(raw, ':') + 1:]) END"
    return f"""
WITH {TASKS}, n AS (SELECT row_id, task_idx, {NORMAL.format("task.gold_answer")} AS raw, {NORMAL.format("task.query")} AS q FROM tasks), k AS (SELECT *, {kind} AS kind FROM n),
v AS (SELECT row_id, task_idx, list_filter(list_concat([CASE WHEN kind IS NULL THEN raw END, {after}], CASE kind {by_kind} ELSE [] END), lambda x: x IS NOT NULL AND x <> '') AS v FROM k)
SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, array_to_string(list_sort(list_distinct(v)), '|') AS found FROM v"""


@query(_values_sql())
def answer_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """What each answer offers as the value asked for."""
    t = F.col("task")
    found = text.value_candidates(t["gold_answer"], text.question_kind(t["query"]))
    return _tasks(spark, folder).select("row_id", "task_idx", F.array_join(F.array_sort(found), "|").alias("found"))
