"""Queries over life stories: chronology rules and causal chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates
from palimpsest.functions.dates import MONTH_WORDS
from palimpsest.operators import dialogue as D
from palimpsest.operators import events as E
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import TASKS

_MONTH = "CASE " + " ".join(f"WHEN contains(lower(coalesce(time_of_year, '')), '{n}') THEN {m}" for n, m in MONTH_WORDS) + " ELSE 0 END"
_YEAR = "CASE WHEN regexp_full_match(trim(year), '[+-]?\\d{1,9}') THEN CAST(trim(year) AS INTEGER) END"
_ONCE = """first_export AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY character_name, event_id ORDER BY loaded_at NULLS LAST, description NULLS FIRST, timestamp NULLS FIRST) AS rn FROM story_events) WHERE rn = 1)"""
_EDGES = "edges AS (SELECT character_name, event_id AS effect, caused_by_event_ids[i] AS cause FROM (SELECT *, unnest(generate_series(1, len(caused_by_event_ids))) AS i FROM first_export) WHERE caused_by_event_ids[i] IS NOT NULL)"
_BLANK = "(coalesce(length(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), 0) = 0)"
_TIMED = "(" + " OR ".join(f"contains(lower(coalesce(time_of_year, '')), '{w}')" for w in E.TIME_WORDS) + ")"
_DIGITS = "CASE WHEN regexp_full_match(trim(year), '\\d{1,9}') THEN CAST(trim(year) AS INTEGER) END"
_OWN = "TRY_CAST(nullif(regexp_extract(event_id, '^(\\d{1,9})_', 1), '') AS INTEGER)"
_FIELD = "CASE WHEN {0} IS NULL THEN 'Missing required field: {0}' WHEN " + _BLANK + " THEN 'Required field is an empty string: {0}' END"

_ISSUES = f"""
event_issues AS (
  SELECT character_name, event_id, list_filter([
    CASE WHEN year IS NULL THEN 'Year is empty' WHEN {_DIGITS} IS NULL THEN 'Year contains non-numeric characters: ' || chr(39) || year || chr(39) WHEN NOT {_DIGITS} BETWEEN 1900 AND 2100 THEN 'Year is outside the expected range: ' || {_DIGITS} END,
    CASE WHEN coalesce(event_id, '') = '' THEN 'Event ID is empty' WHEN NOT regexp_full_match(event_id, '\\d{{4}}_E\\d+') THEN 'Malformed event ID: ' || event_id || ' (expected format: YYYY_EX)' END,
    CASE WHEN {_OWN} <> coalesce({_DIGITS}, CASE WHEN coalesce(year, '') = '' THEN 0 END) THEN 'Event ID year (' || {_OWN} || ') does not match parent year (' || coalesce({_DIGITS}, 0) || ')' END,
    CASE WHEN coalesce(time_of_year, '') = '' THEN 'time_of_year is empty' WHEN NOT {_TIMED} THEN 'time_of_year is not recognized: ' || chr(39) || time_of_year || chr(39) END,
    {_FIELD.format("event_id")}, {_FIELD.format("category")}, {_FIELD.format("description")}], lambda x: x IS NOT NULL) AS issues
  FROM first_export
), causality AS (
  SELECT e.character_name, e.effect AS event_id, e.cause,
    CASE WHEN e.cause = e.effect THEN 'self' WHEN c.event_id IS NULL THEN 'dangling' WHEN c.y > f.y OR (c.y = f.y AND c.m > f.m) THEN 'inversion' END AS issue
  FROM edges e JOIN (SELECT character_name, event_id, {_YEAR} AS y, {_MONTH} AS m FROM first_export) f ON f.character_name = e.character_name AND f.event_id = e.effect
  LEFT JOIN (SELECT character_name, event_id, {_YEAR} AS y, {_MONTH} AS m FROM first_export) c ON c.character_name = e.character_name AND c.event_id = e.cause
)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return E.once(table(spark, folder, "story_events"))


@query(f"WITH {_ONCE}, {_EDGES}, {_ISSUES} SELECT character_name, event_id, array_to_string(issues, '; ') AS issues FROM event_issues WHERE len(issues) > 0")
def validation_issues(spark: SparkSession, folder: str) -> DataFrame:
    return E.event_issues(_events(spark, folder)).withColumn("issues", F.array_join("issues", "; "))


@query(f"WITH {_ONCE}, {_EDGES}, {_ISSUES} SELECT character_name, event_id, cause, issue FROM causality WHERE issue IS NOT NULL")
def causality_issues(spark: SparkSession, folder: str) -> DataFrame:
    return E.causality_issues(_events(spark, folder))


@query(f"WITH {_ONCE}, {_EDGES}, {_ISSUES}, m AS (SELECT unnest(issues) AS m FROM event_issues), a AS (SELECT CASE WHEN regexp_matches(m, 'Causality|Reference|caused_by_event_ids') THEN 'Causality issues' WHEN contains(m, 'ID') THEN 'Event ID issues' WHEN regexp_matches(m, 'Year|year') THEN 'Year format issues' WHEN regexp_matches(m, 'Missing|empty') THEN 'Missing field issues' ELSE 'Other issues' END AS issue FROM m WHERE NOT starts_with(m, 'time_of_year ') UNION ALL SELECT 'Causality issues' FROM causality WHERE issue IS NOT NULL) SELECT issue, count(*) AS n FROM a GROUP BY issue")
def issue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.issue_summary(_events(spark, folder))


@query(f"""
WITH RECURSIVE {_ONCE}, {_EDGES},
ids AS (SELECT character_name, event_id, row_number() OVER (PARTITION BY character_name ORDER BY event_id) AS pos FROM first_export WHERE event_id IS NOT NULL),
steps AS (SELECT DISTINCT e.character_name, e.cause, e.effect, a.pos AS cp, b.pos AS ep FROM edges e JOIN ids a ON a.character_name = e.character_name AND a.event_id = e.cause JOIN ids b ON b.character_name = e.character_name AND b.event_id = e.effect WHERE e.cause <> e.effect),
paths(character_name, path, spots) AS (
  SELECT character_name, [cause, effect], [cp, ep] FROM steps
  UNION ALL SELECT p.character_name, list_append(p.path, s.effect), list_append(p.spots, s.ep) FROM paths p JOIN steps s ON s.character_name = p.character_name AND s.cause = p.path[-1] WHERE len(p.path) < 5 AND NOT list_contains(p.path, s.effect)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY character_name ORDER BY len(path) DESC, spots) AS rank FROM paths WHERE len(path) >= 3)
SELECT character_name, CAST(rank AS INTEGER) AS rank, array_to_string(path, '>') AS path FROM ranked WHERE rank <= 5
""")
def causal_chains(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    placed = events.where("event_id IS NOT NULL").withColumn("pos", F.row_number().over(Window.partitionBy("character_name").orderBy("event_id")))
    return E.causal_chains(placed).withColumn("path", F.array_join("path", ">"))


@query(f"""
WITH {_ONCE}, e AS (SELECT character_name, event_id, i, caused_by_event_ids[i] AS cause FROM (SELECT *, unnest(generate_series(1, len(caused_by_event_ids))) AS i FROM first_export) WHERE caused_by_event_ids[i] IS NOT NULL),
f AS (SELECT e.character_name, e.event_id, count(*) AS n, string_agg(c.description, ' | ' ORDER BY i) AS t FROM e JOIN first_export c ON c.character_name = e.character_name AND c.event_id = e.cause GROUP BY ALL)
SELECT x.character_name, x.event_id, CAST(coalesce(f.n, 0) AS INTEGER) AS n, coalesce(f.t, '') AS causes FROM first_export x LEFT JOIN f ON f.character_name = x.character_name AND f.event_id = x.event_id
""")
def events_with_causes(spark: SparkSession, folder: str) -> DataFrame:
    return E.with_causes(_events(spark, folder)).select("character_name", "event_id", F.size("causes").alias("n"), F.array_join("causes", " | ").alias("causes"))


_DAY = "CAST(try_strptime(regexp_replace(regexp_extract(coalesce(timestamp, ''), '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})'), '[/.]', '-', 'g'), '%Y-%m-%d') AS DATE)"


@query(f"""
WITH {_ONCE}, {TASKS},
days AS (SELECT character_name, event_id, datediff('day', DATE '1970-01-01', {_DAY}) AS day FROM first_export),
ids AS (SELECT row_id, task_idx, character, unnest(task.source_event_ids) AS event_id FROM tasks),
found AS (SELECT i.row_id, i.task_idx, count(*) AS named, count(d.event_id) AS known, count(d.day) AS dated, max(d.day) - min(d.day) AS span FROM ids i LEFT JOIN days d ON d.character_name = i.character AND d.event_id = i.event_id GROUP BY ALL),
v AS (SELECT t.row_id, t.task_idx, t.task.task_type AS k, t.task.query AS q, t.task.gold_answer AS a, t.task.old_state_value IS NULL OR t.task.old_state_event_id IS NULL AS lost, coalesce(f.named, 0) AS named, coalesce(f.known, 0) AS known, coalesce(f.dated, 0) AS dated, f.span AS span,
  TRY_CAST(nullif(regexp_extract(lower(t.task.gold_answer), '(\\d+(\\.\\d+)?)\\s*years?', 1), '') AS DOUBLE) AS y, TRY_CAST(nullif(regexp_extract(lower(t.task.gold_answer), '(\\d+)\\s*days?', 1), '') AS DOUBLE) AS d
  FROM tasks t LEFT JOIN found f ON f.row_id = t.row_id AND f.task_idx = t.task_idx),
w AS (SELECT row_id, task_idx, CASE WHEN named = 0 THEN NULL WHEN {_BLANK.format("q")} OR {_BLANK.format("a")} THEN 'blank'
  WHEN k = 'Temporal Reasoning' AND (regexp_matches(q, '\\d{{4}}-\\d{{2}}') OR regexp_matches(q, 'January|February|March|April|May|June|July|August|September|October|November|December')) THEN 'leak' WHEN known < named THEN 'unknown event'
  WHEN k = 'Knowledge Updating' AND lost THEN 'no old state'
  WHEN k = 'Temporal Reasoning' AND dated >= 2 AND abs(y - span / 365.25) > 1 AND abs(y - span / 365.25) / (span / 365.25 + 0.1) > 0.1 THEN 'years off' WHEN k = 'Temporal Reasoning' AND dated >= 2 AND abs(d - span) > 5 THEN 'days off' END AS issue FROM v)
SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, issue FROM w WHERE issue IS NOT NULL
""")
def task_time_issues(spark: SparkSession, folder: str) -> DataFrame:
    days = _events(spark, folder).select(F.col("character_name").alias("character"), "event_id", dates.day_number(F.col("timestamp")).alias("day"), F.lit(True).alias("known"))
    rows = table(spark, folder, "dialogue_records")
    tasks = D.task_rows(rows, "row_id").join(rows.select("row_id", "character"), "row_id")
    ids = tasks.select("row_id", "task_idx", "character", F.explode("task.source_event_ids").alias("event_id"))
    found = ids.join(days, ["character", "event_id"], "left").groupBy("row_id", "task_idx").agg(F.count("*").alias("named"), F.count("known").alias("known"), F.count("day").alias("dated"), (F.max("day") - F.min("day")).alias("span"))
    both = tasks.join(found, ["row_id", "task_idx"], "left")
    issue = E.task_time_issue(F.col("task"), F.coalesce("known", F.lit(0)), F.coalesce("named", F.lit(0)), F.coalesce("dated", F.lit(0)), F.col("span"))
    return both.select("row_id", "task_idx", issue.alias("issue")).where("issue IS NOT NULL")


@query(f"WITH {_ONCE} SELECT character_name, event_id, coalesce(strftime({_DAY}, '%Y-%m-%d'), '') AS day, {_MONTH} AS month FROM first_export")
def event_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("character_name", "event_id", dates.normalize_date(F.col("timestamp")).alias("day"), dates.month_of(F.col("time_of_year")).alias("month"))
