"""Queries of the text, date, set and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import dates, fuzzy, jsons, text
from palimpsest.operators import dialogue as D
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import NORMAL, TASKS, focus, words


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return D.task_rows(table(spark, folder, "dialogue_records"), "row_id")


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("""
SELECT doc_id, CAST(greatest(1, ceil(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) / 4)) AS INTEGER) AS by_four, CAST(floor(length(coalesce(text, '')) / 4) AS INTEGER) AS floored,
  CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 3.5, 0)) END AS INTEGER) AS by_ratio FROM documents
""")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", text.tokens_by_four(t).alias("by_four"), text.tokens_floor(t).alias("floored"), text.tokens_by_ratio(t, 3.5).alias("by_ratio"))


@query(f"SELECT doc_id, array_to_string(list_sort({focus('text')}), ' ') AS tokens FROM documents")
def focus_token_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.array_join(F.array_sort(text.focus_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""
WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents), g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3))
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS documents FROM g GROUP BY gram HAVING count(*) >= 20
""")
def frequent_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    w = _docs(spark, folder).select("doc_id", text.words(F.col("text")).alias("w"))  # made once, used several times
    grams = w.select("doc_id", F.explode(text.grams(F.col("w"), 3)).alias("gram"))
    by = grams.groupBy("gram", "doc_id").agg(F.count("*").alias("m"))
    return by.groupBy("gram").agg(F.sum("m").alias("n"), F.count("*").alias("documents")).where("n >= 20")


@query(f"""
WITH {TASKS}, w AS (SELECT row_id, task_idx, list_filter({words('task.gold_answer')}, lambda x: length(x) > 3) AS w FROM tasks),
g AS (SELECT row_id, task_idx, w, list_concat(
  list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM w)
SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, array_to_string(list_sort(list_distinct(list_concat(w, list_filter(g, lambda x: length(x) > 8)))), '|') AS phrases FROM g
""")
def answer_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select("row_id", "task_idx", F.array_join(F.array_sort(text.key_phrases(F.col("task.gold_answer"))), "|").alias("phrases"))


@query(f"WITH {TASKS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(task.gold_answer, ''), '([A-Z][a-z]+(?: [A-Z][a-z]+){{0,2}})', 1))), '|') AS names FROM tasks")
def answer_entities(spark: SparkSession, folder: str) -> DataFrame:
    found = text.entities(F.coalesce(F.col("task.gold_answer"), F.lit("")), None)
    return _tasks(spark, folder).select("row_id", "task_idx", F.array_join(F.array_sort(found), "|").alias("names"))


@query("""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\d{4}-\\d{2}-\\d{2})', 1)) AS day FROM documents) SELECT doc_id, day, count(*) AS n FROM d GROUP BY ALL
""")
def iso_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.explode(dates.iso_dates(F.col("text"))).alias("day")).groupBy("doc_id", "day").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\b((?:19|20|21)\\d{2})\\b', 1), lambda x: CAST(x AS INTEGER)))), ',') AS years FROM documents
""")
def document_years(spark: SparkSession, folder: str) -> DataFrame:
    found = text.years(F.coalesce(F.col("text"), F.lit("")))
    return _docs(spark, folder).select("doc_id", F.array_join(F.transform(found, lambda y: y.cast("string")), ",").alias("years"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{k}'" for k, p in text.QUESTION_KINDS) + " END"


@query(f"""WITH {TASKS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, {_KIND} AS kind, CASE WHEN regexp_matches(q, '{text.TWO_SLOTS}') THEN 2 ELSE 1 END AS slots FROM (SELECT *, {NORMAL.format('task.query')} AS q FROM tasks)""")
def question_kinds(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("task.query")
    return _tasks(spark, folder).select("row_id", "task_idx", text.question_kind(q).alias("kind"), text.slot_count(q).alias("slots"))


@query(f"WITH {TASKS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, TRY_CAST(nullif(regexp_extract(regexp_replace(task.gold_answer, '\\d{{4}}-\\d{{2}}-\\d{{2}}', ' ', 'g'), '(\\d{{1,9}})', 1), '') AS INTEGER) AS days FROM tasks")
def answer_day_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select("row_id", "task_idx", dates.day_count(F.col("task.gold_answer")).alias("days"))


@query("""
WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, text FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 57) || '...' END AS preview, substr(t, 1, 40) AS excerpt, regexp_replace(substr(t, 1, 40), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM x
""")
def previews(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", text.preview(t, 60).alias("preview"), text.excerpt(t, 40).alias("excerpt"), text.safe_name(text.excerpt(t, 40)).alias("name"))


@query("""
WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\([^()]*\\)|\\[[^\\[\\]]*\\]|（[^（）]*）|【[^【】]*】', ' ', 'g'), '\\*[^*]+\\*', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS digest FROM x
""")
def spoken_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.md5(text.clean_spoken(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CAST(p_retailprice AS VARCHAR), '[$€£,\\s]', '', 'g'), '^0+([0-9])', '\\1'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS plain FROM part")
def plain_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.numeric_token(F.col("p_retailprice").cast("string")).alias("plain"))


@query()
def numbers_in_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the answers without dates; its expressions look behind, which DuckDB's can't."""
    found = text.numbers_without_dates(F.coalesce(F.col("task.gold_answer"), F.lit("")))
    return _tasks(spark, folder).select("row_id", "task_idx", F.array_join(found, ",").alias("numbers"))


@query()
def date_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The ways in which each event's day may be written."""
    day = dates.normalize_date(F.col("timestamp"))
    return table(spark, folder, "story_events").select("character_name", "event_id", F.array_join(dates.date_variants(day), "|").alias("forms")).where("forms <> ''")


@query()
def answer_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Partial similarity of answers with their questions, and the components they have."""
    t = F.col("task")
    return _tasks(spark, folder).select("row_id", "task_idx", fuzzy.fuzzy_ratio(t["gold_answer"], t["query"]).alias("ratio"), fuzzy.component_recall(t["gold_answer"], t["answer_components"]).alias("recall"))


@query()
def strict_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Which references are JSON throughout, which hold an object, which fields they lack."""
    r = table(spark, folder, "parametric_eval_records").select("row_id", F.col("record.reference").alias("t"), F.col("record.metadata.task_type").alias("k"))
    return r.select("row_id", jsons.strict_json("t")["reason"].alias("strict"), jsons.object_json("t")["reason"].alias("found"), F.size(jsons.fields_check("t", "k")["missing"]).alias("missing"))


@query("SELECT row_id, CASE WHEN upper(regexp_extract(coalesce(record.reference, ''), '^[^A-Za-z]*([A-Za-z]+)', 1)) = 'YES' THEN TRUE WHEN upper(regexp_extract(coalesce(record.reference, ''), '^[^A-Za-z0-9_]*(\\pL+)', 1)) = 'NO' THEN FALSE END AS said FROM parametric_eval_records")
def yes_no_answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parametric_eval_records").select("row_id", jsons.yes_or_no(F.col("record.reference")).alias("said"))


@query()
def recovered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues written as JSON, one in three cut off, and how their turns come back."""
    written = F.to_json(F.transform(D.spoken(F.col("dialogue")), lambda t: F.struct(D.or_missing_role(t).alias("role"), D.or_missing_content(t).alias("content"))))
    broken = F.when(F.col("row_id") % 3 == 0, F.substring(written, F.lit(1), F.length(written) - 7)).otherwise(written)
    found = table(spark, folder, "dialogue_records").select("row_id", jsons.turns_json(broken).alias("x"))
    return found.select("row_id", F.size("x.turns").alias("n"), "x.how")


@query(f"WITH {TASKS} SELECT count(DISTINCT (task.task_type, task.query)) AS keys FROM tasks WHERE task.task_type IS NOT NULL AND task.query IS NOT NULL")
def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = _tasks(spark, folder).where("task.task_type IS NOT NULL AND task.query IS NOT NULL")
    return t.select(jsons.content_key(F.col("task.task_type"), F.col("task.query")).alias("k")).distinct().agg(F.count("*").alias("keys"))
