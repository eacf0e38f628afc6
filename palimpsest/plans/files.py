"""Queries that write whole tables in the formats of benchmark data and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.lineage import new_folder
from palimpsest.sources import readers, writers
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import RESULTS

_PROFILE = "name, gender, age, region, tone, job"


@query(f"SELECT index, mbti, {', '.join(f'profile.{c} AS {c}' for c in _PROFILE.split(', '))} FROM seed_bank")
def files_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Personas as a JSON object a line."""
    place = new_folder(spark, "lines")
    writers.jsonl(table(spark, folder, "seed_bank"), place)
    rows = readers.records(spark, place, table(spark, folder, "seed_bank").schema)
    return rows.select("index", "mbti", *[f"profile.{c}" for c in _PROFILE.split(", ")])


@query("SELECT row_id, split_name, source_file, record.id AS id, record.prompt AS prompt, record.reference AS reference, record.metadata.task_type AS task_type, coalesce(len(record.metadata.source_event_ids), -1) AS events FROM parametric_eval_records", ints="events")
def files_json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records as JSON arrays, told from lines by their first character."""
    place = new_folder(spark, "arrays")
    records = table(spark, folder, "parametric_eval_records").select("row_id", "split_name", "source_file", "record")
    writers.json_arrays(records, place, 16)
    rows = readers.records(spark, place, records.schema)
    m = F.col("record.metadata")
    return rows.select("row_id", "split_name", "source_file", "record.id", "record.prompt", "record.reference", m["task_type"].alias("task_type"), F.coalesce(F.nullif(F.size(m["source_event_ids"]), F.lit(-1)), F.lit(-1)).alias("events"))


@query("SELECT character_name, year, event_id, time_of_year, category, description, timestamp FROM story_events WHERE character_name IS NOT NULL")
def files_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Life stories, one for each character with its years and their events, as JSON lines; events in no order."""
    place = new_folder(spark, "stories")
    fields = ["event_id", "time_of_year", "category", "description", "psychological_note", "caused_by_event_ids", "timestamp"]
    events = table(spark, folder, "story_events").where("character_name IS NOT NULL")
    # A story holds its character's years, a year its events; a long life is written in several parts.
    years = events.groupBy("character_name", "year", F.expr("pmod(xxhash64(event_id, loaded_at), 8L)").alias("part")).agg(F.collect_list(F.struct(*fields)).alias("events"))
    stories = years.groupBy("character_name", "part").agg(F.collect_list(F.struct("year", F.lit(None).cast("string").alias("narrative_summary"), "events")).alias("chronology"))
    writers.jsonl(stories.drop("part"), place)
    return readers.story_events(readers.records(spark, place, readers.STORY)).select("character_name", "year", "event_id", "time_of_year", "category", "description", "timestamp")


_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""
WITH f AS (SELECT character_name AS character, {_SQUEEZED.format("description")} AS fact, {_SQUEEZED.format("event_id")} AS fact_id, {_SQUEEZED.format("timestamp")} AS timestamp FROM story_events WHERE character_name IS NOT NULL)
SELECT character, fact, fact_id, timestamp FROM f WHERE length(fact) > 0 AND length(fact_id) > 0 AND regexp_matches(timestamp, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')
""")
def files_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as objects of lists, one for each character; those without text, id or date are left out."""
    place = new_folder(spark, "facts")
    none = F.lit(None).cast("string")
    fact = F.struct(F.col("description").alias("fact"), F.col("event_id").alias("fact_id"), "timestamp", none.alias("state_repr"), none.alias("schema"))
    events = table(spark, folder, "story_events").where("character_name IS NOT NULL")
    lists = events.groupBy("character_name", F.expr("pmod(xxhash64(event_id, loaded_at), 8L)").alias("part")).agg(F.collect_list(fact).alias("facts"))
    lists.select(F.to_json(F.create_map("character_name", "facts")).alias("value")).write.option("maxRecordsPerFile", 1).text(place)
    return readers.facts(spark, place, strict=False).select("character", "fact", "fact_id", "timestamp")


@query(f"WITH {RESULTS} SELECT model, task, checkpoint, stage, CAST(printf('%.4f', score) AS DOUBLE) AS score FROM cells")
def files_scores_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores as a CSV with fixed decimals."""
    place = new_folder(spark, "csv")
    o = table(spark, folder, "orders")
    score = (F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 100) * 100) / 97
    rows = o.select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("task"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("checkpoint"), (F.col("o_custkey") % 10 + 1).cast("int").alias("stage"), score.alias("score"))
    cells = rows.groupBy("model", "task", "checkpoint", "stage").agg(F.avg("score").alias("score"))
    writers.csv(cells, place, digits=4)
    return readers.csv(spark, place, "model string, task string, checkpoint int, stage int, score double")


@query(f"WITH {RESULTS} SELECT checkpoint, stage, count(*) AS n FROM results WHERE checkpoint IS NOT NULL AND stage IS NOT NULL GROUP BY ALL")
def files_score_tree(spark: SparkSession, folder: str) -> DataFrame:
    """One score file for each checkpoint and stage in a tree of folders, found by the folders' names."""
    place = new_folder(spark, "tree")
    o = table(spark, folder, "orders")
    counts = o.groupBy((F.col("o_orderkey") % 10 + 1).alias("c"), (F.col("o_custkey") % 10 + 1).alias("s")).agg(F.count("*").alias("n"))
    for r in counts.where("c IS NOT NULL AND s IS NOT NULL").collect():  # at most 100
        writers.whole_file(spark, f'{{"aggregate": {{"n": {r["n"]}}}}}', f"{place}/checkpoint_stage_{r['c']:02}/stage_{r['s']:02}_seen/scores.json")
    found = readers.score_files(spark, place, "seen")
    return found.select("checkpoint", "stage", F.get_json_object("doc", "$.aggregate.n").cast("long").alias("n"))


@query("SELECT count(DISTINCT c_nationkey) AS first, count(DISTINCT c_custkey) AS rows, 0 AS again FROM customer", ints="again")
def files_append(spark: SparkSession, folder: str) -> DataFrame:
    """Rows appended by key: the first of each nation, then all others, then none again."""
    place = new_folder(spark, "append")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    firsts = customers.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey", "c_nationkey")
    first = writers.append_new(firsts, place, "c_custkey")
    writers.append_new(customers, place, "c_custkey")
    again = writers.append_new(customers, place, "c_custkey")
    return spark.read.parquet(place).agg(F.lit(first).cast("long").alias("first"), F.count("*").alias("rows"), F.lit(again).alias("again"))


@query("SELECT count(DISTINCT o_custkey) AS total, count(DISTINCT c_custkey) AS completed, count(DISTINCT o_custkey) - count(DISTINCT c_custkey) AS pending, count(DISTINCT o_custkey) = count(DISTINCT c_custkey) AS done FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey")
def files_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys of a run are done."""
    done = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return writers.progress(table(spark, folder, "orders"), done, "o_custkey")


@query("SELECT r_regionkey, r_name, 0 AS missing FROM region", ints="missing")
def files_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A small catalog as a JSON array, and a file that isn't there."""
    place = new_folder(spark, "catalog")
    regions = table(spark, folder, "region").select("r_regionkey", "r_name")
    writers.json_arrays(regions, place, 1)
    missing = readers.optional_records(spark, f"{place}-missing", regions.schema).count()
    return readers.catalog(spark, place, regions.schema).select("r_regionkey", "r_name", F.lit(missing).alias("missing"))


@query("""
WITH n AS (SELECT n_name, CAST(n_regionkey AS INTEGER) AS level, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS at FROM nation) SELECT level, count(*) AS files, min(n_name) AS first FROM n WHERE level BETWEEN 1 AND 3 GROUP BY level
""")
def files_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt files with a level in their names, those of some levels."""
    place = new_folder(spark, "levels")
    for r in table(spark, folder, "nation").select("n_name", "n_regionkey").where("n_name IS NOT NULL AND n_regionkey IS NOT NULL").collect():  # 25 nations
        writers.whole_file(spark, "[]", f"{place}/prompt_L{r['n_regionkey']}_{r['n_name'].replace(' ', '-')}.json")
    name = F.replace(F.regexp_extract("path", r"_L\d+_([^/]*)\.json$", 1), F.lit("-"), F.lit(" "))
    return readers.level_files(spark, place, 1, 3).groupBy("level").agg(F.count("*").alias("files"), F.min(name).alias("first"))


@query(f"WITH {RESULTS}, m AS (SELECT model, checkpoint, stage, avg(score) AS score FROM cells GROUP BY ALL) SELECT panel, model, n FROM (SELECT 'by_model' AS panel, model, count(*) AS n FROM m GROUP BY model UNION ALL SELECT 'all', NULL, count(*) FROM m)")
def files_long_form(spark: SparkSession, folder: str) -> DataFrame:
    """Several panels as one table."""
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("model"), (F.col("o_orderkey") % 10).alias("checkpoint"), (F.col("o_custkey") % 10).alias("stage"))
    cells = o.distinct()
    return writers.long_form({"by_model": cells.groupBy("model").agg(F.count("*").alias("n")), "all": cells.agg(F.count("*").alias("n"))}).select("panel", "model", "n")
