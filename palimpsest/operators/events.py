"""Life stories: causes, chains and the rules for a chronology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import MONTHS, month_of
from palimpsest.functions.text import strip
from palimpsest.lineage import cut
from palimpsest.operators.rank import top_per_group

EVENT_ID = r"^\d{4}_E\d+$"
# What a time of year must speak of, the years allowed, and the groups of issues with the words that tell them, the first that fits.
TIME_WORDS = [*MONTHS, "winter", "spring", "summer", "fall", "autumn", "early", "mid", "late"]
FIRST_YEAR, LAST_YEAR = 1900, 2100
ISSUE_GROUPS = [("Causality issues", "Causality|Reference|caused_by_event_ids"), ("Event ID issues", "ID"), ("Year format issues", "Year|year"), ("Missing field issues", "Missing|empty")]


def once(events: DataFrame) -> DataFrame:
    """The first export of each (character_name, event_id), by loaded_at and then the texts."""
    w = Window.partitionBy("character_name", "event_id").orderBy(F.col("loaded_at").asc_nulls_last(), "description", "timestamp")
    return events.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def cause_edges(events: DataFrame) -> DataFrame:
    """(character_name, cause, pos, effect): a row for each cause an event names; null and empty lists give none."""
    return events.select("character_name", F.col("event_id").alias("effect"), F.posexplode("caused_by_event_ids").alias("pos", "cause")).where("cause IS NOT NULL")


def causality_issues(events: DataFrame) -> DataFrame:
    """(character_name, event_id, cause, issue) of causes that can't be: self, dangling, inversion.

    An inversion is a cause of a later year, or of a later month of the year;
    an unknown month counts as 0. The first that holds counts. Ids are compared
    within a character, as they repeat between characters.
    """
    at = events.select("character_name", "event_id", F.col("year").try_cast("int").alias("y"), month_of(F.col("time_of_year")).alias("m"))
    edges = cause_edges(events)
    effect = edges.join(at.select("character_name", F.col("event_id").alias("effect"), F.col("y").alias("ey"), F.col("m").alias("em")), ["character_name", "effect"])
    both = effect.join(at.select("character_name", F.col("event_id").alias("cause"), F.col("y").alias("cy"), F.col("m").alias("cm"), F.lit(True).alias("known")), ["character_name", "cause"], "left")
    issue = (
        F.when(F.col("cause") == F.col("effect"), "self")
        .when(F.col("known").isNull(), "dangling")
        .when((F.col("cy") > F.col("ey")) | ((F.col("cy") == F.col("ey")) & (F.col("cm") > F.col("em"))), "inversion")
    )
    return both.select("character_name", F.col("effect").alias("event_id"), "cause", issue.alias("issue")).where("issue IS NOT NULL")


def event_issues(events: DataFrame) -> DataFrame:
    """(character_name, event_id, issues): messages on what is wrong with an event itself, in a fixed order; sound events are left out.

    Year: empty, with other characters than digits, outside FIRST_YEAR to
    LAST_YEAR. Id: empty, malformed, another year's. Time of year: empty or
    without a month, season or part of one. Category and description: null or blank.
    """
    written = F.trim("year")
    year = F.when(written.rlike(r"^\d{1,9}$"), written.cast("int"))
    blank = lambda c: F.coalesce(F.length(strip(F.col(c))) == 0, F.lit(True))
    low = F.lower(F.coalesce(F.col("time_of_year"), F.lit("")))
    timed = reduce(lambda a, w: a | F.contains(low, F.lit(w)), TIME_WORDS, F.lit(False))
    own = F.regexp_extract("event_id", r"^(\d{1,9})_", 1).try_cast("int")

    def field(c: str) -> Column:
        return F.when(F.col(c).isNull(), f"Missing required field: {c}").when(blank(c), f"Required field is an empty string: {c}")

    checks = [
        F.when(F.col("year").isNull(), "Year is empty").when(year.isNull(), F.concat(F.lit("Year contains non-numeric characters: '"), "year", F.lit("'"))).when(~year.between(FIRST_YEAR, LAST_YEAR), F.concat(F.lit("Year is outside the expected range: "), year.cast("string"))),
        F.when(F.coalesce(F.col("event_id") == "", F.lit(True)), "Event ID is empty").when(~F.col("event_id").rlike(EVENT_ID), F.concat(F.lit("Malformed event ID: "), "event_id", F.lit(" (expected format: YYYY_EX)"))),
        F.when(own != F.coalesce(year, F.when(F.coalesce(F.col("year") == "", F.lit(True)), 0)), F.concat(F.lit("Event ID year ("), own.cast("string"), F.lit(") does not match parent year ("), F.coalesce(year, F.lit(0)).cast("string"), F.lit(")"))),
        F.when(F.coalesce(F.col("time_of_year") == "", F.lit(True)), "time_of_year is empty").when(~timed, F.concat(F.lit("time_of_year is not recognized: '"), "time_of_year", F.lit("'"))),
        field("event_id"),
        field("category"),
        field("description"),
    ]
    return events.select("character_name", "event_id", F.array_compact(F.array(*checks)).alias("issues")).where("size(issues) > 0")


def issue_group(message: Column) -> Column:
    """The group that a message on an event or a cause belongs to."""
    return F.coalesce(*[F.when(message.rlike(words), group) for group, words in ISSUE_GROUPS], F.lit("Other issues"))


def issue_summary(events: DataFrame) -> DataFrame:
    """(issue, n): how often each group of issues occurs, in events and causes; times of year only warn and don't count."""
    single = event_issues(events).select(F.explode("issues").alias("message")).where("message NOT LIKE 'time_of_year %'").select(issue_group(F.col("message")).alias("issue"))
    return single.unionByName(causality_issues(events).select(F.lit("Causality issues").alias("issue"))).groupBy("issue").agg(F.count("*").alias("n"))


def causal_chains(events: DataFrame, longest: int = 5, shortest: int = 3, most: int = 5) -> DataFrame:
    """(character_name, rank, path): up to ``most`` chains of causes and effects, the longest first.

    A chain follows effects without meeting an event twice and has ``shortest``
    to ``longest`` events; parts of longer chains count too. Equally long ones
    are ordered by their events' positions in the character's list. Each round
    joins paths with edges by character and last event and is checkpointed, as
    the next one and the result both need it.
    """
    ids = events.where("event_id IS NOT NULL").groupBy("character_name", "event_id").agg(F.min("pos").alias("pos"))
    named = ids.select("character_name", F.col("event_id").alias("cause"), F.col("pos").alias("cp"))
    edges = cause_edges(events).select("character_name", "cause", "effect").distinct().join(named, ["character_name", "cause"])
    edges = edges.join(ids.select("character_name", F.col("event_id").alias("effect"), F.col("pos").alias("ep")), ["character_name", "effect"])
    steps = cut(edges.where("cause <> effect").select("character_name", "cause", "effect", "ep", "cp").repartition("character_name", "cause"))
    paths = steps.select("character_name", F.array("cause", "effect").alias("path"), F.array("cp", "ep").alias("at"))
    kept = None
    for n in range(3, longest + 1):
        last = paths.withColumn("cause", F.element_at("path", -1))
        paths = last.join(steps.select("character_name", "cause", "effect", "ep"), ["character_name", "cause"]).where(~F.array_contains("path", F.col("effect")))
        paths = cut(paths.select("character_name", F.array_append("path", F.col("effect")).alias("path"), F.array_append("at", F.col("ep")).alias("at")))
        if n >= shortest:
            kept = paths if kept is None else kept.unionByName(paths)
    return top_per_group(kept, ["character_name"], most, F.size("path").desc(), "at").select("character_name", "rank", "path")


def with_causes(events: DataFrame) -> DataFrame:
    """(character_name, event_id, causes): the descriptions of an event's known causes, in the order it names them."""
    told = events.select("character_name", F.col("event_id").alias("cause"), F.col("description").alias("told"))
    found = cause_edges(events).join(told, ["character_name", "cause"]).groupBy("character_name", F.col("effect").alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "told"))), lambda x: x["told"]).alias("causes"))
    return events.select("character_name", "event_id").join(found, ["character_name", "event_id"], "left").select("character_name", "event_id", F.coalesce("causes", F.array().cast("array<string>")).alias("causes"))


def task_time_issue(task: Column, known: Column, named: Column, dated: Column, span_days: Column) -> Column:
    """Why a task can't be, the first that holds; else null.

    blank: no question or answer; leak: the question of a temporal task has a
    date or a month's name; unknown event: known, the events that exist of those
    it names, is less than named (0 passes everything); no old state: an update
    without the old state's value or event; years off, days off: a temporal
    answer's span, with two dated events at least, is off by more than 1 year and
    a tenth, or by more than 5 days.
    """
    query, answer, kind = task["query"], task["gold_answer"], task["task_type"]
    temporal = F.coalesce(kind == "Temporal Reasoning", F.lit(False))
    low = F.lower(answer)
    years = F.nullif(F.regexp_extract(low, r"(\d+(\.\d+)?)\s*years?", 1), F.lit("")).try_cast("double")
    days = F.nullif(F.regexp_extract(low, r"(\d+)\s*days?", 1), F.lit("")).try_cast("double")
    real = span_days / 365.25
    off = F.abs(years - real)
    dated_span = temporal & (dated >= 2)
    return (
        F.when(named == 0, F.lit(None).cast("string"))
        .when(F.coalesce(F.length(strip(query)) == 0, F.lit(True)) | F.coalesce(F.length(strip(answer)) == 0, F.lit(True)), "blank")
        .when(temporal & (query.rlike(r"\d{4}-\d{2}") | query.rlike("|".join(m.capitalize() for m in MONTHS))), "leak")
        .when(known < named, "unknown event")
        .when((kind == "Knowledge Updating") & (task["old_state_value"].isNull() | task["old_state_event_id"].isNull()), "no old state")
        .when(dated_span & (off > 1) & (off / (real + 0.1) > 0.1), "years off")
        .when(dated_span & (F.abs(days - span_days) > 5), "days off")
    )


def apply_timestamps(stories: DataFrame, stamps: DataFrame, key: str, array: str) -> DataFrame:
    """Stories whose events, structs of an array, carry the timestamps found for their ids; others keep theirs.

    stamps: (key, event_id, stamp). They come to the story as one map, so the
    nested events are changed in place; of a repeated id the last by text counts.
    """
    once_each = stamps.groupBy(key, "event_id").agg(F.max("stamp").alias("stamp"))
    by = once_each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("event_id", "stamp"))).alias("_stamps"))
    changed = F.transform(array, lambda e: e.withField("timestamp", F.coalesce(F.try_element_at(F.col("_stamps"), e["event_id"]), e["timestamp"])))
    return stories.join(by, key, "left").withColumn(array, F.when(F.col("_stamps").isNull(), F.col(array)).otherwise(changed)).drop("_stamps")


def candidate_events(wanted: DataFrame, events: DataFrame, most: int = 12) -> DataFrame:
    """(character_name, event_id): the events a character is asked about, or its first ``most`` where none of those is known."""
    known = events.join(wanted.distinct(), ["character_name", "event_id"], "left_semi").select("character_name", "event_id", F.lit(True).alias("asked"))
    w = Window.partitionBy("character_name").orderBy("pos")
    rest = events.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most).join(known.select("character_name").distinct(), "character_name", "left_anti")
    return known.select("character_name", "event_id").unionByName(rest.select("character_name", "event_id"))
