"""What a component demands, slot by slot, and votes on whether a dialogue tells it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import iso_dates, mentions_date
from palimpsest.functions.sets import focus_tokens
from palimpsest.functions.tasks import intents
from palimpsest.functions.text import entities, numbers_without_dates, strip

# The slots in their order, and other names for them.
SLOTS = ["date", "number", "entity", "event", "status", "relation"]
SLOT_NAMES = {"time": "date", "datetime": "date", "temporal": "date", "count": "number", "duration": "number", "quantity": "number", "name": "entity", "person": "entity", "location": "entity", "place": "entity", "fact": "event", "summary": "event"}
# Words of a vote's reason that speak for and against.
FOR, AGAINST = ("covered", "confirmed", "present", "found", "explicit"), ("missing", "not ", "no evidence", "absent", "fail")


def slot_name(written: Column) -> Column:
    """The slot under any of its names; null for unknown ones."""
    low = F.lower(strip(written))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SLOT_NAMES.items() for x in p]), low), low)
    return F.when(named.isin(SLOTS), named)


def sorted_slots(written: Column) -> Column:
    """The distinct slots of an array of names, in the slots' order."""
    names = F.transform(written, slot_name)
    return F.filter(F.array(*[F.lit(s) for s in SLOTS]), lambda s: F.array_contains(names, s))


def fallback_spec(task_type: Column, query: Column, component: Column) -> Column:
    """struct(hard, soft): maps of slots to the values that a component has by its own text.

    Dates are hard where time matters (temporal tasks, questions for a time or a
    status), numbers where a count is asked for; what isn't hard is soft.
    Entities and the words of events are always soft. Empty slots are left out.
    """
    asks = intents(query)
    dates, numbers = F.array_distinct(iso_dates(component)), F.coalesce(numbers_without_dates(component), F.array().cast("array<string>"))
    timed = (task_type == "Temporal Reasoning") | asks["temporal"] | asks["status"]
    counted = asks["count"] | (task_type == "Temporal Reasoning")
    none = F.array().cast("array<string>")
    hard = F.create_map(F.lit("date"), F.when(F.coalesce(timed, F.lit(False)), dates).otherwise(none), F.lit("number"), F.when(F.coalesce(counted, F.lit(False)), numbers).otherwise(none))
    soft = F.create_map(F.lit("date"), F.when(F.coalesce(timed, F.lit(False)), none).otherwise(dates), F.lit("number"), F.when(F.coalesce(counted, F.lit(False)), none).otherwise(numbers), F.lit("entity"), entities(component), F.lit("event"), F.slice(focus_tokens(component), 1, 8))
    full = lambda k, v: F.size(v) > 0
    return F.struct(F.map_filter(hard, full).alias("hard"), F.map_filter(soft, full).alias("soft"))


def anchored(spec: Column, component: Column) -> Column:
    """A spec with only the values that stand in the component itself; hard slots that lose all become soft without values."""
    low = F.lower(F.coalesce(component, F.lit("")))

    def keep(m: Column) -> Column:
        inside = F.transform_values(m, lambda k, v: F.filter(v, lambda x: F.contains(low, F.lower(x))))
        return F.map_filter(inside, lambda k, v: F.size(v) > 0)

    return F.struct(keep(spec["hard"]).alias("hard"), keep(spec["soft"]).alias("soft"), F.array_except(F.map_keys(spec["hard"]), F.map_keys(keep(spec["hard"]))).alias("degraded"))


def value_told(slot: Column, value: Column, said: Column) -> Column:
    """Whether a text tells a slot's value: dates in any form, numbers as numbers, anything else as it is written."""
    return F.when(slot == "date", mentions_date(said, value)).when(slot == "number", F.array_contains(numbers_without_dates(said), value)).otherwise(F.contains(F.lower(said), F.lower(value)))


def slot_verdicts(specs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hard slots of each component held against what its dialogue tells.

    specs: (key, task_idx, comp_idx, spec); texts: (key, said). Returns (key,
    task_idx, comp_idx, verdicts, missing, status): a map of slot to whether all
    its values are told, the values that aren't, and PASS or HARD_MISSING. A
    component without hard slots passes.
    """
    ids = [key, "task_idx", "comp_idx"]
    values = specs.select(*ids, F.explode("spec.hard").alias("slot", "values")).select(*ids, "slot", F.explode("values").alias("value"))
    held = values.join(texts, key, "left").withColumn("told", F.coalesce(value_told(F.col("slot"), F.col("value"), F.coalesce("said", F.lit(""))), F.lit(False)))
    by_slot = held.groupBy(*ids, "slot").agg(F.every("told").alias("ok"), F.array_sort(F.collect_set(F.when(~F.col("told"), F.col("value")))).alias("lost"))
    by = by_slot.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "ok")))).alias("verdicts"), F.array_sort(F.flatten(F.collect_list("lost"))).alias("missing"))
    both = specs.select(*ids).join(by, ids, "left")
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    return both.select(*ids, F.coalesce("verdicts", F.create_map().cast("map<string,boolean>")).alias("verdicts"), missing.alias("missing"), F.when(F.size(missing) > 0, "HARD_MISSING").otherwise("PASS").alias("status"))


def admit_vote(vote: Column, reason: Column, missing: Column, required: Column, verdicts: Column, evidence: Column) -> Column:
    """struct(vote, why): a vote after it is held against its own grounds; null where they contradict it.

    A no for a reason that only speaks for, or about slots that aren't asked
    for, and a yes for a reason that only speaks against are void. A yes
    without a required slot or without evidence is a no.
    """
    low = F.lower(F.coalesce(reason, F.lit("")))

    def any_of(marks: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for m in marks:
            found = found | F.contains(low, F.lit(m))
        return found

    named = F.filter(F.transform(missing, slot_name), lambda s: s.isNotNull())
    off = (F.size(named) > 0) & (F.size(required) > 0) & ~F.arrays_overlap(named, required)
    lacking = F.exists(required, lambda s: ~F.coalesce(F.try_element_at(verdicts, s), F.lit(False)))
    why = (
        F.when(vote.isNull(), "invalid")
        .when(~vote & any_of(FOR) & ~any_of(AGAINST), "reason speaks for")
        .when(vote & any_of(AGAINST) & ~any_of(FOR), "reason speaks against")
        .when(~vote & F.coalesce(off, F.lit(False)), "other slots")
        .when(~vote, "rejected")
        .when(F.coalesce(lacking, F.lit(False)), "slot missing")
        .when(F.size(evidence) <= 0, "no evidence")
        .otherwise("accepted")
    )
    final = F.when(why.isin("invalid", "reason speaks for", "reason speaks against", "other slots"), F.lit(None).cast("boolean")).otherwise(why == "accepted")
    return F.struct(final.alias("vote"), why.alias("why"))


def enough_votes(votes: Column, least: int = 2) -> Column:
    """Whether at least ``least`` votes are true; nulls don't count."""
    return F.size(F.filter(votes, lambda v: F.coalesce(v, F.lit(False)))) >= least


def gate(before: DataFrame, after: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, passed, regressed): repairs whose component is now present while none of its task got worse.

    before, after: (*keys, status); keys are the dialogue, the task and the
    component, targets the repaired components.
    """
    task = keys[:-1]
    both = before.select(*keys, F.col("status").alias("was")).join(after.select(*keys, F.col("status").alias("now")), keys)
    worse = both.where("was = 'PRESENT' AND now <> 'PRESENT'").groupBy(*task).agg(F.count("*").alias("regressed"))
    now = targets.select(*keys).join(after.select(*keys, F.col("status").alias("now")), keys, "left").join(worse, task, "left")
    regressed = F.coalesce("regressed", F.lit(0))
    return now.select(*keys, (F.coalesce(F.col("now") == "PRESENT", F.lit(False)) & (regressed == 0)).alias("passed"), regressed.cast("long").alias("regressed"))


def missing_reason(rows: DataFrame) -> DataFrame:
    """Rows with ``reason``: why a component isn't present, from its hard status, its rule and its votes."""
    yes = F.size(F.filter(F.coalesce("votes", F.array().cast("array<boolean>")), lambda v: F.coalesce(v, F.lit(False))))
    return rows.withColumn("reason", F.when(F.col("status") == "PRESENT", F.lit(None).cast("string")).when(F.col("hard") == "HARD_MISSING", F.concat(F.lit("hard facts missing: "), F.array_join("missing", ", "))).when(F.size("votes") > 0, F.concat(yes.cast("string"), F.lit(" of "), F.size("votes").cast("string"), F.lit(" votes"))).otherwise("rule found too little"))
