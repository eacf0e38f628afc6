"""Whether a dialogue tells what its tasks need: component audits, their reports and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import iso_dates, mentions_date
from palimpsest.functions.text import entities, focus_tokens, key_phrases, normalize_text, numbers_without_dates, told
from palimpsest.operators.dialogue import render, task_rows

PRESENT, MISSING, SKIPPED, SUSPICIOUS = "PRESENT", "MISSING", "SKIPPED", "SUSPICIOUS"


def component_rows(dialogues: DataFrame, key: str) -> DataFrame:
    """(key, task_idx, comp_idx, task_type, query, component) of all components, numbered from 0."""
    tasks = task_rows(dialogues, key)
    parts = tasks.select(key, "task_idx", F.col("task.task_type").alias("task_type"), F.col("task.query").alias("query"), F.posexplode("task.answer_components").alias("comp_idx", "component"))
    return parts.where("component IS NOT NULL")


def audit(dialogues: DataFrame, key: str, least: float = 0.5, turns: str = "dialogue") -> DataFrame:
    """(key, task_idx, comp_idx, task_type, coverage, status) of every component.

    A component that is inferred rather than told is SKIPPED; one with at least
    ``least`` of its focus tokens in the dialogue is PRESENT, any other MISSING.
    A component without focus tokens counts as covered. Each dialogue is judged
    within its row, so that its tokens are made once and neither copied for its
    components nor shuffled.
    """
    said = F.transform(F.array(focus_tokens(render(F.col(turns)))), lambda tokens: F.transform("tasks_covered", lambda t, i: F.transform(t["answer_components"], lambda c, j: _judged(t, i, c, j, tokens))))
    rows = dialogues.select(key, F.explode(F.flatten(F.filter(said[0], lambda x: x.isNotNull()))).alias("c")).where("c.component IS NOT NULL")
    status = F.when(~F.col("c.told"), SKIPPED).when(F.col("c.share") >= least, PRESENT).otherwise(MISSING)
    return rows.select(key, "c.task_idx", "c.comp_idx", "c.task_type", F.round("c.share", 6).alias("coverage"), status.alias("status"))


def _judged(task: Column, task_idx: Column, component: Column, comp_idx: Column, said: Column) -> Column:
    """struct(task_idx, comp_idx, component, task_type, told, share) of one component."""
    shares = F.transform(F.array(focus_tokens(component)), lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, said)) / F.size(own)).otherwise(1.0))
    return F.struct(task_idx.alias("task_idx"), comp_idx.alias("comp_idx"), component.alias("component"), task["task_type"].alias("task_type"), told(task["task_type"], component).alias("told"), shares[0].alias("share"))


def hard_facts(component: Column, said: Column) -> Column:
    """struct(dates, numbers, passed): the dates and numbers of a component that a text doesn't have."""
    dates = F.filter(F.array_distinct(iso_dates(component)), lambda d: ~mentions_date(said, d))
    numbers = F.array_except(numbers_without_dates(component), numbers_without_dates(said))
    return F.struct(dates.alias("dates"), numbers.alias("numbers"), ((F.size(dates) == 0) & (F.size(numbers) == 0)).alias("passed"))


def rule_status(component: Column, said: Column) -> Column:
    """PRESENT, SUSPICIOUS or MISSING by the first rule that decides.

    A missing date or number: MISSING. A key phrase of several words in the
    text: PRESENT. Else by the share of keywords there: 0.8, 0.4.
    """
    flat = normalize_text(said)
    phrases = key_phrases(component)
    several = F.exists(F.filter(phrases, lambda p: F.contains(p, F.lit(" "))), lambda p: F.contains(flat, p))
    single = F.filter(phrases, lambda p: ~F.contains(p, F.lit(" ")))
    share = F.when(F.size(single) > 0, F.size(F.filter(single, lambda p: F.contains(flat, p))) / F.size(single)).otherwise(0.0)
    return F.when(~hard_facts(component, said)["passed"], MISSING).when(several, PRESENT).when(share >= 0.8, PRESENT).when(share >= 0.4, SUSPICIOUS).otherwise(MISSING)


def soft_signals(component: Column, said: Column) -> Column:
    """struct(entities, keywords): shares of a component's names and keywords that a text has; 1 where it has none."""
    low = F.lower(said)
    names = entities(component)
    keys = F.filter(focus_tokens(component), lambda w: F.length(w) > 3)

    def share(xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: F.contains(low, F.lower(x)))) / F.size(xs)).otherwise(1.0)

    return F.struct(F.round(share(names), 6).alias("entities"), F.round(share(keys), 6).alias("keywords"))


def clean(dialogues: DataFrame, audited: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(dialogues, report) without the tasks that have a MISSING component.

    Tasks that the audit doesn't know stay; dialogues that lose all their tasks
    are left out. Rows keep their other columns, tasks their order. The report
    has raw, valid and removed tasks by task type.
    """
    tasks = task_rows(dialogues, key)
    bad = audited.where(F.col("status") == MISSING).select(key, "task_idx").distinct()
    kept = tasks.join(bad, [key, "task_idx"], "left_anti")
    again = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("task_idx", "task"))).alias("_tasks"))
    cleaned = dialogues.join(again, key).withColumn("tasks_covered", F.transform("_tasks", lambda t: t["task"])).drop("_tasks")
    kind = F.col("task.task_type").alias("task_type")
    counts = tasks.groupBy(kind).agg(F.count("*").alias("raw"))
    valid = kept.groupBy(kind).agg(F.count("*").alias("valid"))
    report = counts.alias("r").join(valid.alias("v"), F.col("r.task_type").eqNullSafe(F.col("v.task_type")), "left")
    report = report.select("r.task_type", "raw", F.coalesce("valid", F.lit(0)).alias("valid"), (F.col("raw") - F.coalesce("valid", F.lit(0))).alias("removed"))
    return cleaned, report


def flips(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: components in both audits, those whose status differs, and their rate."""
    both = old.select(*keys, F.col("status").alias("was")).join(new.select(*keys, F.col("status").alias("is_")), keys)
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("was") != F.col("is_")).alias("flipped")).withColumn("flip_rate", F.round(F.coalesce(F.try_divide("flipped", "compared"), F.lit(0.0)), 6))


def affected(placed: DataFrame, repaired: DataFrame, key: str, width: int) -> DataFrame:
    """(key, task_idx, comp_idx) that a repair may touch, each once.

    placed: (key, task_idx, comp_idx, turns), the turns where each component is
    told; repaired: (key, task_idx, comp_idx, insert_at, n). Affected are the
    repaired components, the others of their tasks, and those told within
    ``width`` turns of the inserted ones. The interval is expanded to single
    turns, so the join is an equi-join.
    """
    ids = [key, "task_idx", "comp_idx"]
    direct = repaired.select(*ids)
    same = placed.join(repaired.select(key, "task_idx").distinct(), [key, "task_idx"], "left_semi").select(*ids)
    reach = F.sequence(F.greatest(F.lit(0), F.col("insert_at") - width), F.col("insert_at") + F.col("n") + width)
    near = repaired.select(key, F.explode(reach).alias("turn")).distinct()
    told_at = placed.select(*ids, F.explode("turns").alias("turn"))
    return direct.unionByName(same).unionByName(told_at.join(near, [key, "turn"], "left_semi").select(*ids)).distinct()


def nearest_sibling(rows: DataFrame, group: list[str], order: str, turn: str) -> DataFrame:
    """Rows with the turns of the nearest siblings before and behind that have one, and where to insert.

    The place is behind the one before, else before the one behind, else null.
    """
    w = Window.partitionBy(*group).orderBy(order)
    before = F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(turn, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("behind", behind).withColumn("insert_at", F.coalesce(F.col("before") + 1, F.col("behind")))


def dialogue_report(audited: DataFrame, key: str) -> DataFrame:
    """A row for each dialogue: components by status and the coverage rate of those that count."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in (PRESENT, MISSING, SKIPPED)]
    rows = audited.groupBy(key).agg(F.count("*").alias("components"), *counts)
    return rows.withColumn("coverage_rate", F.round(F.coalesce(F.try_divide(F.col("present"), F.col("present") + F.col("missing")), F.lit(0.0)), 6))


def vote_result(votes: Column, focused: int = 5, strong: int = 4) -> Column:
    """PRESENT or MISSING from votes of YES and NO, null for none.

    At least ``strong`` YES among the first ``focused`` decide; else the
    majority of the further votes, of all where there are no further ones.
    """
    first = F.slice(votes, 1, focused)
    rest = F.when(F.size(votes) > focused, F.slice(votes, F.lit(focused + 1), F.size(votes))).otherwise(votes)

    def yes(v: Column) -> Column:
        return F.size(F.filter(v, lambda x: F.upper(F.trim(x)) == "YES"))

    return F.when(F.size(votes) <= 0, F.lit(None).cast("string")).when(yes(first) >= strong, PRESENT).when(2 * yes(rest) > F.size(rest), PRESENT).otherwise(MISSING)


def upper_median(votes: Column) -> Column:
    """The element n / 2, rounded down, of the sorted votes: the higher middle one of an even number; null for none."""
    kept = F.array_sort(F.filter(votes, lambda v: v.isNotNull()))
    return F.try_element_at(kept, (F.floor(F.size(kept) / 2) + 1).cast("int"))


def plurality(votes: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """(*keys, role, votes): the most frequent vote of each key, null where two are equally frequent."""
    counts = votes.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("votes"))
    best = counts.alias("c").join(top.alias("t"), [*keys]).where("c.n = t.votes")
    return best.groupBy(*keys).agg(F.when(F.count("*") == 1, F.first(vote)).alias("role"), F.first("votes").alias("votes"))


def unfinished(audited: DataFrame, key: str, done: str = "decision_complete") -> DataFrame:
    """(key): dialogues with a component that isn't decided yet; all of such a dialogue is audited again."""
    return audited.groupBy(key).agg(F.every(F.coalesce(done, F.lit(False))).alias("_done")).where("NOT _done").select(key)
