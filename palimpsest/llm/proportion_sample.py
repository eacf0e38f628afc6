"""Problem 1: a sample whose categories have given shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut
from palimpsest.llm.cube_spark import balanced_sample

# The six task types, their short codes and their other names.
TASK_TYPES = {
    "Information Extraction": "IE",
    "Multi-session Reasoning": "MSR",
    "Temporal Reasoning": "TR",
    "Event Summarization": "ES",
    "Knowledge Updating": "KU",
    "Memory Arbitration": "MA",
}
OTHER_NAMES = {
    "Information Extraction": ["info extraction", "fact extraction", "detail extraction", "information extract"],
    "Multi-session Reasoning": ["multi-session", "multisession", "cross-event reasoning", "cross-event", "cross-session reasoning", "cross-session"],
    "Temporal Reasoning": ["temporal", "temporal reasoning task", "time reasoning", "timeline reasoning", "timeline logic", "temporal logic", "temporal calculation", "temporal inference"],
    "Event Summarization": ["summarization", "summarisation", "summary", "event summary", "event summaries"],
    "Knowledge Updating": ["knowledge update", "knowledge updates", "state update", "state updating", "state tracking", "attribute tracking"],
    "Memory Arbitration": ["false premise", "loaded question", "premise correction", "premise check"],
}
#: Letters that may differ between a written name and one of the six.
TYPO_LETTERS = 2

_WIDE = "".join(map(chr, range(0xFF21, 0xFF3B))) + "".join(map(chr, range(0xFF41, 0xFF5B)))
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _compact(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def task_type(written: Column) -> Column:
    """The one of the six types that a written type names, else null.

    Case, white space, hyphens, other punctuation, full-width letters, the
    words "task", "type" and "question" behind the name and up to
    ``TYPO_LETTERS`` wrong letters in a full name don't matter. Null, blank
    and unrelated words give null.
    """
    bare = F.lower(F.regexp_replace(F.translate(written, _WIDE, _PLAIN), r"[^\p{L}\p{Nd}]+", ""))
    key = F.regexp_replace(bare, r"^(.{2,}?)(task|type|question|category)s?$", "$1")
    names = {_compact(x): t for t, short in TASK_TYPES.items() for x in [t, short, *OTHER_NAMES[t]]}
    exact = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    near = F.coalesce(*[F.when(F.levenshtein(key, F.lit(_compact(t)), TYPO_LETTERS) >= 0, F.lit(t)) for t in TASK_TYPES])
    return F.coalesce(F.try_element_at(exact, bare), F.try_element_at(exact, key), near)


def dialogue_members(dialogues: DataFrame) -> DataFrame:
    """Members of the dialogue pools: (pool, batch_no, member, task_type).

    One for each position in ``tasks_covered`` of each ``id``; of a dialogue
    that was exported again, the row with the lowest row_id counts. A row
    without ``id`` is a dialogue of its own. Empty and null lists have none.
    """
    tasks = dialogues.select(
        "row_id",
        "batch_no",
        F.coalesce(F.col("id"), F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("id"),
        F.posexplode(F.transform("tasks_covered", lambda t: t["task_type"])).alias("position", "written"),
    )
    once = tasks.groupBy("id", "position").agg(F.min_by(F.struct("batch_no", "written"), "row_id").alias("t"))
    member = F.concat_ws("#", "id", "position")
    return once.select(F.lit("dialogue_records").alias("pool"), F.col("t.batch_no").alias("batch_no"), member.alias("member"), task_type(F.col("t.written")).alias("task_type"))


def summary_members(summary: DataFrame) -> DataFrame:
    """Members of the summary's pool: one for each (model_name, split_type) of a type."""
    rows = summary.select("model_name", "split_type", task_type(F.col("task_type")).alias("task_type"))
    once = rows.where("task_type IS NOT NULL").distinct()
    member = F.concat_ws("#", F.coalesce("model_name", F.lit("")), F.coalesce("split_type", F.lit("")), "task_type")
    return once.select(F.lit("parametric_taskwise_summary").alias("pool"), F.lit(None).cast("int").alias("batch_no"), member.alias("member"), "task_type")


def sample_to_shares(members: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Draw for each plan a sample with the wanted number of each category.

    members: (pool, batch_no, member, task_type), each member once; targets:
    rows (plan_id, pool, batch_no, task_type, target_share, min_rows,
    sample_size). A category is wanted ``max(min_rows, target_share *
    sample_size)`` times; one with fewer members comes whole. Nulls in these
    numbers count as 0.

    Returns (sample, report). sample: (plan_id, task_type, member). report, one
    row for each target: members there, number wanted and drawn, share reached,
    ``residual`` (drawn less wanted, what landing and lacking members left
    open) and ``short`` (fewer members than wanted). Plans without any member
    get report rows with zeros. The draw is the cube method balanced on the
    category indicators and the plan's total.
    """
    members = cut(members.where("task_type IS NOT NULL"))
    wanted = F.round(F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))), 9)
    plans = targets.select("plan_id", "pool", "batch_no", "task_type", wanted.alias("wanted"))
    sizes = members.groupBy("pool", "batch_no", "task_type").agg(F.count("*").alias("members"))
    same = (F.col("p.pool") == F.col("s.pool")) & F.col("p.batch_no").eqNullSafe(F.col("s.batch_no")) & (F.col("p.task_type") == F.col("s.task_type"))
    state = plans.alias("p").join(sizes.alias("s"), same, "left").select("p.*", F.coalesce("members", F.lit(0)).cast("long").alias("members"))
    state = cut(state)  # a row for each target
    types = sorted(TASK_TYPES)
    rates = state.where("members > 0 AND wanted > 0").withColumn("pi", F.least(F.lit(1.0), F.col("wanted") / F.col("members")))
    total = rates.groupBy("plan_id").agg(F.sum("members").alias("size"))
    rates = rates.join(total, "plan_id")
    units = (
        members.alias("m")
        .join(rates.alias("p"), (F.col("p.pool") == F.col("m.pool")) & F.col("p.batch_no").eqNullSafe(F.col("m.batch_no")) & (F.col("p.task_type") == F.col("m.task_type")))
        .select("p.plan_id", "p.task_type", "m.member", "p.pi", "p.size")
    )
    # The sum of pi is the plan's total; the indicators times pi are its categories.
    balance = [F.col("pi").alias("x_total"), *[F.when(F.col("task_type") == t, F.col("pi")).otherwise(0.0).alias(f"x{i}") for i, t in enumerate(types[:-1])]]
    units = units.select("plan_id", "size", "pi", F.concat_ws("\x1f", "task_type", "member").alias("unit"), *balance)
    drawn = balanced_sample(units, ["plan_id"], "unit", "pi", ["x_total", *[f"x{i}" for i in range(len(types) - 1)]], "size", seed)
    parts = F.split("unit", "\x1f", 2)
    sample = drawn.select("plan_id", parts[0].alias("task_type"), parts[1].alias("member"))
    got = sample.groupBy("plan_id", "task_type").agg(F.count("*").alias("drawn"))
    report = state.join(got, ["plan_id", "task_type"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    whole = report.groupBy("plan_id").agg(F.sum("drawn").alias("in_all"))
    report = report.join(whole, "plan_id").select(
        "plan_id",
        "task_type",
        "members",
        "wanted",
        "drawn",
        F.round(F.coalesce(F.try_divide("drawn", "in_all"), F.lit(0.0)), 6).alias("share"),
        F.round(F.col("drawn") - F.col("wanted"), 6).alias("residual"),
        _short().alias("short"),
    )
    return sample, report


def _short() -> Column:
    """Whether the draw shows that a category falls short: it lacks a whole member or more, or took all there are and still lacks a part.

    The landing leaves a category with enough members at the whole number
    below or above what is wanted, so this is so just where there are fewer.
    """
    lacking = F.col("wanted") - F.col("drawn")
    return (lacking > 0) & ((lacking >= 1) | (F.col("drawn") == F.col("members")))
