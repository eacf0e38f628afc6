"""Task types, intents, budgets and prompts: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import strip

# The task types and, in the order in which they are looked for, other names for them.
TYPES = ["Information Extraction", "Multi-session Reasoning", "Event Summarization", "Temporal Reasoning", "Knowledge Updating", "Memory Arbitration"]
NAMES = [
    ("timeline logic", "Temporal Reasoning"), ("timeline reasoning", "Temporal Reasoning"), ("time reasoning", "Temporal Reasoning"), ("temporal logic", "Temporal Reasoning"), ("temporal", "Temporal Reasoning"),
    ("state tracking", "Knowledge Updating"), ("state update", "Knowledge Updating"), ("knowledge update", "Knowledge Updating"), ("attribute tracking", "Knowledge Updating"),
    ("memory arbitration", "Memory Arbitration"), ("false premise", "Memory Arbitration"), ("loaded question", "Memory Arbitration"), ("premise correction", "Memory Arbitration"),
    ("multi-session", "Multi-session Reasoning"), ("cross-event reasoning", "Multi-session Reasoning"), ("cross-event", "Multi-session Reasoning"),
    ("summarization", "Event Summarization"), ("summary", "Event Summarization"),
    ("information extraction", "Information Extraction"), ("fact extraction", "Information Extraction"), ("detail extraction", "Information Extraction"),
]
# Tokens that an answer of each type may take.
BUDGETS = {"Information Extraction": 128, "Temporal Reasoning": 128, "Knowledge Updating": 128, "Memory Arbitration": 192, "Multi-session Reasoning": 384, "Event Summarization": 448}
# Other names of the roles of a component.
ROLES = {"evidence": "EVIDENCE_REQUIRED", "evidence_required": "EVIDENCE_REQUIRED", "required": "EVIDENCE_REQUIRED", "inference": "INFERENCE_ONLY", "inference_only": "INFERENCE_ONLY", "derived": "INFERENCE_ONLY", "covered": "COVERED_BY_OTHER_COMPONENT", "covered_by_other_component": "COVERED_BY_OTHER_COMPONENT"}


def standard_type(written: Column) -> Column:
    """The task type that a written one stands for; Information Extraction where none fits.

    Looked for in this order: the name itself, another name, another name as a
    part of it or it as a part of one, the same with the type's own name.
    """
    low = F.lower(strip(written))
    exact = F.create_map(*[F.lit(x) for p in NAMES for x in p])

    def part(names: list[tuple[str, str]]) -> Column:
        return F.coalesce(*[F.when(F.contains(low, F.lit(n)) | F.contains(F.lit(n), low), F.lit(t)) for n, t in names])

    found = F.coalesce(F.when(written.isin(TYPES), written), F.try_element_at(exact, low), part(NAMES), part([(t.lower(), t) for t in TYPES]))
    return F.when(F.coalesce(F.length(written), F.lit(0)) == 0, TYPES[0]).otherwise(F.coalesce(found, F.lit(TYPES[0])))


def intents(query: Column) -> Column:
    """struct(count, temporal, status): what a question is after."""
    q = F.lower(F.coalesce(query, F.lit("")))
    return F.struct(
        q.rlike(r"\b(how many|number of|exactly|count)\b").alias("count"),
        q.rlike(r"\b(duration|interval|elapsed|between|days|months|years|when)\b").alias("temporal"),
        q.rlike(r"\b(as of|currently|current|latest|status|is this correct)\b").alias("status"),
    )


def recheck(confidence: Column, policy: str) -> Column:
    """Whether a present component is checked again: always, never, or unless the rule was sure of it."""
    return {"all": F.lit(True), "none": F.lit(False)}.get(policy, F.coalesce(confidence, F.lit("low")) != "high")


def answer_budget(task_type: Column, reference_tokens: Column, times: float = 2.0, least: int = 64, most: int = 512) -> Column:
    """Tokens for an answer: its type's budget, or more where the reference's tokens ask for it."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in BUDGETS.items() for x in p]), task_type), F.lit(128))
    return F.greatest(base, F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(reference_tokens * times)))).cast("int")


def wrap_prompt(prompt: Column, system: str = "") -> Column:
    """A prompt in plain turns, for models without a template of their own."""
    head = f"System: {system}\n\n" if system else ""
    return F.concat(F.lit(head + "User: "), F.coalesce(prompt, F.lit("")), F.lit("\n\nAssistant: "))


def role_name(written: Column) -> Column:
    """The role of a component under any of its names; null for unknown ones."""
    key = F.regexp_replace(F.lower(strip(written)), r"[\s-]+", "_")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), key)


def period_role(role: Column, years_of: Column, years_of_others: Column, is_period: Column) -> Column:
    """COVERED_BY_OTHER_COMPONENT for a period whose years the other components name; else the role."""
    covered = is_period & (F.size(years_of) > 0) & (F.size(F.array_except(years_of, years_of_others)) == 0)
    return F.when((role == "EVIDENCE_REQUIRED") & covered, "COVERED_BY_OTHER_COMPONENT").otherwise(role)


def next_step(value: Column, reason: Column, low: float, high: float, by: float = 0.05) -> Column:
    """A setting's next value: up by a step after a failed parse, down after anything else, within bounds."""
    moved = F.when(reason == "parse", value + by).otherwise(value - by)
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), moved)), 6)


def retry_class(status: Column, message: Column) -> Column:
    """What to do about a logged call's error: bad_request, fatal, transient or unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 400, "bad_request")
        .when(status.isin(401, 403, 404, 422), "fatal")
        .when((status == 429) | (status >= 500) | low.rlike("timeout|timed out|connection|temporar"), "transient")
        .otherwise("unknown")
    )


def director_note(kind: Column, topic: Column, texts: Column, name: Column) -> Column:
    """What a segment has to do, as a text: its kind, what to tell, what stays open."""
    told = F.when(F.size(texts) > 0, F.concat(F.lit("Tell: "), F.array_join(texts, "; "), F.lit("."))).otherwise(F.lit(""))
    start = F.when(kind == "opening", F.concat(F.lit("Open the talk with "), name, F.lit("."))).when(kind == "closing", F.concat(F.lit("Close the talk with "), name, F.lit("."))).otherwise(F.concat(F.lit("Go on about "), F.coalesce(topic, F.lit("the day")), F.lit(".")))
    return F.trim(F.concat(start, F.lit(" "), told))
