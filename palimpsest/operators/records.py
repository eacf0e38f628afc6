"""Training and evaluation records made of dialogues, and projects of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.jsons import REQUIRED
from palimpsest.functions.text import strip
from palimpsest.operators import dialogue as D
from palimpsest.operators import rank
from palimpsest.operators import sequence as S

#: What a record of each task type asks for.
INSTRUCTIONS = {
    "Information Extraction": "State the single fact asked for.",
    "Multi-session Reasoning": "Join facts from several sessions.",
    "Temporal Reasoning": "Give the span as a number of days.",
    "Event Summarization": "Tell the events in order.",
    "Knowledge Updating": "Give the newest state.",
    "Memory Arbitration": "Check whether the premise is true.",
}


def instruction(task_type: Column) -> Column:
    """The instruction of a task type; a general one for unknown types."""
    texts = {k: f"{t} Return one JSON object with the fields {', '.join(REQUIRED[k])}." for k, t in INSTRUCTIONS.items()}
    pairs = [F.lit(x) for p in texts.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), task_type), F.lit("Answer the question."))


def chunk_lines(dialogues: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunk, tokens, text): the lines of each chunk's turns.

    The turns stay in their row and are cut there, so no turn is shuffled.
    """
    lines = dialogues.select(key, F.transform(D.spoken(F.col("dialogue")), D.turn_line).alias("_lines"))
    both = chunks.join(lines, key)
    return both.select(key, "chunk", "tokens", F.array_join(F.slice("_lines", F.col("start") + 1, F.col("end") - F.col("start") + 1), "\n").alias("text"))


def pretrain_records(dialogues: DataFrame, chunks: DataFrame, key: str, stage: DataFrame, style: str = "text") -> DataFrame:
    """(key, chunk, stage, record): pretraining records, {text} or {instruction, input, output} as JSON.

    The header names stage, character and chunk; the records carry the same as metadata.
    """
    own = dialogues.select(key, F.col("character"))
    rows = chunk_lines(dialogues, chunks, key).join(own, key).join(stage, key)
    head = F.concat(F.lit("[stage "), F.col("stage").cast("string"), F.lit(" | "), F.coalesce("character", F.lit("unknown")), F.lit(" | chunk "), (F.col("chunk") + 1).cast("string"), F.lit("]"))
    meta = F.struct(F.col("stage"), F.col("character"), F.col("chunk"), F.col("tokens")).alias("metadata")
    text = F.concat(head, F.lit("\n"), F.col("text"))
    body = F.struct(text.alias("text"), meta) if style == "text" else F.struct(F.lit("Remember this part of a dialogue.").alias("instruction"), head.alias("input"), F.col("text").alias("output"), meta)
    return rows.select(key, "chunk", "stage", F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))


def sft_output(task: Column) -> Column:
    """The answer of a task as the JSON object that its type asks for."""
    a, parts = task["gold_answer"], F.coalesce(task["answer_components"], F.array().cast("array<string>"))

    def obj(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})

    kind, none = task["task_type"], F.lit("")
    days = F.nullif(F.regexp_extract(a, r"(\d+)\s+days?\b", 1), none).try_cast("int")
    dates = F.regexp_extract_all(F.concat_ws(" ", parts, a), F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)
    years = F.regexp_extract_all(F.concat_ws(" ", task["query"], a), F.lit(r"\b((?:19|20)\d{2})\b"), 1)
    false = F.lower(a).rlike(r"premise is wrong|premise is incorrect|not what happened|never|no longer|false")
    return (
        F.when(kind == "Multi-session Reasoning", obj(event_chain=parts, final_outcome=a))
        .when(kind == "Temporal Reasoning", obj(final_answer=a, days=days, start_date=F.coalesce(F.array_min(dates), none), end_date=F.coalesce(F.array_max(dates), none)))
        .when(kind == "Event Summarization", obj(time_span=F.array_join(F.array_distinct(years), "-"), key_turning_points=parts, summary=a))
        .when(kind == "Knowledge Updating", obj(latest_state=a, as_of_time=F.regexp_extract(F.coalesce(task["query"], none), r"(?i)\bas of ([^,?]+)[,?]", 1), deprecated_state=F.coalesce(task["old_state_value"], none)))
        .when(kind == "Memory Arbitration", obj(premise_verdict=F.when(false, "incorrect").otherwise("correct"), premise_error=F.when(false, a).otherwise(none), corrected_facts=parts, final_answer=a))
        .otherwise(obj(answer=a, evidence_snippets=parts))
    )


def sft_records(dialogues: DataFrame, key: str) -> DataFrame:
    """(key, task_idx, instruction, input, output): a record for each task with a question and an answer."""
    t = F.col("task")
    rows = D.task_rows(dialogues, key).where(F.length(strip(t["query"])) > 0).where(F.length(strip(t["gold_answer"])) > 0)
    return rows.select(key, "task_idx", instruction(t["task_type"]).alias("instruction"), t["query"].alias("input"), sft_output(t).alias("output"))


def eval_samples(dialogues: DataFrame, key: str, identity: str = "id", context: bool = False) -> DataFrame:
    """(sample_id, key, task_idx, prompt, reference): what a model is asked, with the dialogue before it where ``context`` holds.

    Ids are the dialogue, the type and the task's place, joined by "::".
    """
    t = F.col("task")
    own = dialogues.select(key, identity, *([D.render(F.col("dialogue")).alias("_context")] if context else []))
    rows = D.task_rows(dialogues, key).join(own, key)
    sample = F.concat_ws("::", F.coalesce(identity, F.lit("")), F.coalesce(t["task_type"], F.lit("")), F.col("task_idx").cast("string"))
    asked = F.concat(instruction(t["task_type"]), F.lit("\n\n### Question\n"), F.coalesce(t["query"], F.lit("")))
    prompt = F.concat(F.lit("### Dialogue\n"), F.col("_context"), F.lit("\n\n"), asked) if context else asked
    return rows.select(sample.alias("sample_id"), key, "task_idx", prompt.alias("prompt"), t["gold_answer"].alias("reference"))


def project(dialogues: DataFrame, key: str, stages: int, ratio: float, seed: int) -> DataFrame:
    """(key, stage, part): the stage of each dialogue, and train or test within its stage."""
    staged = rank.near_equal_parts(dialogues.select(key), stages, rank.hash_order(seed, F.col(key)), F.col(key), name="stage")
    return S.entity_split(staged, ["stage"], ratio, seed + 1, key)


def job_grid(stages: DataFrame, splits: list[str], done: DataFrame) -> DataFrame:
    """(checkpoint, stage, split) of the evaluations still to run: every stage up to each checkpoint, in each split, without those done."""
    s = stages.select(F.col("stage").alias("checkpoint"))
    grid = s.select("checkpoint", F.explode(F.sequence(F.lit(1), F.col("checkpoint"))).alias("stage")).select("*", F.explode(F.array(*[F.lit(x) for x in splits])).alias("split"))
    return grid.join(done, ["checkpoint", "stage", "split"], "left_anti")


def samples_from_records(rows: DataFrame, order: Column, *ties: str) -> DataFrame:
    """Records with ``sample_id``: their dialogue, type and place among all records, from 0, joined by "::"."""
    ranked = rank.global_rank(rows, order, *ties, name="_at")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("dialogue_id", "task_type")]
    return ranked.withColumn("sample_id", F.concat_ws("::", *parts, (F.col("_at") - 1).cast("string"))).drop("_at")


def training_jobs(stages: DataFrame, first_model: str) -> DataFrame:
    """(stage, step, start_from, gives): the chain of trainings, each stage a pretraining and a tuning, each going on from the one before."""
    steps = stages.select("stage", F.posexplode(F.array(F.lit("pretrain"), F.lit("tune"))).alias("_i", "step"))
    own = F.concat(F.lit("stage_"), F.lpad(F.col("stage").cast("string"), 2, "0"), F.lit("_"), F.col("step"))
    before = F.when(F.col("_i") == 1, F.concat(F.lit("stage_"), F.lpad(F.col("stage").cast("string"), 2, "0"), F.lit("_pretrain"))).when(F.col("stage") > 1, F.concat(F.lit("stage_"), F.lpad((F.col("stage") - 1).cast("string"), 2, "0"), F.lit("_tune"))).otherwise(first_model)
    return steps.select("stage", "step", before.alias("start_from"), own.alias("gives"))
