"""Contracts between stages: checks, defaults, look-ups, subsets and ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import focus_tokens, strip
from palimpsest.operators.rank import global_rank, hash_order


def fact_contract(facts: DataFrame, id_col: str, required: list[str], date: str) -> DataFrame:
    """(check, n): how many facts break each rule; all rules are there, sound ones with 0.

    missing: a required field is null or blank; repeated: its id is another's
    too; malformed: the id isn't six digits or more; gap: ids that lack between
    1 and the number of facts; date: not YYYY-MM-DD.
    """
    number = F.col(id_col).try_cast("long")
    lacks = reduce(lambda a, b: a | b, [F.coalesce(F.length(strip(F.col(c).cast("string"))) == 0, F.lit(True)) for c in required], F.lit(False))
    total = facts.agg(
        F.count_if(lacks).alias("missing"),
        (F.count(id_col) - F.countDistinct(id_col)).alias("repeated"),
        F.count_if(~F.coalesce(F.col(id_col).rlike(r"^\d{6,}$"), F.lit(False))).alias("malformed"),
        (F.count("*") - F.countDistinct(F.when(number.between(1, 2**62), number))).alias("_lost"),
        F.max(number).alias("_most"),
        F.count("*").alias("_n"),
        F.count_if(~F.coalesce(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))).alias("date"),
    )
    gap = F.when(F.col("_n") == 0, 0).otherwise(F.greatest(F.lit(0), F.coalesce("_most", F.lit(0)) - (F.col("_n") - F.col("_lost"))))
    rules = {"missing": F.col("missing"), "repeated": F.col("repeated"), "malformed": F.col("malformed"), "gap": gap, "date": F.col("date")}
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("n")) for k, v in rules.items()])))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, "left" or "right"; nulls count as a key."""
    x = a.select(F.col(key).alias("_l"), F.lit(True).alias("_in_a")).distinct()
    y = b.select(F.col(key).alias("_r"), F.lit(True).alias("_in_b")).distinct()
    both = x.join(y, F.col("_l").eqNullSafe(F.col("_r")), "full_outer").where("_in_a IS NULL OR _in_b IS NULL")
    return both.select(F.coalesce("_l", "_r").alias(key), F.when(F.col("_in_a").isNull(), "right").otherwise("left").alias("side"))


def with_default(rows: DataFrame, table: DataFrame, keys: list[str], value: str, default: object) -> DataFrame:
    """Rows with a value looked up by keys, the default where there is none. The table has a key once."""
    return rows.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def memo(rows: DataFrame, stored: DataFrame, key: Column, value: str, compute: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the value, new entries): stored values where the key is known, computed ones elsewhere.

    Each unknown key is computed once, however many rows have it.
    """
    keyed = rows.withColumn("_key", key)
    known = stored.select(F.col("key").alias("_key"), F.col(value).alias("_stored"))
    marked = keyed.join(known, "_key", "left")
    fresh = marked.where("_stored IS NULL").dropDuplicates(["_key"]).select("_key", compute.alias("_new"))
    result = marked.join(fresh, "_key", "left").withColumn(value, F.coalesce("_stored", "_new")).drop("_key", "_stored", "_new")
    return result, fresh.select(F.col("_key").alias("key"), F.col("_new").alias(value))


def subset(items: DataFrame, key: str, count: int, offset: int = 0, seed: int | None = None, strict: bool = False) -> DataFrame:
    """The items of ``count`` keys from ``offset`` on, by the key as text, or with a seed a shuffled choice of them.

    Items of a null key are left out; those of a repeated key go together, or
    raise with ``strict``.
    """
    once = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    if strict:
        once = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string")))).otherwise(F.lit(True))).where("_ok")
    order = F.hex(F.col(key).cast("string")) if seed is None else hash_order(seed, F.col(key))
    chosen = global_rank(once, order, key, name="_at", prefix=3 if seed is not None else 8).where((F.col("_at") > offset) & (F.col("_at") <= offset + count))
    return items.join(chosen.select(key), key, "left_semi")


def mission_events(tasks: DataFrame, events: DataFrame, owner: str) -> DataFrame:
    """The events that an owner's tasks are about, each once; owners without tasks give none.

    tasks: (owner, event_ids); events: (owner, event_id, ...). Ids are taken
    within their owner, as they repeat between owners.
    """
    named = tasks.select(owner, F.explode("event_ids").alias("event_id")).where("event_id IS NOT NULL").distinct()
    return events.join(named, [owner, "event_id"], "left_semi")


def usage_panel(calls: DataFrame, prompt: str, answer: str) -> DataFrame:
    """One row: calls, those with an answer, tokens in and out and the mean of each; zeros for no calls."""
    n = F.count("*")
    return calls.agg(n.alias("calls"), F.count_if(F.length(F.col(answer)) > 0).alias("answered"), F.coalesce(F.sum(F.ceil(F.length(prompt) / 4)), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.ceil(F.length(answer) / 4)), F.lit(0)).alias("tokens_out"))


def injected(dialogues: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """(key, task_idx, comp_idx, said): for each component its dialogue with the component told at the end; it must be found."""
    return components.join(dialogues, key).select(key, "task_idx", "comp_idx", "component", F.concat_ws("\n", "said", "component").alias("said"))


def redacted(dialogues: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """(key, task_idx, comp_idx, said): for each component its dialogue without the lines that share a focus token with it."""
    rows = components.join(dialogues, key).withColumn("_own", focus_tokens(F.col("component")))
    kept = F.filter(F.split("said", "\n"), lambda line: ~F.arrays_overlap(focus_tokens(line), F.col("_own")))
    return rows.select(key, "task_idx", "comp_idx", "component", F.array_join(kept, "\n").alias("said"))


def quality(rows: DataFrame, least: float) -> Column:
    """Whether ``said`` has at least ``least`` of the focus tokens of ``component``."""
    own = focus_tokens(F.col("component"))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, focus_tokens(F.col("said")))) / F.size(own)).otherwise(1.0) >= least


def self_check(dialogues: DataFrame, components: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """One row: of all components the share found when injected, and of those with focus tokens found when redacted.

    An audit that works finds the first and misses the second.
    """
    a = injected(dialogues, components, key)
    b = redacted(dialogues, components.where(F.size(focus_tokens(F.col("component"))) > 0), key)
    x = a.select(quality(a, least).alias("ok")).agg(F.count("*").alias("components"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("found_injected"))
    y = b.select(quality(b, least).alias("ok")).agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("found_redacted"))
    return x.crossJoin(F.broadcast(y))  # one row each


def ladder(facts: DataFrame, owner: str, kind: str, levels: list[tuple[int, int, int]], seed: int, *order: str) -> DataFrame:
    """(level, owner, kind, facts): prompts that get harder: at each level so many owners, kinds of each and facts of each kind.

    levels: (owners, kinds, facts). Owners and kinds are a shuffled choice, the
    same ones being kept from level to level, facts the first in order.
    """
    owners = global_rank(facts.select(owner).distinct(), hash_order(seed, F.col(owner)), owner, name="_owner")
    kinds = facts.select(owner, kind).distinct().withColumn("_kind", F.row_number().over(Window.partitionBy(owner).orderBy(hash_order(seed, F.col(owner), F.col(kind)), kind)))
    placed = facts.withColumn("_fact", F.row_number().over(Window.partitionBy(owner, kind).orderBy(*order))).join(owners, owner).join(kinds, [owner, kind])
    steps = F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(o).alias("_owners"), F.lit(k).alias("_kinds"), F.lit(f).alias("_facts")) for i, (o, k, f) in enumerate(levels)])
    at = placed.select("*", F.inline(steps)).where("_owner <= _owners AND _kind <= _kinds AND _fact <= _facts")
    return at.groupBy("level", owner, kind).agg(F.count("*").alias("facts"))


def name_parts(path: Column) -> Column:
    """struct(level, tokens) of a ladder file's name, ..._L<level>_tok<tokens>...; null where it has none."""
    level, tokens = (F.nullif(F.regexp_extract(path, p, 1), F.lit("")).try_cast("int") for p in (r"_L(\d+)_", r"_tok(\d+)"))
    return F.struct(level.alias("level"), tokens.alias("tokens"))
