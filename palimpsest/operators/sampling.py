"""Selection, rebalancing and de-duplication of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.rank import global_rank, hash_order, top_per_group

# Weights of the task types when a character has more records than wanted.
TASK_WEIGHTS = {"Knowledge Updating": 3.0, "Memory Arbitration": 3.0, "Temporal Reasoning": 2.0, "Multi-session Reasoning": 2.0, "Event Summarization": 1.5, "Information Extraction": 1.0}


def last_by_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """For each key its last row, at the place of its first; null and empty keys are left out.

    ``first_position`` says where the key came first.
    """
    columns = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    best = kept.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("_r"), F.min(position).alias("first_position"))
    return best.select(key, "_r.*", "first_position")


def merge_shards(shards: Sequence[DataFrame], source: DataFrame, key: str) -> DataFrame:
    """Rows of several shards, the last shard's for each key, with the source's position; unknown keys come last.

    source: (key, position). Columns that a shard lacks are null.
    """
    rows = None
    for i, s in enumerate(shards):
        part = s.withColumn("_shard", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_shard")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_shard").alias("_r")).select(key, "_r.*")
    return best.join(source.select(key, "position"), key, "left").withColumn("position", F.coalesce("position", F.lit(10**18)))


def pending(wanted: DataFrame, done: DataFrame, key: str, response: str) -> DataFrame:
    """The wanted rows that no row of ``done`` with a response answers."""
    answered = done.where(F.length(F.trim(response)) > 0).select(key).distinct()
    return wanted.join(answered, key, "left_anti")


def task_weight(task_type: Column) -> Column:
    """The weight of a task type, 1 for unknown ones."""
    pairs = [F.lit(x) for p in TASK_WEIGHTS.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), task_type), F.lit(1.0))


def rebalance(records: DataFrame, group: str, weight: Column, most: int, *order: str) -> DataFrame:
    """Exactly ``most`` records for each group: the heaviest ones, or all with repetitions.

    A group with more keeps those of greatest weight, the first by ``order`` of
    equals. One with fewer is filled by going round its records in that order;
    ``copy`` numbers the repetitions from 1 and is null for the records
    themselves. Copies are exploded from each record's own row, so a group is
    never gathered.
    """
    sizes = records.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    top = top_per_group(records.withColumn("_w", weight), [group], most, F.col("_w").desc(), *order, name="_at").drop("_w")
    kept = top.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    # Record at place i gets the copies i, i + n, i + 2n, ... of the most - n to make.
    lacking = F.lit(most) - F.col("_n")
    copies = F.when(lacking >= F.col("_at"), F.sequence(F.col("_at").cast("int"), lacking.cast("int"), F.col("_n").cast("int"))).otherwise(F.array().cast("array<int>"))
    both = F.concat(F.array(F.lit(None).cast("int")), copies)
    return kept.withColumn("copy", F.explode(both)).drop("_n", "_at")


def whole_groups(records: DataFrame, group: str, target: int, seed: int, *order: str) -> DataFrame:
    """``target`` records taken group by group in a shuffled order, the last group cut off.

    All where there are fewer, none for a target of 0. Only the groups' sizes
    are ranked; a group is taken, cut or left by the sizes before it.
    """
    if target <= 0:
        return records.limit(0)
    sizes = records.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = global_rank(sizes, hash_order(seed, F.col(group)), group, name="_rank")
    # Running sums over all groups, by blocks of ranks so that no task sees them all.
    block = F.floor((F.col("_rank") - 1) / 10_000)
    sums = ranked.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ranked.withColumn("_block", block).withColumn("_within", within).join(F.broadcast(base), "_block").select(group, (F.col("_within") + F.col("_base")).alias("_before"))
    used = start.where(F.col("_before") < target)
    w = Window.partitionBy(group).orderBy(*order)
    return records.join(used, group).withColumn("_at", F.row_number().over(w)).where(F.col("_before") + F.col("_at") <= target).drop("_at", "_before")


def upsample(records: DataFrame, target: int, seed: int, *keys: str) -> DataFrame:
    """``target`` records: a shuffled choice, or all of them over and over, ``copy`` counting from 1, null for the first time."""
    total = records.agg(F.count("*").alias("_n"))
    ranked = global_rank(records, hash_order(seed, *[F.col(k) for k in keys]), *keys, name="_at").crossJoin(F.broadcast(total))  # one row
    times = F.floor((F.lit(target) - F.col("_at")) / F.col("_n"))
    copies = F.when(times >= 1, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return ranked.where(F.col("_at") <= target).withColumn("copy", F.explode(F.concat(F.array(F.lit(None).cast("int")), copies))).drop("_at", "_n")


def first_per_kind(facts: DataFrame, owner: str, kind: str, kinds: int, each: int, seed: int, *order: str) -> DataFrame:
    """For each owner a shuffled choice of up to ``kinds`` kinds, and the first ``each`` facts of each of them."""
    per = facts.select(owner, kind).distinct()
    w = Window.partitionBy(owner).orderBy(hash_order(seed, F.col(owner), F.col(kind)), kind)
    chosen = per.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= kinds).drop("_at")
    return top_per_group(facts.join(chosen, [owner, kind], "left_semi"), [owner, kind], each, *order, name="_at").drop("_at")


def ready_owners(facts: DataFrame, owner: str, kind: str, kinds: int, each: int) -> DataFrame:
    """Facts of the owners that have at least ``kinds`` kinds with at least ``each`` facts in every one."""
    per = facts.groupBy(owner, kind).agg(F.count("*").alias("n"))
    good = per.groupBy(owner).agg(F.count("*").alias("k"), F.min("n").alias("m")).where((F.col("k") >= kinds) & (F.col("m") >= each))
    return facts.join(good, owner, "left_semi")


def dense_ids(rows: DataFrame, order: Column, *ties: str, name: str = "id", width: int = 6) -> DataFrame:
    """Rows with consecutive numbers as zero-padded text, from 1, by a hexadecimal order key and ties."""
    ranked = global_rank(rows, order, *ties, name="_at")
    text = F.col("_at").cast("string")
    return ranked.withColumn(name, F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))).drop("_at")


def choose(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows in a shuffled order, without replacement; with more than there are, the rest with repetition."""
    return upsample(rows, n, seed, *keys)


def event_group(ids: Column, otherwise: Column) -> Column:
    """A record's group: its sorted distinct event ids, else ``otherwise``."""
    kept = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(kept) > 0, F.array_join(kept, ",")).otherwise(otherwise)


def paced_choice(slots: Column, kinds: Sequence[str], budget: int, seed: int) -> Column:
    """For each slot of an array a kind or null: never the one before, each at most ``budget`` times.

    The slots' values start the choice, which goes round the kinds from a place
    that their hash gives; a fold within one row.
    """
    options = F.array(*[F.lit(k) for k in kinds])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(a: Column, slot: Column) -> Column:
        offset = F.pmod(F.xxhash64(F.lit(seed), slot), F.lit(len(kinds))).cast("int")
        turned = F.concat(F.slice(options, offset + 1, len(kinds)), F.slice(options, F.lit(1), offset))
        free = F.filter(turned, lambda k: (k != a["last"]) & (F.size(F.filter(a["out"], lambda x: x == k)) < budget))
        pick = F.try_element_at(free, F.lit(1))
        return F.struct(F.array_append(a["out"], pick).alias("out"), F.coalesce(pick, F.lit("")).alias("last"))

    return F.aggregate(slots, start, step, lambda a: a["out"])


def retrieve(turns: DataFrame, key: str, routes: dict[str, tuple[Column, float]], matched: Column, radius: int, cap: int) -> DataFrame:
    """(key, positions): up to ``cap`` turns around the best ones by several routes.

    Each route's score is divided by its greatest in the dialogue and weighted;
    matched turns get the full weight. Turns are taken by score, each with its
    neighbours within ``radius``, while the cap lasts; ties by position. A
    dialogue without any score gives the turns at a fifth, a half and four fifths.
    """
    w = Window.partitionBy(key)
    full = sum(weight for _, weight in routes.values())
    score = F.lit(0.0)
    for column, weight in routes.values():
        top = F.max(column).over(w)
        score = score + F.when(top > 0, column / top * F.lit(weight)).otherwise(0.0)
    scored = turns.withColumn("_score", F.round(F.when(matched, F.lit(full)).otherwise(score), 9)).withColumn("_last", F.max("pos").over(w)).withColumn("_best", F.max("_score").over(w))
    fallback = F.col("pos").isin(0) | (F.col("pos") == F.floor(F.col("_last") / 5)) | (F.col("pos") == F.floor(F.col("_last") / 2)) | (F.col("pos") == F.floor(F.col("_last") * 4 / 5))
    centres = scored.where(F.when(F.col("_best") > 0, F.col("_score") > 0).otherwise(fallback & (F.col("pos") > 0) | (F.col("_last") == 0)))
    ranked = centres.withColumn("_at", F.row_number().over(w.orderBy(F.col("_score").desc(), "pos")))
    near = ranked.select(key, "_at", "_last", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - radius), F.least(F.col("_last"), F.col("pos") + radius))).alias("turn"))
    firsts = near.groupBy(key, "turn").agg(F.min("_at").alias("_at"))
    kept = firsts.withColumn("_n", F.row_number().over(w.orderBy("_at", "turn"))).where(F.col("_n") <= cap)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list("turn")).alias("positions"))
