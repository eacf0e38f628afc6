"""Score panels, forgetting matrices, retention and other roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits)


def score_panel(rows: DataFrame, scores: str) -> DataFrame:
    """A row for each key of a map of scores: valid and failed rows, mean, population deviation, least and most.

    Keys are those of all rows; a row without the key or with a null under it
    counts as failed.
    """
    total = rows.agg(F.count("*").alias("_rows"))
    long = rows.select(F.explode(scores).alias("key", "score"))
    panel = long.groupBy("key").agg(F.count("score").alias("valid"), mean("score").alias("avg"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return panel.crossJoin(F.broadcast(total)).select("key", "valid", (F.col("_rows") - F.col("valid")).alias("failed"), "avg", "std", "min", "max")  # one row


def task_panel(rows: DataFrame, group: str, score: str, pass_at: float = 1.0) -> DataFrame:
    """Mean, rows and pass rate by group, with a last row null for the mean of the groups' means (macro)."""
    by = rows.where(F.col(score).isNotNull()).groupBy(group).agg(F.avg(score).alias("_avg"), F.count("*").alias("n"), F.avg((F.col(score) >= pass_at).cast("double")).alias("_pass"))
    whole = by.agg(F.avg("_avg").alias("_avg"), F.sum("n").alias("n"), F.avg("_pass").alias("_pass")).withColumn(group, F.lit(None).cast(rows.schema[group].dataType))
    both = by.unionByName(whole.select(group, "_avg", "n", "_pass"))
    return both.select(group, F.round("_avg", 6).alias("avg"), "n", F.round("_pass", 6).alias("pass_rate"))


def forgetting(rows: DataFrame, checkpoint: str, stage: str, task: str, score: str) -> DataFrame:
    """Mean scores at three grains in one pass: by checkpoint, with task, with stage.

    ``grain`` says which; the columns of another grain are null.
    """
    sets = rows.groupingSets([[checkpoint], [checkpoint, task], [checkpoint, stage]], checkpoint, task, stage)
    grain = F.when(F.grouping(task) == 0, "task").when(F.grouping(stage) == 0, "stage").otherwise("overall")
    return sets.agg(mean(score).alias("avg"), F.count(score).alias("n"), grain.alias("grain"))


def matrix(rows: DataFrame, row: Sequence[str], column: str, values: Sequence[object], value: Column, prefix: str) -> DataFrame:
    """A pivot with a column for each of ``values``, named with the prefix; empty cells are null."""
    wide = rows.groupBy(*row).pivot(column, list(values)).agg(value)
    return wide.select(*row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def retention_cells(scores: DataFrame, keys: Sequence[str], checkpoint: str = "checkpoint", stage: str = "stage", score: str = "score", digits: int | None = 6) -> DataFrame:
    """Each later checkpoint's score on an earlier stage over that stage's own, with notes.

    scores: one row for each key, checkpoint and stage. The grid has all keys
    with checkpoints and stages of the data, stage below checkpoint; the
    baseline is the score at checkpoint = stage. The rate is null where either
    is missing or the baseline isn't positive. Notes name a missing or small
    baseline (below 0.03, 0.05), a missing score and rates above 2 and 3.
    ``digits`` None leaves the numbers unrounded.
    """
    who = scores.select(*keys).distinct()
    stages = scores.select(F.col(stage).alias("s")).distinct()
    points = scores.select(F.col(checkpoint).alias("c")).distinct()
    grid = who.crossJoin(F.broadcast(points.crossJoin(F.broadcast(stages)).where("s < c")))  # a dimension grid, not data
    cell = scores.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(checkpoint).alias("_c"), F.col(stage).alias("_s"), F.col(score).alias("_score"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    base = grid.join(cell.where("_c = _s"), [*same, F.col("s") == F.col("_s")], "left").select(*keys, "c", "s", F.col("_score").alias("baseline"))
    both = base.join(cell, [*same, F.col("c") == F.col("_c"), F.col("s") == F.col("_s")], "left").select(*keys, "c", "s", "baseline", F.col("_score").alias("score"))
    rate = F.when((F.col("baseline") > 0) & F.col("score").isNotNull(), F.col("score") / F.col("baseline"))
    notes = F.concat_ws(
        ";",
        F.when(F.col("baseline").isNull() | (F.col("baseline") <= 0), "no baseline").when(F.col("baseline") < 0.03, "baseline<0.03").when(F.col("baseline") < 0.05, "baseline<0.05"),
        F.when(F.col("score").isNull(), "no score"),
        F.when(rate > 3, "rate>3").when(rate > 2, "rate>2"),
    )
    shown = {"baseline": F.col("baseline"), "score": F.col("score"), "rate": rate}
    numbers = [(c if digits is None else F.round(c, digits)).alias(n) for n, c in shown.items()]
    return both.select(*keys, F.col("c").alias(checkpoint), F.col("s").alias(stage), *numbers, notes.alias("notes"))


def stage_cells(scores: DataFrame, keys: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Every cell with checkpoint >= stage: its score, the stage's own, ratio, difference and lag.

    The ratio is null unless the stage's own score is positive.
    """
    base = scores.where("checkpoint = stage").select(*keys, "stage", F.col("score").alias("own"))
    both = scores.where("checkpoint >= stage").join(base, [*keys, "stage"], "left")
    shown = {"score": F.col("score"), "ratio": F.when(F.col("own") > 0, F.col("score") / F.col("own")), "delta": F.col("score") - F.col("own")}
    numbers = [(c if digits is None else F.round(c, digits)).alias(n) for n, c in shown.items()]
    return both.select(*keys, "checkpoint", "stage", (F.col("checkpoint") - F.col("stage")).alias("lag"), *numbers)


def retention_summary(cells: DataFrame, model: str, task: str, checkpoint: str, least: float = 0.0) -> DataFrame:
    """Mean and sample deviation of the rates at three grains in one pass: model, task, both, each by checkpoint.

    Cells with a baseline below ``least`` are left out; one rate has deviation
    0, none null.
    """
    used = cells.where((F.col("baseline") >= least) & F.col("rate").isNotNull())
    sets = used.groupingSets([[model, checkpoint], [task, checkpoint], [model, task, checkpoint]], model, task, checkpoint)
    grain = F.when(F.grouping(task) == 1, "model").when(F.grouping(model) == 1, "task").otherwise("both")
    return sets.agg(mean("rate").alias("avg"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("std"), F.count("*").alias("n"), grain.alias("grain"))


def slopes(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(*keys, slope, points): the least-squares slope of y over x; null for fewer than two points or one x only."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.count("*").alias("points"))


def baseline_report(cells: DataFrame) -> DataFrame:
    """One row: distinct baselines, their range, how many are small, how many rates are large."""
    base = cells.where("baseline IS NOT NULL")
    return base.agg(F.countDistinct("baseline").alias("baselines"), F.min("baseline").alias("least"), F.max("baseline").alias("most"), F.count_if(F.col("baseline") < 0.03).alias("below_003"), F.count_if(F.col("baseline") < 0.05).alias("below_005"), F.count_if(F.col("rate") > 2).alias("above_2"), F.count_if(F.col("rate") > 3).alias("above_3"))


def extremes(rows: DataFrame, keys: Sequence[str], value: str, *ties: str) -> DataFrame:
    """One row: the mean, and the keys with the most and least value, ties to the first by ``ties``."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ranked = rows.where(F.col(value).isNotNull()).select(name.alias("k"), F.col(value).alias("v"))
    best = F.max(F.struct(F.col("v"), F.col("k")))
    worst = F.min(F.struct(F.col("v"), F.col("k")))
    return ranked.agg(mean("v").alias("avg"), best["k"].alias("most_at"), worst["k"].alias("least_at"))


def rates(rows: DataFrame, group: str, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rates from summed counters by group and, in a row with null, of all (micro): each part over its whole, 0 where the whole is 0."""
    sums = [F.sum(x).alias(f"{n}_{i}") for n, pair in parts.items() for i, x in enumerate(pair)]
    by = rows.rollup(group).agg(F.count("*").alias("n"), F.grouping(group).alias("is_total"), *sums)
    return by.select(group, "is_total", "n", *[F.round(F.coalesce(F.try_divide(F.col(f"{n}_0"), F.col(f"{n}_1")), F.lit(0.0)), 6).alias(n) for n in parts])


def apportion(targets: DataFrame, total: int, weight: str, order: Column, *keys: str) -> DataFrame:
    """Targets with ``share``: whole numbers in proportion to the weights that add up to ``total``.

    Largest remainders get what rounding down leaves, ties by ``order``. The
    targets are a table of categories, not of data. Null weights count as 0;
    without any weight all get 0.
    """
    whole = targets.agg(F.sum(F.coalesce(weight, F.lit(0)).cast("double")).alias("_sum"))
    exact = F.coalesce(F.try_divide(F.coalesce(weight, F.lit(0)) * F.lit(float(total)), F.col("_sum")), F.lit(0.0))
    rows = targets.crossJoin(F.broadcast(whole)).withColumn("_exact", F.round(exact, 9))  # one row
    rows = rows.withColumn("_floor", F.floor("_exact"))
    w = Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), order, *keys)
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    more = ((F.row_number().over(w) <= left) & (F.col("_sum") > 0)).cast("long")
    return rows.withColumn("share", F.col("_floor") + more).drop("_sum", "_exact", "_floor")


def holdout_targets(rows: DataFrame, stage: str, task: str, ratio: float, least: int) -> DataFrame:
    """(task, smallest, holdout, train): what each stage gives of a task.

    The smallest number of the task in any stage counts, 0 where a stage has
    none; the holdout is its share, at least ``least``, and leaves one for
    train; train takes what is left of the smallest.
    """
    counts = rows.groupBy(stage, task).agg(F.count("*").alias("n"))
    stages = counts.agg(F.countDistinct(stage).alias("_stages"))
    per = counts.groupBy(task).agg(F.min("n").alias("_least"), F.count("*").alias("_in"))
    m = per.crossJoin(F.broadcast(stages)).withColumn("smallest", F.when(F.col("_in") < F.col("_stages"), 0).otherwise(F.col("_least")))  # one row
    hold = F.when((F.col("smallest") <= 1) | F.lit(ratio <= 0), 0).otherwise(F.least(F.greatest(F.lit(least), F.floor(F.col("smallest") * ratio)), F.col("smallest") - 1))
    return m.select(task, "smallest", hold.cast("long").alias("holdout"), (F.col("smallest") - hold).cast("long").alias("train"))
