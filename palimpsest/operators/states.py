"""Predictions of state tracking held against what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import grams

#: Words of the longest name.
NAME_WORDS = 5


def accepted(truth: DataFrame, facts: DataFrame, owner: str, kind: str) -> DataFrame:
    """(owner, kind, gold, accepted): what counts as right for each group.

    A group of one fact accepts its gold answer, null and the fact itself; any
    other the gold answer only. truth: (owner, kind, gold); facts: (owner, kind, fact).
    """
    sizes = facts.groupBy(owner, kind).agg(F.count("*").alias("_n"), F.min("fact").alias("_fact"))
    rows = truth.join(sizes, [owner, kind], "left")
    single = F.array(F.col("gold"), F.lit(None).cast("string"), F.col("_fact"))
    return rows.select(owner, kind, "gold", F.when(F.col("_n") == 1, single).otherwise(F.array("gold")).alias("accepted"))


def compare(known: DataFrame, predicted: DataFrame, owner: str, kind: str) -> DataFrame:
    """(owner, kind, covered, right): each known group with whether it is predicted and right.

    Predictions of unknown groups don't count. Null may be accepted, so the
    comparison is null-safe; a group without a prediction is wrong.
    """
    p = predicted.select(owner, kind, "prediction", F.lit(True).alias("_there"))
    both = known.join(p, [owner, kind], "left")
    right = F.exists("accepted", lambda v: v.eqNullSafe(F.col("prediction"))) & F.col("_there").isNotNull()
    return both.select(owner, kind, F.col("_there").isNotNull().alias("covered"), right.alias("right"))


def accuracy(compared: DataFrame, owner: str) -> DataFrame:
    """A row for each owner, and one with null for all: groups, coverage, accuracy and whether all are right."""
    by = compared.rollup(owner).agg(F.count("*").alias("groups"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.every("right").alias("exact"))
    return by.select(owner, "groups", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"), "exact")


def owner_of_text(texts: DataFrame, owners: DataFrame, text: str, owner: str) -> DataFrame:
    """Texts with the one owner whose name they contain; null where none or several do.

    Names are looked for as runs of the text's words, joined by equality: each
    text gives its runs of as many words as names have, at most NAME_WORDS.
    """
    names = owners.select(owner, F.lower(F.trim(owner)).alias("_name")).distinct()
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'-]+"), lambda x: x != "")
    runs = F.flatten(F.array(*[grams(w, n) for n in range(1, NAME_WORDS + 1)]))
    found = texts.select(text, F.explode(F.array_distinct(runs)).alias("_name")).distinct().join(names, "_name").groupBy(text).agg(F.when(F.countDistinct(owner) == 1, F.first(owner)).alias("owner"))
    return texts.join(found, text, "left")


def label_clusters(members: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Members with the one label of their cluster, given back to all of them; null where it has none yet."""
    once = labels.groupBy(*keys).agg(F.min("schema").alias("schema"))
    return members.join(once, keys, "left")
