"""Set functions over the words of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import SLOT_WORDS, focus_tokens, years


def overlap_metrics(answer: Column, candidate: Column) -> Column:
    """struct(recall, precision, f1) of the focus tokens of an answer against a candidate; zeros where one has none."""
    a, c = focus_tokens(answer), focus_tokens(candidate)
    both = F.size(F.array_intersect(a, c)).cast("double")
    recall = F.when(F.size(c) > 0, both / F.size(c)).otherwise(0.0)
    precision = F.when(F.size(a) > 0, both / F.size(a)).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return F.struct(F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def matched_components(text: Column, components: Column, least: float = 0.5) -> Column:
    """How many components have at least ``least`` of their focus tokens in a text, without those that only scaffold a slot; those without tokens don't match."""
    t, scaffold = focus_tokens(text), F.array(*[F.lit(w) for w in SLOT_WORDS])
    own = F.transform(F.coalesce(components, F.array().cast("array<string>")), lambda c: F.array_except(focus_tokens(c), scaffold))
    return F.size(F.filter(own, lambda o: (F.size(o) > 0) & (F.size(F.array_intersect(o, t)) >= least * F.size(o))))


def year_recall(component: Column, text: Column) -> Column:
    """Share of a component's years that a text names; null for a component without years."""
    y = years(component)
    return F.when(F.size(y) > 0, F.size(F.array_intersect(y, years(text))) / F.size(y))


def covered_by_others(values: Column, others: Column) -> Column:
    """Whether every value is among the others; false for an empty array."""
    return (F.size(values) > 0) & (F.size(F.array_except(values, others)) == 0)
