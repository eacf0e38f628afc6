"""Dialogues as turns and tasks, and what is built from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import or_missing, strip, tokens_by_four

CHUNKS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "tokens")]))


def turn_line(turn: Column) -> Column:
    """"role: content" of a turn; role and content fall back on speaker and message where null or empty."""
    return F.concat(or_missing_role(turn), F.lit(": "), strip(or_missing_content(turn)))


def or_missing_role(turn: Column) -> Column:
    return F.coalesce(or_missing(turn["role"], turn["speaker"]), F.lit("speaker"))


def or_missing_content(turn: Column) -> Column:
    return F.coalesce(or_missing(turn["content"], turn["message"]), F.lit(""))


def spoken(turns: Column) -> Column:
    """The turns that say anything: null and blank ones left out."""
    return F.filter(F.coalesce(turns, F.array().cast(turns_type())), lambda t: t.isNotNull() & (F.length(strip(or_missing_content(t))) > 0))


def turns_type() -> str:
    return "array<struct<role:string,speaker:string,content:string,message:string>>"


def render(turns: Column) -> Column:
    """A dialogue as text, a line for each spoken turn; '' for none."""
    return F.array_join(F.transform(spoken(turns), turn_line), "\n")


def turn_rows(dialogues: DataFrame, key: str, turns: str = "dialogue") -> DataFrame:
    """(key, pos, role, content, line, tokens) of the spoken turns, numbered from 0."""
    lines = dialogues.select(key, F.posexplode(spoken(F.col(turns))).alias("pos", "t"))
    t = F.col("t")
    return lines.select(key, "pos", or_missing_role(t).alias("role"), strip(or_missing_content(t)).alias("content"), turn_line(t).alias("line")).withColumn("tokens", tokens_by_four(F.col("line")))


def task_rows(dialogues: DataFrame, key: str, tasks: str = "tasks_covered") -> DataFrame:
    """(key, task_idx, task) of the tasks, numbered from 0 by their place; null tasks left out."""
    return dialogues.select(key, F.posexplode(tasks).alias("task_idx", "task")).where("task IS NOT NULL")


@F.pandas_udf(CHUNKS)
def greedy_spans(tokens: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
    """Chunks of turns within a token budget; see :func:`greedy_chunks`."""
    out = []
    for sizes, limit, back in zip(tokens, most, overlap, strict=True):
        sizes = [] if sizes is None else [int(x) for x in sizes]
        spans, start = [], 0
        while start < len(sizes):
            end, total = start, 0
            while end < len(sizes) and (end == start or total + sizes[end] <= limit):
                total += sizes[end]
                end += 1
            spans.append({"start": start, "end": end - 1, "tokens": total})
            if end >= len(sizes):
                break
            start = max(start + 1, end - int(back))
        out.append(spans)
    return pd.Series(out)


def greedy_chunks(dialogues: DataFrame, key: str, most: int, overlap: int = 0, turns: str = "dialogue") -> DataFrame:
    """(key, chunk, start, end, tokens): spans of spoken turns within ``most`` tokens.

    A chunk takes turns while the budget lasts, at least one, so an oversized
    turn is a chunk of its own. The next one starts ``overlap`` turns before the
    end of the last, but behind its start. Ends are inclusive. Dialogues
    without a spoken turn have no chunk. The fold runs within one row.
    """
    sizes = F.transform(spoken(F.col(turns)), lambda t: tokens_by_four(turn_line(t)))
    spans = dialogues.select(key, F.posexplode(greedy_spans(sizes, F.lit(most), F.lit(overlap))).alias("chunk", "s"))
    return spans.select(key, "chunk", "s.start", "s.end", "s.tokens")


def sliding_chunks(turns: DataFrame, key: str, most: int, overlap: int) -> DataFrame:
    """(key, chunk, start, end, tokens): turns that hopping token windows touch.

    turns: (key, pos, tokens). Windows of ``most`` tokens start every ``most -
    overlap``; a window takes the turns that it touches, whole, so ``tokens``
    may exceed it. Equal spans count once, chunks are numbered by their first
    window. A turn finds its windows by arithmetic, so no join is needed.
    """
    if not 0 <= overlap < most:
        raise ValueError("0 <= overlap < most is needed")
    stride = most - overlap
    w = Window.partitionBy(key).orderBy("pos")
    ends = turns.withColumn("_end", F.sum("tokens").over(w)).withColumn("_total", F.sum("tokens").over(Window.partitionBy(key)))
    ends = ends.withColumn("_start", F.col("_end") - F.col("tokens"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_total") - most) / stride))
    # Windows k with k * stride < end and k * stride + most > start.
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - most) / stride) + 1)
    upto = F.least(last, F.ceil(F.col("_end") / stride) - 1)
    hit = ends.withColumn("_k", F.explode(F.when(first <= upto, F.sequence(first.cast("int"), upto.cast("int"))).otherwise(F.array().cast("array<int>"))))
    spans = hit.groupBy(key, "_k").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("tokens").cast("int").alias("tokens"))
    once = spans.groupBy(key, "start", "end").agg(F.min("_k").alias("_k"), F.first("tokens").alias("tokens"))
    return once.withColumn("chunk", F.row_number().over(Window.partitionBy(key).orderBy("_k")) - 1).select(key, "chunk", "start", "end", "tokens")


def degenerate(content: Column, repeats: int = 4, least: int = 6) -> Column:
    """Whether a turn says one word ``repeats`` times in a row; turns of fewer than ``least`` words don't count."""
    w = F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"\s+"), lambda x: x != "")
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(acc["w"] == x, acc["n"] + 1).otherwise(1)
        return F.struct(x.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    return (F.size(w) >= least) & (F.aggregate(w, start, step, lambda a: a["most"]) >= repeats)


def insert_turns(dialogues: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """(key, pos, role, content): dialogues with patches put in.

    dialogues: (key, pos, role, content), pos from 0; patches: (key, insert_at,
    seq, role, content). A patch stands before the turn that had its place;
    places beyond the end count as the end, below 0 as 0; patches of one place
    keep the order of ``seq``.
    """
    sizes = dialogues.groupBy(key).agg(F.count("*").alias("_n"))
    put = patches.join(sizes, key).select(key, F.least(F.greatest("insert_at", F.lit(0)), "_n").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").alias("_seq"), "role", "content")
    own = dialogues.select(key, F.col("pos").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_seq"), "role", "content")
    w = Window.partitionBy(key).orderBy("_at", "_kind", "_seq")
    return own.unionByName(put).select(key, (F.row_number().over(w) - 1).alias("pos"), "role", "content")


def keyword_windows(turns: DataFrame, key: str, keywords: list[str], width: int) -> DataFrame:
    """(key, pos, hits): how many keywords stand in the turns from ``width`` before to ``width`` - 1 behind each turn."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-width, width - 1)
    near = F.lower(F.array_join(F.collect_list("content").over(w), " "))
    hits = sum((F.contains(near, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return turns.select(key, "pos", hits.alias("hits"))


def neighbours(turns: DataFrame, key: str, chosen: Column, cap: int) -> DataFrame:
    """(key, positions): turns that ``chosen`` holds for and those next to them, the first ``cap`` in order."""
    bounds = turns.groupBy(key).agg(F.max("pos").alias("_last"))
    near = turns.where(chosen).select(key, F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"))
    inside = near.join(bounds, key).where("pos >= 0 AND pos <= _last").distinct()
    return inside.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("pos")), 1, cap).alias("positions"))


def anchors(dialogues: DataFrame, key: str) -> DataFrame:
    """(key, task_idx, part, kind, text): what a dialogue must tell, a setup and the fragments of each task.

    Fragments are a task's components, its gold answer where it has none; the
    setup, part -1, is its query. Null texts stay as rows.
    """
    tasks = task_rows(dialogues, key)
    parts = F.when(F.size("task.answer_components") > 0, F.col("task.answer_components")).otherwise(F.array("task.gold_answer"))
    pieces = tasks.select(key, "task_idx", F.posexplode(parts).alias("part", "text")).withColumn("kind", F.lit("fragment"))
    setup = tasks.select(key, "task_idx", F.lit(-1).alias("part"), F.col("task.query").alias("text"), F.lit("setup").alias("kind"))
    return pieces.select(key, "task_idx", "part", "kind", "text").unionByName(setup.select(key, "task_idx", "part", "kind", "text"))


def spread_anchors(found: DataFrame, key: str, segments: int, order: Column, start: float = 0.1, end: float = 0.9) -> DataFrame:
    """Anchors with the segment in which each is told, from 1.

    Fragments are spread evenly, in ``order``, over the segments from ``start``
    to ``end`` of all; a task's setup comes one segment before its first
    fragment, at the earliest in the first segment.
    """
    fragments = found.where("kind = 'fragment'")
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(order, "task_idx", "part"))
    share = F.lit(start) + (F.lit(end) - F.lit(start)) * (at - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    told = fragments.withColumn("segment", F.least(F.lit(segments), F.floor(share * segments) + 1).cast("int"))
    first = told.groupBy(key, "task_idx").agg(F.min("segment").alias("_first"))
    setup = found.where("kind = 'setup'").join(first, [key, "task_idx"]).withColumn("segment", F.greatest(F.lit(1), F.col("_first") - 1)).drop("_first")
    return told.unionByName(setup)


def outlines(placed: DataFrame, dialogues: DataFrame, key: str, segments: int) -> DataFrame:
    """(key, segment, kind, anchors): an outline row for every segment of every dialogue.

    The first is the opening, the last the closing, one with anchors info, any
    other filler.
    """
    grid = dialogues.select(key, F.explode(F.sequence(F.lit(1), F.lit(segments))).alias("segment"))
    counts = placed.groupBy(key, "segment").agg(F.count("*").alias("anchors"))
    rows = grid.join(counts, [key, "segment"], "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))
    kind = F.when(F.col("segment") == 1, "opening").when(F.col("segment") == segments, "closing").when(F.col("anchors") > 0, "info").otherwise("filler")
    return rows.select(key, "segment", kind.alias("kind"), "anchors")


def later_keywords(placed: DataFrame, key: str, words_of: Column, most: int = 15) -> DataFrame:
    """(key, segment, forbidden): up to ``most`` distinct keywords of all later segments, which an earlier one must not tell."""
    by = placed.select(key, "segment", F.explode(words_of).alias("_w")).groupBy(key, "segment").agg(F.array_sort(F.collect_set("_w")).alias("_ws"))
    w = Window.partitionBy(key).orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    return by.select(key, "segment", F.slice(F.array_distinct(F.flatten(F.collect_list("_ws").over(w))), 1, most).alias("forbidden"))


def length_targets(written: Column, segments: int, total: int, low: int = 900, high: int = 1100) -> Column:
    """The size that each further segment should have, given the sizes written so far, as an array.

    After each segment what is left of ``total`` is shared out evenly over the
    segments to come, within ``low`` and ``high``.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        i, s = a["i"] + 1, a["sum"] + n.cast("long")
        target = F.least(F.lit(high), F.greatest(F.lit(low), F.round((F.lit(total) - s) / F.greatest(F.lit(segments) - i, F.lit(1)), 0))).cast("int")
        return F.struct(i.alias("i"), s.alias("sum"), F.array_append(a["out"], target).alias("out"))

    return F.aggregate(written, start, step, lambda a: a["out"])


def chunks(dialogues: DataFrame, key: str, most: int, mode: str = "greedy", overlap: int = 0) -> DataFrame:
    """Chunks by turns ("greedy", overlap in turns) or by windows ("sliding", overlap in tokens)."""
    if mode == "greedy":
        return greedy_chunks(dialogues, key, most, overlap)
    if mode == "sliding":
        return sliding_chunks(turn_rows(dialogues, key), key, most, overlap)
    raise ValueError(f"unknown mode {mode}")
