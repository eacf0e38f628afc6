"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chunking, group_split, leakage, lookalike, mixing, pair_defects, split_overlap
from palimpsest.llm.common import cut, table
from palimpsest.llm.proportion_sample import dialogue_members, sample_to_shares, summary_members, task_type
from palimpsest.llm.sql import ORACLES
from palimpsest.llm.sql import p8_found as look_alike_sql

Query = Callable[[SparkSession, str], DataFrame]


def _shares(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    members = dialogue_members(table(spark, folder, "dialogue_records")).unionByName(summary_members(table(spark, folder, "parametric_taskwise_summary")))
    return sample_to_shares(members, table(spark, folder, "task_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    # ``short`` is read off the draw.
    return cut(_shares(spark, folder)[1]).where("short").select("plan_id", "task_type")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder)[1]


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder)[0]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = split_overlap.overlaps(table(spark, folder, "parametric_eval_records"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "parametric_eval_records")
    return split_overlap.overlap_report(records, split_overlap.overlap_classes(records))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, train, key, links): each record that can be compared, its class of equal texts and its number of links."""
    return split_overlap.overlap_classes(table(spark, folder, "parametric_eval_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tasks = pair_defects.task_pairs(table(spark, folder, "dialogue_records"))
    return pair_defects.find_defects(tasks.unionByName(pair_defects.record_pairs(table(spark, folder, "parametric_eval_records"))))


def _ties(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    m = F.col("record.metadata")
    keys = {"character": group_split.name_key(m["character"]), "dialogue": group_split.id_key(m["dialogue_id"])}
    return group_split.tie(table(spark, folder, "parametric_eval_records"), "row_id", keys)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    _, nodes = _ties(spark, folder)
    name = F.concat(F.lit("character:"), group_split.name_key(F.col("profile.name")))
    personas = table(spark, folder, "seed_bank").select("index", name.alias("node")).join(nodes, "node").select("index", "component")
    a, b = personas.alias("a"), personas.alias("b")
    same = (F.col("a.component") == F.col("b.component")) & (F.col("a.index") < F.col("b.index"))
    return a.join(b, same).select(F.col("a.index").alias("index_a"), F.col("b.index").alias("index_b")).distinct()


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, split_name) of every record."""
    records = table(spark, folder, "parametric_eval_records")
    members, _ = _ties(spark, folder)
    members = cut(members)
    labels = records.select(F.col("row_id").alias("row"), task_type(F.col("record.metadata.task_type")).alias("label"))
    placed = group_split.assign_splits(members, labels, table(spark, folder, "split_targets"))
    return members.join(placed, "component").select(F.col("row").alias("row_id"), "split_name")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(split_name, target_share, met, torn): whether the split's rows are off its share by no more than one per cent and the largest component, and how many keys other splits have too."""
    members, nodes = _ties(spark, folder)
    members = cut(members)
    labels = table(spark, folder, "parametric_eval_records").select(F.col("row_id").alias("row"), task_type(F.col("record.metadata.task_type")).alias("label"))
    targets = table(spark, folder, "split_targets")
    placed = cut(group_split.assign_splits(members, labels, targets))
    rows = placed.groupBy("split_name").agg(F.sum("rows").alias("rows"))
    whole = placed.agg(F.sum("rows").alias("whole"), F.max("rows").alias("largest"))  # one row
    of_key = nodes.join(placed, "component").groupBy("node").agg(F.min("split_name").alias("split_name"), F.max("split_name").alias("other"))
    torn = of_key.where("split_name <> other").groupBy("split_name").agg(F.count("*").alias("torn"))
    off = F.abs(F.coalesce("rows", F.lit(0)) - F.col("target_share") * F.col("whole"))
    report = targets.join(rows, "split_name", "left").join(torn, "split_name", "left").crossJoin(F.broadcast(whole))
    return report.select("split_name", "target_share", (off <= F.col("largest") + 0.01 * F.col("whole")).alias("met"), F.coalesce("torn", F.lit(0)).cast("long").alias("torn"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    items = chunking.text_items(table(spark, folder, "contextual_eval_records"), table(spark, folder, "parametric_eval_records"))
    return chunking.split_oversized(items, table(spark, folder, "size_limits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece = 0").select("item_kind", "row_id", "turn_idx", F.col("item_cut").alias("cut"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, leaked): each document that holds a leak with the items that leaked into it."""
    leaks = _leaks(spark, folder)
    return leaks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "words", "errors", "at"))).alias("leaked"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    # As in p1_found.
    return cut(_mix(spark, folder)[1]).where("short").select("plan_id", "source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.alike_pairs(lookalike.canonical_texts(table(spark, folder, "documents")))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, form): each document's text in its one consistent form."""
    return lookalike.canonical_texts(table(spark, folder, "documents")).select("doc_id", "form")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, task_type, members, wanted, short, landed): the report without the numbers that chance decides.

    ``landed``: the draw is less than one member off what is wanted and there.
    """
    report = _shares(spark, folder)[1]
    landed = F.abs(F.col("drawn") - F.least("wanted", "members")) < 1
    return report.select("plan_id", "task_type", "members", "wanted", "short", landed.alias("landed"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, source, documents, short, landed): the report without the numbers that chance or the tokenizer decide.

    ``landed``: the draw is no more tokens off what is wanted and can be given than LANDED of the longest documents may have.
    """
    documents = table(spark, folder, "documents")
    report = _mix(spark, folder)[1].join(table(spark, folder, "mix_targets").select("plan_id", "source", "max_repeats"), ["plan_id", "source"])
    most = documents.agg(F.max(F.octet_length("text")).alias("most"))  # a document has no more tokens than bytes
    off = F.abs(F.col("reached") - F.least(F.col("wanted"), F.coalesce("max_repeats", F.lit(0)) * F.col("there")))
    return report.crossJoin(F.broadcast(most)).select("plan_id", "source", "documents", "short", (off <= mixing.LANDED * F.col("most")).alias("landed"))  # one row


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, "p8_found": look_alike_sql()}
