"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, spread
from palimpsest.llm.cube_spark import balanced_sample

#: Folder of the public tokenizers' files, and the vocabulary used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a plan table that all tasks get; more are joined by a shuffle, the documents of a source over SALTS parts.
PLAN_ROWS, SALTS = 100_000, 64
#: Characters from which on a text is handed to the tokenizer in several parts, cut where the pattern cuts it anyway.
PART = 100_000
#: Documents that the landing rounds against the balance of tokens at most: one for each balancing total.
LANDED = 2

_loaded: dict[str, object] = {}


def _encoding(path: str):
    """The encoding of a vocabulary file, made once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """Parts of a text, cut only where the pattern cuts it, so that their tokens are those of the whole text.

    A part has at most ``size`` characters, unless one match of the pattern has
    more. Behind white space no cut is made, as there the pattern looks ahead.
    """
    start = end = 0
    for m in regex.finditer(PATTERN, text):
        if m.end() - start > size and end > start:
            yield text[start:end]
            start = end
        if not m.group()[-1].isspace():
            end = m.end()
    yield text[start:]


def _merged(path: str, piece: str) -> int:
    """Tokens of one long match of the pattern, merged as a whole."""
    return len(_encoding(path)._core_bpe.encode_single_piece(piece.encode()))


def count_tokens(documents: DataFrame, key: str, text: str, carry: list[str], tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, *carry, tokens): the tokens of each whole text; null and empty have 0."""
    path = f"{tokenizers}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            counts = []
            for t in b.column("_text").to_pylist():
                if not t:
                    counts.append(0)
                elif len(t) <= PART:
                    counts.append(len(encode(t)))
                else:
                    counts.append(sum(len(encode(part)) if len(part) <= PART else _merged(path, part) for part in parts_of(t)))
            columns = [b.column(c) for c in [key, *carry]] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *carry, "tokens"])

    rows = documents.select(key, *carry, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(key, *carry).schema.fields)
    return spread(rows).mapInArrow(run, f"{schema}, tokens long")


def mix_sources(documents: DataFrame, plans: DataFrame, seed: int = 7, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """Fill each plan's budget from its sources at their target shares.

    documents: (doc_id, source, text); plans: rows (plan_id, source,
    target_share, max_repeats, budget_ratio). The budget of a plan is
    ``budget_ratio`` times the tokens of all documents, those without a source
    or text included. A source gives each of its documents ``floor(r)`` times
    and a balanced draw of them once more, r being its wanted tokens over the
    tokens it has, at most ``max_repeats``. The draw is the cube method, each
    document with the fraction of r as its probability, balanced on the tokens
    and the number of documents. Nulls in a plan count as 0.

    Returns (mix, report). mix: (plan_id, source, doc_id, copies). report, one
    row for each plan row: tokens there, wanted and reached, the share reached
    of the whole mix, ``residual`` (reached less wanted, in tokens) and
    ``short``, which the draw shows: it gave all documents ``max_repeats`` times
    and still lacks tokens, or lacks more than the landing can leave open (the
    tokens of LANDED of the largest documents); just so where more is wanted than
    max_repeats allow. A source without documents is short when anything is
    wanted of it.
    """
    counted = cut(count_tokens(documents, "doc_id", "text", ["source"], tokenizers))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("there"), F.count("*").alias("documents"), F.max("tokens").alias("largest"))
    whole = sizes.agg(F.coalesce(F.sum("there"), F.lit(0)).alias("all_tokens"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "budget_ratio")]
    state = (
        plans.select("plan_id", "source", *zero)
        .join(sizes, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .withColumns({"there": F.coalesce("there", F.lit(0)), "documents": F.coalesce("documents", F.lit(0)), "largest": F.coalesce("largest", F.lit(0))})
        .withColumn("wanted", F.col("target_share") * F.col("budget_ratio") * F.col("all_tokens"))
        .withColumn("rate", F.least(F.coalesce(F.try_divide("wanted", "there"), F.lit(0.0)), F.col("max_repeats").cast("double")))
        .withColumns({"times": F.floor("rate"), "pi": F.col("rate") - F.floor("rate")})
    )
    state = cut(state)  # a row for each plan row
    use = state.where("rate > 0").select("plan_id", "source", "times", "pi", "documents")
    few = state.count() <= PLAN_ROWS

    def of_plan(rows: DataFrame) -> DataFrame:
        if few:
            return counted.join(F.broadcast(rows), "source")
        salted = rows.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        return counted.withColumn("_salt", F.expr(f"pmod(xxhash64(doc_id), {SALTS})")).join(salted, ["source", "_salt"]).drop("_salt")

    open_ = of_plan(use.where("pi > 0"))
    balance = open_.select("plan_id", "source", "doc_id", "pi", "documents", (F.col("tokens") * F.col("pi")).alias("x_tokens"), F.col("pi").alias("x_count"))
    drawn = balanced_sample(balance, ["plan_id", "source"], "doc_id", "pi", ["x_tokens", "x_count"], "documents", seed)
    sure = of_plan(use.where("times > 0")).select("plan_id", "source", "doc_id", F.col("times").cast("long").alias("copies"))
    mix = sure.unionByName(drawn.withColumn("copies", F.lit(1).cast("long"))).groupBy("plan_id", "source", "doc_id").agg(F.sum("copies").alias("copies"))
    # Tokens reached: all documents so many times, and those drawn once more.
    extra = drawn.join(counted.select("doc_id", "tokens"), "doc_id").groupBy("plan_id", "source").agg(F.sum("tokens").alias("extra"))
    report = state.join(extra, ["plan_id", "source"], "left").withColumn("reached", F.col("times") * F.col("there") + F.coalesce("extra", F.lit(0)))
    totals = report.groupBy("plan_id").agg(F.sum("reached").alias("in_all"))
    lacking = F.col("wanted") - F.col("reached")
    report = report.join(totals, "plan_id").select(
        "plan_id",
        "source",
        "there",
        "documents",
        F.round("wanted", 3).alias("wanted"),
        F.col("reached").cast("long").alias("reached"),
        "target_share",
        F.round(F.coalesce(F.try_divide("reached", "in_all"), F.lit(0.0)), 6).alias("share"),
        F.round(F.col("reached") - F.col("wanted"), 3).alias("residual"),
        ((lacking > 0) & ((F.col("reached") == F.col("max_repeats") * F.col("there")) | (lacking > LANDED * F.col("largest")))).alias("short"),
    )
    return mix, report
