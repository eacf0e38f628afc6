"""Problem 5: splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import spread

# Marks that end a sentence, those of Japanese included.
SENTENCE_MARKS = ".!?。！？．｡…‼⁇⁈⁉"
#: Penalties of a cut: at a paragraph, a line, a sentence, a space, behind a mark without a space, inside a stretch.
PARAGRAPH, LINE, SENTENCE, SPACE, MARK, FORCED = 0.0, 0.2, 0.4, 1.0, 1.2, 50.0
#: Weight of a piece's missing size, as the square of its share of the limit.
IMBALANCE = 1.0
#: Size limits that all tasks get; more are joined by a shuffle.
FEW_LIMITS = 10_000

_BOUNDARY = re.compile(rf"(?P<paragraph>\s*\n\s*\n\s*)|(?P<line>[^\S\n]*\n\s*)|(?P<sentence>(?<=[{SENTENCE_MARKS}])[\"'”’)\]」]*\s+)|(?P<space>\s+)|(?P<mark>(?<=[{SENTENCE_MARKS}])(?=[^\s{SENTENCE_MARKS}]))")
_COST = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "space": SPACE, "mark": MARK}
_STRETCH = re.compile(rf"[^\s{SENTENCE_MARKS}]+")
#: A forced cut isn't made before such a character, as it belongs to the one before it.
_JOINED = re.compile("[\u0300-\u036f\u200d\ufe00-\ufe0f\u3099\u309a\u20d0-\u20ff]")


def longest_stretch(text: str) -> int:
    """Code points of the longest stretch without white space or sentence-ending mark."""
    return max((m.end() - m.start() for m in _STRETCH.finditer(text)), default=0)


def best_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of a text above the limit.

    Each piece has at most ``limit`` code points, each but the first starts
    ``overlap`` before the end of the one before. Among all such chains of
    boundary positions the cheapest is taken: the cut penalties plus the square
    of each piece's missing share of the mean size that this number of pieces
    has. Positions inside a stretch are offered only where no natural boundary
    is within reach. The last piece's kind is "end".
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    if limit <= 0 or overlap < 0 or overlap >= limit:
        raise ValueError("0 <= overlap < limit is needed")
    step = limit - overlap
    costs = {m.end(): (_COST[m.lastgroup], m.lastgroup) for m in _BOUNDARY.finditer(text) if 0 < m.end() < n}
    natural = sorted(costs)
    mean = overlap + (n - overlap) / -(-(n - overlap) // step)
    # Forced positions: reach after reach inside gaps that are wider than a step.
    last = 0
    for p in [*natural, n]:
        while p - last > step:
            q = last + step
            while q > last + 1 and _JOINED.match(text[q]):
                q -= 1
            last = q if not _JOINED.match(text[q]) else last + step
            costs[last] = (FORCED, "forced")
        last = p
    positions = np.array([0, *sorted(costs), n])
    starts = np.where(positions > 0, positions - overlap, 0)
    best = np.full(len(positions), np.inf)
    best[0], back = 0.0, np.zeros(len(positions), int)
    best_from = best.copy()  # without the positions from which a piece would bring nothing new
    low = 0
    for j in range(1, len(positions)):
        e = int(positions[j])
        while starts[low] < e - limit:
            low += 1
        short = (mean - (e - starts[low:j])) / limit
        total = best_from[low:j] + IMBALANCE * short * short
        i = int(np.argmin(total))
        best[j] = total[i] + (0.0 if e == n else costs[e][0])
        back[j] = low + i
        if e > overlap:
            best_from[j] = best[j]
    chain = deque()
    j = len(positions) - 1
    while j:
        i = int(back[j])
        e = int(positions[j])
        chain.appendleft((int(starts[i]), e, "end" if e == n else costs[e][1]))
        j = i
    return list(chain)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """:func:`best_cuts` over a whole text, of any length."""
    return best_cuts(text, limit, overlap)


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Cut the items that are longer than their kind's limit into pieces.

    items: (item_kind, row_id, turn_idx, text); limits: (item_kind, max_chars,
    overlap_chars), the overlap below the limit, a null overlap counting as 0.
    Items at or below the limit, null and empty texts and kinds without a limit
    give no row. Sizes are in code points.

    Returns (item_kind, row_id, turn_idx, piece, start, end, cut_at, text,
    item_cut): ``cut_at`` is the boundary at the piece's end (paragraph, line,
    sentence, space, mark, forced or end); ``item_cut`` is forced for an item
    with a stretch longer than max_chars that holds neither white space nor a
    sentence-ending mark, else natural. A stretch between max_chars less
    overlap and max_chars makes a forced ``cut_at`` in a natural item, as the
    overlap is always kept.

    Only oversized texts leave the JVM; they are found by their length in the
    scan and spread over all tasks.
    """
    bounds = limits.where("max_chars IS NOT NULL").select("item_kind", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    if bounds.limit(FEW_LIMITS + 1).count() <= FEW_LIMITS:
        bounds = F.broadcast(bounds)
    long_ = items.select("item_kind", "row_id", "turn_idx", "text").join(bounds, "item_kind").where(F.length("text") > F.col("max_chars")).select("item_kind", "row_id", "turn_idx", "text", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, row, turn, text, limit, overlap in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                cut = "forced" if longest_stretch(text) > limit else "natural"
                for k, (s, e, at) in enumerate(split_text(text, limit, overlap)):
                    out.append((kind, row, turn, k, s, e, at, text[s:e], cut))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names=names)

    names = ["item_kind", "row_id", "turn_idx", "piece", "start", "end", "cut_at", "text", "item_cut"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return spread(long_, always=True).mapInArrow(run, "item_kind string, row_id long, turn_idx int, piece int, start int, end int, cut_at string, text string, item_cut string")


def text_items(contextual: DataFrame, parametric: DataFrame) -> DataFrame:
    """(item_kind, row_id, turn_idx, text) of all turns and prompts."""
    turns = contextual.select("row_id", F.posexplode(F.transform("dialogue_turns", lambda t: t["content"])).alias("turn_idx", "text"))
    prompts = parametric.select("row_id", F.lit(-1).alias("turn_idx"), F.col("record.prompt").alias("text"))
    return turns.select(F.lit("content").alias("item_kind"), "row_id", "turn_idx", "text").unionByName(prompts.select(F.lit("prompt").alias("item_kind"), "row_id", "turn_idx", "text"))
