"""Problem 2: the same or nearly the same records in several splits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, spread
from palimpsest.llm.fold import loose_words, table_form
from palimpsest.llm.group_split import name_key
from palimpsest.llm.pair_defects import asked_in

#: Word edits between two questions: this share of the first words of one, and one more for so many further words.
EDITED_SHARE, FIRST_WORDS, WORDS_FOR_EDIT = 0.4, 15, 50
#: Pairs from which on a segment counts as hot and is refined by rare words, and the parts into which a refined one is split.
HOT_PAIRS, SALTS = 250_000, 8
#: Share of an answer's words that may be edited, besides misspelled ones.
ANSWER_EDITS = 0.1

# Polite or leading words around a question or an answer that don't change it.
COURTESIES = [
    x.split()
    for x in (
        "so|well|ok|okay|now|hi|hello|hey|please|please tell me|tell me|kindly|can you tell me|could you tell me|do you know|quick question|a quick question|from memory|as far as you recall|one more question|question|q|"
        "thanks|thank you|thanks a lot|many thanks|be exact|be brief|be precise|please be exact|please be brief|short|in short|briefly|short please|exactly|that is all|thats all|that is it|answer|the answer|the answer is|a|final answer|response|reply|bitte|danke|merci|por favor|gracias|svp"
    ).split("|")
]
_HEADS: dict[str, list[list[str]]] = {}
_TAILS: dict[str, list[list[str]]] = {}
for _x in sorted(COURTESIES, key=len, reverse=True):
    if _x != ["a"]:
        _HEADS.setdefault(_x[0], []).append(_x)
        _TAILS.setdefault(_x[-1], []).append(_x)
# Words that may be exchanged, added or left out without changing what is said.
SMALL_WORDS = set("a an the this that these those and or of to in on at by for with from as is was were are be been being had has have did does do it its who which what person one then so also just very".split())
SAME_WORDS = {"&": "and", "which": "who", "that": "the", "this": "the"}

_EVENT = re.compile(r"^\D*(\d{4})\D+?0*(\d+)(\D.*)?$", re.S)


def event_key(ids: Sequence[str | None] | None) -> str:
    """One key for a list of event ids, whatever their order, repetition and spelling; empty for none."""
    found = set()
    for x in ids or ():
        x = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x or "")).strip().lower()
        if x:
            m = _EVENT.match(x)
            found.add(f"{m[1]}_e{m[2]}{(m[3] or '').strip()}" if m else x)
    return ",".join(sorted(found))


def bare_words(text: str | None) -> list[str]:
    """The words of a text in loose form, courtesies at both ends taken off."""
    words = loose_words((text or "").replace("&", " and "))
    changed = True
    while changed and words:
        changed = False
        for x in _HEADS.get(words[0], ()):
            if len(x) < len(words) and words[: len(x)] == x:
                words, changed = words[len(x) :], True
                break
        for x in _TAILS.get(words[-1], ()):
            if len(x) < len(words) and words[-len(x) :] == x:
                words, changed = words[: -len(x)], True
                break
    return words


def edits_for(n: int) -> int:
    """Word edits allowed for a question of n words."""
    return max(1, int(EDITED_SHARE * min(n, FIRST_WORDS)) + max(0, n - FIRST_WORDS) // WORDS_FOR_EDIT)


def changes_for(n: int) -> int:
    """Changed words that the verification may accept in a question of n words: as a misspelled one counts half, twice the edits."""
    return 2 * edits_for(n)


def most_changes(m: int) -> int:
    """Changed words against the longest question that one of m words may come from."""
    n = m
    while n + 1 - edits_for(n + 1) <= m:
        n += 1
    return changes_for(n)


def segments(words: Sequence[str], k: int) -> list[tuple[int, list[str]]]:
    """(start, words) of the k + 1 segments, of nearly equal length, the shorter ones first."""
    n = len(words)
    least, longer = divmod(n, k + 1)
    result, at = [], 0
    for s in range(k + 1):
        size = least + (s >= k + 1 - longer)
        result.append((at, list(words[at : at + size])))
        at += size
    return result


def places(n: int, m: int, k: int, s: int, start: int, size: int, lone: int | None = None) -> range:
    """Where segment s of a string of n words may stand in one of m words within k edits.

    Left of a matching segment at most s edits can be, right of it at most
    k - s; this is the multi-match-aware choice of positions. Where only
    ``lone`` of the edits can be insertions and deletions, those on both sides
    together are no more.
    """
    d = m - n
    spare = k if lone is None else (lone - abs(d)) // 2
    low = max(0, start - s, start + d - (k - s), start + min(0, d) - spare)
    high = min(m - size, start + s, start + d + (k - s), start + max(0, d) + spare)
    return range(low, high + 1)


def typo(a: str, b: str) -> bool:
    """Whether one word is a misspelling of the other: letters doubled, dropped, added or swapped, one or two of them.

    An exchanged letter isn't counted as such, as names differ by it.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    if len(a) == len(b):  # swapped neighbours
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) in (2, 4) and all(d[i + 1] == d[i] + 1 and a[d[i]] == b[d[i + 1]] and a[d[i + 1]] == b[d[i]] for i in range(0, len(d), 2)) or (len(a) > 5 and letter_edits(a, b, 2) <= 2 and sorted(a) == sorted(b))
    return letter_edits(a, b, 1 if min(len(a), len(b)) < 6 else 2) <= (1 if min(len(a), len(b)) < 6 else 2)


def letter_edits(a: str, b: str, k: int) -> int:
    """Insertions and deletions between two words, by banded dynamic programming; above k is k + 1."""
    return _banded(a, b, k, lambda x, y: 0 if x == y else 2, lambda x: 1)


def _banded(a, b, k: float, swap, lone) -> float:
    """Weighted edit distance in the band of width k around the diagonal; anything above k is k + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    width = int(k)
    far = k + 1
    before = {j: 0.0 for j in range(1)}
    total = 0.0
    for j in range(1, min(m, width) + 1):
        total += lone(b[j - 1])
        before[j] = total
    for i in range(1, n + 1):
        row = {}
        for j in range(max(0, i - width), min(m, i + width) + 1):
            best = before.get(j, far) + lone(a[i - 1])
            if j:
                best = min(best, row.get(j - 1, far) + lone(b[j - 1]), before.get(j - 1, far) + swap(a[i - 1], b[j - 1]))
            row[j] = best
        if min(row.values(), default=far) > k:
            return far
        before = row
    return min(far, before.get(m, far))


def question_edits(a: Sequence[str], b: Sequence[str], k: int) -> float:
    """Word edits between two questions; a misspelled word counts half."""
    return _banded(a, b, k, lambda x, y: 0.0 if x == y else 0.5 if typo(x, y) else 1.0, lambda x: 1.0)


def same_answer(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether two answers say the same but for spelling, form and small changes of wording.

    Numbers must agree. Misspelled words and exchanged, added or missing small
    words count little, any other word fully; at most ANSWER_EDITS of the words
    may be edited in all, at least one small word.
    """
    if list(a) == list(b):
        return True
    if sorted(w for w in a if w[0].isdigit()) != sorted(w for w in b if w[0].isdigit()):
        return False
    if not a or not b:
        return False
    limit = max(1.0, ANSWER_EDITS * min(len(a), len(b)))

    def swap(x: str, y: str) -> float:
        if x == y:
            return 0.0
        if x in SMALL_WORDS and y in SMALL_WORDS:
            return 0.25
        return 0.3 if typo(x, y) else 10.0

    return _banded(a, b, max(3.0, limit), swap, lambda x: 0.3 if x in SMALL_WORDS else 1.0 if len(a) > 12 else 10.0) <= limit


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, blocks, questions, answers = [], [], [], []
        for row, who, events, q, r in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            events, words = event_key(events), bare_words(q)
            if not who or not events or not words:
                rows.append(None)
                continue
            answer = bare_words(r)
            numbers = " ".join(sorted(w for w in answer if w[0].isdigit()))
            rows.append(row)
            blocks.append(f"{table_form(who)}|{events}|{numbers}")
            questions.append(" ".join(words))
            answers.append(" ".join(answer))
        kept = [i for i, r in enumerate(rows) if r is not None]
        side = [b.column(5)[i].as_py() for i in kept]
        yield pa.RecordBatch.from_arrays([pa.array([rows[i] for i in kept], pa.int64()), pa.array(side, pa.bool_()), pa.array(blocks, pa.string()), pa.array(questions, pa.string()), pa.array(answers, pa.string())], names=["row_id", "train", "block", "question", "answer"])


def prepared(records: DataFrame) -> DataFrame:
    """(row_id, train, block, question, answer) of the records that can be compared.

    ``block`` joins the character, the set of events and the answer's numbers,
    which must agree; the character comes from the prompt where the metadata
    have none. Records without events, character or question ask about nothing
    that could be compared and are left out.
    """
    m = F.col("record.metadata")
    query = F.when(F.length(F.trim(m["query"])) > 0, m["query"]).otherwise(asked_in(F.col("record.prompt")))
    who = F.coalesce(name_key(m["character"]), name_key(F.regexp_extract("record.prompt", r"(?m)^Person:[ \t]*(.+)$", 1)))
    rows = records.where("split_name IS NOT NULL").select("row_id", who.alias("who"), m["source_event_ids"].alias("events"), query.alias("question"), F.col("record.reference").alias("answer"), (F.trim("split_name") == "train").alias("train"))
    return spread(rows).mapInArrow(_prepare, "row_id long, train boolean, block string, question string, answer string")


def _key_of(block: str, n: int, s: int, part: Sequence[str]) -> int:
    """A hash of 64 bits of a segment in its block; a chance hit fails in the verification."""
    return xxhash.xxh64_intdigest(f"{block}|{n}|{s}|{' '.join(part)}")


def _eval_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, found = [], []
        for key, block, question in zip(*[b.column(c).to_pylist() for c in ("key", "block", "question")], strict=True):
            words = question.split(" ")
            own = {_key_of(block, len(words), s, part) for s, (_, part) in enumerate(segments(words, changes_for(len(words))))}
            keys += [key] * len(own)
            found += own
        yield _keys(keys, found)


def _train_substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, block, question, lengths in zip(*[b.column(c).to_pylist() for c in ("key", "block", "question", "lengths")], strict=True):
            words = question.split(" ")
            m = len(words)
            own: set[int] = set()
            for n in lengths:
                k, changes = edits_for(n), changes_for(n)
                if abs(m - n) > k:
                    continue
                for s, (start, part) in enumerate(segments([""] * n, changes)):
                    size = len(part)
                    own.update(_key_of(block, n, s, words[p : p + size]) for p in places(n, m, changes, s, start, size, k))
            if own:
                yield _keys([key] * len(own), list(own))


def _keys(keys: list[str], found: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "h"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (q, r, q2, r2) in enumerate(zip(*[b.column(c).to_pylist() for c in ("qa", "ra", "qb", "rb")], strict=True)):
            x, y = q2.split(" "), q.split(" ")  # x is the evaluation's
            if question_edits(x, y, edits_for(len(x))) <= edits_for(len(x)) and same_answer(r.split(), r2.split()):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column("ta").take(pa.array(keep, pa.int32())), b.column("tb").take(pa.array(keep, pa.int32()))], names=["ta", "tb"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each question, repetitions numbered, with how many of them its prefix has."""
    for b in batches:
        keys, words, takes = [], [], []
        for key, train, question in zip(*[b.column(c).to_pylist() for c in ("key", "train", "question")], strict=True):
            own = question.split(" ")
            seen: dict[str, int] = {}
            for w in own:
                seen[w] = seen.get(w, 0) + 1
                words.append(f"{w}#{seen[w]}")
            # Questions of one or two words may share none; the empty word joins them.
            words += [""] * (len(own) <= 2)
            n = len(own) + (len(own) <= 2)
            keys += [key] * n
            takes += [(most_changes(len(own)) if train else changes_for(len(own))) + 1 + (len(own) <= 2)] * n
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(takes, pa.int32())], names=["key", "w", "take"])


def rare_words(texts: DataFrame) -> DataFrame:
    """(train, key, w): the rarest words of each question, one more than may be changed.

    Two questions within c changed words share all but c of the longer one's, so
    the c + 1 rarest of each have one in common, whatever the counts are. Words
    are counted over ``texts``; a frequent one is counted and looked up in parts.
    """
    words = cut(texts.select("train", "key", "question").mapInArrow(lambda batches: _numbered(batches), "key string, w string, take int"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    salted = words.withColumn("salt", F.expr(f"pmod(xxhash64(key), {SALTS})")).join(counts, ["w", "salt"])
    # One list for each text: as many entries as it has words.
    ordered = salted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("w") == "", F.lit(-1).cast("long")).otherwise(F.col("n")).alias("n"), "w"))).alias("ws"), F.max("take").alias("take"))
    return ordered.select("key", F.explode(F.slice("ws", F.lit(1), F.col("take"))).alias("x")).select("key", F.col("x.w").alias("w"))


def _candidates(left: DataFrame, right: DataFrame, texts: DataFrame, hot_pairs: int) -> DataFrame:
    """(ta, tb) of the texts that share a segment, (tb, h) of ``left`` and (ta, h) of ``right``.

    A segment that very many texts have on both sides, as questions of one form
    about one block do, would give all pairs of a group. Such hot segments are
    split by the rare words of their questions, of which any pair has one in
    common, and each of these over SALTS parts; no pair is lost.
    """
    counts = left.groupBy("h").agg(F.count("*").alias("nl")).join(right.groupBy("h").agg(F.count("*").alias("nr")), "h")
    hot = cut(counts.where(F.col("nl") * F.col("nr") > hot_pairs).select("h"))
    if not hot.take(1):
        return right.join(left, "h").select("ta", "tb").distinct()
    usual = right.join(hot, "h", "left_anti").join(left.join(hot, "h", "left_anti"), "h").select("ta", "tb")
    sides = [side.join(hot, "h", "left_semi").withColumnRenamed(name, "key") for side, name in ((right, "ta"), (left, "tb"))]
    mine = [texts.where(F.col("train") == t).join(side.select("key").distinct(), "key", "left_semi") for t, side in zip((True, False), sides, strict=True)]
    # A text may stand on both sides; each has its own prefix.
    marked = rare_words(mine[0].unionByName(mine[1]).withColumn("key", F.concat(F.col("key"), F.when(F.col("train"), "+").otherwise("-"))))
    refined = []
    for side, name, sign in ((sides[0], "ta", "+"), (sides[1], "tb", "-")):
        own = marked.where(F.endswith("key", F.lit(sign))).select(F.expr("left(key, length(key) - 1)").alias("key"), "w")
        refined.append(side.join(own, "key").select(F.col("key").alias(name), F.xxhash64("h", "w").alias("h")))
    a = refined[0].withColumn("salt", F.expr(f"pmod(xxhash64(ta), {SALTS})"))
    b = refined[1].withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return usual.unionByName(a.join(b, ["h", "salt"]).select("ta", "tb")).distinct()


def linked_texts(records: DataFrame, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of the records that can be compared.

    rows: (row_id, train, key), ``key`` being the class of equal texts in one
    block; links: (ta, tb) of a train and an evaluation class that say the same,
    see :func:`overlaps`.
    """
    text = F.sha2(F.concat_ws("\x1f", "block", "question", "answer"), 256)
    rows = cut(prepared(records).withColumn("key", F.substring(text, 1, 32)))
    texts = cut(rows.groupBy("train", "key").agg(F.first("block").alias("block"), F.first("question").alias("question"), F.first("answer").alias("answer")))
    held, train = texts.where("NOT train"), texts.where("train")
    lengths = held.groupBy("block").agg(F.collect_set(F.size(F.split("question", " "))).alias("lengths"))
    used = train.join(lengths, "block")
    left = cut(held.select("key", "block", "question").mapInArrow(_eval_segments, "key string, h long")).withColumnRenamed("key", "tb")
    right = cut(used.select("key", "block", "question", "lengths").mapInArrow(_train_substrings, "key string, h long")).withColumnRenamed("key", "ta")
    hits = _candidates(left, right, texts, hot_pairs)
    content = texts.select("train", "key", "question", "answer")
    a = content.where("train").select(F.col("key").alias("ta"), F.col("question").alias("qa"), F.col("answer").alias("ra"))
    b = content.where("NOT train").select(F.col("key").alias("tb"), F.col("question").alias("qb"), F.col("answer").alias("rb"))
    links = hits.join(a, "ta").join(b, "tb").select("ta", "tb", "qa", "ra", "qb", "rb").mapInArrow(_verify, "ta string, tb string")
    return rows.select("row_id", "train", "key"), cut(links)


def overlaps(records: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(train_row, eval_row): records of train that come back in an evaluation split.

    Both ask the same question about the same events of the same character and
    have the same answer, apart from spelling, form and small changes of
    wording. Repeated rows each count; rows with a null split, without events
    or without any question or character match nothing. Two missing answers
    are the same answer.

    Edit-distance segment join over words: each distinct question of an
    evaluation split is cut into 2k + 1 segments, of which at least one stands
    unchanged in a question within cost k, as a misspelled word costs half and so
    at most 2k words are changed; the train questions' substrings at
    the positions possible are joined with them, in the same block. Candidates
    are verified by banded dynamic programming. Equal records are joined once,
    as one text, and expanded at the end; train texts of blocks that no
    evaluation split has are dropped before any substring is made. A segment
    that would give more than ``hot_pairs`` pairs is split by rare words.
    """
    rows, links = linked_texts(records, hot_pairs)
    in_train = rows.where("train").select(F.col("key").alias("ta"), F.col("row_id").alias("train_row"))
    in_eval = rows.where("NOT train").select(F.col("key").alias("tb"), F.col("row_id").alias("eval_row"))
    return links.join(in_train, "ta").join(in_eval, "tb").select("train_row", "eval_row")


def overlap_classes(records: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(row_id, train, key, links) of the records that can be compared: the class of equal texts and the rows of the other side linked to it.

    Links are counted from the sizes of classes; no pair of rows is made.
    """
    rows, links = linked_texts(records, hot_pairs)
    sizes = rows.groupBy("train", "key").agg(F.count("*").alias("n"))
    counted = []
    for train, own, other in ((True, "ta", "tb"), (False, "tb", "ta")):
        of_other = sizes.where(F.col("train") != train).select(F.col("key").alias(other), "n")
        counted.append(links.join(of_other, other).groupBy(F.col(own).alias("key")).agg(F.sum("n").alias("links")).withColumn("train", F.lit(train)))
    return rows.join(counted[0].unionByName(counted[1]), ["train", "key"], "left").select("row_id", "train", "key", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def overlap_report(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts by evaluation split and source_file: (split_name, source_file, rows, overlapping, pairs).

    classes as :func:`overlap_classes` gives them. Every evaluation split and
    source file has a row, those without an overlap zeros; a null source file is
    a source of its own.
    """
    by_row = classes.where("NOT train AND links > 0").select("row_id", F.col("links").alias("n"))
    held = records.where("split_name IS NOT NULL AND trim(split_name) <> 'train'").select("row_id", "split_name", "source_file")
    return held.join(by_row, "row_id", "left").groupBy("split_name", "source_file").agg(F.count("*").alias("rows"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
