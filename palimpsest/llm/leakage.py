"""Problem 6: evaluation texts leaking into training text."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, parallelism, spread
from palimpsest.llm.fold import loose_ids, loose_words

#: Masks of the seeds: the word positions that must agree; the ones left out may differ.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
#: Consecutive words of an item that make a leak; a shorter item must stand there whole.
LEAST = 12
#: A leak has at most one altered, dropped or inserted word in so many words of the item; two in any LEAST words.
WORDS_FOR_ERROR, ERRORS = 7, 2
#: Bits of the filter of the items' seeds, as a power of two: the least, the most (16 MB), and bits for each seed.
FILTER_LEAST, FILTER_MOST, BITS_FOR_SEED = 16, 27, 512
#: Parts into which the documents that share one seed are split.
SALTS = 8
#: Items whose seeds a verifying task keeps at hand.
KEPT_ITEMS = 2_000

_EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))  # words of document and item skipped over
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _hashes(ids: np.ndarray, mask: Sequence[int], number: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows whose masked words all are in the vocabulary (ids above 0)."""
    span = mask[-1] + 1
    if len(ids) < span:
        return np.empty(0, int), np.empty(0, np.uint64)
    picked = [ids[o : len(ids) - span + 1 + o] for o in mask]
    at = np.flatnonzero(np.logical_and.reduce([p > 0 for p in picked]))
    h = np.full(len(at), number + 1, dtype=np.uint64)
    for p, f in zip(picked, _FACTORS, strict=False):
        h = (h ^ (h >> np.uint64(29))) * f + p[at].astype(np.uint64) * _FACTORS[0]
    return at, h


def seeds_of(ids: np.ndarray, owner: np.ndarray, masks: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, seed) of all windows under each mask; words of one owner stand together, ids are hashes of words."""
    places, seeds = [], []
    for mask in masks:
        n = len(ids) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, sum(1 << o for o in mask), dtype=np.uint64)
        for o, f in zip(mask, _FACTORS, strict=False):
            h = (h ^ (h >> np.uint64(29))) * f + ids[o : o + n]
        h = (h ^ (h >> np.uint64(31))) * _FACTORS[0]
        inside = np.flatnonzero(owner[:n] == owner[mask[-1] :])
        places.append(inside)
        seeds.append(h[inside])
    if not seeds:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(seeds)


def _hashed(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner) of the words of several texts in a row."""
    ids = [loose_ids(t) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return np.fromiter((w for x in ids for w in x), np.uint64, len(owner)), owner


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a seed sets."""
    most = np.uint64((1 << bits) - 1)
    return (seeds & most).astype(np.int64), ((seeds >> np.uint64(64 - bits)) & most).astype(np.int64)


class Index:
    """Seeds of a few test items."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        found: list[list[np.ndarray]] = [[], [], []]
        self.masks: list[tuple[int, ...]] = list(MASKS)
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in loose_words(text or "")]
            if not ids:
                continue
            n = len(self.items)
            self.items.append((key, ids))
            masks = enumerate(MASKS)
            if len(ids) < 4:  # found whole only
                whole = tuple(range(len(ids)))
                if whole not in self.masks:
                    self.masks.append(whole)
                masks = [(self.masks.index(whole), whole)]
            for number, mask in masks:
                at, h = _hashes(np.array(ids), mask, number)
                for store, x in zip(found, (h, np.full(len(at), n), at), strict=True):
                    store.append(x)
        h, n, at = [np.concatenate(x) if x else np.empty(0, np.uint64 if i == 0 else int) for i, x in enumerate(found)]
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.bounds = np.append(first, len(h))
        self.item_of, self.place = n[order], at[order]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the document, item, place in the item) of all agreeing seeds."""
        if not len(self.hashes):
            return
        for number, mask in enumerate(self.masks):
            at, h = _hashes(ids, mask, number)
            if not len(h):
                continue
            slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for k in np.flatnonzero(self.hashes[slot] == h):
                s = slot[k]
                for x in range(self.bounds[s], self.bounds[s + 1]):
                    yield int(at[k]), int(self.item_of[x]), int(self.place[x])


#: Words that agree one by one: first in the document, first and last in the item, words edited before them.
Run = tuple[int, int, int, int]


def _extend(doc: Sequence[int], item: Sequence[int], i: int, j: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """Go from an agreeing pair of words as far as single edits lead; (i, j, i, j, edits before) of the runs that agree, first and last pair."""
    n, m, errors = len(doc), len(item), 0
    first, runs = (i, j), []
    while True:
        a, b = i + step, j + step
        if 0 <= a < n and 0 <= b < m and doc[a] == item[b]:
            i, j = a, b
            continue
        for da, db in _EDITS:
            x, y = a + da * step, b + db * step
            # Two or three agreeing words confirm an edit, fewer only where the item ends.
            need = min(2 if da < 2 and db < 2 else 3, m - y if step > 0 else y + 1)
            if need < 1:
                continue
            ex, ey = x + (need - 1) * step, y + (need - 1) * step
            if 0 <= x < n and 0 <= y < m and 0 <= ex < n and 0 <= ey < m and all(doc[x + k * step] == item[y + k * step] for k in range(need)):
                runs.append((*first, i, j, errors))
                i, j, errors = x, y, max(da, db)
                first = x, y
                break
        else:
            return [*runs, (*first, i, j, errors)]


def _chain(doc: Sequence[int], item: Sequence[int], p: int, q: int) -> list[Run]:
    """The runs of the stretch around an agreeing pair of words, in their order."""
    back, on = _extend(doc, item, p, q, -1), _extend(doc, item, p, q, 1)
    # Backwards the edits stand behind the run that comes after them.
    runs = [(x[2], x[3], x[1], y[4]) for x, y in zip(back[:0:-1], [(0,) * 5, *back[:0:-1]], strict=False)]
    middle = (back[0][2], back[0][3], on[0][3], back[1][4] if len(back) > 1 else 0)
    return [*runs, middle, *((x[0], x[1], x[3], x[4]) for x in on[1:])]


def _window(runs: Sequence[Run], need: int) -> tuple[int, int, int] | None:
    """(words, errors, start) of the longest sequence of runs with few enough errors for its words.

    At most one error in WORDS_FOR_ERROR words or, from LEAST words on, at most ERRORS.
    """
    best: tuple[int, int, int] | None = None
    spent = 0  # errors up to the run
    before: list[int] = []
    low: list[tuple[int, int]] = []  # falling minima of first word less what the errors up to there take, negated, with their runs
    near = 0
    for t, (_, c, d, e) in enumerate(runs):
        spent += e
        before.append(spent)
        value = WORDS_FOR_ERROR * spent - c
        if not low or value > low[-1][0]:
            low.append((value, t))
        starts = []
        k = bisect_left(low, (WORDS_FOR_ERROR * spent - d - 1, -1))
        if k < len(low):
            starts.append(low[k][1])
        while spent - before[near] > ERRORS:
            near += 1
        if d - runs[near][1] + 1 >= LEAST:
            starts.append(near)
        for s in starts:
            words = d - runs[s][1] + 1
            if words >= need and (best is None or words > best[0]):
                best = words, spent - before[s], runs[s][0]
    return best


def _joined(runs: list[Run], runs2: list[Run]) -> Iterator[list[Run]]:
    """Two stretches with the interruption between them as one; where both have a word of the item, either one's is left out."""
    d, c2 = runs[-1][2], runs2[0][1]
    if c2 > d:
        yield [*runs, (*runs2[0][:3], c2 - d - 1), *runs2[1:]]
        return
    # The second begins where the first ends, at its next run if it has an edit there.
    rest = [x for x in runs2 if x[2] > d]
    if rest:
        i, c, e, _ = rest[0]
        cut_off = max(0, d + 1 - c)
        yield [*runs, (i + cut_off, c + cut_off, e, max(0, c - d - 1)), *rest[1:]]
    head = [x for x in runs if x[1] < c2]
    i, c, e, lost = head[-1]
    e = min(e, c2 - 1)
    yield [*head[:-1], (i, c, e, lost), (*runs2[0][:3], c2 - 1 - e), *runs2[1:]]


def _find(doc: Sequence[int], words: Sequence[int], low: int, high: int) -> int:
    """Where words stand in the document from ``low`` on and before ``high``, -1 if nowhere."""
    words, n = list(words), len(words)
    try:
        while True:
            x = doc.index(words[0], low, max(low, high - n + 1))
            if list(doc[x : x + n]) == words:
                return x
            low = x + 1
    except ValueError:
        return -1


def _with_end(doc: Sequence[int], item: Sequence[int], runs: list[Run], b: int, short: int) -> list[Run]:
    """A stretch with the item's next words, too few for a seed, that stand beyond an interruption."""
    d = runs[-1][2]
    at = _find(doc, item[d + 1 : d + 1 + short], b + 1, len(doc)) if d + short < len(item) else -1
    return [*runs, (at, d + 1, d + short, 0)] if at >= 0 else runs


def _with_start(doc: Sequence[int], item: Sequence[int], runs: list[Run], a: int, short: int) -> list[Run]:
    """The same for the item's words before the stretch."""
    c = runs[0][1]
    at = _find(doc, item[c - short : c], 0, a) if c >= short else -1
    return [(at, c - short, c - 1, 0), (*runs[0][:3], 0), *runs[1:]] if at >= 0 else runs


def overlap(doc: Sequence[int], item: Sequence[int], hits: Sequence[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(words, errors, start in the document) of the item's longest leak, if it has one.

    hits: places of agreeing seeds. Each is extended to a stretch of the item
    in which single words may be altered, dropped or inserted; two stretches
    that follow one another in the item count as one with an interruption.
    """
    need = min(LEAST, len(item))
    parts: list[tuple[int, int, list[Run]]] = []
    near: list[tuple[int, int, int, int, set[int]]] = []  # parts that may hold further hits; of one without a leak only those on its runs
    best: tuple[int, int, int] | None = None

    def offer(window: tuple[int, int, int] | None) -> None:
        nonlocal best
        if window and (best is None or window[0] > best[0]):
            best = window

    for p, q in sorted(hits):
        near = [x for x in near if x[1] >= p]
        if doc[p] != item[q] or any(a <= p and c <= q <= d and (not lines or q - p in lines) for a, _, c, d, lines in near):
            continue
        runs = _chain(doc, item, p, q)
        a, c, d = runs[0][0], runs[0][1], runs[-1][2]
        b = runs[-1][0] + d - runs[-1][1]
        offer(window := _window(runs, need))
        if best and best[0] == len(item) and not best[1]:
            return best  # the whole item, word by word
        near.append((a, b, c, d, set() if window else {x[1] - x[0] for x in runs}))
        parts.append((a, b, runs))
    # Each stretch once by its place in the item and its edits: the first in the document and the last, as one must end before the other begins.
    firsts: dict[tuple, tuple[int, list[Run]]] = {}
    lasts: dict[tuple, tuple[int, list[Run]]] = {}
    for a, b, runs in parts:
        shape = tuple(x[1:] for x in runs)
        firsts[shape] = min(firsts.get(shape, (b, runs)), (b, runs))
        lasts[shape] = max(lasts.get(shape, (a, runs)), (a, runs))
    after: dict[int, list[tuple[int, list[Run]]]] = defaultdict(list)
    for a, runs in lasts.values():
        after[runs[0][1]].append((a, runs))
    for b, runs in firsts.values():
        c, d = runs[0][1], runs[-1][2]
        for c2 in range(c + 1, d + 3):  # one interruption, at which a word may be lost, or the item's next words be taken for it
            for a2, runs2 in after.get(c2, ()):
                if a2 > b and runs2[-1][2] > max(d, c + (best[0] if best else need) - 2):
                    for joined in _joined(runs, runs2):
                        offer(_window(joined, need))
    if best is None:
        for shape, (b, runs) in firsts.items():
            a, runs2 = lasts[shape]
            for short in range(max(1, need - (runs[-1][2] - runs[0][1] + 1)), 4):
                offer(_window(_with_end(doc, item, runs, b, short), need))
                offer(_window(_with_start(doc, item, runs2, a, short), need))
    return best


def without_instructions(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, text) of the test items without a first sentence that others share.

    A first sentence counts as shared when items with at least two different
    continuations begin with it; of repeated items nothing is cut.
    """
    halves = items.where(F.col(text).isNotNull()).select(
        key,
        F.col(text).alias("_whole"),
        F.regexp_extract(F.col(text), r"(?s)^\s*(.*?[.!?:。！？])(\s+|$)(.*)$", 1).alias("_first"),
        F.regexp_extract(F.col(text), r"(?s)^\s*(.*?[.!?:。！？])(\s+|$)(.*)$", 3).alias("_rest"),
    )
    norm = F.lower(F.regexp_replace("_first", r"[^\p{L}\p{N}]+", ""))
    halves = halves.withColumn("_norm", norm)
    shared = halves.where("_norm <> ''").groupBy("_norm").agg((F.min("_rest") != F.max("_rest")).alias("_shared")).where("_shared")
    return halves.join(shared, "_norm", "left").select(key, F.when(F.col("_shared"), F.col("_rest")).otherwise(F.col("_whole")).alias(text))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, owner = _hashed(b.column("text").to_pylist())
        size = np.bincount(owner, minlength=b.num_rows)
        start = np.append(0, np.cumsum(size))
        at, seed = seeds_of(ids, owner, MASKS)
        keep = size[owner[at]] >= 4
        ats, seeds, lengths = [at[keep]], [seed[keep]], [np.full(int(keep.sum()), 4)]
        for n in (1, 2, 3):  # items of so few words are found whole
            short = np.flatnonzero(size[owner] == n)
            at, seed = seeds_of(ids[short], owner[short], [tuple(range(n))])
            ats.append(short[at])
            seeds.append(seed)
            lengths.append(np.full(len(at), n))
        at, seed, length = np.concatenate(ats).astype(np.int64), np.concatenate(seeds), np.concatenate(lengths)
        item = b.column("item").to_numpy(zero_copy_only=False)[owner[at]] if len(at) else np.empty(0, np.int64)
        place = at - start[owner[at]] if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(seed.view(np.int64)), pa.array(place, pa.int64()), pa.array(length, pa.int32())], names=["item", "seed", "q", "length"])


def may_leak(doc: set[str], item: Sequence[str]) -> bool:
    """Whether a document has so many of an item's words that it can hold a leak of it."""
    need = min(LEAST, len(item))
    return sum(w in doc for w in item) >= need - (ERRORS if need >= LEAST else need // WORDS_FOR_ERROR)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come document by document: the text, then a row for each item with the places of the seeds that agree."""
    items: dict[int, list[str]] = {}
    doc, words, known = None, [], set()
    for b in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for text, doc_id, item, item_text, hits in zip(*[b.column(c).to_pylist() for c in ("text", "doc_id", "item", "item_text", "hits")], strict=True):
            if item is None:
                doc, words = doc_id, loose_words(text)
                known = set(words)
                continue
            if (own := items.get(item)) is None:
                if len(items) >= KEPT_ITEMS:
                    items.clear()
                own = items[item] = loose_words(item_text)
            if may_leak(known, own) and (leak := overlap(words, own, [(h >> 32, h & 0xFFFFFFFF) for h in hits])):
                out.append((doc, item, *leak))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item", "words", "errors", "at"])


def seed_filter(seeds: DataFrame, most: int = FILTER_MOST) -> tuple[int, np.ndarray]:
    """(power of two, bits) of a Bloom filter of the items' seeds, two bits for each.

    Its size follows the number of seeds up to 2 ** ``most`` bits, whatever the
    number of items; a full filter lets more seeds through and loses none.
    """
    count = seeds.count()
    bits = min(most, max(FILTER_LEAST, int(count * BITS_FOR_SEED).bit_length()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    # At most 2 ** most / 64 words, of eight bytes each.
    words = seeds.select("seed").mapInArrow(parts, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return bits, filled.view(np.uint8)


def find_leaks(documents: DataFrame, items: DataFrame, filter_bits: int = FILTER_MOST) -> DataFrame:
    """(doc_id, item_id, words, errors, at): the test items that leaked into each document.

    documents: (doc_id, text); items: (item_id, text). A leak is an item's text
    without its shared instruction, whole or at least LEAST consecutive words of
    it, with at most one wrong word in WORDS_FOR_ERROR, or two in LEAST words, and
    one interruption; any part of a longer, worse stretch counts.
    ``words`` are the item's words covered, ``at`` the document's word where
    they begin. Null and empty texts leak nothing; repeated documents and items
    each count.

    Spaced-seed hashing: the words of items and documents are hashed under the
    same masks, and the hashes are joined. A Bloom filter of the items' seeds, at
    most 2 ** ``filter_bits`` bits whatever the number of items, goes to all tasks,
    so that a scan of the documents leaves only those with a seed that may be an
    item's; their seeds alone are shuffled, a seed's documents over SALTS parts.
    Documents and items that share a seed are verified pair by pair around all
    their hits, document by document, each text once. Items of one text are one
    item until the end.
    """
    cleaned = cut(without_instructions(items).withColumn("digest", F.sha2("text", 256)))
    distinct = cleaned.where("text <> ''").groupBy("digest").agg(F.min("item_id").cast("long").alias("item"), F.first("text").alias("text"))
    members = cleaned.select("item_id", "digest").join(distinct.select("digest", "item"), "digest").select("item", "item_id")
    distinct = cut(distinct.select("item", "text"))
    seeds = cut(spread(distinct).mapInArrow(_item_seeds, "item long, seed long, q long, length int"))
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())  # of 1 to 4
    masks = [m for n in lengths for m in (MASKS if n == 4 else [tuple(range(n))])]
    bits, filled = seed_filter(seeds, filter_bits)
    shared = documents.sparkSession.sparkContext.broadcast(filled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value
        for b in batches:
            ids, owner = _hashed(b.column("text").to_pylist())
            at, seed = seeds_of(ids, owner, masks)
            one, two = _places(seed, bits)
            may = np.flatnonzero((has[one >> 3] >> (one & 7).astype(np.uint8)) & (has[two >> 3] >> (two & 7).astype(np.uint8)) & 1)
            at, seed = at[may], seed[may].view(np.int64)
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            begins = np.append(0, np.cumsum(np.bincount(owner, minlength=b.num_rows)))
            own = owner[at] if len(at) else at
            rows, start = np.unique(own, return_index=True)
            bounds = pa.array(np.append(start, len(own)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (seed, at - begins[own] if len(at) else at)]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(taken), b.column("text").take(taken), *lists], names=["doc_id", "text", "seeds", "places"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # Written once, so that the rows' numbers are the same whenever they are read.
    kept = cut(spread(texts).mapInArrow(scan, "doc_id long, text string, seeds array<long>, places array<long>")).withColumn("key", F.monotonically_increasing_id())
    hits = kept.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("key", F.col("h.seeds").alias("seed"), F.col("h.places").alias("p"), F.expr(f"pmod(xxhash64(key), {SALTS})").alias("salt"))
    parts = seeds.select("item", "seed", "q").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    place = F.shiftleft(F.col("p"), 32).bitwiseOR(F.col("q"))
    pairs = cut(hits.join(parts, ["seed", "salt"]).groupBy("key", "item").agg(F.collect_set(place).alias("hits")))
    none = F.lit(None)
    wanted = kept.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "text", none.cast("long").alias("item"), none.cast("string").alias("item_text"), none.cast("array<long>").alias("hits"))
    asked = pairs.join(distinct.withColumnRenamed("text", "item_text"), "item").select("key", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "item", "item_text", "hits")
    tasks = parallelism(documents.sparkSession)
    ordered = wanted.unionByName(asked).repartition(tasks, "key").sortWithinPartitions("key", F.col("item").asc_nulls_first())
    found = ordered.mapInArrow(_verify, "doc_id long, item long, words int, errors int, at int")
    return found.join(members, "item").select("doc_id", "item_id", "words", "errors", "at")
