"""Problem 8: one consistent form for texts that look alike."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, parallelism, spread
from palimpsest.llm.fold import alike, table_form

#: White space that separates words, whatever it is made of.
SPACES = r"[\s\p{Z}]+"
#: White space with another character as its form.
UNUSUAL_SPACE = r"[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
#: Characters of distinct words in a shard.
SHARD = 2_000_000
#: ASCII words with a more frequent spelling in other letters that all tasks get; more are joined by a shuffle.
FEW_WORDS = 100_000
_SPLIT = re.compile("([ \\t\\n\\x0b\\f\\r\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+)")  # as SPACES


class Leaf:
    """A word with its count and path; the path's characters from ``at`` on have no nodes of their own."""

    __slots__ = ("at", "path", "words")

    def __init__(self, path: str, at: int) -> None:
        self.path, self.at = path, at
        self.words: dict[str, int] = {}


@lru_cache(maxsize=65_536)
def _form(c: str) -> str:
    return table_form(alike(c)) if c else ""


def _path(word: str) -> str:
    """The characters by which a word stands in the trie: its own, composed, so that its form can be read off one by one.

    A word whose form can't be, as marks change places or compose over an
    ignorable, stands there by its form.
    """
    if word.isascii():
        return word
    path, form = unicodedata.normalize("NFC", word), table_form(word)
    return path if "".join(map(_form, path)) == form else form


class Trie:
    """A trie of words with their counts; the end that a word shares with no other is kept whole."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        leaf = self._leaf(_path(word))
        leaf.words[word] = leaf.words.get(word, 0) + count

    def _leaf(self, path: str) -> Leaf:
        node = self.root
        for i, c in enumerate(path):
            child = node.get(c)
            if child is None:
                node[c] = child = Leaf(path, i + 1)
                return child
            if isinstance(child, Leaf):
                if child.path == path:
                    return child
                inner: dict = {}
                rest = child.path[i + 1 : i + 2]
                child.at = i + 2 if rest else i + 1
                inner[rest] = child
                node[c] = child = inner
            node = child
        if "" not in node:
            node[""] = Leaf(path, len(path))
        return node[""]

    def alike(self, word: str, budget: float = 0.0, cost: float = 1.0) -> list[tuple[float, int, str]]:
        """(cost, count, spelling) of the words that a weighted edit automaton accepts.

        Reading a character as one that looks like it, and reading or leaving
        out an ignorable, costs nothing; any other substitution, insertion or
        deletion costs ``cost``. Words within ``budget`` are found. The
        automaton's states are the trie's nodes with the place in the word's
        ordinary form, to which both sides are brought character by character;
        without a budget it walks one path.
        """
        target = table_form(word)
        found: dict[str, tuple[float, int]] = {}
        best: dict[tuple[int, int, str], float] = {}

        def accept(leaf: Leaf, spent: float) -> None:
            for w, n in leaf.words.items():
                if w not in found or spent < found[w][0]:
                    found[w] = (spent, n)

        # A state: trie node, place in the target, characters of a composed form still to come, cost.
        states: list[tuple[dict | Leaf, int, str, float]] = [(self.root, 0, "", 0.0)]
        while states:
            node, at, owed, spent = states.pop()
            if isinstance(node, Leaf):
                rest = owed + "".join(map(_form, node.path[node.at :]))
                edits = _edits(target[at:], rest, int((budget - spent) / cost + 1e-9))
                if spent + edits * cost <= budget:
                    accept(node, spent + edits * cost)
                continue
            key = (id(node), at, owed)
            if best.get(key, budget + 1) <= spent:
                continue
            best[key] = spent
            if owed:
                if at < len(target) and target[at] == owed[0]:
                    states.append((node, at + 1, owed[1:], spent))
                if spent + cost <= budget:
                    states.append((node, at, owed[1:], spent + cost))
                    if at < len(target):
                        states.append((node, at + 1, owed[1:], spent + cost))
                continue
            if at == len(target) and "" in node:
                accept(node[""], spent)
            if at < len(target) and spent + cost <= budget:
                states.append((node, at + 1, "", spent + cost))
            for c, child in node.items():
                form = _form(c)
                if c and (spent + cost <= budget or target.startswith(form, at)):
                    states.append((child, at, form, spent))
        return sorted((c, n, w) for w, (c, n) in found.items())


def _edits(a: str, b: str, most: int) -> int:
    """Edits between two texts in a band of width ``most``; more than that is most + 1."""
    if a == b:
        return 0
    if most <= 0 or abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            step = min(row.get(j, most + 1), new.get(j - 1, most + 1)) + 1
            new[j] = min(step, row.get(j - 1, most + 1) + (x != b[j - 1])) if j else i
        row = new
    return min(row.get(len(b), most + 1), most + 1)


def has_unusual(text: Column) -> Column:
    """Whether a text has a character outside ASCII; only those can look like another."""
    return F.octet_length(text) > F.length(text)


def _forms(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words:
        w = b.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array([table_form(x) for x in w], pa.string())], names=["word", "n", "form"])


def _spell(shard: pd.DataFrame) -> pd.DataFrame:
    """The canonical spelling of each word of a shard that isn't in it."""
    trie = Trie()
    for word, n, form in zip(shard["word"], shard["n"], shard["form"], strict=True):
        if form:  # a word of ignorables alone looks like no word
            trie.add(word, int(n))
    out = []
    canonical: dict[str, str] = {}  # by form, on which alone the walk depends
    for word, form in zip(shard["word"], shard["form"], strict=True):
        if form not in canonical:
            hits = [(-n, w) for cost, n, w in trie.alike(form) if cost == 0]
            canonical[form] = min(hits)[1] if hits else form
        if canonical[form] != word:
            out.append((word, canonical[form]))
    return pd.DataFrame(out, columns=["word", "spelling"])


def spellings(documents: DataFrame, text: str) -> DataFrame:
    """(word, spelling) of the words that aren't in their canonical spelling.

    The vocabulary is the words of all texts with their counts. Words that look
    alike have the same table form; by it they are shared out over shards, in
    each of which a trie of all their spellings is walked by each form. The most
    frequent spelling found (the first by code points of equals) is canonical,
    in whatever script it is; one without an unusual character may have to give
    way to it too. Words of ignorables alone are dropped by table. A shard is a
    bounded number of distinct words, however often they occur and however many
    documents there are.
    """
    words = documents.where(F.col(text).isNotNull()).select(F.explode(F.split(text, SPACES)).alias("word"))
    counted = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    # Each distinct word once, with its form; all that follows reads this table, not the texts again.
    formed = cut(counted.mapInArrow(_forms, "word string, n long, form string"))
    # Ordinary words matter only where an unusual one looks like them.
    wanted = formed.where(has_unusual(F.col("word"))).select("form").distinct()
    both = cut(formed.join(wanted, "form", "left_semi"))
    size = both.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shards = max(parallelism(documents.sparkSession), size // SHARD)
    # A given number of partitions isn't merged at run time, as few bytes make much work here.
    placed = both.withColumn("shard", F.expr(f"pmod(xxhash64(form, 8L), {shards}L)")).repartition(parallelism(documents.sparkSession), "shard")
    return placed.groupBy("shard").applyInPandas(_spell, "word string, spelling string")


def canonical_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, form): each text in the one form that all texts that look like it have.

    Full-width and half-width forms, ligatures, no-break and other spaces,
    ignorable characters, composed and decomposed accents and look-alike
    letters make no difference; case, accents, line breaks and every other
    visible difference stay. ASCII texts are their own form, unless a word of
    theirs is more often spelled in other letters. Null has the form null; empty
    is empty.
    """
    ascii_ = documents.where(~has_unusual(F.col(text)) | F.col(text).isNull()).select(key, text)
    other = documents.where(has_unusual(F.col(text))).select(key, text)
    changed = cut(spellings(documents, text))
    # ASCII words that give way to another spelling: few as a rule, and then every task gets them.
    plain = changed.where(~has_unusual(F.col("word")))
    giving_way = plain.count()
    if giving_way <= FEW_WORDS:
        plain = F.broadcast(plain)

    def owned(uses: DataFrame) -> DataFrame:
        # One map for each document: at most as many entries as it has distinct words.
        return uses.groupBy(key).agg(F.collect_set(F.struct("word", "spelling")).alias("own"))

    uses = other.select(key, F.explode(F.array_distinct(F.split(text, SPACES))).alias("word"))
    mixed = uses.where(has_unusual(F.col("word"))).join(changed, "word")
    if giving_way:
        mixed = mixed.unionByName(uses.where(~has_unusual(F.col("word"))).join(plain, "word"))
    own = owned(mixed)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = []
            for t, own in zip(b.column(text).to_pylist(), b.column("own").to_pylist(), strict=True):
                new = {x["word"]: x["spelling"] for x in own or []}
                # The pieces at odd places are white space.
                forms.append("".join([new.get(p, p) if i % 2 == 0 else "".join(map(alike, p)) for i, p in enumerate(_SPLIT.split(t))]))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(text), pa.array(forms, pa.string())], names=[key, text, "form"])

    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {text} string, form string"
    # Most texts have nothing to rewrite and stay in the JVM.
    joined = other.join(own, key, "left").withColumn("_new", F.col("own").isNotNull() | F.col(text).rlike(UNUSUAL_SPACE))
    same = joined.where("NOT _new").select(key, text, F.col(text).alias("form"))
    done = spread(joined.where("_new").select(key, text, "own"), always=True).mapInArrow(rewrite, schema).unionByName(same)
    if not giving_way:
        return ascii_.withColumn("form", F.col(text)).unionByName(done)
    used = owned(ascii_.select(key, F.explode(F.split(text, SPACES)).alias("word")).join(plain, "word"))
    with_own = ascii_.join(used, key, "left")
    kept = with_own.where("own IS NULL").select(key, text, F.col(text).alias("form"))
    return kept.unionByName(with_own.where("own IS NOT NULL").mapInArrow(rewrite, schema)).unionByName(done)


def alike_pairs(forms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that differ but have the same form.

    Forms that only one text has, however often it is repeated, are dropped by
    an aggregate of digests (two hashes of 64 bits) before any pair is made. Pairs
    are made of the different texts of a form, each once, and then expanded to
    the documents that have them. Nulls match nothing.
    """
    digest = [F.xxhash64("form").alias("f"), F.xxhash64(F.lit(1), "form").alias("f2"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2")]
    marked = cut(forms.where("form IS NOT NULL").select(F.col(key).alias("id"), *digest))
    differ = (F.min("t") != F.max("t")) | (F.min("t2") != F.max("t2"))
    several = marked.groupBy("f", "f2").agg(differ.alias("differ")).where("differ").select("f", "f2")
    few = cut(marked.join(several, ["f", "f2"], "left_semi"))
    texts = few.select("f", "f2", "t", "t2").distinct()
    a, b = (texts.toDF("f", "f2", f"t_{x}", f"t2_{x}") for x in "ab")
    pairs = a.join(b, ["f", "f2"]).where("t_a < t_b OR (t_a = t_b AND t2_a < t2_b)")
    owners = [few.select("id", "f", "f2", "t", "t2").toDF(f"id_{x}", "f", "f2", f"t_{x}", f"t2_{x}") for x in "ab"]
    both = pairs.join(owners[0], ["f", "f2", "t_a", "t2_a"]).join(owners[1], ["f", "f2", "t_b", "t2_b"])
    return both.where("id_a <> id_b").select(F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b"))
