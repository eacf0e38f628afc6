"""Problem 4: splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, seed_of

#: A component with more than total / HEAVY rows has a level of its own, the first; there are fewer than HEAVY of them.
HEAVY = 2_000
#: Components that one task places, and the labels for which that holds; with more labels a task places fewer.
BLOCK, LABELS = 20_000, 64


def name_key(name: Column) -> Column:
    """One key for all spellings of a person's name; null for null and blank.

    Case, white space of any kind and the form "surname, first name" don't
    matter. Accents and the order of the names do.
    """
    seen = F.regexp_replace(name, r"\p{Cf}+", "")
    flat = F.lower(F.trim(F.regexp_replace(seen, r"[\s\p{Z}]+", " ")))
    turned = F.regexp_replace(flat, r"^([^,]+?) ?, ?([^,]+)$", "$2 $1")
    return F.when(F.length(turned) > 0, turned)


def id_key(identifier: Column) -> Column:
    """One key for all spellings of a dialogue id; null for null and blank.

    A prefix like "dlg:" or "urn:uuid:", braces, hyphens, case and white space
    don't matter.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(identifier, r"^\s*(\p{L}+:)+", "")), r"[^\p{L}\p{Nd}]+", "")
    return F.when(F.length(bare) > 0, bare)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links.

    links: pairs of comparable nodes; pairs with a null are ignored, a pair of
    equal nodes makes a node of its own. Alternating large-star and small-star
    steps move each node's links to its smallest neighbour, which ends after
    about log(n) rounds whatever the shape; a node with very many links is
    never gathered in one task, as each step is a minimum by key and a join.
    Each round is checkpointed, so a lost executor costs one round.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    edges = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # Large star: neighbours above a node move to the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the others move with the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def tie(records: DataFrame, row: str, keys: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Components of the records that share a key of any kind.

    Returns (members, nodes). nodes: (node, component), node being the kind
    and the key. members: (row, component); a record without any key is a
    component of its own.
    """
    nodes = [F.when(k.isNotNull(), F.concat(F.lit(f"{kind}:"), k)) for kind, k in keys.items()]
    have = records.select(F.col(row).alias("row"), F.array_compact(F.array(*nodes)).alias("nodes"))
    found = components(have.where("size(nodes) > 0").select(F.element_at("nodes", 1).alias("a"), F.explode("nodes").alias("b")).distinct())
    single = have.where("size(nodes) = 0").select("row", F.concat(F.lit("row:"), F.col("row").cast("string")).alias("component"))
    first = have.where("size(nodes) > 0").select("row", F.element_at("nodes", 1).alias("node"))
    return first.join(found, "node").select("row", "component").unionByName(single), found


def stratify(vectors: np.ndarray, want: np.ndarray, rng: np.random.Generator, room: np.ndarray | None = None) -> np.ndarray:
    """The split of each component: grouped iterative stratification.

    vectors: (components, labels) rows with each label; want: (splits, labels)
    rows outstanding, changed in place; room: (splits) rows outstanding in all.
    The components with the rarest outstanding label go first, the largest of
    them at the head, each into the split that lacks most of that label; ties
    go to the split that lacks most rows, then to chance.
    """
    n, labels = vectors.shape
    sizes = vectors.sum(axis=1)
    room = want.sum(axis=1) if room is None else room
    open_ = np.ones(n, bool)
    split = np.full(n, -1)
    left = vectors.sum(axis=0).astype(float)
    while open_.any():
        there = np.flatnonzero(left > 0)
        if not len(there):
            members = np.flatnonzero(open_)
            label = None
        else:
            label = there[np.argmin(left[there])]
            members = np.flatnonzero(open_ & (vectors[:, label] > 0))
        for i in members[np.argsort(-sizes[members], kind="stable")]:
            need = want[:, label] if label is not None else room
            best = np.flatnonzero(need == need.max())
            if len(best) > 1:
                best = best[room[best] == room[best].max()]
            s = best[0] if len(best) == 1 else rng.choice(best)
            split[i] = s
            want[s] -= vectors[i]
            room[s] -= sizes[i]
            open_[i] = False
        left = vectors[open_].sum(axis=0).astype(float)
    return split


def assign_splits(members: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 4) -> DataFrame:
    """(component, rows, split_name): each component in one split, shares as given.

    members: (row, component); labels: (row, label), null allowed; targets:
    (split_name, target_share), shares that add up to 1 (null counts as 0, a
    split without a name isn't one, of a repeated one the largest share counts).

    Label vectors are summed by component before any is placed, over all labels.
    Placement has two levels, each by grouped iterative stratification. In the
    first, one task places the components with more than 1/HEAVY of all rows
    (fewer than HEAVY) against the targets, as no share of a block could take
    one. What each split then lacks of each label is shared out over blocks of
    about BLOCK components by hash, which are placed side by side. The
    outstanding counts of a label reach a block by a join; nothing that grows
    with the labels or components is collected or broadcast.
    """
    shares = sorted((r["split_name"], float(r["target_share"] or 0)) for r in targets.where("split_name IS NOT NULL").groupBy("split_name").agg(F.max("target_share").alias("target_share")).limit(1_001).collect())
    if len(shares) > 1_000:
        raise ValueError("more than 1000 splits")
    names, share = [s for s, _ in shares], [x for _, x in shares]
    schema = "component string, rows long, split_name string"
    spark = members.sparkSession
    if not names:
        return spark.createDataFrame([], schema)
    tagged = cut(members.select("row", "component").join(labels.select("row", "label"), "row").groupBy("component", F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n")))
    sizes = tagged.groupBy("component").agg(F.sum("n").alias("rows"))
    totals = tagged.groupBy("label").agg(F.sum("n").alias("there"))
    sums = sizes.agg(F.count("*").alias("components"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    wide = max(1.0, totals.count() / LABELS)
    limit = sums["rows"] / max(len(names), HEAVY / wide)
    sized = tagged.join(sizes, "component")
    same_label = lambda a, b: F.col(f"{a}.label").eqNullSafe(F.col(f"{b}.label"))

    def put(pdf: pd.DataFrame, outstanding: np.ndarray, component: np.ndarray, which: pd.Index, label: np.ndarray, *parts: object) -> pd.DataFrame:
        vectors = np.zeros((len(which), label.max() + 1))
        np.add.at(vectors, (component, label), pdf["n"].to_numpy(float))
        to = stratify(vectors, outstanding, np.random.default_rng(seed_of(seed, *parts)))
        return pd.DataFrame({"component": which, "rows": vectors.sum(axis=1).astype("int64"), "split_name": [names[s] for s in to]})

    def coded(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.Index, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(["component", "label"], na_position="first", kind="stable").reset_index(drop=True)
        component, which = pd.factorize(pdf["component"])
        label, _ = pd.factorize(pdf["label"], use_na_sentinel=False)
        _, first = np.unique(label, return_index=True)
        return pdf, component, which, label, first

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, component, which, label, first = coded(pdf)
        return put(pdf, np.outer(share, pdf["there"].to_numpy(float)[first]), component, which, label, "heavy")

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, component, which, label, first = coded(pdf)
        lacking = np.stack(pdf["lacking"].to_numpy()[first]).T
        own = np.bincount(label, weights=pdf["n"].to_numpy(float))
        return put(pdf, lacking / np.maximum(lacking.sum(axis=0), 1e-9) * own, component, which, label, *key)

    heavy = sized.where(F.col("rows") > limit).alias("a").join(totals.alias("b"), same_label("a", "b")).select("a.component", "a.label", "a.n", "b.there", F.lit(0).alias("block"))
    placed = cut(heavy.groupBy("block").applyInPandas(first_level, schema))
    taken = tagged.join(placed.select("component", "split_name"), "component").groupBy("label", "split_name").agg(F.sum("n").alias("n"))
    taken = taken.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("split_name", "n"))).alias("taken"))  # an entry for each split
    got = [F.coalesce(F.try_element_at("taken", F.lit(x)), F.lit(0)) for x in names]
    lacking = F.array(*[F.greatest(F.lit(x) * F.col("there") - g, F.lit(0.0)) for x, g in zip(share, got, strict=True)])
    rest = totals.alias("a").join(taken.alias("b"), same_label("a", "b"), "left").select("a.label", lacking.alias("lacking"))
    blocks = max(1, int(-(-sums["components"] * wide // BLOCK)))
    light = sized.where(F.col("rows") <= limit).withColumn("block", F.expr(f"pmod(xxhash64(component, {seed}L), {blocks}L)"))
    light = light.alias("a").join(rest.alias("b"), same_label("a", "b")).select("a.component", "a.label", "a.n", "b.lacking", "a.block")
    return placed.unionByName(light.groupBy("block").applyInPandas(block, schema))
