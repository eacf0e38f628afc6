"""Size-bounded clusters of embedded facts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.lineage import cut

#: Facts whose distances are held at once; of an owner with more, neighbours along a fixed direction are clustered together.
AT_ONCE = 1_000


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage over cosine distances, by nearest-neighbour chains."""
    n = len(x)
    if k >= n:
        return np.arange(n)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1.0 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((d[a, b], a, b))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        parent[root(b)] = root(a)
    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row at the least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0] = i
        j0, low, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            cur = cost[p[j0] - 1] - u[p[j0]] - v[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    result = np.zeros(n, int)
    for j in range(1, m + 1):
        if p[j]:
            result[p[j] - 1] = j - 1
    return result


def bounded(x: np.ndarray, labels: np.ndarray, least: int, most: int, rounds: int = 2) -> np.ndarray:
    """Labels with ``least`` to ``most`` members each: places of the clusters are filled at the least total distance to their centres."""
    n = len(x)
    k = int(min(max(labels.max() + 1, -(-n // most)), max(1, n // least)))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if labels.max() + 1 != k:
        labels = average_linkage(x, k)
    for _ in range(rounds):
        centres = np.stack([unit[labels == c].mean(axis=0) for c in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        far = 1.0 - unit @ centres.T
        seats = np.concatenate([np.repeat(np.arange(k), min(least, n // k)), np.repeat(np.arange(k), most - min(least, n // k))])
        must = k * min(least, n // k)
        cost = far[:, seats] + np.where(np.arange(len(seats)) < must, -10.0, 0.0)
        new = seats[assign(cost)]
        if (new == labels).all():
            break
        labels = new
    return labels


def cluster_facts(facts: DataFrame, owner: str, key: str, vector: str, target: int = 10, least: int = 3, most: int = 20) -> DataFrame:
    """(owner, key, cluster, of): each owner's facts in clusters of ``least`` to ``most``, about ``target`` of them.

    The number of clusters is the feasible one nearest to the target. Facts
    with a null vector get none and are left out. An owner with more than AT_ONCE
    facts is first cut into stretches of about half of it along a fixed direction
    in space, each of which is clustered by itself, as no cluster may grow with
    the owner anyway; clusters are numbered through.
    """
    kinds = facts.schema
    head = f"`{owner}` {kinds[owner].dataType.simpleString()}, `{key}` {kinds[key].dataType.simpleString()}"

    def clustered(x: np.ndarray, whole: bool) -> tuple[np.ndarray, int]:
        n = len(x)
        if n < least:
            return np.zeros(n, int), 1
        wish = target if whole else -(-n * target // AT_ONCE)
        k = int(min(max(wish, -(-n // most)), n // least))
        labels = bounded(x, average_linkage(x, k), least, most)
        return labels, int(labels.max()) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Ties may leave a stretch too long; it is then taken in even parts.
        pdf = pdf.sort_values(["_along", key]).reset_index(drop=True)
        parts = np.array_split(np.arange(len(pdf)), max(1, -(-len(pdf) // AT_ONCE)))
        labels, of = np.zeros(len(pdf), int), 0
        for part in parts:
            part = part[np.argsort(pdf[key].to_numpy()[part], kind="stable")]
            found, k = clustered(np.stack(pdf[vector].to_numpy()[part]).astype(float), bool(pdf["_whole"].iloc[0]))
            labels[part] = found + of
            of += k
        return pd.DataFrame({owner: pdf[owner], key: pdf[key], "_stretch": pdf["_stretch"], "cluster": labels.astype("int32"), "_of": np.full(len(pdf), of, dtype="int32")})

    rows = facts.where(F.col(vector).isNotNull()).select(owner, key, vector)
    # A direction made of the places alone, alike in every run.
    along = F.aggregate(F.transform(F.col(vector), lambda v, i: v.cast("double") * F.sin(i * 12.9898 + 1.0)), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    placed = rows.withColumn("_along", along)
    sizes = placed.groupBy(owner).agg(F.count("*").alias("_n"), F.percentile_approx("_along", [i / 1_000 for i in range(1, 1_000)], 10_000).alias("_cuts"))
    # Of the thousandths those that part an owner's facts into stretches of about half of AT_ONCE; more stretches than that stay longer and are parted above.
    every = F.greatest(F.lit(1), F.floor(F.lit(500.0) * AT_ONCE / F.col("_n"))).cast("int")
    sizes = sizes.select(owner, (F.col("_n") <= AT_ONCE).alias("_whole"), F.when(F.col("_n") <= AT_ONCE, F.array().cast("array<double>")).otherwise(F.filter("_cuts", lambda c, i: (i + 1) % every == 0)).alias("_cuts"))
    joined = placed.join(sizes, owner).withColumn("_stretch", F.size(F.filter("_cuts", lambda c: c < F.col("_along")))).drop("_cuts")
    found = cut(joined.groupBy(owner, "_stretch").applyInPandas(run, f"{head}, _stretch int, cluster int, _of int"))
    counts = found.groupBy(owner, "_stretch").agg(F.max("_of").alias("_of"))
    w = Window.partitionBy(owner).orderBy("_stretch")  # at most 1 000 stretches
    offsets = counts.select(owner, "_stretch", (F.sum("_of").over(w) - F.col("_of")).alias("_before"), F.sum("_of").over(Window.partitionBy(owner)).alias("_all"))
    return found.join(offsets, [owner, "_stretch"]).select(owner, key, (F.col("cluster") + F.col("_before")).cast("int").alias("cluster"), F.col("_all").cast("int").alias("of"))
