"""Clusterings that go through their rows in order: one group of vectors or one alignment per task, leader scans of pairs in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(vectors: np.ndarray, rows: np.ndarray, heads: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``heads`` to each of ``rows``, and its squared distance. Found by products of matrices; heads that their
    error leaves open are measured again, difference by difference."""
    sizes = (vectors**2).sum(axis=1)
    head, least = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), np.inf)
    for h in range(0, len(heads), 4096):
        some = heads[h:h + 4096]
        for r in range(0, len(rows), block):
            mine = rows[r:r + block]
            both = sizes[mine][:, None] + sizes[some][None, :]
            d = both - 2 * (vectors[mine] @ vectors[some].T)
            error = both * (1e-14 * (vectors.shape[1] + 4))
            i, j = np.nonzero(d - error <= (d + error).min(axis=1, keepdims=True))
            exact = ((vectors[some[j]] - vectors[mine[i]]) ** 2).sum(axis=1)
            order = np.lexsort((j, exact, i))
            first = order[np.unique(i[order], return_index=True)[1]]
            i, j, exact = i[first], j[first], exact[first]
            better = exact < least[r + i]
            head[r + i[better]], least[r + i[better]] = some[j[better]], exact[better]
    return head, least


def leaders(vectors: np.ndarray, close: float, block: int = 256) -> list[int]:
    """The leader of each row, in order: the nearest earlier leader within ``close``, or itself. A block of rows meets all leaders
    before it at once, and then those of its own one by one."""
    found: list[int] = []
    out = np.arange(len(vectors))
    for start in range(0, len(vectors), block):
        rows = np.arange(start, min(start + block, len(vectors)))
        head, least = nearest(vectors, rows, np.array(found, dtype=np.int64))
        own: list[int] = []
        for i in rows:
            if own:
                d = ((vectors[own] - vectors[i]) ** 2).sum(axis=1)
                k = int(np.argmin(d))
                if d[k] < least[i - start]:
                    head[i - start], least[i - start] = own[k], d[k]
            if np.sqrt(least[i - start]) <= close:
                out[i] = head[i - start]
            else:
                own.append(i)
        found += own
    return out.tolist()


def leader_clusters(rows: DataFrame, group: str, key: str, vector: str, close: float, reassign: bool = True) -> DataFrame:
    """(group, key, leader): greedy leader clustering in the order of ``key``, then each to its nearest leader."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        lead = leaders(x, close)
        if reassign:
            lead = nearest(x, np.arange(len(x)), np.unique(lead))[0]
        keys = pdf[key].to_numpy()
        return pd.DataFrame({group: pdf[group].to_numpy(), key: keys, "leader": keys[lead]})

    types = dict(rows.dtypes)
    return rows.select(group, key, vector).groupBy(group).applyInPandas(one, f"{group} {types[group]}, {key} {types[key]}, leader {types[key]}")


def sequence_leaders(rows: DataFrame, identity: float = 0.01, substitutions: int = 2) -> DataFrame:
    """(algn_id, seq_id, leader) of aligned sequences (algn_id, seq_id, seq): a sequence joins the leader of
    fewest substitutions that is within ``identity`` of its length or ``substitutions``; then each goes to
    the leader of fewest substitutions."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        x = np.array([list(s) for s in pdf["seq"]])
        heads: list[int] = []
        for i in range(len(x)):
            d = (x[heads] != x[i]).sum(axis=1) if heads else np.zeros(0)
            if not len(d) or not (d.min() / max(x.shape[1], 1) <= identity or d.min() <= substitutions):
                heads.append(i)
        lead = [heads[int(np.argmin((x[heads] != v).sum(axis=1)))] for v in x]
        ids = pdf["seq_id"].to_numpy()
        return pd.DataFrame({"algn_id": pdf["algn_id"].to_numpy(), "seq_id": ids, "leader": ids[lead]})

    return rows.groupBy("algn_id").applyInPandas(one, "algn_id string, seq_id string, leader string")


def average_linkage(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of average-linkage clustering of the rows by Euclidean distance.

    Cluster n + i is made by merge i; ties go to the first pair.
    """
    n = len(points)
    d = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in points])  # a row at a time: n x n in memory, not n x n x n
    np.fill_diagonal(d, np.inf)
    name, size, live, out = list(range(n)), np.ones(n), np.ones(n, dtype=bool), []
    for step in range(n - 1):
        sub = np.where(live[:, None] & live[None, :], d, np.inf)
        i, j = np.unravel_index(int(np.argmin(sub)), sub.shape)
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j], float(d[i, j])))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        size[i] += size[j]
        live[j], name[i] = False, n + step
    return out


def cut_tree(n: int, merges: list[tuple[int, int, float]], height: float) -> list[int]:
    """Cluster numbers, by first appearance, of n leaves after all merges up to ``height``."""
    head = list(range(n + len(merges)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for k, (a, b, h) in enumerate(merges):
        if h <= height:
            head[find(a)] = head[find(b)] = n + k
    seen: dict[int, int] = {}
    return [seen.setdefault(find(i), len(seen)) for i in range(n)]


def fuzzy_clusters(rows: DataFrame, group: str, key: str, vector: str, k: int, power: float = 2.0, rounds: int = 300) -> DataFrame:
    """(group, key, cluster, membership): fuzzy c-means per group, hard label and its membership."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        u = np.random.default_rng(144).dirichlet(np.ones(min(k, len(x))), len(x))
        for _ in range(rounds):
            w = u**power
            centre = (w.T @ x) / w.sum(axis=0)[:, None]
            d = np.maximum(((x[:, None] - centre[None]) ** 2).sum(axis=2), 1e-12) ** (-1 / (power - 1))
            new = d / d.sum(axis=1, keepdims=True)
            moved, u = np.abs(new - u).max(), new
            if moved < 1e-5:
                break
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), "cluster": u.argmax(axis=1), "membership": u.max(axis=1)})

    types = dict(rows.dtypes)
    return rows.select(group, key, vector).groupBy(group).applyInPandas(one, f"{group} {types[group]}, {key} {types[key]}, cluster int, membership double")


def duplicate_clusters(pairs: DataFrame, ids: DataFrame, cut, least: float = 0.9) -> DataFrame:
    """(id, leader): a leader scan in the order of ids over pairs (a, b, score, agrees): an id joins the first leader
    with a score of at least ``least`` that agrees with it, else it leads itself.

    In rounds: who has no undecided smaller neighbour leads, and a leader's larger neighbours follow. A round decides
    whatever does not wait for another, so scans take few rounds unless the ids form a long chain.
    """
    near = pairs.filter((F.col("score") >= least) & F.col("agrees") & (F.col("a") != F.col("b")))
    near = cut(near.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    state = cut(ids.select("id").distinct().withColumn("leads", F.lit(None).cast("boolean")))
    waiting = near
    while not waiting.isEmpty():
        blocked = waiting.select(F.col("high").alias("id"))
        first = state.filter("leads IS NULL").join(blocked, "id", "left_anti").select("id")
        followers = waiting.join(first.withColumnRenamed("id", "low"), "low", "left_semi").select(F.col("high").alias("id")).distinct()
        decided = cut(first.withColumn("now", F.lit(True)).unionByName(followers.withColumn("now", F.lit(False))))
        state = cut(state.join(decided, "id", "left").select("id", F.coalesce("leads", "now").alias("leads")))
        done = decided.select("id")
        waiting = cut(waiting.join(done.withColumnRenamed("id", "low"), "low", "left_anti").join(done.withColumnRenamed("id", "high"), "high", "left_anti"))
    leaders = state.filter("coalesce(leads, true)").select("id")
    first = near.join(leaders.withColumnRenamed("id", "low"), "low", "left_semi").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("first"))
    follows = state.filter("NOT leads").join(first, "id").select("id", F.col("first").alias("leader"))
    return leaders.withColumn("leader", F.col("id")).unionByName(follows)
