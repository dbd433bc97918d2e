"""Likelihood reconstruction of 0/1 features on a tree, gains and losses at rates of their own.

The two-state process has a closed transition matrix, so partial likelihoods are column expressions that
go up and down the levels of the tree, all features, candidate rates and nodes of a level at once. Rates are
searched on a grid around the best pair so far, for all features together, and the grid is made finer each round.

The tree is cut at a level below which all subtrees are small. Each of these blocks is gone through within a task, for a feature and all its
candidate rates, so of a block only its root is shuffled by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateralis.operators.tree import block_roots as block_roots_of

#: Rate at which the search begins, as in the usual maximisers, and bounds of rates.
START, LEAST, MOST = 0.1, 1e-8, 1e4
#: Likelihoods up to this count as none.
TINY = 1e-300
#: Levels of a plan between two cuts.
LEVELS = 8
#: Edges that a subtree may have to be gone through within a task.
BLOCK = 2048


def chances(t: Column, gain: Column, loss: Column) -> list[list[Column]]:
    """Transition probabilities over a length ``t``: [from][to]."""
    total = gain + loss
    stay = F.exp(-total * t)
    up, down = gain / total * (1 - stay), loss / total * (1 - stay)
    return [[1 - up, up], [down, 1 - down]]


def with_blocks(edges: DataFrame, closure: DataFrame) -> tuple[DataFrame, int]:
    """(edge, parent_edge, length, level, block) and the level of the blocks' roots: the first below which all subtrees have up to
    ``BLOCK`` edges. Edges above that level are their own block. The level is 0 without edges."""
    at, top = block_roots_of(closure, BLOCK)
    return edges.select("edge", "parent_edge", "length").join(at, "edge"), top


class Block:
    """A subtree and the states of a feature at its tips, for several pairs of rates at once; the likelihoods are those of ``upward``."""

    def __init__(self, nodes: pd.DataFrame, gain: np.ndarray, loss: np.ndarray):
        nodes = nodes.sort_values(["level", "edge"], ignore_index=True)
        self.edge, level = nodes["edge"].to_numpy(), nodes["level"].to_numpy()
        n, known = len(nodes), nodes["state"].notna().to_numpy()
        upper = pd.Index(self.edge).get_indexer(nodes["parent_edge"])
        self.upper = np.where(np.arange(n) > 0, upper, -1)  # the first is the root of the block
        self.levels = [np.flatnonzero(level == k) for k in range(level[0], level[-1] + 1)]
        t = nodes["length"].to_numpy(dtype=float)[:, None]
        stay = np.exp(-(gain + loss) * t)
        up, down = gain / (gain + loss) * (1 - stay), loss / (gain + loss) * (1 - stay)
        self.p = [[1 - up, up], [down, 1 - down]]
        self.seen = known.copy()  # has a tip with a state at it or below
        self.l, self.m, self.scale = np.zeros((2, n, len(gain))), np.zeros((2, n, len(gain))), np.zeros((n, len(gain)))
        state = nodes["state"].to_numpy(dtype=float)
        self.l[1, known], self.l[0, known] = state[known, None], 1 - state[known, None]
        logs, tips = np.zeros((2, n, len(gain))), known
        for here in reversed(self.levels):
            inner = here[~tips[here] & self.seen[here]]
            top = logs[:, inner].max(axis=0)
            none = np.isneginf(top)
            self.l[:, inner] = np.where(none, 0.0, np.exp(logs[:, inner] - np.where(none, 0.0, top)))
            self.scale[inner] += np.where(none, np.nan, top)
            for x in (0, 1):
                self.m[x, here] = self.p[x][0][here] * self.l[0, here] + self.p[x][1][here] * self.l[1, here]
            below = here[self.seen[here] & (self.upper[here] >= 0)]
            to = self.upper[below]
            self.seen[to] = True
            for x in (0, 1):
                m = self.m[x, below]
                np.add.at(logs[x], to, np.where(m > TINY, np.log(np.maximum(m, TINY)), -np.inf))
            np.add.at(self.scale, to, self.scale[below])

    def down(self, f: np.ndarray) -> np.ndarray:
        """The share of state 1 at all nodes, given both shares at the block's root; of one pair of rates."""
        share = np.full((2, len(self.edge)), np.nan)
        share[:, 0] = f
        for here in self.levels[1:]:
            out = [share[x, self.upper[here]] / np.maximum(self.m[x, here, 0], TINY) for x in (0, 1)]
            g = [(out[0] * self.p[0][x][here, 0] + out[1] * self.p[1][x][here, 0]) * self.l[x, here, 0] for x in (0, 1)]
            with np.errstate(invalid="ignore"):
                share[:, here] = g / (g[0] + g[1])
        return share[1]


def block_roots(blocks: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gain, loss, edge, l0, l1, scale) of the blocks' roots."""
    kinds = dict(blocks.dtypes) | dict(rates.dtypes)
    extra = keys[1:]

    def one(key: tuple, nodes: pd.DataFrame, rates: pd.DataFrame) -> pd.DataFrame:
        done = Block(nodes, rates["gain"].to_numpy(), rates["loss"].to_numpy())
        out = rates[[*extra, "gain", "loss"]].assign(feature=key[0], edge=key[1], l0=done.l[0, 0], l1=done.l[1, 0], scale=done.scale[0])
        return out if done.seen[0] else out[:0]

    roots = blocks.filter("edge = block").select("feature", F.col("block").alias("root"))
    each = roots.join(F.broadcast(rates), "feature").withColumnRenamed("feature", "of")  # a row per feature and candidate is broadcast
    schema = ", ".join([f"{k} {kinds[k]}" for k in ("feature", *extra)] + [f"gain double, loss double, edge {kinds['edge']}, l0 double, l1 double, scale double"])
    return blocks.groupBy("feature", "block").cogroup(each.groupBy("of", "root")).applyInPandas(one, schema)


def block_states(blocks: DataFrame, tops: DataFrame, rates: DataFrame) -> DataFrame:
    """(feature, edge, f1) of the edges below the blocks' roots. ``tops``: feature, edge, f0, f1 of the roots."""
    kinds = dict(blocks.dtypes)

    def one(key: tuple, nodes: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        if not len(top) or not len(nodes):
            return pd.DataFrame({"feature": [], "edge": [], "f1": []})
        done = Block(nodes, top["gain"].to_numpy(), top["loss"].to_numpy())
        share = done.down(top[["f0", "f1"]].to_numpy(dtype=float)[0])
        kept = done.seen & (np.arange(len(share)) > 0)
        return pd.DataFrame({"feature": key[0], "edge": done.edge[kept], "f1": share[kept]})

    each = tops.join(F.broadcast(rates.select("feature", "gain", "loss")), "feature").withColumnsRenamed({"feature": "of", "edge": "root"})
    return blocks.groupBy("feature", "block").cogroup(each.groupBy("of", "root")).applyInPandas(one, f"feature {kinds['feature']}, edge {kinds['edge']}, f1 double")


def upward(shape: DataFrame, deepest: int, tips: DataFrame, blocks: DataFrame, rates: DataFrame, keys: list[str], cut) -> tuple[list[DataFrame], DataFrame]:
    """Partial likelihoods by level, the blocks' roots (at level ``deepest``) first, and those of the root.

    A level has (keys, edge, parent_edge, l0, l1, m0, m1, scale): the likelihood of what is below, by the state of the lower
    node, and by that of the upper node; both are divided by exp(scale). ``rates``: keys, gain, loss. ``tips``: those above the blocks;
    ``blocks``: feature, block, edge, parent_edge, length, level and state, which only tips have.
    """
    leaves = tips.join(F.broadcast(rates), "feature").select(
        *keys, "gain", "loss", "edge", "parent_edge", "length", (1 - F.col("state")).cast("double").alias("l0"),
        F.col("state").cast("double").alias("l1"), F.lit(0.0).alias("scale"), "level")
    levels, made = [], cut(block_roots(blocks, rates, keys))
    for level in range(deepest, 0, -1):
        inner = made.join(shape.filter(F.col("level") == level).select("edge", "parent_edge", "length"), "edge")
        here = leaves.filter(F.col("level") == level).drop("level")
        here = here.unionByName(inner.select(*here.columns))
        p = chances(F.col("length"), F.col("gain"), F.col("loss"))
        here = here.withColumns({f"m{x}": p[x][0] * F.col("l0") + p[x][1] * F.col("l1") for x in (0, 1)})
        if level % LEVELS == 0 or len(keys) == 1:
            here = cut(here)
        levels.append(here)
        logs = here.groupBy(*keys, "gain", "loss", F.col("parent_edge").alias("edge")).agg(
            *[F.when(F.min(f"m{x}") > TINY, F.sum(F.ln(F.greatest(f"m{x}", F.lit(TINY))))).alias(f"x{x}") for x in (0, 1)],
            F.when(F.count("scale") == F.count(F.lit(1)), F.sum("scale")).alias("scale"))
        top = F.greatest("x0", "x1")  # null if the node can have neither state
        made = logs.select(
            *keys, "gain", "loss", "edge", *[F.coalesce(F.exp(F.col(f"x{x}") - top), F.lit(0.0)).alias(f"l{x}") for x in (0, 1)],
            (F.col("scale") + top).alias("scale"))
    return levels, made.drop("edge")


def fitted_rates(shape: DataFrame, deepest: int, tips: DataFrame, blocks: DataFrame, features: DataFrame, cut, rounds: int = 10, step: float = 2.0, side: int = 2) -> DataFrame:
    """(feature, gain, loss, loglik): each round tries a grid of (2 side + 1) squared pairs in logarithms around the best, at half the step of the last."""
    size = 2 * side + 1
    best = features.select("feature", F.lit(START).alias("gain"), F.lit(START).alias("loss"))
    for _ in range(rounds):
        best = cut(best)
        c = F.col("candidate")
        bounded = [F.least(F.greatest(F.col(r) * F.exp(step * (at - side)), F.lit(LEAST)), F.lit(MOST)) for r, at in (("gain", F.floor(c / size)), ("loss", c % size))]
        tried = best.select("feature", "gain", "loss", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("candidate"))
        tried = tried.select("feature", "candidate", bounded[0].alias("gain"), bounded[1].alias("loss"))
        _, root = upward(shape, deepest, tips, blocks, tried, ["feature", "candidate"], cut)
        loglik = F.round(F.ln(F.col("l0") + F.col("l1")) + F.col("scale"), 9)
        order = F.struct(loglik.alias("loglik"), (-F.abs(c - (size * size) // 2)).alias("near"), (-c).alias("first"), "gain", "loss")
        best = root.groupBy("feature").agg(F.max(order).alias("b")).select("feature", "b.gain", "b.loss", "b.loglik")
        step /= 2
    return cut(best)


def likelihood_states(edges: DataFrame, tips: DataFrame, closure: DataFrame, cut, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(feature, edge, state, p1) of the lower nodes and (feature, root, p1, gain, loss, loglik) of the root.

    ``tips`` has (feature, edge, state 0 or 1) for every tip edge and feature; tips keep their state. The state of a node
    is the one that is likelier given all tips, 0 on ties (to nine places); the root's states weigh the same. A feature that all tips have or
    none has no rates: its states are null, and so are those of a feature that differs between tips at distance 0. Nodes may have any number of children; lengths are not negative.
    """
    rows, deepest = with_blocks(edges, closure)
    rows = cut(rows)
    kinds = tips.groupBy("feature").agg((F.countDistinct("state") == 2).alias("varied"))
    varied = cut(tips.join(kinds.filter("varied"), "feature", "left_semi").select("feature", "edge", "state"))
    if deepest == 0:
        none = tips.select("feature", "edge", "state", F.lit(None).cast("double").alias("p1"))
        return none, kinds.select("feature", F.lit(None).cast("int").alias("root"), *[F.lit(None).cast("double").alias(c) for c in ("p1", "gain", "loss", "loglik")])
    shape = cut(rows.filter(F.col("level") <= deepest).drop("block"))
    features = cut(kinds.filter("varied").select("feature"))
    low = rows.filter(F.col("level") >= deepest).crossJoin(F.broadcast(features))  # a row of the result each
    blocks = cut(low.join(varied, ["feature", "edge"], "left"))
    high = cut(varied.join(shape.filter(F.col("level") < deepest), "edge"))
    rates = fitted_rates(shape, deepest, high, blocks, features, cut, rounds)
    levels, root = upward(shape, deepest, high, blocks, rates.select("feature", "gain", "loss"), ["feature"], cut)
    total = F.col("l0") + F.col("l1")
    root = cut(root.select("feature", *[F.when(F.col("scale").isNotNull(), F.col(f"l{x}") / total).alias(f"f{x}") for x in (0, 1)]))
    whole = root.withColumn("parent_edge", F.lit(None).cast(dict(edges.dtypes)["edge"]))
    states = None
    for here in reversed(levels):  # the uppermost first
        same = F.col("x.parent_edge").eqNullSafe(F.col("w.parent_edge"))  # null is the root
        rows = here.alias("x").join(whole.alias("w"), (F.col("x.feature") == F.col("w.feature")) & same)
        p = chances(F.col("length"), F.col("gain"), F.col("loss"))
        out = [F.col(f"f{x}") / F.greatest(F.col(f"m{x}"), F.lit(TINY)) for x in (0, 1)]  # the rest of the tree, by the upper state
        g = [(out[0] * p[0][x] + out[1] * p[1][x]) * F.col(f"l{x}") for x in (0, 1)]
        rows = cut(rows.select("x.feature", "x.edge", (g[0] / (g[0] + g[1])).alias("f0"), (g[1] / (g[0] + g[1])).alias("f1")))
        states = rows if states is None else states.unionByName(rows)
        whole = rows.withColumnRenamed("edge", "parent_edge")
    states = states.select("feature", "edge", "f1").unionByName(cut(block_states(blocks, rows, rates)))
    found = states.select("feature", "edge", (F.round("f1", 9) > 0.5).cast("int").alias("state"), F.col("f1").alias("p1"))
    every = edges.select("edge").crossJoin(kinds.filter("NOT varied").select("feature"))  # a row of the result each
    bad = every.select("feature", "edge", F.lit(None).cast("int").alias("state"), F.lit(None).cast("double").alias("p1"))
    tops = kinds.select("feature").join(root, "feature", "left").join(rates, "feature", "left").select(
        "feature", (F.round("f1", 9) > 0.5).cast("int").alias("root"), F.col("f1").alias("p1"), "gain", "loss", "loglik")
    return found.unionByName(bad), tops
