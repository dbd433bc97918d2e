"""Pairwise distances: neighbours, thresholds, in- and out-group summaries, medoids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, v) -> s + v)"))


def rounded_distances(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Euclidean distances of the rows of x and y, rounded. By one product of matrices; where its error could change the last
    digit, the squares are added up one after the other, as ``euclidean`` does."""
    scale = 10.0**digits
    sizes = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    d = np.sqrt(np.maximum(sizes - 2 * (x @ y.T), 0.0))
    error = sizes * (x.shape[1] * 1e-15 * scale) / np.maximum(d, 1e-9) + 1e-6
    d *= scale
    open_ = np.flatnonzero(np.abs(d - np.floor(d) - 0.5) <= error)
    for part in np.array_split(open_, len(open_) // 100_000 + 1):
        i, j = np.unravel_index(part, d.shape)
        d[i, j] = np.sqrt(np.cumsum((x[i] - y[j]) ** 2, axis=1)[:, -1]) * scale
    return np.floor(d + 0.5) / scale


def in_blocks(vectors: DataFrame, fold: Callable, schema: str, digits: int = 6, size: int = 2048) -> DataFrame:
    """Rows of ``fold(a, b, d)`` for each pair of blocks of vectors (label, id, vector) of one label, with ``label``.

    ``a`` and ``b``: ids of some ``size`` vectors each; ``d``: their rounded distances, NaN between equal ids. All ordered pairs
    occur in one block. A task holds one pair of blocks, however many vectors a label has; vectors have one length.
    """
    parts = vectors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    v = vectors.join(parts, "label").withColumn("block", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    v = v.select("label", "id", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["vector"].to_numpy()).astype(float), pdf["id"].to_numpy()
        left, right = (pdf["block"] == key[1]).to_numpy(), (pdf["block"] == key[2]).to_numpy()
        d = rounded_distances(x[left], x[right], digits)
        if key[1] == key[2]:
            d[ids[:, None] == ids[None, :]] = np.nan
            made = fold(ids, ids, d)
        else:
            made = pd.concat([fold(ids[left], ids[right], d), fold(ids[right], ids[left], d.T)])
        made.insert(0, "label", key[0])
        return made

    return v.groupBy("label", "low", "high").applyInPandas(one, f"label {dict(vectors.dtypes)['label']}, {schema}")


def block_pairs(vectors: DataFrame, digits: int = 6, most: float = np.inf) -> DataFrame:
    """(label, a, b, dist): ordered pairs of one label, or those within ``most``."""

    def rows(a, b, d):
        i, j = np.nonzero(d <= most)
        return pd.DataFrame({"a": a[i], "b": b[j], "dist": d[i, j]})

    kind = dict(vectors.dtypes)["id"]
    return in_blocks(vectors, rows, f"a {kind}, b {kind}, dist double", digits)


def block_nearest(vectors: DataFrame) -> DataFrame:
    """(label, a, b, dist): rows at each a's smallest distance within its label, ties kept."""

    def rows(a, b, d):
        d = np.where(np.isnan(d), np.inf, d)
        i, j = np.nonzero((d == d.min(axis=1, keepdims=True)) & np.isfinite(d))
        return pd.DataFrame({"a": a[i], "b": b[j], "dist": d[i, j]})

    kind = dict(vectors.dtypes)["id"]
    return nearest(in_blocks(vectors, rows, f"a {kind}, b {kind}, dist double"))


def block_medoids(vectors: DataFrame) -> DataFrame:
    """(grp, medoid, total): per label the vector with the smallest sum of distances within it, smallest id on ties."""

    def rows(a, b, d):
        met = ~np.isnan(d)
        return pd.DataFrame({"a": a, "total": np.where(met, d, 0.0).sum(axis=1)})[met.any(axis=1)]

    sums = in_blocks(vectors, rows, f"a {dict(vectors.dtypes)['id']}, total double")
    total = sums.groupBy("label", "a").agg(F.round(F.sum("total"), 6).alias("total"))
    best = total.groupBy(F.col("label").alias("grp")).agg(F.min(F.struct("total", "a")).alias("b"))
    return best.select("grp", F.col("b.a").alias("medoid"), F.col("b.total").alias("total"))


def block_moments(vectors: DataFrame, classes: int) -> DataFrame:
    """(same, n, mean, sd): distances of ordered pairs of one label whose ids leave the same remainder by ``classes``, and of the others."""

    def rows(a, b, d):
        met = ~np.isnan(d)
        if not met.any():
            return pd.DataFrame({"same": [], "n": [], "s1": [], "s2": []}).astype({"same": bool, "n": "int64"})
        centre = float(d[met].mean())
        off = np.where(met, d - centre, 0.0)

        def sums(i, j):
            x = off[np.ix_(i, j)]
            return np.array([met[np.ix_(i, j)].sum(), x.sum(), (x * x).sum()])

        own = sum(sums(np.flatnonzero(a % classes == k), np.flatnonzero(b % classes == k)) for k in range(classes))
        found = [(s, int(n), x + n * centre, xx + 2 * centre * x + n * centre * centre) for s, (n, x, xx) in ((True, own), (False, np.array([met.sum(), off.sum(), (off * off).sum()]) - own)) if n]
        return pd.DataFrame(found, columns=["same", "n", "s1", "s2"])

    m = in_blocks(vectors, rows, "same boolean, n long, s1 double, s2 double").groupBy("same").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    return m.select("same", "n", mean.alias("mean"), F.sqrt(F.try_divide(F.greatest(F.col("s2") - n * mean * mean, F.lit(0.0)), n - 1)).alias("sd"))


def in_strips(vectors: DataFrame, fold: Callable, schema: str, digits: int = 6, size: int = 4096, cells: int = 1 << 20) -> DataFrame:
    """Rows of ``fold(a, b, d)`` for some vectors a of a label against all of that label, with ``label``.

    ``vectors``: label, id, vector, taken (whether it is to be an a) and what else ``fold`` needs. ``a`` and ``b``: frames of these
    columns, the largest id first; ``d``: their rounded distances, NaN between equal ids. A task has some ``size`` vectors as a's, of
    which ``fold`` gets as many at once as make up to ``cells`` distances, so no row per pair leaves it.
    """
    v = vectors.filter("label IS NOT NULL AND id IS NOT NULL")
    parts = v.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    v = v.join(parts, "label").withColumn("own", F.pmod(F.xxhash64("id"), "parts")).withColumn("strip", F.explode(F.expr("sequence(0, parts - 1)")))
    v = v.withColumn("taken", F.col("taken") & (F.col("own") == F.col("strip"))).drop("own", "parts")

    def one(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(frames)).sort_values("id", ascending=False, ignore_index=True)
        x, ids, taken = np.stack(b.pop("vector").to_numpy()).astype(float), b["id"].to_numpy(), np.flatnonzero(b["taken"])
        for k in np.array_split(taken, -(-len(taken) * len(b) // cells)) if len(taken) else []:
            d = rounded_distances(x[k], x, digits)
            d[ids[k][:, None] == ids[None, :]] = np.nan
            made = fold(b.iloc[k], b, d)
            made.insert(0, "label", key[0])
            yield made

    return v.groupBy("label", "strip").applyInPandas(one, f"label {dict(vectors.dtypes)['label']}, {schema}")


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as DuckDB does, by the scaled value and not by its shortest decimal."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def row_numbers(d: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Per row of d without its NaN: how many, smallest, mean, largest and the ``shares`` with linear interpolation. Means are of sums one after the other."""
    n = (~np.isnan(d)).sum(axis=1)
    if not d.shape[1]:
        return np.column_stack([n, *[np.full(len(d), np.nan)] * (3 + len(shares))])
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.cumsum(np.nan_to_num(d), axis=1)[:, -1] / n
    place = np.maximum(n - 1, 0)[:, None] * np.array([0.0, *shares, 1.0])
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    at = np.unique([low, high])
    d = np.partition(d, at, axis=1) if len(at) <= 16 else np.sort(d, axis=1)
    x, y = np.take_along_axis(d, low, axis=1), np.take_along_axis(d, high, axis=1)
    q = np.where((low == high) | (x == y), x, (high - place) * x + (place - low) * y)
    return np.column_stack([n, q[:, 0], mean, q[:, -1], q[:, 1:-1]])


def strip_numbers(vectors: DataFrame, shares: dict[str, float], digits: int = 6, size: int = 4096) -> DataFrame:
    """(label, a, grp, and in_ and out_ n, min, mean, max and ``shares``): distances within one label to a's own grp and to the others,
    rounded to six digits; null without such a vector. A null grp is neither a's own nor another.

    ``vectors``: label, id, vector, grp, taken, as for ``in_strips``; each row taken makes one of the result.
    """
    names = [f"{g}_{n}" for g in ("in", "out") for n in ("n", "min", "mean", "max", *shares)]
    kinds = dict(vectors.dtypes)

    def rows(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        code, _ = pd.factorize(b["grp"])
        own, out = code[a.index], np.full((len(a), len(names)), np.nan)
        out[:, [0, len(names) // 2]] = 0
        for g in np.unique(own[own >= 0]):
            here, same = np.flatnonzero(own == g), code == g
            out[here] = np.hstack([row_numbers(d[here][:, c], tuple(shares.values())) for c in (same, ~same & (code >= 0))])
        made = pd.DataFrame(half_up(out, 6), columns=names)
        made.insert(0, "a", a["id"].to_numpy())
        made.insert(1, "grp", a["grp"].to_numpy())
        return made

    found = in_strips(vectors, rows, f"a {kinds['id']}, grp {kinds['grp']}, " + ", ".join(f"{n} double" for n in names), digits, size)
    return found.select("label", "a", "grp", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


#: Values of one chunk of a histogram, and how far a task counts them in one array.
CHUNK, DENSE = 1 << 16, 1 << 24


def pair_histogram(vectors: DataFrame, digits: int = 6, size: int = 4096, cells: int = 1 << 20) -> DataFrame:
    """(label, chunk, n, low, high, total, codes, counts): how often each rounded distance occurs among the pairs a < b of a label.

    A distance is the whole number ``code`` by ``10 ** digits``, and a chunk has codes of a range of ``CHUNK``: their distinct values in
    order, how often each occurs (both packed), all of them, the smallest, the largest and the sum. Pairs are counted within a task for
    two blocks of vectors and added up by chunk, so no row per pair arises.
    """
    v = vectors.filter("label IS NOT NULL AND id IS NOT NULL").select("label", "id", "vector")
    parts = v.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    v = v.join(parts, "label").withColumn("block", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    v = v.select("label", "id", "vector", "block", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"))
    label = dict(vectors.dtypes)["label"]

    def packed(label, codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """A row per chunk of distinct codes in order."""
        at = np.flatnonzero(np.diff(codes // CHUNK, prepend=-1))
        ends = [*at[1:], len(codes)][: len(at)]
        rows = [(codes[i] // CHUNK, (codes[i:k] % CHUNK).astype(np.uint16).tobytes(), counts[i:k].astype(np.int64).tobytes()) for i, k in zip(at, ends, strict=True)]
        made = pd.DataFrame(rows, columns=["chunk", "codes", "counts"])
        made.insert(0, "label", label)
        return made

    def counted(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames), ignore_index=True)
        x, ids = np.stack(pdf["vector"].to_numpy()).astype(float), pdf["id"].to_numpy()
        left, right = (np.flatnonzero(pdf["block"] == k) for k in key[1:])
        if not len(left) or not len(right):
            return
        most = 2 * np.nan_to_num(np.sqrt((x * x).sum(axis=1)), posinf=np.inf).max() * 10.0**digits + 2
        dense = np.zeros(int(most) + 1, np.int64) if most < DENSE else None
        for k in np.array_split(left, -(-len(left) * len(right) // cells)):
            d = rounded_distances(x[k], x[right], digits)
            d = d[ids[k][:, None] < ids[right][None, :] if key[1] == key[2] else ~np.isnan(d)]
            codes = np.rint(d[~np.isnan(d)] * 10.0**digits).astype(np.int64)
            if dense is None:
                yield packed(key[0], *np.unique(codes, return_counts=True))
            else:
                found = np.bincount(codes)
                dense[: len(found)] += found
        if dense is not None:
            yield packed(key[0], np.flatnonzero(dense), dense[dense > 0])

    def added(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CHUNK, np.int64)
        for pdf in frames:
            for codes, counts in zip(pdf["codes"], pdf["counts"], strict=True):
                n[np.frombuffer(codes, np.uint16)] += np.frombuffer(counts, np.int64)
        at = np.flatnonzero(n)
        codes, n = at + int(key[1]) * CHUNK, n[at]
        row = (*key, int(n.sum()), codes[0], codes[-1], float(sum(map(int, codes * n.astype(object)))), at.astype(np.uint16).tobytes(), n.tobytes())
        yield pd.DataFrame([row], columns=["label", "chunk", "n", "low", "high", "total", "codes", "counts"])

    rows = v.groupBy("label", "lower", "upper").applyInPandas(counted, f"label {label}, chunk long, codes binary, counts binary")
    return rows.groupBy("label", "chunk").applyInPandas(added, f"label {label}, chunk long, n long, low long, high long, total double, codes binary, counts binary")


def block_five_numbers(vectors: DataFrame, cut, digits: int = 6, size: int = 4096) -> DataFrame:
    """(label, min, q1, median, mean, q3, max): distances of the pairs a < b of each label, with linear interpolation, from their histogram."""
    chunks = cut(pair_histogram(vectors, digits, size))
    whole = chunks.groupBy("label").agg(F.sum("n").alias("all"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("total").alias("total"))
    before = F.sum("n").over(W.partitionBy("label").orderBy("chunk")) - F.col("n")
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    place = {k: (F.col("all") - 1) * F.lit(p) for k, p in shares.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    rows = chunks.withColumn("before", before).join(whole.select("label", ranks.alias("ranks")), "label")
    rows = rows.withColumn("rank", F.explode("ranks")).filter("rank >= before AND rank < before + n")  # one chunk each
    rows = rows.select("label", "rank", (F.col("rank") - F.col("before")).alias("at"), "chunk", "codes", "counts")

    def value(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [np.frombuffer(c, np.uint16)[np.searchsorted(np.cumsum(np.frombuffer(n, np.int64)), at, side="right")] for c, n, at in zip(pdf["codes"], pdf["counts"], pdf["at"], strict=True)]
            yield pdf[["label", "rank"]].assign(value=(np.array(found, np.int64) + pdf["chunk"].to_numpy() * CHUNK) / 10.0**digits)

    values = rows.mapInPandas(value, f"label {dict(vectors.dtypes)['label']}, rank long, value double")
    values = values.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    scale = 10.0**digits

    def share(p: Column) -> Column:
        x, y = F.col("v")[F.floor(p)], F.col("v")[F.ceil(p)]
        return F.when(x == y, x).otherwise((F.ceil(p) - p) * x + (p - F.floor(p)) * y)

    q = {k: share(p).alias(k) for k, p in place.items()}
    return whole.join(values, "label").select(
        "label", (F.col("min") / scale).alias("min"), q["q1"], q["median"], (F.col("total") / F.col("all") / scale).alias("mean"), q["q3"], (F.col("max") / scale).alias("max"))


def nearest(dist: DataFrame, a: str = "a", d: str = "dist") -> DataFrame:
    """Rows at each a's smallest distance, ties kept."""
    return dist.withColumn("__r__", F.rank().over(W.partitionBy(a).orderBy(d))).filter("__r__ = 1").drop("__r__")


def within(dist: DataFrame, threshold: float, d: str = "dist") -> DataFrame:
    return dist.filter(F.col(d) <= threshold)


def five_numbers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, q1, median, mean, q3, max with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.min(value).alias("min"), p.alias("p"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return out.select(*keys, "min", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), "mean", F.col("p")[2].alias("q3"), "max")


def in_out_group(dist: DataFrame, group: DataFrame, include_self: bool = False) -> DataFrame:
    """(a, in_mean, in_median, out_mean, out_median): distances to a's own group and to the others.

    ``group``: id, grp. Self distances count as in-group only if ``include_self``.
    """
    rows = dist.join(group.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(
        group.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b")
    if not include_self:
        rows = rows.filter("a <> b")
    inside, outside = F.when(F.col("ga") == F.col("gb"), F.col("dist")), F.when(F.col("ga") != F.col("gb"), F.col("dist"))
    return rows.groupBy("a").agg(
        F.avg(inside).alias("in_mean"), F.percentile(inside, 0.5).alias("in_median"),
        F.avg(outside).alias("out_mean"), F.percentile(outside, 0.5).alias("out_median"))


def source_summaries(dist: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, a, source, in_group, out_group): per cluster and genome the six numbers of its distances to the other genomes
    of its source and to those of other sources, all sources in one pass.

    ``dist``: cluster, a, b, dist in both directions; ``labels``: id, source. A source with one genome in a cluster has no
    rows there; without a genome of another source ``out_group`` is null. A group is one row of a distance matrix.
    """
    own, other = labels.select(F.col("id").alias("a"), "source"), labels.select(F.col("id").alias("b"), F.col("source").alias("met"))
    rows = dist.filter("a <> b").join(own, "a").join(other, "b")
    within, beyond = F.when(F.col("source") == F.col("met"), F.col("dist")), F.when(F.col("source") != F.col("met"), F.col("dist"))

    def six(v: Column) -> Column:
        p = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        numbers = {"min": F.min(v), "q1": p[0], "median": p[1], "mean": F.avg(v), "q3": p[2], "max": F.max(v)}
        return F.when(F.count(v) > 0, F.struct(*[c.alias(n) for n, c in numbers.items()]))

    out = rows.groupBy("cluster", "a", "source").agg(six(within).alias("in_group"), six(beyond).alias("out_group"))
    return out.filter("in_group IS NOT NULL")


def medoids(dist: DataFrame, group: DataFrame) -> DataFrame:
    """(grp, medoid, total): per group the member with the smallest sum of distances within it, smallest id on ties."""
    rows = dist.join(group.select(F.col("id").alias("a"), "grp"), "a").join(
        group.select(F.col("id").alias("b"), F.col("grp").alias("g2")), "b").filter("grp = g2")
    total = rows.groupBy("grp", "a").agg(F.round(F.sum("dist"), 6).alias("total"))
    best = total.groupBy("grp").agg(F.min(F.struct("total", "a")).alias("b"))
    return best.select("grp", F.col("b.a").alias("medoid"), F.col("b.total").alias("total"))
