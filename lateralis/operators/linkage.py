"""Clusterings of a distance table in rounds of joins: average linkage, its cuts, and fuzzy memberships.

``pairs`` and ``dist`` are long tables (a, b, dist), one row for a pair in either order; nothing holds a matrix or a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(pairs: DataFrame) -> DataFrame:
    """(a, b, dist) with a < b, the smallest value where a pair comes more than once."""
    rows = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")
    return rows.groupBy("a", "b").agg(F.min("dist").alias("dist"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair of ``once``."""
    rows = once(pairs)
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


def row_distances(pairs: DataFrame, cut) -> DataFrame:
    """(a, b, dist), a < b: Euclidean distances between the rows of a symmetric matrix whose diagonal and missing cells are 0.

    Cells meet at their column and are added up per pair of rows before any exchange of the sums.
    """
    cells = mirrored(pairs)
    own = cells.select("a").distinct()
    cells = cut(cells.unionByName(own.select("a", F.col("a").alias("b"), F.lit(0.0).alias("dist"))))
    left = cells.select("a", F.col("b").alias("k"), F.col("dist").alias("x"))
    right = cells.select(F.col("a").alias("b"), F.col("b").alias("k"), F.col("dist").alias("y"))
    met = left.join(right, "k").filter("a < b").groupBy("a", "b").agg(
        F.sum((F.col("x") - F.col("y")) ** 2).alias("both"), F.sum(F.col("x") ** 2).alias("x"), F.sum(F.col("y") ** 2).alias("y"), F.count(F.lit(1)).alias("n"))
    row = cells.groupBy("a").agg(F.sum(F.col("dist") ** 2).alias("square"), F.count(F.lit(1)).alias("cells"))
    a, b = row.toDF("a", "square_a", "cells_a"), row.toDF("b", "square_b", "cells_b")
    rows = met.join(a, "a").join(b, "b")

    def alone(whole: str, part: str, n: str) -> Column:  # squares of the cells that the other row lacks
        return F.when(F.col("n") == F.col(n), 0.0).otherwise(F.greatest(F.col(whole) - F.col(part), F.lit(0.0)))

    return rows.select("a", "b", F.sqrt(F.col("both") + alone("square_a", "x", "cells_a") + alone("square_b", "y", "cells_b")).alias("dist"))


def average_merges(pairs: DataFrame, cut, digits: int = 10) -> DataFrame:
    """(a, b, height): average-linkage merges of two clusters, each named by its smallest member, a < b.

    A pair without a row is infinitely far, so parts that no chain of rows connects stay apart. Of equal heights (to
    ``digits`` places) the pair with the smallest a, then b, merges first. In each round all pairs of clusters merge that are nearest
    to each other: an average of two distances is never below both, so no later merge can come between them and
    the merges are those of the scan that takes one pair at a time. Distances of merged clusters are sums and counts added
    up, so an update is a relabelling and one aggregation.
    """
    live = cut(once(pairs).select("a", "b", F.col("dist").alias("total"), F.lit(1).cast("long").alias("n")))
    size = cut(live.select("a").unionByName(live.select(F.col("b").alias("a"))).distinct().withColumn("size", F.lit(1).cast("long")))
    merges: list[DataFrame] = []
    while True:
        rows = live.join(size.withColumnRenamed("size", "size_a"), "a").join(size.select(F.col("a").alias("b"), F.col("size").alias("size_b")), "b")
        pair = F.struct(F.round(F.col("total") / F.col("n"), digits).alias("height"), "a", "b").alias("pair")
        known = rows.filter(F.col("n") == F.col("size_a") * F.col("size_b")).select(pair)
        ends = known.select(F.col("pair.a").alias("end"), "pair").unionByName(known.select(F.col("pair.b").alias("end"), "pair"))
        nearest = ends.groupBy("end").agg(F.min("pair").alias("pair"))
        mutual = cut(nearest.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("pair.a", "pair.b", "pair.height"))
        if mutual.isEmpty():
            return cut(reduce(DataFrame.unionByName, merges, mutual))
        merges.append(mutual)
        def moved(df: DataFrame, column: str, mutual: DataFrame = mutual) -> DataFrame:
            into = mutual.select(F.col("b").alias(column), F.col("a").alias("into"))
            return df.join(into, column, "left").withColumn(column, F.coalesce("into", column)).drop("into")

        both = moved(moved(live, "a"), "b").filter("a <> b")
        both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "n")
        live = cut(both.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        size = cut(moved(size, "a").groupBy("a").agg(F.sum("size").alias("size")))


def cut_merges(ids: DataFrame, merges: DataFrame, heights: list[float], cut) -> DataFrame:
    """(id, height, cluster): the clusters after all merges up to each height, named by their smallest member.

    ``ids`` has every id, those without merges too. A cluster points to the one that it went into; pointers are doubled.
    """
    each = ids.select("id").distinct().withColumn("height", F.explode(F.array(*[F.lit(float(h)) for h in heights])))
    up = merges.select(F.col("b").alias("id"), F.col("a").alias("up"), F.col("height").alias("at"))
    rows = each.join(up, "id", "left").select("id", "height", F.when(F.col("at") <= F.col("height"), F.col("up")).otherwise(F.col("id")).alias("up"))
    while True:
        rows = cut(rows)
        above = rows.select(F.col("id").alias("up"), "height", F.col("up").alias("next"))
        far = rows.join(above, ["up", "height"])
        if far.filter("next <> up").isEmpty():
            return rows.select("id", "height", F.col("up").alias("cluster"))
        rows = far.select("id", "height", F.col("next").alias("up"))


def first_memberships(ids: DataFrame, k: int) -> DataFrame:
    """(id, u): the start of the fuzzy rounds: 0.9 for one cluster, the rest of 1 in equal parts for the others.

    The k smallest ids have a cluster each as their own, the others one by the hash of their id.
    """
    first = ids.select("id").distinct().orderBy("id").limit(k)
    numbered = first.agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.posexplode("ids").alias("own", "id"))
    rows = ids.select("id").distinct().join(F.broadcast(numbered), "id", "left")  # k rows
    own = F.coalesce("own", F.pmod(F.xxhash64("id"), F.lit(k)))
    u = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda v: F.when(v == own, 0.9 if k > 1 else 1.0).otherwise(0.1 / max(k - 1, 1)))
    return rows.select("id", u.alias("u"))


def fuzzy_memberships(dist: DataFrame, k: int, cut, power: float = 2.0, tol: float = 1e-5, most: int = 100, start: DataFrame | None = None) -> DataFrame:
    """(id, cluster, membership, u, rounds, objective, converged): fuzzy clustering of dissimilarities, without vectors or centres.

    Minimises the sum over clusters v of ``sum_ij u_iv^r u_jv^r d_ij / (2 sum_j u_jv^r)``, r being ``power``. A round takes, for each id and
    cluster, the weighted mean distance to the cluster less half the cluster's own mean distance, and sets memberships
    in proportion to its -1/(r-1)-th power. It is one join of the pairs with the memberships; per round only two
    numbers a cluster reach the driver. ``converged`` says whether the objective, falling, moved by less than ``tol`` of itself within
    ``most`` rounds; ``objective`` is the last one. A missing pair counts as distance 0. The cluster of ties is the first.
    """
    pairs = cut(mirrored(dist))
    ids = pairs.select(F.col("a").alias("id")).distinct()
    u = cut(start if start is not None else first_memberships(ids, k))
    w = [F.col("w")[v] for v in range(k)]
    objective, converged, rounds = None, False, 0
    while True:
        weights = u.select("id", "u", F.transform("u", lambda x: F.pow(x, F.lit(float(power)))).alias("w"))
        towards = pairs.join(weights.select(F.col("id").alias("b"), "w"), "b").groupBy(F.col("a").alias("id")).agg(
            F.array(*[F.sum(F.col("dist") * x) for x in w]).alias("t"))
        rows = cut(weights.join(towards, "id"))
        sums = rows.agg(*[F.sum(x).alias(f"s{v}") for v, x in enumerate(w)], *[F.sum(x * F.col("t")[v]).alias(f"q{v}") for v, x in enumerate(w)]).first()
        s, q = [sums[f"s{v}"] or 0.0 for v in range(k)], [sums[f"q{v}"] or 0.0 for v in range(k)]
        now = sum(b / (2 * a) for a, b in zip(s, q, strict=True) if a > 0)
        converged = objective is not None and abs(objective - now) <= tol * abs(objective)
        objective = now
        if converged or rounds == most:
            break
        rounds += 1
        apart = [F.greatest(F.col("t")[v] / a - b / (2 * a * a), F.lit(1e-12)) if a > 0 else F.lit(1e300) for v, (a, b) in enumerate(zip(s, q, strict=True))]
        near = F.array(*[F.pow(x, F.lit(-1.0 / (power - 1))) for x in apart])
        rows = rows.select("id", near.alias("x")).withColumn("sum", F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
        u = cut(rows.select("id", F.transform("x", lambda x: x / F.col("sum")).alias("u")))
    best = F.array_max("u")
    return u.select(
        "id", (F.array_position("u", best) - 1).cast("int").alias("cluster"), best.alias("membership"), "u", F.lit(rounds).alias("rounds"),
        F.lit(objective).cast("double").alias("objective"), F.lit(converged).alias("converged"))
