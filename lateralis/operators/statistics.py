"""Rank-sum and Kolmogorov-Smirnov tests, regression, weighted and label permutation tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tied_counts(rows: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """Per distinct value: n1, n2 (rows with and without ``first``) and what lies at or below it.

    Ranks are made from counts per distinct value, so the windows see each value once.
    """
    n = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumns({"c1": F.sum("n1").over(upto), "c2": F.sum("n2").over(upto)})


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def rank_sum(rows: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, w, z, p): Wilcoxon rank-sum, two-sided, normal with tie and continuity correction.

    ``w`` is the rank sum of the first sample less n1 (n1 + 1) / 2.
    """
    t = tied_counts(rows, keys, value, first)
    ties = F.col("n1") + F.col("n2")
    rank = F.col("c1") + F.col("c2") - (ties - 1) / 2
    s = t.groupBy(*keys).agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(rank * F.col("n1")).alias("r"),
        F.sum((ties * ties * ties - ties).cast("double")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    w = F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    off = w - n1 * n2 / 2
    z = F.try_divide(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sigma)
    out = s.select(*keys, "n1", "n2", w.alias("w"), z.alias("z"))
    return out.withColumn("p", F.least(erfc(F.col("z") / F.sqrt(F.lit(2.0))), F.lit(1.0)))


def ks_statistic(rows: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, d, p): largest gap between the two distribution functions, asymptotic p."""
    t = tied_counts(rows, keys, value, first)
    total = t.groupBy(*keys).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    t = t.select(*keys, "c1", "c2").join(total, keys) if keys else t.select("c1", "c2").crossJoin(F.broadcast(total))
    gap = F.abs(F.try_divide(F.col("c1"), F.col("n1")) - F.try_divide(F.col("c2"), F.col("n2")))
    out = t.groupBy(*keys, "n1", "n2").agg(F.max(gap).alias("d"))
    x = F.col("d") * F.sqrt(F.col("n1").cast("double") * F.col("n2") / (F.col("n1") + F.col("n2")))
    p = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))
    return out.withColumn("p", F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


def rank_sum_ways(n1: Column, n2: Column) -> Column:
    """For w = 0, 1, ..., n1 n2: in how many of the orders of n1 + n2 different values the rank-sum statistic is w.

    Ranks are dealt out one after the other: ``ways[k][w]`` counts the choices of k ranks whose sum is k (k + 1) / 2 + w.
    """
    size = n1 * n2 + 1
    zeros = F.array_repeat(F.lit(0.0), size.cast("int"))
    one = F.concat(F.array(F.lit(1.0)), F.slice(zeros, F.lit(1), (size - 1).cast("int")))
    start = F.concat(F.array(one), F.array_repeat(zeros, n1.cast("int")))

    def dealt(ways: Column, rank: Column) -> Column:
        def chosen(k: Column) -> Column:  # the k-th smallest rank chosen exceeds its least value, k, by rank - k
            shift = F.greatest(F.lit(0), F.least(rank - k, size)).cast("int")
            moved = F.slice(F.concat(F.slice(zeros, F.lit(1), shift), F.get(ways, k - 1)), F.lit(1), size.cast("int"))
            return F.when(rank < k, F.get(ways, k)).otherwise(F.zip_with(F.get(ways, k), moved, lambda a, b: a + b))

        return F.transform(F.sequence(F.lit(0), n1.cast("int")), lambda k: F.when(k == 0, F.get(ways, F.lit(0))).otherwise(chosen(k)))

    done = F.aggregate(F.sequence(F.lit(1), (n1 + n2).cast("int")), start, dealt)
    return F.get(done, n1.cast("int"))


def exact_rank_sum(tests: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Adds ``exact_p``: two-sided, by the counted distribution, to tests (n1, n2, w) of samples of 1 to 49 different values.

    Twice the tail on the side of ``w``, at most 1. Other tests, and those with a fractional ``w`` (ties), get null.
    The distribution is made once for each pair of sizes that occurs.
    """
    fits = F.col("n1").between(1, 49) & F.col("n2").between(1, 49) & (F.col("w") == F.floor("w"))
    sizes = tests.filter(fits).select("n1", "n2").distinct()
    made = sizes.select(F.col("n1").alias("__n1__"), F.col("n2").alias("__n2__"), rank_sum_ways(F.col("n1"), F.col("n2")).alias("__ways__"))
    low = F.when(F.col("w") * 2 > F.col("n1") * F.col("n2"), F.col("n1") * F.col("n2") - F.col("w")).otherwise(F.col("w"))  # symmetric
    total = F.aggregate("__ways__", F.lit(0.0), lambda a, b: a + b)
    tail = F.aggregate(F.slice("__ways__", F.lit(1), (low + 1).cast("int")), F.lit(0.0), lambda a, b: a + b)
    rows = tests.join(made, fits & (F.col("n1") == F.col("__n1__")) & (F.col("n2") == F.col("__n2__")), "left")
    p = F.when(F.col("__ways__").isNotNull(), F.least(2 * tail / total, F.lit(1.0)))
    return rows.withColumn("exact_p", p).drop("__n1__", "__n2__", "__ways__")


def exact_ks(tests: DataFrame, most: int = 10_000) -> DataFrame:
    """Adds ``exact_p`` to tests (n1, n2, d): the share of orders of n1 + n2 different values whose largest gap is d or more.

    An order is a path from (0, 0) to (n1, n2); paths that stay below the gap are counted row by row. Tests with n1 n2 of
    ``most`` or more, or without values on a side, get null. A gap is compared with an allowance of half a step of 1 / (n1 n2).
    """
    n1, n2, d = F.col("n1").cast("int"), F.col("n2").cast("int"), F.col("d")
    fits = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") * F.col("n2") < most)
    step = 0.5 / (F.col("n1") * F.col("n2"))
    columns = F.sequence(F.lit(0), n2)

    def below(i: Column, j: Column) -> Column:
        return F.abs(i / n1 - j / n2) < d - step

    def row(before: Column, i: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            left = F.when(j > 0, F.element_at(made, -1)).otherwise(0.0)
            return F.array_append(made, F.when(below(i, j), F.get(before, j) + left).otherwise(0.0))

        return F.aggregate(columns, F.array().cast("array<double>"), cell)

    first = F.aggregate(columns, F.array().cast("array<double>"), lambda made, j: F.array_append(
        made, F.when(below(F.lit(0), j) & ((j == 0) | (F.element_at(F.concat(F.array(F.lit(1.0)), made), -1) > 0)), 1.0).otherwise(0.0)))
    last = F.aggregate(F.sequence(F.lit(1), n1), first, row)
    paths = F.aggregate(F.sequence(F.lit(1), n1), F.lit(1.0), lambda a, k: a * (n2 + k) / k)  # n1 + n2 over n1
    p = 1 - F.element_at(last, -1) / paths
    sizes = tests.filter(fits & d.isNotNull()).select("n1", "n2", "d").distinct().withColumn("exact_p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return tests.join(sizes, ["n1", "n2", "d"], "left").select(*tests.columns, "exact_p")


def linear_model(rows: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r, n) of y on x."""
    return rows.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
        F.regr_count(y, x).alias("n"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def permutation_draws(clusters: DataFrame, permutations: int, seed: int = 144) -> DataFrame:
    """(cluster, observed, perm, event, u, dir): for each event a number in [0, 1) and a direction by the share of gains."""
    draws = clusters.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("event", F.explode(F.expr("sequence(1, n_events)")))
    c, m, e = F.col("cluster"), F.col("perm"), F.col("event")
    gain = uniform(F.lit(seed), c, m, e, F.lit("dir")) < F.col("gain_share")
    return draws.select("cluster", "observed", "perm", "event", uniform(F.lit(seed), c, m, e, F.lit("edge")).alias("u"), F.when(gain, 1).otherwise(2).alias("dir"))


def length_ranges(edges: DataFrame, parts: int = 256) -> DataFrame:
    """(edge, low, high): the share of the total length up to each edge, in the order of numeric edges.

    Sums run within ``parts`` ranges of edges, and over the sums of those.
    """
    first, last, total = edges.agg(F.min("edge"), F.max("edge"), F.sum("length")).first()
    width = max(1, ((last or 0) - (first or 0)) // parts + 1)
    rows = edges.select("edge", "length", F.floor((F.col("edge") - (first or 0)) / width).alias("part"))
    sums = rows.groupBy("part").agg(F.sum("length").alias("sum"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("base"))  # one row per part
    upto = W.partitionBy("part").orderBy("edge").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("length").over(upto)).join(sums, "part")
    high = F.try_divide(F.col("base") + F.col("upto"), F.lit(total))
    return rows.select("edge", (high - F.try_divide("length", F.lit(total))).alias("low"), high.alias("high"))


def permutation_hits(clusters: DataFrame, edges: DataFrame, marker: DataFrame, permutations: int, seed: int = 144, cells: int = 1024) -> DataFrame:
    """(cluster, observed, perm, n): how many drawn events fall on an edge where the marker changes the same way.

    A draw meets only the ranges of its own of ``cells`` equal parts of [0, 1); a range lies in every part that it touches.
    """
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells)))
    ranges = length_ranges(edges).join(marker, "edge").select("dir", "low", "high", cell.alias("cell"))
    draws = permutation_draws(clusters, permutations, seed).withColumn("cell", F.floor(F.col("u") * cells))
    inside = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
    return draws.join(ranges, ["dir", "cell"], "left").groupBy("cluster", "observed", "perm").agg(F.count_if(inside).alias("n"))


def weighted_permutations(clusters: DataFrame, edges: DataFrame, marker: DataFrame, permutations: int, seed: int = 144) -> DataFrame:
    """(cluster, observed, n_over, p): weighted permutation test of co-acquisition with a marker.

    ``clusters``: cluster, n_events, gain_share, observed. ``edges``: edge, length. ``marker``: edge, dir
    (1 gain, 2 loss). Each event draws an edge with a probability in proportion to its length and a direction by
    the cluster's share of gains; it counts when the marker changes the same way there. p is the
    share of permutations whose count is strictly over the observed one, so it can be 0.
    """
    hit = permutation_hits(clusters, edges, marker, permutations, seed)
    over = hit.groupBy("cluster", "observed").agg(F.count_if(F.col("n") > F.col("observed")).alias("n_over"))
    return over.withColumn("p", F.col("n_over") / permutations)


def hit_shares(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(dir, class, share): of the total length, the share of edges that are in a class for draws of a direction.

    ``marks``: dir, class, edge; an edge may have a class for either direction.
    """
    total = edges.agg(F.sum("length").alias("total"))
    rows = marks.select("dir", "class", "edge").distinct().join(edges.select("edge", "length"), "edge").groupBy("dir", "class").agg(F.sum("length").alias("length"))
    return rows.crossJoin(F.broadcast(total)).select("dir", "class", F.try_divide("length", "total").alias("share"))  # one number


def class_chances(clusters: DataFrame, edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(cluster, n_events, observed, class, chance): how likely a drawn event of each cluster is in each class.

    ``clusters``: cluster, n_events, gain_share, and observed if it is there. An event is a gain (dir 1) with the share of gains, else a loss.
    """
    shares = hit_shares(edges, marks).groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("dir") == 1, F.col("share"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("dir") == 2, F.col("share"))), F.lit(0.0)).alias("down"))
    rows = clusters.crossJoin(F.broadcast(shares))  # a row per class
    chance = F.col("gain_share") * F.col("up") + (1 - F.col("gain_share")) * F.col("down")
    return rows.select(*clusters.drop("gain_share").columns, "class", F.least(F.greatest(chance, F.lit(0.0)), F.lit(1.0)).alias("chance"))


def expected_classes(chances: DataFrame, permutations: int) -> DataFrame:
    """(class, expected): mean events of each class in all permutations of all clusters together."""
    return chances.groupBy("class").agg((F.sum(F.col("n_events") * F.col("chance")) * permutations).alias("expected"))


def binomial_steps(n: Column, p: Column) -> Column:
    """The chances of 0, 1, ..., n hits in n draws, as an array."""
    def step(made: Column, k: Column) -> Column:
        return F.array_append(made, F.element_at(made, -1) + F.ln((n - k + 1) / k) + F.ln(p) - F.ln(1 - p))

    inner = F.transform(F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(n * F.ln(1 - p)), step), lambda x: F.exp(x))
    none = F.array_repeat(F.lit(0.0), n.cast("int"))
    one = F.array(F.lit(1.0))
    usual = F.when(n > 0, inner).otherwise(one)
    return F.when(p <= 0, F.concat(one, none)).when(p >= 1, F.concat(none, one)).otherwise(usual)


def binomial_tail(n: Column, p: Column, observed: Column) -> Column:
    """The chance of more than ``observed`` hits in n draws, summed up in one pass without keeping the chances."""
    odds = F.ln(p) - F.ln(1 - p)

    def step(made: Column, k: Column) -> Column:
        log = made["log"] + F.ln((n - k + 1) / k) + odds
        return F.struct(log.alias("log"), (made["sum"] + F.when(k > observed, F.exp(log)).otherwise(0.0)).alias("sum"))

    none = F.when(observed < 0, 1.0).otherwise(0.0)
    start = n * F.ln(1 - p)
    first = F.struct(start.alias("log"), F.when(observed < 0, F.exp(start)).otherwise(0.0).alias("sum"))
    usual = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), first, step)["sum"]).otherwise(none)
    return F.least(F.when(p <= 0, none).when(p >= 1, F.when(n > observed, 1.0).otherwise(0.0)).otherwise(usual), F.lit(1.0))


def exact_permutations(chances: DataFrame) -> DataFrame:
    """(cluster, class, observed, p): the chance of strictly more hits than observed, which ``weighted_permutations`` estimates.

    The hits of a permutation are a sum of independent draws, so their number is binomial: no row per draw or permutation.
    """
    return chances.select("cluster", "class", "observed", binomial_tail(F.col("n_events"), F.col("chance"), F.col("observed")).alias("p"))


def strength(p: Column, permutations: int) -> Column:
    """-log10 of p and one permutation more, so that p = 0 has a value."""
    return -F.log10(p + 1.0 / permutations)


def sampled_permutations(chances: DataFrame, permutations: int, seed: int = 144) -> DataFrame:
    """(cluster, class, observed, n_over, p): as ``weighted_permutations``, with one draw per permutation, the number of its hits."""
    upto = F.aggregate(binomial_steps(F.col("n_events"), F.col("chance")), F.array().cast("array<double>"), lambda made, x: F.array_append(made, x + F.coalesce(F.get(made, F.size(made) - 1), F.lit(0.0))))
    rows = chances.select("cluster", "class", "observed", upto.alias("upto")).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    u = uniform(F.lit(seed), F.col("cluster"), F.col("class"), F.col("perm"))
    hits = F.size(F.filter("upto", lambda x: x <= u))
    over = rows.groupBy("cluster", "class", "observed").agg(F.count_if(hits > F.col("observed")).alias("n_over"))
    return over.withColumn("p", F.col("n_over") / permutations)


def permutation_totals(hits: DataFrame) -> DataFrame:
    """(perm, n): the hits of all clusters in each permutation."""
    return hits.groupBy("perm").agg(F.sum("n").alias("n"))


def bonferroni(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds ``significant``: p at most level / number of tests."""
    n = tests.agg(F.count(F.lit(1)).alias("__n__"))
    return tests.crossJoin(F.broadcast(n)).withColumn("significant", F.col("p") <= level / F.col("__n__")).drop("__n__")


def numbered(rows: DataFrame, keys: list[str], part: Column, order: list, name: str) -> DataFrame:
    """Adds ``name``: the place, from 1, of each row within ``keys``; ``part`` never falls along ``order``.

    Rows are numbered within parts, and the parts by the counts before them, so no task sorts a whole group.
    """
    rows = rows.withColumn("__part__", part)
    n = rows.groupBy(*keys, "__part__").agg(F.count(F.lit(1)).alias("__n__"))
    before = W.partitionBy(*keys).orderBy("__part__").rowsBetween(W.unboundedPreceding, -1)
    n = n.select(*keys, "__part__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__base__"))
    inside = F.row_number().over(W.partitionBy(*keys, "__part__").orderBy(*order))
    out = rows.withColumn("__in__", inside).join(n, [*keys, "__part__"])
    return out.withColumn(name, F.col("__base__") + F.col("__in__")).drop("__part__", "__in__", "__base__")


def sums_before(rows: DataFrame, keys: list[str], at: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` with a smaller ``at``, an integer, distinct within keys.

    Sums run within ranges of ``width`` numbers, and over the sums of those. Null keys are keys like others.
    """
    rows = rows.withColumn("__range__", F.floor(F.col(at) / width))
    total = rows.groupBy(*keys, "__range__").agg(F.sum(value).alias("__sum__"))
    earlier = W.partitionBy(*keys).orderBy("__range__").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*[F.col(k).alias(f"__{k}__") for k in keys], F.col("__range__").alias("__of__"), F.coalesce(F.sum("__sum__").over(earlier), F.lit(0)).alias("__base__"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "__range__").orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    on = F.col("__range__") == F.col("__of__")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}__"))
    out = rows.withColumn("__in__", inside).join(total, on)
    return out.withColumn(name, F.col("__base__") + F.col("__in__")).drop("__range__", "__of__", "__base__", "__in__", *[f"__{k}__" for k in keys])


def label_permutations(items: DataFrame, permutations: int, seed: int = 144, per_part: int = 100_000) -> DataFrame:
    """(perm, id, label): the labels of (id, label) dealt anew to the numeric ids, once per permutation."""
    parts = items.count() // per_part + 1
    bounds = items.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    place = numbered(items.select("id"), [], at, ["id"], "k").select("id", "k")
    perms = items.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("u", uniform(F.lit(seed), F.col("perm"), F.col("id")))
    drawn = numbered(perms, ["perm"], F.floor(F.col("u") * parts), ["u", "id"], "k").select("perm", "k", "label")
    return drawn.hint("merge").join(place.hint("merge"), "k").select("perm", "id", "label")  # no table of all ids goes to the driver
