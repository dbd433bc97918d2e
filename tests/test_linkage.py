"""Clusterings by joins against plain versions: linkage, fuzzy memberships, leaders of alignments and distances by differences."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateralis.operators import alignments, clustering, genes, linkage
from lateralis.session import written as cut


def pairs_of(spark, d):
    rows = [(i, j, float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, "a long, b long, dist double")


def plain_merges(d, digits=10):
    """One pair at a time: the smallest rounded average, then the smallest pair."""
    groups = {i: [i] for i in range(len(d))}
    out = []
    while len(groups) > 1:
        h, a, b = min((round(float(np.mean(d[np.ix_(groups[a], groups[b])])), digits), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        out.append((a, b, h))
        groups[a] += groups.pop(b)
    return out


@pytest.mark.parametrize("n, kinds", [(40, 1000), (40, 4)], ids=["spread", "many ties"])
def test_average_merges(spark, n, kinds):
    r = np.random.default_rng(n + kinds)
    p = r.integers(0, kinds, (n, 2)).astype(float)
    d = np.abs(p[:, None] - p[None]).sum(axis=2)
    got = {(x.a, x.b, round(x.height, 8)) for x in linkage.average_merges(pairs_of(spark, d), cut).collect()}
    assert got == {(a, b, round(h, 8)) for a, b, h in plain_merges(d)}


def test_average_merges_of_200_points(spark):
    r = np.random.default_rng(5)
    p = r.integers(0, 30, (200, 2)).astype(float)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    merges = linkage.average_merges(pairs_of(spark, d), cut)
    want = clustering.average_linkage(p)
    assert sorted(round(x.height, 6) for x in merges.collect()) == pytest.approx(sorted(h for _, _, h in want), abs=0.3)
    heights = [0.5, 1.0, 3.0, 8.0]
    got = linkage.cut_merges(spark.range(200), merges, heights, cut).collect()
    steps = plain_steps(d, heights)
    assert {(x.id, x.height): x.cluster for x in got} == steps


def plain_steps(d, heights):
    """Clusters by merges of the scan over the matrix of averages, one pair at a time."""
    n = len(d)
    total, size, live = d.copy(), np.ones(n), list(range(n))
    own, out, now, rest = list(range(n)), {}, 0.0, sorted(heights)
    while True:
        mean = np.round(total / size[:, None] / size[None], 10)
        mean[np.tril_indices(n)] = np.inf
        sub = mean[np.ix_(live, live)]
        k = int(np.argmin(sub)) if len(live) > 1 else -1
        now = sub.flat[k] if k >= 0 else np.inf
        while rest and now > rest[0]:
            out |= {(i, rest[0]): own[i] for i in range(n)}
            rest.pop(0)
        if not rest:
            return out
        a, b = live[k // len(live)], live[k % len(live)]
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a] += size[b]
        live.remove(b)
        own = [a if x == b else x for x in own]


def test_parts_without_pairs_stay_apart(spark):
    rows = [("a", "b", 1.0), ("b", "a", 2.0), ("c", "d", 1.0), ("d", "e", 1.0), ("x", "x", 0.0)]
    d = spark.createDataFrame(rows, "a string, b string, dist double")
    merges = linkage.average_merges(d, cut)
    assert {tuple(r) for r in merges.collect()} == {("a", "b", 1.0), ("c", "d", 1.0)}  # c-e is unknown, so e stays
    ids = spark.createDataFrame([(x,) for x in "abcdex"], "id string")
    assert {(r.id, r.height): r.cluster for r in linkage.cut_merges(ids, merges, [0.5, 1.0], cut).collect()} == {
        **{(x, 0.5): x for x in "abcdex"}, **{(x, 1.0): c for x, c in zip("abcdex", "aaccex", strict=True)}}
    assert linkage.average_merges(d.limit(0), cut).collect() == []


def test_row_distances(spark):
    r = np.random.default_rng(2)
    m = r.random((12, 12)) * (r.random((12, 12)) < 0.6)
    m = np.triu(m, 1) + np.triu(m, 1).T
    rows = [(i, j, float(m[i, j])) for i in range(12) for j in range(i) if m[i, j]]
    got = {(x.a, x.b): x.dist for x in linkage.row_distances(spark.createDataFrame(rows, "a long, b long, dist double"), cut).collect()}
    want = {(i, j): float(np.sqrt(((m[i] - m[j]) ** 2).sum())) for i in range(12) for j in range(i + 1, 12)}
    assert got.keys() <= want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert all(not set(np.flatnonzero(m[i]) ) & set(np.flatnonzero(m[j])) and not m[i, j] for i, j in want.keys() - got.keys())


def plain_fuzzy(d, u, power, tol, most):
    objective, objectives = None, []
    for rounds in range(most + 1):
        w = u**power
        t, s = d @ w, w.sum(axis=0)
        q = (w * t).sum(axis=0)
        now = float((q / (2 * s)).sum())
        objectives.append(now)
        if objective is not None and abs(objective - now) <= tol * abs(objective):
            return u, objectives, rounds, True
        objective = now
        if rounds == most:
            return u, objectives, rounds, False
        x = np.maximum(t / s - q / (2 * s * s), 1e-12) ** (-1 / (power - 1))
        u = x / x.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("power, k, most", [(2.0, 3, 60), (25.0, 5, 4)])
def test_fuzzy_memberships(spark, power, k, most):
    r = np.random.default_rng(7)
    p = np.concatenate([r.normal(c, 0.4, (20, 2)) for c in (0, 3, 6)])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    df = pairs_of(spark, d)
    start = {x.id: x.u for x in linkage.first_memberships(spark.range(60), k).collect()}
    assert all(sum(u) == pytest.approx(1) and max(u) == pytest.approx(0.9) for u in start.values())
    u, objectives, rounds, converged = plain_fuzzy(d, np.array([start[i] for i in range(60)]), power, 1e-5, most)
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(objectives))
    got = linkage.fuzzy_memberships(df, k, cut, power, 1e-5, most).collect()
    assert {(x.rounds, x.converged) for x in got} == {(rounds, converged)} and got[0].objective == pytest.approx(objectives[-1])
    for x in got:
        assert x.u == pytest.approx(list(u[x.id]), abs=1e-6) and x.membership == pytest.approx(max(u[x.id]), abs=1e-6)
    if power == 2.0:
        assert converged and len({frozenset(x.id for x in got if x.cluster == c) for c in range(3)} & {frozenset(range(i, i + 20)) for i in (0, 20, 40)}) == 3
    else:
        assert not converged


# --- alignments


def near_alignment(seed, n, width, algn="g"):
    r = random.Random(seed)
    heads = ["".join(r.choice("ACGT") for _ in range(width)) for _ in range(3)]
    out = []
    for i in range(n):
        s = list(r.choice(heads))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            s[r.randrange(width)] = r.choice("ACGT-N")
        out.append((algn, f"s{i:03d}", "".join(s)))
    return out


def plain_pair(a, b):
    raw = sum(x != y for x, y in zip(a, b, strict=True))
    both = [(x, y) for x, y in zip(a, b, strict=True) if "-" not in (x, y)]
    return raw, sum(x != y for x, y in both) / len(both) if both else None


def test_pair_distances(spark):
    rows = near_alignment(1, 25, 60) + near_alignment(2, 9, 7, "h") + [("h", "gaps", "-------"), ("one", "x", "ACGT"), ("none", "y", "")]
    df = spark.createDataFrame(rows, "algn string, seq_id string, seq string")
    got = {(x.algn, x.a, x.b): (x.raw, x.shared) for x in alignments.pair_distances(df, cut).collect()}
    want = {(g, a, b): plain_pair(x, y) for (g, a, x), (h, b, y) in itertools.product(rows, rows) if g == h and a < b}
    assert got.keys() == want.keys()
    for k, (raw, shared) in want.items():
        assert got[k][0] == raw and (got[k][1] is None if shared is None else got[k][1] == pytest.approx(shared))
    pair = df.alias("l").join(df.alias("r"), F.expr("l.algn = r.algn AND l.seq_id < r.seq_id AND l.seq <> ''"))
    raw, _ = genes.aligned_distance(F.col("l.seq"), F.col("r.seq"))
    assert {(x[0], x[1], x[2]): x[3] for x in pair.select("l.algn", "l.seq_id", "r.seq_id", raw).collect()} == {k: v[0] for k, v in got.items()}


def plain_leaders(rows, identity=0.01, substitutions=2):
    out = {}
    for algn in {g for g, _, _ in rows}:
        own = sorted((i, s) for g, i, s in rows if g == algn)
        heads = []
        for i, s in own:
            near = [plain_pair(s, h) for _, h in heads]
            if not any((d is not None and d <= identity) or raw <= substitutions for raw, d in near):
                heads.append((i, s))
        for i, s in own:
            out[algn, i] = min((plain_pair(s, h)[0], j) for j, h in heads)[1]
    return out


def test_alignment_leaders(spark):
    rows = near_alignment(3, 40, 90) + near_alignment(4, 30, 400, "h") + near_alignment(5, 12, 5, "short") + [("one", "x", "AC")]
    df = spark.createDataFrame(rows, "algn string, seq_id string, seq string")
    got = {(x.algn, x.seq_id): x.leader for x in alignments.alignment_leaders(df, cut).collect()}
    assert got == plain_leaders(rows) and len(set(got.values())) < len(got)
    plan = alignments.pair_distances(df, cut)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert alignments.alignment_leaders(df.limit(0), cut).collect() == []


def test_nearest_copy_and_split(spark):
    rows = [("g", 1, "a", "ACGTA"), ("g", 1, "b", "ACGTT"), ("g", 2, "c", "ACGTT"), ("g", 3, "d", "ACGTT"), ("g", 3, "e", "ACGTT"), ("h", 1, "z", "A")]
    df = spark.createDataFrame(rows, "algn string, genome int, seq_id string, seq string")
    assert {(r.algn, r.genome, r.seq_id) for r in alignments.nearest_copy(df, cut).collect()} == {("g", 1, "b"), ("g", 2, "c"), ("g", 3, "d"), ("h", 1, "z")}
    whole = spark.createDataFrame([("x", "AACCC"), ("y", "GGTT-")], "seq_id string, seq string")
    parts = spark.createDataFrame([("p", 1, 2), ("q", 3, 5)], "gene string, start int, end int")
    names = spark.createDataFrame([("x",), ("y",)], "seq_id string")
    assert {tuple(r) for r in alignments.split_alignment(whole, parts, names).collect()} == {("p", "x", "AA"), ("q", "x", "CCC"), ("p", "y", "GG"), ("q", "y", "TT-")}
    with pytest.raises(Exception, match="names do not match: y"):
        alignments.split_alignment(whole, parts, names.limit(1)).collect()
