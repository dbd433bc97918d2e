"""Tree preparation, event and gene operators on hand-sized inputs and random trees against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lateralis.operators import clustering, events, genes, rooting, statistics, tree
from lateralis.session import cut

SCHEMA = "edge int, parent_edge int, is_tip boolean, length double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def closure(edges):
    return cut(tree.ancestor_closure(edges, cut))


def between(rows):
    """{(a, b): distance} of all tips, in plain Python."""
    up = {r[0]: (r[1], r[3]) for r in rows}

    def path(e):
        out = {}
        while e is not None:
            out[e] = up[e][1]
            e = up[e][0]
        return out

    paths = {r[0]: path(r[0]) for r in rows if r[2]}
    return {(a, b): sum(v for k, v in paths[a].items() if k not in paths[b]) + sum(v for k, v in paths[b].items() if k not in paths[a])
            for a in paths for b in paths if a < b}, {e: sum(p.values()) for e, p in paths.items()}


def random_tree(seed, n=12):
    """Nodes get two or more children until there are ``n`` tips; the root may have two."""
    r = random.Random(seed)
    parents, tips, k = {}, [None], 0
    while len(tips) < n:
        at = tips.pop(r.randrange(len(tips)))
        for _ in range(r.choice([2, 2, 3])):
            k += 1
            parents[k] = at
            tips.append(k)
    return [(e, p, e in tips, float(r.randrange(0, 6))) for e, p in parents.items()]


def collected(df):
    return [tuple(r) for r in df.select(*rooting.COLUMNS).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_midpoint_keeps_distances(spark, seed):
    rows = random_tree(seed)
    edges = frame(spark, rows)
    out = collected(rooting.midpoint_root(edges, closure(edges), cut))
    before, _ = between(rows)
    after, depth = between(out)
    assert {k: pytest.approx(v) for k, v in before.items()} == after
    longest = max(before.values())
    assert sorted(depth.values())[-2:] == [pytest.approx(longest / 2)] * 2 and all(r[3] >= 0 for r in out)
    children = [r[1] for r in out]
    assert all(children.count(p) > 1 for p in children)


def test_midpoint_of_nothing(spark):
    flat = [(1, None, True, 0.0), (2, None, True, 0.0)]
    assert sorted(collected(rooting.midpoint_root(frame(spark, flat), closure(frame(spark, flat)), cut))) == flat
    empty = frame(spark, [])
    assert collected(rooting.midpoint_root(empty, closure(empty), cut)) == []


@pytest.mark.parametrize("seed", [5, 6])
def test_keep_resolve_unroot(spark, seed):
    rows = random_tree(seed)
    edges = frame(spark, rows)
    before, _ = between(rows)
    tips = sorted(r[0] for r in rows if r[2])
    kept = tips[::2]
    out = collected(rooting.keep_tips(edges, closure(edges), spark.createDataFrame([(k,) for k in kept], "edge int")))
    after, _ = between(out)
    assert after == {k: pytest.approx(v) for k, v in before.items() if k[0] in kept and k[1] in kept}
    assert all([r[1] for r in out].count(r[1]) > 1 for r in out)
    two = collected(rooting.resolve(edges))
    assert between(two)[0] == {k: pytest.approx(v) for k, v in before.items()}
    assert all([r[1] for r in two].count(r[1]) == 2 for r in two) and len({r[0] for r in two}) == len(two)
    open_ = collected(rooting.unroot(frame(spark, two)))
    assert between(open_)[0] == {k: pytest.approx(v) for k, v in before.items()} and len(open_) == len(two) - 1


def test_order_outgroup_labels(spark):
    rows = [(1, None, True, 1.0), (2, None, False, 2.0), (3, 2, True, 1.0), (4, 2, True, 1.0), (5, None, False, 1.5), (6, 5, True, 0.5), (7, 5, True, 0.5)]
    edges = frame(spark, rows)
    c = closure(edges)
    assert [r.edge for r in rooting.tip_order(edges, c).orderBy("position").collect()] == [1, 3, 4, 6, 7]
    assert [r.edge for r in rooting.outgroup(edges, c).collect()] == [1]
    labels = spark.createDataFrame([(2, "x"), (4, "y")], "edge int, label string")
    assert {r.edge: r.label for r in rooting.nearest_label(labels, c).collect()} == {2: "x", 3: "x", 4: "y"}
    with pytest.raises(Exception, match="several labels"):
        rooting.nearest_label(labels.union(spark.createDataFrame([(2, "z")], labels.schema)), c).collect()
    states = spark.createDataFrame([("f", 1, 1), ("f", 3, 1)], "feature string, edge int, state int")
    assert {r.edge: r.state for r in rooting.zero_outgroup(states, spark.createDataFrame([(1,)], "edge int")).collect()} == {1: 0, 3: 1}
    gone = rooting.drop_tips(edges, c, spark.createDataFrame([(3,), (6,), (7,)], "edge int"))
    assert sorted(collected(gone)) == [(1, None, True, 1.0), (4, None, True, 3.0)]


def test_sequence_types(spark):
    rows = [("MLST.Kp.258", "K p"), ("MLST.Kp_2.5,MLST.Kp_1.11", "K p"), ("MLST.a,b", "K p"), ("none", "K p"), (None, "K p")]
    df = spark.createDataFrame(rows, "m string, sp string")
    st = events.sequence_type(F.col("m"), F.col("sp"))
    assert [r[0] for r in df.select(st).collect()] == ["K p ST258", "K p ST11", "Other", "Other", "Other"]
    assert [r[0] for r in df.select(events.strain_label(st, F.col("sp"))).collect()] == ["K p ST258", "K p ST11", "K p", "K p", "K p"]


def test_alignments(spark):
    rows = spark.createDataFrame([(1, "a", "AC-T"), (1, "b", "AC-T"), (1, "c", "AGGT"), (2, "a", "TT")], "algn int, seq_id string, seq string")
    unique, names = genes.unique_sequences(rows)
    assert unique.count() == 3
    assert sorted(map(tuple, genes.expand(unique, names).collect())) == sorted(map(tuple, rows.collect()))
    kept = genes.columns_kept(rows)
    assert [tuple(r) for r in kept.collect()] == [(1, 1)]
    assert {(r.algn, r.seq_id): r.seq for r in genes.keep_columns(rows, kept).collect()} == {(1, "a"): "C", (1, "b"): "C", (1, "c"): "G"}
    raw, shared = genes.aligned_distance(F.col("x"), F.col("y"))
    d = spark.createDataFrame([("AC-T", "AGGT"), ("A", "AC"), ("-", "A"), ("", "")], "x string, y string")
    assert [tuple(r) for r in d.select(raw, shared).collect()] == [(2, pytest.approx(1 / 3)), (1, 0.0), (1, None), (0, None)]
    whole = genes.concatenate(rows.select("algn", F.col("seq_id").alias("genome"), "seq"))
    assert {r.genome: r.seq for r in whole.collect()} == {"a": "AC-TTT", "b": "AC-T--", "c": "AGGT--"}


def test_cut_genes(spark):
    g = spark.createDataFrame([("g", 1, 1, 3, "+"), ("g", 1, 1, 3, "-"), ("g", 2, 0, 0, "+")], "genome string, contig int, start int, end int, strand string")
    c = spark.createDataFrame([("g", 1, "AACGT")], "genome string, contig int, seq string")
    assert sorted(r.seq for r in genes.cut_genes(g, c).collect()) == ["ACG", "CGT"]


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_scan(spark, seed):
    r = random.Random(seed)
    ids = list(range(60))
    rows = [(a, b, r.random(), r.random() < 0.8) for a in ids for b in ids if a < b and r.random() < 0.2]
    good = {(a, b) for a, b, score, agrees in rows if score >= 0.6 and agrees}
    heads, want = [], {}
    for i in ids:
        want[i] = next((h for h in heads if (h, i) in good), i)
        heads += [i] if want[i] == i else []
    pairs = spark.createDataFrame(rows, "a int, b int, score double, agrees boolean")
    found = clustering.duplicate_clusters(pairs, spark.createDataFrame([(i,) for i in ids], "id int"), cut, 0.6)
    assert {x.id: x.leader for x in found.collect()} == want


def test_permutations_in_parts(spark):
    """Many parts deal the same labels as one, each label once; ranges add up in any number of parts."""
    items = spark.range(500).select((F.col("id") * 3).alias("id"), F.col("id").alias("label"))
    one, many = (statistics.label_permutations(items, 2, per_part=n) for n in (1000, 60))
    a = {(r.perm, r.id): r.label for r in one.collect()}
    assert a == {(r.perm, r.id): r.label for r in many.collect()} and len(set(a.values())) == 500
    edges = spark.range(1, 40).select(F.col("id").alias("edge"), (F.col("id") % 4).cast("double").alias("length"))
    r1, r2 = ({r.edge: (r.low, r.high) for r in statistics.length_ranges(edges, n).collect()} for n in (1, 7))
    assert all(r1[e] == pytest.approx(r2[e], abs=1e-12) for e in r1) and max(h for _, h in r1.values()) == pytest.approx(1)
