"""Tip order, likelihood reconstruction and the call from a tree to transitions against plain versions."""

import math
import random

import pytest

from lateralis.operators import likelihood, rooting, transitions, tree
from lateralis.session import written as cut
from lateralis.sources import formats

EDGES = "edge long, parent_edge long, is_tip boolean, length double"


def random_tree(seed, tips, most=3):
    """Rows (edge, parent, is_tip, length) of a random tree; edges are numbered at random, so children are not in reading order."""
    r = random.Random(seed)
    nodes, rows, free = [None], [], list(range(1, 10 * tips))
    r.shuffle(free)
    parents = {}
    open_ = [(None, tips)]
    while open_:
        parent, n = open_.pop()
        if n == 1 and parent is not None:
            continue
        k = min(n, r.randint(2, most))
        sizes = [1] * k
        for _ in range(n - k):
            sizes[r.randrange(k)] += 1
        for size in sizes:
            e = free.pop()
            parents[e] = parent
            rows.append((e, parent, size == 1, round(r.choice([0.0, r.random(), 3 * r.random()]), 3)))
            open_.append((e, size))
    assert nodes and len([x for x in rows if x[2]]) == tips
    return rows


def displayed(rows):
    below = {}
    for e, p, tip, _ in rows:
        below.setdefault(p, []).append((e, tip))
    out, stack = [], sorted(below[None], reverse=True)
    while stack:
        e, tip = stack.pop()
        if tip:
            out.append(e)
        stack += sorted(below.get(e, []), reverse=True)
    return out


@pytest.mark.parametrize("rows", [random_tree(1, 60), random_tree(2, 40, 9), [(i, None, True, 1.0) for i in range(50, 0, -1)]], ids=["tree", "wide", "star"])
def test_tip_order_by_subtree_sizes(spark, rows):
    edges = spark.createDataFrame(rows, EDGES)
    closure = tree.ancestor_closure(edges, cut)
    order = rooting.tip_order(edges, closure, width=7)
    assert [r.edge for r in sorted(order.collect(), key=lambda r: r.position)] == displayed(rows)
    assert sorted(r.position for r in order.collect()) == list(range(1, sum(r[2] for r in rows) + 1))
    plan = order._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SinglePartition" not in plan
    ends = [displayed(rows)[0], displayed(rows)[-1]]
    length = {r[0]: r[3] for r in rows}
    assert rooting.outgroup(edges, closure).first().edge == (ends[1] if length[ends[1]] > length[ends[0]] else ends[0])


# --- likelihood


def plain_up(rows, states, gain, loss):
    below = {}
    for e, p, _, t in rows:
        below.setdefault(p, []).append((e, t))
    scale = 0.0

    def p_of(t):
        stay = math.exp(-(gain + loss) * t)
        up, down = gain / (gain + loss) * (1 - stay), loss / (gain + loss) * (1 - stay)
        return [[1 - up, up], [down, 1 - down]]

    part = {}

    def up(e):
        nonlocal scale
        if e in states:
            part[e] = [1.0 - states[e], float(states[e])]
            return part[e]
        l = [1.0, 1.0]
        for c, t in below[e]:
            v, p = up(c), p_of(t)
            l = [l[x] * (p[x][0] * v[0] + p[x][1] * v[1]) for x in (0, 1)]
        top = max(l)
        scale += math.log(top)
        part[e] = [x / top for x in l]
        return part[e]

    root = up(None)
    return scale + math.log(sum(root)), part, p_of, below


def plain_fit(rows, states, rounds=10):
    gain = loss = 0.1
    step = 2.0
    for _ in range(rounds):
        tried = []
        for c in range(25):
            g, q = (min(max(x * math.exp(step * (k - 2)), 1e-8), 1e4) for x, k in ((gain, c // 5), (loss, c % 5)))
            tried.append((round(plain_up(rows, states, g, q)[0], 9), -abs(c - 12), -c, g, q))
        _, _, _, gain, loss = max(tried)
        step /= 2
    return gain, loss


def plain_posterior(rows, states, gain, loss, node):
    """P(node is 1 | tips) with equal weights at the root: the share of the likelihood with the node held at 1."""
    both = []
    for held in (0, 1):
        loglik, part, p_of, below = plain_up(rows, states, gain, loss)

        def up(e, held=held, p_of=p_of, below=below):
            if e in states:
                l = [1.0 - states[e], float(states[e])]
            else:
                l = [1.0, 1.0]
                for c, t in below[e]:
                    v, p = up(c), p_of(t)
                    l = [l[x] * (p[x][0] * v[0] + p[x][1] * v[1]) for x in (0, 1)]
            return [l[x] if e != node or x == held else 0.0 for x in (0, 1)]

        both.append(sum(up(None)))
    return both[1] / sum(both)


@pytest.mark.parametrize("seed, most", [(3, 2), (4, 4)])
def test_likelihood_states(spark, seed, most):
    rows = [(e, p, tip, t + 0.02) for e, p, tip, t in random_tree(seed, 14, most)]
    r = random.Random(seed)
    tips = [e for e, _, tip, _ in rows if tip]
    states = {f: {e: r.randrange(2) if f != "rare" else int(e == tips[0]) for e in tips} for f in ("a", "rare")}
    states |= {"none": dict.fromkeys(tips, 0), "all": dict.fromkeys(tips, 1)}
    edges = spark.createDataFrame(rows, EDGES)
    df = spark.createDataFrame([(f, e, s) for f, x in states.items() for e, s in x.items()], "feature string, edge long, state int")
    found, root = likelihood.likelihood_states(edges, df, tree.ancestor_closure(edges, cut), cut, rounds=5)
    got = {(x.feature, x.edge): x for x in found.collect()}
    tops = {x.feature: x for x in root.collect()}
    assert len(got) == 4 * len(rows) and set(tops) == set(states)
    for f in ("none", "all"):
        assert tops[f].root is None and tops[f].gain is None and all(got[f, e].state is None for e, *_ in rows)
    for f in ("a", "rare"):
        gain, loss = plain_fit(rows, states[f], 5)
        assert (tops[f].gain, tops[f].loss) == (pytest.approx(gain), pytest.approx(loss))
        assert tops[f].loglik == pytest.approx(plain_up(rows, states[f], gain, loss)[0], abs=1e-6)
        for e in [None, *[e for e, _, tip, _ in rows if not tip]]:
            p = plain_posterior(rows, states[f], gain, loss, e)
            mine = tops[f].p1 if e is None else got[f, e].p1
            assert mine == pytest.approx(p, abs=1e-6)
            assert (tops[f].root if e is None else got[f, e].state) == int(round(mine, 9) > 0.5)
        assert all(got[f, e].state == s for e, s in states[f].items())


# --- from a tree to transitions


@pytest.fixture(scope="module")
def newick(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tree") / "t.nwk"
    path.write_text("(((A:1,B:1):1,(C:1,D:1):1):1,(E:1,O:4):1);\n")
    return formats.read_newick(spark, f"file://{path}")


def features_of(spark, **carried):
    rows = [(t, f, int(t in on)) for f, on in carried.items() for t in "ABCDEO"] + [("elsewhere", "f", 1)]
    return spark.createDataFrame(rows, "label string, feature string, state int")


def test_transitions_by_parsimony(spark, newick):
    feats = features_of(spark, f="AB", g="O", h="ABCDE")
    tips = {r.label: r.edge for r in newick.filter("is_tip").collect()}
    parent = {r.edge: r.parent_edge for r in newick.collect()}
    got = {tuple(r) for r in transitions.feature_transitions(newick, feats, cut, "mpr", "O").collect()}
    ab = parent[tips["A"]]
    assert ("f", ab, 1) in got and ("g", tips["O"], 1) in got and {f for f, *_ in got} == {"f", "g", "h"}
    zero = {tuple(r) for r in transitions.feature_transitions(newick, feats, cut, "mpr", "O", zero_root=True).collect()}
    assert not any(f == "g" for f, *_ in zero) and ("f", ab, 1) in zero
    for bad in ({"method": "other"}, {"method": "mpr"}, {"method": "ace", "zero_root": True}):
        with pytest.raises(ValueError):
            transitions.feature_transitions(newick, feats, cut, **bad)
    with pytest.raises(Exception, match="no state of tip A"):
        transitions.feature_transitions(newick, feats.filter("label <> 'A'"), cut, "mpr", "O").collect()


def test_transitions_by_likelihood(spark, newick):
    feats = features_of(spark, f="AB", none="")
    tips = {r.label: r.edge for r in newick.filter("is_tip").collect()}
    parent = {r.edge: r.parent_edge for r in newick.collect()}
    got = {tuple(r) for r in transitions.feature_transitions(newick, feats, cut).collect()}
    rows = [(r.edge, r.parent_edge, r.is_tip, r.length) for r in newick.collect()]
    states = {e: int(t in "AB") for t, e in tips.items()}
    gain, loss = plain_fit(rows, states)
    state = states | {e: int(plain_posterior(rows, states, gain, loss, e) > 0.5) for e in [None, *parent] if e not in states}
    want = {("f", e, 1 if state[e] > state[p] else 2) for e, p in parent.items() if state[e] != state[p]}
    assert got == want and want


def test_tips_at_distance_zero_that_differ(spark):
    edges = spark.createDataFrame([(1, None, False, 1.0), (2, 1, True, 0.0), (3, 1, True, 0.0), (4, None, True, 1.0)], EDGES)
    df = spark.createDataFrame([("f", 2, 0), ("f", 3, 1), ("f", 4, 1), ("g", 2, 1), ("g", 3, 1), ("g", 4, 0)], "feature string, edge long, state int")
    found, root = likelihood.likelihood_states(edges, df, tree.ancestor_closure(edges, cut), cut, rounds=2)
    assert {r.feature: r.root is None for r in root.collect()} == {"f": True, "g": False}
    assert {(r.feature, r.state is None) for r in found.collect()} == {("f", True), ("g", False)}


def test_cleaned_tree(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((C:0,A:0,B:0):1,(D:1,E:1):1,F:1,G:1);\n")
    read = formats.read_newick(spark, f"file://{tmp_path}/t.nwk")
    order = spark.createDataFrame([(x, i) for i, x in enumerate("ABCDEFG")], "label string, place int")
    rows = transitions.cleaned(read, order).collect()
    children = {}
    for r in rows:
        children.setdefault(r.parent_edge, []).append(r)
    assert all(len(x) == (3 if p is None else 2) for p, x in children.items())
    assert [r.label for r in sorted(rows, key=lambda r: r.edge) if r.is_tip and r.length == 0] == ["A", "B", "C"]
    assert sorted(r.label for r in rows if r.is_tip) == list("ABCDEFG")
    (tmp_path / "s.nwk").write_text("(A:1,(B:1,C:1):1);\n")
    small = transitions.cleaned(formats.read_newick(spark, f"file://{tmp_path}/s.nwk")).collect()
    assert len(small) == 4 and sum(r.parent_edge is None for r in small) == 2
