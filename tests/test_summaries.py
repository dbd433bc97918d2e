"""Distance summaries per source, alignments split into clusters, trees as text, tables with row names."""

import random
import statistics

import pytest

from lateralis.operators import alignments, distances, tree
from lateralis.session import cut, folder_of
from lateralis.sources import formats


def test_source_summaries(spark):
    rng = random.Random(5)
    source = {i: "abc"[i % 3] if i < 11 else "d" for i in range(12)}
    dist = {(a, b): round(rng.random(), 4) for a in range(12) for b in range(a)}
    dist |= {(b, a): d for (a, b), d in dist.items()}
    rows = spark.createDataFrame([("k", a, b, d) for (a, b), d in dist.items()] + [("alone", 0, 3, 0.5), ("alone", 3, 0, 0.5)], "cluster string, a int, b int, dist double")
    found = {(r.cluster, r.a): r for r in distances.source_summaries(rows, spark.createDataFrame(list(source.items()), "id int, source string")).collect()}
    assert {a for k, a in found if k == "k"} == set(range(11))  # the only one of source d has no row
    for a in range(11):
        for group, same in (("in_group", True), ("out_group", False)):
            values = [dist[a, b] for b in range(12) if b != a and (source[a] == source[b]) == same]
            q = statistics.quantiles(values, n=4, method="inclusive")
            want = [min(values), q[0], q[1], statistics.mean(values), q[2], max(values)]
            assert list(found["k", a][group]) == pytest.approx(want)
    assert found["alone", 0].out_group is None and found["alone", 0].in_group.max == 0.5
    assert distances.source_summaries(rows.limit(0), spark.createDataFrame([], "id int, source string")).count() == 0


def test_split_alignments(spark):
    rows = spark.createDataFrame([("x", "s1", "AC"), ("x", "s2", "A-"), ("x", "s3", "GG"), ("y", "s4", "T"), ("y", "s5", "C"), ("y", "s1", "A")], "algn string, seq_id string, seq string")

    def split(members):
        out = alignments.split_alignments(rows, spark.createDataFrame(members, "cluster int, seq_id string"))
        return sorted(tuple(r) for r in out.collect())

    assert split([(1, "s1"), (1, "s2"), (1, "s2"), (2, "s3"), (3, "s4"), (3, "s5")]) == [
        (1, "x", "s1", "AC"), (1, "x", "s2", "A-"), (3, "y", "s4", "T"), (3, "y", "s5", "C")]
    for members in ([(1, "s1"), (1, "s9")], [(7, "s8"), (7, "s9")], [(1, "s2"), (1, "s4")]):
        with pytest.raises(Exception, match="not once in its alignment: cluster"):
            split(members)
    twice = rows.unionByName(rows.filter("seq_id = 's2'"))
    with pytest.raises(Exception, match="cluster 1 sequence s2"):
        alignments.split_alignments(twice, spark.createDataFrame([(1, "s1"), (1, "s2")], "cluster int, seq_id string")).collect()


@pytest.mark.parametrize("text", ["((a:1.5,b:2.0)n1:0.5,(c:1.0,(d:3.0,e:4.0)n3:0.25):1.0,f:2.0);", "(a:1.0,b:1.0);", "(((x,y),z),w);", "(lone:2.5);"])
def test_newick_text(spark, text):
    rows = [(e, p, n == 0, length, label) for e, p, n, length, label in formats.parse_newick(text)]
    edges = spark.createDataFrame(rows, "edge int, parent_edge int, is_tip boolean, length double, label string")
    found = formats.newick_text(edges, tree.ancestor_closure(edges, cut)).collect()
    assert [r.newick for r in found] == [text]


def test_newick_text_of_many_levels(spark):
    rng = random.Random(2)
    rows = [(1, None)] + [(i, rng.choice([None, *range(1, i)])) for i in range(2, 90)]
    inner = {p for _, p in rows}
    edges = spark.createDataFrame([(e, p, e not in inner, float(e), f"n{e}") for e, p in rows], "edge int, parent_edge int, is_tip boolean, length double, label string")
    text = formats.newick_text(edges, tree.ancestor_closure(edges, cut)).first().newick
    back = {label: (parent, length) for _, parent, _, length, label in formats.parse_newick(text)}
    names = {e: label for e, _, _, _, label in formats.parse_newick(text)}
    assert {label: (names.get(p), length) for label, (p, length) in back.items()} == {f"n{e}": (p and f"n{p}", float(e)) for e, p in rows}
    none = edges.limit(0)
    assert formats.newick_text(none, tree.ancestor_closure(none, cut)).count() == 0


def test_row_names(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\ng1\t1\tNA\ng2\t0\tx\n")
    rows = formats.read_tsv(spark, str(tmp_path / "m.tsv"), "a int, b string", row_names="genome").collect()
    assert [tuple(r) for r in rows] == [("g1", 1, None), ("g2", 0, "x")]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder_of(Session())
