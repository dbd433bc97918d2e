"""Hand-sized fixtures with values worked out on paper."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateralis.functions import dates, sequences
from lateralis.operators import clustering, counts, distances, intervals, similarity, statistics, tree
from lateralis.session import cut
from lateralis.sources import formats

TIPS = {1: "A", 3: "B", 4: "C", 6: "D", 7: "E"}


@pytest.fixture(scope="module")
def b1(spark):
    """A root of three children: A, (B, C), (D, E)."""
    rows = [(1, None, True, 1.0), (2, None, False, 2.0), (3, 2, True, 1.0), (4, 2, True, 1.0), (5, None, False, 1.5), (6, 5, True, 0.5), (7, 5, True, 0.5)]
    edges = spark.createDataFrame(rows, "edge int, parent_edge int, is_tip boolean, length double")
    return edges, cut(tree.ancestor_closure(edges, cut))


def tip_states(spark, features):
    rows = [(f, e, s) for f, states in features.items() for e, s in zip(TIPS, states, strict=True)]
    return spark.createDataFrame(rows, "feature string, edge int, state int")


FEATURES = {"x": (0, 1, 1, 0, 0), "y": (0, 1, 0, 0, 0), "z": (1, 1, 0, 1, 1), "w": (1, 1, 1, 1, 1), "t": (0, 1, 1, 1, 0)}


def test_paths(b1):
    edges, closure = b1
    paths = {r.edge: r.p for r in closure.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "anc"))), lambda x: x["anc"]).alias("p")).collect()}
    assert paths[1] == [1] and paths[3] == [3, 2] and paths[7] == [7, 5]
    assert sorted(r.edge for r in tree.root_edges(edges).collect()) == [1, 2, 5]


def test_patristic(spark, b1):
    edges, closure = b1
    pair = spark.createDataFrame([(3, 6), (3, 4)], "a int, b int")
    assert {(r.a, r.b): r.dist for r in tree.patristic(closure, edges, pair).collect()} == {(3, 6): 5.0, (3, 4): 2.0}


def test_parsimony_transitions_and_carrying_edges(spark, b1):
    edges, closure = b1
    changes = cut(tree.state_changes(edges, tip_states(spark, FEATURES), closure, cut))
    found = {(r.feature, r.edge, r.dir) for r in changes.collect()}
    assert found == {("x", 2, 1), ("y", 3, 1), ("z", 4, 2), ("t", 2, 1), ("t", 6, 1)}
    carried = {}
    for r in tree.feature_edges(closure, edges, changes).collect():
        carried.setdefault(r.feature, set()).add(r.edge)
    assert carried == {"x": {2, 3, 4}, "y": {3}, "z": {1, 2, 3, 5, 6, 7}, "t": {2, 3, 4, 6}}
    strict = tree.feature_edges(closure, edges, changes, root_policy="none")
    assert "z" not in {r.feature for r in strict.collect()}


def brute_lower(parents, tips, states):
    """Lowest state per node over all most parsimonious assignments."""
    inner = [n for n in parents if n not in tips] + ["root"]
    best, low = None, {}
    for values in itertools.product((0, 1), repeat=len(inner)):
        s = dict(zip(inner, values, strict=True)) | states
        cost = sum(s[n] != s[p if p is not None else "root"] for n, p in parents.items())
        if best is None or cost < best:
            best, low = cost, dict(s)
        elif cost == best:
            low = {n: min(low[n], s[n]) for n in s}
    return low, best


def test_parsimony_equals_brute_force(spark):
    rng = random.Random(3)
    edge_rows, tip_rows, expected = [], [], {}
    base = 0
    for trial in range(12):
        parents, leaves = {}, [None]
        count = 0
        open_nodes = [None]
        for _ in range(rng.randint(2, 4)):
            p = open_nodes.pop(rng.randrange(len(open_nodes)))
            for _ in range(rng.choice((2, 2, 3))):
                count += 1
                parents[count] = p
                open_nodes.append(count)
        leaves = [n for n in parents if n not in set(parents.values())]
        states = {n: rng.randint(0, 1) for n in leaves}
        low, best = brute_lower(parents, set(leaves), states)
        edges = spark.createDataFrame([(n, p, n in leaves) for n, p in parents.items()], "edge int, parent_edge int, is_tip boolean")
        tips = spark.createDataFrame([(0, n, s) for n, s in states.items()], "feature int, edge int, state int")
        if trial < 4:
            got, root = tree.parsimony(edges, tips, tree.ancestor_closure(edges, cut), cut)
            assert {r.edge: r.state for r in got.collect()} == {n: low[n] for n in parents}
            assert root.first().root == low["root"]
            assert tree.transitions(got, edges, root).count() == best


def test_acquisition_deletion(spark, b1):
    _, closure = b1
    counts_ = spark.createDataFrame([(0, e, n) for e, n in zip(range(1, 8), (0, 3, 4, 2, 1, 3, 0), strict=True)], "cluster int, edge int, n int")
    clusters = spark.createDataFrame([(0, 3)], "cluster int, least int")
    paths = closure.filter(F.col("edge").isin(*TIPS)).select(F.col("edge").alias("tip"), F.col("anc").alias("edge"), "depth")
    got = tree.acquisition_edges(paths, counts_, clusters)
    assert {(r.tip, r.acq_edge) for r in got.collect()} == {(3, 2), (6, 6)}
    assert {r.edge for r in tree.deletion_edges(closure, counts_, clusters, got).collect()} == {4}


def test_status(spark):
    rows = spark.createDataFrame([(2, 2), (2, 1), (1, 2), (1, None), (None, 1)], "acq int, loc int")
    got = [r[0] for r in rows.select(tree.hgt_status(F.col("acq"), F.col("loc"))).collect()]
    assert got == [1, 2, 1, None, 0]


def test_sets(spark):
    m = spark.createDataFrame([("s1", c) for c in "abc"] + [("s2", c) for c in "bcde"], "s string, i string")
    r = similarity.pair_counts(m, "s", "i", ordered=True).select(
        "a", similarity.jaccard().alias("j"), similarity.dice().alias("d"), similarity.containment().alias("c")).orderBy("a").collect()
    assert r[0].j == 0.4 and r[0].d == pytest.approx(4 / 7) and [x.c for x in r] == [pytest.approx(2 / 3), 0.5]


def test_phi(spark):
    m = spark.createDataFrame([("g1", 1), ("g1", 2), ("g2", 1), ("all", 1), ("all", 2), ("all", 3), ("all", 4)], "g string, e int")
    r = {(x.a, x.b): x.r for x in similarity.pair_counts(m, "g", "e").select("a", "b", similarity.phi(F.lit(4)).alias("r")).collect()}
    assert r[("g1", "g2")] == pytest.approx(0.577350, abs=1e-6) and r[("all", "g1")] is None
    assert np.sqrt(2 - 2 * r[("g1", "g2")]) == pytest.approx(0.919402, abs=1e-6)


def test_leader_sequences(spark):
    base = ["A"] * 300

    def variant(*at):
        s = list(base)
        for i in at:
            s[i] = "C"
        return "".join(s)

    rows = [("g", "s1", variant(*range(8))), ("g", "s2", variant(*range(1, 8))), ("g", "s3", variant(8, 9)), ("g", "s4", variant(*range(3, 7)))]
    got = {r.seq_id: r.leader for r in clustering.sequence_leaders(spark.createDataFrame(rows, "algn_id string, seq_id string, seq string")).collect()}
    assert got == {"s1": "s1", "s2": "s1", "s3": "s3", "s4": "s4"}


def test_confusion(spark):
    p = spark.createDataFrame([("k", i) for i in (1, 2, 3)], "k string, i int")
    t = spark.createDataFrame([("k", i) for i in (2, 3, 4, 5)], "k string, i int")
    r = counts.confusion(p, t, "k", "i", 10).select("tp", "fp", "fn", "tn", *counts.rates()).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 5) and r.tpr == 0.5
    assert r.ppv == pytest.approx(2 / 3) and r.f1 == pytest.approx(4 / 7)


def test_rank_tests(spark):
    df = spark.createDataFrame([(float(x), x < 4) for x in range(1, 7)], "v double, f boolean")
    r = statistics.rank_sum(df, [], "v", F.col("f")).first()
    assert r.w == 0 and r.z == pytest.approx(1.745743, abs=1e-6) and r.p == pytest.approx(0.080856, abs=1e-5)
    assert statistics.ks_statistic(df, [], "v", F.col("f")).first().d == 1.0


def test_sequences(spark):
    df = spark.createDataFrame([("AACGTR", "aaCG", "ACgT-RN", "ABCDEFGH", "A--C-", "ACGTACGT")], "a string, b string, c string, d string, e string, g string")
    r = df.select(
        sequences.reverse_complement(F.col("a")), sequences.cased_reverse_complement(F.col("b")), sequences.clean(F.col("c")),
        sequences.mask(F.col("d"), F.lit(3), F.lit(5)), sequences.mask(F.col("d"), F.lit(3), F.lit(5), inclusive_end=True), sequences.gaps(F.col("e")),
        sequences.gene(F.col("g"), F.lit(2), F.lit(4), F.lit("+")), sequences.gene(F.col("g"), F.lit(2), F.lit(4), F.lit("-"))).first()
    assert tuple(r) == ("NACGTT", "CGNN", "ACNT-NN", "AB--EFGH", "AB---FGH", 3, "GTA", "TAC")


def test_ranges(spark):
    p = spark.createDataFrame([(1, 1, 10), (2, 11, 20), (3, 21, 30)], "gene int, start int, end int")
    loci = spark.createDataFrame([(1, 11, 25), (2, 5, 15)], "locus int, start int, end int")
    assert {(r.locus, r.gene) for r in intervals.locus_genes(loci, p).collect()} == {(1, 2), (1, 3), (2, 2)}
    assert {(r.locus, r.gene) for r in intervals.locus_genes(loci, p, overlap=True, width=7).collect()} == {(1, 2), (1, 3), (2, 1), (2, 2)}


def test_dates(spark):
    df = spark.createDataFrame([("2018-3-14",), ("7/5/2019",), ("2017",), ("1/2",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(dates.parts(F.col("t"))).collect()]
    assert got == [(2018, 3, 14), (2019, 7, 5), (2017, None, None), (None, None, None), (None, None, None)]
    months = spark.createDataFrame([(3,), (5,), (7,)], "m int")
    assert [r[0] for r in months.select(dates.floor_bucket(F.col("m"), 3)).collect()] == [1, 4, 7]


def test_cluster_file(spark, tmp_path):
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t300aa, >fig|10.1.peg.1... *\n1\t300aa, >fig|10.2.peg.7... at 98.50%\n>Cluster 1\n0\t200aa, >fig|10.1.peg.2... *\n")
    rows = formats.read_cluster_file(spark, str(tmp_path / "x.clstr"), 2).orderBy("position").collect()
    assert [(r.cluster_id, r.gene_id, r.genome_id, r.identity) for r in rows] == [(0, "fig|10.1.peg.1", "10.1", 100.0), (0, "fig|10.2.peg.7", "10.2", 98.5)]
    assert formats.read_cluster_file(spark, str(tmp_path / "x.clstr")).select("cluster_id").distinct().count() == 2


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a some words\nACGT\nAC\n>b\nTT\n")
    df = formats.read_fasta(spark, str(tmp_path / "x.fa"))
    assert {tuple(r) for r in df.collect()} == {("a", "ACGTAC"), ("b", "TT")}
    formats.write_fasta(df, str(tmp_path / "out"))
    assert {tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "out")).collect()} == {("a", "ACGTAC"), ("b", "TT")}


def test_tsv_gff_partitions(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1), ("g2", None)], "name string, kpc int")
    formats.write_tsv(df, str(tmp_path / "t"))
    assert {tuple(r) for r in formats.read_tsv(spark, str(tmp_path / "t"), "name string, kpc int").collect()} == {("g1", 1), ("g2", None)}
    (tmp_path / "r.gff").write_text('##gff\ns\tG\tCDS\t11\t25\t0\t.\t0\tnode="x";taxa="a b  c";snp="3"\n')
    r = formats.read_recombination(spark, str(tmp_path / "r.gff")).first()
    assert (r.start, r.end, r.taxa) == (11, 25, ["a", "b", "c"])
    p = formats.partitions_of(spark.createDataFrame([(1, "1-10")], "gene int, range string"), "range").first()
    assert tuple(p) == (1, 1, 10)


def test_newick(spark, tmp_path):
    text = "(A:1,(B:1,C:1)n1:2,(D:0.5,E:0.5):1.5);"
    rows = formats.parse_newick(text)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [
        (1, None, 0, 1.0, "A"), (2, None, 2, 2.0, "n1"), (3, 2, 0, 1.0, "B"), (4, 2, 0, 1.0, "C"), (5, None, 2, 1.5, None), (6, 5, 0, 0.5, "D"), (7, 5, 0, 0.5, "E")]
    assert formats.write_newick([(r[0], r[1], r[3], r[4]) for r in rows]) == text
    (tmp_path / "a.tre").write_text(text)
    assert formats.read_newick(spark, str(tmp_path)).filter("is_tip").count() == 5


def test_rollup(spark):
    rows = [("P1", "s1", "HGT")] * 2 + [("P2", "s1", "HGT"), ("P2", "s2", "HGT"), ("P3", "s1", "HGT"), ("P3", "s1", "Importation"),
            ("P4", "s1", "Importation"), ("P4", "s1", "Unknown"), ("P5", "s1", "Unknown"), ("P5", "s1", "Unknown"), ("P6", "s1", "HGT")]
    got = dict(counts.patient_status(spark.createDataFrame(rows, "p string, s string, st string"), "p", "s", "st").collect())
    assert got == {"P1": "Multiple HGT", "P2": "Multiple isolates", "P3": "Multiple isolates", "P4": "Importation", "P5": "Undetermined"}


def test_missing_patient_is_its_own(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "p"), ("d", "p")], "iso string, patient string")
    assert {r.iso for r in counts.first_by(df, ["patient"], [F.col("iso")], null_is_own=["patient"]).collect()} == {"a", "b", "c"}
    assert counts.first_by(df, ["patient"], [F.col("iso")]).count() == 2


def test_linkage():
    points = np.array([[0.0], [0.1], [5.0], [5.2]])
    merges = clustering.average_linkage(points)
    assert clustering.cut_tree(4, merges, 1.0) == [0, 0, 1, 1] and clustering.cut_tree(4, merges, 10.0) == [0, 0, 0, 0]


def test_nearest_keeps_ties(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("a", "d", 2.0)], "a string, b string, dist double")
    assert {r.b for r in distances.nearest(d).collect()} == {"b", "c"}


def test_bonferroni(spark):
    t = spark.createDataFrame([(1, 0.02), (2, 0.03)], "cluster int, p double")
    assert {r.cluster for r in statistics.bonferroni(t).filter("significant").collect()} == {1}
