"""Exact tests and permutation tails against enumeration, masking of recombinant genes, and annotation files."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lateralis.functions import sequences
from lateralis.operators import genes, intervals, statistics
from lateralis.sources import annotation


def test_exact_rank_sum(spark):
    sizes = [(1, 1), (1, 5), (5, 1), (3, 4), (4, 4), (6, 3), (7, 8)]
    rows = [(a, b, float(w)) for a, b in sizes for w in range(a * b + 1)] + [(3, 4, 2.5), (50, 3, 4.0), (0, 3, 0.0)]
    got = {(r.n1, r.n2, r.w): r.exact_p for r in statistics.exact_rank_sum(spark.createDataFrame(rows, "n1 long, n2 long, w double")).collect()}
    for a, b in sizes:
        seen = [sum(c) - a * (a - 1) // 2 for c in itertools.combinations(range(a + b), a)]
        for w in range(a * b + 1):
            tail = min(sum(x <= w for x in seen), sum(x >= w for x in seen)) / len(seen)
            assert got[a, b, float(w)] == pytest.approx(min(1.0, 2 * tail), abs=1e-12)
    assert got[3, 4, 2.5] is None and got[50, 3, 4.0] is None and got[0, 3, 0.0] is None


def test_exact_rank_sum_of_the_largest_size(spark):
    r = statistics.exact_rank_sum(spark.createDataFrame([(49, 49, 1200.0), (49, 49, 900.0)], "n1 long, n2 long, w double")).collect()
    normal = [math.erfc((abs(w - 1200.5) - 0.5) / math.sqrt(49 * 49 * 99 / 12) / math.sqrt(2)) for w in (1200, 900)]
    assert [x.exact_p for x in r] == pytest.approx(normal, abs=2e-3)


def test_exact_ks(spark):
    sizes = [(1, 1), (2, 3), (4, 4), (5, 3), (7, 6)]
    rows, want = [], {}
    for a, b in sizes:
        gaps = []
        for c in itertools.combinations(range(a + b), a):
            x = y = 0
            top = 0.0
            for i in range(a + b):
                x, y = (x + 1, y) if i in c else (x, y + 1)
                top = max(top, abs(x / a - y / b))
            gaps.append(top)
        for d in {round(g, 12) for g in gaps}:
            rows.append((a, b, d))
            want[a, b, d] = sum(g >= d - 1e-9 for g in gaps) / len(gaps)
    df = spark.createDataFrame([*rows, (200, 60, 0.4), (0, 3, 0.5), (2, 3, None)], "n1 long, n2 long, d double")
    got = {(r.n1, r.n2, r.d): r.exact_p for r in statistics.exact_ks(df).collect()}
    assert {k: got[k] for k in want} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert got[200, 60, 0.4] is None and got[0, 3, 0.5] is None and got[2, 3, None] is None


def permutation_tables(spark):
    edges = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(1, 41)], "edge long, length double")
    marker = edges.filter("edge % 4 = 0").select("edge", (F.lit(1) + F.col("edge") % 8 / 4).cast("int").alias("dir"))
    clusters = spark.createDataFrame([(c, n, g, o) for c, (n, g, o) in enumerate([(20, 0.5, 2), (20, 1.0, 3), (7, 0.3, 0), (30, 0.0, 9), (5, 0.5, 5), (5, 0.5, 9)])],
                                     "cluster int, n_events int, gain_share double, observed int")
    return edges, marker, clusters


def test_permutation_tails(spark):
    edges, marker, clusters = permutation_tables(spark)
    marks = marker.withColumn("class", F.lit("same"))
    chances = statistics.class_chances(clusters, edges, marks)
    length = {r.edge: r.length for r in edges.collect()}
    share = {d: sum(length[r.edge] for r in marker.collect() if r.dir == d) / sum(length.values()) for d in (1, 2)}
    exact = {r.cluster: r.p for r in statistics.exact_permutations(chances).collect()}
    sampled = {r.cluster: r.p for r in statistics.sampled_permutations(chances, 4000).collect()}
    drawn = {r.cluster: r.p for r in statistics.weighted_permutations(clusters, edges, marker, 1500).collect()}
    for c in clusters.collect():
        p = c.gain_share * share[1] + (1 - c.gain_share) * share[2]
        want = sum(math.comb(c.n_events, k) * p**k * (1 - p) ** (c.n_events - k) for k in range(c.observed + 1, c.n_events + 1))
        assert exact[c.cluster] == pytest.approx(want, abs=1e-10)
        assert sampled[c.cluster] == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 4000) + 1e-9)
        assert drawn[c.cluster] == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 1500) + 1e-9)
    total = {r["class"]: r.expected for r in statistics.expected_classes(chances, 10).collect()}
    assert total["same"] == pytest.approx(10 * sum(c.n_events * (c.gain_share * share[1] + (1 - c.gain_share) * share[2]) for c in clusters.collect()))


def test_permutation_tail_at_certain_and_impossible_hits(spark):
    rows = spark.createDataFrame([(1, 4, 2, "x", 0.0), (2, 4, 2, "x", 1.0), (3, 4, 4, "x", 1.0), (4, 0, 0, "x", 0.5)], "cluster int, n_events int, observed int, class string, chance double")
    assert {r.cluster: r.p for r in statistics.exact_permutations(rows).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert {r.cluster: r.n_over for r in statistics.sampled_permutations(rows, 50).collect()} == {1: 0, 2: 50, 3: 0, 4: 0}


def test_permutations_by_the_million(spark):
    edges, marker, clusters = permutation_tables(spark)
    chances = statistics.class_chances(clusters.filter("cluster < 2"), edges, marker.withColumn("class", F.lit("same")))
    exact = {r.cluster: r.p for r in statistics.exact_permutations(chances).collect()}
    for r in statistics.sampled_permutations(chances.filter('cluster = 0'), 1_000_000).collect():
        assert r.p == pytest.approx(exact[r.cluster], abs=4e-3)


# --- recombination


def plain_locus_genes(start, end, parts):
    """Cursors over the partitions in order, as described: first start at or after, then first end at or after."""
    first = next((i for i, (_, s, _) in enumerate(parts) if s >= start), None)
    if first is None:
        return set()
    last = next((i for i in range(first, len(parts)) if parts[i][2] >= end), len(parts) - 1)
    return {g for g, _, _ in parts[first:last + 1]}


@pytest.mark.parametrize("seed", [1, 2])
def test_locus_genes_against_cursors(spark, seed):
    r = random.Random(seed)
    parts, at = [], r.randint(1, 20)
    for g in range(25):
        end = at + r.randint(0, 40)
        parts.append((g, at, end))
        at = end + 1 + r.choice([0, 0, 15])
    loci = [(k, s, s + r.choice([0, 3, 30, 150])) for k, s in enumerate(r.randint(1, at + 30) for _ in range(120))] + [(999, 9, 4)]
    got = {}
    for x in intervals.locus_genes(spark.createDataFrame(loci, "locus int, start int, end int"), spark.createDataFrame(parts, "gene int, start int, end int"), width=17).collect():
        got.setdefault(x.locus, set()).add(x.gene)
    assert got == {k: w for k, s, e in loci if s <= e and (w := plain_locus_genes(s, e, parts))}


def test_range_that_ends_in_a_gap(spark):
    parts = spark.createDataFrame([(1, 1, 10), (2, 11, 20), (3, 31, 40)], "gene int, start int, end int")
    loci = spark.createDataFrame([(1, 5, 25)], "locus int, start int, end int")
    assert {r.gene for r in intervals.locus_genes(loci, parts).collect()} == {2, 3}


def test_masking_of_recombinant_genes(spark):
    parts = spark.createDataFrame([("g1", 1, 4), ("g2", 5, 9), ("g3", 12, 15)], "gene string, start int, end int")
    ranges = [(1, 1, 9, ["x", "y"]), (2, 2, 6, ["x", "x"]), (3, 5, 9, ["x"]), (4, 10, 11, ["z", "gone"]), (5, 9, 5, ["z"])]  # nested, touching, in a gap, reversed
    df = spark.createDataFrame(ranges, "locus int, start int, end int, taxa array<string>")
    counts = intervals.recombination_counts(df, parts)
    assert {tuple(r) for r in counts.collect()} == {("x", "g1", 1), ("x", "g2", 3), ("y", "g1", 1), ("y", "g2", 1), ("z", "g3", 1), ("gone", "g3", 1)}
    algn = spark.createDataFrame([("x", "ACGTACGTACGTACGT"), ("y", "ACGTACG"), ("z", "TTTTTTTTTTTTTTTT"), ("w", "CCCC"), ("n", None)], "seq_id string, seq string")
    got = {r.seq_id: r.seq for r in intervals.mask_recombinant(algn, parts, counts).collect()}
    assert got == {"x": "---T----ACGTACGT", "y": "---T---", "z": "TTTTTTTTTTT---TT", "w": "CCCC", "n": None}
    one = algn.filter("seq_id = 'x'")
    same = one.select(sequences.mask(sequences.mask(F.col("seq"), F.lit(1), F.lit(4)), F.lit(5), F.lit(9)).alias("s")).first().s
    assert same == got["x"]


# --- annotation


def test_gene_environment(spark, tmp_path):
    (tmp_path / "gff").mkdir()
    (tmp_path / "fasta").mkdir()
    (tmp_path / "gff" / "g one.gff").write_text(
        "##gff-version 3\n# a comment\nc1\tx\tCDS\t2\t5\t.\t+\t0\tID=p1;product=beta%2Clactamase A+B\nc1\tx\tgene\t2\t5\t.\t+\t0\tID=q\n"
        "c1\tx\tCDS\t3\t6\t.\t-\t0\tlocus_tag=p2\nc9\tx\tCDS\t1\t2\t.\t+\t0\tID=lost\nbroken\tline\nc1\tx\tCDS\tq\t6\t.\t-\t0\tID=odd\n##FASTA\n>c1\nACGTACGT\n")
    (tmp_path / "gff" / "g2.gff3").write_text("c1\tx\tCDS\t1\t3\t.\t-\t0\tnote=none\n")
    (tmp_path / "fasta" / "g one.fna").write_text(">c1 the contig\nACGTA\nCGT\n>c2\n\n")
    (tmp_path / "fasta" / "g2.fasta").write_text(">c1\r\nTTT\r\nG\r\n")
    found, contigs = annotation.gene_environment(spark, f"file://{tmp_path}/gff", f"file://{tmp_path}/fasta")
    assert {tuple(r) for r in contigs.collect()} == {("g one", "c1", "ACGTACGT"), ("g one", "c2", ""), ("g2", "c1", "TTTG")}
    assert {(r.genome, r.gene_id, r.annotation, r.start, r.end, r.strand) for r in found.collect()} == {
        ("g one", "p1", "beta,lactamase A+B", 1, 4, "+"), ("g one", "p2", None, 2, 5, "-"), ("g2", "g2:c1:1:3", None, 0, 2, "-")}
    cut = {r.gene_id: r.seq for r in genes.cut_genes(found, contigs).collect()}
    assert cut == {"p1": "CGTA", "p2": "GTAC", "g2:c1:1:3": "AAA"}
