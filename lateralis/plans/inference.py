"""Exact tests, permutation tails, masking, alignments and likelihood reconstruction on stand-in tables.

Samples are suppliers of a nation; clusters of events are nations of customers; aligned sequences are nations within a
market segment, with a base for each of 40 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.operators import alignments, intervals, likelihood, rooting, statistics, transitions, tree
from lateralis.plans import phylogeny, relational
from lateralis.plans.registry import Tables, query
from lateralis.session import written as cut

SAMPLES_SQL = """
WITH s AS (SELECT s_nationkey k, s_acctbal v, s_suppkey % 2 = 0 f FROM supplier),
r AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY v) pos FROM s),
n AS (SELECT k, count(*) FILTER (f) n1, count(*) FILTER (NOT f) n2, coalesce(sum(pos) FILTER (f), 0) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2 w FROM r GROUP BY 1),
z AS (SELECT DISTINCT n1, n2 FROM n WHERE n1 > 0 AND n2 > 0),
o AS (SELECT n1, n2, mask FROM z, LATERAL (SELECT unnest(range(0, (1::bigint << (n1 + n2)))) mask) WHERE bit_count(mask) = n1)
"""


@query(SAMPLES_SQL + """, d AS (SELECT n1, n2, list_sum(list_transform(range(0, n1 + n2), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n1 * (n1 + 1) / 2 x FROM o)
SELECT n.k AS s_nationkey, n.n1, n.n2, any_value(w)::double AS w, round(least(1, 2 * least(count(*) FILTER (x <= w), count(*) FILTER (x >= w)) / count(*)), 9) AS exact_p
FROM n JOIN d ON d.n1 = n.n1 AND d.n2 = n.n2 GROUP BY 1, 2, 3""")
def rank_sum_exact(t):
    tests = statistics.rank_sum(t.supplier, ["s_nationkey"], "s_acctbal", F.col("s_suppkey") % 2 == 0)
    tests = statistics.exact_rank_sum(tests.filter("n1 > 0 AND n2 > 0").select("s_nationkey", "n1", "n2", "w"))
    return tests.select("s_nationkey", "n1", "n2", "w", F.round("exact_p", 9).alias("exact_p"))


GAP = "list_max(list_transform(range(1, n1 + n2 + 1), lambda j: abs(bit_count(mask & ((1::bigint << j) - 1)) / n1 - (j - bit_count(mask & ((1::bigint << j) - 1))) / n2)))"


@query(SAMPLES_SQL + f""", d AS (SELECT n1, n2, {GAP} x FROM o),
g AS (SELECT k, pos, sum(f::int) OVER w c1, sum((NOT f)::int) OVER w c2 FROM r WINDOW w AS (PARTITION BY k ORDER BY pos)),
m AS (SELECT n.k, n1, n2, max(abs(c1 / n1 - c2 / n2)) d FROM n JOIN g USING (k) WHERE n1 > 0 AND n2 > 0 GROUP BY 1, 2, 3)
SELECT m.k AS s_nationkey, m.n1, m.n2, round(m.d, 9) AS d, round(count(*) FILTER (x >= m.d - 1e-9) / count(*), 9) AS exact_p FROM m JOIN d ON d.n1 = m.n1 AND d.n2 = m.n2 GROUP BY 1, 2, 3, m.d""")
def ks_exact(t):
    tests = statistics.ks_statistic(t.supplier, ["s_nationkey"], "s_acctbal", F.col("s_suppkey") % 2 == 0)
    tests = statistics.exact_ks(tests.filter("n1 > 0 AND n2 > 0").select("s_nationkey", "n1", "n2", "d"))
    return tests.select("s_nationkey", "n1", "n2", F.round("d", 9).alias("d"), F.round("exact_p", 9).alias("exact_p"))


CHANCES_SQL = phylogeny.TREE_SQL + """, z AS (SELECT sum(length) z FROM t),
cl AS (SELECT c_nationkey AS cluster, count(*) n, avg((c_acctbal >= 0)::int) g, count(*) FILTER (c_custkey % 5 = 0) obs FROM customer GROUP BY 1),
mk AS (SELECT 1 + edge % 2 dir, CASE edge % 5 WHEN 0 THEN 'marker' WHEN 1 THEN 'carried' ELSE 'other' END AS class, sum(length) / any_value(z) s FROM t, z GROUP BY 1, 2),
h AS (SELECT class, sum(s) FILTER (dir = 1) u, sum(s) FILTER (dir = 2) d FROM mk GROUP BY 1),
ch AS (SELECT cluster, n, obs, class, g * u + (1 - g) * d p FROM cl, h)
"""


def chances(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    clusters = t.customer.groupBy(F.col("c_nationkey").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg((F.col("c_acctbal") >= 0).cast("int")).alias("gain_share"), F.count_if(k % 5 == 0).alias("observed"))
    edges = phylogeny.edges(t).select("edge", "length")
    kind = F.when(F.col("edge") % 5 == 0, "marker").when(F.col("edge") % 5 == 1, "carried").otherwise("other")
    return statistics.class_chances(clusters, edges, edges.select((1 + F.col("edge") % 2).alias("dir"), kind.alias("class"), "edge"))


@query(CHANCES_SQL + """, k AS (SELECT cluster, class, obs, n, p, unnest(range(obs + 1, n + 1)) k FROM ch),
tl AS (SELECT ch.cluster, ch.class, ch.obs, coalesce(sum(exp(lgamma(k.n + 1) - lgamma(k.k + 1) - lgamma(k.n - k.k + 1) + k.k * ln(k.p) + (k.n - k.k) * ln(1 - k.p))), 0) tail
 FROM ch LEFT JOIN k ON k.cluster = ch.cluster AND k.class = ch.class GROUP BY 1, 2, 3)
SELECT cluster, class, obs AS observed, round(tail, 6) AS p, round(-log10(tail + 0.001), 5) AS strength FROM tl""")
def permutation_tail(t):
    tails = statistics.exact_permutations(chances(t))
    return tails.select("cluster", "class", "observed", F.round("p", 6).alias("p"), F.round(statistics.strength(F.col("p"), 1000), 5).alias("strength"))


@query(CHANCES_SQL + "SELECT class, round(sum(n * p) * 1000, 3) AS expected FROM ch GROUP BY 1")
def expected_classes(t):
    return statistics.expected_classes(chances(t), 1000).select("class", F.round("expected", 3).alias("expected"))


RECOMBINED_SQL = relational.BASES_SQL.rstrip() + """, pt AS (SELECT i AS gene, i * 50 + 1 s, i * 50 + 40 e FROM (SELECT unnest(range(0, 40)) i)),
lo AS (SELECT c_custkey locus, 1 + (c_custkey * 37) % 2000 s, 1 + (c_custkey * 37) % 2000 + (c_custkey * 13) % 300 e, c_custkey k FROM customer),
la AS (SELECT locus, coalesce(min(pt.s) FILTER (pt.e >= lo.e), 1e18) last FROM lo JOIN pt ON pt.s >= lo.s GROUP BY 1),
ge AS (SELECT locus, gene, k FROM lo JOIN la USING (locus) JOIN pt ON pt.s >= lo.s AND pt.s <= last),
rc AS (SELECT taxon, gene, count(*) AS n FROM (SELECT DISTINCT locus, gene, unnest([k % 997, (k * 7) % 997]) taxon FROM ge) GROUP BY 1, 2)
"""


def recombination(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Ranges of customers, each with two taxa, over 40 genes with gaps between them."""
    k = F.col("c_custkey")
    start = 1 + (k * 37) % 2000
    ranges = t.customer.select(k.alias("locus"), start.alias("start"), (start + (k * 13) % 300).alias("end"), F.array(k % 997, (k * 7) % 997).alias("taxa"))
    genes = t.spark.range(40).select(F.col("id").alias("gene"), (F.col("id") * 50 + 1).alias("start"), (F.col("id") * 50 + 40).alias("end"))
    return ranges, genes


@query(RECOMBINED_SQL + "SELECT taxon, gene, n FROM rc")
def recombination_counts(t):
    return intervals.recombination_counts(*recombination(t))


@query(RECOMBINED_SQL + """, sp AS (SELECT taxon, list({'s': s, 'e': e}) spans FROM rc JOIN pt USING (gene) GROUP BY 1)
SELECT doc_id AS seq_id, md5(CASE WHEN spans IS NULL THEN seq ELSE array_to_string(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN len(list_filter(spans, lambda v: i >= v.s AND i < v.e)) > 0 THEN '-' ELSE c END), '') END) AS seq
FROM s LEFT JOIN sp ON taxon = doc_id""")
def masked_alignment(t):
    ranges, genes = recombination(t)
    rows = relational.bases(t).select(F.col("doc_id").alias("seq_id"), "seq")
    return intervals.mask_recombinant(rows, genes, intervals.recombination_counts(ranges, genes)).select("seq_id", F.md5("seq").alias("seq"))


ALIGNED_SQL = """
WITH b AS (SELECT c_mktsegment algn, c_nationkey seq_id, c_custkey % 40 i, max(CASE WHEN c_acctbal < -500 THEN 3 WHEN c_acctbal < 0 THEN 2 ELSE 1 END) v FROM customer GROUP BY 1, 2, 3),
g AS (SELECT algn, seq_id, i FROM (SELECT DISTINCT algn, seq_id FROM b), (SELECT unnest(range(0, 40)) i)),
x AS (SELECT algn, seq_id, string_agg(CASE v WHEN 3 THEN '-' WHEN 2 THEN 'C' ELSE 'A' END, '' ORDER BY i) seq FROM g LEFT JOIN b USING (algn, seq_id, i) GROUP BY 1, 2)
"""


def aligned(t: Tables) -> DataFrame:
    low = F.when(F.col("c_acctbal") < -500, 3).when(F.col("c_acctbal") < 0, 2).otherwise(1)
    b = t.customer.groupBy(F.col("c_mktsegment").alias("algn"), F.col("c_nationkey").alias("seq_id"), (F.col("c_custkey") % 40).alias("i")).agg(F.max(low).alias("v"))
    marks = b.groupBy("algn", "seq_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))  # at most 40
    base = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("-")), F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(1))))
    return marks.select("algn", "seq_id", F.array_join(base, "").alias("seq"))


@query(ALIGNED_SQL + """, p AS (SELECT l.algn, l.seq_id a, r.seq_id b, list_zip(string_split(l.seq, ''), string_split(r.seq, '')) z FROM x l JOIN x r ON l.algn = r.algn AND l.seq_id < r.seq_id)
SELECT algn, a, b, len(list_filter(z, lambda v: v[1] <> v[2])) AS raw,
 round(len(list_filter(z, lambda v: v[1] <> '-' AND v[2] <> '-' AND v[1] <> v[2])) / nullif(len(list_filter(z, lambda v: v[1] <> '-' AND v[2] <> '-')), 0), 6) AS shared FROM p""")
def alignment_distances(t):
    return alignments.pair_distances(cut(aligned(t)), cut).withColumn("shared", F.round("shared", 6))


@query(ALIGNED_SQL + """, n AS (SELECT algn, seq_id, seq_id % 6 AS genome, seq FROM x),
p AS (SELECT l.algn, l.seq_id, sum(len(list_filter(list_zip(string_split(l.seq, ''), string_split(r.seq, '')), lambda v: v[1] <> v[2]))) total FROM n l JOIN n r ON l.algn = r.algn AND l.seq_id <> r.seq_id GROUP BY 1, 2)
SELECT algn, genome, arg_min(seq_id, (coalesce(total, 0), seq_id)) AS seq_id FROM n LEFT JOIN p USING (algn, seq_id) GROUP BY 1, 2""")
def nearest_copies(t):
    rows = cut(aligned(t)).withColumn("genome", F.col("seq_id") % 6)
    return alignments.nearest_copy(rows, cut).select("algn", "genome", "seq_id")


@query(ALIGNED_SQL + """, y AS (SELECT algn || seq_id AS seq_id, algn, algn || seq_id % 14 AS cluster, seq FROM x),
k AS (SELECT *, count(*) OVER (PARTITION BY cluster) n FROM y)
SELECT l.cluster, l.algn, l.seq_id AS a, r.seq_id AS b, len(list_filter(list_zip(string_split(l.seq, ''), string_split(r.seq, '')), lambda v: v[1] <> v[2])) AS raw
FROM k l JOIN k r ON l.cluster = r.cluster AND l.seq_id < r.seq_id WHERE l.n > 1""")
def cluster_alignments(t):
    """Clusters of nations within a segment, each with the sequences that its alignment has of it, and their distances."""
    rows = cut(aligned(t).withColumn("nation", F.col("seq_id")).withColumn("seq_id", F.concat("algn", "nation")))
    parts = cut(alignments.split_alignments(rows, rows.select(F.concat("algn", F.col("nation") % 14).alias("cluster"), "seq_id")))
    found = alignments.pair_distances(parts.select(F.col("cluster").alias("algn"), "seq_id", "seq"), cut)
    return found.withColumnRenamed("algn", "cluster").join(parts.select("cluster", "algn").distinct(), "cluster").select("cluster", "algn", "a", "b", "raw")


@query()
def alignment_leaders(t):
    return alignments.alignment_leaders(aligned(t), cut, identity=0.05, substitutions=2)


@query()
def likelihood_states(t):
    """Feature q of a tip: its customer has an urgent order in quarter q."""
    edges = phylogeny.edges(t).select("edge", "parent_edge", "is_tip", (F.col("length") / 10_000).alias("length"))
    tips = phylogeny.tip_states(t).groupBy(F.floor((F.col("feature") - 1) / 3).alias("feature"), "edge").agg(F.max("state").alias("state"))
    found, _ = likelihood.likelihood_states(edges, cut(tips), phylogeny.closure(t), cut, rounds=6)
    return found.select("feature", "edge", "state", F.round("p1", 4).alias("p1"))


@query()
def transition_chain(t):
    """Features of months on the tree of customers, with the outgroup found and its features zeroed."""
    edges = cut(phylogeny.edges(t).select("edge", "parent_edge", "is_tip", "length", F.col("edge").cast("string").alias("label")))
    out = rooting.outgroup(edges, tree.ancestor_closure(edges, cut)).first()
    states = phylogeny.tip_states(t).select(F.col("edge").cast("string").alias("label"), "feature", "state")
    return transitions.feature_transitions(edges, states, cut, "mpr", str(out.edge), zero_root=True)
