"""Tree operators on a stand-in tree: customers by key, the parent of k is k div 2, an edge is its lower node.

Transitions stand in by a rule on edge and feature; clusters are features by parity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.operators import statistics, tree
from lateralis.plans.registry import Tables, query
from lateralis.sources import formats
from lateralis.session import cut

TREE_SQL = """
WITH RECURSIVE t AS (SELECT c_custkey edge, CASE WHEN c_custkey >= 4 THEN c_custkey // 2 END parent_edge,
  2 * c_custkey > (SELECT max(c_custkey) FROM customer) is_tip, abs(c_acctbal) + 1 AS length, c_nationkey FROM customer WHERE c_custkey >= 2),
c(edge, anc, depth) AS (SELECT edge, edge, 1 FROM t UNION ALL SELECT c.edge, t.parent_edge, depth + 1 FROM c JOIN t ON t.edge = c.anc WHERE t.parent_edge IS NOT NULL)
"""
CHANGES_SQL = TREE_SQL + """, f AS (SELECT unnest(range(5)) feature),
x AS (SELECT feature, edge, CASE WHEN (edge * 7 + feature * 13) % 31 = 0 THEN 1 WHEN (edge * 11 + feature * 5) % 37 = 0 THEN 2 END dir FROM t, f),
ch AS (SELECT * FROM x WHERE dir IS NOT NULL)
"""
CARRIED_SQL = CHANGES_SQL + """,
free AS (SELECT feature, l.edge FROM ch l WHERE dir = 2 AND NOT EXISTS (SELECT 1 FROM c JOIN ch g ON g.edge = c.anc AND g.dir = 1 AND g.feature = l.feature WHERE c.edge = l.edge)),
mk AS (SELECT feature, edge, max(dir) dir FROM (SELECT * FROM ch UNION ALL SELECT DISTINCT feature, t.edge, 1 FROM free, t WHERE parent_edge IS NULL) GROUP BY 1, 2),
nr AS (SELECT feature, c.edge, arg_min(dir, depth) dir FROM c JOIN mk ON mk.edge = c.anc GROUP BY 1, 2),
fe AS (SELECT feature, edge FROM nr WHERE dir = 1)
"""
ACQUIRED_SQL = CARRIED_SQL + """,
cl AS (SELECT feature % 2 cluster, ceil(0.51 * count(*))::int least FROM f GROUP BY 1),
n AS (SELECT feature % 2 cluster, edge, count(*) n FROM fe GROUP BY 1, 2),
pa AS (SELECT c.edge tip, c.anc edge, depth FROM c JOIN t USING (edge) WHERE is_tip),
ok AS (SELECT tip, cl.cluster, pa.edge, depth, coalesce(n, 0) >= least ok FROM pa CROSS JOIN cl LEFT JOIN n ON n.cluster = cl.cluster AND n.edge = pa.edge),
ff AS (SELECT *, min(CASE WHEN NOT ok THEN depth END) OVER (PARTITION BY tip, cluster) fail FROM ok),
aq AS (SELECT tip, cluster, arg_max(edge, depth) acq_edge, max(depth) depth FROM ff WHERE fail IS NULL OR depth < fail GROUP BY 1, 2)
"""
DELETED_SQL = ACQUIRED_SQL + """,
st AS (SELECT DISTINCT cluster, acq_edge FROM aq),
fa AS (SELECT st.cluster, acq_edge, c.edge FROM st JOIN c ON c.anc = acq_edge AND c.depth > 1 JOIN cl ON cl.cluster = st.cluster
  LEFT JOIN n ON n.cluster = st.cluster AND n.edge = c.edge WHERE coalesce(n, 0) < least),
de AS (SELECT DISTINCT cluster, edge FROM fa WHERE NOT EXISTS (SELECT 1 FROM c JOIN fa h ON h.edge = c.anc WHERE c.edge = fa.edge AND c.depth > 1 AND h.cluster = fa.cluster AND h.acq_edge = fa.acq_edge))
"""


def edges(t: Tables) -> DataFrame:
    top = t.customer.agg(F.max("c_custkey").alias("top"))
    k = F.col("c_custkey")
    rows = t.customer.filter(k >= 2).crossJoin(F.broadcast(top))  # one number
    return rows.select(
        k.alias("edge"), F.when(k >= 4, F.expr("c_custkey div 2")).alias("parent_edge"), (2 * k > F.col("top")).alias("is_tip"),
        (F.abs("c_acctbal") + 1).alias("length"), "c_nationkey")


def closure(t: Tables) -> DataFrame:
    return tree.ancestor_closure(edges(t), cut)


def changes(t: Tables) -> DataFrame:
    rows = edges(t).select("edge", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("feature"))
    gain, loss = (F.col("edge") * 7 + F.col("feature") * 13) % 31 == 0, (F.col("edge") * 11 + F.col("feature") * 5) % 37 == 0
    return rows.withColumn("dir", F.when(gain, 1).when(loss, 2)).filter("dir IS NOT NULL").select("feature", "edge", "dir")


def carried(t: Tables, c: DataFrame) -> DataFrame:
    return tree.feature_edges(c, edges(t), changes(t))


def clusters(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(0, 2), (1, 2)], "cluster int, least int")


def member_counts(fe: DataFrame) -> DataFrame:
    return fe.groupBy((F.col("feature") % 2).alias("cluster"), "edge").agg(F.count(F.lit(1)).alias("n"))


def tip_paths(t: Tables, c: DataFrame) -> DataFrame:
    tips = edges(t).filter("is_tip").select("edge")
    return c.join(tips, "edge", "left_semi").select(F.col("edge").alias("tip"), F.col("anc").alias("edge"), "depth")


def acquired(t: Tables, c: DataFrame, n: DataFrame) -> DataFrame:
    return tree.acquisition_edges(tip_paths(t, c), n, clusters(t))


@query(TREE_SQL + "SELECT edge, anc, depth FROM c")
def tree_ancestors(t):
    return closure(t)


@query(TREE_SQL + "SELECT anc AS edge, count(*) AS n, max(depth) - 1 AS height FROM c GROUP BY 1")
def tree_descendants(t):
    below = tree.descendants(closure(t))
    return below.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("height"))


@query(CHANGES_SQL + """, st AS (SELECT d.edge, feature, min(depth) stop FROM c d JOIN ch ON ch.edge = d.anc AND ch.dir = 2 GROUP BY 1, 2)
SELECT f.feature, c.anc AS edge, count(*) AS n FROM c CROSS JOIN f LEFT JOIN st ON st.edge = c.edge AND st.feature = f.feature WHERE stop IS NULL OR depth < stop GROUP BY 1, 2""")
def tree_pruned(t):
    c, lost = closure(t), changes(t).filter("dir = 2")

    def below(feature: int) -> DataFrame:
        kept = tree.pruned_descendants(c, lost.filter(F.col("feature") == feature).select("edge"))
        return kept.groupBy(F.lit(feature).alias("feature"), "edge").agg(F.count(F.lit(1)).alias("n"))

    return reduce(DataFrame.unionByName, map(below, range(5)))


@query(TREE_SQL + "SELECT c.edge AS tip, max(depth) AS depth, arg_max(anc, depth) AS root_edge FROM c JOIN t USING (edge) WHERE is_tip GROUP BY 1")
def tip_edges(t):
    return tip_paths(t, closure(t)).groupBy("tip").agg(F.max("depth").alias("depth"), F.max_by("edge", "depth").alias("root_edge"))


@query(TREE_SQL + """, w AS (SELECT c.edge, anc, length FROM c JOIN t ON t.edge = c.anc), r AS (SELECT edge, sum(length) d FROM w GROUP BY 1),
p AS (SELECT x.edge a, y.edge b FROM t x JOIN t y ON x.c_nationkey = y.c_nationkey AND x.edge < y.edge WHERE x.is_tip AND y.is_tip),
s AS (SELECT a, b, sum(u.length) s FROM p JOIN w u ON u.edge = a JOIN w v ON v.edge = b AND v.anc = u.anc GROUP BY 1, 2)
SELECT a, b, round(x.d + y.d - 2 * coalesce(s, 0), 4) AS dist FROM p JOIN r x ON x.edge = a JOIN r y ON y.edge = b LEFT JOIN s USING (a, b)""")
def patristic(t):
    """All pairs of tips of one nation."""
    tips = edges(t).filter("is_tip AND c_nationkey IS NOT NULL").select(F.col("c_nationkey").alias("group"), "edge")
    return tree.patristic_within(closure(t), edges(t), tips).select("a", "b", F.round("dist", 4).alias("dist"))


@query(TREE_SQL + """, p AS (SELECT edge, list(anc ORDER BY depth DESC) path FROM c GROUP BY 1),
n AS (SELECT t.edge, path, is_tip, t.edge::varchar || ':' || length::varchar AS name, t.edge <> min(t.edge) OVER (PARTITION BY parent_edge) AS later FROM t JOIN p USING (edge)),
tk AS (SELECT path k, (CASE WHEN later THEN ',' ELSE '' END) || (CASE WHEN is_tip THEN name ELSE '(' END) s FROM n UNION ALL SELECT list_append(path, 9223372036854775807), ')' || name FROM n WHERE NOT is_tip)
SELECT count(*)::int AS n_tokens, md5('(' || string_agg(s, '' ORDER BY k) || ');') AS newick FROM tk""")
def newick_text(t):
    rows = edges(t).withColumn("label", F.col("edge").cast("string"))
    text = formats.newick_text(rows, closure(t))
    return text.select((F.regexp_count("newick", F.lit("[(:]")) - 1).cast("int").alias("n_tokens"), F.md5("newick").alias("newick"))


@query(CARRIED_SQL + "SELECT feature, edge FROM fe")
def feature_edges(t):
    return carried(t, closure(t))


@query(ACQUIRED_SQL + "SELECT tip, cluster, acq_edge FROM aq")
def acquisition_edge(t):
    c = closure(t)
    return acquired(t, c, member_counts(carried(t, c)))


@query(DELETED_SQL + "SELECT cluster, edge FROM de")
def deletion_edges(t):
    c = closure(t)
    n = cut(member_counts(carried(t, c)))
    return tree.deletion_edges(c, n, clusters(t), acquired(t, c, n))


@query(DELETED_SQL + "SELECT cluster, acq_edge AS edge, '+' AS dir FROM st UNION ALL SELECT cluster, edge, '-' FROM de")
def event_table(t):
    c = closure(t)
    n = cut(member_counts(carried(t, c)))
    a = cut(acquired(t, c, n))
    gained = a.select("cluster", F.col("acq_edge").alias("edge")).distinct().withColumn("dir", F.lit("+"))
    return gained.unionByName(tree.deletion_edges(c, n, clusters(t), a).withColumn("dir", F.lit("-")))


@query(ACQUIRED_SQL + """, lo AS (SELECT c.edge tip, c.depth loc FROM c JOIN t USING (edge) WHERE is_tip AND depth = 1 + c.edge % 5 AND c.edge % 7 <> 0)
SELECT t.edge AS tip, cl.cluster, CASE WHEN loc IS NULL THEN NULL WHEN aq.depth IS NULL THEN 0 WHEN aq.depth <= loc THEN 1 ELSE 2 END AS status
FROM t CROSS JOIN cl LEFT JOIN lo ON lo.tip = t.edge LEFT JOIN aq ON aq.tip = t.edge AND aq.cluster = cl.cluster WHERE is_tip""")
def hgt_status(t):
    c = closure(t)
    paths = tip_paths(t, c)
    a = acquired(t, c, member_counts(carried(t, c)))
    depth = a.join(paths.select("tip", F.col("edge").alias("acq_edge"), F.col("depth").alias("acq_depth")), ["tip", "acq_edge"])
    place = paths.filter((F.col("depth") == 1 + F.col("tip") % 5) & (F.col("tip") % 7 != 0)).select("tip", F.col("depth").alias("loc_depth"))
    rows = edges(t).filter("is_tip").select(F.col("edge").alias("tip")).crossJoin(F.broadcast(clusters(t).select("cluster")))
    rows = rows.join(place, "tip", "left").join(depth.select("tip", "cluster", "acq_depth"), ["tip", "cluster"], "left")
    return rows.select("tip", "cluster", tree.hgt_status(F.col("acq_depth"), F.col("loc_depth")).alias("status"))


@query(CARRIED_SQL + """SELECT feature, ch.edge, ch.dir, CASE WHEN EXISTS (SELECT 1 FROM ch m WHERE m.feature = 4 AND m.edge = ch.edge AND m.dir = ch.dir) THEN 3
 WHEN EXISTS (SELECT 1 FROM fe WHERE fe.feature = 4 AND fe.edge = ch.edge) THEN 2 ELSE 1 END AS status FROM ch WHERE feature < 4""")
def edge_status(t):
    fe = carried(t, closure(t))
    ch = changes(t)
    return tree.edge_status(ch.filter("feature < 4"), ch.filter("feature = 4"), fe.filter("feature = 4")).select("feature", "edge", "dir", "status")


@query(CHANGES_SQL + """, g AS (SELECT c.edge tip, max((feature, ch.edge)) b FROM c JOIN t USING (edge) JOIN ch ON ch.edge = c.anc AND dir = 1 WHERE is_tip GROUP BY 1)
SELECT tip, b[1] AS feature, b[2] AS edge FROM g""")
def tip_latest_edge(t):
    gains = changes(t).filter("dir = 1").select("feature", "edge")
    last = tip_paths(t, closure(t)).join(gains, "edge").groupBy("tip").agg(F.max(F.struct("feature", "edge")).alias("b"))
    return last.select("tip", "b.feature", "b.edge")


@query(ACQUIRED_SQL + """SELECT p.cluster, p.acq_edge AS edge, count(*) AS n FROM aq p WHERE p.tip % 2 = 1 AND EXISTS (
 SELECT 1 FROM aq s WHERE s.tip % 2 = 0 AND s.cluster = p.cluster AND s.acq_edge = p.acq_edge) GROUP BY 1, 2""")
def shared_isolates(t):
    c = closure(t)
    a = cut(acquired(t, c, member_counts(carried(t, c))))
    watched = a.filter("tip % 2 = 0").select("cluster", "acq_edge")
    return a.filter("tip % 2 = 1").join(watched, ["cluster", "acq_edge"], "left_semi").groupBy("cluster", F.col("acq_edge").alias("edge")).agg(F.count(F.lit(1)).alias("n"))


@query(ACQUIRED_SQL + "SELECT tip, cluster, CASE WHEN acq_edge IN (SELECT edge FROM ch WHERE feature = 4 AND dir = 1) THEN 2 ELSE 1 END AS value FROM aq")
def co_acquisition(t):
    c = closure(t)
    a = acquired(t, c, member_counts(carried(t, c)))
    marker = changes(t).filter("feature = 4 AND dir = 1").select(F.col("edge").alias("acq_edge"), F.lit(True).alias("m"))
    return a.join(marker, "acq_edge", "left").select("tip", "cluster", F.when(F.col("m"), 2).otherwise(1).alias("value"))


@query(TREE_SQL + """, l AS (SELECT edge, CASE WHEN c_nationkey % 5 = 4 THEN 'Other' ELSE 'N' || (c_nationkey % 5)::varchar END label FROM t WHERE is_tip),
u AS (SELECT label, anc FROM l JOIN c USING (edge)), tp AS (SELECT label, anc, count(*) tp FROM u GROUP BY 1, 2),
s AS (SELECT anc, count(*) s FROM u WHERE label <> 'Other' GROUP BY 1), n AS (SELECT label, count(*) n FROM l GROUP BY 1),
r AS (SELECT tp.label, tp.anc, 2 * tp / (s + n) f1 FROM tp JOIN s USING (anc) JOIN n USING (label) WHERE tp.label <> 'Other')
SELECT label, anc AS edge, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, anc) k FROM r) WHERE k = 1""")
def label_edges_f1(t):
    n = (F.col("c_nationkey") % 5)
    labels = edges(t).filter("is_tip").select("edge", F.when(n == 4, "Other").otherwise(F.concat(F.lit("N"), n.cast("string"))).alias("label"))
    return tree.label_edges(labels, closure(t)).select("label", "edge", F.round("f1", 6).alias("f1"))


def tip_states(t: Tables) -> DataFrame:
    """Feature m of a tip: its customer has an urgent order in month m."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.month("o_orderdate").alias("feature"), F.col("o_custkey").alias("edge")).distinct()
    rows = edges(t).filter("is_tip").select("edge", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("feature"))
    return rows.join(urgent.withColumn("state", F.lit(1)), ["feature", "edge"], "left").fillna(0, ["state"])


def parsimony_sql(levels: int = 18) -> str:
    """Costs up and down the stand-in tree, a level (the binary digits of an edge, less one) at a time."""
    up0, up1 = "least(c0, c1 + 1)", "least(c1, c0 + 1)"
    sql = TREE_SQL.rstrip() + """, f AS (SELECT unnest(range(1, 13)) feature),
ug AS (SELECT DISTINCT month(o_orderdate) feature, o_custkey edge, 1 s FROM orders WHERE o_orderpriority = '1-URGENT'),
ts AS (SELECT f.feature, t.edge, length(bin(t.edge)) - 1 l, coalesce(s, 0) s FROM t CROSS JOIN f LEFT JOIN ug ON ug.feature = f.feature AND ug.edge = t.edge WHERE is_tip)"""
    for level in range(levels, 0, -1):
        sql += f""",
u{level} AS MATERIALIZED (SELECT feature, edge, CASE s WHEN 0 THEN 0 ELSE 1 << 30 END::bigint c0, CASE s WHEN 1 THEN 0 ELSE 1 << 30 END::bigint c1 FROM ts WHERE l = {level}"""
        sql += f" UNION ALL SELECT feature, edge // 2, sum({up0})::bigint, sum({up1})::bigint FROM u{level + 1} GROUP BY 1, 2)" if level < levels else ")"
    sql += f""",
w0 AS (SELECT feature, 1 AS edge, sum({up0}) t0, sum({up1}) t1 FROM u1 GROUP BY 1)"""
    for level in range(1, levels + 1):
        sql += f""",
w{level} AS MATERIALIZED (SELECT u.feature, u.edge, c0 + least(t0 - {up0}, t1 - {up1} + 1) t0, c1 + least(t1 - {up1}, t0 - {up0} + 1) t1
 FROM u{level} u JOIN w{level - 1} w ON w.feature = u.feature AND w.edge = u.edge // 2)"""
    rows = " UNION ALL ".join(f"SELECT feature, edge, (t1 < t0)::int state FROM w{level}" for level in range(levels + 1))
    return sql + f", st AS ({rows})\n"


PARSIMONY_SQL = parsimony_sql()


@query(PARSIMONY_SQL + "SELECT feature, edge, state FROM st WHERE edge > 1")
def parsimony_states(t):
    return tree.parsimony_costs(edges(t), tip_states(t), closure(t), cut)


@query(PARSIMONY_SQL + """SELECT b.feature, b.edge, CASE WHEN b.state > a.state THEN 1 ELSE 2 END AS dir FROM st b JOIN st a ON a.feature = b.feature AND a.edge = b.edge // 2
WHERE b.edge > 1 AND a.state <> b.state""")
def transitions(t):
    return tree.state_changes(edges(t), tip_states(t), closure(t), cut)


@query(TREE_SQL + """, z AS (SELECT sum(length) z FROM t), w AS (SELECT edge, sum(length) OVER (ORDER BY edge) / z hi, (sum(length) OVER (ORDER BY edge) / z) - length / z lo FROM t, z),
m AS (SELECT edge, 1 + edge % 2 dir, lo, hi FROM w WHERE edge % 5 = 0), k AS (SELECT unnest(range(1, 4)) cluster),
d AS (SELECT cluster, perm, ('0x' || substr(md5('144:' || cluster || ':' || perm || ':' || ev || ':edge'), 1, 12))::bigint / 281474976710656.0 u,
 CASE WHEN ('0x' || substr(md5('144:' || cluster || ':' || perm || ':' || ev || ':dir'), 1, 12))::bigint / 281474976710656.0 < 0.5 THEN 1 ELSE 2 END dir
 FROM k, (SELECT unnest(range(1, 101)) perm), (SELECT unnest(range(1, 21)) ev)),
h AS (SELECT d.cluster, perm, count(m.edge) n FROM d LEFT JOIN m ON m.dir = d.dir AND u >= lo AND u < hi GROUP BY 1, 2)
SELECT cluster, count(*) FILTER (n > cluster) AS n_over, round(count(*) FILTER (n > cluster) / 100, 6) AS p FROM h GROUP BY 1""")
def perm_pvalue(t):
    k = t.spark.range(1, 4).select(F.col("id").alias("cluster"), F.lit(20).alias("n_events"), F.lit(0.5).alias("gain_share"), F.col("id").alias("observed"))
    marker = edges(t).filter("edge % 5 = 0").select("edge", (1 + F.col("edge") % 2).cast("int").alias("dir"))
    p = statistics.weighted_permutations(k, edges(t).select("edge", "length"), marker, 100)
    return p.select("cluster", "n_over", F.round("p", 6).alias("p"))


@query("""WITH r AS (SELECT perm, c_custkey id, c_nationkey label, row_number() OVER (PARTITION BY perm ORDER BY c_custkey) k,
 row_number() OVER (PARTITION BY perm ORDER BY ('0x' || substr(md5('144:' || perm || ':' || c_custkey), 1, 12))::bigint, c_custkey) d FROM customer, (SELECT unnest(range(1, 21)) perm))
SELECT a.perm, count(*) FILTER (a.id % 25 = b.label) AS linked FROM r a JOIN r b ON a.perm = b.perm AND a.k = b.d GROUP BY 1""")
def label_perm(t):
    items = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    dealt = statistics.label_permutations(items, 20)
    return dealt.groupBy("perm").agg(F.count_if(F.col("id") % 25 == F.col("label")).alias("linked"))
