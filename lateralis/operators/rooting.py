"""Trees made ready for the operators on them: tips kept or dropped, roots moved, nodes resolved, tips in order.

``edges``: edge, parent_edge (null below the root), is_tip, length; ``closure``: edge, anc, depth as in ``tree``.
Lengths are not negative. An edge is its lower node; the root has no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lateralis.operators.statistics import sums_before
from lateralis.session import dealt

COLUMNS = ["edge", "parent_edge", "is_tip", "length"]


def with_lengths(closure: DataFrame, edges: DataFrame) -> DataFrame:
    return closure.join(edges.select(F.col("edge").alias("anc"), "length"), "anc").select("edge", "anc", "depth", "length")


def keep_tips(edges: DataFrame, closure: DataFrame, tips: DataFrame) -> DataFrame:
    """The tree of the tips in ``tips`` (edge). Nodes with one child left are taken out, their lengths added up.

    A root left with one internal child goes with that child's edge. Without any kept tip there are no edges.
    """
    tips = tips.select("edge").distinct()
    kept = edges.join(closure.join(tips, "edge", "left_semi").select(F.col("anc").alias("edge")).distinct(), "edge", "left_semi")
    forks = kept.groupBy(F.col("parent_edge").alias("edge")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND edge IS NOT NULL").select("edge")
    nodes = forks.unionByName(tips)
    above = closure.join(nodes, "edge", "left_semi").join(nodes.select(F.col("edge").alias("anc")), "anc", "left_semi")
    parent = above.filter("depth > 1").groupBy("edge").agg(F.min(F.struct("depth", "anc")).alias("p"))
    nearest = nodes.join(parent, "edge", "left").select("edge", F.col("p.anc").alias("parent_edge"), F.col("p.depth").alias("stop"))
    rows = with_lengths(closure, edges).join(nearest, "edge").filter("stop IS NULL OR depth < stop").groupBy("edge", "parent_edge").agg(F.sum("length").alias("length"))
    rows = rows.join(edges.select("edge", "is_tip"), "edge")
    top = rows.filter("parent_edge IS NULL").agg(F.count(F.lit(1)).alias("n"), F.first(F.when(~F.col("is_tip"), F.col("edge"))).alias("top"))
    top = top.filter("n = 1").select("top")  # at most one row
    rows = rows.join(F.broadcast(top), F.lit(True), "left")
    return rows.filter("top IS NULL OR edge <> top").select(
        "edge", F.when(F.col("top").isNull() | (F.col("parent_edge") != F.col("top")), F.col("parent_edge")).alias("parent_edge"), "is_tip", "length")


def drop_tips(edges: DataFrame, closure: DataFrame, tips: DataFrame) -> DataFrame:
    return keep_tips(edges, closure, edges.filter("is_tip").join(tips, "edge", "left_anti"))


def tip_order(edges: DataFrame, closure: DataFrame, width: int = 4096) -> DataFrame:
    """(edge, position): tips as displayed, from 1: children in the order of their (integer) edges.

    Before a tip come the tips below the smaller siblings of the tip and of every edge above it, so its place is a sum over its
    way to the root; siblings are added up in ranges of ``width`` edges.
    """
    tips = edges.filter("is_tip").select("edge")
    ways = closure.join(tips, "edge", "left_semi").select("edge", "anc")
    below = ways.groupBy(F.col("anc").alias("edge")).agg(F.count(F.lit(1)).alias("tips"))
    ranked = sums_before(edges.select("edge", "parent_edge").join(below, "edge"), ["parent_edge"], "edge", "tips", "earlier", width)
    rows = ways.join(ranked.select(F.col("edge").alias("anc"), "earlier"), "anc")
    return rows.groupBy("edge").agg((F.sum("earlier") + 1).alias("position"))


def distances_from(lengths: DataFrame, edge: int) -> DataFrame:
    """(edge, dist, own): path lengths from the lower end of ``edge``, and those from where the paths part down to there."""
    above = lengths.filter(F.col("edge") == edge).select("anc", F.lit(1).alias("shared"))
    total = lengths.filter(F.col("edge") == edge).agg(F.sum("length").alias("total"))
    rows = lengths.join(above, "anc", "left").groupBy("edge").agg(
        F.sum("length").alias("d"), F.sum(F.when(F.col("shared").isNotNull(), F.col("length")).otherwise(0.0)).alias("s"))
    rows = rows.crossJoin(F.broadcast(total))  # one number
    return rows.select("edge", (F.col("total") + F.col("d") - 2 * F.col("s")).alias("dist"), (F.col("total") - F.col("s")).alias("own"))


def midpoint_root(edges: DataFrame, closure: DataFrame, cut, old_root: int = 0) -> DataFrame:
    """The tree rooted in the middle of its longest path between tips; as it was where all paths have length 0.

    The ends of that path are found in two sweeps: the tip farthest from any tip, and the tip farthest from that one
    (the smallest edge on ties). The old root stays as node ``old_root`` if it has two other children or more.
    """
    lengths = cut(with_lengths(closure, edges))
    tips = edges.filter("is_tip").select("edge")

    def farthest(edge):
        return distances_from(lengths, edge).join(tips, "edge", "left_semi").orderBy(F.desc("dist"), "edge").first()

    start = tips.agg(F.min("edge")).first()[0]
    if start is None:
        return edges.select(*COLUMNS)
    a = farthest(start)
    b = farthest(a.edge)
    if not b.dist > 0:
        return edges.select(*COLUMNS)
    half = b.dist / 2
    end = a.edge if b.own >= half else b.edge
    upto = W.orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    path = lengths.filter(F.col("edge") == end).select(F.col("anc").alias("edge"), "depth", "length").withColumn("sum", F.sum("length").over(upto))
    # half may exceed the last sum by a rounding error: the last edge then
    m = path.filter(F.col("sum") >= half).orderBy("depth").first() or path.orderBy(F.desc("depth")).first()
    low = min(max(half - (m["sum"] - m["length"]), 0.0), m["length"])
    turned = path.filter(F.col("depth") >= m["depth"])
    size = turned.count()
    order = W.orderBy("depth")
    below = F.lag("edge").over(order)
    span = F.lag("length").over(order) - F.when(F.col("depth") == m["depth"] + 1, low).otherwise(0.0)
    flipped = turned.select(
        "edge", F.when(F.col("depth") > m["depth"] + 1, below).alias("parent_edge"),
        F.when(F.col("depth") == m["depth"], low).otherwise(span).alias("length"))
    top = turned.orderBy(F.desc("depth")).first()
    root_length = top["length"] - (low if size == 1 else 0.0)
    root_parent = F.lit(None) if size == 1 else F.lit(top["edge"])
    kind = dict(edges.select("edge", "parent_edge").dtypes)["parent_edge"]
    flipped = flipped.join(edges.select("edge", "is_tip"), "edge").select(*COLUMNS)
    rest = edges.join(turned.select("edge"), "edge", "left_anti").select(*COLUMNS)
    others = rest.filter("parent_edge IS NULL").count()
    under_root = F.col("parent_edge").isNull()
    if others == 1:
        rest = rest.select(
            "edge", F.when(under_root, root_parent.cast(kind)).otherwise(F.col("parent_edge")).alias("parent_edge"), "is_tip",
            (F.col("length") + F.when(under_root, root_length).otherwise(0.0)).alias("length"))
        return flipped.unionByName(rest)
    rest = rest.withColumn("parent_edge", F.when(under_root, F.lit(old_root).cast(kind)).otherwise(F.col("parent_edge")))
    root = edges.sparkSession.range(1).select(
        F.lit(old_root).cast(kind).alias("edge"), root_parent.cast(kind).alias("parent_edge"), F.lit(others == 0).alias("is_tip"), F.lit(root_length).alias("length"))
    return flipped.unionByName(rest).unionByName(root)


def unroot(edges: DataFrame) -> DataFrame:
    """A root with two edges loses the first internal one, whose length goes to the other; other trees stay."""
    tops = edges.filter("parent_edge IS NULL").orderBy("edge").limit(3).collect()
    inner = [r for r in tops if not r.is_tip]
    if len(tops) != 2 or not inner:
        return edges.select(*COLUMNS)
    gone = inner[0]
    more = F.when(F.col("parent_edge").isNull(), gone.length).otherwise(0.0)
    parent = F.when(F.col("parent_edge") != gone.edge, F.col("parent_edge"))
    return edges.filter(F.col("edge") != gone.edge).select("edge", parent.alias("parent_edge"), "is_tip", (F.col("length") + more).alias("length"))


def resolve(edges: DataFrame) -> DataFrame:
    """Nodes with more than two children become ladders of edges of length 0, children in the order of their edges.

    A new node has the largest edge of the tree plus the edge of its first child as id. The children of one node are
    numbered in one task.
    """
    base = edges.agg(F.max("edge")).first()[0] or 0
    w = W.partitionBy("parent_edge").orderBy("edge")
    rows = edges.select(*COLUMNS).withColumns({
        "j": F.row_number().over(w), "k": F.count(F.lit(1)).over(W.partitionBy("parent_edge")), "before": F.lag("edge").over(w)})
    own, last = F.col("edge") + base, F.col("before") + base
    inside = (F.col("j") > 1) & (F.col("j") < F.col("k"))
    parent = F.when(inside, own).when((F.col("k") > 2) & (F.col("j") == F.col("k")), last).otherwise(F.col("parent_edge"))
    old = rows.select("edge", parent.alias("parent_edge"), "is_tip", "length")
    new = rows.filter(inside).select(
        own.alias("edge"), F.when(F.col("j") == 2, F.col("parent_edge")).otherwise(last).alias("parent_edge"), F.lit(False).alias("is_tip"), F.lit(0.0).alias("length"))
    return old.unionByName(new)


def outgroup(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(edge): the first or the last displayed tip, whichever has the longer edge, the first on ties."""
    rows = tip_order(edges, closure).join(edges.select("edge", "length"), "edge")
    ends = rows.agg(F.min(F.struct("position", "edge", "length")).alias("a"), F.max(F.struct("position", "edge", "length")).alias("b"))
    return ends.select(F.when(F.col("b.length") > F.col("a.length"), F.col("b.edge")).otherwise(F.col("a.edge")).alias("edge")).filter("edge IS NOT NULL")


def zero_outgroup(states: DataFrame, tips: DataFrame) -> DataFrame:
    """``states`` (feature, edge, state) with state 0 at the tips in ``tips``."""
    marked = states.join(tips.select("edge").distinct().withColumn("__out__", F.lit(True)), "edge", "left")
    return marked.withColumn("state", F.when(F.col("__out__"), F.lit(0)).otherwise(F.col("state"))).drop("__out__")


def ancestors_before(closure: DataFrame, gains: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, edge, anc, depth): for each of ``features`` each edge and the way to the root, up to but without the next gain edge above it.

    ``gains``: feature, edge. ``closure`` is read thrice, so it should be cut; it meets the gains of all features at once.
    """
    n = closure.count()
    marks = dealt(gains.select(F.col("edge").alias("anc"), "feature").distinct(), n, "anc")
    met = dealt(closure.filter("depth > 1"), n, "anc").join(marks, "anc").select("edge", "feature", "depth")
    stops = dealt(met, n, "edge").groupBy("edge", "feature").agg(F.min("depth").alias("stop"))
    stops = stops.groupBy("edge").agg(F.map_from_entries(F.collect_list(F.struct("feature", "stop"))).alias("stops"))
    rows = dealt(closure, n, "edge").join(stops, "edge", "left").crossJoin(F.broadcast(features.select("feature")))  # a row of the result each
    stop = F.try_element_at("stops", F.col("feature"))
    return rows.filter(stop.isNull() | (F.col("depth") < stop)).select("feature", "edge", "anc", "depth")


def nearest_label(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """(edge, label): the label of the nearest labelled edge on the way to the root. An edge with two labels is an error."""
    one = labels.groupBy("edge").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("edge with several labels: "), F.col("edge").cast("string")))).otherwise(F.col("label"))
    rows = closure.join(one.select(F.col("edge").alias("anc"), checked.alias("label")), "anc")
    return rows.groupBy("edge").agg(F.min(F.struct("depth", "label")).alias("b")).select("edge", "b.label")
