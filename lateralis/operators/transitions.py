"""From a tree as read and a table of features to the edges on which each feature is gained or lost, in one call.

``tree``: edge, parent_edge, is_tip, length, label, as ``sources.formats.read_newick`` gives them for one tree;
``features``: label, feature, state (0 or 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.operators import likelihood, rooting
from lateralis.operators import tree as trees


def cleaned(tree: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``tree`` binary and without its root. If it has nodes of more than two children (a root of three counts as binary), the labels of
    tips under nodes with a tip on an edge of length 0 go in the order of ``order`` (label, place) first, then the nodes
    are resolved. Trees of three tips or fewer keep their root."""
    rows = tree.select("edge", "parent_edge", "is_tip", F.coalesce("length", F.lit(0.0)).alias("length"), "label")
    children = rows.groupBy("parent_edge").agg(F.count(F.lit(1)).alias("n"))
    wide = not children.filter("n > CASE WHEN parent_edge IS NULL THEN 3 ELSE 2 END").isEmpty()
    if order is not None and wide:
        rows = rows.join(order.select("label", "place").dropDuplicates(["label"]), "label", "left").select(*rows.columns, "place")
        tips = rows.filter("is_tip").withColumn("under", F.coalesce("parent_edge", F.lit(-1)))
        flat = tips.filter("length = 0").select("under").distinct()
        tips = tips.join(flat, "under", "left_semi")
        each = tips.groupBy("under").agg(  # the tips of one node
            F.array_sort(F.collect_list("edge")).alias("edges"), F.array_sort(F.collect_list(F.struct(F.col("place").isNull().alias("x"), "place", "label"))).alias("labels"))
        dealt = each.select(F.explode(F.arrays_zip("edges", "labels")).alias("z")).select(F.col("z.edges").alias("edge"), F.col("z.labels.label").alias("new"), F.lit(True).alias("dealt"))
        rows = rows.join(dealt, "edge", "left").withColumn("label", F.when(F.col("dealt"), F.col("new")).otherwise(F.col("label")))
    labels = rows.filter("is_tip").select("edge", "label")
    binary = rooting.resolve(rows)
    few = labels.limit(4).count() <= 3
    out = binary if few else rooting.unroot(binary)
    return out.join(labels, "edge", "left")


def matched_states(tree: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, edge, state) for every tip and feature; rows of labels that the tree lacks go, a tip without a row is an error."""
    tips = tree.filter("is_tip").select("edge", "label")
    cells = tips.crossJoin(features.select("feature").distinct()).join(features.select("label", "feature", "state"), ["label", "feature"], "left")
    missing = F.raise_error(F.concat(F.lit("no state of tip "), F.coalesce("label", F.lit("without a label"))))
    return cells.select("feature", "edge", F.when(F.col("state").isNull(), missing).otherwise(F.col("state")).cast("int").alias("state"))


def feature_transitions(tree: DataFrame, features: DataFrame, cut, method: str = "ace", outgroup: str | None = None, zero_root: bool = False) -> DataFrame:
    """(feature, edge, dir): 1 gained, 2 lost on the way down the edge; other edges have no row.

    ``method`` "ace" takes the likeliest states on the tree rooted at its midpoint if it has no root (of more than two edges);
    "mpr" takes the lower most parsimonious states on the tree without its root, and needs ``outgroup``, the label of a
    tip. With ``zero_root`` the outgroup's state is 0 for all features. Edges are those of the tree that the method sees.
    """
    if method not in ("ace", "mpr"):
        raise ValueError('method must be "ace" or "mpr"')
    if method == "mpr" and outgroup is None:
        raise ValueError("mpr needs an outgroup")
    if zero_root and outgroup is None:
        raise ValueError("zero_root needs an outgroup")
    labels = cut(tree.filter("is_tip").select("edge", "label"))
    edges = cut(tree.select("edge", "parent_edge", "is_tip", F.coalesce("length", F.lit(0.0)).alias("length")))
    if method == "mpr":
        edges = cut(rooting.unroot(edges))
    elif edges.filter("parent_edge IS NULL").limit(3).count() != 2:
        edges = cut(rooting.midpoint_root(edges, trees.ancestor_closure(edges, cut), cut))
    states = matched_states(edges.join(labels, "edge", "left"), features)
    if zero_root:
        states = rooting.zero_outgroup(states, labels.filter(F.col("label") == outgroup))
    states = cut(states)
    closure = trees.ancestor_closure(edges, cut)
    if method == "mpr":
        return trees.state_changes(edges, states, closure, cut)
    found, root = likelihood.likelihood_states(edges, states, closure, cut)
    return trees.transitions(cut(found.filter("state IS NOT NULL").select("feature", "edge", "state")), edges, root.select("feature", "root"))
