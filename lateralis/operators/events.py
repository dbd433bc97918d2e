"""Acquisition events: what isolates, places and strains the edges of a cluster's acquisitions hold.

``calls``: one row per isolate and cluster with genome, cluster, edge (of the acquisition, 0 or null where the isolate
lacks the cluster), status (1 transfer, 2 importation, null unknown), and columns such as state, strain and facility.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lateralis.operators import distances
from lateralis.operators.statistics import label_permutations


def acquired(calls: DataFrame) -> DataFrame:
    return calls.filter(F.coalesce("edge", F.lit(0)) != 0)


def status_text(status: Column) -> Column:
    return F.when(status == 1, "HGT").when(status == 2, "Importation")


def strain_label(sequence_type: Column, species: Column) -> Column:
    """The sequence type, or the species where the type is "Other" or missing."""
    return F.when(sequence_type != "Other", sequence_type).otherwise(species)


def sequence_type(text: Column, species: Column) -> Column:
    """"<species> ST<n>" from a text such as "MLST.Name_1.258"; of a comma list the first entry with "_1".

    Texts without MLST, nulls, and lists without such an entry are "Other".
    """
    entry = F.when(text.contains(","), F.get(F.filter(F.split(text, ","), lambda v: v.contains("_1")), F.lit(0))).otherwise(text)
    name = F.concat(species, F.lit(" ST"), F.element_at(F.split(entry, "[.]"), -1))
    return F.when(text.contains("MLST"), F.coalesce(name, F.lit("Other"))).otherwise("Other")


def event_status_counts(calls: DataFrame) -> DataFrame:
    """(cluster, edge, n_hgt, n_import): isolates of each event by status; events with neither are left out."""
    n = acquired(calls).groupBy("cluster", "edge").agg(
        F.count_if(F.col("status") == 1).alias("n_hgt"), F.count_if(F.col("status") == 2).alias("n_import"))
    return n.filter("n_hgt > 0 OR n_import > 0")


def hgt_edges(calls: DataFrame, place: str) -> DataFrame:
    """(cluster, place, n_edges): distinct edges with a transfer in the place."""
    return acquired(calls).filter("status = 1").groupBy("cluster", place).agg(F.countDistinct("edge").alias("n_edges"))


def acquisition_counts(calls: DataFrame, group: str) -> DataFrame:
    """(cluster, group, n_acq): distinct edges with a transfer, and one more where any status is unknown."""
    edge = F.when(F.col("status") == 1, F.col("edge"))
    n = F.countDistinct(edge) + F.max(F.col("status").isNull().cast("int"))
    return calls.groupBy("cluster", group).agg(n.alias("n_acq"))


def first_status(calls: DataFrame, kind: str) -> DataFrame:
    """(kind, status, n): events by the kind and status of their first isolate."""
    first = acquired(calls).groupBy("cluster", "edge").agg(F.min(F.struct("genome", kind, "status")).alias("f"))
    return first.groupBy(F.col(f"f.{kind}").alias(kind), F.col("f.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def event_sizes(calls: DataFrame) -> DataFrame:
    """(cluster, edge, size): isolates of each event."""
    return acquired(calls).groupBy("cluster", "edge").agg(F.count(F.lit(1)).alias("size"))


def sizes_upto(sizes: DataFrame) -> DataFrame:
    """(cluster, size, n, n_upto): events of each size, and of that size or less."""
    n = sizes.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("cluster").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumn("n_upto", F.sum("n").over(upto))


def largest_event(calls: DataFrame) -> DataFrame:
    """(cluster, edge, n_major, n_rest): the event with most isolates, the smallest edge on ties, and isolates of the others."""
    s = event_sizes(calls).groupBy("cluster").agg(F.min(F.struct((-F.col("size")).alias("m"), "edge")).alias("b"), F.sum("size").alias("n"))
    return s.select("cluster", "b.edge", (-F.col("b.m")).alias("n_major"), (F.col("n") + F.col("b.m")).alias("n_rest"))


def linked_places(calls: DataFrame, place: str) -> DataFrame:
    """(cluster, edge, place, n_linked, linked): single transfers and whether their place holds expanded events.

    A single transfer is an event of one isolate with status 1. ``n_linked`` counts the isolates of its place in
    events of the same cluster with more than one isolate; it is linked when there is more than one of them. Isolates
    without a place are in no place.
    """
    rows = acquired(calls).join(event_sizes(calls), ["cluster", "edge"])
    single = rows.filter(f"size = 1 AND status = 1 AND {place} IS NOT NULL").select("cluster", "edge", place)
    held = rows.filter("size > 1").groupBy("cluster", place).agg(F.count(F.lit(1)).alias("n_linked"))
    out = single.join(held, ["cluster", place], "left").fillna(0, ["n_linked"])
    return out.withColumn("linked", F.col("n_linked") > 1)


def linked_shares(calls: DataFrame, place: str, permutations: int, seed: int = 144) -> DataFrame:
    """(perm, n_single, n_linked, share): of single transfers, those whose place holds more than one isolate of the cluster's
    events, once per permutation of the places among the genomes.

    Transfers keep their place; the isolates have the place that was dealt to their (numeric) genome. All events of
    a cluster count here, expanded or not, so shares lie above that of ``linked_places``, which asks for expanded ones. Genomes
    without a place take no part in the dealing; ``share`` is null without single transfers.
    """
    rows = acquired(calls).join(event_sizes(calls), ["cluster", "edge"])
    single = rows.filter(f"size = 1 AND status = 1 AND {place} IS NOT NULL").groupBy("cluster", F.col(place).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    items = calls.filter(F.col(place).isNotNull()).groupBy(F.col("genome").alias("id")).agg(F.min(place).alias("label"))
    dealt = label_permutations(items, permutations, seed)
    held = rows.select("cluster", F.col("genome").alias("id")).join(dealt, "id").groupBy("perm", "cluster", "label").agg(F.count(F.lit(1)).alias("held"))
    linked = held.filter("held > 1").join(single, ["cluster", "label"]).groupBy("perm").agg(F.sum("n").alias("n_linked"))
    every = calls.sparkSession.range(1, permutations + 1).select(F.col("id").cast("int").alias("perm"))
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_single"))
    out = every.join(linked, "perm", "left").fillna(0, ["n_linked"]).crossJoin(F.broadcast(total))  # one number
    return out.select("perm", "n_single", "n_linked", F.try_divide("n_linked", "n_single").alias("share"))


def presence_classes(events: DataFrame) -> DataFrame:
    """(class, n): clusters none, some or all of whose events have a status other than 1; see ``tree.edge_status``. Events without one do not count."""
    on = F.col("status") != 1
    per = events.filter("status IS NOT NULL").groupBy("cluster").agg(F.count_if(on).alias("on"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("on") == 0, "never").when(F.col("on") == F.col("n"), "always").otherwise("sometimes")
    return per.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def member_shares(counts: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, edge, share): of the members (cluster, feature) of each cluster, those present on an edge (cluster, edge, n)."""
    size = members.groupBy("cluster").agg(F.countDistinct("feature").alias("size"))
    return counts.join(size, "cluster").select("cluster", "edge", (F.col("n") / F.col("size")).alias("share"))


def genome_places(genomes: DataFrame, places: DataFrame, source: str, place: str, outside: str = "Other") -> DataFrame:
    """``genomes`` (genome, source) with the place of their first row in ``places`` (genome, order, place); null where the source is ``outside``."""
    first = places.groupBy("genome").agg(F.min_by(place, "order").alias("__place__"))
    rows = genomes.join(first, "genome", "left")
    return rows.withColumn(place, F.when(~F.col(source).eqNullSafe(outside), F.col("__place__"))).drop("__place__")


def place_overlap(calls: DataFrame, place: str) -> DataFrame:
    """(cluster, n_hgt, n_shared, share): transfers, and those whose place also holds an importation of the cluster."""
    rows = acquired(calls).filter("status IS NOT NULL")
    imported = rows.filter("status = 2").select("cluster", place).distinct().withColumn("i", F.lit(True))
    n = rows.filter("status = 1").join(imported, ["cluster", place], "left").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_hgt"), F.count("i").alias("n_shared"))
    return n.withColumn("share", F.col("n_shared") / F.col("n_hgt"))


def set_regions(members: DataFrame, item: str, group: str) -> DataFrame:
    """(groups, n): how many items occur in exactly these groups, the groups sorted and comma-joined."""
    seen = members.filter(F.col(group).isNotNull()).select(item, group).distinct()
    at = seen.groupBy(item).agg(F.array_join(F.array_sort(F.collect_list(F.col(group).cast("string"))), ",").alias("groups"))
    return at.groupBy("groups").agg(F.count(F.lit(1)).alias("n"))


def edge_features(changes: DataFrame, direction: int) -> DataFrame:
    """(edge, features): the features that change this way on each edge, sorted."""
    kept = changes.filter(F.col("dir") == direction)
    return kept.groupBy("edge").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def change_to_parent(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(edge, change): the value of each edge less that of its parent edge; missing values are 0, root edges have null."""
    own = values.select("edge", F.col(value).alias("own"))
    above = values.select(F.col("edge").alias("parent_edge"), F.col(value).alias("above"))
    rows = edges.select("edge", "parent_edge").join(own, "edge", "left").join(above, "parent_edge", "left")
    change = F.coalesce("own", F.lit(0)) - F.coalesce("above", F.lit(0))
    return rows.select("edge", F.when(F.col("parent_edge").isNotNull(), change).alias("change"))


def long_pairs(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """(a, b, dist, same_state, same_facility) for each other isolate; the facility flag is null unless some other shares it.

    ``meta``: id, state, facility.
    """
    left = meta.select(F.col("id").alias("a"), F.col("state").alias("sa"), F.col("facility").alias("fa"))
    right = meta.select(F.col("id").alias("b"), F.col("state").alias("sb"), F.col("facility").alias("fb"))
    rows = pairs.filter("a <> b").join(left, "a").join(right, "b")
    same = F.coalesce(F.col("fa") == F.col("fb"), F.lit(False))
    shares = rows.groupBy("a").agg(F.max(same).alias("shares"))
    flag = F.when(F.col("shares"), same)
    return rows.join(shares, "a").select("a", "b", "dist", (F.col("sa") == F.col("sb")).alias("same_state"), flag.alias("same_facility"))


def label_pairs(vectors: DataFrame) -> DataFrame:
    """``long_pairs`` of the distances within each label, made where the distances are: no pair is shuffled.

    ``vectors``: label, id, vector, state, facility. Whether an isolate shares its facility with another is counted per label and facility.
    """
    v = vectors.filter("label IS NOT NULL AND id IS NOT NULL")
    met = v.groupBy("label", "facility").agg(F.countDistinct("id").alias("n")).filter("n > 1 AND facility IS NOT NULL").drop("n")
    shared = v.join(met, ["label", "facility"], "left_semi").select("id").distinct().withColumn("shares", F.lit(True))
    v = v.join(shared, "id", "left").withColumn("shares", F.coalesce("shares", F.lit(False))).withColumn("taken", F.lit(True))

    def rows(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ids = b["id"].to_numpy()
        i, j = np.nonzero(ids[a.index][:, None] != ids[None, :])
        state, facility = (pd.factorize(b[c])[0] for c in ("state", "facility"))
        shares, at = a["shares"].to_numpy(), a.index.to_numpy()[i]
        same, known = state[at] == state[j], (state[at] >= 0) & (state[j] >= 0)
        place = (facility[at] == facility[j]) & (facility[at] >= 0)
        return pd.DataFrame({"a": ids[at], "b": ids[j], "dist": d[i, j], "same_state": pd.arrays.BooleanArray(same, ~known), "same_facility": pd.arrays.BooleanArray(place, ~shares[i])})

    kind = dict(vectors.dtypes)["id"]
    return distances.in_strips(v, rows, f"a {kind}, b {kind}, dist double, same_state boolean, same_facility boolean").drop("label")


def indicator_features(meta: DataFrame, genome: str, columns: list[str], least: int = 1) -> DataFrame:
    """(genome, feature): "column=value" of each isolate, for values that ``least`` isolates or more have."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    rows = meta.select(genome, F.explode(F.array_compact(F.array(*parts))).alias("feature")).distinct()
    kept = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("feature")
    return rows.join(kept, "feature", "left_semi").select(genome, "feature")
