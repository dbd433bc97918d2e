"""Alignments of near-equal sequences from their differences: distances, leaders, one copy per genome, parts.

``alignment``: algn, seq_id, seq, all of one length within ``algn``. A sequence is told by the places where it differs from the
consensus of its alignment, so a pair costs as many rows as it has places where both differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "-"


def cells(alignment: DataFrame) -> DataFrame:
    return alignment.select("algn", "seq_id", F.posexplode(F.split("seq", "")).alias("position", "base"))


def consensus(alignment: DataFrame) -> DataFrame:
    """(algn, position, common): the most frequent base of each place, the smallest on ties."""
    n = cells(alignment.filter("seq <> ''")).groupBy("algn", "position", "base").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("algn", "position").agg(F.max_by("base", F.struct("n", (-F.ascii("base")).alias("x"))).alias("common"))


def differences(alignment: DataFrame, common: DataFrame) -> DataFrame:
    """(algn, seq_id, position, base, common): where each sequence differs from the consensus."""
    rows = cells(alignment.filter("seq <> ''")).join(common, ["algn", "position"]).filter("base <> common")
    return rows.select("algn", "seq_id", "position", "base", "common")


def pair_distances(alignment: DataFrame, cut, others: DataFrame | None = None) -> DataFrame:
    """(algn, a, b, raw, shared): mismatches of each pair a < b, and their share of the places without a gap in either.

    With ``others`` (algn, seq_id), pairs of any sequence a with those as b instead, a <> b. ``shared`` is null without a place to
    compare. Counts per sequence (differences, gaps) make the distances of all pairs; only places where both differ
    from the consensus are joined.
    """
    common = cut(consensus(alignment))
    diff = cut(differences(alignment, common))
    width = common.groupBy("algn").agg(F.count(F.lit(1)).alias("width"), F.count_if(F.col("common") == GAP).alias("open"))
    fewer = diff.groupBy("algn", "seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") == GAP).alias("new"), F.count_if(F.col("common") == GAP).alias("filled"))
    one = alignment.select("algn", "seq_id").distinct().join(fewer, ["algn", "seq_id"], "left").fillna(0, ["n", "new", "filled"])
    one = cut(one)
    a = one.select("algn", *[F.col(c).alias(f"{c}_a") for c in ("seq_id", "n", "new", "filled")])
    second = one if others is None else one.join(others.select("algn", "seq_id").distinct(), ["algn", "seq_id"], "left_semi")
    b = second.select("algn", *[F.col(c).alias(f"{c}_b") for c in ("seq_id", "n", "new", "filled")])
    order = "seq_id_a < seq_id_b" if others is None else "seq_id_a <> seq_id_b"
    pairs = a.join(b, "algn").filter(order)
    left = diff.select("algn", "position", F.col("seq_id").alias("seq_id_a"), F.col("base").alias("x"), "common")
    right = diff.select("algn", "position", F.col("seq_id").alias("seq_id_b"), F.col("base").alias("y"))
    if others is not None:
        right = right.join(others.select("algn", F.col("seq_id").alias("seq_id_b")).distinct(), ["algn", "seq_id_b"], "left_semi")
    met = left.join(right, ["algn", "position"]).filter(order).groupBy("algn", "seq_id_a", "seq_id_b").agg(
        F.count(F.lit(1)).alias("both"), F.count_if(F.col("x") == F.col("y")).alias("same"),
        F.count_if((F.col("x") == GAP) & (F.col("y") == GAP)).alias("both_new"), F.count_if(F.col("common") == GAP).alias("both_filled"))
    keys = ["algn", "seq_id_a", "seq_id_b"]
    rows = pairs.join(met, keys, "left").fillna(0, ["both", "same", "both_new", "both_filled"]).join(width, "algn")
    raw = F.col("n_a") + F.col("n_b") - F.col("both") - F.col("same")
    gaps_a, gaps_b = (F.col("open") - F.col(f"filled_{x}") + F.col(f"new_{x}") for x in "ab")
    gaps_both = F.col("open") - F.col("filled_a") - F.col("filled_b") + F.col("both_filled") + F.col("both_new")
    compared = F.col("width") - gaps_a - gaps_b + gaps_both
    return rows.select(
        "algn", F.col("seq_id_a").alias("a"), F.col("seq_id_b").alias("b"), raw.alias("raw"),
        F.try_divide(raw - (gaps_a + gaps_b - 2 * gaps_both), compared).alias("shared"))


def alignment_leaders(alignment: DataFrame, cut, identity: float = 0.01, substitutions: int = 2) -> DataFrame:
    """(algn, seq_id, leader): a scan in the order of seq_id, then each to the leader of fewest mismatches.

    A sequence leads unless an earlier leader is within ``identity`` (shared distance) or ``substitutions`` (mismatches); of
    leaders equally near, the first. The scan runs in rounds over the pairs that are near enough: who waits for no earlier
    undecided sequence leads, and those near it do not. Repeated rows are one.
    """
    rows = cut(alignment.dropDuplicates(["algn", "seq_id"]))
    dist = pair_distances(rows, cut)
    near = cut(dist.filter((F.col("shared") <= identity) | (F.col("raw") <= substitutions)).select("algn", "a", "b"))
    state = cut(rows.select("algn", "seq_id", F.lit(None).cast("boolean").alias("leads")))
    waiting = near
    while not waiting.isEmpty():
        open_ = state.filter("leads IS NULL").select("algn", "seq_id")
        first = open_.join(waiting.select("algn", F.col("b").alias("seq_id")), ["algn", "seq_id"], "left_anti")
        late = waiting.join(first.withColumnRenamed("seq_id", "a"), ["algn", "a"], "left_semi").select("algn", F.col("b").alias("seq_id")).distinct()
        decided = cut(first.withColumn("now", F.lit(True)).unionByName(late.withColumn("now", F.lit(False))))
        state = cut(state.join(decided, ["algn", "seq_id"], "left").select("algn", "seq_id", F.coalesce("leads", "now").alias("leads")))
        for end in ("a", "b"):
            waiting = waiting.join(decided.select("algn", F.col("seq_id").alias(end)), ["algn", end], "left_anti")
        waiting = cut(waiting)
    leaders = cut(state.filter("coalesce(leads, true)").select("algn", "seq_id"))
    own = leaders.select("algn", "seq_id", F.col("seq_id").alias("leader"), F.lit(0).cast("long").alias("raw"))
    far = pair_distances(rows, cut, leaders).select("algn", F.col("a").alias("seq_id"), F.col("b").alias("leader"), "raw")
    best = own.unionByName(far).groupBy("algn", "seq_id").agg(F.min(F.struct("raw", "leader")).alias("best"))
    return best.select("algn", "seq_id", "best.leader")


def nearest_copy(alignment: DataFrame, cut) -> DataFrame:
    """(algn, genome, seq_id, seq): of several copies (algn, genome, seq_id, seq) the one whose mismatches with all other
    sequences of the alignment sum up to least, the smallest id on ties."""
    pairs = pair_distances(alignment.select("algn", "seq_id", "seq"), cut)
    each = pairs.select("algn", F.col("a").alias("seq_id"), "raw").unionByName(pairs.select("algn", F.col("b").alias("seq_id"), "raw"))
    total = each.groupBy("algn", "seq_id").agg(F.sum("raw").alias("total"))
    rows = alignment.join(total, ["algn", "seq_id"], "left")
    best = rows.groupBy("algn", "genome").agg(F.min_by(F.struct("seq_id", "seq"), F.struct(F.coalesce("total", F.lit(0)).alias("t"), "seq_id")).alias("best"))
    return best.select("algn", "genome", "best.seq_id", "best.seq")


def split_alignment(whole: DataFrame, partitions: DataFrame, names: DataFrame) -> DataFrame:
    """(gene, seq_id, seq): one alignment (seq_id, seq) cut into those of its genes (gene, start, end, from 1, both included).

    ``names`` (seq_id) has the sequences that must be there: a name that only one of the two has is an error.
    """
    left, right = whole.select("seq_id", F.lit(True).alias("has")), names.select("seq_id", F.lit(True).alias("asked")).distinct()
    odd = left.join(right, "seq_id", "full").filter("has IS NULL OR asked IS NULL").agg(F.min("seq_id").alias("odd"))
    rows = whole.crossJoin(F.broadcast(odd)).crossJoin(partitions)  # one name; a row per gene and sequence of the result
    checked = F.when(F.col("odd").isNotNull(), F.raise_error(F.concat(F.lit("names do not match: "), F.col("odd").cast("string")))).otherwise(
        F.substring(F.col("seq"), F.col("start"), F.col("end") - F.col("start") + 1))
    return rows.select("gene", "seq_id", checked.alias("seq"))


def split_alignments(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, algn, seq_id, seq): the sequences of each cluster, out of the first alignment that has any of them.

    ``rows``: algn, seq_id, seq; ``members``: cluster, seq_id. A cluster of one member has no rows. A member that the
    cluster's alignment lacks, or has twice, is an error that names it.
    """
    members = members.select("cluster", "seq_id").distinct()
    several = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    wanted = members.join(several, "cluster", "left_semi")
    counted = rows.groupBy("seq_id", "algn").agg(F.count(F.lit(1)).alias("times"), F.first("seq").alias("seq"))
    first = wanted.join(counted.select("seq_id", "algn"), "seq_id").groupBy("cluster").agg(F.min("algn").alias("algn"))
    found = wanted.join(first, "cluster", "left").join(counted, ["algn", "seq_id"], "left")
    name = F.concat_ws(" ", F.lit("cluster"), F.col("cluster").cast("string"), F.lit("sequence"), F.col("seq_id").cast("string"))
    seq = F.when(F.col("times") == 1, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not once in its alignment: "), name)))
    return found.select("cluster", "algn", "seq_id", seq.alias("seq"))
