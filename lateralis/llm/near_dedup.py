"""MinHash near-dedup with DartMinHash signatures and banded joining.

A text is a weighted set: its runs of five words, each weighing as often as it occurs. Darts fall on
every unit of weight by a hash-driven Poisson process in time; each dart has a coordinate, and the
earliest dart on a text's region per coordinate is that coordinate of its signature. Two signatures
agree in a coordinate with the probability of their weighted Jaccard similarity. Only as much time
is looked at as gives each coordinate a dart, so the work is near the number of words plus
k ln k, not their product.

Texts of equal word sequences are one node from the start. Nodes that share a band are candidates:
in a small bucket every pair, in a large one each member with the most central member, and then,
among what is still unlinked there, with the most central of those. A member that is still outside
its bucket's main component is tried with all members of other components, unless so many units of
either occur nowhere else that the two cannot be similar enough. Candidates are verified by exact
similarity; classes are the connected components of what passes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lateralis.llm import bloom
from lateralis.llm.shared import named, scratch, smaller_batches, stage
from lateralis.llm.wordhash import LOWER, PLACE, blocks, buffers, mix, shingles, words_of

#: Units that a task counts at once.
UNITS_PER_PART = 1_000_000
SKETCH_TYPE = "d long, row long, digest binary, bands array<long>"
LAST = (1 << 63) - 1
COPY, SLOT, DART = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Cumulative probabilities of 0, 1, 2, ... darts on a unit of weight in a unit of time.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def units(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Each text's occurrences as distinct unit weights: (element, how many of it came before); sorted per text by element."""
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    start = np.flatnonzero(new)
    copy = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return mix(h + copy.astype(np.uint64) * COPY)


def darts(unit: np.ndarray, text: np.ndarray, until: np.ndarray, k: int):
    """(text, coordinate, time, dart) of all darts on the units before their text's ``until``."""
    slots = np.maximum(1, np.ceil(until)).astype(np.int64)[text]
    owner = np.repeat(text, slots)
    slot = np.arange(len(owner)) - np.repeat(np.cumsum(slots) - slots, slots)
    cell = mix(np.repeat(unit, slots) + (slot.astype(np.uint64) + np.uint64(1)) * SLOT)
    number = np.searchsorted(POISSON, (cell >> np.uint64(11)) * 2.0**-53, side="right")
    out = []
    for j in range(int(number.max(initial=0))):
        at = np.flatnonzero(number > j)
        dart = mix(cell[at] + np.uint64((j + 1) * int(DART) % 2**64))
        time = slot[at] + (dart >> np.uint64(32)) * 2.0**-32
        soon = time < until[owner[at]]
        dart, at = dart[soon], at[soon]
        out.append((owner[at], ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64), time[soon], dart))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(unit: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
    """One row of k darts per text; rows of texts without words are 0."""
    n = np.diff(ptr)
    out = np.zeros((len(n), k), dtype=np.uint64)
    todo = np.flatnonzero(n > 0)
    until = np.zeros(len(n))
    until[todo] = (k * math.log(k) + 2 * k) / n[todo]
    text = np.repeat(np.arange(len(n)), n)
    while len(todo):
        mine = np.isin(text, todo)
        who, coordinate, time, dart = darts(unit[mine], text[mine], until, k)
        place = who * k + coordinate
        order = np.lexsort((dart, time, place))
        place, dart = place[order], dart[order]
        first = np.ones(len(place), dtype=bool)
        first[1:] = place[1:] != place[:-1]
        complete = np.bincount(place[first] // k, minlength=len(n)) == k
        done = first & complete[place // k]
        out.reshape(-1)[place[done]] = dart[done]
        todo = todo[~complete[todo]]  # a coordinate without a dart: look on, twice as far
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, different bands apart."""
    parts = signature.reshape(len(signature), -1, rows)
    keys = (parts * PLACE[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * DART)


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(named(text), F.lit(""))
    return docs.select(
        F.coalesce(named(key).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(named(key), whole).alias("row"),
        whole.alias("text"))


def sketches(texts: DataFrame, bands: int, rows: int, size: int = 5) -> DataFrame:
    """(d, row, digest, bands): 128 bits of the word sequence and the band keys; both null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            column = batch.column(2)
            words = words_of(column)
            keys = band_keys(signatures(units(*(s := shingles(words, size))), s[1], bands * rows), rows)
            data, _ = buffers(column)
            low = LOWER[data]
            digests = []
            for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
                if a == b:
                    digests.append(None)
                    continue
                sha = hashlib.blake2b(digest_size=16)
                spans = zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)
                whole = low[words.starts[a]:words.ends[b - 1]].tobytes()
                base = int(words.starts[a])
                sha.update(b" ".join([whole[x - base:y - base] for x, y in spans]))
                digests.append(sha.digest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                pa.array([None if x is None else k for x, k in zip(digests, keys.view(np.int64).tolist(), strict=True)], pa.list_(pa.int64())),
            ], ["d", "row", "digest", "bands"])

    return texts.mapInArrow(sketch, SKETCH_TYPE)


def weighted_sets(texts: DataFrame, size: int = 5) -> DataFrame:
    """(node, units): the sorted unit weights of each text, 8 bytes each. ``texts`` has node, text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            h, ptr = shingles(words_of(batch.column(1)), size)
            u = units(h, ptr)
            sets = [np.sort(u[a:b]).tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "units"])

    return texts.mapInArrow(measure, "node long, units binary")


def jaccard(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two ``units``."""

    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return arrow_udf(similarity, "double")(a, b)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for each node of ``links`` (a, b). Staged.

    In each round a node takes its smallest neighbour as its label and then that one's label; links
    are carried over to labels, and those within one label vanish. So all rounds together hold little
    more than the first.
    """
    edges, found = links.select("a", "b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
        low = stage(low, "lower")
        labels = stage(low.join(low.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select(
            "node", F.col("next").alias("comp")), "labels")
        if found is None:
            found = labels
        else:
            step = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            found = stage(found.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "comps")
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").filter("x <> y")
        edges = stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found


def candidate_pairs(buckets: DataFrame, small: int) -> DataFrame:
    """(a, b): every pair of a bucket of at most ``small`` members; else each member with the most central one."""
    little = buckets.filter(F.col("n") <= small).select("bucket", "node")
    pairs = little.select("bucket", F.col("node").alias("a")).join(
        little.select("bucket", F.col("node").alias("b")), "bucket").filter("a < b").select("a", "b")
    return pairs.unionByName(with_pivots(buckets.filter(F.col("n") > small)))


def with_pivots(members: DataFrame) -> DataFrame:
    """Each member with its bucket's member that meets most others over all its buckets, then the smallest."""
    pivots = members.groupBy("bucket").agg(F.max(F.struct("mass", (-F.col("node")).alias("x"))).alias("best")).select(
        "bucket", (-F.col("best.x")).alias("pivot"))
    return members.select("bucket", "node").join(pivots, "bucket").filter("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def large_buckets(members: DataFrame, comps: DataFrame, small: int) -> DataFrame:
    """(bucket, node, mass, comp, main, pivot, open) of the large buckets: pivot is the most central member, main its component,
    open whether the bucket has members of other components."""
    large = members.filter(F.col("n") > small).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    large = stage(large.select("bucket", "node", "mass", "comp"), "large-buckets")
    best = F.max(F.struct("mass", (-F.col("node")).alias("x"), "comp"))
    each = large.groupBy("bucket").agg(best.alias("best"), (F.min("comp") < F.max("comp")).alias("open"))
    return large.join(each.select("bucket", F.col("best.comp").alias("main"), (-F.col("best.x")).alias("pivot"), "open"), "bucket")


def later_pivots(large: DataFrame) -> DataFrame:
    """(a, b): each member with the most central of those outside the main component, if in another component."""
    best = F.max(F.struct("mass", (-F.col("node")).alias("x"), "comp")).alias("best")
    pivots = large.filter("comp <> main").groupBy("bucket").agg(best).select(
        "bucket", (-F.col("best.x")).alias("pivot"), F.col("best.comp").alias("pivot_comp"))
    return large.drop("pivot").join(pivots, "bucket").filter("comp <> pivot_comp").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def single_units(sets: DataFrame, per_part: int = UNITS_PER_PART) -> DataFrame:
    """(node, size, lone): how many units each node has, and how many of them no other node of ``sets`` has.

    A task sends the distinct units of its texts, packed by a hash of the unit into parts of about ``per_part`` units, each with
    its node, or -1 if several have it. So there are no rows per unit, and a unit of all texts counts once per batch of texts.
    """
    size = (F.octet_length("units") / 8).cast("long")
    parts = (sets.agg(F.sum(size)).first()[0] or 0) // per_part + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.as_py() for x in batch.column(1)]
            unit = np.frombuffer(b"".join(packed), np.uint64)
            node = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in packed])
            unit, first, n = np.unique(unit, return_index=True, return_counts=True)
            owner = np.where(n == 1, node[first], -1)
            part = (unit % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
            yield pa.RecordBatch.from_arrays([
                pa.array([int(part[x[0]]) for x in at], pa.int64()), pa.array([unit[x].tobytes() for x in at], pa.binary()),
                pa.array([owner[x].tobytes() for x in at], pa.binary())], ["part", "units", "owners"])

    def alone(table: pa.Table) -> pa.Table:
        unit, owner = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("units", np.uint64), ("owners", np.int64)))
        _, first, n = np.unique(unit, return_index=True, return_counts=True)
        own = owner[first[n == 1]]
        node, lone = np.unique(own[own >= 0], return_counts=True)
        return pa.table({"node": pa.array(node, pa.int64()), "lone": pa.array(lone, pa.int64())})

    packed = sets.select("node", "units").mapInArrow(pack, "part long, units binary, owners binary")
    lone = packed.groupBy("part").applyInArrow(alone, "node long, lone long").groupBy("node").agg(F.sum("lone").alias("lone"))
    return sets.select("node", size.alias("size")).join(lone, "node", "left").select("node", "size", F.coalesce("lone", F.lit(0)).alias("lone"))


def able_members(held: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """The members that can be similar to some member of their bucket, with size and shared (units).

    A member of n units, c of which any other member has, can share at most c of them: with one of m
    units it has a similarity of at most c / (n + m - c). Members for which that is too little even
    with the smallest one of their bucket can have no link in it and go, and then buckets without strays.
    """
    counted = stage(single_units(sets.join(held.select("node"), "node", "left_semi").select("node", "units")), f"lone-units-{label}")
    counted = counted.select("node", "size", (F.col("size") - F.col("lone")).alias("shared"))
    sized = stage(held.select("bucket", "node", "comp", "main", "central").join(counted, "node"), f"sized-{label}")
    able = F.col("shared") * (1 + 1 / similarity) >= F.col("size") + F.col("least") - 1e-6
    least = sized.groupBy("bucket").agg(F.min("size").alias("least"))
    strayed = sized.filter("comp <> main").join(least, "bucket").filter(able).select("bucket", "least").distinct()
    return stage(sized.join(strayed, "bucket").filter(able).drop("least"), f"able-{label}")


def stray_pairs(large: DataFrame, sets: DataFrame, measured: DataFrame, similarity: float) -> DataFrame:
    """(a, b): members outside their bucket's main component with those members of other components that
    the numbers of shared units of both allow (see ``able_members``), each pair in one of its buckets.

    Units are counted twice, the second time among the members that the first left. All members of a
    bucket have been measured against its most central one. One minus the similarity is a distance, so
    by the triangle inequality two that differ by more than 1 - ``similarity`` there cannot be similar.
    """
    held = large.filter("open").select("*", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    held = held.join(measured, ["a", "b"], "left").withColumn("central", F.coalesce("similarity", F.lit(1.0)))
    held = stage(held.select("bucket", "node", "comp", "main", "central"), "open-members")
    for label in ("first", "second"):
        held = able_members(held, sets, similarity, label)
    own = held.groupBy("node").agg(F.collect_set("bucket").alias("own"))  # one of each band at most
    held = stage(held.join(own, "node"), "able-members")
    stray = held.filter("comp <> main").select("bucket", *[F.col(c).alias(f"stray_{c}") for c in ("node", "comp", "size", "shared", "central", "own")])
    met = held.join(stray, "bucket").filter(
        (F.col("comp") != F.col("stray_comp")) & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("stray_node")))
        & (F.abs(F.col("central") - F.col("stray_central")) <= 1 - similarity + 1e-9)
        & (F.least("shared", "stray_shared") * (1 + 1 / similarity) >= F.col("size") + F.col("stray_size") - 1e-6)
        & (F.array_min(F.array_intersect("own", "stray_own")) == F.col("bucket")))
    return met.select(F.least("node", "stray_node").alias("a"), F.greatest("node", "stray_node").alias("b"))


def near_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    bands: int = 25,
    rows: int = 5,
    small: int = 8,
    proofs: bool = False,
) -> DataFrame:
    """(d, row, class_id, class_size, kept): one row per document, staged; with ``proofs`` also via_id and similarity.

    The class of a text is its connected component under weighted Jaccard similarity of at least
    ``similarity`` of five-word runs; a text of fewer words is one run, a text without words (or null)
    is alone. ``class_id`` is the smallest key of the class, and exactly one row of the class is kept:
    one with that key. Null keys come last (``d`` is then 2**63 - 1). A pair at similarity 0.8 is missed
    by all bands with a probability of 0.00005.

    The row with the smallest key of a text stands for it. Its ``via_id`` is the key that stands for the most similar of the
    texts that it has a verified link to (the smallest key on ties), ``similarity`` the similarity to it; both are null without
    a link. Other rows of the text point to the one that stands for it, with 1. ``near_links`` gives all links.
    """
    smaller_batches(docs.sparkSession, 250)
    with scratch(docs.sparkSession):
        return classes_of(keyed_texts(docs, key, text), similarity, bands, rows, small, proofs)


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, bands: int = 25, rows: int = 5, small: int = 8) -> DataFrame:
    """(a, b, similarity): the verified links that span the classes of ``near_classes``, staged; a and b are the keys that stand
    for two different texts. Not every similar pair of a large bucket is among them, but the classes are their components.
    """
    smaller_batches(docs.sparkSession, 250)
    with scratch(docs.sparkSession):
        _, nodes, links, _ = linked(keyed_texts(docs, key, text), similarity, bands, rows, small)
        for end in "ab":
            links = links.join(nodes.select(F.col("node").alias(end), F.col("rep.d").alias(f"key_{end}")), end)
        pair = links.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "similarity")
        return stage(pair, "near-links", keep=True)


def nearest_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, via_id, similarity): per node of ``links`` its most similar neighbour, the smallest key on ties."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    keys = nodes.select(F.col("node").alias("b"), F.bitwise_not("rep.d").alias("k"))  # orders like -d and cannot overflow
    best = both.join(keys, "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("similarity", "k")).alias("m"))
    return best.select("node", F.bitwise_not("m.k").alias("via_id"), "m.similarity")


def classes_of(texts: DataFrame, similarity: float, bands: int, rows: int, small: int, proofs: bool = False) -> DataFrame:
    """``near_classes`` of (d, row, text)."""
    found, nodes, links, comps = linked(texts, similarity, bands, rows, small)
    counted = nodes.select("digest", "node", "rep", "copies").join(comps, "node", "left")
    counted = counted.filter("copies > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "node"))
    if proofs:
        counted = counted.join(nearest_links(links, nodes), "node", "left")
    counted = stage(counted, "node-classes")
    classes = stage(counted.groupBy("comp").agg(F.min(F.struct("rep.d", "rep.rid")).alias("best"), F.sum("copies").alias("class_size")), "classes")
    extra = [F.col("rep.d").alias("rep_d"), F.col("rep.rid").alias("rep_rid"), "via_id", "similarity"] if proofs else []
    by_digest = stage(counted.join(classes, "comp").select("digest", "best", "class_size", *extra), "digest-classes")
    out = found.select("d", "row", "rid", "digest").join(by_digest, "digest", "left")
    stands = F.col("rep_rid") == F.col("rid")
    proof = [
        F.when(stands, F.col("via_id")).otherwise(F.col("rep_d")).alias("via_id"),
        F.when(stands, F.col("similarity")).when(F.col("rep_rid").isNotNull(), 1.0).alias("similarity")] if proofs else []
    return stage(out.select(
        "d", "row", F.coalesce("best.d", "d").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"), *proof,
    ), "near-classes", keep=True)


def linked(texts: DataFrame, similarity: float, bands: int, rows: int, small: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketches, the nodes (one per text), the verified links between them and the links' components."""
    found = stage(sketches(texts, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    worded = found.filter("digest IS NOT NULL")
    nodes = worded.groupBy("digest").agg(
        F.min(F.struct("d", "rid", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    each = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = stage(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = stage(each.join(shared, "bucket"), "members")
    mass = stage(members.groupBy("node").agg(F.sum("n").alias("mass")), "mass")
    members = stage(members.join(mass, "node"), "members-mass")

    reps = mass.select("node").join(nodes.select("node", "rep.d", "rep.row"), "node")
    bits = bloom.bits_for(mass.count())
    words = stage(bloom.build(reps, "row", bits), "rep-filter")
    likely = bloom.tested(texts, F.col("row"), words, bits, "maybe").filter("maybe").select("d", "row", "text")
    sets = likely.join(reps, ["d", "row"]).dropDuplicates(["node"]).select("node", "text")
    sets = stage(weighted_sets(sets), "weighted-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("units").alias("units_a"))
        right = sets.select(F.col("node").alias("b"), F.col("units").alias("units_b"))
        both = pairs.join(left, "a").join(right, "b")
        return stage(both.select("a", "b", jaccard(F.col("units_a"), F.col("units_b")).alias("similarity")), "measured")

    enough = F.col("similarity") >= similarity
    measured = verified(candidate_pairs(members, small).distinct())
    comps = components(measured.filter(enough))
    large = large_buckets(members, comps, small)
    late = verified(later_pivots(large).join(measured, ["a", "b"], "left_anti"))
    measured = measured.unionByName(late)
    if not late.filter(enough).isEmpty():
        comps = components(measured.filter(enough))
        large = large_buckets(members, comps, small)
    rest = stray_pairs(stage(large, "main-buckets"), sets, measured, similarity)
    late = verified(rest.join(measured, ["a", "b"], "left_anti"))
    links = measured.unionByName(late).filter(enough)
    if not late.filter(enough).isEmpty():
        comps = components(links)
    return found, nodes, links, comps


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, without all but one row of each near-duplicate class; see ``near_classes``.

    Only documents that may have to go are shuffled.
    """
    with scratch(docs.sparkSession):
        rows = near_classes(docs, key, text, similarity).groupBy("d", "row").agg(
            F.max("kept").alias("one"), F.min("kept").alias("each"))
        rows = rows.filter("NOT each").select(F.col("d").alias("__d__"), F.col("row").alias("__row__"), F.col("one").alias("__one__"))
        going = stage(rows, "going", keep=True)
    bits = bloom.bits_for(going.count())
    words = stage(bloom.build(going, "__row__", bits), "going-filter")
    whole = F.coalesce(named(text), F.lit(""))
    keyed = docs.withColumns({"__d__": F.coalesce(named(key).cast("long"), F.lit(LAST)), "__row__": F.xxhash64(named(key), whole)})
    tested = bloom.tested(keyed, F.col("__row__"), words, bits, "__maybe__")
    met = tested.filter("__maybe__").join(going, ["__d__", "__row__"], "left")
    stay = met.filter("__one__ IS NULL").unionByName(met.filter("__one__").dropDuplicates(["__d__", "__row__"]))
    columns = [named(c) for c in docs.columns]
    return tested.filter("NOT __maybe__").select(*columns).unionByName(stay.select(*columns))
