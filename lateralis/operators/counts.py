"""Counts, modes, recodes, first-of-group, confusion and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frequency(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, the most frequent first; equal counts in the order of the keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def modal_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, n): the most frequent value, the smallest on ties."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))


def first_mode(rows: DataFrame, key: str, value: str, position: Column) -> DataFrame:
    """(key, mode, n): the most frequent value, on ties the one seen first by ``position``."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("at"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "at", F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], null_is_own: list[str] = ()) -> DataFrame:
    """The first row per key. Rows with a null in ``null_is_own`` are each kept (a missing id is not a shared id)."""
    ranked = rows.withColumn("__rank__", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    keep = F.col("__rank__") == 1
    for c in null_is_own:
        keep = keep | F.col(c).isNull()
    return ranked.filter(keep).drop("__rank__")


def rare_to_other(rows: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Values that occur fewer than ``least`` times become ``other``."""
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("__n__"))
    kept = rows.join(n, column, "left")
    return kept.withColumn(column, F.when(F.col("__n__") >= least, F.col(column)).otherwise(other)).drop("__n__")


def drop_singletons(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur once become 0."""
    once = F.count(F.lit(1)).over(W.partitionBy(key)) == 1
    return rows.withColumn(key, F.when(once, F.lit(0)).otherwise(F.col(key)))


def frequent_features(members: DataFrame, feature: str, more_than: int) -> DataFrame:
    """Rows of features that are present more than ``more_than`` times."""
    kept = members.groupBy(feature).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than).select(feature)
    return members.join(kept, feature, "left_semi")


def shannon(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, diversity): minus the sum of p ln p over the kinds within the group."""
    n = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return n.join(total, group).groupBy(group).agg(F.sum(-p * F.log(p)).alias("diversity"))


def confusion(predicted: DataFrame, truth: DataFrame, key: str, item: str, universe: int) -> DataFrame:
    """(key, tp, fp, fn, tn) of two (key, item) tables; tn by subtraction from ``universe``."""
    p = predicted.select(key, item, F.lit(1).alias("p"))
    t = truth.select(key, item, F.lit(1).alias("t"))
    counts = p.join(t, [key, item], "full").groupBy(key).agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    return counts.withColumn("tn", F.lit(universe) - F.col("tp") - F.col("fp") - F.col("fn"))


def rates() -> list[Column]:
    """tpr (0 without positives), ppv, f1 from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("tpr"), F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


def best_match(overlaps: DataFrame, query: str, target: str, n: str = "n_ab") -> DataFrame:
    """Per query the target with the largest overlap, the smallest target on ties."""
    best = F.min(F.struct((-F.col(n)).alias("m"), F.col(target).alias("t"))).alias("b")
    return overlaps.groupBy(query).agg(best).select(query, F.col("b.t").alias(target), (-F.col("b.m")).alias(n))


def rescaled(rows: DataFrame, columns: list[str], constant: float | None = None) -> DataFrame:
    """Each column to [0, 1] by its own minimum and maximum, and ``score``, their sum; constants and nulls become 0.

    With ``constant``, values of a constant column become that (NaN: 0 / 0, as SQL has it) and nulls stay null.
    """
    ends = rows.agg(*[f(c).alias(f"__{n}_{c}__") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    out = rows.crossJoin(F.broadcast(ends))  # one row of minima and maxima
    for c in columns:
        low, high = F.col(f"__low_{c}__"), F.col(f"__high_{c}__")
        share = F.try_divide(F.col(c) - low, high - low)
        fixed = F.when(F.col(c).isNotNull() & (low == high), F.lit(constant)).otherwise(share)
        out = out.withColumn(f"{c}_scaled", F.coalesce(share, F.lit(0.0)) if constant is None else fixed)
    total = sum((F.col(f"{c}_scaled") for c in columns), F.lit(0.0))
    return out.withColumn("score", total).drop(*[f"__{n}_{c}__" for c in columns for n in ("low", "high")])


def patient_status(isolates: DataFrame, patient: str, strain: str, status: str) -> DataFrame:
    """(patient, result) of patients with several isolates, from the statuses HGT, Importation, Unknown.

    More than one HGT in one strain is "Multiple HGT"; any HGT else "Multiple isolates"; else any
    importation "Importation"; else "Undetermined".
    """
    per = isolates.groupBy(patient, strain).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "HGT").alias("hgt"),
        F.count_if(F.col(status) == "Importation").alias("imp"))
    rolled = per.groupBy(patient).agg(F.sum("n").alias("n"), F.max("hgt").alias("most"), F.sum("imp").alias("imp"))
    result = (
        F.when(F.col("most") > 1, "Multiple HGT").when(F.col("most") == 1, "Multiple isolates")
        .when(F.col("imp") > 0, "Importation").otherwise("Undetermined"))
    return rolled.filter("n > 1").select(patient, result.alias("result"))


def points(rows: DataFrame, keys: list[str], base: float = 2.0, least: float = 1.0) -> DataFrame:
    """Counts per cell of a plot and the marker size ``log_base(n) + least``."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("size", F.log(F.col("n").cast("double")) / F.log(F.lit(base)) + least)


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n): counts in [bin, bin + width)."""
    low = (F.floor(F.col(column) / width) * width).cast("double").alias("bin")
    return values.groupBy(low).agg(F.count(F.lit(1)).alias("n"))
