"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees grown on a bounded sample of labelled texts give conjunctive rules, one per path from
the root; an L1-penalised logistic model keeps few of them; what is kept is compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lateralis.llm.shared import named, smaller_batches
from lateralis.llm.wordhash import BLOCK_BYTES, IS_SPACE, blocks, buffers, words_of

#: The most labelled rows that are fitted on, chosen by a hash of their keys.
MAX_LABELLED = 10_000

STATISTICS = [
    "log_words", "word_length", "upper", "digit", "symbol", "bang", "pipe", "stop", "non_ascii",
    "distinct_words", "repeated_word", "distinct_lines", "words_per_line",
]
STATISTICS_TYPE = "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">"

CLASSES = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+<>_{}[]\\/", b"!", b"|", b".,;:?", bytes(range(128, 256)),
), start=1):
    CLASSES[list(_bytes)] = _kind
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True


def distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def statistics_of(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; ratios of nothing are 0."""
    data, offsets = buffers(texts)
    n = len(texts)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 8 + CLASSES[data], minlength=8 * n).reshape(n, 8)
    words, lines = words_of(texts, ~IS_SPACE), words_of(texts, ~NEWLINE)
    text = words.text_of()
    n_words, n_lines = np.diff(words.ptr), np.diff(lines.ptr)
    again = np.zeros(len(text), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    per_char, per_word, per_line = np.maximum(size, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    return np.column_stack([
        np.log1p(n_words),
        np.bincount(text, weights=words.ends - words.starts, minlength=n) / per_word,
        kinds[:, 1] / per_char, kinds[:, 2] / per_char, kinds[:, 3] / per_word, kinds[:, 4] / per_word,
        kinds[:, 5] / per_word, kinds[:, 6] / per_word, kinds[:, 7] / per_char,
        distinct(words.hashes, text, n) / per_word,
        np.bincount(text[again], minlength=n) / per_word,
        distinct(lines.hashes, lines.text_of(), n) / per_line,
        n_words / per_line,
    ])


def statistics(text: Column) -> Column:
    """A struct of STATISTICS for each text; null counts as empty."""

    @arrow_udf(STATISTICS_TYPE)
    def measured(texts: pa.Array) -> pa.Array:
        parts = [np.zeros((0, len(STATISTICS)))]
        for block in blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), size=BLOCK_BYTES):
            parts.append(statistics_of(block.column(0)))
        table = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(table.shape[1])], names=STATISTICS)

    return measured(F.coalesce(text, F.lit("")))


Condition = tuple[int, bool, float]  # statistic, whether it must be over the threshold, threshold


@dataclass
class RuleModel:
    """weights[i] applies where all conditions of rules[i] hold."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The ensemble as one column: the probability of label 1.

        The rules are an array whose values are added up. A sum of hundreds of terms would make one generated
        method beyond Java's limit of 64 KB, and the compiler that finds that out hundreds of MB of the driver.
        """
        parts = []
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, over, threshold in rule:
                value = stats[STATISTICS[j]]
                holds = holds & ((value > threshold) if over else (value <= threshold))
            parts.append(F.when(holds, float(weight)).otherwise(0.0))
        total = F.lit(float(self.intercept))
        if parts:
            total = F.aggregate(F.array(*parts), total, lambda so_far, part: so_far + part)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, over, threshold in rule:
        out &= (x[:, j] > threshold) == over
    return out


def grow(x, y, weight, cuts, binned, rows, depth, features, path, out) -> None:
    """Adds the path to every node below; splits where the weighted Gini impurity falls most."""
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = None
    w, pos = weight[rows], weight[rows] * y[rows]
    for j in features:
        size = len(cuts[j]) + 1
        if size == 1:
            continue
        total = np.bincount(binned[rows, j], weights=w, minlength=size).cumsum()
        ones = np.bincount(binned[rows, j], weights=pos, minlength=size).cumsum()
        n, p, m, q = total[-1], ones[-1], total[:-1], ones[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = q * (m - q) / m + (p - q) * (n - m - p + q) / (n - m)
        cost[~np.isfinite(cost)] = np.inf
        k = int(np.argmin(cost))
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-12):
            best = (cost[k], j, k)
    if best is None:
        return
    _, j, k = best
    for over in (False, True):
        below = rows[(binned[rows, j] > k) == over]
        if len(below) >= 5:
            step = (*path, (int(j), over, float(cuts[j][k])))
            out.setdefault(tuple(sorted(set(step))), None)
            grow(x, y, weight, cuts, binned, below, depth - 1, features, step, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 1) -> list[tuple[Condition, ...]]:
    """The distinct paths of a bagged forest that sees both classes with equal weight."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 41)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    out: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        rows = random.integers(0, len(x), len(x))
        features = random.choice(x.shape[1], max(4, x.shape[1] // 2), replace=False)
        grow(x, y, weight, cuts, binned, rows, depth, features, (), out)
    return list(out)


def lasso(z: np.ndarray, y: np.ndarray, rows: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on the ``rows`` (0 or 1 each) of the 0/1 matrix ``z`` by accelerated proximal
    gradients; the intercept is free. No copy of ``z`` is made."""
    n = rows.sum()
    rate = 4.0 / (float(rows @ z.sum(axis=1, dtype=np.float32)) / n + 1)  # a row's squares add up to its ones
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        wrong = (1 / (1 + np.exp(-(z @ v + c))) - y) * rows
        new = v - rate * (wrong @ z) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * wrong.sum() / n
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = (new + (t - 1) / t_new * (new - w)).astype(np.float32), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> RuleModel:
    """Rules from trees, weights from the lasso; the penalty is the best on a fifth set aside.

    With labels of one class only, or none, the score is the smoothed share of label 1.
    """
    y = y.astype(np.float32)
    rules = tree_rules(x, y, seed=seed) if len(y) and y.min() < y.max() else []
    if not rules:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    z = np.empty((len(y), len(rules)), dtype=np.float32)
    for i, rule in enumerate(rules):
        z[:, i] = holds(x, rule)
    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    learned = (~aside).astype(np.float32)
    share = np.clip(float(y.mean()), 0.01, 0.99)
    w, b, best = np.zeros(z.shape[1], dtype=np.float32), float(np.log(share / (1 - share))), None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w, b = lasso(z, y, learned, penalty, w.astype(np.float32), b)
        p = np.clip(1 / (1 + np.exp(-(z @ w.astype(np.float32) + b)))[aside], 1e-6, 1 - 1e-6)
        loss = -np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)) if aside.any() else 0.0
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = lasso(z, y, np.ones(len(y), np.float32), best[1], np.zeros(z.shape[1], dtype=np.float32), float(np.log(share / (1 - share))), 300)
    kept = np.flatnonzero(w)
    return RuleModel([rules[i] for i in kept], [float(v) for v in w[kept]], float(b))


def held_out(key: Column) -> Column:
    """Keys whose crc32 as text is a multiple of 5 are never learned from; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Fits, in one task, on at most ``max_labelled`` labelled rows, taken by a hash of their keys; null labels are left out.

    A key with several labels is learned with each of them.
    """
    rows = labels.select(named(key).cast("long").alias("k"), named(label).cast("int").alias("y"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    sample = rows.orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled)  # so its broadcast has a bound
    texts = docs.select(named(key).cast("long").alias("k"), named(text).alias("t"))
    found = texts.join(F.broadcast(sample), "k").select("y", statistics(F.col("t")).alias("s")).limit(max_labelled)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches]
        table = np.concatenate([np.zeros((0, 1 + len(STATISTICS))), *rows])
        table = table[np.lexsort(table.T[::-1])]
        model = fit(table[:, 1:], table[:, 0])
        yield pa.RecordBatch.from_pydict({"model": [json.dumps([model.rules, model.weights, model.intercept])]})

    made = found.select(F.col("y").cast("double"), "s.*").repartition(1).mapInArrow(learn, "model string").first()
    if made is None:  # nothing is labelled, and no task ran
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    rules, weights, intercept = json.loads(made.model)
    return RuleModel([tuple((int(j), bool(over), float(at)) for j, over, at in rule) for rule in rules], weights, intercept)


def classify(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3,
             into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with ``into`` added (replacing columns of these names).

    Every text is scored whole, empty and null ones too; repeated rows get equal scores; an empty
    table stays empty.
    """
    smaller_batches(docs.sparkSession)
    inner = "__statistics__"
    scored = docs.withColumn(inner, statistics(named(text)))
    scored = scored.withColumn(into[0], model.score(F.col(inner))).drop(inner)
    return scored.withColumn(into[1], (named(into[0]) >= threshold).cast("int"))
