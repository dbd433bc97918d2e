"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Two levels of restaurants: one per context (the word before, by 16 bits of its hash: frequent words
hardly share one, rare ones do) and, as their common parent, the restaurant of words without context, over a uniform base of all training
words and one unknown word. In a context's restaurant each (context, word) cell seats its training
occurrences; every table sends one customer to the parent. The first seating follows the process;
then come Gibbs sweeps: given the parent's predictive probabilities and the tables per context of the
last sweep, all cells draw their numbers of tables from the posterior, weights S_d(n, t) * pull ** t
with generalised Stirling numbers, whatever n is; then the parent its own. All cells draw at once, so
a cell sees the others as they were a sweep ago. Predictive probabilities are averaged over the sweeps
after the first.

How it runs: texts become blocks of about two million tokens, each with its distinct cells and, per
token, the number of its cell. Only the cells are shuffled, packed, to buckets by word hash, so that
all of a word's contexts meet. They are added up as a tree: at most some FAN blocks meet in one group,
their sums meet in the next level. A word has at most CONTEXTS distinct cells, so however frequent it is
a group takes some FAN times that of it, 16 million for the most frequent. A sweep is a map over the buckets of the last level and writes
them again with the tables drawn; a later sweep starts from these. What buckets share are the numbers of
customers and tables per context, at most 65,536 sums of each whatever the corpus. At the end the
levels are gone down again: each block gets one probability per distinct cell back and adds up its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import discard, documents_of, scratch, smaller_batches, stage
from lateralis.llm.wordhash import IS_SPACE, blocks, words_of

BLOCK_TOKENS, BUCKET_CELLS, LEAST_BUCKETS, FAN, CONTEXTS = 2_000_000, 1_000_000, 64, 256, 1 << 16
#: The token after a text's last word.
END = np.uint64(0x0123456789ABCDEF)
EXACT = 64  # customers seated one by one before larger steps

TEXT_COLUMNS = ["block", "doc_ids", "held", "ptr", "tokens", "words_of_cells", "n_cells"]
BLOCK_TYPE = (
    "block string, doc_ids array<long>, held array<boolean>, ptr binary, tokens binary, words_of_cells binary, "
    "words binary, cells binary, n binary, n_words long, n_cells long"
)
SLICE_TYPE = "bucket long, node string, words binary, cells binary, n binary, n_words long, n_cells long"
MERGED_TYPE = SLICE_TYPE + ", from_node array<string>, from_words array<long>, from_cells array<long>, word_of binary, cell_of binary"
SWEPT = ["bucket", "node", "cells", "n", "n_words", "n_cells", "from_node", "from_words", "from_cells", "word_of", "cell_of"]
SWEPT_TYPE = (
    "bucket long, node string, cells binary, n binary, n_words long, n_cells long, from_node array<string>, from_words array<long>, "
    "from_cells array<long>, word_of binary, cell_of binary, tables array<binary>, above array<binary>"
)
SUM_TYPE = "name string, k int, value double"
BACK_TYPE = "node string, bucket long, n_words long, seen binary, score binary"
RESULT_TYPE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def squeeze(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Integers, by byte planes and compressed."""
    values = np.asarray(values).astype(kind)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return pa.Codec("zstd").compress(planes, asbytes=True) if planes else b""


def unsqueeze(packed: bytes, n: int, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(packed, width * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def packed_cells(words: np.ndarray, cells: np.ndarray, n: np.ndarray) -> tuple:
    """words, cells, n, n_words, n_cells of a row: ``words`` ascend, ``cells`` are word number * CONTEXTS + context and ascend."""
    return (
        squeeze(np.diff(words, prepend=np.uint64(0)), "<u8"), squeeze(np.diff(cells, prepend=0)), squeeze(n, "<i8"), len(words), len(cells))


def words_in(r: dict) -> np.ndarray:
    return np.cumsum(unsqueeze(r["words"], r["n_words"], "<u8"), dtype=np.uint64)


def codes_in(r: dict) -> np.ndarray:
    return np.cumsum(unsqueeze(r["cells"], r["n_cells"]), dtype=np.int64)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value in them; hashed, so only distinct ones are sorted."""
    found = pa.array(values).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[found.indices.to_numpy()]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each is megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


SLICE_NAMES = ["bucket", "node", "words", "cells", "n", "n_words", "n_cells"]
SLICE_ARROW = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
FROM_NAMES = ["from_node", "from_words", "from_cells", "word_of", "cell_of"]
FROM_ARROW = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
BACK_NAMES, BACK_ARROW = ["node", "bucket", "n_words", "seen", "score"], [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with the end after each text, the context of each, tokens per text."""
    words = words_of(texts, ~IS_SPACE)
    tokens = np.insert(words.hashes, words.ptr[1:], END)
    context = np.append(END, tokens)[:len(tokens)] % np.uint64(CONTEXTS)
    return tokens, context.astype(np.uint16), np.diff(words.ptr) + 1


def corpus_blocks(docs: DataFrame, at_once: int = BLOCK_TOKENS) -> DataFrame:
    """``BLOCK_TYPE``: the texts as blocks. ``docs`` has doc_id, text, held. Words ascend by hash, contexts within."""

    def row(block: str, held: list) -> pa.RecordBatch:
        ids, out, hashes, context, sizes = zip(*held, strict=True)
        ids, out = pa.concat_arrays(ids), pa.concat_arrays(out)
        hashes, context, sizes = np.concatenate(hashes), np.concatenate(context), np.concatenate(sizes)
        words, word = ranked(hashes)
        cells, token = np.unique(word * CONTEXTS + context, return_inverse=True)
        train = np.repeat(~np.asarray(out.to_numpy(zero_copy_only=False), dtype=bool), sizes)
        n = np.bincount(token, weights=train, minlength=len(cells)).astype(np.int64)
        return table(
            [(block, ids.to_pylist(), out.to_pylist(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes(),
              squeeze(token), squeeze(np.diff(cells // CONTEXTS, prepend=0)), *packed_cells(words, cells, n))],
            [*TEXT_COLUMNS[:-1], *SLICE_NAMES[2:]],
            [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 3, *SLICE_ARROW[2:]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in blocks(batches):
            tokens, context, sizes = tokens_of(batch.column(1))
            held.append((batch.column(0), batch.column(2), tokens, context, sizes))
            size += len(tokens)
            if size >= at_once:
                yield row(f"{part}-{made}", held)
                made, held, size = made + 1, [], 0
        if held:
            yield row(f"{part}-{made}", held)

    return docs.mapInArrow(build, BLOCK_TYPE)


def to_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """``SLICE_TYPE``: each block's cells, cut by the first ``bits`` bits of the word hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                words, cells, n = words_in(r), codes_in(r), unsqueeze(r["n"], r["n_cells"], "<i8")
                bucket = (words >> np.uint64(64 - bits)).astype(np.int64)
                edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(words))
                first = np.searchsorted(cells, edge * CONTEXTS)
                out = []
                for a, b, x, y in zip(edge[:-1], edge[1:], first[:-1], first[1:], strict=True):
                    out.append((int(bucket[a]), r["block"], *packed_cells(words[a:b], cells[x:y] - a * CONTEXTS, n[x:y])))
                yield table(out, SLICE_NAMES, SLICE_ARROW)

    return rows.select("block", "words", "cells", "n", "n_words", "n_cells").mapInArrow(cut, SLICE_TYPE)


def merged(slices: DataFrame, groups: int) -> DataFrame:
    """``MERGED_TYPE``: per bucket and group of nodes the sums, and where each node's words and cells are in them."""

    def merge(group: pa.Table) -> pa.Table:
        rows = group.sort_by("node").to_pylist()
        words = [words_in(r) for r in rows]
        distinct, word_of = ranked(np.concatenate(words))
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        codes = []
        for r, a in zip(rows, at[:-1], strict=True):
            own = codes_in(r)
            codes.append(word_of[a + own // CONTEXTS] * CONTEXTS + own % CONTEXTS)
        cells, cell_of = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.concatenate([unsqueeze(r["n"], r["n_cells"], "<i8") for r in rows])
        n = np.bincount(cell_of, weights=n, minlength=len(cells)).astype(np.int64)
        row = (rows[0]["bucket"], str(rows[0]["parent"]), *packed_cells(distinct, cells, n), [r["node"] for r in rows],
               [r["n_words"] for r in rows], [r["n_cells"] for r in rows], squeeze(np.diff(word_of, prepend=0)), squeeze(np.diff(cell_of, prepend=0)))
        return pa.Table.from_batches([table([row], SLICE_NAMES + FROM_NAMES, SLICE_ARROW + FROM_ARROW)])

    parent = F.pmod(F.xxhash64("node"), F.lit(groups))
    return slices.withColumn("parent", parent).groupBy("bucket", "parent").applyInArrow(merge, MERGED_TYPE)


def levels_of(slices: DataFrame, nodes: int, fan: int) -> list[DataFrame]:
    """Sums by levels, each staged; the last has one row per bucket."""
    levels = []
    while True:
        groups = 1 if nodes <= fan else ceil(nodes / fan)
        slices = merged(slices, groups)
        slices = stage(slices if groups > 1 else slices.select(*SWEPT), "lm-level", keep=True)
        levels.append(slices)
        if groups == 1:
            return levels
        slices, nodes = slices.select(*SLICE_NAMES), groups


def seat(n: np.ndarray, base: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of n customers each, drawn from the Chinese-restaurant process: a customer opens a table with
    a probability of ``weight * base`` over that plus what sits minus a discount per table.

    The first EXACT customers sit down one by one; from then on a sixteenth of those that sit come at
    once, with the probability of the first of them.
    """
    tables = (n > 0).astype(np.int64)
    pull = weight * base
    at, i = np.flatnonzero(n > 1), 1
    while len(at):
        step = 1 if i < EXACT else i // 16
        p = pull[at] / (i - discount * tables[at] + pull[at])
        come = np.minimum(n[at] - i, step)
        tables[at] += (random.random(len(at)) < p) if step == 1 else random.binomial(come, np.minimum(p, 1))
        i += step
        at = at[n[at] > i]
    return tables


def stirling_sum(n: int, most: int, d: float) -> np.ndarray | None:
    """log S_d(n, t) for t from 1 to ``most`` by the alternating sum; None where doubles cannot hold it."""
    t, j = np.arange(1, most + 1), np.arange(1, min(most, 200) + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(t))])
    x = d * j
    gammas = np.array([lgamma(n - v) - lgamma(n) + lgamma(1 + v) for v in x])
    out = np.empty(most)
    for a in range(0, most, 2000):
        u = t[a:a + 2000]
        rest = u[:, None] - j
        size = log_factorial[u][:, None] - log_factorial[j] - log_factorial[np.maximum(rest, 0)] + gammas
        size[rest < 0] = -np.inf
        top = size.max(axis=1)
        terms = np.exp(size - top[:, None]) * np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * x) / np.pi
        total = terms.sum(axis=1)
        cut = (u > j[-1]) & (np.exp(size[:, -1] - top) > 1e-9 * np.abs(total))
        if np.any(total < 1e-6) or np.any(cut):
            return None
        out[a:a + 2000] = top + np.log(total)
    return out + lgamma(n) - t * np.log(d) - log_factorial[1:]


def stirling_rows(sizes: np.ndarray, need: np.ndarray, d: float, direct: int = 1000) -> Iterator[np.ndarray]:
    """log S_d(n, t) for t from 1 to need[k], for each n of the ascending ``sizes``: by
    S(n + 1, t) = S(n, t - 1) + (n - d * t) * S(n, t), and from ``direct`` on by the sum where that is exact enough."""
    later = np.maximum.accumulate(need[::-1])[::-1]
    row, at = np.zeros(1), 1
    for size, most, limit in zip(sizes.tolist(), need.tolist(), later.tolist(), strict=True):
        found = stirling_sum(size, most, d) if size > direct else None
        while found is None and at < size:
            last = row[:limit]
            row = np.append(last, -np.inf)[:limit]
            row[:len(last)] += np.log(at - d * np.arange(1, len(last) + 1))
            row[1:] = np.logaddexp(row[1:], last[:len(row) - 1])
            at += 1
        yield row[:most] if found is None else found


def reseat(n: np.ndarray, pull: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of n customers each given all else: t with weights S_d(n, t) * pull ** t.

    More than one table are no more than a Poisson number of mean pull / d, so weights end ten deviations above.
    """
    tables = (n > 0).astype(np.int64)
    at = np.flatnonzero(n > 1)
    at = at[np.argsort(n[at], kind="stable")]
    if not len(at):
        return tables
    sizes, first, count = np.unique(n[at], return_index=True, return_counts=True)
    mean = pull[at] / discount
    most = np.minimum(n[at], np.ceil(31 + mean + 10 * np.sqrt(mean)).astype(np.int64))
    for row, a, m in zip(stirling_rows(sizes, np.maximum.reduceat(most, first), discount), first, count, strict=True):
        step = max(1, 1_000_000 // len(row))
        for i in range(a, a + m, step):
            own = at[i:min(i + step, a + m)]
            weight = row + np.log(pull[own])[:, None] * np.arange(1, len(row) + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (weight < random.random(len(own))[:, None] * weight[:, -1:]).sum(axis=1)
    return tables


@dataclass
class Model:
    """Sums over the corpus, and per sweep the tables per context and in the parent."""

    tokens: float
    types: float
    customers: np.ndarray
    discount: float
    parent_discount: float
    strength: float
    seed: int
    sweeps: list[tuple[np.ndarray, float]]

    def step(self, bucket: int, word: np.ndarray, n_words: int, context: np.ndarray, n: np.ndarray, before: tuple | None):
        """One more sweep: tables of the cells, customers and tables of the words. ``before`` is the last one's (customers,
        tables) of the words.

        Draws depend on seed, bucket, sweep and ``before`` alone, so a lost task is repeated exactly.
        """
        s = len(self.sweeps)
        random = np.random.default_rng([self.seed, bucket, s])
        if before is None:
            seen = np.bincount(word, weights=n, minlength=n_words)
            parent = (seen + 0.5) / (self.tokens + 0.5 * (self.types + 1))
            opened, parent_tables = self.customers ** self.discount, self.types
        else:
            opened, parent_tables = self.sweeps[-1]
            parent = self.parent(*before, opened.sum(), parent_tables)
        weight = (self.strength + self.discount * opened)[context]
        rest = np.full(n_words, (self.strength + self.parent_discount * parent_tables) / (self.types + 1))
        if before is None:
            tables = seat(n, parent[word], weight, self.discount, random)
        else:
            tables = reseat(n, weight * parent[word], self.discount, random)
        u = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
        if before is None:
            t = seat(u, np.ones(n_words), rest, self.parent_discount, random)
        else:
            t = reseat(u, rest, self.parent_discount, random)
        return tables, u, t

    def parent(self, u, t, sat: float, parent_tables: float) -> np.ndarray:
        rest = (self.strength + self.parent_discount * parent_tables) / (self.types + 1)
        return (u - self.parent_discount * t + rest) / (self.strength + sat)

    def predictive(self, s: int, word, context, n, tables, u, t) -> np.ndarray:
        """Probability of each cell's word in its context after sweep s."""
        opened, parent_tables = self.sweeps[s]
        back = self.parent(u, t, opened.sum(), parent_tables)[word]
        rest = self.strength + self.discount * opened[context]
        return (n - self.discount * tables + rest * back) / (self.strength + self.customers[context])


def cells_of(r: dict) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Word number and context of each cell, number of words, training occurrences."""
    codes = codes_in(r)
    return codes // CONTEXTS, r["n_words"], codes % CONTEXTS, unsqueeze(r["n"], r["n_cells"], "<i8")


def drawn(r: dict, s: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the cells, customers and tables of the words that sweep ``s`` has left."""
    tables = unsqueeze(r["tables"][s], r["n_cells"], "<i8")
    u = np.bincount(word, weights=tables, minlength=r["n_words"]).astype(np.int64)
    return tables, u, unsqueeze(r["above"][s], r["n_words"], "<i8")


def summed(buckets: DataFrame, columns: list[str], measure) -> dict[str, np.ndarray]:
    """Adds up what ``measure`` gives per bucket: by name, up to CONTEXTS numbers. At most CONTEXTS + 5 rows come back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in rows_of(batch):
                for name, values in measure(r).items():
                    total[name] = total.get(name, 0) + np.asarray(values, dtype=float)
        for name, values in total.items():
            k = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(values[k])], ["name", "k", "value"])

    found: dict[str, np.ndarray] = {}
    own = buckets.select(*columns).mapInArrow(each, SUM_TYPE)
    sums = own.groupBy("name", "k").agg(F.sum("value").alias("value")).toArrow()
    for name in sums["name"].unique().to_pylist():
        one = sums.filter(pc.equal(sums["name"], name))
        found[name] = np.zeros(CONTEXTS)
        found[name][one["k"].to_numpy()] = one["value"].to_numpy()
    return found


def corpus_sums(r: dict) -> dict[str, np.ndarray]:
    word, n_words, context, n = cells_of(r)
    seen = np.bincount(word, weights=n, minlength=n_words)
    contexts = np.bincount(word, weights=n > 0, minlength=n_words)
    return {
        "customers": np.bincount(context, weights=n, minlength=CONTEXTS), "types": [np.sum(seen > 0)],
        "ones": [np.sum(n == 1), np.sum(contexts == 1)], "twos": [np.sum(n == 2), np.sum(contexts == 2)],
    }


def swept(buckets: DataFrame, model: Model) -> DataFrame:
    """``SWEPT_TYPE``: the buckets with the tables of one more sweep."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                word, n_words, context, n = cells_of(r)
                before = drawn(r, -1, word)[1:] if r["tables"] else None
                tables, _, t = model.step(r["bucket"], word, n_words, context, n, before)
                r["tables"].append(squeeze(tables, "<i8"))
                r["above"].append(squeeze(t, "<i8"))
                yield pa.RecordBatch.from_pylist([r], batch.schema)

    return buckets.mapInArrow(sweep, SWEPT_TYPE)


def fit(buckets: DataFrame, sweeps: int, strength: float, seed: int) -> tuple[DataFrame, Model]:
    """Discounts from the numbers of cells and words seen once and twice; then ``sweeps`` Gibbs sweeps.

    Returns the buckets with the tables of all sweeps, staged. Each sweep writes them again and removes the ones before.
    """
    own = ["bucket", "cells", "n", "n_words", "n_cells"]
    s = summed(buckets, own, corpus_sums)
    none = np.zeros(CONTEXTS)
    ones, twos = s.get("ones", none), s.get("twos", none)
    d, p = (float(np.clip(ones[i] / max(ones[i] + 2 * twos[i], 1), 0.05, 0.95)) for i in range(2))
    customers = s.get("customers", none)
    model = Model(float(customers.sum()), float(s.get("types", none)[0]), customers, d, p, strength, seed, [])
    empty = F.array().cast("array<binary>")
    buckets = buckets.select(*SWEPT, empty.alias("tables"), empty.alias("above"))

    def tables(r: dict) -> dict[str, np.ndarray]:
        word, _, context, _ = cells_of(r)
        t, _, above = drawn(r, -1, word)
        return {"opened": np.bincount(context, weights=t, minlength=CONTEXTS), "parent": [above.sum()]}

    for i in range(sweeps):
        last, buckets = buckets, stage(swept(buckets, model), "lm-sweep")
        if i:
            discard(last)
        s = summed(buckets, [*own, "tables", "above"], tables)
        model.sweeps.append((s.get("opened", none), float(s.get("parent", none)[0])))
    return buckets, model


def handed_down(r: dict, seen: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """The counts of words and the values of cells of a merged row, for each of the nodes it was made of."""
    word_of = np.cumsum(unsqueeze(r["word_of"], sum(r["from_words"])), dtype=np.int64)
    cell_of = np.cumsum(unsqueeze(r["cell_of"], sum(r["from_cells"])), dtype=np.int64)
    a = b = 0
    out = []
    for node, x, y in zip(r["from_node"], r["from_words"], r["from_cells"], strict=True):
        out.append((node, r["bucket"], x, squeeze(seen[word_of[a:a + x]], "<i8"), value[cell_of[b:b + y]].tobytes()))
        a, b = a + x, b + y
    return table(out, BACK_NAMES, BACK_ARROW)


def scored_cells(buckets: DataFrame, model: Model, burn: int) -> DataFrame:
    """``BACK_TYPE``: to each node below, training counts of its words and log10 averaged probabilities of its cells."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                word, n_words, context, n = cells_of(r)
                seen = np.bincount(word, weights=n, minlength=n_words).astype(np.int64)
                total = np.zeros(len(n))
                for s in range(burn, len(model.sweeps)):
                    total += model.predictive(s, word, context, n, *drawn(r, s, word))
                yield handed_down(r, seen, np.log10(total / (len(model.sweeps) - burn)).astype(np.float32))

    return buckets.mapInArrow(score, BACK_TYPE)


def down(back: DataFrame, level: DataFrame) -> DataFrame:
    """``BACK_TYPE`` of the nodes below ``level``, from that of its own."""

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                yield handed_down(r, unsqueeze(r["seen"], r["n_words"], "<i8"), np.frombuffer(r["score"], np.float32))

    rows = level.select("bucket", "node", *FROM_NAMES).join(back, ["bucket", "node"])
    return rows.select("bucket", "n_words", "seen", "score", *FROM_NAMES).mapInArrow(hand, BACK_TYPE)


def scored_texts(rows: DataFrame, back: DataFrame, model: Model) -> DataFrame:
    """``RESULT_TYPE``: each block's texts added up."""
    tokens, types = model.tokens, model.types

    def add(block: pa.Table, cells: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        cells = cells.sort_by("bucket").to_pydict()
        seen = np.concatenate([unsqueeze(x, k, "<i8") for x, k in zip(cells["seen"], cells["n_words"], strict=True)])
        score = np.concatenate([np.frombuffer(x, np.float32) for x in cells["score"]]).astype(float)
        ptr = np.frombuffer(r["ptr"], np.int64)
        token = unsqueeze(r["tokens"], int(ptr[-1]))
        word = np.cumsum(unsqueeze(r["words_of_cells"], r["n_cells"]), dtype=np.int64)[token]
        base = np.log10((seen + 0.5) / (tokens + 0.5 * (types + 1)))
        n = np.diff(ptr)
        return pa.Table.from_pydict({
            "doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": n,
            "n_known": np.add.reduceat((seen > 0)[word].astype(np.int64), ptr[:-1]),
            "train_tokens": np.full(len(n), int(tokens)), "base_score": np.add.reduceat(base[word], ptr[:-1]),
            "score": np.add.reduceat(score[token], ptr[:-1]),
        })

    return rows.groupBy("block").cogroup(back.groupBy("node")).applyInArrow(add, RESULT_TYPE)


def score(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sweeps: int = 4,
    burn: int = 1,
    strength: float = 10.0,
    seed: int = 5,
    at_once: int = BLOCK_TOKENS,
    fan: int = FAN,
) -> DataFrame:
    """One row per document, ``RESULT_TYPE``: held_out, token counts, base and model log10 probability of the text.

    Tokens are runs of other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, then one end. Documents whose
    crc32 of the key as text is 1 modulo 5 are scored but not learned from; a null key is learned
    from. A null or empty text has just its end. Perplexity per token is 10 ** (-score / n_tokens).
    Repeated documents count and are scored each; an empty table gives no rows.
    """
    smaller_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    spark = docs.sparkSession
    with scratch(spark):
        with scratch(spark):
            rows = stage(corpus_blocks(documents_of(docs, key, text).withColumn("held", held), at_once), "lm-blocks")
            texts = stage(rows.select(*TEXT_COLUMNS), "lm-texts", keep=True)
            n_blocks, cells = rows.agg(F.count(F.lit(1)), F.sum("n_cells")).first()
            bits = max(LEAST_BUCKETS, (cells or 0) // BUCKET_CELLS).bit_length()
            levels = levels_of(to_buckets(rows, bits), n_blocks, fan)
        buckets, model = fit(levels[-1], sweeps, strength, seed)
        back = scored_cells(buckets, model, burn)
        for level in reversed(levels[:-1]):
            back = down(back, level)
        return stage(scored_texts(texts, back, model), "lm-scores", keep=True)
