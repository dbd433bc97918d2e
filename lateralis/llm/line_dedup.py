"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words. Two lines are the same when their words are, and near when few words
inserted, deleted or replaced turn one into the other: one, and if asked one more for each
``per_edit`` words of the shorter line. A line goes when an earlier line of the corpus is the same or
near; the earliest stays.

One edit: each line emits, as hashed keys, itself and all its variants with one word deleted, with the
place of that word. Two lines are within one edit just when one equals a variant of the other, or both
lose the word at the same place and are then equal. So of equal keys the earliest line settles all
others, and no pairs arise. Only lines that share an unchanged half with another line can have such a
partner; only those emit variants. Keys of variants are 128 bits, so equal keys are equal variants and
their places prove the edit distance.

More edits: of two lines of m words or more within k edits, (m - k) / (k + 1) words stand together
unchanged in both. So of each window of that many words each line sends the key of one short run of
words, the one with the least hash. Lines with such a key in common, alike in length and in a bit map
of their words (k edits change at most 2k bits), are verified word by word: first each with the
earliest of its partners, then those that this does not settle with the others.

How it runs: keys are combined in the task that makes them (per key and line only the earliest place
goes on, and what it settles is settled), so a key that all documents share is a row per task. Keys of
lines are dealt packed, by ranges that grow in number with the documents, and a task reads some ranges at
a time; variants are dealt by key, sorted, and read in batches with one row carried over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lateralis.llm import bloom
from lateralis.llm.shared import discard, named, release, scratch, smaller_batches, stage
from lateralis.llm.wordhash import BASE, LOWER, PLACE, Words, blocks, buffers, mix, powers, runs, words_of

SECOND = np.uint64(0x9E6C63D0876A9A47)
#: Rows of keys that a task combines at once.
COMBINED_ROWS = 400_000
#: Rows of sorted keys that are read at once.
READ_ROWS = 50_000
#: Documents, on average, whose keys of lines are one range, and the fewest ranges.
RANGE_DOCUMENTS, LEAST_RANGES = 4096, 1024
VARIANT_TYPE = "key long, other long, place int, d long, row long, line int"
RUN_TYPE = (
    "d long, row long, line int, n int, words string, b0 long, b1 long, b2 long, b3 long, "
    "keys array<long>"
)
#: Kinds of keys: a whole line, a half of one, a run of words; from DONE on, results on their way.
WHOLE, HALF, RUN, DONE = 0, 1, 2, 16
#: Places of variants: nothing lost, or a result on its way.
NOTHING, SETTLED = -1, -2
LAST = (1 << 63) - 1


def document_key(key: Column, text: Column) -> Column:
    """Rows with equal key and text are one document here; ``line_dedup`` then keeps the lines of one of them."""
    return F.xxhash64(key, text)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``__d__``, the key with nulls last, and ``__row__``, which tells the documents of one key apart: 0 where a filter
    says that no other row has the key, so that most rows of keys and variants are shuffled without it."""
    d = F.coalesce(named(key).cast("long"), F.lit(LAST))
    many = stage(docs.select(d.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d"), "repeated-keys")
    bits = bloom.bits_for(many.count())
    words = stage(bloom.build(many, "d", bits), "repeated-filter")
    tested = bloom.tested(docs.withColumn("__d__", d), F.col("__d__"), words, bits, "__many__")
    row = F.when(F.col("__many__"), document_key(named(key), F.coalesce(named(text), F.lit("")))).otherwise(F.lit(0))
    return tested.withColumn("__row__", row.cast("long")).select("__d__", "__row__", *[named(c) for c in docs.columns])


class Sums:
    """Hashes of any runs of a word sequence in constant time each."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h))
        self.total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * up[:len(h)], out=self.total[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def lines_of(texts: pa.Array):
    """Word hashes, and of each line with words: its text, number, first word, end word."""
    data, offsets = buffers(texts)
    words = words_of(texts)
    newline = data == 10
    starts, _, ptr = runs(~newline, offsets)
    before = np.concatenate([[0], np.cumsum(newline)])
    text = np.repeat(np.arange(len(texts)), np.diff(ptr))
    number = before[starts] - before[offsets[text]]
    first = np.searchsorted(words.starts, starts)
    last = np.append(first[1:], len(words.starts))
    full = last > first
    return words.hashes, text[full], number[full], first[full], last[full]


def half_keys(sums: Sums, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Four keys per line: first and second half of the line as the shorter of a pair, and as the longer."""
    n = last - first
    out = []
    for base in (n, n - 1):
        h = base // 2
        salt = base.astype(np.uint64) * np.uint64(4)
        out.append(mix(sums.run(first, first + h) ^ mix(salt)))
        out.append(mix(sums.run(last - (base - h), last) ^ mix(salt + np.uint64(1))))
    return np.column_stack(out)


def of_lines(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of the lines one after another, and the line of each."""
    n = last - first
    line = np.repeat(np.arange(len(n)), n)
    return h[first[line] + np.arange(len(line)) - (np.cumsum(n) - n)[line]], line


#: Of how many words the hashed runs are, by the words that two lines have unchanged in one run at least.
RUNS = {1: 1, 2: 2, 3: 3, 5: 4, 12: 5}


def run_lengths(most: int, per_edit: int) -> np.ndarray:
    """By the length of the shorter line, the words that are unchanged in one run: of m words and k edits (m - k) / (k + 1)
    stand together, or more; never more than longer lines have."""
    m = np.arange(most + 2 * per_edit + 2)
    k = 1 + m // per_edit
    return np.minimum.accumulate((-(k - m) // (k + 1) + ((m - k) % (k + 1) > 0))[::-1])[::-1][:most + 1]


def run_keys(h: np.ndarray, first: np.ndarray, last: np.ndarray, per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the line of each: of all runs of a few words that start in a window, the one of the least hash. Lines that have a
    window's words in common have its key in common. The least of a window is the least of the smaller windows around it,
    so of all windows that partners of a line ask for, the smallest of each length of runs gives the keys of the others too."""
    n = last - first
    table = run_lengths(int(n.max(initial=0)), per_edit)
    own = table[n]
    shortest = table[np.maximum((n - 2) * per_edit // (per_edit + 1) - 1, 0)]
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for (least, size), beyond in zip(RUNS.items(), [*list(RUNS)[1:], LAST], strict=True):
        asked = np.where((own >= least) & (shortest < beyond), np.maximum(shortest, least) - size + 1, 0)
        if not asked.any():
            continue
        value = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for j in range(size):
            value += h[j:len(value) + j] * PLACE[j]
        value = low = mix(value + np.uint64(size))
        for width in range(1, int(asked.max()) + 1):  # ``low``: the least of so many runs
            low = np.minimum(low[:-1], value[width - 1:]) if width > 1 else value
            at = np.flatnonzero(asked == width)
            each = n[at] - (width + size - 2)
            line = np.repeat(np.arange(len(at)), each)
            key = low[first[at][line] + np.arange(len(line)) - (np.cumsum(each) - each)[line]]
            new = starts_of(key, line)
            keys.append(key[new])
            owners.append(at[line[new]])
    return np.concatenate(keys), np.concatenate(owners)


def bit_maps(word: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """256 bits per line, four columns: one bit for each distinct word."""
    out = np.zeros((n, 256), dtype=np.uint8)
    out[line, (mix(word) >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.int64)


Rows = list[np.ndarray]  # the columns of a table


def before(rows: Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the line of row a comes before that of row b; the last three columns are d, row, line."""
    d, r, k = (c for c in rows[-3:])
    return (d[a] < d[b]) | ((d[a] == d[b]) & ((r[a] < r[b]) | ((r[a] == r[b]) & (k[a] < k[b]))))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def last_true(marks: np.ndarray) -> np.ndarray:
    """For each row, the last marked one up to it; the first row counts as marked."""
    at = np.where(marks, np.arange(len(marks)), 0)
    return np.maximum.accumulate(at)


def met_keys(rows: Rows) -> tuple[Rows, Rows]:
    """Of rows sorted by ``KEY_ORDER``: what can be said already, and the earliest row per key and line.

    A whole line that is not the earliest is said to be DONE + WHOLE; the earliest place of each line that
    has a half or run in common with another line DONE + HALF or DONE + RUN.
    """
    key, kind, other = rows[:3]
    group, line = starts_of(key, kind), starts_of(key, kind, other)
    number = np.cumsum(group) - 1
    several = np.bincount(number, weights=line) > 1
    repeat = (kind == WHOLE) & before(rows, last_true(line), np.arange(len(key)))
    told = np.flatnonzero(repeat | ((kind != WHOLE) & line & several[number]))
    said, kept = [c[told] for c in rows], np.flatnonzero(line)
    said[1] = said[1] + DONE
    return said, [c[kept] for c in rows]


def met_variants(rows: Rows) -> tuple[Rows, Rows]:
    """Of variants sorted by ``VARIANT_ORDER``: settled lines, and the earliest per variant and place. Settled is who
    comes after a line that is the variant, or is it and comes after one that has it, or after one that lost that place."""
    key, other, place = rows[:3]
    same, every = starts_of(key, other, place), np.arange(len(key))
    head = last_true(starts_of(key, other))
    longer = (place[head] == NOTHING) & (place > NOTHING)
    late = before(rows, last_true(same), every) | (longer & before(rows, head, every))
    late[head[longer & before(rows, every, head)]] = True
    said, kept = [c[late] for c in rows], np.flatnonzero(same)
    said[2] = np.full(len(said[2]), SETTLED, dtype=np.int32)
    return said, [c[kept] for c in rows]


KEY_ORDER = ["key", "kind", "other", "d", "row", "line"]
#: How the columns of keys are packed: as what, and cut into parts of what, so that parts that are mostly equal stand together.
PACKED = {"key": ("<i8", "<u2"), "kind": ("u1", "u1"), "other": ("<i8", "<u2"), "d": ("<i8", "<u2"), "row": ("<i8", "<u2"), "line": ("<i4", "u1")}
PACKED_NAMES = [f"{c}{i}" for c, (whole, part) in PACKED.items() for i in range(np.dtype(whole).itemsize // np.dtype(part).itemsize)]
PACKED_TYPE = ", ".join(["at int", *[f"{c} binary" for c in PACKED_NAMES]])
VARIANT_ORDER = ["key", "other", "place", "d", "row", "line"]


def as_batch(rows: Rows, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)


def packed(rows: Rows, bits: int) -> pa.RecordBatch:
    """Rows of keys that are sorted by key as one row for each range: the first ``bits`` bits of the key, and the columns in parts."""
    at = rows[0] >> (64 - bits)
    first = np.flatnonzero(starts_of(at))
    bounds = np.append(first, len(at))
    columns = [pa.array(at[first].astype(np.int32))]
    for column, (whole, part) in zip(rows, PACKED.values(), strict=True):
        parts = np.ascontiguousarray(column.astype(whole)).view(part).reshape(len(at), -1)
        offsets = pa.py_buffer((bounds * parts.itemsize).astype(np.int32))
        columns += [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]) for x in parts.T]
    return pa.RecordBatch.from_arrays(columns, ["at", *PACKED_NAMES])


def unpacked(table: pa.Table) -> Rows:
    """The rows of keys of ``packed`` ones."""
    parts = {}
    for name in PACKED_NAMES:
        column = pa.concat_arrays(table.column(name).chunks).cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[[column.offset, column.offset + len(column)]]
        parts[name] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[1]]
    out = []
    for c, (whole, part) in PACKED.items():
        found = [parts[name].view(part) for name in PACKED_NAMES if name.rstrip("0123456789") == c]
        out.append(np.column_stack(found).view(whole).ravel())
    out[1] = out[1].astype(np.int32)
    return out


def whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The rows of keys of ``packed`` ones that are sorted by range, of some whole ranges at a time, in order of all columns."""
    held, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
        size += np.asarray(pc.binary_length(batch.column(2))).sum() // 2
        at = held.column("at").to_numpy()
        if size >= COMBINED_ROWS and at[0] != at[-1]:
            last = int(np.searchsorted(at, at[-1]))  # more of this range may come
            rows, held = unpacked(held.slice(0, last)), held.slice(last)
            size -= len(rows[0])
            yield [c[order] for order in [order_of(rows)] for c in rows]
    if held is not None:
        rows = unpacked(held)
        yield [c[order] for order in [order_of(rows)] for c in rows]


def order_of(rows: Rows) -> np.ndarray:
    """The order of the rows by all their columns; most differ in the first, only the others are compared further."""
    at = np.argsort(rows[0])
    tied = ~starts_of(rows[0][at])
    tied[:-1] |= tied[1:]
    among = at[tied]
    at[tied] = among[np.lexsort([c[among] for c in rows[::-1]])]
    return at


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The columns of the batches, of at least ``READ_ROWS`` rows but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= READ_ROWS:
            yield columns_of(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield columns_of(pa.Table.from_batches(held))


def combined(parts: Iterator[Rows], meet: Callable, sent: Callable[[Rows], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task sends: per ``COMBINED_ROWS`` rows, what is settled there and the earliest of the rest."""
    held, size = [], 0

    def send() -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        at = order_of(rows)
        for out in meet([c[at] for c in rows])[:2]:
            if len(out[0]):
                yield sent(out)

    for rows in parts:
        held.append(rows)
        size += len(rows[0])
        if size >= COMBINED_ROWS:
            yield from send()
            held, size = [], 0
    if size:
        yield from send()


def columns_of(table: pa.Table) -> Rows:
    return [c.to_numpy() for c in table.columns]


def keys(docs: DataFrame, min_words: int, near_words: int, per_edit: int | None, bits: int) -> DataFrame:
    """``PACKED_TYPE``: the keys of all lines. ``docs`` has d, row, text.

    Keys of halves and runs, and the line beside them, are cut to 48 bits to have less to shuffle: they only say which lines are looked at."""
    cut = np.int64(-1 << 16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in blocks(batches):
            h, text, number, first, last = lines_of(batch.column(2))
            enough = last - first >= min_words
            text, number, first, last = text[enough], number[enough], first[enough], last[enough]
            d, row = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text]
            n = last - first
            one, two = Sums(h), Sums(mix(h ^ SECOND))
            h1, h2 = mix(one.run(first, last)), mix(two.run(first, last))
            near = np.flatnonzero(n >= near_words)
            found = [(h1, np.arange(len(n)), h2, WHOLE), (half_keys(one, first[near], last[near]).ravel(), np.repeat(near, 4), None, HALF)]
            long = np.flatnonzero(n >= max(per_edit, near_words)) if per_edit else near[:0]
            if len(long):
                key, owner = run_keys(h, first[long], last[long], per_edit)
                found.append((key, long[owner], None, RUN))
            for key, owner, other, kind in found:
                key, other = key.view(np.int64), (h1[owner] if other is None else other).view(np.int64)
                if kind != WHOLE:
                    key, other = key & cut, other & cut
                yield [key, np.full(len(key), kind, dtype=np.int32), other, d[owner], row[owner], number[owner].astype(np.int32)]

    return docs.mapInArrow(lambda batches: combined(emit(batches), met_keys, lambda rows: packed(rows, bits)), PACKED_TYPE)


def shared_keys(rows: DataFrame) -> DataFrame:
    """(kind, d, row, line): DONE + WHOLE for lines that repeat an earlier one, DONE + HALF or RUN for lines that share one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_ranges(batches):
            done = rows[1] >= DONE
            told = [[c[done] for c in rows]]
            if not done.all():
                told.append(met_keys([c[~done] for c in rows])[0])
            for said in told:
                yield as_batch(said, KEY_ORDER).select(["kind", "d", "row", "line"])

    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(read, "kind int, d long, row long, line int")


def asked_lines(texts: pa.Array, asked: pa.Array):
    """Like ``lines_of``, only the asked lines."""
    h, text, number, first, last = lines_of(texts)
    wanted = np.asarray(asked.flatten(), dtype=np.int64)
    owner = np.repeat(np.arange(len(asked)), np.asarray(asked.value_lengths(), dtype=np.int64))
    span = int(max(number.max(initial=0), wanted.max(initial=0))) + 1
    keep = np.isin(text * span + number, owner * span + wanted)
    return h, text[keep], number[keep], first[keep], last[keep]


def variants(docs: DataFrame) -> DataFrame:
    """``VARIANT_TYPE`` of each line asked for: itself with place NOTHING, then minus each word. ``docs`` has d, row, text, asked."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        step, back = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        for batch in blocks(batches):
            h, text, number, first, last = asked_lines(batch.column(2), batch.column(3))
            d, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            each = last - first + 1
            line = np.repeat(np.arange(len(each)), each)
            place = np.arange(len(line)) - (np.cumsum(each) - each)[line] + NOTHING
            a, b = first[line], last[line]
            lost, rest = np.maximum(a + place, a), a + place + 1  # nothing is lost before ``a``
            hashes = []
            for sums in (Sums(h), Sums(mix(h ^ SECOND))):
                left = (sums.total[lost] - sums.total[a]) * sums.down[a]
                right = (sums.total[b] - sums.total[rest]) * sums.down[a]
                hashes.append(mix((left + np.where(place == NOTHING, right, right * back)) * step))
            yield [
                hashes[0].view(np.int64), hashes[1].view(np.int64), place.astype(np.int32), d[text[line]],
                row[text[line]], number[line].astype(np.int32)]

    return docs.mapInArrow(lambda batches: combined(emit(batches), met_variants, lambda rows: as_batch(rows, VARIANT_ORDER)), VARIANT_TYPE)


def one_edit(rows: DataFrame) -> DataFrame:
    """(d, row, line): the lines within one edit of an earlier one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for rows in together(batches):
            done = rows[2] == SETTLED
            if done.any():
                yield as_batch([c[done] for c in rows], VARIANT_ORDER).select(["d", "row", "line"])
                rows = [c[~done] for c in rows]
            if not len(rows[0]):
                continue
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            said, kept = met_variants(rows)
            head = last_true(starts_of(kept[0], kept[1]))[-1]
            carry = [c[np.unique([head, len(kept[0]) - 1])] for c in kept]  # of the last variant its first place and its last
            yield as_batch(said, VARIANT_ORDER).select(["d", "row", "line"])

    return rows.repartition("key").sortWithinPartitions(*VARIANT_ORDER).mapInArrow(read, "d long, row long, line int")


def run_lines(docs: DataFrame, per_edit: int) -> DataFrame:
    """``RUN_TYPE`` of each line asked for: its words, bit map and run keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            h, text, number, first, last = asked_lines(batch.column(2), batch.column(3))
            parts = batch.column(2).to_pylist()
            lines = [x.split("\n") for x in parts]
            bits = bit_maps(*of_lines(h, first, last), len(first))
            key, owner = run_keys(h, first, last, per_edit)
            at = np.argsort(owner, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(number.astype(np.int32)),
                pa.array((last - first).astype(np.int32)), pa.array([lines[t][k] for t, k in zip(text.tolist(), number.tolist(), strict=True)], pa.string()),
                *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)], pa.ListArray.from_arrays(offsets, pa.array(key[at].view(np.int64))),
            ], ["d", "row", "line", "n", "words", "b0", "b1", "b2", "b3", "keys"])

    return docs.mapInArrow(emit, RUN_TYPE)


def within(a: list[bytes], b: list[bytes], edits: int) -> bool:
    """Whether at most ``edits`` words inserted, deleted or replaced turn a into b."""
    n, m = len(a), len(b)
    if abs(n - m) > edits or (Counter(a) & Counter(b)).total() < max(n, m) - edits:
        return False
    none = -2 - n - m
    reach: dict[int, int] = {}  # the furthest place in a, by what the place in b is ahead
    for e in range(edits + 1):
        now = {}
        for ahead in range(-e, e + 1):
            i = max(reach.get(ahead, none) + 1, reach.get(ahead - 1, none), reach.get(ahead + 1, none) + 1) if e else 0
            i = min(i, n, m - ahead)
            while 0 <= i < n and 0 <= i + ahead < m and a[i] == b[i + ahead]:
                i += 1
            now[ahead] = i
        if now.get(m - n, none) >= n:
            return True
        reach = now
    return False


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    return within(a, b, 1)


def common_words(a: Words, b: Words) -> np.ndarray:
    """How many words text i of a and text i of b have in common, each as often as both have it; rather more than fewer, as words
    are told apart by a part of their hash."""
    n = len(a.ptr) - 1
    bits = np.uint64(max(n, 2).bit_length())
    mixed = [(x.text_of().astype(np.uint64) << (np.uint64(64) - bits)) | (x.hashes >> bits) & ~np.uint64(1) | np.uint64(side) for side, x in enumerate((a, b))]
    rows = np.sort(np.concatenate(mixed))
    word = rows >> np.uint64(1)
    first = np.flatnonzero(starts_of(word))
    if not len(first):
        return np.zeros(n, dtype=np.int64)
    size = np.diff(np.append(first, len(rows)))
    right = np.add.reduceat((rows & np.uint64(1)).astype(np.int64), first)
    return np.bincount((rows[first] >> (np.uint64(64) - bits)).astype(np.int64), weights=np.minimum(right, size - right), minlength=n).astype(np.int64)


def words_at(low: bytes, words: Words, i: int) -> list[bytes]:
    at = slice(words.ptr[i], words.ptr[i + 1])
    return [low[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]


def near_pairs(line: pa.Array, partner: pa.Array, bound: np.ndarray) -> np.ndarray:
    """Which pairs are within their bounds. Most pairs have too few words in common, which is seen for all at once."""
    a, b = words_of(line), words_of(partner)
    n, m = np.diff(a.ptr), np.diff(b.ptr)
    out = common_words(a, b) >= np.maximum(n, m) - bound
    low = [LOWER[buffers(texts)[0]].tobytes() for texts in (line, partner)]
    for i in np.flatnonzero(out).tolist():
        out[i] = within(words_at(low[0], a, i), words_at(low[1], b, i), int(bound[i]))
    return out


def verified(line: Column, partner: Column, bound: Column) -> Column:
    def near(line: pa.Array, partner: pa.Array, bound: pa.Array) -> pa.Array:
        return pa.array(near_pairs(line, partner, bound.to_numpy(zero_copy_only=False)), pa.bool_())

    return arrow_udf(near, "boolean")(line, partner, bound)


AT = ("d", "row", "line")
BITS = ("b0", "b1", "b2", "b3")


def documents_with(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(d, row, text, asked) of the documents of ``asked`` (d, row, asked), staged. Only rows that a filter cannot clear are shuffled."""
    bits = bloom.bits_for(asked.count())
    document = F.xxhash64("d", "row")
    rows = stage(bloom.build(asked.select(document.alias("document")), "document", bits), "document-filter")
    found = bloom.tested(texts, document, rows, bits, "maybe").filter("maybe").drop("maybe")
    return stage(found.join(asked, ["d", "row"]).dropDuplicates(["d", "row"]), "near-documents")


def several_edits(lines: DataFrame, near: DataFrame, per_edit: int) -> DataFrame:
    """(d, row, line), staged: ``near`` and the ``run_lines`` that are within their bound of an earlier one."""
    place = F.struct(*AT)
    each = lines.select(*AT, "n", *BITS, F.explode(F.array_distinct("keys")).alias("key"))
    shared = stage(each.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "shared-runs")
    release(lines.sparkSession)
    bits = bloom.bits_for(shared.count())
    words = stage(bloom.build(shared.select("key"), "key", bits), "run-filter")
    maybe = bloom.tested(each, F.col("key"), words, bits, "maybe").filter("maybe").drop("maybe")  # few keys of one line are shuffled
    each = stage(maybe.join(shared, "key"), "run-keys")
    release(lines.sparkSession)

    def partner(rows: DataFrame) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"p_{c}") for c in (*AT, "n", *BITS)])

    def alike(met: DataFrame) -> DataFrame:
        """Pairs whose lengths and bit maps differ by no more than the bound of the shorter line allows."""
        bound = (1 + F.floor(F.least("n", "p_n") / per_edit)).cast("int")
        differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"p_{b}"))) for b in BITS), F.lit(0))
        met = met.filter((F.struct(*[F.col(f"p_{c}") for c in AT]) < place) & (differ <= 2 * bound))
        met = met.filter(F.abs(F.col("n") - F.col("p_n")) <= bound)
        return met.select(*AT, *[f"p_{c}" for c in AT], bound.alias("bound")).distinct()

    def settled(pairs: DataFrame, near: DataFrame) -> DataFrame:
        release(lines.sparkSession)
        own = lines.select(*AT, "words")
        other = lines.select(*[F.col(c).alias(f"p_{c}") for c in AT], F.col("words").alias("p_words"))
        met = pairs.join(own, list(AT)).join(other, [f"p_{c}" for c in AT])
        found = met.filter(verified(F.col("words"), F.col("p_words"), F.col("bound"))).select(*AT)
        near = stage(near.unionByName(found).distinct(), "near-so-far")
        release(lines.sparkSession)
        return near

    first = each.groupBy("key").agg(F.min(F.struct(*AT, "n", *BITS)).alias("p")).select("key", "p.*")
    near = settled(stage(alike(each.join(partner(first), "key")), "first-pairs"), near)
    more = each.filter("many > 2")  # in other groups the first partner was the only one
    open_ = more.join(near, list(AT), "left_anti")
    return settled(stage(alike(open_.join(partner(more), "key")), "other-pairs"), near)


def line_drops(
    docs: DataFrame, text: str = "text", min_words: int = 5, near_words: int = 8, per_edit: int | None = None
) -> DataFrame:
    """(d, row, drop): per document of ``keyed`` the numbers of the lines that go, staged; see ``line_dedup``."""
    smaller_batches(docs.sparkSession)
    texts = docs.select(F.col("__d__").alias("d"), F.col("__row__").alias("row"), F.coalesce(named(text), F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        ranges = max(LEAST_RANGES, texts.count() // RANGE_DOCUMENTS)
        found = stage(shared_keys(keys(texts, min_words, near_words, per_edit, (ranges - 1).bit_length())), "line-keys")
        release(docs.sparkSession)

        def lines(kind: int) -> Column:
            return F.collect_set(F.when(F.col("kind") == DONE + kind, F.col("line")))

        told = stage(found.groupBy("d", "row").agg(
            lines(WHOLE).alias("drop"), F.array_except(lines(HALF), lines(WHOLE)).alias("halves"),
            F.array_except(lines(RUN), lines(WHOLE)).alias("runs")), "told-lines")
        release(docs.sparkSession)
        asked = documents_with(texts, told.filter("size(halves) > 0 OR size(runs) > 0").select("d", "row", "halves", "runs"))
        near = stage(one_edit(variants(asked.filter("size(halves) > 0").select("d", "row", "text", "halves"))).distinct(), "near-lines")
        release(docs.sparkSession)
        if per_edit:
            long = stage(run_lines(asked.filter("size(runs) > 0").select("d", "row", "text", "runs"), per_edit), "run-lines")
            discard(asked)
            near = several_edits(long, near, per_edit)
        drops = told.select("d", "row", F.explode("drop").alias("line")).unionByName(near)
        return stage(drops.groupBy("d", "row").agg(F.array_sort(F.collect_set("line")).alias("drop")), "line-drops", keep=True)


def cut_lines(text: pa.Array, drop: pa.Array, again: pa.Array, min_words: int) -> pa.Array:
    """The texts without the lines to drop; of a row that repeats another, without all lines that may go."""
    full: dict[int, list[int]] = {}
    if pc.any(again).as_py():
        _, owner, number, first, last = lines_of(text)
        enough = last - first >= min_words
        for t, k in zip(owner[enough].tolist(), number[enough].tolist(), strict=True):
            full.setdefault(t, []).append(k)
    out = []
    for i, (t, gone, repeated) in enumerate(zip(text.to_pylist(), drop.to_pylist(), again.to_pylist(), strict=True)):
        parts = t.split("\n")
        gone = set(full.get(i, []) if repeated else gone or [])
        out.append({"text": "\n".join(x for k, x in enumerate(parts) if k not in gone), "n_lines": len(parts), "n_dropped": len(gone)})
    return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))


def without(text: Column, drop: Column, again: Column, min_words: int) -> Column:
    def cut(text: pa.Array, drop: pa.Array, again: pa.Array) -> pa.Array:
        return cut_lines(text, drop, again, min_words)

    return arrow_udf(cut, "struct<text:string,n_lines:long,n_dropped:long>")(text, drop, again)


def line_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5, near_words: int = 8, per_edit: int | None = None
) -> DataFrame:
    """All columns of ``docs`` and, as ``deduped``, a struct of the text left, n_lines and n_dropped.

    The order of lines is (key, hash of the document, line number), null keys last. Of equal lines of
    at least ``min_words`` words all but the earliest go; a line of at least ``near_words`` words also
    goes, with its copies, when an earlier such line is near it: within one word, and one more for each
    ``per_edit`` words of the shorter line (None: no more). Shorter lines, and lines without words,
    always stay. Of rows with equal key and text one is the earlier: it loses what any document loses,
    the others all lines of ``min_words`` words. Null texts are empty; an empty table stays empty.
    Documents in which nothing changes are not shuffled.
    """
    rows = keyed(docs, key, text)
    drops = line_drops(rows, text, min_words, near_words, per_edit)
    whole = F.coalesce(named(text), F.lit(""))
    copies = rows.groupBy("__d__", "__row__").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d__", "__row__")
    copies = stage(copies.withColumn("__copies__", F.lit(True)), "repeated-rows")
    side = drops.select(F.col("d").alias("__d__"), F.col("row").alias("__row__"), F.col("drop").alias("__drop__"))
    side = stage(side.join(copies, ["__d__", "__row__"], "full"), "changed-rows")
    bits = bloom.bits_for(side.count())
    document = F.xxhash64("__d__", "__row__")
    words = stage(bloom.build(side.select(document.alias("document")), "document", bits), "drop-filter")
    tested = bloom.tested(rows, document, words, bits, "__maybe__")
    left = tested.filter("NOT __maybe__").withColumn(
        "deduped", F.struct(whole.alias("text"), F.size(F.split(whole, "\n", -1)).cast("long").alias("n_lines"),
                            F.lit(0).cast("long").alias("n_dropped")))
    met = tested.filter("__maybe__").join(side, ["__d__", "__row__"], "left")
    once = met.filter("__copies__ IS NULL").withColumn("__again__", F.lit(False))
    many = stage(met.filter("__copies__").withColumn("__rid__", F.monotonically_increasing_id()), "copied-rows")
    earliest = many.groupBy("__d__", "__row__").agg(F.min("__rid__").alias("__first__"))
    many = many.join(earliest, ["__d__", "__row__"]).withColumn("__again__", F.col("__rid__") > F.col("__first__"))
    cut = once.unionByName(many.select(*once.columns)).withColumn(
        "deduped", without(whole, F.col("__drop__"), F.col("__again__"), min_words))
    kept = [*docs.columns, "deduped"]
    return left.select(*[named(c) for c in kept]).unionByName(cut.select(*[named(c) for c in kept]))
