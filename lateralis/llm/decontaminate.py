"""Benchmark decontamination with a distributed positional inverted index.

The training texts become index blocks: for each block of texts the sorted term hashes and, per
term, the ascending word positions. Blocks are stored as a table, so each is a shard of a
document-partitioned index and no posting is ever shuffled. A bounded block of test windows at a
time is sent to all shards; each shard takes a window's terms from the rarest in the whole corpus
to the commonest and intersects their offset-adjusted position lists. What survives are exact
phrases; with a tolerance on each offset the same walk gives proximity matches.

Terms are 64-bit hashes of whole words: two different words of corpus and benchmark meet with a
probability of about (distinct corpus words x distinct test words) / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm import bloom
from lateralis.llm.shared import documents_of, named, smaller_batches, stage
from lateralis.llm.wordhash import blocks, words_of

#: Test windows sent to the shards at once: a broadcast of at most 8 MB for windows of 10 words.
BLOCK_WINDOWS = 50_000

INDEX_TYPE = "block string, doc_ids array<long>, ptr binary, terms binary, term_ptr binary, positions binary"
MATCH_TYPE = (
    "block string, ordinal int, doc_id long, n_words long, items array<string>, near_items array<string>, "
    "spans array<struct<start:long,end:long>>"
)
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index, one row per block of texts; every word of every text is in it."""
    smaller_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(blocks(batches)):
            words = words_of(batch.column(1))
            order = np.argsort(words.hashes, kind="stable")
            terms, first = np.unique(words.hashes[order], return_index=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{k}"]),
                pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([words.ptr.astype(np.int32).tobytes()]),
                pa.array([terms.tobytes()]),
                pa.array([np.append(first, len(order)).astype(np.int32).tobytes()]),
                pa.array([order.astype(np.int32).tobytes()]),
            ], ["block", "doc_ids", "ptr", "terms", "term_ptr", "positions"])

    return documents_of(docs, key, text).mapInArrow(index, INDEX_TYPE)


class Windows:
    """A block of distinct test windows with the items that have each."""

    def __init__(self, owned: dict[tuple[int, ...], set[str]], size: int):
        self.lengths = np.array([len(w) for w in owned], dtype=np.int64)
        self.items = [sorted(x) for x in owned.values()]
        table = np.zeros((len(owned), size), dtype=np.uint64)
        for row, window in zip(table, owned, strict=True):
            row[:len(window)] = window
        self.used = np.arange(size)[None, :] < self.lengths[:, None]
        self.vocabulary, places = np.unique(table[self.used], return_inverse=True)
        self.terms = np.zeros(table.shape, dtype=np.int64)
        self.terms[self.used] = places

    def rarest_first(self, counts: np.ndarray) -> None:
        """``walk``: per window its offsets, from the rarest term of the corpus to the commonest."""
        common = np.where(self.used, counts[self.terms], np.iinfo(np.int64).max)
        self.walk = np.argsort(common, axis=1, kind="stable")


def windows_in_blocks(bench: DataFrame, key: str, text: str, size: int, at_once: int) -> Iterator[Windows]:
    """Reads the benchmark row by row on the driver, holding one block of windows at a time."""
    owned: dict[tuple[int, ...], set[str]] = {}
    for row in bench.select(named(key).cast("string").alias("i"), named(text).alias("t")).toLocalIterator():
        words = words_of(pa.array([row["t"] or ""])).hashes.tolist()
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owned.setdefault(tuple(words[i:i + size]), set()).add(row["i"] or "")
        if len(owned) >= at_once:
            yield Windows(owned, size)
            owned = {}
    if owned:
        yield Windows(owned, size)


def corpus_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each of the block's terms stands in the corpus (reads only terms and their pointers)."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        seen = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for terms, ptr in zip(*batch.to_pydict().values(), strict=True):
                terms, n = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(ptr, np.int32))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    seen += np.where(terms[at] == wanted, n[at], 0)
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(seen[kept])], ["term", "n"])

    counts = np.zeros(len(vocabulary), dtype=np.int64)
    sums = index.select("terms", "term_ptr").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in sums.collect():  # at most one row per term of the block
        counts[term] = n
    sent.unpersist()
    return counts


def intersect(w: Windows, terms: np.ndarray, term_ptr: np.ndarray, positions: np.ndarray, ptr: np.ndarray, slack: int):
    """(window, start) of exact phrases, and (window, text) of proximity matches, in one index block."""
    none = np.zeros(0, dtype=np.int64)
    if not len(terms) or not len(w.vocabulary):
        return none, none, none, none
    at = np.minimum(np.searchsorted(terms, w.vocabulary), len(terms) - 1)
    rank = np.where(terms[at] == w.vocabulary, at, -1)
    live = np.flatnonzero(((rank[w.terms] >= 0) | ~w.used).all(axis=1))
    counts = np.diff(term_ptr)
    first = w.walk[live, 0]
    anchor = rank[w.terms[live, first]]
    n = counts[anchor]
    window = np.repeat(live, n)
    inner = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    start = positions[np.repeat(term_ptr[:-1][anchor], n) + inner].astype(np.int64) - np.repeat(first, n)
    text = np.searchsorted(ptr, start + np.repeat(first, n), side="right") - 1
    exact = (start >= ptr[text]) & (start + w.lengths[window] <= ptr[text + 1])
    postings = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | positions
    for j in range(1, w.terms.shape[1]):
        if not len(window):
            break
        offset = w.walk[window, j]
        needed = j < w.lengths[window]
        term = rank[w.terms[window, offset]]
        goal = start + offset
        low = np.maximum(goal - slack, 0)
        key = (term << 32) | low
        place = np.searchsorted(postings, key)
        found = postings[np.minimum(place, len(postings) - 1)]
        where = found & 0xFFFFFFFF
        near = ((found >> 32) == term) & (where >= low) & (where <= goal + slack)
        near &= (where >= ptr[text]) & (where < ptr[text + 1])
        here = (term << 32) | np.maximum(goal, 0)
        hit = postings[np.minimum(np.searchsorted(postings, here), len(postings) - 1)] == here
        exact &= ~needed | (hit & (goal >= 0))
        keep = ~needed | near | exact
        window, start, text, exact = window[keep], start[keep], text[keep], exact[keep]
    return window[exact], start[exact], window, text


def merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Unions of overlapping or touching ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)], strict=True)]


def search(index: DataFrame, w: Windows, slack: int = 3) -> DataFrame:
    """One row per text of the index: its items with exact phrases or proximity matches, and the hit ranges."""
    sent = index.sparkSession.sparkContext.broadcast(w)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                ptr = np.frombuffer(row["ptr"], np.int32).astype(np.int64)
                terms, term_ptr = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["term_ptr"], np.int32)
                positions = np.frombuffer(row["positions"], np.int32)
                window, start, near_window, near_text = intersect(w, terms, term_ptr, positions, ptr, slack)
                size = len(row["doc_ids"])
                items, near, spans = [[] for _ in range(size)], [[] for _ in range(size)], [[] for _ in range(size)]
                text = np.searchsorted(ptr, start, side="right") - 1
                for t in np.unique(text):
                    own = text == t
                    items[t] = sorted({i for x in np.unique(window[own]) for i in w.items[x]})
                    spans[t] = merged(start[own] - ptr[t], start[own] + w.lengths[window[own]] - ptr[t])
                for t in np.unique(near_text):
                    near[t] = sorted({i for x in np.unique(near_window[near_text == t]) for i in w.items[x]})
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * size), pa.array(range(size), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(ptr)),
                    pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(SPAN)),
                ], ["block", "ordinal", "doc_id", "n_words", "items", "near_items", "spans"])

    return index.mapInArrow(match, MATCH_TYPE)


#: Length of the union of ranges that come sorted by start.
COVERED = """aggregate(array_sort(spans), struct(0L AS n, 0L AS upto), (a, s) -> struct(
    a.n + greatest(0L, s.end - greatest(s.start, a.upto)) AS n, greatest(a.upto, s.end) AS upto), a -> a.n)"""


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    slack: int = 3,
    at_once: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, near_items, spans, contaminated.

    A window is ``size`` consecutive words of an item, or the whole of a shorter item that has words;
    ``items`` have a window that occurs, ``spans`` are the covered word ranges. ``near_items`` have a
    window each of whose words stands within ``slack`` of its place. Null texts have no words;
    repeated documents each get their row; items that share a window all count, repeated rows of
    an item count once; a null item id is the empty string. With an empty benchmark nothing is hit;
    an empty table gives no rows. A benchmark of more than ``at_once`` windows is searched in as many
    passes over the stored index.
    """
    index = stage(build_index(docs, key, text), "positional-index")
    passes = []
    for w in windows_in_blocks(bench, item_key, item_text, size, at_once):
        w.rarest_first(corpus_counts(index, w.vocabulary))
        passes.append(search(index, w, slack))
    found = passes[0] if passes else search(index, Windows({}, size), slack)
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        one = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
        found = found.groupBy("block", "ordinal", "doc_id", "n_words").agg(
            *one, F.flatten(F.collect_list("spans")).alias("spans"))
    return found.select(
        "doc_id", "n_words", F.expr(COVERED).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "near_items", "spans", (F.size("items") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which a benchmark window occurs."""
    row = F.xxhash64(named(key), F.coalesce(named(text), F.lit("")))  # rows with equal key and text share their fate
    found = decontaminate(docs.select(row.alias("row"), named(text).alias("text")), bench, key="row")
    dirty = stage(found.filter("contaminated").select("doc_id"), "contaminated")
    return bloom.without(docs, row, dirty, "doc_id")
