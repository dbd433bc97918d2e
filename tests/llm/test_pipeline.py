"""The corpus pipeline stage by stage against brute force on the smallest tables."""

import collections

import pytest
from pyspark.sql import functions as F

from llm.test_operators import ROWS, brute_hits, near_reference, words

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from lateralis.llm.shared import stage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(df.columns == COLUMNS for name, df in stages.items() if name != "bpe")
    assert all(r.n_chars == len(r.text) for r in stages["decontamination"].collect())


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) / len(good) > 0.97 and sum(d not in kept for d in bad) / len(bad) > 0.8


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def grown_reference(rows):
    """Lines that repeat an earlier one, or from five words on are within one edit and one for each 16 words of it."""
    seen, gone = {}, collections.defaultdict(set)
    for d, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = tuple(words(line))
            if not w:
                continue
            if w not in seen:
                bag, near = collections.Counter(w), False
                for o, other in seen.items():
                    short, most = min(len(o), len(w)), 1 + min(len(o), len(w)) // 16
                    if short >= 5 and abs(len(o) - len(w)) <= most and (bag & other).total() >= max(len(o), len(w)) - most:
                        near = near or distance(o, w) <= most
                seen[w] = bag
                if near:
                    gone[(d, t)].add(k)
            else:
                gone[(d, t)].add(k)
    return gone


def test_lines(stages):
    before = rows(stages["quality"])
    gone = grown_reference(before)
    expected = []
    for d, t in before:
        parts = t.split("\n")
        left = "\n".join(x for i, x in enumerate(parts) if i not in gone[(d, t)])
        if not gone[(d, t)] or words(left):
            expected.append((d, left))
    assert rows(stages["line_dedup"]) == expected


def test_near(stages):
    before = rows(stages["line_dedup"])
    heads = {best for (_, best, _) in near_reference(before)}
    assert [d for d, _ in rows(stages["near_dedup"])] == sorted(heads)


def test_benchmark(spark, stages):
    before = rows(stages["near_dedup"])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = sorted(d for (d, _, hits, _) in brute_hits(before, bench, 10) if hits == 0)
    assert [d for d, _ in rows(stages["decontamination"])] == clean


def test_tokens(stages):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows(stages["decontamination"]))
    got = {r.doc_id: r for r in stages["bpe"].collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert np.frombuffer(got[d].ids, np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert got[d].decoded == t


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty texts, repeated rows, ties, and columns named like the operators' own."""
    made = [(*r, "en", "s", None if i % 3 else len(r[1] or ""), "x", i, None) for i, r in enumerate([*ROWS, ROWS[0], (None, None), (None, None)])]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, row string, d long, score double")


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"])
def test_odd_rows(spark, odd, name):
    import corpus_pipeline

    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, odd, FOLDER)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect()) if name != "bpe" else out.count()
    before = collections.Counter((r.doc_id, r.text) for r in odd.collect())
    if name == "bpe":
        assert got == odd.count()
    else:
        assert out.dtypes == odd.dtypes
    if name == "quality":
        assert all(n == before[row] for row, n in got.items())  # repeated rows share their fate
    if name == "line_dedup":
        assert got[(1, ROWS[0][1])] == 1 and got[(None, None)] == 2 and got[(3, "")] == 1
    if name == "near_dedup":
        assert got[(1, ROWS[0][1])] == 1 and got[(6, ROWS[5][1])] == 0 and got[(None, None)] == 2 and got[(2, None)] == 1
    if name == "decontamination":
        assert got == before
    nothing = step(spark, odd.filter(F.lit(False)), FOLDER)
    assert nothing.count() == 0 and nothing.columns == out.columns
