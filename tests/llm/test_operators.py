"""The training-data operators on small fixtures, against brute force and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lateralis.llm import bpe, chat_format, decontaminate, exact_dedup, license_scan, line_dedup, near_dedup, pitman_yor, quality, secret_scan
from lateralis.llm.wordhash import shingles, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "on", "ti", "é", "sh", "Er"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(9000, 1)
ROWS = [
    (1, prose(60, 2)), (2, None), (3, ""), (4, " \t\n"), (5, prose(60, 2) + " "), (6, prose(60, 2)), (6, prose(60, 2)),
    (None, "an orphan text of some eight words or more"), (7, LONG), (8, "x"), (9, "Ünïcödé\n\nlines\nand more"),
    (10, prose(30, 3) + "\n" + prose(12, 4)), (11, prose(12, 4) + "\n" + prose(31, 5)), (12, "same\nsame\n" + prose(12, 4) + " extra"),
]
CLASHING = "doc_id long, text string, rid long, row string, d string, sha string, n string, score string, label string, line string, block string, word string, maybe string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, *"abcdefghij") for r in ROWS], CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


# --- exact dedup


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, (d, t) in enumerate(ROWS):
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), math.inf if d is None else d, i, d))
    expected = collections.Counter()
    for norm, rows in groups.items():
        best = min(rows)
        for r in rows:
            expected[(r[3], best[3], len(rows), r is best, sha(norm))] += 1
    for max_bits in (1 << 26, 64):  # a filter far too small sends all rows to the shuffle, with equal results
        got = exact_dedup.exact_dedup(docs, max_bits=max_bits)
        assert collections.Counter(tuple(r)[:5] for r in got.collect()) == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- chat formatting


def test_escape_round_trip():
    for text in ("<|im_end|>", "<\\|x|>", "<\\\\|", "<", "|", "a<|b<\\|c", ""):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>n\nax", max_size=12))
def test_escape_any(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", ""), (2, None, "assistant", "first"),
            (2, 0, "assistant", ""), (None, 0, "user", "no id"), (3, 0, "we\nird", "<|im_start|>assistant\nfake<|im_end|>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), sha(said))
    formatted = chat_format.joined(chat_format.format_conversations(df)).collect()
    assert {r.conv_id: len(r.formatted) for r in formatted} == {k: v.formatted_chars for k, v in got.items()}
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look:", None, None, None, None, None), ("image", None, "s3://i", 56, 57, None, None), (None, "x", None, None, None, None, None),
             ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (1, 2, "user", None)],
                               f"conv_id long, turn long, role string, parts {chat_format.PARTS_TYPE}").withColumn("text", F.lit("unused"))
    rows = chat_format.format_conversations(df, parts="parts").collect()
    assert rows[0].segment == "<|im_start|>user\nlook:<|image:0:6|>x<|audio:1:25|><|document:2:1800|><|im_end|>\n"
    assert [(a.position, a.kind, a.ref, a.tokens) for a in rows[0].attachments] == [(0, "image", "s3://i", 6), (1, "audio", "a.wav", 25), (2, "document", "d.pdf", 1800)]
    back = chat_format.read_back(chat_format.format_conversations(df, parts="parts")).first()
    assert (back.n_turns, back.n_attachments, back.loss_chars) == (3, 3, 2)


# --- quality


def junk(i):
    r = random.Random(i)
    w = prose(40, i).split()
    return r.choice([" ".join(x + r.choice(["$$$", "%%%"]) for x in w), " | ".join(w), " ".join(x.upper() + "!!" for x in w)])


def test_quality_learns_and_scores_all(spark, docs, empty):
    rows = [(i, junk(i) if i % 4 == 0 else prose(40, i)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    assert 0 < len(model.rules) < 200
    out = quality.classify(table, model).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    odd = quality.classify(docs, model)
    assert set(odd.columns) == {*docs.columns, "predicted"}
    assert all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == len(ROWS)
    assert quality.classify(empty, model).count() == 0
    none = quality.train(table, labels.limit(0))
    assert none.rules == [] and quality.classify(table, none).first().score == pytest.approx(0.5)


# --- license scan


def test_compiled_rules_equal_numpy_and_hold_out(spark):
    """The column expression against the rules one by one on whole tables, and its worth on labels never learned from."""
    folder = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(table, labels)
    got = quality.classify(table, model).select("doc_id", "text", "score").collect()
    x = quality.statistics_of(pa.array([r.text or "" for r in got]))
    total = model.intercept + sum(w * quality.holds(x, r) for r, w in zip(model.rules, model.weights, strict=True))
    assert len(model.rules) > 3 and np.allclose([r.score for r in got], 1 / (1 + np.exp(-total)), atol=1e-9)
    score = {r.doc_id: r.score for r in got}
    out = [(score[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in score and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95, auc


def test_license_scan(spark, empty):
    texts = [
        "This is under the GNU General\nPublic-License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
        "Released under the MIT License. MIT; LICENSE! xMIT License", "All rights reserved.", None, "", LONG, "mit licence", "spdx-license-identifier: MIT License"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        w, at, labels = words(t), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, set(r.base_labels)) == (len(w), len(at), min(at, default=None), max(at, default=None), labels)
        assert labels <= set(r.labels) and 0 <= r.score <= 1
    assert "apache-2.0" in got[1].labels and "cc-by-nc-4.0" in got[2].labels and got[4].labels == ["all-rights-reserved"]
    assert len([d for d in got[1].detections if d.label.startswith("apache")]) == 1  # the rest lies within it
    assert len(license_scan.rules()) > 300
    assert license_scan.scan(empty).count() == 0


def test_license_keywords_lose_no_match():
    ordered = license_scan.rules()
    free = [license_scan.Rule(r.label, r.pattern, (), ((),), r.priority, r.confidence) for r in ordered]
    expected = {
        "Licensed under CC BY NC SA 4.0": "cc-by-nc-sa-4.0", "Attribution-NonCommercial-ShareAlike": "cc-by-nc-sa", "CC BY NC ND": "cc-by-nc-nd",
        "Attribution-NoDerivatives": "cc-by-nd", "Creative Commons Zero": "cc0", "Microsoft Public License": "ms-pl", "the open\nfont  license": "ofl",
        "Open\nSoftware License": "osl", "common\npublic license": "cpl", "Creative\nCommons": "creative-commons", "into the public\ndomain": "public-domain",
        "GNU GPL v3": "gpl-3", "MPL 2.0": "mpl-2.0", "CC0": "cc0", "Apache-2.0": "apache-2.0", "Common Development and Distribution Licence": "cddl",
        "# Permission is hereby granted, free of charge, to\n# any person obtaining a copy": "mit", "nothing here": None,
    }
    names = [re.sub(r"\[cs\]", "s", x).replace("[ -]", " ").replace("\\w*", "s").replace("\\", "") for _, n in license_scan.LICENSES for x in re.sub(r"\(\?:[^()]*\)\??", "", n).split("|")]
    assert len(names) > 50
    for text in [*expected, *names, *(n.replace(" ", "\n") for n in names), *(f"see the {n} 2" for n in names), *(f"SPDX-License-Identifier: {n}".lower() for n in names)]:
        low = text.lower().encode()
        got = license_scan.detections(low, ordered)
        assert got == license_scan.detections(low, free)
        assert expected.get(text) in {None, *(d[2] for d in got)}
        assert got or text not in expected or expected[text] is None


def test_license_identifiers():
    ordered = license_scan.rules()
    free = [license_scan.Rule(r.label, r.pattern, (), ((),), r.priority, r.confidence) for r in ordered]
    expected = {
        "SPDX-License-Identifier: MIT": {"mit"}, "SPDX-License-Identifier: ISC": {"isc"}, "spdx-license-identifier: (zlib)": {"zlib"},
        "SPDX-License-Identifier: EPL-2.0": {"epl-2.0"}, "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0"}, "License: MIT": {"mit"},
        'license = "Apache 2"': {"apache-2"}, "license: lgpl-2.1-only": {"lgpl-2.1"}, "MIT licensed": {"mit"}, "artistic-2.0": {"artistic-2.0"}, "released under BSD": {"bsd"},
        "gpl-2.0-or-later": {"gpl-2.0"}, "Apache License, version 2.0": {"apache-2.0"}, "licensed under the MPL 2.0": {"mpl-2.0"}, "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "the ISC conference; an artistic mit; zlib 1.2": set(), "submit-2.0 emit licenses": set(), "cc-by-sa-4.0": {"cc-by-sa-4.0"},
    }
    for text, labels in expected.items():
        got = license_scan.detections(text.lower().encode(), ordered)
        assert {d[2] for d in got} == labels, text
        assert got == license_scan.detections(text.lower().encode(), free)


def plain_detections(low, ordered):
    """Every match of every rule, and of these one after the other whatever lies in no interval accepted before."""
    found = []
    for place, rule in enumerate(ordered):
        for m in rule.pattern.finditer(low):
            version = m.groupdict().get("version")
            label = rule.label if version is None else f"{rule.label}-{version.decode()}"
            found.append((-rule.priority, m.start() - m.end(), m.start(), place, m.end(), label, rule.confidence))
    kept = []
    for prio, _, a, _, b, label, confidence in sorted(found):
        if not any(x <= a and b <= y for x, y, *_ in kept):
            kept.append((a, b, label, -prio, confidence))
    return sorted(kept)


def test_license_suppression_and_score(spark):
    r = random.Random(3)
    said = ["MIT License", "licensed under the", "Apache License, Version 2.0", "GNU General Public License v3", "SPDX-License-Identifier: MIT", "license:", "bsd-3-clause",
            "the terms of the", "as published by", "CC BY-SA 4.0", "see the", "All rights reserved.", "in the public domain", "released under", "MPL", "zlib/libpng license", "x"]
    texts = ["\n".join(" ".join(r.choice(said) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 4))) for _ in range(150)]
    texts += ["MIT License MIT License", "gpl gpl gpl", "license: the mit license"]  # equal priority and length
    ordered = license_scan.rules()
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        kept = plain_detections(text.lower().encode(), ordered)
        assert [(d.start, d.end, d.label, d.priority) for d in got[i].detections] == [d[:4] for d in kept], text
        doubt = math.prod([0.1] * len(got[i].base_labels) + [1 - d[4] for d in kept])
        assert got[i].score == pytest.approx(1 - doubt, abs=1e-12)
        assert got[i].labels == sorted({*got[i].base_labels, *(d[2] for d in kept)})


# --- decontamination


def brute_hits(rows, bench, size):
    windows = collections.defaultdict(set)
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(str(item) if item is not None else "")
    out = []
    for d, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    items |= windows[tuple(w[i:i + n])]
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), tuple(sorted(items))))
    return collections.Counter(out)


@pytest.mark.parametrize("at_once", [50_000, 3])
def test_decontaminate(spark, docs, empty, at_once):
    body = prose(60, 2).split()
    bench = [(1, " ".join(body[5:20])), (2, " ".join(body[15:30]).upper()), (3, "x"), (4, None), (5, "--"), (6, LONG[:300]), (6, LONG[:300]), (None, "eight words or more"), (7, "no such words here at all")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.decontaminate(docs, table, at_once=at_once).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_hits(ROWS, bench, 10)
    assert all(set(r["items"]) <= set(r.near_items) and r.contaminated == bool(r["items"]) for r in got)
    assert decontaminate.decontaminate(docs, table.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.decontaminate(empty, table).count() == 0
    left = decontaminate.remove_contaminated(docs, table)
    assert left.columns == docs.columns
    clean = sum(n for (_, _, hits, _), n in brute_hits(ROWS, bench, 10).items() if hits == 0)
    assert left.count() == clean


def test_proximity(spark):
    body = prose(40, 8).split()
    loose = " ".join(body[:5] + ["inserted"] + body[5:10])
    docs = spark.createDataFrame([(1, loose), (2, " ".join(body[:10])), (3, " ".join(reversed(body[:10])))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(body[:10]))], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1] == ([], ["9"]) and got[2] == (["9"], ["9"])


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


UNSPLIT = ["a" * 5000, "".join(random.Random(1).choice("abcé'日sl") for _ in range(3000)), "日本語" * 400, " " * 700 + "x" + " " * 500, "don't" * 300, "a<|endoftext|>b" * 50, "\n\n  \t" * 99]


@pytest.mark.parametrize("leaf", [16, 57, 16384])
def test_bpe_equals_the_library(spark, docs, empty, tokenizer, leaf):
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(UNSPLIT))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = collections.Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected[(d, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    got = bpe.encode_decode(df, leaf_chars=leaf, digests=True).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == expected
    assert bpe.encode_decode(empty).count() == 0
    full = bpe.encode_decode(docs, leaf_chars=leaf).filter("doc_id = 9").first()
    assert full.decoded == "Ünïcödé\n\nlines\nand more" and len(full.ids) == 4 * full.n_tokens


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stle é日1!. \n<|endoftxt>"), max_size=60), st.integers(1, 20))
def test_bpe_join_any(text, leaf):
    c = bpe.codec(bpe.default_ranks_path())
    ids, _ = bpe.concatenate(c, [c.encode(x) for x in bpe.halves(text, leaf)])
    assert ids.tolist() == c.encode(text).tolist()
    assert c.decode(ids) == text


# --- MinHash near-dedup


def weighted_set(text):
    w = words(text)
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def near_reference(rows):
    sets = [weighted_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                head[max(find(i), find(j))] = min(find(i), find(j))
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return collections.Counter((rows[i][0], min((x for x in classes[find(i)] if x is not None), default=None), len(classes[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("small", [8, 2])  # 2: nearly all buckets count as large
def test_near_dedup(spark, docs, empty, small):
    def edited(text, i, n):
        w = text.split()
        for k in range(n):
            w[(i * 13 + k * 29) % len(w)] = f"edit{i}x{k}"
        return " ".join(w)

    base = prose(120, 50)
    rows = [*ROWS, *((200 + i, edited(base, i, i % 5)) for i in range(40)), (300, base.upper()), (301, prose(119, 51)), (302, "one two"), (303, "One, two!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_classes(df, small=small).collect()
    last = near_dedup.LAST
    assert collections.Counter((None if r.d == last else r.d, None if r.class_id == last else r.class_id, r.class_size) for r in got) == near_reference(rows)
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) if r.class_size > 1 else (r.d, r.row) for r in got})
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in near_dedup.near_classes(docs).collect())
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """200 texts of one origin, most too far from the most central ones: links between any two of them count."""
    rng, base = random.Random(11), prose(150, 52).split()

    def edited(i):
        w = list(base)
        for k in range(rng.choice([1, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"edit{i}x{k}"
        return " ".join(w)

    rows = [(i, edited(i)) for i in range(200)]
    rows += [(200 + i, rows[7 * i][1] + " one more end") for i in range(20)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.d, r.class_id, r.class_size) for r in got) == near_reference(rows)
    assert len({r.class_id for r in got}) > 5


@pytest.mark.parametrize("small", [8, 2])
def test_near_links_prove_the_classes(spark, empty, small):
    """Every link is exact, the classes are the components of the links and copies, and via_id is the best link of a text."""
    base = prose(150, 61).split()
    rows = [(i, " ".join([*base[:i % 9], f"edit{i}", *base[i % 9 + 1:100 + i]])) for i in range(30)]
    rows += [(100 + i, re.sub("[a-z]", lambda m: m[0].upper(), rows[i][1])) for i in range(0, 30, 4)] + [(200, None), (201, prose(90, 62)), (201, prose(90, 62)), (202, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {d: weighted_set(t) for d, t in rows}

    def jaccard(x, y):
        return sum((text[x] & text[y]).values()) / sum((text[x] | text[y]).values())

    links = [tuple(r) for r in near_dedup.near_links(df, small=small).collect()]
    assert links and len({(a, b) for a, b, _ in links}) == len(links)
    assert all(a < b < 100 and s >= 0.8 and s == pytest.approx(jaccard(a, b)) for a, b, s in links)
    got = near_dedup.near_classes(df, small=small, proofs=True).collect()
    head = {d: d for d, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in [(a, b) for a, b, _ in links] + [(i, 100 + i) for i in range(0, 30, 4)]:
        head[max(find(a), find(b))] = min(find(a), find(b))
    assert all(r.class_id == find(r.d) for r in got)
    best = {}
    for x, y, s in links + [(b, a, s) for a, b, s in links]:
        best[x] = max(best.get(x, (0, 0)), (s, -y))
    seen = set()
    for r in sorted(got, key=lambda r: (r.d, r.similarity is not None)):
        if 100 <= r.d < 200:
            assert (r.via_id, r.similarity) == (r.d - 100, 1.0)
        elif r.d == 201 and 201 in seen:
            assert (r.via_id, r.similarity) == (201, 1.0)
        elif r.d in best:
            assert (r.similarity, -r.via_id) == best[r.d]
        else:
            assert r.via_id is None and r.similarity is None
        seen.add(r.d)
    assert near_dedup.near_links(empty).count() == 0 and near_dedup.near_classes(empty, proofs=True).count() == 0


def test_bands_recall_pairs_of_the_least_similarity(spark):
    """At least 0.99 of the pairs at 0.8 and a little more share a band."""
    base = [prose(200, 300 + i).split() for i in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(100 + i, " ".join([*b[:40], "x0", *b[41:80], "x1", *b[81:120], "x2", *b[121:160], "x3", *b[161:]])) for i, b in enumerate(base)]
    texts = near_dedup.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    bands = {r.d: set(r.bands) for r in near_dedup.sketches(texts, 25, 5).collect()}
    assert all(0.8 <= (lambda a, b: sum((a & b).values()) / sum((a | b).values()))(weighted_set(rows[i][1]), weighted_set(rows[60 + i][1])) < 0.83 for i in range(60))
    assert sum(bool(bands[i] & bands[100 + i]) for i in range(60)) >= 0.99 * 60


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(45)] + [(200, 300)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    head = {x: x for pair in links for x in pair}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == {x: find(x) for x in head}


def test_dart_signatures_estimate_weighted_jaccard():
    texts = [prose(300, 60)]
    w = texts[0].split()
    texts += [" ".join(w[: 300 - k] + w[: k]) for k in (30, 100, 200)]
    h, ptr = shingles(words_of(pa.array(texts)))
    sig = near_dedup.signatures(near_dedup.units(h, ptr), ptr, 2000)
    for i in range(1, 4):
        a, b = weighted_set(texts[0]), weighted_set(texts[i])
        true = sum((a & b).values()) / sum((a | b).values())
        assert abs(np.mean(sig[0] == sig[i]) - true) < 0.05


# --- line dedup


def line_reference(rows):
    order = sorted({(math.inf if d is None else d, t or "") for d, t in rows}, key=lambda x: x[0])
    seen, gone = {}, collections.defaultdict(set)
    for d, t in order:
        for k, line in enumerate(t.split("\n")):
            w = words(line)
            if len(w) < 5:
                continue
            w = tuple(w)
            if w not in seen:
                seen[w] = len(w) >= 8 and any(len(o) >= 8 and line_dedup.within_one(list(o), list(w)) for o in seen)
                if seen[w]:
                    gone[(d, t)].add(k)
            else:
                gone[(d, t)].add(k)
    return gone


@pytest.mark.parametrize("batch", [1000, 7])
def test_line_dedup(spark, docs, empty, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))  # 7: most keys span batches
    try:
        check_line_dedup(spark, docs, empty)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def check_line_dedup(spark, docs, empty):
    base = prose(14, 70).split()
    variants = [" ".join(base), " ".join(base[1:]), " ".join([*base, "more"]), " ".join([*base[:6], "other", *base[7:]]), " ".join([*base[:6], "third", *base[7:]]), " ".join(base[:-2])]
    rows = [*ROWS, ROWS[5], *((400 + i, f"head {i}\n{v}\ntail {i}") for i, v in enumerate(variants)), (500, "\n".join(variants))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    gone, met = line_reference(rows), set()
    expected = collections.Counter()
    for d, t in rows:
        parts = (t or "").split("\n")
        drop = gone[(math.inf if d is None else d, t or "")]
        if (d, t) in met:  # a repeated row has nothing new
            drop = {i for i, x in enumerate(parts) if len(words(x)) >= 5}
        met.add((d, t))
        expected[(d, "\n".join(x for i, x in enumerate(parts) if i not in drop), len(parts), len(drop))] += 1
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", "text", "line", "deduped"]
    assert collections.Counter((r.doc_id, *r.deduped) for r in got.collect()) == expected
    assert line_dedup.line_dedup(docs).count() == len(ROWS) and line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_bound_grows_and_short_lines_go(spark):
    base = prose(70, 71).split()

    def edited(n, k):  # k words replaced in the first n
        w = base[:n]
        for i in range(k):
            w[(3 + i * n // max(k, 1)) % n] = f"e{n}x{k}x{i}"
        return " ".join(w)

    texts = [edited(n, k) for n in (6, 16, 40, 64) for k in (0, 1, 2, 3, 5, 6)]
    texts += [" ".join(base[2:40]), " ".join(["in", "front", *base[:38]]), "so", "two words", "So!", "Two, words", "one two three", *[f"{prose(20, 90 + i)} {' '.join(base[:9])}" for i in range(9)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, expected = [], {}
    for i, t in enumerate(texts):
        w = words(t)
        d = [[0] * (len(w) + 1) for _ in range(2)]
        expected[i] = 0
        for o in seen:
            short = min(len(o), len(w))
            d[0] = list(range(len(w) + 1))
            for x in range(1, len(o) + 1):
                d[x % 2] = [x] + [0] * len(w)
                for y in range(1, len(w) + 1):
                    d[x % 2][y] = min(d[(x - 1) % 2][y] + 1, d[x % 2][y - 1] + 1, d[(x - 1) % 2][y - 1] + (o[x - 1] != w[y - 1]))
            expected[i] |= d[len(o) % 2][-1] <= (1 + short // 16 if short >= 5 else 0)
        seen.append(w)
    assert 10 < sum(expected.values()) < len(texts) - 10
    got = {r.doc_id: r.deduped.n_dropped for r in line_dedup.line_dedup(df, min_words=1, near_words=5, per_edit=16).collect()}
    assert got == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 5))
def test_within(a, b, k):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(d[j] + 1, left[-1] + 1, d[j - 1] + (x != y)))
        d = left
    assert line_dedup.within(a, b, k) == (d[-1] <= k)


def test_within_one():
    assert all(line_dedup.within_one(a.split(), b.split()) for a, b in (("a b c", "a b c"), ("a b c", "a c"), ("a b c", "a x c"), ("a b", "a b c"), ("", "a")))
    assert not any(line_dedup.within_one(a.split(), b.split()) for a, b in (("a b c", "c b a"), ("a b c d", "a b"), ("a b c", "b c d")))


# --- secret scan


def test_secret_scan(spark, docs, empty):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = ['token = "' + hexes[0] + '"', "é password=abc123DEF456 x", "secret=short", "API_KEY: token = password: abcdefghijklmnop", "AKIA" + "AB12" * 4, "AKIAAB12", None, "",
             "deadbeef" * 2 + " deadbee", "api-key=abcdefghijkl apikey=abcdefghijkl", *hexes, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", LONG]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secret_scan.secret_spans(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [tuple(s) for s in got[i].spans if s.kind < 3] == sorted(spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    found = sum(got[i].n_random for i, t in enumerate(texts) if t in hexes)
    assert found >= 25 and got[len(texts) - 2].n_random == 0 and got[len(texts) - 1].n_random == 0
    assert secret_scan.secret_spans(docs).count() == len(ROWS) and secret_scan.secret_spans(empty).count() == 0
    assert secret_scan.secret_spans(docs).select(secret_scan.as_text(F.col("spans"))).distinct().count() == 1


def test_secret_behind_a_name(spark):
    """Standard base64 that touches a character of the url-safe alphabet is found like the same key alone."""
    r = random.Random(11)
    plain = [chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)]]
    keys = [("".join(r.choice([*plain, *extra]) for _ in range(30)) + extra[0] + "".join(r.choice([*plain, *extra]) for _ in range(33)) + "a") for extra in ("+/", "-_") for _ in range(20)]
    forms = [lambda k: k, lambda k: f"id-{k} end", lambda k: f"see name_{k}_x", lambda k: f"https://x/{k}"]
    rows = [(100 * f + i, form(k)) for f, form in enumerate(forms) for i, k in enumerate(keys)]
    got = {x.doc_id: x.spans for x in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def whole(f, i):
        text = dict(rows)[100 * f + i]
        at = text.index(keys[i])
        return any(s["kind"] == 3 and s["start"] <= at + 4 and s["end"] >= at + len(keys[i]) - 4 for s in got[100 * f + i])

    counts = [[sum(whole(f, i) for i in half) for half in (range(20), range(20, 40))] for f in range(4)]
    assert counts[0] == [20, 20] and counts[1][0] >= 19 and counts[2][0] >= 19, counts
    assert counts[1][1] >= 19 and counts[3][0] >= 19, counts  # behind a slash a url-safe key is cut at its own - and _


def test_long_candidates_take_linear_time(spark):
    import time

    began = time.time()
    rows = [(1, "ab-cd_" * 50_000 + "+"), (2, "aB3" * 100_000 + "-"), (3, "a+b-" * 60_000), (4, "x/y_" * 60_000)]
    assert secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert time.time() - began < 60


def test_secret_scan_of_letters_only_and_digits_only(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("abcdefghijklmnopqrstuvwxyz", 60), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 60), ("0123456789", 120)) for _ in range(20)]
    plain = "ofthepeopleandtheotherthingsthatweresaidtohimbeforehewenttothetown"
    texts = [*keys, plain, plain.upper(), "1000000200000010000019990000200000010000001000020000100000", "-" * 40]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in secret_scan.secret_spans(df).collect()}
    assert all(sum(got[i] for i in range(k, k + 20)) >= 15 for k in (0, 20, 40))
    assert [got[i] for i in range(60, 64)] == [0] * 4


def battery_reference(t):
    """(p_random, log_p), with exact normal tails, in plain Python."""
    kinds = [("0123456789", 0.165, False), ("0123456789abcdef", 0.1, True), ("abcdefghijklmnopqrstuvwxyz", 0.065, False), ("abcdefghijklmnopqrstuvwxyz", 0.065, "upper"),
             ("abcdefghijklmnopqrstuvwxyz234567", 0.065, "upper"), ("0123456789abcdefghijklmnopqrstuvwxyz", 0.065, True)]
    full = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds += [(full, 0.065, False), (full + "+/", 0.065, False), (full + "-_", 0.065, False)]
    for alphabet, share, fold in kinds:
        one_case = t in (t.lower(), t.upper()) if fold is True else t == t.upper()
        use = t.lower() if fold and one_case else t
        if set(use) <= set(alphabet) and (one_case or not fold):
            break
    else:
        return None, 0.0
    n, k, x = len(use), len(alphabet), np.array([alphabet.index(c) for c in use], dtype=float)
    chi = k / n * sum(v * v for v in collections.Counter(use).values()) - n
    upper = lambda z: math.erfc(z / math.sqrt(2)) / 2
    high = x >= k / 2
    expected = 1 + 2 * high.sum() * (n - high.sum()) / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    m = x - x.mean()
    z = [((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))),
         (1 + (high[1:] != high[:-1]).sum() - expected) / math.sqrt(variance) if variance > 0 else 8.0,
         ((m[1:] * m[:-1]).sum() / (m * m).sum() + 1 / n) * math.sqrt(n) if (m * m).sum() > 1e-9 else 8.0]
    p = sorted([upper(z[0]), 2 * upper(abs(z[1])), 2 * upper(abs(z[2]))])
    excess = (n - 1) * (k * share - 1)
    over = (k - 1 + excess - chi) / math.sqrt(2 * (k - 1) + 4 * excess)
    return min(3 * p[0], 1.5 * p[1], p[2]), math.log10(max(upper(over), 1e-300))


def test_secret_battery_and_discoveries_equal_plain_python(spark):
    rng = random.Random(21)
    full = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in (full[:16], full[:36], full, full + "+/", full + "-_", full[:10], full[36:]) for n in (16, 33, 64, 400, 3200)]
    texts += ["a" * 20, "ab" * 40, "abcdefghijklmnopqrstuvwxyz", "thequickbrownfoxjumpsoverthelazydog", "some-file_name/with+all", "0" * 16, prose(40, 3).replace(" ", "").replace("é", "e")]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.i: r for r in secret_scan.battery(spark.createDataFrame(rows, "i long, found string"), 0.001).collect()}
    for i, t in rows:
        p, log_p = battery_reference(t)
        assert (p is None) == (got[i].p_random is None)
        if p is not None:
            assert got[i].p_random == pytest.approx(p, abs=0.002)
        if p is None or abs(p - 0.001) > 0.001:
            assert max(got[i].log_p, -290) == pytest.approx(max(log_p, -290) if p is not None and p >= 0.001 else 0.0, abs=0.05)
    assert sum(got[i].log_p < -20 for i, t in rows if len(t) == 3200 and "+" in t or "_" in t and len(t) == 3200) == 2
    tested = [(-rng.random() * 9 if k % 3 == 0 else -rng.random(), 2 ** rng.randrange(4, 7), k) for k in range(900)]
    accepted = set()
    for stratum in (4, 5, 6):
        own = sorted((-(int(min(-p, 30.0) / 0.02)), k) for p, s, k in tested if s == 2**stratum)
        ranks = collections.Counter(b for b, _ in own)
        best, below = None, 0
        for b in sorted(ranks):
            below += ranks[b]
            if 10 ** (0.02 * b) <= 0.1 * below / len(own):
                best = b
        accepted |= {k for b, k in own if best is not None and b <= best}
    assert {r.k for r in secret_scan.discoveries(spark.createDataFrame(tested, "log_p double, size int, k long"), 0.1).collect()} == accepted and 50 < len(accepted) < 850


def test_log_tail_has_no_floor(spark):
    z = [-9.0, -3.0, 0.0, 1.0, 2.9, 3.0, 4.0, 8.0, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(secret_scan.log_tail(F.col("z"))).collect()]
    for x, y in zip(z, got, strict=True):
        assert y == pytest.approx(math.log10(math.erfc(x / math.sqrt(2)) / 2), abs=0.05)
    weak, strong = [(float(-0.3 * (i % 3)), 40, i) for i in range(300)], [(-9.5, 40, 300), (-12.0, 40, 301)]
    huge = spark.createDataFrame(weak + strong, "log_p double, size int, i long")
    assert {r.i for r in secret_scan.discoveries(huge, 1e-7).collect()} == {300, 301}  # 1e-8 is too weak for 2 of 302


# --- language model


@pytest.mark.parametrize("at_once", [2_000_000, 100])
def test_language_model(spark, empty, at_once):
    rows = [*ROWS, *((1000 + i, prose(50, i % 30)) for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit("clash"))

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(ASCII_LOWER)), "\0end"]

    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    n = collections.Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    total, types = sum(n.values()), len(n)
    expected = collections.Counter(
        (d, h, len(tokens(t)), sum(n[w] > 0 for w in tokens(t)), total, round(sum(math.log10((n[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens(t)), 6))
        for (d, t), h in zip(rows, held, strict=True))
    got = pitman_yor.score(df, at_once=at_once).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    again = [r for r in got if r.doc_id is not None and r.doc_id >= 1000]  # texts that others repeat
    assert sum(r.score for r in again) > sum(r.base_score for r in again)
    assert pitman_yor.score(empty).count() == 0


def test_seating_matches_the_process():
    random_ = np.random.default_rng(0)
    n = np.full(4000, 200)
    tables = pitman_yor.seat(n, np.full(4000, 0.5), np.full(4000, 2.0), 0.5, random_)
    slow = []
    for _ in range(1500):
        t = 1
        for i in range(1, 200):
            t += random_.random() < 1.0 / (i - 0.5 * t + 1.0)
        slow.append(t)
    assert abs(tables.mean() - np.mean(slow)) < 0.6
    assert pitman_yor.seat(np.array([0, 1]), np.ones(2), np.ones(2), 0.5, random_).tolist() == [0, 1]


@pytest.mark.parametrize(("n", "pull", "d"), [(20, 2.0, 0.5), (60, 2.0, 0.8), (7, 0.3, 0.1), (100, 8.0, 0.6)])
def test_reseating_matches_a_gibbs_sampler(n, pull, d):
    r, sizes, counts = random.Random(3), [n], []
    for sweep in range(3000):
        for _ in range(n):  # take one customer out, seat it again given all others
            k = r.choices(range(len(sizes)), sizes)[0]
            sizes[k] -= 1
            sizes = [x for x in sizes if x]
            k = r.choices(range(len(sizes) + 1), [*(x - d for x in sizes), pull])[0]
            sizes = [*sizes, 1] if k == len(sizes) else [x + (i == k) for i, x in enumerate(sizes)]
        counts += [len(sizes)] if sweep >= 200 else []
    drawn = pitman_yor.reseat(np.full(20000, n), np.full(20000, pull), d, np.random.default_rng(2))
    assert abs(drawn.mean() - np.mean(counts)) < 0.25 and abs(drawn.std() - np.std(counts)) < 0.25


@pytest.mark.parametrize("d", [0.05, 0.3, 0.5, 0.9])
def test_stirling_rows_by_sum_and_by_recurrence(d):
    sizes, need = np.array([2, 3, 1500, 2500]), np.array([2, 3, 12, 20])
    slow = list(pitman_yor.stirling_rows(sizes, need, d, direct=10**9))
    fast = list(pitman_yor.stirling_rows(sizes, need, d))
    assert np.allclose(np.exp(slow[1]), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    assert all(len(a) == k and np.allclose(a, b, atol=1e-6) for a, b, k in zip(slow, fast, need, strict=True))
    assert d < 0.3 or pitman_yor.stirling_sum(2500, 20, d) is not None


def test_predictive_sums_to_one():
    random_ = np.random.default_rng(1)
    word, context = np.divmod(np.arange(40), 4)
    n = random_.integers(0, 6, 40)
    seen = np.bincount(word, weights=n)
    model = pitman_yor.Model(float(n.sum()), float((seen > 0).sum()), np.bincount(context, weights=n, minlength=256), 0.6, 0.4, 3.0, 1, [])
    before = None
    for _ in range(3):
        tables, u, t = model.step(0, word, 10, context, n, before)
        before = u, t
        model.sweeps.append((np.bincount(context, weights=tables, minlength=256), float(t.sum())))
    p = model.predictive(2, word, context, n, tables, u, t)
    known = (seen > 0)[word]
    rest = model.predictive(2, np.zeros(4, int), np.arange(4), np.zeros(4), np.zeros(4), np.zeros(1), np.zeros(1))
    for c in range(4):
        assert p[known & (context == c)].sum() + rest[c] == pytest.approx(1.0, abs=1e-9)


def plain_gibbs(tokens, d, p, strength, base, sweeps, burn):
    """Averaged probabilities of (word, context) by a sampler that keeps every table and reseats customers one by one."""
    r = random.Random(11)
    under, top = collections.defaultdict(list), collections.defaultdict(list)
    customers, opened, above = collections.Counter(), collections.Counter(), collections.Counter()

    def parent(w):
        rest = (strength + p * above["tables"]) * base
        return (sum(top[w]) - p * len(top[w]) + rest) / (strength + above["sat"])

    def sit(tables, pull, discount):
        k = r.choices(range(len(tables) + 1), [*(x - discount for x in tables), pull])[0]
        if k < len(tables):
            tables[k] += 1
            return False
        tables.append(1)
        return True

    def rise(tables):
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if tables[k]:
            return False
        tables.pop(k)
        return True

    def add(w, c):
        customers[c] += 1
        if sit(under[w, c], (strength + d * opened[c]) * parent(w), d):
            opened[c] += 1
            new = sit(top[w], (strength + p * above["tables"]) * base, p)
            above["tables"] += new
            above["sat"] += 1

    def remove(w, c):
        customers[c] -= 1
        if rise(under[w, c]):
            opened[c] -= 1
            above["tables"] -= rise(top[w])
            above["sat"] -= 1

    for w, c in tokens:
        add(w, c)
    total = collections.Counter()
    cells = {(w, c) for w, _ in tokens for _, c in tokens}
    for sweep in range(sweeps):
        for w, c in tokens:
            remove(w, c)
            add(w, c)
        if sweep >= burn:
            for w, c in cells:
                own = under.get((w, c), [])
                back = (strength + d * opened[c]) * parent(w)
                total[w, c] += (sum(own) - d * len(own) + back) / (strength + customers[c]) / (sweeps - burn)
    return total


def test_score_matches_a_plain_gibbs_sampler():
    r = random.Random(4)
    words = [min(int(r.expovariate(0.25)), 14) for _ in range(500)]
    tokens = [(w, r.randrange(2) if w % 3 else w % 2) for w in words]
    n_words, d, p, strength = max(words) + 1, 0.6, 0.4, 3.0
    types = len(set(words))
    slow = plain_gibbs(tokens, d, p, strength, 1 / (types + 1), 400, 50)
    word, context = np.divmod(np.arange(n_words * 2), 2)
    seen = collections.Counter(tokens)
    n = np.array([seen[w, c] for w, c in zip(word, context, strict=True)])
    customers = np.bincount(context, weights=n, minlength=256)
    model = pitman_yor.Model(float(n.sum()), float(types), customers, d, p, strength, 1, [])
    drawn = []
    for _ in range(40):
        drawn.append(model.step(0, word, n_words, context, n, drawn[-1][1:] if drawn else None))
        tables, _, t = drawn[-1]
        model.sweeps.append((np.bincount(context, weights=tables, minlength=256), float(t.sum())))
    fast = sum(model.predictive(s, word, context, n, *drawn[s]) for s in range(5, 40)) / 35
    exact = np.array([slow[w, c] if (w, c) in slow else np.nan for w, c in zip(word, context, strict=True)])
    off = np.abs(np.log10(fast) - np.log10(exact))
    assert np.nanmean(off[n > 0]) < 0.01 and np.nanmax(off[n > 0]) < 0.05
    assert np.nanmax(off) < 0.2  # cells never met: all cells draw at once here, so small corpora differ a little


def test_query_score_matches_a_plain_gibbs_sampler(spark):
    """Default sweeps and strength, discounts as fitted: the scores of whole texts, learned from and held out."""
    r = random.Random(8)
    texts = [" ".join(f"w{min(int(r.expovariate(0.2)), 30)}" for _ in range(60)) for _ in range(50)]
    got = {x.doc_id: x for x in pitman_yor.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 1}
    places = {i: [(w, c) for t in [[*x.split(), None]] for c, w in zip([None, *t], t, strict=False)] for i, x in enumerate(texts)}
    tokens = [x for i, own in places.items() if i not in held for x in own]
    cells = collections.Counter(tokens)
    contexts = collections.Counter(w for w, _ in cells)
    d, p = (max(0.05, min(0.95, ones / max(ones + 2 * twos, 1))) for ones, twos in (
        [sum(v == k for v in count.values()) for k in (1, 2)] for count in (cells, contexts)))
    slow = plain_gibbs(tokens, d, p, 10.0, 1 / (len(contexts) + 1), 60, 10)
    assert held and len(held) < len(texts)
    for i, own in places.items():
        expected = sum(math.log10(slow[x]) for x in own)
        assert got[i].score == pytest.approx(expected, rel=0.02), i


def test_cells_are_added_up_in_levels(spark):
    """One word in half of all places: no group takes more than some ``fan`` blocks, and the scores do not depend on it."""
    rows = [(i, " ".join(f"hot {i * 7 + k}" for k in range(60))) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(48)
    blocks = pitman_yor.corpus_blocks(df.withColumn("held", F.lit(False)), 300)
    n = blocks.count()
    assert n > 40
    levels = pitman_yor.levels_of(pitman_yor.to_buckets(blocks, 7), n, 4)
    assert len(levels) >= 3
    for level in levels:
        assert level.select(F.max(F.size("from_node"))).first()[0] <= 16
    assert levels[-1].groupBy("bucket").count().filter("count > 1").count() == 0

    def scores(**more):
        return sorted((x.doc_id, x.n_known, x.score) for x in pitman_yor.score(df, **more).collect())

    assert scores(at_once=300, fan=4) == scores(at_once=300) == scores()
