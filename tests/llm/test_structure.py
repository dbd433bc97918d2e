"""SimHash classes, fill-in-the-middle and conversation repair against plain versions and on odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lateralis.llm import conversation_repair as repair
from lateralis.llm import fill_in_middle, simhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "on", "ti", "é", "sh", "Er"]) for _ in range(r.randint(1, 4))) for _ in range(n))


# --- SimHash


def plain_fingerprint(text):
    w = SPACE.findall((text or "").translate(ASCII_LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    head = list(range(len(fps)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                head[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


TEXTS = [
    None, "", " \t\n\x0b", "one", "one two", "one two three", "ONE  two\tthree", "É è ÀB " * 40, prose(9000, 1), "x" * 5000 + " y z",
    "a b " + "w" * 40, "c" * 31 + " d", *[prose(40, s) for s in range(6)], prose(40, 0) + " more", "w " * 2000, "w " * 2001,
]


def test_fingerprints(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, term int")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


@given(st.lists(st.text(alphabet="ab Zé\n\x85", max_size=80), max_size=6))
@settings(max_examples=60, deadline=None)
def test_hashes_of_ranges(texts):
    import pyarrow as pa

    data, start, length, ptr = simhash.shingle_ranges(pa.array(texts, pa.string()))
    fp = simhash.fingerprints_of(simhash.xxh64(data, start, length), ptr)
    assert [int(x) for x in fp] == [plain_fingerprint(t) for t in texts]


def near_values(seed, centres, each, spread):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for b in r.sample(range(64), r.randint(0, spread)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("values", [
    near_values(1, 150, 4, 3), near_values(2, 3, 120, 4),
    sorted({(0xABCDEF << 40) ^ (x << 8) for x in random.Random(5).sample(range(1 << 16), 400)}),  # one list of six positions
    [0, 1, 2**63, 2**63 + 2**62, 2**64 - 1],
], ids=["pairs", "long lists", "one list", "ends"])
def test_links_lose_none(spark, values):
    signed = [v - 2**64 if v >> 63 else v for v in values]
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want} and len(got) == len(want)


def test_simhash_classes(spark):
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (3, prose(40, 2)), (3, prose(40, 2)), (None, "quite alone here")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, component_id string, bytes int")
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    want = sorted((str(d), f"{f:016x}", str(least[c])) for (d, _), f, c in zip(rows, fps, comp, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_classes(docs).collect())
    assert got == want
    assert simhash.simhash_classes(docs.limit(0)).collect() == []


# --- fill in the middle


def plain_output(key, text, size=None):
    h = [int(sha(f"1:{'' if key is None else key}")[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


FIM = [(i, t) for i, t in enumerate([
    None, "", "x", "ab", "<P>", "a<S>b", "<", "<P", "P>", "S>x<", "<S<M", "é\U0001f600" * 50, "a\x00b", prose(4000, 3), prose(300, 4)] + ["<P S> <M"] * 40)]


@pytest.mark.parametrize("size", [1, 7, 1 << 14])
def test_fill_in_middle(spark, size):
    rows = [r for r in FIM if size > 1 or len(r[1] or "") < 500] + [(None, "no key at all"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, row string, place int").repartition(3)
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256)
                 for r in fill_in_middle.round_trips(docs, size=size).collect())
    want = []
    for d, t in rows:
        form, a, m, out = plain_output(d, t or "")
        want.append((str(d), len(t or ""), form, str(a), str(m), sha(out), sha(t or "")))
    assert got == sorted(want)
    assert fill_in_middle.round_trips(docs.limit(0)).collect() == []


def test_fill_in_middle_pieces(spark):
    docs = spark.createDataFrame(FIM, "doc_id long, text string")
    by_row = {}
    for r in fill_in_middle.transformed(docs, size=100).collect():
        by_row.setdefault((r.row, r.doc_id), []).append((r.place, r.piece))
    assert sorted((d, "".join(p for _, p in sorted(x))) for (_, d), x in by_row.items()) == sorted((d, plain_output(d, t or "")[3]) for d, t in FIM)
    plans = fill_in_middle.round_trips(docs)._jdf.queryExecution().toString()
    assert plans.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1  # restored without a second shuffle


# --- conversation repair


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Uniform-cost search by (cost, audit): the first complete path is the cheapest, then the ASCII-least."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, q) in done:
            continue
        done.add((i, q))
        new = (2, 2, 3, 2)[q]
        role = {2: "user", 3: "assistant"}[new]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new, (*out, (role, rows[i][1]))))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, rows[i][0][:1]))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, rows[i])))


def plain_summary(rows):
    """Of (turn, role, text) rows of one conversation as damaged."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    said = [(r, t) for _, r, t in rows]
    f = faults_of(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
    cost, audit, text = plain_repair(said)
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha(text)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURN = st.tuples(
    st.sampled_from([None, 0, 1, 2, 3, 5, 9]), st.sampled_from(["system", "user", "assistant", "tool", "", None]),
    st.sampled_from(["Hi.", "Well", "ok?", " ", "", None, "a.\n", "a", "é!"]))


def conversations(seed, n):
    r = random.Random(seed)
    return [(c if c else None, *[r.choice(x) for x in (
        [None, *range(6)], ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Hi.", "Well", "ok?", " ", "", None, "a.\n", "é!", "b.", "c."])])
        for c in range(n) for _ in range(r.randint(1, 9))]


def test_repair_of_damaged(spark):
    rows = conversations(1, 120)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, fault int").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in SUMMARY) for r in repair.repaired_summary(repair.damaged(df), df).collect()}
    by_conv = {c: [] for c, *_ in rows}
    for c, *rest in plain_damage(rows):
        by_conv[c].append(tuple(rest))
    assert got == {c: plain_summary(x) for c, x in by_conv.items()}
    assert repair.repaired_summary(repair.damaged(df.limit(0)), df.limit(0)).collect() == []


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=12), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_blocks_walk_as_one(rows, size):
    """Any block size gives the edits of the search over the whole conversation."""
    rows = [{"initial": i, "fault": f, "role": i} for i, f in rows]
    marks, costs = [], repair.AT_END
    for at in range(len(rows) - 1, -1, -1):
        if (at + 1) % size == 0 or at == len(rows) - 1:
            marks.append((at - at % size, costs))
        costs = repair.before(rows[at]["initial"], rows[at]["fault"], costs)
    state, total, audit = 0, 0, ""
    for at, ahead in reversed(marks):
        for edit, cost, _, state in repair.block_edits(rows[at:at + size], ahead, state):
            audit, total = audit + edit, total + cost
    while repair.AT_END[state]:
        audit, total, state = audit + "I", total + 2, repair.NEXT[state]
    said = [(r["role"], r["fault"]) for r in rows]
    assert (total, audit) == search(said)


def search(rows):
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        new = (2, 2, 3, 2)[q]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if rows[i][1] not in ("blank", "duplicate"):
                more = rows[i][1] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, rows[i][0]))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))


def test_long_conversation_in_blocks(spark):
    """One conversation of 6,000 rows: 78 checkpoints, and edits as by the search over all rows."""
    r = random.Random(4)
    said = [(i, r.choice(["user", "assistant", "user", "assistant", "system"]), f"{i % 900} {r.choice(['so.', 'so', ''])}") for i in range(6000)]
    df = spark.createDataFrame([(7, *x) for x in said], "conv_id long, turn long, role string, text string").repartition(4)
    assert repair.checkpoints(repair.coded(df)).count() == -(-6000 // repair.block_size(6000))
    got = repair.summaries(repair.repair(df)).first()
    assert tuple(got[c] for c in SUMMARY[1:]) == plain_summary(said)[1:]
    legal = "".join(e.role[0] for e in repair.repair(df).collect() if e.edit != "D")
    assert re.fullmatch("(s?(ua)+)?", legal)


def test_queries_count(spark):
    from lateralis.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conv.collect()]
    by_conv = {c: [] for c, *_ in rows}
    for c, *rest in plain_damage(rows):
        by_conv[c].append(tuple(rest))
    got = {r.conv_id: tuple(r[c] for c in SUMMARY) for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got == {c: plain_summary(x) for c, x in by_conv.items()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    comp = plain_components(fps)
    least = {}
    for d, c in zip(docs, comp, strict=True):
        least[c] = min(least.get(c, d.doc_id), d.doc_id)
    found = QUERIES["op11_simhash"](spark, folder)
    assert {tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()} == {
        (d.doc_id, f"{f:016x}", least[c]) for d, f, c in zip(docs, fps, comp, strict=True)}
    assert found.select(F.countDistinct("doc_id")).first()[0] == len(docs)
