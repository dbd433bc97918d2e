"""Cases of the findings of round 3: queries against their SQL or against plain versions, on tables made for the case."""

import os
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from lateralis import session
from lateralis.llm import line_dedup, near_dedup
from lateralis.llm.shared import shared_dir
from lateralis.operators import clustering, distances, genes, intervals, likelihood, rooting, similarity, statistics, tree
from lateralis.operators import events as operators
from lateralis.plans import events, inference, phylogeny, relational  # noqa: F401
from lateralis.plans.registry import ORACLE_SQL, QUERIES
from lateralis.session import cut


def against_sql(spark, folder, name, **tables):
    """The query and its SQL on tables given as (rows, schema)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{folder}/{table}.parquet")
    assert_same(QUERIES[name](spark, str(folder)), ORACLE_SQL[name], str(folder))


@pytest.mark.parametrize("price", [[900.0, 900.0, 900.0], [900.0, 901.0, None]])
def test_rescale_score_of_constant_and_missing(spark, tmp_path, price):
    rows = [(f"B{k}", k + i, p) for k, p in enumerate(price) for i in range(k + 2)]
    against_sql(spark, tmp_path, "rescale_score", part=(rows, "p_brand string, p_size int, p_retailprice double"))


def test_interval_overlap_takes_whole_genes(spark, tmp_path):
    genes = [(k, n) for k, n in enumerate([30, 401, 5000, 128_000, 399, 0])]
    assert "n_chars %" not in ORACLE_SQL["interval_overlap"]
    against_sql(spark, tmp_path, "interval_overlap", documents=(genes, "doc_id long, n_chars long"), customer=([(k,) for k in (0, 1, 4, 70, 430)], "c_custkey long"))


@pytest.mark.parametrize("ordered", [False, True])
def test_shared_items_in_lists(spark, ordered):
    rows = [(s, i) for s in range(40) for i in (0, 1 + s % 3, 10 + s)] + [(None, 0), (1, None), (2, None)]
    items = {s: {i for k, i in rows if k == s and i is not None} for s in range(40)}
    want = Counter({(a, b): len(items[a] & items[b]) for a, b in permutations(range(40), 2) if ordered or a < b})
    found = similarity.shared_items(spark.createDataFrame(rows, "s int, i int"), "s", "i", ordered, per_list=3)
    assert Counter({(r.a, r.b): r.n_ab for r in found.collect()}) == want
    assert found.count() == len(want)


def test_tail_of_many_events(spark):
    rows = spark.createDataFrame([(k, 40_000, 20_000 + k, "x", 0.5) for k in range(4)] + [(9, 0, 0, "x", 0.5)], "cluster int, n_events long, observed long, class string, chance double")
    plan = statistics.exact_permutations(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan  # an array of n made anew n times
    p = {r.cluster: r.p for r in statistics.exact_permutations(rows).collect()}
    assert p[0] == pytest.approx(0.5 - 0.5 * 0.00398942, abs=1e-6) and p[9] == 0.0
    assert p[0] > p[1] > p[2] > p[3]


def plain_distances(x, y):
    return [[round(float(np.sqrt(np.cumsum((u - v) ** 2)[-1])), 6) for v in y] for u in x]


def test_distances_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8)).astype("float32").astype(float)
    x[30:] = x[:10]  # copies: a product of matrices alone leaves 1e-8 between them
    x[5] = x[4] + 1e-7
    want = plain_distances(x, x)
    assert distances.rounded_distances(x, x, 6).tolist() == want
    rows = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(40)], "label int, id long, vector array<float>")
    exact = {(a, b): want[a][b] for a in range(40) for b in range(40) if a != b and a % 2 == b % 2 and 5 not in (a, b)}
    found = distances.in_blocks(rows, lambda a, b, d: __import__("pandas").DataFrame([(u, v, d[i, j]) for i, u in enumerate(a) for j, v in enumerate(b) if u != v], columns=["a", "b", "dist"]), "a long, b long, dist double", size=3).collect()
    assert len(found) == 40 * 19 and {(r.a, r.b): r.dist for r in found if 5 not in (r.a, r.b)} == exact


@pytest.mark.parametrize("name", ["nearest_ties", "within_threshold", "medoid", "group_mean_sd", "components", "five_number", "source_summaries", "long_pairs"])
def test_distance_queries_with_copies(spark, tmp_path, name):
    rng = np.random.default_rng(7)
    rows = [(i, (0.2 * rng.normal(size=6)).astype("float32").tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, rows[i % 7 * 3][1], 0) for i in range(20)] + [(500, rows[0][1], 8)]  # copies, and a label of one
    against_sql(spark, tmp_path, name, embeddings=(rows, "vec_id long, embedding array<float>, label int"))


def test_dealt_labels_are_not_broadcast(spark):
    items = spark.range(500).selectExpr("id", "id % 7 AS label")
    dealt = statistics.label_permutations(items, 2, per_part=100)
    assert sorted(r.id for r in dealt.filter("perm = 2").collect()) == list(range(500))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_lone_units_without_a_row_per_unit(spark):
    """op9 and the pipeline: units of members of large buckets are counted packed, not as a row each."""
    rng = np.random.default_rng(5)
    common = rng.integers(1, 1 << 62, 300)
    sets = {n: np.unique(np.concatenate([common[: 280 + n % 20], rng.integers(1, 1 << 62, n % 7)])) for n in range(200)}
    sets[900] = np.zeros(0, np.int64)
    times = Counter(u for x in sets.values() for u in x.tolist())
    df = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "node long, units binary")
    for per_part in (1_000_000, 5000):
        counted = near_dedup.single_units(df, per_part)
        got = {r.node: (r.size, r.lone) for r in counted.collect()}
        assert got == {n: (len(x), sum(times[u] == 1 for u in x.tolist())) for n, x in sets.items()}
        assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_run_keys_of_near_lines_are_few(spark):
    """op10 and the pipeline's line_dedup: lines within their bound share a key, and windows of many lengths share theirs."""
    rng = np.random.default_rng(11)
    words = line_dedup.mix(np.arange(50_000, dtype=np.uint64))
    first = np.arange(0, 50_000 - 200, 200)
    n = rng.integers(16, 200, len(first))
    keys, owner = line_dedup.run_keys(words, first, first + n, 16)
    assert len(keys) < 0.225 * n.sum()  # 0.24 with windows of few lengths, each with keys of its own
    for i in range(len(first)):
        a = words[first[i]:first[i] + n[i]]
        at = rng.choice(len(a), 1 + len(a) // 16, replace=False)
        b = np.where(np.isin(np.arange(len(a)), at), line_dedup.mix(a + np.uint64(1)), a)
        key, own = line_dedup.run_keys(np.concatenate([a, b]), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]), 16)
        assert set(key[own == 0]) & set(key[own == 1])


def test_documents_without_a_row_hash(spark):
    """Only rows whose key occurs again carry the hash that tells them apart."""
    rows = [(k, f"text {k}") for k in range(50)] + [(7, "other"), (None, "a"), (None, "b")]
    got = {(r.doc_id, r.text): r["__row__"] for r in line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert len(got) == 53 and sum(v == 0 for v in got.values()) >= 45
    assert all(got[r] for r in rows if r[0] in (7, None)) and len({got[(7, "other")], got[(7, "text 7")]}) == 2


def test_patristic_within_groups_in_blocks(spark):
    """F8: no row per pair and common ancestor."""
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(1, k)) if k > 3 else None, float(k % 7) + 0.25) for k in range(1, 120)]
    edges = spark.createDataFrame(rows, "edge long, parent_edge long, length double")
    closure = tree.ancestor_closure(edges, cut)
    groups = edges.filter("edge % 5 > 0").selectExpr("edge % 3 AS group", "edge")
    other = groups.withColumnRenamed("edge", "b")
    pairs = groups.withColumnRenamed("edge", "a").join(other, "group").filter("a < b").select("a", "b")
    want = {(r.a, r.b): r.dist for r in tree.patristic(closure, edges, pairs).collect()}
    found = tree.patristic_within(closure, edges, groups, size=9)
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.dist for r in got} == pytest.approx(want)
    assert all(r.a % 3 == r.group for r in got)


def test_genes_before_over_stretches(spark):
    """no window over all genes, no distinct; the gene before may lie in an earlier stretch."""
    parts = [(k, s, s + 5) for k, s in enumerate([0, 7, 40, 95, 300, 5001, 5002 + 9, 90_000])]
    loci = [(k, s, s + n) for k, (s, n) in enumerate([(0, 3), (8, 50), (96, 10), (301, 4600), (301, 89_000), (5002, 1), (89_999, 1), (90_001, 9)])]
    df, p = spark.createDataFrame(loci, "locus int, start int, end int"), spark.createDataFrame(parts, "gene int, start int, end int")
    want = Counter((r.locus, r.gene) for r in intervals.locus_genes(df, p).collect())
    small = intervals.locus_genes(df, p, width=2)
    assert Counter((r.locus, r.gene) for r in small.collect()) == want and max(want.values()) == 1
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [lag(p_start" not in plan and "Deduplicate" not in plan and "Aggregate [locus" not in plan


def test_leaders_in_blocks():
    """the same leaders as one row at a time."""
    def plain(x, close):
        found, out = [], []
        for i, v in enumerate(x):
            d = np.sqrt(((x[found] - v) ** 2).sum(axis=1))
            if len(d) and d.min() <= close:
                out.append(found[int(np.argmin(d))])
            else:
                found.append(i)
                out.append(i)
        return out

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)).astype("float32").astype(float)
    x[300:400] = x[:100]
    for close in (0.0, 1.0, 2.5, 9.0):
        lead = plain(x, close)
        assert clustering.leaders(x, close) == lead and clustering.leaders(x, close, block=7) == lead
        heads = sorted(set(lead))
        want = [heads[int(np.argmin(((x[heads] - v) ** 2).sum(axis=1)))] for v in x]
        assert clustering.nearest(x, np.arange(700), np.array(heads), block=64)[0].tolist() == want
    assert clustering.leaders(np.zeros((0, 8)), 1.0) == []


def test_aligned_distance_of_odd_texts(spark):
    """characters are compared without an array of each text."""
    rows = [("AC-T", "AG-TT"), ("", ""), ("--", "AC"), ("é𝄞A", "é𝄢C"), (None, "A")]
    raw, shared = genes.aligned_distance(F.col("x"), F.col("y"))
    df = spark.createDataFrame(rows, "x string, y string").select(raw.alias("raw"), shared.alias("shared"))
    assert [tuple(r) for r in df.collect()] == [(2, pytest.approx(1 / 3)), (0, None), (2, None), (2, pytest.approx(2 / 3)), (None, None)]
    assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_order_of_keys_is_that_of_all_columns():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, most, 5_000) for most in (2_000, 2, 3, 3, 2, 4)]
    at = line_dedup.order_of(rows)
    assert all((c[at] == c[np.lexsort(rows[::-1])]).all() for c in rows)
    assert line_dedup.order_of([c[:0] for c in rows]).size == 0


def test_documents_of_near_lines_are_removed_before_their_pairs_meet(spark, monkeypatch):
    """The staged documents were kept on disk beside the lines taken from them until the end."""
    seen = []
    plain = line_dedup.several_edits

    def watched(lines, near, per_edit):
        seen.append([name for name in os.listdir(shared_dir(spark).removeprefix("file://")) if "near-documents" in name])
        return plain(lines, near, per_edit)

    monkeypatch.setattr(line_dedup, "several_edits", watched)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20] + ["x"] + words[21:38] + ["y", "z"])), (3, "a line of its own words")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1, near_words=5, per_edit=16)
    assert {r.doc_id: r.deduped.n_dropped for r in out.collect()} == {1: 0, 2: 1, 3: 0}
    assert seen == [[]]


def test_keys_of_lines_are_dealt_packed(spark, monkeypatch):
    """op10 and the pipeline's line_dedup: each key of a line was a row of the shuffle."""
    monkeypatch.setattr(line_dedup, "LEAST_RANGES", 4)
    rows = [(k, 0, f"line {k} of some eight words or so\nthe same words on this line everywhere") for k in range(300)]
    keys = line_dedup.keys(spark.createDataFrame(rows, "d long, row long, text string").coalesce(1), 1, 5, 16, 2)
    assert keys.count() <= 16
    found = line_dedup.shared_keys(keys).groupBy("kind", "line").count().collect()
    assert {(r.kind, r.line): r["count"] for r in found if r.kind == line_dedup.DONE} == {(line_dedup.DONE, 1): 299}


def test_packed_keys_come_back_by_whole_ranges(monkeypatch):
    rng = np.random.default_rng(6)
    wide = [rng.integers(-2**63, 2**63 - 1, 3_000) for _ in range(4)]
    rows = [wide[0], rng.integers(0, 19, 3_000).astype(np.int32), wide[1], wide[2], wide[3], rng.integers(0, 2**31 - 1, 3_000).astype(np.int32)]
    rows = [c[line_dedup.order_of(rows)] for c in rows]
    batch = line_dedup.packed(rows, 6)
    assert batch.num_rows == 64
    monkeypatch.setattr(line_dedup, "COMBINED_ROWS", 300)
    got = list(line_dedup.whole_ranges(batch.slice(i, 7) for i in range(0, 64, 7)))
    assert len(got) > 5 and all((np.concatenate(c) == r).all() for c, r in zip(zip(*got), rows))
    assert not any(set(a[0] >> 58) & set(b[0] >> 58) for a, b in zip(got, got[1:]))


def test_near_pairs_are_those_of_within():
    rng = np.random.default_rng(7)
    pairs = []
    for n in range(400):
        a = rng.choice(list("abcdefghijklmnop"), n % 40).tolist()
        b = [x for w in a for x in {0: [], 1: ["\u00c9x"], 2: [w, "q"]}.get(int(rng.integers(0, 24)), [w])]
        pairs.append((a, b, int(rng.integers(0, 4))))
    want = [line_dedup.within([x.encode() for x in a], [x.encode() for x in b], k) for a, b, k in pairs]
    got = line_dedup.near_pairs(pa.array([" ".join(a) for a, _, _ in pairs]), pa.array([", ".join(b).upper().replace("\u00c9X", "\u00c9x") for _, b, _ in pairs]), np.array([k for *_, k in pairs]))
    assert got.tolist() == want and 50 < sum(want) < 350


def test_parsimony_in_blocks(spark, monkeypatch):
    """small subtrees are gone through within a task, for some features at once; only their roots go by level."""
    rng = np.random.default_rng(9)
    up = {k: int(rng.integers(max(1, k - 30), k)) if k > 3 else None for k in range(1, 150)}
    below = {k: [c for c, p in up.items() if p == k] for k in [None, *up]}
    edges = spark.createDataFrame([(k, p, not below[k]) for k, p in up.items()], "edge long, parent_edge long, is_tip boolean")
    given = {(f, k): int(rng.integers(0, 2)) for f in ("a", "b", "c", "d") for k in up if not below[k]}
    del given["c", next(k for k in up if not below[k])]  # a tip that says nothing of c

    def costs(f, k):  # by the state of k, or None
        if (f, k) in given:
            return [0 if given[f, k] == x else 1 << 30 for x in (0, 1)]
        parts = [c for c in (costs(f, c) for c in below[k]) if c]
        return [sum(min(c[x], c[1 - x] + 1) for c in parts) for x in (0, 1)] if parts else None

    want, roots = {}, {}
    for f in ("a", "b", "c", "d"):
        def down(k, total, f=f):  # total: cost of the whole tree by the state of k
            for c in below[k]:
                own = costs(f, c)
                if own:
                    rest = [total[x] - min(own[x], own[1 - x] + 1) for x in (0, 1)]
                    whole = [own[x] + min(rest[x], rest[1 - x] + 1) for x in (0, 1)]
                    want[f, c] = int(whole[1] < whole[0])
                    down(c, whole)
        first = costs(f, None)
        roots[f] = int(first[1] < first[0])
        down(None, first)
    changes = {(f, k): 1 if v > b else 2 for (f, k), v in want.items() for b in [roots[f] if up[k] is None else want[f, up[k]]] if v != b}
    tips = spark.createDataFrame([(f, k, v) for (f, k), v in given.items()], "feature string, edge long, state int")
    closure = cut(tree.ancestor_closure(edges, cut))
    levels = []
    for block, features in ((2048, 256), (9, 2), (1, 256)):
        monkeypatch.setattr(tree, "BLOCK", block)
        monkeypatch.setattr(tree, "FEATURES", features)
        tables = []
        states, root = tree.parsimony(edges, tips, closure, lambda df, tables=tables: tables.append(0) or cut(df))
        levels.append(len(tables))
        assert {(r.feature, r.edge): r.state for r in states.collect()} == want and states.count() == len(want)
        assert {r.feature: r.root for r in root.collect()} == roots
        found = tree.state_changes(edges, tips, closure, cut).collect()
        assert {(r.feature, r.edge): r.dir for r in found} == changes and len(found) == len(changes)
    assert levels[0] < levels[1] < levels[2]  # as many rounds as levels above the blocks


def test_incomplete_clusters_in_tasks_of_few_rows(spark, monkeypatch):
    """ids of a cluster were counted, all distinct ones, in as many tasks as the session has partitions."""
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    members = spark.createDataFrame([(k % 3, k) for k in range(200)] * 2 + [(0, None), (2, 7)], "cluster int, gene_id long")
    seqs = spark.createDataFrame([(k, "A") for k in range(200) if k % 4] + [(9, "C"), (10, None)], "gene_id long, seq string")
    rows = genes.cluster_sequences(members, seqs)
    assert rows.rdd.getNumPartitions() == 21
    found = genes.incomplete_clusters(rows)
    by = [{(c, g) for c, g in members.collect() if c == k} for k in range(3)]
    have = Counter(r.gene_id for r in seqs.collect() if r.seq)
    want = {(k, sum(g is not None for _, g in ids), sum(have[g] for _, g in ids)) for k, ids in enumerate(by)}
    assert {tuple(r) for r in found.collect()} == {w for w in want if w[1] != w[2]}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 3


def test_ancestors_before_of_all_features_in_tasks_of_few_rows(spark, monkeypatch):
    """the ways met the gains of each feature by themselves, in as many tasks as the session has partitions."""
    rng = np.random.default_rng(3)
    up = {k: int(rng.integers(1, k)) if k > 3 else None for k in range(1, 80)}
    edges = spark.createDataFrame(list(up.items()), "edge long, parent_edge long")
    gains = [(i, int(e)) for i in range(3) for e in rng.choice(79, 4 * i, replace=True) + 1]
    closure = tree.ancestor_closure(edges, cut)
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    found = rooting.ancestors_before(
        closure, spark.createDataFrame(gains, "feature int, edge long"), spark.createDataFrame([(i,) for i in range(3)], "feature int"))
    assert found.rdd.getNumPartitions() == -(-closure.count() // 40) > 4
    want = set()
    for i in range(3):
        for e in up:
            at, depth = e, 1
            while at is not None and (depth == 1 or (i, at) not in gains):
                want.add((i, e, at, depth))
                at, depth = up[at], depth + 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_likelihood_of_blocks_of_a_tree_is_that_of_levels(spark, monkeypatch):
    """every node of every pair of rates was shuffled by level; now the roots of the blocks and what is above them."""
    rng = np.random.default_rng(8)
    up = {k: int(rng.integers(max(1, k // 2 - 3), k)) if k > 3 else None for k in range(1, 90)}
    inner = set(up.values())
    edges = spark.createDataFrame([(k, p, float(k % 5) / 4) for k, p in up.items()], "edge long, parent_edge long, length double")
    df = spark.createDataFrame([(f, k, int((k * (f + 3)) % 7 < 3)) for f in range(2) for k in up if k not in inner] + [(2, 89, 1)], "feature int, edge long, state int")
    closure = tree.ancestor_closure(edges, cut)
    sent, plain = [], likelihood.block_roots

    def watched(blocks, rates, keys):
        sent.append((blocks.filter("edge = block").count(), blocks.count()))
        return plain(blocks, rates, keys)

    monkeypatch.setattr(likelihood, "block_roots", watched)
    got = {}
    for size in (1, 12, 2048):  # of one edge: by levels; of 2048: whole subtrees of the root
        monkeypatch.setattr(likelihood, "BLOCK", size)
        found, root = likelihood.likelihood_states(edges, df, closure, cut, rounds=2)
        got[size] = {(r.feature, r.edge): (r.state, r.p1) for r in found.collect()} | {r.feature: (r.root, r.p1, r.gain, r.loss) for r in root.collect()}
    assert sent[0][0] == sent[0][1] and sent[-1][0] < sent[-1][1] and len(got[1]) == 3 * len(up) + 3
    for k, want in got[1].items():
        for size in (12, 2048):
            assert [v is None for v in got[size][k]] == [v is None for v in want]
            assert [v or 0 for v in got[size][k]] == pytest.approx([v or 0 for v in want], abs=1e-9)


def test_summaries_in_strips(spark, tmp_path):
    """F2, F3 of round 4: no row per pair leaves a task; ids that occur again, in one label or in two, are summed up together."""
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), i % 3) for i in range(70)] + [(i, rng.normal(size=6).astype("float32").tolist(), i % 2) for i in (4, 5, 9)] + [(900, [0.0] * 6, 7)]
    for name in ("in_out_group", "source_summaries"):
        against_sql(spark, tmp_path, name, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    v = spark.createDataFrame([(l, i, x, i % 4, True) for i, x, l in rows[:70]], "label int, id long, vector array<float>, grp long, taken boolean")
    whole = distances.strip_numbers(v, {"median": 0.5})
    strips = distances.strip_numbers(v, {"median": 0.5}, size=5)
    assert sorted(map(tuple, strips.collect())) == sorted(map(tuple, whole.collect())) and strips.count() == 70


def test_long_pairs_are_not_shuffled(spark, tmp_path):
    """F1 of round 4: the flags are known before pairs are made; missing states and facilities, and ids that occur again."""
    rng = np.random.default_rng(17)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), i % 3) for i in range(40)] + [(i, rng.normal(size=6).astype("float32").tolist(), i % 2) for i in (4, 5, 9)] + [(900, [0.0] * 6, 7)]
    against_sql(spark, tmp_path, "long_pairs", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    plan = QUERIES["long_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("FlatMapGroups") and plan.index("Aggregate") > plan.index("FlatMapGroups")  # all below what makes the pairs
    meta = [(i, None if i % 5 == 0 else "s" + str(i % 2), None if i % 3 == 0 else i % 4) for i in range(13)]
    v = spark.createDataFrame([(0, i, [float(i), 1.0], s, f) for i, s, f in meta], "label int, id long, vector array<float>, state string, facility int")
    pairs = distances.block_pairs(v.select("label", "id", "vector"))
    want = operators.long_pairs(pairs, v.select("id", "state", "facility"))
    assert sorted(map(str, operators.label_pairs(v).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("dense", [1 << 24, 10])
def test_five_numbers_without_a_row_per_pair(spark, tmp_path, monkeypatch, dense):
    """F8 of round 4: equal distances are counted within a task; ids that occur again, a label of one, long distances."""
    monkeypatch.setattr(distances, "DENSE", dense)
    rng = np.random.default_rng(19)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), i % 3) for i in range(70)] + [(4, [0.5] * 6, 1), (900, [0.0] * 6, 7)]
    against_sql(spark, tmp_path, "five_number", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    v = spark.createDataFrame([(l, i, [1000.0 * z for z in x]) for i, x, l in rows], "label int, id long, vector array<float>")
    want = {r.label: r for r in distances.five_numbers(distances.block_pairs(v).filter("a < b"), ["label"], "dist").collect()}
    chunks = distances.pair_histogram(v, size=9)
    assert chunks.agg(F.sum("n")).first()[0] == 3 * 23 * 11 + 23 + 23 - (0 if 4 % 3 != 1 else 1)
    found = distances.block_five_numbers(v, cut, size=9).collect()
    assert {r.label for r in found} == set(want) == {0, 1, 2}
    for r in found:
        assert list(r)[1:] == pytest.approx([want[r.label][c] for c in ("min", "q1", "median", "mean", "q3", "max")], rel=1e-12)


def test_sets_meet_in_ranges(spark, monkeypatch):
    """F7 of round 4: an item's sets are sent once to a range of sets and not once for each set; sizes come with them."""
    monkeypatch.setattr(similarity, "TASK_PAIRS", 50)
    rng = np.random.default_rng(23)
    rows = sorted({(int(s) + 30 * c, int(i) + 10 * c) for c in range(4) for s, i in zip(rng.integers(0, 30, 150), rng.integers(0, 12, 150))}) + [(7, None), (None, 3)]
    items = {s: {i for k, i in rows if k == s and i is not None} for s, _ in rows if s is not None}
    df = spark.createDataFrame(rows, "s int, i int")
    for ordered in (False, True):
        want = {(a, b): (len(items[a] & items[b]), len(items[a]), len(items[b])) for a, b in permutations(items, 2) if (ordered or a < b) and items[a] & items[b]}
        found = similarity.counted_pairs(df, "s", "i", ordered, per_list=5)
        got = found.collect()
        assert {(r.a, r.b): (r.n_ab, r.n_a, r.n_b) for r in got} == want and len(got) == len(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [range" in plan and "RepartitionByExpression [a" not in plan


def test_patristic_sends_a_way_once_a_large_block(spark):
    """F6 of round 4: a block has far more edges than pairs are made at once, so a way is sent to few tasks."""
    rng = np.random.default_rng(29)
    rows = [(k, int(rng.integers(1, k)) if k > 3 else None, None if k == 50 else float(k % 7) + 0.25) for k in range(1, 700)]
    edges = spark.createDataFrame(rows, "edge long, parent_edge long, length double")
    closure = cut(tree.ancestor_closure(edges, cut))
    groups = edges.selectExpr("0 AS group", "edge")
    found = tree.patristic_within(closure, edges, groups)
    explain = found._jdf.queryExecution().analyzed().toString()
    assert groups.count() > 512 and "/ cast(8192 as double)" in explain  # one block; two of 512 before
    small = tree.patristic_within(closure, edges, groups, size=100, cells=64)
    one, many = ({(r.a, r.b): r.dist for r in df.collect()} for df in (found, small))
    assert len(one) == 699 * 698 // 2 and one == pytest.approx(many, nan_ok=True)
    assert small.count() == len(one)
