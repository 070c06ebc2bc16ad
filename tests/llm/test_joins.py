import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.llm.blocks import forest, joining_edges
from vecmill.llm.common import BATCH_BYTES, _settle, connected_components, first_by_hash, in_batches
from vecmill.llm.ngram_join import Shingler, common_counts, hashers, lsh_forest, min_hashes, ngram_join, verify
from vecmill.llm import nn_descent
from vecmill.llm.nn_descent import near_duplicates
from vecmill.llm.spotsigs import similar_pairs


def groups(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_components(spark, few):
    """By rounds alone, by some and one task for the rest, in one task."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t", few=few).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
    chain = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    assert [r[0] for r in connected_components(chain, "t", few=few).select("component").distinct().collect()] == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=1, max_size=60), st.integers(1, 60))
def test_settle(pairs, cut):
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in p], pa.int64()), pa.array([b for _, b in p], pa.int64())], ["a", "b"]) for p in (pairs[:cut], pairs[cut:])]
    (got,) = _settle(iter(batches))
    assert dict(zip(got.column("id").to_pylist(), got.column("to").to_pylist(), strict=True)) == groups({x for p in pairs for x in p}, pairs)


def test_batches_are_bounded(spark):
    """By 4 MB, or by what the session says; a row longer than that is a batch alone."""
    rows = spark.range(3000).selectExpr("id", "repeat('x', case when id = 7 then 9000000 else 3000 end) as t").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    was = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        got = in_batches(rows, sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 3000 and all(r["bytes"] < 5 << 20 for r in got if r["bytes"] < 9_000_000) and len(got) > 2
        spark.conf.set(BATCH_BYTES, str(1 << 20))
        assert max(r["n"] for r in in_batches(rows, sizes, "n long, bytes long").collect()) < 400
    finally:
        spark.conf.set(BATCH_BYTES, was)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=20), min_size=1, max_size=8))
def test_common_counts(sets):
    arrays = [np.array(sorted(s), np.uint32) for s in sets]
    got = common_counts(arrays, columns=7)  # what a set shares with itself does not matter
    assert all(got[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20))
def test_forest(n, pairs):
    linked = np.zeros((n, n), bool)
    for a, b in pairs:
        if a < n and b < n and a != b:
            linked[a, b] = linked[b, a] = True
    parent = forest(linked)
    assert all(p == i or linked[i, p] for i, p in enumerate(parent))
    edges = [(i, j) for i in range(n) for j in range(n) if linked[i, j]]
    assert groups(range(n), [(i, int(p)) for i, p in enumerate(parent)]) == groups(range(n), edges)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(2, 4), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=30))
def test_edges_of_units_join_what_is_linked(n, blocks, pairs):
    """All units together give the components, each unit of two blocks fewer edges than the blocks have components."""
    linked = np.zeros((n, n), bool)
    for a, b in pairs:
        if a < n and b < n and a != b:
            linked[a, b] = linked[b, a] = True
    own, edges = np.arange(n) % blocks, []
    for i in range(blocks):
        for j in range(i, blocks):
            at = np.flatnonzero((own == i) | (own == j))
            parent = joining_edges(linked[np.ix_(at, at)], own[at])
            given_ = [(int(at[x]), int(at[p])) for x, p in enumerate(parent) if p >= 0]
            assert all(linked[a, b] and (i == j or own[a] != own[b]) for a, b in given_) and len(given_) < max(1, len(at))
            edges += given_
    assert groups(range(n), edges) == groups(range(n), [(i, j) for i in range(n) for j in range(n) if linked[i, j]])


@pytest.mark.parametrize("size", [300, 600, 1200])
def test_edges_are_as_many_as_the_members_of_a_group(size, block=192):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 32, 300, np.uint32)
    sets = [np.unique(np.concatenate([base[: 300 - k % 5], rng.integers(0, 1 << 32, k % 5, np.uint32)])).tobytes() for k in range(size)]
    own, count = rng.integers(0, -(-size // block), size), 0
    for i in range(own.max() + 1):
        for j in range(i, own.max() + 1):
            at = np.flatnonzero((own == i) | (own == j))
            t = pa.table({"i": [i] * len(at), "j": [j] * len(at), "id": at, "own": own[at], "weight": [1] * len(at), "was": at, "shingles": [sets[k] for k in at]})
            got = verify(0.8)(t)
            count += int((got["id"] != got["parent"]).sum())
    assert size - 1 <= count < 2 * size


def test_tries_hold_all_common_prefixes(spark):
    """For every level, what shares a prefix of so many values in some tree hangs together, and nothing else."""
    rng, trees, depth = np.random.default_rng(4), 3, 4
    signatures = {n: rng.integers(0, 3, (trees, depth)).astype(">u2") for n in range(90)}
    df = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in signatures.items()] * 2, "node long, signature binary").repartition(5)
    edges = [tuple(r) for r in lsh_forest(df, trees, depth, 2).collect()]
    for level in (2, 3, 4):
        same = [(a, b) for a in signatures for b in signatures if a < b and (signatures[a][:, :level] == signatures[b][:, :level]).all(1).any()]
        assert groups(signatures, [(a, b) for x, a, b in edges if x >= level]) == groups(signatures, same)
    assert len(edges) <= trees * 2 * len(signatures) and lsh_forest(df.limit(0), trees, depth, 2).count() == 0


def test_min_hashes_estimate_likeness():
    rng = np.random.default_rng(1)
    mult, add = hashers(512)
    a = rng.integers(0, 1 << 32, 400, np.uint32)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 32, 80, np.uint32)])
    same = (min_hashes(a, mult, add) == min_hashes(b, mult, add)).mean()
    assert same == pytest.approx(320 / 480, abs=0.08)


def test_ngram_join(docs, corpus, nothing):
    got = {}
    for r in ngram_join(docs, block=4).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"], r["component_id"], r["kept"]))
    shingler = Shingler()
    sets = [(i, frozenset(shingler.set_of(t or "").tolist())) for i, t, *_ in corpus]
    linked = [(n, m) for n in range(len(sets)) for m in range(len(sets)) if n != m and sets[n][1] and len(sets[n][1] & sets[m][1]) >= 0.8 * len(sets[n][1] | sets[m][1])]
    label = groups({i for i, _ in sets}, [(sets[n][0], sets[m][0]) for n, m in linked])
    for n, (i, s) in enumerate(sets):
        same = min([j for j, other in sets if other == s and s] or [i])
        assert (same, sum(a == n for a, _ in linked), label[i], label[i] == i) in got[i]
    assert sum(map(len, got.values())) == len(corpus)
    assert ngram_join(nothing).count() == 0


def test_ngram_join_shortens_prefixes(docs):
    """A forest of few, deep trees misses links until its prefixes are shortened; what was reached is told."""
    report, deep = {}, {}
    whole = {(r["doc_id"], r["component_id"]) for r in ngram_join(docs, report=report).collect()}
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join(docs, trees=10, depth=12, shortest=3, report=deep).collect()} == whole
    assert report["level"] <= 7 and report["chance"] >= 0.999 and (report["found_before"] is None or report["found_before"] >= 0.999)
    assert deep["level"] <= 3 and deep["chance"] >= 0.999
    with pytest.raises(RuntimeError):
        ngram_join(docs, trees=2, depth=12, shortest=8)


def test_ngram_join_finds_pairs_that_long_prefixes_miss(spark):
    """Isolated pairs of likeness 0.81 that meet first at a prefix of 7, and of 6, values."""
    rng, shingler, (mult, add), wanted, rows = random.Random(5), Shingler(), hashers(256), {7: 2, 6: 1}, []
    for _ in range(60_000):
        if not any(wanted.values()):
            break
        base = [f"w{rng.getrandbits(40)}" for _ in range(64)]
        texts = [" ".join(base), " ".join(base[:58] + [f"w{rng.getrandbits(40)}" for _ in range(6)])]
        same = (np.stack([min_hashes(shingler.set_of(t), mult, add) for t in texts]).reshape(2, 32, 8)).astype(int)
        longest = int(np.cumprod(same[0] == same[1], 1).sum(1).max())
        if wanted.get(longest):
            wanted[longest] -= 1
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    assert len(rows) == 6
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (1, i - i % 2) for i in range(6)}


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (5, "other words that nobody else has here")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join(df).collect()}
    assert got == {None: (1, None), 4: (1, None), 5: (0, 5)}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    rows = [rng.normal(size=16) for _ in range(150)]
    for group in range(4):  # near copies: pairs, triples, and a group larger than any list
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * 0.05 for _ in range((2, 3, 5, 90)[group])]
    rows += [rows[0] * 3, rows[0] * 3, rows[1], rows[1]]
    data = [(i * 2, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    data += [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, []), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (1009, [1e-30] * 16), (1010, [1e30] * 16)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)


def test_near_duplicates(vectors):
    data, df = vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, size=4, largest=8, block=24, leaf=16).collect()}
    unit = {}
    for i, v in data:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            w = np.array(v, float) / max(map(abs, v))
            unit[i] = w / np.linalg.norm(w)
    edges = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    label = groups([i for i, _ in data], edges)
    want = {i: (sum(a == i for a, _ in edges), label[i], label[i] == i) for i, _ in data}
    assert {i: w for i, w in want.items() if got[i] != w} == {}
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_with_clashing_columns_and_shared_ids(spark):
    """Rows that share an id are vectors of their own; null ids take part and come back null; other columns do not matter."""
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(None, a), (3, a), (3, [2.0, 0.0, 0.2]), (5, b), (6, [0.0, 1.0, 0.0]), (9, [-1.0, -1.0, 4.0]), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("id", "v", "ok", "dim", "weight", "g", "h", "n_links", "component", "label"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    # copies are vectors apart from one another; a null id is the smallest, so the group around it has no id to show
    want = [(3, 2, None, False)] * 2 + [(5, 1, 5, True), (6, 1, 5, False), (9, 0, 9, True), (9, 0, 9, True), (None, 2, None, True)]
    assert got == sorted(want, key=repr)
    assert near_duplicates(df).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_ngram_join_with_clashing_columns_and_shared_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (2, text.upper() + "!"), (3, "alone " + text * 3), (None, None), (4, "")], "doc_id long, text string")
    for name in ("id", "digest", "n", "signature", "shingles", "node", "cluster", "rep", "weight", "tree", "level"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted((tuple(r) for r in ngram_join(df).collect()), key=repr)
    assert got == sorted([(1, 1, 2, 1, True), (1, 1, 2, 1, True), (2, 1, 2, 1, False), (3, 3, 0, 3, True), (4, 4, 0, 4, True), (None, None, 0, None, True)], key=repr)


def test_dense_leaves_give_few_pairs():
    """Members with many links in their own block name one neighbour of each other block, others a list."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((60, 8)) + rng.normal(size=(60, 8)) * 0.01, rng.normal(size=(4, 8))])
    one = {"id": np.arange(64), "own": np.arange(64) % 2, "v": pa.array(x.tolist())}
    got = nn_descent._nearest(8, -1.0, (0.9, 20))(pa.table(one | {"i": [0] * 64, "j": [1] * 64}))
    counts = np.bincount(got["id"], minlength=64)
    assert set(counts[:60]) == {1} and set(counts[60:]) == {8}
    assert all((a - b) % 2 for a, b in zip(got["id"], got["other"], strict=True))
    within = nn_descent._nearest(8, -1.0, (0.9, 20))(pa.table(one | {"i": [0] * 64, "j": [0] * 64}))
    assert set(np.bincount(within["id"])) == {8}


def test_lists_that_fill_in_the_last_round(vectors, monkeypatch):
    """They were not enlarged any more, so their group is counted in blocks."""
    monkeypatch.setattr(nn_descent, "_recall", lambda *a: 1.0)
    links = {r["vec_id"]: r["n_links"] for r in near_duplicates(vectors[1], size=4, largest=8, block=24, leaf=16, rounds=1).collect()}
    assert [links[2 * i] for i in range(160, 250)] == [89] * 90


def test_audit_counts_each_vector_once(spark, vectors, monkeypatch):
    """Members of a dense group do not hide that isolated pairs are missed, and what is missed is never returned."""
    truth = {i: 5000 for i in range(90)} | {1000 + i: 1 for i in range(10)}
    links = spark.createDataFrame([(i, 5000, 5000) for i in range(90)] + [(1000, 1, 1)], "id long, links long, pairs long")
    assert nn_descent._recall(links, truth, 16) == pytest.approx(0.1)
    monkeypatch.setattr(nn_descent, "_recall", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        near_duplicates(vectors[1], size=4, largest=8, block=24, leaf=16, rounds=1, extra_forests=0)


def test_similar_pairs(spark):
    rng, sets = random.Random(2), []
    for _ in range(30):
        base = rng.sample(range(1000), rng.randint(1, 25))
        sets += [sorted(base), sorted({*base[: max(1, len(base) - 1)], rng.randint(0, 1000)})]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(map(list, dict.fromkeys(map(tuple, sets))))], "id long, sigs array<long>")
    rows = {r["id"]: set(r["sigs"]) for r in df.collect()}
    want = {(a, b) for a in rows for b in rows if a < b and len(rows[a] & rows[b]) >= 0.6 * len(rows[a] | rows[b])}
    assert {(r["a"], r["b"]) for r in similar_pairs(df, 0.6).collect()} == want and want


def test_first_by_hash(spark):
    rows = spark.range(5000)
    some = {r["id"] for r in first_by_hash(rows, "id", 50, 5000).collect()}
    assert len(some) == 50 and some == {r["id"] for r in first_by_hash(rows.repartition(7), "id", 50, 5000).collect()}
    assert some <= {r["id"] for r in first_by_hash(rows, "id", 200, 5000).collect()}
    assert first_by_hash(rows, "id", 9000, 5000).count() == 5000 and first_by_hash(rows.limit(0), "id", 5, 0).count() == 0
