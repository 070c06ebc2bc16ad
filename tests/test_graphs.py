import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.errors import InvalidArgument
from vecmill.functions.tokens import encode
from vecmill.operators.hnsw import Graph, build_graphs, from_bytes, search_graphs, search_graphs_many, to_bytes, update_graphs
from vecmill.operators.metrics import METRICS
from vecmill.types import Hnsw


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(size=(700, 12))


def best(x, q, name, n, ids=None):
    m = METRICS[name]
    s = m.matrix(q[None, :], x)[0]
    c = s if m.greater_is_closer else -s
    return sorted(range(len(x)) if ids is None else ids, key=lambda i: -c[i])[:n]


@pytest.mark.parametrize("name", ["euclidean", "cosine", "dot"])
def test_recall_and_delete(x, name):
    g = Graph(Hnsw(name, 60, 12, 24))
    assert all(g.insert(i, v) for i, v in enumerate(x)) and not g.insert(3, x[0])
    for level, layer in enumerate(g.layers):
        assert all(len(n) <= g._room(level) and i not in n for i, n in layer.items())
    recall = lambda left: np.mean([len({i for _, i in g.nearest(q, 10, 80)} & set(best(x, q, name, 10, left))) / 10 for q in x[:20] + 0.1])
    assert recall(None) > 0.9
    gone = [g.entry, *range(100, 300)]
    assert all(g.delete(i) for i in dict.fromkeys(gone)) and not g.delete(100)
    assert recall([i for i in range(700) if i not in set(gone)]) > 0.85
    for i in list(g.vectors):
        g.delete(i)
    assert g.nearest(x[0], 3) == [] and g.entry is None


@pytest.mark.parametrize("name", ["euclidean", "cosine", "dot"])
def test_filled_graphs_find_as_well_and_deletions_look_at_those_who_name(x, name):
    g = Graph(Hnsw(name, 60, 12, 24))
    g.fill([*range(700), 3], np.concatenate([x, x[:1]]))
    assert len(g.vectors) == 700 and np.array_equal(g.vectors[3], x[3]) and g.entry in g.layers[-1]
    for level, layer in enumerate(g.layers):
        assert all(len(n) <= g._room(level) and i not in n for i, n in layer.items())
    assert np.mean([len({i for _, i in g.nearest(q, 10, 80)} & set(best(x, q, name, 10))) / 10 for q in x[:20] + 0.1]) > 0.9
    read = []

    class Watched(dict):
        def items(self):
            read.append(1)
            return super().items()

    g.layers = [Watched(layer) for layer in g.layers]
    once = len(g.layers)
    for i in range(0, 200):
        g.delete(i)
    assert len(read) == once
    assert all(i >= 200 and all(n in layer for n in others) for layer in g.layers for i, others in layer.items())
    left = range(200, 700)
    assert np.mean([len({i for _, i in g.nearest(q, 10, 80)} & set(best(x, q, name, 10, left))) / 10 for q in x[:20] + 0.1]) > 0.85


def test_filter_passes_through_refused(x):
    ray = np.arange(6000)[:, None] * 0.01 * np.ones((1, 4))
    g = Graph(Hnsw(ef_construction=40, maximum_connections=8, maximum_connections_zero=16))
    for i, v in enumerate(ray):
        g.insert(i, v)
    accept = set(range(200, 6000))
    got = [i for _, i in g.nearest([0.0] * 4, 10, accept=accept)]
    assert len(got) == 10 and accept.issuperset(got) and len(set(got) & set(range(200, 210))) >= 8
    assert [i for _, i in g.nearest([0.0] * 4, 2, accept={5000, 4999, 17})] == [17, 4999] and g.nearest([0.0] * 4, 2, accept=set()) == []


def test_shards(spark, x, tmp_path):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key_id long, key array<double>")
    graphs = build_graphs(rows, f"file://{tmp_path}/g", Hnsw("cosine"), shard_rows=200)
    assert graphs.agg(F.sum("n")).first()[0] == 700 and graphs.count() > 1
    got = [r["key_id"] for r in search_graphs(graphs, x[5], 10).collect()]
    assert got[0] == 5 and len(set(got) & set(best(x, x[5], "cosine", 10))) >= 9
    few = [r["key_id"] for r in search_graphs(graphs, x[5], 10, accept=rows.where("key_id < 4").select("key_id")).collect()]
    assert few == best(x, x[5], "cosine", 4, range(4))
    with pytest.raises(InvalidArgument):
        search_graphs(graphs, x[5], 0)
    with pytest.raises(InvalidArgument):
        Graph(Hnsw(maximum_connections=1))


def test_batch_search_and_changes(spark, x, tmp_path):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key_id long, key array<double>")
    graphs = build_graphs(rows, f"file://{tmp_path}/g", Hnsw("euclidean"), shards=3)
    asked = rows.where("key_id % 50 = 0").select(F.col("key_id").alias("query_id"), F.col("key").alias("query"))

    def recall(graphs, ids):
        got = {}
        for r in search_graphs_many(graphs, asked, 10, 80).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["key_id"]))
        assert all([n for n, _ in sorted(g)] == list(range(1, 11)) for g in got.values()) and len(got) == 14
        return np.mean([len({i for _, i in got[q]} & set(best(every, every[q], "euclidean", 10, ids))) / 10 for q in got])

    every = np.concatenate([x, x[:40] + 0.01])
    assert recall(graphs, range(700)) > 0.95
    change = [(i, [], False) for i in range(100, 200)] + [(700 + i, [float(v) for v in x[i] + 0.01], True) for i in range(40)]
    after = update_graphs(graphs, spark.createDataFrame(change, "key_id long, key array<double>, alive boolean"), f"file://{tmp_path}/h", Hnsw("euclidean"), 3)
    assert after.agg(F.sum("n")).first()[0] == 640
    assert recall(after, [i for i in range(740) if not 100 <= i < 200]) > 0.9
    fresh = update_graphs(graphs.limit(0), spark.createDataFrame(change[-1:], "key_id long, key array<double>, alive boolean"), f"file://{tmp_path}/f", Hnsw("euclidean"), 3)
    assert fresh.first()["n"] == 1


def test_graphs_as_bytes(x):
    g = Graph(Hnsw("cosine", 40, 8, 16))
    assert from_bytes(to_bytes(g)).nearest(x[0], 3) == []
    for i, v in enumerate(x[:200]):
        g.insert(i, v)
    back = from_bytes(to_bytes(g))
    assert (back.settings, back.entry, back.layers) == (g.settings, g.entry, g.layers) and back.nearest(x[300], 5) == g.nearest(x[300], 5)
    assert back.insert(999, x[300]) and back.nearest(x[300], 1)[0][1] == 999


def test_levels_thin_out():
    g = Graph(Hnsw())
    levels = [g.level_of(i * 7919) for i in range(5000)]
    assert levels == [g.level_of(i * 7919) for i in range(5000)] and 0.02 < np.mean(np.array(levels) > 0) < 0.12


def test_tokens():
    class Fake:
        def encode_batch(self, texts, add_special_tokens):
            return [type("E", (), {"ids": [1, *map(len, t.split()), 2]}) for t in texts]

    b = encode(Fake(), ["a bb ccc", "a"], 4)
    assert b.ids.tolist() == [[1, 1, 2, 3], [1, 1, 2, 0]] and b.mask.tolist() == [[1, 1, 1, 1], [1, 1, 1, 0]]
    with pytest.raises(InvalidArgument):
        encode(Fake(), ["a bb ccc"], 4, preprocess=False)
