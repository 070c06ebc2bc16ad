import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.functions.vectors import key_id, l2_normalize, mean_pool, merged, softmax
from vecmill.operators import ivf, search
from vecmill.operators.metrics import METRICS, vector
from vecmill.operators.search import knn_join, recall_at_k, top_n


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(60, 8)) * 5, np.zeros((1, 8))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, "key_id long, key array<float>").repartition(5).cache()


def brute(x, q, m, k):
    s = m.matrix(q[None, :], x)[0]
    c = np.where(np.isnan(s), -np.inf, s if m.greater_is_closer else -s)
    return sorted(range(len(x)), key=lambda i: (-c[i], -i))[:k], s


@pytest.mark.parametrize("name", METRICS)
def test_top_n_and_join_agree_with_numpy(spark, points, name):
    x, rows = points
    m = METRICS[name]
    queries = spark.createDataFrame([(i, [float(v) for v in x[i] + 0.25]) for i in range(12)], "query_id long, query array<double>")
    got = {}
    for r in knn_join(queries, rows, 7, name, keep_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key_id"], r["similarity"]))
    for i in range(12):
        best, s = brute(x, x[i] + 0.25, m, 7)
        assert [k for k, _ in got[i]] == best
        assert np.allclose([v for _, v in got[i]], s[best])
    one = top_n(rows, x[3], 7, name).collect()
    assert [r["key_id"] for r in one] == brute(x, x[3], m, 7)[0]


def test_join_leaves_self_out_and_takes_few_rows(spark, points):
    x, rows = points
    queries = rows.where("key_id < 5").select(F.col("key_id").alias("query_id"), F.col("key").alias("query"))
    got = knn_join(queries, rows.where("key_id < 3"), 10, "euclidean").collect()
    assert all(r["query_id"] != r["key_id"] for r in got) and len(got) == 2 * 3 + 3 * 2
    assert knn_join(queries.limit(0), rows, 3).count() == 0 and knn_join(queries, rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["cosine", "euclidean", "squared_euclidean"])
def test_cells_give_what_one_grid_gives(spark, monkeypatch, name):
    """Cells lose nothing that belongs to the result: of zero, odd and infinite vectors, copies and ties."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 1, 6)) + rng.normal(size=(40, 60, 6)) * 0.02).reshape(-1, 6).astype(np.float32)
    x[100:140] = x[100]
    x[200], x[201] = 0, np.inf
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, None), (5002, [2.0, 1.0])]
    every = spark.createDataFrame(rows, "key_id long, key array<float>").repartition(6).cache()
    queries = every.where("key_id % 5 = 0 or key_id > 4999").select(F.col("key_id").alias("query_id"), F.col("key").alias("query"))
    with monkeypatch.context() as patch:
        patch.setattr(search, "CELLED", ())
        one = sorted(map(repr, knn_join(queries, every, 5, name).collect()))
    with monkeypatch.context() as patch:
        patch.setattr(search, "QUERY_BYTES", 9000)
        assert sorted(map(repr, knn_join(queries, every, 5, name).collect())) == one


def test_leaves_meet_few_rows(monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(100, 1, 16)) + rng.normal(size=(100, 50, 16)) * 0.02).reshape(-1, 16)
    met, kernel = [], search.closest
    monkeypatch.setattr(search, "closest", lambda m, q, r, *rest: met.append(len(q) * len(r)) or kernel(m, q, r, *rest))
    for name in search.CELLED:
        met.clear()
        best = search.Closest({16: (np.arange(0, 5000, 50), x[::50])}, 10, METRICS[name], False)
        best.show_leaves(np.arange(5000), x, np.arange(100))
        got = {}
        for b in best.found():
            for q, r, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(q, []).append((s if METRICS[name].greater_is_closer else -s, r))
        for q in range(0, 5000, 50):
            want = [i for i in brute(x, x[q], METRICS[name], 11)[0] if i != q][:10]
            assert [r for _, r in sorted(got[q], reverse=True)][:10] == want
        assert sum(met) < 100 * 5000 / 4


def test_many_queries_meet_rows_in_a_grid(spark, points, monkeypatch):
    """Blocks of queries by chunks of rows give what one scan gives; vectors of other dimensions and nulls meet nothing."""
    x, rows = points
    odd = spark.createDataFrame([(900, [1.0, 2.0]), (901, None), (902, [2.0, 1.0])], "key_id long, key array<float>")
    every = rows.unionAll(odd)
    queries = every.where("key_id % 7 = 0 or key_id > 899").select(F.col("key_id").alias("query_id"), F.col("key").alias("query"))
    for by in ("euclidean", "dot"):
        one = sorted(tuple(r) for r in knn_join(queries, every, 5, by).collect())
        with monkeypatch.context() as patch:
            patch.setattr(search, "QUERY_BYTES", 900)
            assert sorted(tuple(r) for r in knn_join(queries, every, 5, by).collect()) == one
            assert knn_join(queries, every.limit(0), 5, by).count() == 0


def test_index_measures_its_probes(spark, points, tmp_path):
    """With its defaults, over all rows as queries."""
    _, rows = points
    index = ivf.build(rows, f"file://{tmp_path}/i", "cosine")
    asked = rows.where("key_id < 360").select(F.col("key_id").alias("query_id"), F.col("key").alias("query"))
    truth = knn_join(asked, rows, 10, "cosine", keep_self=True)
    assert 1 <= index.probes <= len(index.centres)
    assert recall_at_k(index.search_many(spark, asked, 10), truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert ivf.build(rows.limit(0), f"file://{tmp_path}/none").search(spark, [1.0], 3).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100, width=32).filter(lambda v: abs(v) > 1e-3), min_size=2, max_size=6))
def test_a_vector_is_closer_to_itself_than_to_its_opposite(spark, v):
    row = spark.range(1)
    for m in METRICS.values():
        a, b = row.select(m.closeness(m.score(vector(v), vector(v))), m.closeness(m.score(vector(v), vector([-x for x in v])))).first()
        assert a > b


def test_index_recall(spark, points, tmp_path):
    x, rows = points
    for by in ("euclidean", "cosine"):
        index = ivf.build(rows, f"file://{tmp_path}/{by}", by, cells=12)
        assert spark.read.parquet(index.path).count() == len(x)
        found = truth = None
        for i in range(0, 300, 30):
            f = index.search(spark, x[i], 10, probes=7).select(F.lit(i).cast("long").alias("query_id"), "key_id")
            t = top_n(rows, x[i], 10, by).select(F.lit(i).cast("long").alias("query_id"), "key_id")
            found, truth = (f, t) if found is None else (found.unionAll(f), truth.unionAll(t))
        assert recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    many = index.search_many(spark, rows.where("key_id % 30 = 0 and key_id < 300").select(F.col("key_id").alias("query_id"), F.col("key").alias("query")), 10, probes=7)
    assert recall_at_k(many, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    # a filter that leaves few rows is answered exactly; probes that hold too few are widened
    few = index.search(spark, x[0], 5, probes=1, where=F.col("key_id") < 4)
    assert few.count() == 4
    assert index.search(spark, x[0], len(x), probes=1).count() == len(x)


def test_filtered_search_in_far_cluster(spark):
    rows = [(i, [(0 if i < 900 else 100) + i * 0.001] * 8) for i in range(1000)]
    df = spark.createDataFrame(rows, "key_id long, key array<float>")
    got = top_n(df, [0.0] * 8, 10, "euclidean", F.col("key_id") >= 900).collect()
    assert [r["key_id"] for r in got] == list(range(900, 910))


def test_plan_prunes_and_limits(spark, points, tmp_path):
    _, rows = points
    rows.withColumn("other", F.lit("x")).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/t")
    plan = top_n(spark.read.parquet(f"{tmp_path}/t").select("key_id", "key", "lang"), [1.0] * 8, 3, where=F.col("lang") == "en")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "other" not in plan.split("== Physical Plan ==")[1] and "EqualTo(lang,en)" in plan


def test_vector_functions(spark):
    one = spark.range(1)
    got = one.select(
        l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("b"),
        mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("c"),
        softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("d"), merged(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("e"),
    ).first()
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [0.0, 0.0] and got["c"] == [2.0, 4.0]
    assert got["d"] == [0.5, 0.5] and got["e"] == {"a": 2, "b": 3}
    # from rows: Spark takes equal literals for one
    zeros = spark.createDataFrame([([0.0],), ([-0.0],)], "k array<float>").select(key_id(F.col("k")).alias("i"))
    assert zeros.distinct().count() == 2
