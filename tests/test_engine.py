"""Commands on small stores, with the expected numbers of the service's own tests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.errors import AlreadyExists, DimensionMismatch, EngineError, InvalidArgument, NonLinearIndexNotFound, PredicateNotFound, StoreNotFound, UpsertMismatch
from vecmill.operators.predicates import And, Equals, In, NotEquals, NotIn, Or
from vecmill.plans.engine import Count, Engine, SetResult
from vecmill.types import Hnsw, KdTree, image

MEDALS = [([1.2, 1.3, 1.4], {"medal": "silver"}), ([2.0, 2.1, 2.2], {"medal": "gold"}), ([5.0, 5.1, 5.2], {"medal": "bronze"})]


@pytest.fixture
def medals(spark):
    e = Engine(spark)
    e.create_store("main", 3, ["medal"], [KdTree()])
    assert e.set("main", MEDALS) == SetResult(3, 0)
    return e


def said(df, name="medal"):
    return [r["value"][name]["str"] for r in df.select("value").collect()]


def scored(df):
    return [(r["value"]["medal"]["str"], pytest.approx(r["similarity"], abs=1e-5)) for r in df.collect()]


def test_similarity(medals):
    got = lambda *a: [(m, s) for m, s in scored(medals.get_sim_n("main", *a))]
    assert got([5.0, 2.1, 2.2], 2, "cosine", Equals("medal", "gold")) == [("gold", 0.90363388)]
    assert got([1.0, 2.1, 2.2], 2, "dot") == [("bronze", 27.149998), ("gold", 11.25)]
    assert got([1.0, 2.1, 2.2], 2, "euclidean") == [("gold", 1.0), ("silver", 1.14891253)]
    assert got([5.0, 2.1, 2.2], 1, "cosine", NotEquals("medal", "gold")) == [("bronze", 0.91193725)]
    assert got([1.1, 2.0, 3.0], 2, "kdtree") == [("gold", 1.4599998), ("silver", 3.0600002)]
    assert got([5.0, 2.1, 2.2], 2, "kdtree", Equals("medal", "gold")) == [("gold", 9.0)]
    assert len(got([5.0, 2.1, 2.2], 99, "cosine")) == 3


def test_search_errors(medals):
    for error, args in (
        (StoreNotFound, ("none", [1.0], 1)), (DimensionMismatch, ("main", [1.0], 1)), (InvalidArgument, ("main", [1.0, 2.0, 3.0], 0)),
        (NonLinearIndexNotFound, ("main", [1.0, 2.0, 3.0], 1, "hnsw")), (InvalidArgument, ("main", [1.0, 2.0, 3.0], 1, "odd")),
    ):
        with pytest.raises(error):
            medals.get_sim_n(*args)


def test_ties_zero_and_signed_zero(spark):
    e = Engine(spark)
    e.create_store("s", 2)
    assert e.set("s", [([0.0, 0.0], {"n": "zero"}), ([-0.0, 0.0], {"n": "minus"}), ([1.0, 0.0], {"n": "a"}), ([2.0, 0.0], {"n": "b"})]) == SetResult(4, 0)
    first = [r["value"]["n"]["str"] for r in e.get_sim_n("s", [1.0, 0.0], 4, "cosine").collect()]
    assert set(first[:2]) == {"a", "b"} and set(first[2:]) == {"zero", "minus"}
    assert first == [r["value"]["n"]["str"] for r in e.get_sim_n("s", [1.0, 0.0], 4, "cosine").collect()]
    assert said(e.get_key("s", [[-0.0, 0.0]]), "n") == ["minus"]


def test_set_rules(spark):
    e = Engine(spark)
    e.create_store("main", 3, ["role"])
    assert e.set("main", [([1.23, 1.0, 0.2], None)]) == SetResult(1, 0)
    with pytest.raises(DimensionMismatch):
        e.set("main", [([1.0, 2.0, 3.0], {}), ([2.1], {})])
    assert e.rows("main").count() == 1
    assert e.set("main", [([1.23, 1.0, 0.2], {"role": "headmaster"}), ([0.03, 5.1, 3.23], {}), (None, {"role": "lost"})]) == SetResult(1, 1)
    assert said(e.get_pred("main", Equals("role", "headmaster")), "role") == ["headmaster"]
    e.set("main", [([9.0, 9.0, 9.0], {"role": "first"}), ([9.0, 9.0, 9.0], {"role": "last"})])
    assert said(e.get_key("main", [[9.0, 9.0, 9.0]]), "role") == ["last"]
    assert e.get_pred("main", Equals("role", "first")).count() == 0
    assert e.set("main", []) == SetResult(0, 0)


def test_getkey_order(spark):
    e = Engine(spark)
    e.create_store("m", 2)
    e.set("m", [([1.0, 0.2], {"k": "sorcerer"}), ([1.2, 0.3], {"k": "elf"})])
    assert said(e.get_key("m", [[1.2, 0.3], [0.4, 0.6], [1.0, 0.2], [1.2, 0.3]]), "k") == ["elf", "sorcerer", "elf"]
    assert e.get_key("m", []).count() == 0
    with pytest.raises(DimensionMismatch):
        e.get_key("m", [[1.2, 0.3], [1.0, 2.0, 3.0]])


def test_deletes(spark):
    e = Engine(spark)
    e.create_store("p", 2)
    assert e.del_pred("p", Equals("planet", "earth")) == Count(0)
    e.set("p", [([1.4, 1.5], {"planet": "jupiter"}), ([1.6, 1.7], {"planet": "mars"})])
    assert e.del_pred("p", NotEquals("planet", "mars")) == Count(1)
    assert e.del_key("p", [[1.6, 1.7], [1.6, 1.7], [0.0, 0.0]]) == Count(1)
    assert e.del_key("p", []) == Count(0)
    assert e.rows("p").count() == 0
    with pytest.raises(DimensionMismatch):
        e.del_key("p", [[1.0]])


def test_upsert(spark):
    e = Engine(spark)
    e.create_store("u", 3, ["id"])
    e.set("u", [([1.0, 2.0, 3.0], {"id": "123", "name": "Alice", "age": "30"}), ([4.0, 5.0, 6.0], {"id": "9"})])
    values = lambda i: {k: v["str"] for k, v in e.get_pred("u", Equals("id", i)).first()["value"].items()}
    assert e.upsert("u", Equals("id", "123"), None, {"name": "Bob"}, True) == SetResult(0, 1)
    assert values("123") == {"id": "123", "name": "Bob", "age": "30"}
    e.upsert("u", Equals("id", "123"), [7.0, 8.0, 9.0])
    assert e.get_key("u", [[1.0, 2.0, 3.0]]).count() == 0 and values("123")["name"] == "Bob"
    e.upsert("u", Equals("id", "123"), None, {"id": "123"})
    assert values("123") == {"id": "123"}
    for error, args in (
        (InvalidArgument, (Equals("id", "123"),)), (UpsertMismatch, (Equals("id", "none"), None, {"a": "b"})), (UpsertMismatch, (NotEquals("id", "none"), None, {"a": "b"})),
        (DimensionMismatch, (Equals("id", "123"), [1.0])), (UpsertMismatch, (Equals("id", "123"), [4.0, 5.0, 6.0])),
    ):
        with pytest.raises(error):
            e.upsert("u", *args)
    assert e.rows("u").count() == 2  # nothing was lost on the way


@pytest.mark.parametrize("semantics", ["direct", "indexed"])
def test_missing_keys(spark, semantics):
    e = Engine(spark, semantics=semantics)
    e.create_store("s", 1, ["k"])
    e.set("s", [([1.0], {"k": "a", "n": "1"}), ([2.0], {"k": "b", "n": "2"}), ([3.0], {"n": "3"})])
    got = lambda c: sorted(said(e.get_pred("s", c), "n"))
    rest = ["3"] if semantics == "direct" else []
    assert got(Equals("k", "a")) == ["1"] and got(In("k", ("a", "b"))) == ["1", "2"]
    assert got(NotEquals("k", "a")) == sorted(["2", *rest]) and got(NotIn("k", ("a", "b"))) == rest
    assert got(Or(And(Equals("k", "a"), NotEquals("n", "2")), Equals("n", "3"))) == ["1", "3"]
    # a key without postings is judged directly either way
    assert got(NotEquals("unknown", "x")) == ["1", "2", "3"]
    assert got(Equals("k", image(b"a"))) == []


def test_catalog(spark):
    e = Engine(spark)
    e.create_store("s", 3, ["b", "a"], schema="one")
    e.create_store("s", 4)
    with pytest.raises(AlreadyExists):
        e.create_store("s", 5)
    e.create_store("s", 5, ["x"], error_if_exists=False)
    info = e.get_store("s").first()
    assert (info["dimension"], info["len"], info["predicates"]) == (4, 0, [])
    assert e.list_stores("one").first()["predicates"] == ["a", "b"] and e.list_stores("One").count() == 0
    assert e.create_pred_index("s", ["p", "q"]) == Count(2) and e.create_pred_index("s", ["p", "r"]) == Count(1)
    with pytest.raises(PredicateNotFound):
        e.drop_pred_index("s", ["p", "none"])
    assert e.drop_pred_index("s", ["p", "none"], False) == Count(1)
    assert e.create_nonlinear_index("s", [KdTree(), Hnsw("dot"), Hnsw("cosine")]) == Count(2)
    assert e.store("s").meta.nonlinear["hnsw"].metric == "dot"
    with pytest.raises(InvalidArgument):
        e.create_nonlinear_index("s", [Hnsw(maximum_connections=1)])
    assert e.drop_nonlinear_index("s", ["kdtree"]) == Count(1)
    with pytest.raises(NonLinearIndexNotFound):
        e.drop_nonlinear_index("s", ["kdtree"])
    for error, call in ((InvalidArgument, lambda: e.drop_schema("public")), (InvalidArgument, lambda: e.drop_schema("")), (InvalidArgument, lambda: e.create_store("z", 0)), (StoreNotFound, lambda: e.drop_store("none"))):
        with pytest.raises(error):
            call()
    assert e.drop_schema("one") == Count(1) and e.drop_schema("one") == Count(0)
    assert e.drop_store("none", False) == Count(0) and e.drop_store("s") == Count(1)


def test_language_and_pipeline(spark):
    e = Engine(spark)
    got = e.query(
        "PING; CREATESTORE s DIMENSION 2 PREDICATES (a); SET (([1, 2], {a: x y}), ([-3.5, 4e0], {a: /xFF})) IN s; GETPRED (a = x y) IN s; "
        "DROPSTORE none; UPSERT (none, {b: z}) WHERE (a = x y) IN s MERGE; GETKEY ([1, 2]) IN s; DELKEY ([1, 2]) IN s; LISTSTORES; INFOSERVER; LISTCLIENTS"
    )
    assert got[0] == "pong" and got[2] == SetResult(2, 0) and isinstance(got[4], EngineError) and got[4].code == 5
    assert got[5] == SetResult(0, 1) and got[7] == Count(1) and got[8].first()["len"] == 1
    with pytest.raises(InvalidArgument):
        e.pipeline([None])


def test_many_changes_and_snapshots(spark, tmp_path):
    e = Engine(spark, compact_every=3)
    e.create_store("s", 1, ["n"], [Hnsw("dot")], schema="x")
    for i in range(8):
        e.set("s", [([float(i)], {"n": str(i), "b": image(bytes([i]))})], "x")
    e.del_key("s", [[3.0]], "x")
    path = f"file://{tmp_path}/snap"
    e.write_snapshot(path)
    e.set("s", [([99.0], {})], "x")
    back = Engine(spark)
    back.read_snapshot(path)
    assert back.store("s", "x").meta == back.store("s", "x").meta and back.store("s", "x").meta.nonlinear["hnsw"].metric == "dot"
    assert sorted(said(back.get_pred("s", NotEquals("n", "0"), "x"), "n")) == ["1", "2", "4", "5", "6", "7"]
    assert back.get_pred("s", Equals("b", image(b"\x05")), "x").count() == 1
    back.write_snapshot(path)  # over the files that it reads from: complete before they go
    again = Engine(spark)
    again.read_snapshot(path)
    assert again.rows("s", "x").count() == 7


def test_graphs_follow_changes(spark):
    e = Engine(spark, compact_every=2)
    e.create_store("s", 2, [], [Hnsw("euclidean")])
    e.set("s", [([float(i), 0.0], {"n": str(i % 3)}) for i in range(60)])
    near = lambda q, **k: [r["key"][0] for r in e.approximate("s", q, 3, **k).collect()]
    assert near([10.2, 0]) == [10, 11, 9]
    e.del_key("s", [[10.0, 0.0]])
    e.set("s", [([10.25, 0.0], {}), ([11.0, 0.0], {"n": "again"})])
    e.upsert("s", Equals("n", "again"), [10.5, 0.0])
    assert near([10.2, 0]) == [10.25, 10.5, 9] and near([10.2, 0], condition=Equals("n", "0")) == [9, 12, 6]
    assert e.graphs("s").rows.agg(F.sum("n")).first()[0] == e.rows("s").count() == 60
    e.drop_nonlinear_index("s", ["hnsw"])
    with pytest.raises(NonLinearIndexNotFound):
        e.approximate("s", [1.0, 1.0], 1)


def test_compaction_deletes_what_it_replaced(spark, tmp_path):
    """Readers of the rows before a compaction still find them; two compactions later their files are gone."""
    e = Engine(spark, compact_every=2)
    e.create_store("s", 1)
    e.set("s", [([1.0], {})])
    e.set("s", [([2.0], {})])
    before, files = e.rows("s"), list(e.store("s").files)
    assert len(files) == 1 and not e.store("s").layers
    e.set("s", [([3.0], {})])
    e.set("s", [([4.0], {})])
    assert before.count() == 2 and files[0] in e.store("s").outdated
    e.set("s", [([5.0], {})])
    e.set("s", [([6.0], {})])
    assert e.rows("s").count() == 6
    with pytest.raises(Exception):  # noqa: B017
        before.count()


def test_few_changes_are_merged_not_rewritten(spark):
    """The base of a large store stays as it is; its changes become one, in which each key's last state counts."""
    e = Engine(spark, compact_every=3)
    e.create_store("s", 1, ["n"])
    e.set("s", [([float(i)], {"n": str(i)}) for i in range(100)])
    e.compact(e.store("s"))
    base = list(e.store("s").files)
    for step in range(4):
        e.set("s", [([float(step)], {"n": f"new{step}"}), ([200.0], {"n": f"last{step}"})])
        e.del_key("s", [[50.0 + step], [200.0] if step == 1 else [-1.0]])
        e.set("s", [([50.0], {"n": "back"})])
    s = e.store("s")
    assert s.files == base and 1 <= len(s.layers) < 3
    got = {r["key"][0]: r["value"]["n"]["str"] for r in e.rows("s").collect()}
    want = {float(i): str(i) for i in range(100) if i not in (51, 52, 53)} | {float(i): f"new{i}" for i in range(4)} | {50.0: "back", 200.0: "last3"}
    assert got == want


def test_one_hash_is_not_one_vector(spark, monkeypatch):
    """Vectors whose hashes are equal stay two rows."""
    from vecmill.operators import mutations
    from vecmill.plans import engine

    for module in (mutations, engine):
        monkeypatch.setattr(module, "key_id", lambda key: F.lit(7).cast("long") + F.size(key) * 0)
    e = Engine(spark)
    e.create_store("s", 1, ["n"])
    assert e.set("s", [([1.0], {"n": "a"}), ([2.0], {"n": "b"}), ([2.0], {"n": "c"})]) == SetResult(2, 0)
    assert e.set("s", [([2.0], {"n": "d"}), ([3.0], {"n": "e"})]) == SetResult(1, 1)
    assert e.del_key("s", [[1.0]]) == Count(1)
    assert e.upsert("s", Equals("n", "d"), [4.0]) == SetResult(0, 1)
    with pytest.raises(UpsertMismatch):
        e.upsert("s", Equals("n", "d"), [3.0])
    assert sorted(said(e.get_key("s", [[1.0], [2.0], [3.0], [4.0]]), "n")) == ["d", "e"]


def test_snapshots_when_something_changed(spark, tmp_path):
    e, path = Engine(spark), f"file://{tmp_path}/snap"
    assert not e.snapshot_if_changed(path)
    e.create_store("s", 1)
    assert e.snapshot_if_changed(path) and not e.snapshot_if_changed(path)
    end = e.snapshot_every(0.05, path)
    e.set("s", [([1.0], {"a": "b"})])
    end()
    assert not e.dirty
    back = Engine(spark)
    back.read_snapshot(path)
    assert said(back.get_pred("s", Equals("a", "b")), "a") == ["b"]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from vecmill.operators import mutations as M
    from vecmill.streaming.ingest import stream_into

    for part in range(2):
        M.entries(spark, [([float(part * 3 + i)], {"n": str(i)}) for i in range(3)]).write.mode("append").parquet(f"{tmp_path}/in")
        e = Engine(spark)  # as a new process would begin
        if part:
            e.read_snapshot(f"file://{tmp_path}/snap")
        else:
            e.create_store("s", 1)
        given = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        stream_into(e, given, "s", f"{tmp_path}/cp", snapshot=f"file://{tmp_path}/snap").awaitTermination()
    assert sorted(r["key"][0] for r in e.rows("s").collect()) == [0, 1, 2, 3, 4, 5]


def test_bytes_in_tagged_json(spark):
    from vecmill.sources.snapshot import tagged_json

    e = Engine(spark)
    e.create_store("s", 1)
    e.set("s", [([1.0], {"b": "é\"", "a": "x"}), ([2.0], {"b": image(b"\x00"), "a": "x"}), ([3.0], {})])
    got = {r["key"][0]: json.loads(r["value"]) for r in tagged_json(e.rows("s")).collect()}
    assert got == {1: {"a": "str:x", "b": 'str:é"'}, 2: {"a": "str:x", "b": "img:!!"}, 3: {}}


def test_service_snapshots(spark):
    store = {"dimension": 3, "id_to_value": {"1": [[1.0, 2.0, 3.0], {"name": "str:a", "pic": "img:z"}]}, "predicate_indices": {"allowed_predicates": ["name"]}}
    for document, schema in (({"db_version": "2", "stores": {"t": {"fixture": store}}}, "t"), ({"fixture": store}, "public"), ({"stores": {"t": {"fixture": store}}}, "t")):
        e = Engine(spark)
        e.import_service_snapshot(document)
        assert said(e.get_pred("fixture", Equals("name", "a"), schema), "name") == ["a"]
        assert e.get_store("fixture", schema).first()["predicates"] == ["name"]
        again = Engine(spark)
        again.import_service_snapshot(e.export_service_snapshot())
        assert again.rows("fixture", schema).collect() == e.rows("fixture", schema).collect()


def test_service_snapshots_as_files(spark, tmp_path, monkeypatch):
    """Rows never come to the driver, and the files one after another are the document."""
    from vecmill.sources import snapshot

    e = Engine(spark)
    e.query("CREATESTORE s DIMENSION 2 PREDICATES (a); CREATESTORE empty DIMENSION 3; CREATESTORE s DIMENSION 1 SCHEMA t")
    e.set("s", [([0.1, float("nan")], {"a": "é,\n\u2028\"}{", "b": ""}), ([-0.0, 0.0], {"p": image(b"\x00z"), "a": "x"}), ([0.0, 1e-30], {})])
    e.set("s", [([float(i)], {"n": f"{i}"}) for i in range(50)], "t")
    document = e.export_service_snapshot()
    monkeypatch.setattr(snapshot, "to_service_json", None)
    e.write_service_snapshot(f"file://{tmp_path}/d")
    parts = sorted(p for p in (tmp_path / "d").rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    written = json.loads("".join(p.read_text() for p in parts))
    for body in (document, written):
        for store in (s for group in body["stores"].values() for s in group.values()):
            store["id_to_value"] = {i: (repr(np.float32(k).tolist()), v) for i, (k, v) in store["id_to_value"].items()}
    assert written == document
    back = Engine(spark)
    back.read_service_snapshot(f"file://{tmp_path}/d")
    for name, schema in (("s", None), ("empty", None), ("s", "t")):
        one, two = (sorted(map(repr, x.rows(name, schema).collect())) for x in (e, back))
        assert one == two and back.store(name, schema).meta.dimension == e.store(name, schema).meta.dimension
    assert back.store("s").meta.predicates == {"a"}
    with pytest.raises(ValueError):
        e.write_service_snapshot(f"file://{tmp_path}/f", flat=True)
    e.drop_schema("t")
    e.write_service_snapshot(f"file://{tmp_path}/f", flat=True)
    flat = Engine(spark)
    flat.read_service_snapshot(f"file://{tmp_path}/f")
    assert sorted(map(repr, flat.rows("s").collect())) == sorted(map(repr, e.rows("s").collect()))


def test_migration_of_more_rows_than_one_document_may_hold(spark, tmp_path):
    """The query itself, over more than 100,000 vectors, which it once refused."""
    from pyspark.sql import functions as F

    from vecmill.queries import queries

    n, x = 100_001, F.col("id")
    ids = spark.range(n)
    ids.select(x.alias("vec_id"), F.array(x.cast("float"), F.lit(1).cast("float")).alias("embedding"), (x % 7).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    ids.select(x.alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.where("id % 2 = 0").select(x.alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries()["snapshot_migration"](spark, str(tmp_path))
    i = F.col("vec_id").cast("long")
    right = (F.col("first") == i) & (F.col("label") == (i % 7).cast("string")) & (F.col("lang") == "en") & (F.col("quality").isNull() == (i % 2 == 1))
    assert got.agg(F.count("*"), F.countDistinct("vec_id"), F.sum(right.cast("int"))).first() == (n, n, n)


def test_streaming(spark, tmp_path):
    from vecmill.operators import mutations as M
    from vecmill.streaming.ingest import stream_into

    e = Engine(spark)
    e.create_store("s", 1)
    M.entries(spark, [([float(i % 5)], {"n": str(i)}) for i in range(20)]).write.parquet(f"{tmp_path}/in")
    given = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    stream_into(e, given, "s", f"{tmp_path}/cp").awaitTermination()
    assert sorted(said(e.get_key("s", [[float(i)] for i in range(5)]), "n"), key=int) == ["15", "16", "17", "18", "19"]
