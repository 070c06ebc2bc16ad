"""Registered queries of commands, models, indexes and files, with the SQL that gives the same rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill import storage
from vecmill.__main__ import serve
from vecmill.embedding.engine import AiEngine
from vecmill.embedding.front import ImageFront, SoundFront
from vecmill.embedding.models import MODELS, HashEmbedder, ModelSpec, Registry
from vecmill.errors import EngineError, InvalidArgument
from vecmill.functions import sound, vision
from vecmill.functions.codec import from_tagged, to_tagged
from vecmill.functions.vectors import key_id
from vecmill.operators import hnsw, ivf
from vecmill.operators.predicates import Equals, In, NotEquals, Or, Predicate, compile_predicate
from vecmill.operators.search import knn_join, recall_at_k
from vecmill.plans import commands as C
from vecmill.plans.engine import Engine
from vecmill.queries import FIRST, NAMES, ROW, S, _asked, _entry, _id, _said, _state, dealt, opened, read, state_sql, vector_of
from vecmill.sources.vecs import read_vecs
from vecmill.types import VALUE, Hnsw, KdTree, Meta, audio, image, text

# -- models without weights, which make of an input what SQL can tell too


class Lengths:
    """(characters, words, 1) of a text."""

    def __call__(self, inputs: Sequence[str], params: dict[str, str]) -> list:
        return [[([float(len(x)), float(len(x.split(" "))), 1.0], {})] for x in inputs]


class Words:
    """A vector for each word, with what was found; words below ``confidence_threshold`` (their length by 10) are left out."""

    def __call__(self, inputs: Sequence[bytes], params: dict[str, str]) -> list:
        one, least = HashEmbedder(4), float(params["confidence_threshold"])
        return [[(one([f"{n} {x.decode()}"], {})[0][0][0], {"word": w, "confidence": f"{len(w) / 10:.1f}"}) for n,
            w in enumerate(x.decode().split(" ")) if len(w) / 10 >= least] for x in inputs]


class Tokens:
    """(ids that are no padding, width of the batch, 1): reads what a text front end makes."""

    def __call__(self, batch, params: dict[str, str]) -> list:
        return [[([float(m.sum()), float(batch.mask.shape[1]), 1.0], {})] for m in batch.mask]


class Pixels:
    """Means of the three colours: reads what an image front end makes."""

    def __call__(self, tensors: np.ndarray, params: dict[str, str]) -> list:
        return [[(x, {})] for x in tensors.reshape(len(tensors), 3, -1).mean(2).astype(float).tolist()]


class Loudness:
    """(largest, smallest, frames) of spectrograms: reads what a sound front end makes."""

    def __call__(self, tensors: np.ndarray, params: dict[str, str]) -> list:
        return [[([float(t.max()), float(t.min()), float(t.shape[-2])], {})] for t in tensors]


MOST_TOKENS = 12


class SpaceTokenizer:
    """Stands for a front end of the tokenizer library: a token for each word, and two special ones."""

    def __call__(self, inputs: Sequence[str], preprocess: bool):
        from vecmill.functions.tokens import Batch

        rows = [x.split(" ") for x in inputs]
        longest = max((len(r) + 2 for r in rows), default=0)
        if longest > MOST_TOKENS and not preprocess:
            raise InvalidArgument(f"a text of {longest} tokens, where {MOST_TOKENS} are taken")
        n = [min(len(r) + 2, MOST_TOKENS) for r in rows]
        mask = np.array([[int(i < x) for i in range(max(n, default=0))] for x in n])
        return Batch(mask.copy(), mask)


def models() -> Registry:
    specs = {
        "lengths": ModelSpec("lengths", "str", 3, 64),
        "letters": ModelSpec("letters", "str", 16, 256),
        "words": ModelSpec("words", "img", 4, 16, one_to_many=True, needs_preprocessing=True, thresholds=(("confidence_threshold", 0.3),)),
        "tokens": ModelSpec("tokens", "str", 3, 1, max_tokens=MOST_TOKENS),
        "pixels": ModelSpec("pixels", "img", 3, 16, image_size=8),
        "loudness": ModelSpec("loudness", "aud", 3, 8),
    }
    loaders = {"lengths": Lengths, "letters": lambda: HashEmbedder(16), "words": Words, "tokens": Tokens, "pixels": Pixels,
        "loudness": Loudness}
    fronts = {"tokens": SpaceTokenizer, "pixels": lambda: ImageFront(8, (0.5, 0.4, 0.3), (0.2, 0.25, 0.5)), "loudness": SoundFront}
    return Registry(loaders, specs, fronts)


def _items(spark: SparkSession, sf_dir: str, model: str = "letters", kind: str = "str") -> tuple[AiEngine, DataFrame]:
    """A store of raw inputs, and the texts of ``benchmark`` for it."""
    ai = AiEngine(Engine(spark), models())
    ai.create_store("items", model, model, ["item"], store_original=True)
    given = _entry(F.col("text")) if kind == "str" else F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("str"),
        F.encode("text", "utf-8").alias("bin"))
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), given.alias("input"),
        F.create_map(F.lit("item"), _entry(F.col("item_id"))).alias("value"))
    return ai, rows


def _filled(spark: SparkSession, sf_dir: str, **options) -> AiEngine:
    ai, rows = _items(spark, sf_dir, **options)
    ai.set("items", rows)
    return ai


def _texts_of(spark: SparkSession, sf_dir: str) -> list[Meta]:
    """All texts of ``benchmark``, a small table, as a command's inputs."""
    return [text(r["text"]) for r in read(spark, sf_dir, "benchmark").orderBy("item_id").collect()]


# -- stores of raw inputs


def ai_getkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input that was set, asked for among others."""
    found = _filled(spark, sf_dir).get_key("items", [*_texts_of(spark, sf_dir), text("unknown")])
    return found.select(_id("item"), F.col("key.str").alias("text"), F.size("value").alias("entries"))


def ai_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new input for one item; the other entries of its value stay."""
    ai = _filled(spark, sf_dir)
    ai.upsert("items", Equals("item", "1"), text("another text"), {"more": "yes"})
    return ai.get_pred("items", NotEquals("item", "-")).select(_id("item"), F.col("key.str").alias("text"), _said("more"))


def ai_delpred(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai = _filled(spark, sf_dir)
    n = ai.execute(C.DelPred("items", In("item", ("1", "2", "-5"))))
    return ai.get_pred("items", NotEquals("item", "-")).select(_id("item"), F.lit(n.count).alias("deleted"))


def ai_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of several vectors: set twice, the second time with a threshold that leaves fewer of each."""
    ai, rows = _items(spark, sf_dir, "words", "img")
    ai.set("items", rows, params={"confidence_threshold": "0"})
    ai.set("items", rows)
    part = F.try_element_at("value", F.lit("_vecmill_part"))["str"].cast("int")
    return ai.engine.rows("items").select(_id("item"), part.alias("part"), _said("word"), _said("confidence"))


def ai_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings without a store, in batches."""
    ai, rows = _items(spark, sf_dir, "lengths")
    made = ai.models.embed_frame(rows, "lengths")
    return made.select(F.col("pos").alias("item"), F.col("key")[0].cast("int").alias("chars"), F.col("key")[1].cast("int").alias("words"))


def ai_convert_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai, _ = _items(spark, sf_dir, "lengths")
    made = ai.execute(C.ConvertInputs(tuple(_texts_of(spark, sf_dir)), "lengths"))
    return made.select(F.col("input.str").alias("text"), "number", F.col("key")[0].cast("int").alias("chars"))


def ai_token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens after the model's cut; without preprocessing the inputs that are too long are refused."""
    ai, rows = _items(spark, sf_dir, "tokens")
    made = ai.models.embed_frame(rows, "tokens").select(F.col("pos").alias("item"), F.col("key")[0].cast("int").alias("tokens"))
    refused = 0
    for t in _texts_of(spark, sf_dir):
        try:
            ai.models.embed("tokens", [t], preprocess=False)
        except InvalidArgument:
            refused += 1
    return made.withColumn("refused", F.lit(refused))


def ai_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of one colour, of any shape: scaled, cut, normalised, and embedded as their mean colours."""
    ai = AiEngine(Engine(spark), models())
    w, h, c = F.col("p_size") + 3, F.pmod("p_partkey", F.lit(9)) + 2, F.pmod("p_partkey", F.lit(256))
    pixel = F.unhex(F.lpad(F.hex(c * 65536 + F.pmod(c + 50, F.lit(256)) * 256 + F.pmod(c + 100, F.lit(256))), 6, "0"))
    data = F.concat(F.encode(F.concat(F.lit("P6\n"), w, F.lit(" "), h, F.lit("\n255\n")), "utf-8"),
        F.unhex(F.repeat(F.hex(pixel), (w * h).cast("int"))))
    given = F.struct(F.lit("img").alias("kind"), F.lit(None).cast("string").alias("str"), data.alias("bin"))
    rows = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("pos"), given.alias("input"),
        F.create_map().cast("map<string, struct<kind:string,str:string,bin:binary>>").alias("value"))
    made = ai.models.embed_frame(rows, "pixels")
    return made.select(F.col("pos").alias("p_partkey"),
        *[F.round(F.col("key")[i].cast("double"), 3).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def ai_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent WAVE files as long as the texts: spectrograms at the floor, zero where no whole window is left, all of the model's shape."""
    ai = AiEngine(Engine(spark), models())

    def run(frames):
        for f in frames:
            bodies = [bytes(4 * (len(t) + 1)) for t in f["text"]]
            head = [b"RIFF" + struct.pack("<I", 36 + len(b)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(b)) for b in bodies]
            yield pd.DataFrame({"pos": f["item_id"], "bin": [h + b for h, b in zip(head, bodies, strict=True)]})

    waves = read(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "pos long, bin binary")
    given = F.struct(F.lit("aud").alias("kind"), F.lit(None).cast("string").alias("str"), F.col("bin")).alias("input")
    made = ai.models.embed_frame(waves.select("pos", given, F.create_map().cast(VALUE).alias("value")), "loudness")
    return made.select(F.col("pos").alias("item"), *[F.round(F.col("key")[i], 3).alias(n) for i, n in enumerate(("loudest", "softest", "frames"))])


def ai_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language's statements for raw inputs, an entry for each row of ``benchmark``: results by step."""
    ai = AiEngine(Engine(spark), models())
    ids = [r["item_id"] for r in read(spark, sf_dir, "benchmark").select("item_id").collect()]
    entries = ", ".join(f"([text {i}], {{who: p{i % 3}}})" for i in ids)
    got = ai.query(
        f"CREATESTORE notes QUERYMODEL letters INDEXMODEL letters PREDICATES (who) STOREORIGINAL; SET ({entries}) in notes PREPROCESSACTION nopreprocessing;"
        "GETSIMN 1 WITH [text 2] USING cosinesimilarity PREPROCESSACTION modelpreprocessing EXECUTIONPROVIDER cpu IN notes; GETKEY ([text 1], [text -9]) IN notes;"
        "DELKEY ([text 1]) IN notes; GETPRED (who = p1) IN notes; PURGESTORES"
    )
    rows = []
    for step, r in enumerate(got):
        n = r.count() if isinstance(r, DataFrame) else getattr(r, "inserted", getattr(r, "count", -1))
        rows.append((step, r.code if isinstance(r, EngineError) else 0, int(n) if r is not None else -1))
    return spark.createDataFrame(rows, "step int, code int, n long")


def ai_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of raw inputs and of vectors in two schemas: what is listed, described and purged."""
    ai = _filled(spark, sf_dir)
    ai.create_store("pictures", "words", "words", ["item"], schema="other")
    ai.engine.create_store("plain", 5)
    own = ai.get_store("items").unionByName(ai.list_stores("other"))
    out = own.select("name", "index_model", "len", "dimension", F.array_join("predicates", ",").alias("predicates")).collect()
    n = ai.execute(C.PurgeStores())
    left = sum(len(x) for x in ai.engine.stores.values())
    return spark.createDataFrame([(*r, n.count, left) for r in out],
        "name string, index_model string, len long, dimension int, predicates string, purged int, left int")


def ai_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of another kind than the model's, or of several kinds, are refused, and nothing of them is set."""
    ai = _filled(spark, sf_dir)
    steps = [
        C.AiSet("items", ((image(b"x"), {}),)), C.AiSet("items", ((text("a"), {}), (audio(b"y"), {}))), C.AiGetSimN("items", image(b"x"), 1), C.AiUpsert("items", Equals("item", "1"), audio(b"z")),
        C.AiSet("items", ((text("one more"), {"item": text("-1")}),)),
    ]
    codes = [r.code if isinstance(r, EngineError) else 0 for r in ai.pipeline(steps)]
    left = ai.engine.rows("items").count()
    return spark.createDataFrame([(i, c, left) for i, c in enumerate(codes)], "step int, code int, n long")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of statements as the command line takes them: what it says to each."""
    said: list[str] = []
    lines = ["PING", "CREATESTORE s DIMENSION 2; DROPSTORE none", "nonsense", "", "SET (([1, 2], {a: b}), ([3, 4], {a: c})) IN s; DELKEY ([1, 2]) IN s", "DROPSTORE s"]
    serve(Engine(spark), lines, out=said.append)
    return spark.createDataFrame([(i, x.split(":")[0]) for i, x in enumerate(said)], "pos int, said string")


def ai_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index commands of stores of raw inputs; the engine's own keys stay."""
    ai = _filled(spark, sf_dir)
    steps = [
        C.CreatePredIndex("items", ("size", "item")), C.DropPredIndex("items", ("size", "_vecmill_input")),
            C.CreateNonLinearIndex("items", (KdTree(), Hnsw())), C.DropNonLinearIndex("items", ("kdtree",)),
        C.DropStore("items", True, None), C.DropStore("items", False, None), C.DropSchema("other"),
    ]
    return spark.createDataFrame([(i, r.count) for i, r in enumerate(ai.pipeline(steps))], "step int, n long")


# -- snapshots, files, values


def _back(spark: SparkSession, sf_dir: str, flat: bool) -> DataFrame:
    path = f"{storage.root(spark)}/service-{uuid.uuid4().hex}"
    opened(spark, sf_dir).write_service_snapshot(path, flat)
    engine = Engine(spark)
    engine.read_service_snapshot(path)
    return engine.rows("vectors").select(_id(), *[_said(n) for n in NAMES], F.round(F.col("key")[0].cast("double"), 6).alias("first"))


def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, flat=False)


def snapshot_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document in the old flat form, without schemas and version."""
    return _back(spark, sf_dir, flat=True)


def snapshot_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed, written because of that, not written again, and read by an engine that goes on."""
    engine, path = opened(spark, sf_dir), f"{storage.root(spark)}/snapshot-{uuid.uuid4().hex}"
    engine.del_pred("vectors", Equals("lang", "en"))
    wrote = [engine.snapshot_if_changed(path), engine.snapshot_if_changed(path)]
    back = Engine(spark)
    back.read_snapshot(path)
    back.del_pred("vectors", Equals("lang", "fr"))
    return _state(back).withColumn("wrote", F.lit(sum(wrote)))


def fvecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    path = f"{storage.root(spark)}/vecs-{uuid.uuid4().hex}/base.fvecs"
    storage.put_bytes(spark, path, b"".join(struct.pack(f"<i{len(r['embedding'])}f", len(r["embedding"]), *r["embedding"]) for r in rows))
    return read_vecs(spark, path).select("pos", F.size("vector").alias("dimension"),
        F.round(F.col("vector")[1].cast("double"), 6).alias("second"))


def ivecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three true neighbours of every queried vector, by a file of integers."""
    truth = knn_join(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"), 3, "cosine", row_id="vec_id",
        row_key="embedding").orderBy("query_id", "rank").collect()
    path = f"{storage.root(spark)}/vecs-{uuid.uuid4().hex}/truth.ivecs"
    ids = [r["vec_id"] for r in truth]
    storage.put_bytes(spark, path, b"".join(struct.pack("<4i", 3, *ids[i : i + 3]) for i in range(0, len(ids), 3)))
    return read_vecs(spark, path, floats=False).select((F.col("pos") * 50).alias("query_id"),
        F.posexplode("vector").alias("rank", "vec_id")).select("query_id", (F.col("rank") + 1).alias("rank"),
            F.col("vec_id").cast("long").alias("vec_id"))


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as hexadecimal literals of images and sounds, set by one statement and read back as bytes."""
    engine = Engine(spark)
    engine.create_store("s", 1)
    entries = [f"([{r['item_id']}], {{data: {'/x' if r['item_id'] % 2 else '/a'}{r['text'].encode().hex()}}})" for r in read(spark, sf_dir, "benchmark").collect()]
    engine.query(f"SET ({', '.join(entries)}) IN s")
    v = F.col("value")["data"]
    return engine.rows("s").select(F.col("key")[0].cast("long").alias("item"), v["kind"].alias("kind"), F.decode(v["bin"], "utf-8").alias("text"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as images under tagged strings and back."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"item_id": f["item_id"],
                "text": [from_tagged(to_tagged(image(t.encode()))).data.decode() for t in f["text"]],
                    "kind": [to_tagged(image(t.encode()))[:4] for t in f["text"]]})

    return read(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, text string, kind string")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, and their opposites in which one number is a zero of either sign: as many identities as bit patterns."""
    e = read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("key"))
    zero = lambda z: e.select(F.concat(F.array(F.lit(z).cast("float")), F.slice("key", 2, 100)).alias("key"))
    every = e.unionAll(e).unionAll(zero(0.0)).unionAll(zero(-0.0))
    return every.agg(F.countDistinct(key_id(F.col("key"))).alias("n"))


# -- catalog and indexes


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name in several schemas; what is dropped, what is missing, what is refused."""
    engine = opened(spark, sf_dir)
    got = engine.query(
        "CREATESTORE vectors DIMENSION 2 SCHEMA a; CREATESTORE other DIMENSION 3 SCHEMA a; CREATESTORE vectors DIMENSION 2 SCHEMA Public; SET (([1, 2], {x: y})) IN vectors SCHEMA a;"
        "GETPRED (x = y) IN vectors SCHEMA a; GETPRED (x = y) IN vectors; DROPSCHEMA a; DROPSCHEMA a; GETSTORE vectors SCHEMA a; LISTSTORES; LISTSTORES SCHEMA none"
    )
    rows = []
    for step, r in enumerate(got):
        n = r.count() if isinstance(r, DataFrame) else getattr(r, "inserted", getattr(r, "count", -1))
        rows.append((step, r.code if isinstance(r, EngineError) else 0, int(n) if r is not None and not isinstance(r, EngineError) else -1))
    return spark.createDataFrame(rows, "step int, code int, n long")


def store_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).get_store("vectors").select("len", "size_in_bytes")


def server(spark: SparkSession, sf_dir: str) -> DataFrame:
    pong, info, clients, cluster = opened(spark, sf_dir).query("PING; INFOSERVER; LISTCLIENTS; CLUSTERINFO")
    drivers = cluster.where("role = 'driver' and state = 'running'").count()
    same = (F.col("spark") == F.lit(spark.version)).alias("same")
    return info.select("type", F.lit(pong).alias("ping"), F.lit(clients.count()).alias("clients"), F.lit(drivers).alias("drivers"), same)


def built_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions put together by operators; an empty one is refused."""
    built = (Equals("lang", "en") & NotEquals("label", "3")) | In("source", ("src2",)) | Equals("toxic", "1")
    try:
        compile_predicate(Predicate())
        refused = False
    except (EngineError, NotImplementedError, TypeError, ValueError):
        refused = True
    return opened(spark, sf_dir).get_pred("vectors", built).select(_id(), F.lit(refused).alias("refused"))


def postings_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    engine.del_pred("vectors", Or(Equals("lang", "de"), Equals("label", "4")))
    engine.query("DROPPREDINDEX (source, toxic) IN vectors")
    return engine.postings("vectors").select("name", F.col("str").alias("value"), "n")


def kdtree_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    engine.del_pred("vectors", In("label", ("0", "1", "2", "3")))
    found = engine.get_sim_n("vectors", vector_of(spark, sf_dir, 0), 10, "kdtree")
    return found.select(_id(), F.round("similarity", 6).alias("similarity"))


def accepts_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by an index that the store lacks: an error, but no rows where postings accept nothing."""
    engine = opened(spark, sf_dir, semantics="indexed")
    engine.query("DROPNONLINEARALGORITHMINDEX (kdtree) IN vectors")
    n = [*engine.pipeline([C.GetSimN("vectors", tuple(vector_of(spark, sf_dir, 0)), 3, "kdtree", Equals("lang", x)) for x in ("none",
        "en")])]
    return spark.createDataFrame([(i, r.code if isinstance(r, EngineError) else 0,
        r.count() if isinstance(r, DataFrame) else -1) for i, r in enumerate(n)], "step int, code int, n long")


def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many layers of a graph an id stands."""
    g = hnsw.Graph(Hnsw())

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "level": [g.level_of(int(i)) for i in f["vec_id"]]})

    return read(spark, sf_dir, "embeddings").select("vec_id").mapInPandas(run, "vec_id long, level int")


def graph_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of an index as they are kept and written."""
    engine, path = opened(spark, sf_dir), f"{storage.root(spark)}/snapshot-{uuid.uuid4().hex}"
    engine.write_snapshot(path)
    back = Engine(spark)
    back.read_snapshot(path)
    h = back.store("vectors").meta.nonlinear["hnsw"]
    fields = "metric string, ef int, m int, m0 int, extended boolean, pruned boolean"
    return spark.createDataFrame([(h.metric, h.ef_construction, h.maximum_connections, h.maximum_connections_zero, h.extend_candidates,
        h.keep_pruned_connections)], fields)


def _graph_truth(engine: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, recall) of the graphs as they stand against all rows as they stand."""
    asked = _asked(spark, sf_dir)
    truth = knn_join(asked, engine.rows("vectors").select("key_id", "key"), 10, "euclidean", keep_self=True)
    return recall_at_k(hnsw.search_graphs_many(engine.graphs("vectors").rows, asked, 10, width=160), truth, 10)


def _judged(recall: DataFrame) -> DataFrame:
    return recall.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(_graph_truth(opened(spark, sf_dir), spark, sf_dir))


def graph_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs that were built before rows were deleted, replaced and added follow the changes."""
    engine = opened(spark, sf_dir)
    engine.graphs("vectors")
    engine.del_pred("vectors", Equals("label", "4"))
    few = engine.rows("vectors").where(_said("label") == "3")
    engine.set("vectors", few.select(F.lit(0).cast("long").alias("pos"), F.transform("key", lambda x: -x).alias("key"), "value"))
    held = engine.graphs("vectors").rows.agg(F.sum("n").alias("held"))
    return _judged(_graph_truth(engine, spark, sf_dir)).join(held)  # one row with one row


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selective filter: the accepted rows are few, so they are compared one by one."""
    found = opened(spark, sf_dir).approximate("vectors", vector_of(spark, sf_dir, 0), 10, Equals("source", "src3"))
    return found.select(_id(), F.round("similarity", 6).alias("similarity"))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queried vector, with the index's own settings: as many cells as measured when it was built."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_id"), F.col("embedding").alias("key"))
    index = ivf.build(rows, f"{storage.root(spark)}/ivf-{uuid.uuid4().hex}", "cosine")
    truth = knn_join(_asked(spark, sf_dir), rows, 10, "cosine", keep_self=True)
    return _judged(recall_at_k(index.search_many(spark, _asked(spark, sf_dir), 10), truth, 10))


# -- detectors


def _per_image(spark: SparkSession, sf_dir: str, work: Callable, kinds: str) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame([work(*r) for r in f.itertuples(index=False)], columns=[k.split()[0] for k in kinds.split(", ")])

    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")).mapInPandas(run, kinds)


@lru_cache(maxsize=1)
def _silent_outputs(size: int) -> list[np.ndarray]:
    """A detector's outputs that find nothing, by stride (8, 16, 32) score, box and points; made once in a worker, so what is written there is taken back."""
    return [np.zeros(((size // s) ** 2 * 2, n)) for s in (8, 16, 32) for n in (1, 4, 10)]


def decoded_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one confident cell of a detector's outputs, as a box."""

    def work(key, size, price):
        at = key % 800
        outputs = _silent_outputs(640)
        score, box = outputs[6], outputs[7]  # of stride 32
        score[at], box[at] = 0.9, (size / 10, 1, 2, size / 5)
        boxes, _, confidence = vision.decode_distances(outputs, 0.5)
        score[at], box[at] = 0, 0
        return (key, len(boxes), *[round(float(x), 4) for x in boxes[0]], float(confidence[0]))

    return _per_image(spark, sf_dir, work, "p_partkey long, n int, x1 double, y1 double, x2 double, y2 double, confidence double")


def decoded_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(key, size, price):
        at, n = key % 400, 400
        cls, obj, box, point = np.zeros((n, 1)), np.ones((n, 1)), np.zeros((n, 4)), np.zeros((n, 10))
        cls[at], box[at] = 0.8, (0.25, 0.5, size / 10, 2)
        boxes, _, confidence = vision.decode_centres({32: (cls, obj, box, point)}, 0.6)
        return (key, len(boxes), *[round(float(x), 4) for x in boxes[0]], float(confidence[0]))

    return _per_image(spark, sf_dir, work, "p_partkey long, n int, x1 double, y1 double, x2 double, y2 double, confidence double")


def aligned_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a point lies after the transform that takes the eyes to their places."""

    def work(key, size, price):
        m = vision.similarity_from_eyes((size, 5), (size + 10, 5), (30, 50), (30 + price / 50, 50))
        x, y = m @ np.array([size + 5, 5 + key % 7, 1])
        return key, round(float(x), 4), round(float(y), 4)

    return _per_image(spark, sf_dir, work, "p_partkey long, x double, y double")


def repeated_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels mixed, and repeated to a length: whole repeats, then silence."""

    def work(key, size, price):
        left = np.full(size + 1, float(key % 5))
        ready = sound.repeat_to(sound.mono(np.stack([left, left + 2], 1)), 100)
        return key, int((ready != 0).sum()), round(float(ready.sum()), 4)

    return _per_image(spark, sf_dir, work, "p_partkey long, n int, total double")


def face_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models of faces are called with: given, not a number, and not given."""
    rows = []
    for name in ("buffalo-l", "sface-yunet"):
        for given in ({}, {"confidence_threshold": "0.7", "nms_threshold": "0.2", "attributes": "genderage, hat"},
            {"confidence_threshold": "high"}):
            p = MODELS[name].parameters(given)
            rows.append((name, len(given), float(p["confidence_threshold"]), float(p["nms_threshold"]), p.get("attributes")))
    return spark.createDataFrame(rows, "model string, given int, confidence double, nms double, attributes string")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m.name, m.kind, m.dimension, m.batch) for m in MODELS.values()],
        "model string, kind string, dimension int, batch int")


WORDS = "WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)"
NEAR_LABEL = "round(list_sum(list_transform(list_zip(v, qv), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS similarity"
BACK = f"SELECT vec_id, label, lang, source, quality, toxic, {FIRST} FROM s"

#: name: (query, SQL)
TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "ai_getkey": (ai_getkey, "SELECT item_id AS item, text, 1 AS entries FROM benchmark"),
    "ai_upsert": (
        ai_upsert,
        "SELECT item_id AS item, CASE WHEN item_id = 1 THEN 'another text' ELSE text END AS text, CASE WHEN item_id = 1 THEN 'yes' END AS more FROM benchmark",
    ),
    "ai_delpred": (ai_delpred, "SELECT item_id AS item, 2 AS deleted FROM benchmark WHERE item_id NOT IN (1, 2)"),
    "ai_one_to_many": (
        ai_one_to_many,
        f"{WORDS}, e AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM w), k AS (SELECT * FROM e WHERE length(word) >= 3) "
        "SELECT item_id AS item, (row_number() OVER (PARTITION BY item_id ORDER BY n) - 1)::INTEGER AS part, word, printf('%.1f', length(word) / 10) AS confidence FROM k",
    ),
    "ai_convert": (ai_convert, f"{WORDS} SELECT item_id AS item, length(text)::INTEGER AS chars, len(ws)::INTEGER AS words FROM w JOIN benchmark USING (item_id)"),
    "ai_convert_inputs": (ai_convert_inputs, "SELECT text, 0 AS number, length(text)::INTEGER AS chars FROM benchmark"),
    "ai_token_limit": (
        ai_token_limit,
        f"{WORDS} SELECT item_id AS item, least(len(ws) + 2, {MOST_TOKENS})::INTEGER AS tokens, (SELECT count(*) FROM w WHERE len(ws) + 2 > {MOST_TOKENS})::INTEGER AS refused FROM w",
    ),
    "ai_images": (
        ai_images,
        "WITH c AS (SELECT p_partkey, p_partkey % 256 AS c FROM part) "
        "SELECT p_partkey, round((c / 255 - 0.5) / 0.2, 3) AS red, round(((c + 50) % 256 / 255 - 0.4) / 0.25, 3) AS green, round(((c + 100) % 256 / 255 - 0.3) / 0.5, 3) AS blue FROM c",
    ),
    "ai_sounds": (ai_sounds, "SELECT item_id AS item, 0.0::FLOAT AS loudest, -100.0::FLOAT AS softest, 1000.0::FLOAT AS frames FROM benchmark"),
    "ai_dsl": (
        ai_dsl,
        "WITH b AS (SELECT count(*) AS n, count(*) FILTER (item_id = 1) AS one, count(*) FILTER (item_id = 2) AS two, count(*) FILTER (item_id % 3 = 1) AS p1 FROM benchmark) "
        "SELECT 0 AS step, 0 AS code, -1::BIGINT AS n UNION ALL SELECT 1, 0, n FROM b UNION ALL SELECT 2, 0, 1 UNION ALL SELECT 3, 0, one FROM b UNION ALL SELECT 4, 0, one FROM b "
        "UNION ALL SELECT 5, 0, p1 - one FROM b UNION ALL SELECT 6, 0, 1",
    ),
    "ai_catalog": (
        ai_catalog,
        "SELECT 'items' AS name, 'letters' AS index_model, count(*) AS len, 16 AS dimension, 'item' AS predicates, 2 AS purged, 1 AS left FROM benchmark UNION ALL SELECT 'pictures', 'words', 0, 4, 'item', 2, 1",
    ),
    "ai_kinds": (ai_kinds, "SELECT step, code, (SELECT count(*) + 1 FROM benchmark) AS n FROM (VALUES (0, 3), (1, 3), (2, 3), (3, 3), (4, 0)) t(step, code)"),
    "statements": (
        statements,
        "SELECT * FROM (VALUES (0, 'pong'), (1, 'None'), (2, 'error 5'), (3, 'error 3'), (4, 'SetResult(inserted=2, updated=0)'), (5, 'Count(count=1)'), (6, 'Count(count=1)')) t(pos, said)",
    ),
    "ai_indexes": (ai_indexes, "SELECT * FROM (VALUES (0, 1::BIGINT), (1, 1), (2, 2), (3, 1), (4, 1), (5, 0), (6, 0)) t(step, n)"),
    "export_import": (export_import, state_sql(BACK)),
    "snapshot_migration": (snapshot_migration, state_sql(BACK)),
    "snapshot_resumed": (snapshot_resumed, state_sql(f"SELECT {ROW}, 1 AS wrote FROM s WHERE lang IS NULL OR lang NOT IN ('en', 'fr')")),
    "fvecs": (fvecs, "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, len(embedding)::INTEGER AS dimension, round(embedding[2]::DOUBLE, 6) AS second FROM embeddings"),
    "ivecs": (
        ivecs,
        "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id DESC)::INTEGER AS rank "
        "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, rank, vec_id FROM p WHERE rank <= 3",
    ),
    "literals": (literals, "SELECT item_id AS item, CASE WHEN item_id % 2 = 1 THEN 'img' ELSE 'aud' END AS kind, text FROM benchmark"),
    "tags": (tags, "SELECT item_id, text, 'img:' AS kind FROM benchmark"),
    "identities": (identities, "SELECT count(DISTINCT embedding) + 2 * count(DISTINCT embedding[2:]) AS n FROM embeddings"),
    "schemas": (
        schemas,
        "SELECT * FROM (VALUES (0, 0, -1::BIGINT), (1, 0, -1), (2, 0, -1), (3, 0, 1), (4, 0, 1), (5, 0, 0), (6, 0, 2), (7, 0, 0), (8, 5, -1), (9, 0, 1), (10, 0, 0)) t(step, code, n)",
    ),
    "store_size": (
        store_size,
        f"{S} SELECT count(*) AS len, sum(4 * len(v) + 6 + length(vec_id::VARCHAR) + coalesce(5 + length(label), 0) + coalesce(4 + length(lang), 0) + coalesce(6 + length(source), 0) + coalesce(7 + length(quality), 0) + coalesce(5 + length(toxic), 0))::BIGINT AS size_in_bytes FROM s",
    ),
    "server": (server, "SELECT 'database' AS type, 'pong' AS ping, 1 AS clients, 1 AS drivers, TRUE AS same"),
    "built_predicates": (built_predicates,
        f"{S} SELECT vec_id, TRUE AS refused FROM s WHERE coalesce(lang = 'en' AND label <> '3', FALSE) OR coalesce(source = 'src2', FALSE) OR coalesce(toxic = '1', FALSE)"),
    "postings_after_delete": (
        postings_after_delete,
        f"{S} SELECT name, value, count(*) AS n FROM (UNPIVOT (SELECT label, lang, quality FROM s WHERE NOT (coalesce(lang = 'de', FALSE) OR label = '4')) ON label, lang, quality INTO NAME name VALUE value) GROUP BY ALL",
    ),
    "kdtree_after_delete": (kdtree_after_delete,
        f"{S} SELECT vec_id, {NEAR_LABEL} FROM s, q WHERE label NOT IN ('0', '1', '2', '3') ORDER BY similarity, vec_id DESC LIMIT 10"),
    "accepts_nothing": (accepts_nothing, "SELECT * FROM (VALUES (0, 0, 0::BIGINT), (1, 5, -1)) t(step, code, n)"),
    "graph_levels": (
        graph_levels,
        "WITH u AS (SELECT vec_id, greatest(((vec_id::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT // 2048)::DOUBLE / 9007199254740992, 1 / 9007199254740992) AS u FROM embeddings) SELECT vec_id, floor(-ln(u) / ln(16))::INTEGER AS level FROM u",
    ),
    "graph_settings": (graph_settings, "SELECT 'euclidean' AS metric, 100 AS ef, 16 AS m, 32 AS m0, FALSE AS extended, FALSE AS pruned"),
    "graph_recall": (graph_recall, "SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0"),
    "graph_after_changes": (
        graph_after_changes,
        "SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, TRUE AS enough, (count(*) FILTER (label <> 4) + count(*) FILTER (label = 3))::BIGINT AS held FROM embeddings",
    ),
    "graph_search": (graph_search, f"{S} SELECT vec_id, round(list_distance(v, qv), 6) AS similarity FROM s, q WHERE source = 'src3' ORDER BY list_distance(v, qv), vec_id DESC LIMIT 10"),
    "ivf_recall": (ivf_recall, "SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0"),
    "decoded_distances": (
        decoded_distances,
        "WITH g AS (SELECT p_partkey, p_size, (p_partkey % 800 // 2 % 20) * 32 AS x, (p_partkey % 800 // 2 // 20) * 32 AS y FROM part) "
        "SELECT p_partkey, 1 AS n, round(x - p_size / 10 * 32, 4) AS x1, (y - 32)::DOUBLE AS y1, (x + 64)::DOUBLE AS x2, round(y + p_size / 5 * 32, 4) AS y2, 0.9::DOUBLE AS confidence FROM g",
    ),
    "decoded_centres": (
        decoded_centres,
        "WITH g AS (SELECT p_partkey, p_size, (p_partkey % 400 % 20 + 0.5) * 32 + 8 AS x, (p_partkey % 400 // 20 + 0.5) * 32 + 16 AS y FROM part), b AS (SELECT *, p_size / 10 * 16 AS w FROM g) "
        "SELECT p_partkey, 1 AS n, round(greatest(0, least(640, x - w)), 4)::DOUBLE AS x1, greatest(0, least(640, y - 32))::DOUBLE AS y1, round(greatest(0, least(640, x + w)), 4)::DOUBLE AS x2, greatest(0, least(640, y + 32))::DOUBLE AS y2, 0.8::DOUBLE AS confidence FROM b",
    ),
    "aligned_eyes": (aligned_eyes, "SELECT p_partkey, round(30 + p_retailprice / 500 * 5, 4) AS x, round(50 + p_retailprice / 500 * (p_partkey % 7), 4) AS y FROM part"),
    "repeated_sounds": (repeated_sounds,
        "SELECT p_partkey, (100 // (p_size + 1) * (p_size + 1))::INTEGER AS n, round(100 // (p_size + 1) * (p_size + 1) * (p_partkey % 5 + 1.0), 4)::DOUBLE AS total FROM part"),
    "face_parameters": (
        face_parameters,
        "SELECT * FROM (VALUES ('buffalo-l', 0, 0.5::DOUBLE, 0.4::DOUBLE, NULL), ('buffalo-l', 3, 0.7, 0.2, 'genderage'), ('buffalo-l', 1, 0.5, 0.4, NULL), "
        "('sface-yunet', 0, 0.6, 0.4, NULL), ('sface-yunet', 3, 0.7, 0.4, ''), ('sface-yunet', 1, 0.6, 0.4, NULL)) t(model, given, confidence, nms, attributes)",
    ),
    "registry": (
        registry,
        "SELECT * FROM (VALUES ('all-minilm-l6-v2', 'str', 384, 128), ('all-minilm-l12-v2', 'str', 384, 128), ('bge-base-en-v1.5', 'str', 768, 128), ('bge-large-en-v1.5', 'str', 1024, 128), ('resnet-50', 'img', 2048, 16), "
        "('clip-vit-b32-image', 'img', 512, 16), ('clip-vit-b32-text', 'str', 512, 128), ('sface-yunet', 'img', 128, 16), ('buffalo-l', 'img', 512, 16), ('clap-audio', 'aud', 512, 8), ('clap-text', 'str', 512, 128), "
        "('jina-embeddings-v2-base-code', 'str', 768, 128)) t(model, kind, dimension, batch)",
    ),
}
