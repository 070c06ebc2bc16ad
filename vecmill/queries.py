"""Registered queries over the test tables, with the SQL that gives the same rows.

The store of these queries holds ``embeddings`` with metadata: label, and by
equal id lang and source of ``documents`` and quality and toxic of ``labels``. A
null is a missing key; quality and toxic are missing for most rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill import storage
from vecmill.embedding.engine import AiEngine
from vecmill.embedding.models import HashEmbedder, ModelSpec, Registry
from vecmill.functions import vision
from vecmill.functions.vectors import l2_normalize, mean_pool, softmax
from vecmill.operators.predicates import And, Equals, In, NotEquals, NotIn, Or, Predicate, columns_entry, compile_predicate, plain
from vecmill.operators.search import knn_join, top_n
from vecmill.plans.engine import Engine
from vecmill.sources.snapshot import tagged_json
from vecmill.streaming.ingest import stream_into
from vecmill.types import Hnsw, KdTree, text

NAMES = ("label", "lang", "source", "quality", "toxic")
COLUMNS = {n: n for n in NAMES}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a file over all cores, for work that costs more than reading: a small file is one task however many rows it holds."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def flat(spark: SparkSession, sf_dir: str, names: Collection[str] = NAMES) -> DataFrame:
    """(vec_id, embedding, label, ...): metadata as plain columns; only tables that hold the names are joined."""
    out = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    for table, columns in (("documents", ("lang", "source")), ("labels", ("quality", "toxic"))):
        if wanted := [c for c in columns if c in names]:
            held = read(spark, sf_dir, table).select(F.col("doc_id").alias("vec_id"), *[F.col(c).cast("string").alias(c) for c in wanted])
            out = out.join(held, "vec_id", "left")
    return out


def _entry(c: Column) -> Column:
    return F.struct(F.lit("str").alias("kind"), c.cast("string").alias("str"), F.lit(None).cast("binary").alias("bin"))


def store_rows(rows: DataFrame) -> DataFrame:
    """(key, value) of flat rows; the id is an entry too."""
    names = ("vec_id", *NAMES)
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("v")) for n in names])
    kept = F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()),
        lambda p: F.struct(p["key"].alias("key"), _entry(p["v"]).alias("value")))
    return rows.select(F.col("embedding").alias("key"), F.map_from_entries(kept).alias("value"))


def _dimension(spark: SparkSession, sf_dir: str) -> int:
    return len(read(spark, sf_dir, "embeddings").select("embedding").first()[0])


def opened(spark: SparkSession, sf_dir: str, **options) -> Engine:
    engine = Engine(spark, **options)
    engine.attach("vectors", store_rows(flat(spark, sf_dir)), _dimension(spark, sf_dir), NAMES, [KdTree(), Hnsw("euclidean")])
    return engine


def vectors_of(spark: SparkSession, sf_dir: str, *ids: int) -> list[list[float]]:
    """The vectors of these ids, in their order, from one read."""
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()
    held = {r["vec_id"]: r["embedding"] for r in rows}
    return [held[i] for i in ids]


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return vectors_of(spark, sf_dir, vec_id)[0]


def _id(name: str = "vec_id") -> Column:
    return F.col("value")[name]["str"].cast("long").alias(name)


def _said(name: str) -> Column:
    return F.try_element_at("value", F.lit(name))["str"].alias(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simn(spark, sf_dir, "cosine")


# -- search


def simn(spark: SparkSession, sf_dir: str, metric: str, where: Predicate | None = None, semantics: str = "direct") -> DataFrame:
    """Filters on plain columns: they reach the scans, and only passing rows are scored."""
    rows = flat(spark, sf_dir, where.keys() if where else ())
    condition = compile_predicate(where, columns_entry(COLUMNS), semantics, plain) if where else None
    found = top_n(rows, vector_of(spark, sf_dir, 0), 10, metric, condition, key="embedding", tie="vec_id")
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def simn_engine(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    found = opened(spark, sf_dir).get_sim_n("vectors", vector_of(spark, sf_dir, 0), 10, algorithm, Equals("lang", "en"))
    return found.select(_id(), F.round("similarity", 6).alias("similarity"))


def dsl_getsimn(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ", ".join(repr(float(x)) for x in vector_of(spark, sf_dir, 0))
    found = opened(spark, sf_dir).query(f"GETSIMN 10 WITH [{numbers}] USING dotproductsimilarity IN vectors WHERE ((lang = en) AND (label not in (1, 2)) OR (toxic = 1))")
    return found[0].select(_id(), F.round("similarity", 6).alias("similarity"))


def accept_list_simn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows accepted by postings, then searched."""
    from vecmill.operators.postings import accept, posting_rows

    engine = opened(spark, sf_dir)
    rows = engine.rows("vectors")
    ids = posting_rows(rows, ["source"]).where("str in ('src1', 'src2')").select("key_id")
    found = top_n(accept(rows, ids), vector_of(spark, sf_dir, 0), 10, "euclidean")
    return found.select(_id(), F.round("similarity", 6).alias("similarity"))


def knn(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(_asked(spark, sf_dir), e, 10, metric, row_id="vec_id", row_key="embedding").withColumn("similarity",
        F.round("similarity", 6))


def knn_large(spark: SparkSession, sf_dir: str, copies: int = 50) -> DataFrame:
    """The vectors and ``copies`` - 1 changed forms of each, searched by every 50th of all: the size that batches have."""
    dealt = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism)
    e = dealt.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c"))
    turned = F.transform("embedding", lambda x, i: (x + F.sin(F.col("c") * (i + 1)) * F.lit(0.05)).cast("float"))
    form = F.when(F.col("c") == 0, F.col("embedding")).otherwise(turned).alias("embedding")
    every = e.select((F.col("vec_id") * copies + F.col("c")).alias("vec_id"), form)
    asked = every.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knn_join(asked, every, 10, "cosine", row_id="vec_id", row_key="embedding").select("query_id", "rank",
        F.round("similarity", 5).alias("similarity"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat(spark, sf_dir, ("lang",)).where(compile_predicate(NotEquals("lang", "en"), columns_entry(COLUMNS), "direct", plain))
    return knn_join(_asked(spark, sf_dir), rows.select("vec_id", "embedding"), 5, "euclidean", row_id="vec_id",
        row_key="embedding").withColumn("similarity", F.round("similarity", 6))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("query"))


# -- reads


def getkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = vectors_of(spark, sf_dir, 7, 3, 7)
    return opened(spark, sf_dir).get_key("vectors", [*asked, [-x for x in asked[0]]]).select(_id(), _said("label"), _said("lang"))


def getpred(spark: SparkSession, sf_dir: str, where: Predicate, semantics: str = "direct") -> DataFrame:
    return opened(spark, sf_dir, semantics=semantics).get_pred("vectors", where).select(_id(), *[_said(n) for n in NAMES])


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).rows("vectors").select(_id(), *[_said(n) for n in NAMES], F.size("key").alias("dimension"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).postings("vectors").select("name", F.col("str").alias("value"), "n")


# -- writes: a state after commands


def _state(engine: Engine) -> DataFrame:
    return engine.rows("vectors").select(_id(), *[_said(n) for n in NAMES], F.round(F.col("key")[0].cast("double"), 6).alias("first"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of label 3 with another language, and the opposites of label 4's vectors under ids of their own."""
    rows = flat(spark, sf_dir)
    old = rows.where("label = '3'").withColumn("lang", F.lit("xx"))
    new = rows.where("label = '4'").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("vec_id",
        -F.col("vec_id") - 1)
    both = old.unionByName(new)
    return store_rows(both).withColumn("pos", F.lit(0).cast("long"))


def set_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    engine.set("vectors", _batch(spark, sf_dir))
    return _state(engine)


def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = opened(spark, sf_dir).set("vectors", _batch(spark, sf_dir))
    return spark.createDataFrame([(r.inserted, r.updated)], "inserted long, updated long")


def upsert(spark: SparkSession, sf_dir: str, merge: bool) -> DataFrame:
    engine = opened(spark, sf_dir)
    engine.upsert("vectors", Equals("vec_id", "5"), None, {"vec_id": "5", "lang": "yy"}, merge)
    return _state(engine)


def upsert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    engine.upsert("vectors", Equals("vec_id", "6"), [-x for x in vector_of(spark, sf_dir, 6)])
    return _state(engine)


def delkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    n = engine.del_key("vectors", vectors_of(spark, sf_dir, 1, 2, 2))
    return _state(engine).withColumn("deleted", F.lit(n.count))


def delpred(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    n = engine.del_pred("vectors", And(In("lang", ("fr", "de")), NotEquals("toxic", "0")))
    return _state(engine).withColumn("deleted", F.lit(n.count))


def stream_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream into an empty store: the same state as setting it."""
    engine = Engine(spark)
    engine.create_store("vectors", _dimension(spark, sf_dir), NAMES)
    schema = read(spark, sf_dir, "embeddings").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")
    given = stream.select(F.col("embedding").alias("key"),
        F.create_map(F.lit("vec_id"), _entry(F.col("vec_id")), F.lit("label"), _entry(F.col("label"))).alias("value"))
    stream_into(engine, given, "vectors", f"{storage.root(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return engine.rows("vectors").groupBy(_said("label")).agg(F.count("*").alias("n"), F.sum(_id()).alias("ids"))


# -- catalog


def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = opened(spark, sf_dir).get_store("vectors")
    return info.select("name", "len", "dimension", F.array_join("predicates", ",").alias("predicates"),
        F.array_join("nonlinear", ",").alias("nonlinear"))


def list_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    for c in ("CREATESTORE b DIMENSION 3", "CREATESTORE a DIMENSION 2 PREDICATES (x, y)", "CREATESTORE IF NOT EXISTS a DIMENSION 9"):
        engine.query(c)
    return engine.list_stores().select("name", "len", "dimension")


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    got = engine.query("CREATEPREDINDEX (label, fresh) IN vectors; DROPPREDINDEX IF EXISTS (fresh, none) IN vectors; CREATENONLINEARALGORITHMINDEX (kdtree, hnsw) IN vectors; DROPNONLINEARALGORITHMINDEX (kdtree) IN vectors; DROPSTORE vectors; DROPSTORE vectors IF EXISTS")
    return spark.createDataFrame([(i, r.count) for i, r in enumerate(got)], "step int, n long")


def pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands after one that fails still run."""
    from vecmill.errors import EngineError

    got = opened(spark, sf_dir).query("DROPSTORE none; GETKEY ([1.0]) IN vectors; DELPRED (lang = en) IN vectors; GETPRED (lang = en) IN vectors; DROPSCHEMA public")
    rows = [(i, r.code if isinstance(r, EngineError) else 0,
        r.count if hasattr(r, "count") and not callable(r.count) else (r.count() if isinstance(r, DataFrame) else -1)) for i,
            r in enumerate(got)]
    return spark.createDataFrame(rows, "step int, code int, n long")


def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir)
    path = f"{storage.root(spark)}/snapshot-{uuid.uuid4().hex}"
    engine.write_snapshot(path)
    back = Engine(spark)
    back.read_snapshot(path)
    return _state(back)


def snapshot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged_json(opened(spark, sf_dir).rows("vectors"))
    return rows.select(F.get_json_object("value", "$.vec_id").alias("vec_id"), F.get_json_object("value", "$.label").alias("label"))


# -- functions


def normalized(spark: SparkSession, sf_dir: str, epsilon: float = 0.0) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3 + 1))
    return rows.select("vec_id", F.posexplode(l2_normalize(F.col("v"), epsilon)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tokens = F.array("v", F.transform("v", lambda x: x * 2), F.transform("v", lambda x: x + 9))
    return rows.select("vec_id", F.posexplode(mean_pool(tokens, F.array(F.lit(1), F.lit(1), F.lit(0)))).alias("pos",
        "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def softmaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey",
        softmax(F.array(F.col("p_size") / 10, F.col("p_retailprice") / 1000, F.lit(1.0))).alias("s"))
    return rows.select("p_partkey", *[F.round(F.col("s")[i], 6).alias(f"s{i}") for i in range(3)])


def ious(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    rows = read(spark, sf_dir, "part").select("p_partkey",
        vision.iou(F.array(F.lit(0.0), F.lit(0.0), s, p), F.array(s / 2, F.lit(1.0), s + 5, p / 2 + 3)).alias("iou"))
    return rows.select("p_partkey", F.round("iou", 6).alias("iou"))


def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 13 + 20, F.floor(F.col("p_retailprice")).cast("int")
    box = vision.unletterbox(F.array(F.lit(10.0), F.lit(20.0), F.lit(400.0), F.lit(630.0)), w, h, 640)
    rows = read(spark, sf_dir, "part").select("p_partkey", box.alias("b"))
    return rows.select("p_partkey", *[F.round(F.col("b")[i], 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("double"), F.col("p_partkey")
    boxes = read(spark, sf_dir, "part").select((k % 100).alias("image_id"), F.array(s, s, s + 20, s + 10).alias("box"),
        (F.col("p_retailprice") + k / 1e6).alias("confidence"))
    return vision.nms(boxes, 0.4).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("top"))


# -- raw inputs


def _texts(spark: SparkSession, sf_dir: str) -> tuple[AiEngine, DataFrame]:
    models = Registry({"letters": lambda: HashEmbedder(16)}, {"letters": ModelSpec("letters", "str", 16, 256)})
    ai = AiEngine(Engine(spark), models)
    ai.create_store("items", "letters", "letters", ["size"], store_original=True)
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), _entry(F.col("text")).alias("input"),
        F.create_map(F.lit("item"), _entry(F.col("item_id"))).alias("value"))
    return ai, rows


def ai_set_getpred(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai, rows = _texts(spark, sf_dir)
    ai.set("items", rows)
    ai.set("items", rows)  # inputs that are set again replace themselves
    return ai.get_pred("items", NotEquals("item", "0")).select(_id("item"), F.col("key.str").alias("text"),
        F.size("value").alias("entries"))


def ai_delkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai, rows = _texts(spark, sf_dir)
    ai.set("items", rows)
    first = rows.orderBy("pos").first()["input"]["str"]
    n = ai.del_key("items", [text(first), text("unknown")])
    return ai.engine.rows("items").agg(F.count("*").alias("n")).withColumn("deleted", F.lit(n.count))


def ai_getsimn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input is closest to itself."""
    ai, rows = _texts(spark, sf_dir)
    ai.set("items", rows)
    first = rows.orderBy("pos").first()["input"]["str"]
    return ai.get_sim_n("items", text(first), 1).select(_id("item"), F.col("key.str").alias("text"),
        F.round("similarity", 5).alias("similarity"))


# -- SQL

S = """WITH s AS (
  SELECT e.vec_id, e.embedding::DOUBLE[] AS v, e.label::VARCHAR AS label, d.lang, d.source, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id
), q AS (SELECT v AS qv FROM s WHERE vec_id = 0)
"""
#: SQL by metric: score, and its direction.
SCORES = {
    "cosine": ("list_cosine_similarity(v, qv)", "DESC"),
    "dot": ("list_dot_product(v, qv)", "DESC"),
    "euclidean": ("list_distance(v, qv)", "ASC"),
    "squared_euclidean": ("list_sum(list_transform(list_zip(v, qv), lambda x: (x[1] - x[2]) * (x[1] - x[2])))", "ASC"),
}


def simn_sql(metric: str, where: str = "TRUE", label: bool = True) -> str:
    score, way = SCORES[metric]
    return f"{S} SELECT vec_id, {'label, ' if label else ''}round({score}, 6) AS similarity FROM s, q WHERE {where} ORDER BY {score} {way}, vec_id DESC LIMIT 10"


def getpred_sql(where: str) -> str:
    return f"{S} SELECT vec_id, label, lang, source, quality, toxic FROM s WHERE {where}"


def state_sql(body: str) -> str:
    return f"{S} {body}"


FIRST = "round(v[1], 6) AS first"
ROW = f"vec_id, label, lang, source, quality, toxic, {FIRST}"

#: name: (predicate, SQL with direct meaning)
PREDICATES: dict[str, tuple[Predicate, str]] = {
    "eq": (Equals("lang", "en"), "lang = 'en'"),
    "neq": (NotEquals("lang", "en"), "lang IS DISTINCT FROM 'en'"),
    "in": (In("source", ("src1", "src2", "src3")), "source IN ('src1', 'src2', 'src3')"),
    "not_in": (NotIn("label", ("1", "2", "3")), "label NOT IN ('1', '2', '3')"),
    "and": (And(Equals("lang", "en"), NotEquals("label", "5")), "lang = 'en' AND label <> '5'"),
    "or": (Or(Equals("toxic", "1"), Equals("source", "src7")), "coalesce(toxic = '1', FALSE) OR source = 'src7'"),
    "missing_key_direct": (NotEquals("toxic", "0"), "toxic IS DISTINCT FROM '0'"),
    "missing_key_not_in_direct": (NotIn("quality", ("1", "7")), "NOT coalesce(quality IN ('1', '7'), FALSE)"),
}
INDEXED: dict[str, tuple[Predicate, str]] = {
    "missing_key_indexed": (NotEquals("toxic", "0"), "toxic <> '0'"),
    "missing_key_not_in_indexed": (NotIn("quality", ("1", "7")), "quality NOT IN ('1', '7')"),
}


def _with(f: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, sf_dir, *args, **kwargs)


KNN_SQL = """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, {score} AS s FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {way}, vec_id DESC) AS rank FROM p)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM n WHERE rank <= 10"""

SET_SQL = f"""SELECT vec_id, label, 'xx' AS lang, source, quality, toxic, {FIRST} FROM s WHERE label = '3'
UNION ALL SELECT {ROW} FROM s WHERE label <> '3'
UNION ALL SELECT -vec_id - 1, label, lang, source, quality, toxic, round(-v[1], 6) FROM s WHERE label = '4'"""

#: Boxes of an image one after another, most confident first; each stays unless it overlaps one that stayed.
NMS_SQL = """WITH RECURSIVE b AS (
  SELECT p_partkey % 100 AS image_id, p_size::DOUBLE AS s, p_retailprice + p_partkey / 1e6 AS confidence,
         row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_retailprice + p_partkey / 1e6 DESC) AS n FROM part
), k AS (
  SELECT image_id, n, [s] AS kept, confidence AS top FROM b WHERE n = 1
  UNION ALL
  SELECT k.image_id, b.n, CASE WHEN len(list_filter(k.kept, lambda x: greatest(0, least(x + 20, b.s + 20) - greatest(x, b.s)) * greatest(0, least(x + 10, b.s + 10) - greatest(x, b.s))
           > 0.4 * (400 - greatest(0, least(x + 20, b.s + 20) - greatest(x, b.s)) * greatest(0, least(x + 10, b.s + 10) - greatest(x, b.s))))) = 0 THEN list_append(k.kept, b.s) ELSE k.kept END, k.top
  FROM k JOIN b ON b.image_id = k.image_id AND b.n = k.n + 1
)
SELECT image_id, len(arg_max(kept, n)) AS n, round(any_value(top), 4) AS top FROM k GROUP BY image_id"""

#: name: (query, SQL or None)
TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{f"simn_{m if m != 'squared_euclidean' else 'kdtree_sq'}": (_with(simn, m), simn_sql(m)) for m in SCORES},
    **{f"simn_filtered_{n}": (_with(simn, "cosine", p), simn_sql("cosine", f"({w})")) for n, (p, w) in PREDICATES.items()},
    **{f"simn_filtered_{n}": (_with(simn, "cosine", p, "indexed"), simn_sql("cosine", f"({w})")) for n, (p, w) in INDEXED.items()},
    **{f"getpred_{n}": (_with(getpred, p), getpred_sql(w)) for n, (p, w) in PREDICATES.items()},
    **{f"getpred_{n}": (_with(getpred, p, "indexed"), getpred_sql(w)) for n, (p, w) in INDEXED.items()},
    "simn_engine_kdtree": (_with(simn_engine, "kdtree"), simn_sql("squared_euclidean", "lang = 'en'", False)),
    "simn_engine_hnsw": (_with(simn_engine, "hnsw"), simn_sql("euclidean", "lang = 'en'", False)),
    "dsl_getsimn": (dsl_getsimn, simn_sql("dot", "lang = 'en' AND (label NOT IN ('1', '2') OR coalesce(toxic = '1', FALSE))", False)),
    "accept_list_simn": (accept_list_simn, simn_sql("euclidean", "source IN ('src1', 'src2')", False)),
    "knn_join": (_with(knn), KNN_SQL.format(score="list_cosine_similarity(a.v, b.v)", way="DESC")),
    "knn_join_large": (
        knn_large,
        """WITH r AS (SELECT vec_id * 50 + c AS id, CASE WHEN c = 0 THEN embedding ELSE list_transform(embedding, lambda x, i: (x + sin(c * i) * 0.05)::FLOAT) END::DOUBLE[] AS v FROM embeddings, range(50) t(c)),
        p AS (SELECT a.id AS query_id, list_cosine_similarity(a.v, b.v) AS s FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS rank FROM p) SELECT query_id, rank::INTEGER AS rank, round(s, 5) AS similarity FROM n WHERE rank <= 10""",
    ),
    "knn_join_dot": (_with(knn, "dot"), KNN_SQL.format(score="list_dot_product(a.v, b.v)", way="DESC")),
    "knn_join_euclidean": (_with(knn, "euclidean"), KNN_SQL.format(score="list_distance(a.v, b.v)", way="ASC")),
    "knn_join_filtered": (
        knn_filtered,
        f"""{S}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS d FROM s a, s b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND b.lang IS DISTINCT FROM 'en'),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id DESC) AS rank FROM p) SELECT query_id, vec_id, round(d, 6) AS similarity, rank::INTEGER AS rank FROM n WHERE rank <= 5""",
    ),
    "scan": (scan, f"{S} SELECT vec_id, label, lang, source, quality, toxic, len(v)::INTEGER AS dimension FROM s"),
    "getkey": (getkey, f"{S} SELECT vec_id, label, lang FROM s WHERE vec_id IN (3, 7) UNION ALL SELECT vec_id, label, lang FROM s WHERE vec_id = 7"),
    "postings": (postings, f"{S} SELECT name, value, count(*) AS n FROM (UNPIVOT (SELECT label, lang, source, quality, toxic FROM s) ON label, lang, source, quality, toxic INTO NAME name VALUE value) GROUP BY ALL"),
    "set_state": (set_state, state_sql(SET_SQL)),
    "set_counts": (set_counts, state_sql("SELECT count(*) FILTER (label = '4') AS inserted, count(*) FILTER (label = '3') AS updated FROM s")),
    "upsert_merge": (_with(upsert, True),
        state_sql(f"SELECT vec_id, label, CASE WHEN vec_id = 5 THEN 'yy' ELSE lang END AS lang, source, quality, toxic, {FIRST} FROM s")),
    "upsert_replace": (
        _with(upsert, False),
        state_sql(f"SELECT {ROW} FROM s WHERE vec_id <> 5 UNION ALL SELECT vec_id, NULL, 'yy', NULL, NULL, NULL, {FIRST} FROM s WHERE vec_id = 5"),
    ),
    "upsert_key": (upsert_key, state_sql("SELECT vec_id, label, lang, source, quality, toxic, round(CASE WHEN vec_id = 6 THEN -v[1] ELSE v[1] END, 6) AS first FROM s")),
    "delkey": (delkey, state_sql(f"SELECT {ROW}, 2 AS deleted FROM s WHERE vec_id NOT IN (1, 2)")),
    "delpred": (
        delpred,
        state_sql(f"SELECT {ROW}, (SELECT count(*) FROM s WHERE coalesce(lang IN ('fr', 'de'), FALSE) AND toxic IS DISTINCT FROM '0')::INTEGER AS deleted FROM s WHERE NOT (coalesce(lang IN ('fr', 'de'), FALSE) AND toxic IS DISTINCT FROM '0')"),
    ),
    "stream_set": (stream_set, "SELECT label::VARCHAR AS label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label"),
    "store_info": (store_info, "SELECT 'vectors' AS name, count(*) AS len, min(len(embedding))::INTEGER AS dimension, 'label,lang,quality,source,toxic' AS predicates, 'hnsw,kdtree' AS nonlinear FROM embeddings"),
    "list_stores": (list_stores, "SELECT 'vectors' AS name, count(*) AS len, min(len(embedding))::INTEGER AS dimension FROM embeddings UNION ALL VALUES ('a', 0, 2), ('b', 0, 3)"),
    "index_counts": (index_counts, "SELECT * FROM (VALUES (0, 1::BIGINT), (1, 1), (2, 0), (3, 1), (4, 1), (5, 0)) t(step, n)"),
    "pipeline_results": (
        pipeline_results,
        f"{S} SELECT 0 AS step, 5 AS code, -1::BIGINT AS n UNION ALL SELECT 1, 3, -1 UNION ALL SELECT 2, 0, count(*) FROM s WHERE lang = 'en' UNION ALL SELECT 3, 0, 0 UNION ALL SELECT 4, 3, -1",
    ),
    "snapshot_state": (snapshot_state, state_sql(f"SELECT {ROW} FROM s")),
    "snapshot_tags": (snapshot_tags, "SELECT 'str:' || vec_id AS vec_id, 'str:' || label AS label FROM embeddings"),
    "l2_normalize": (
        normalized,
        "WITH w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS m FROM w) SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i] / m, 6) AS x FROM n, unnest(range(1, len(v) + 1)) t(i)",
    ),
    "l2_normalize_epsilon": (
        _with(normalized, epsilon=0.5),
        "WITH w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS v FROM embeddings), "
        "n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) + 0.5 AS m FROM w) "
        "SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i] / m, 6) AS x FROM n, unnest(range(1, len(v) + 1)) t(i)",
    ),
    "mean_pool": (pooled, "WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, (i - 1)::INTEGER AS pos, round((v[i] + v[i] * 2) / 2, 6) AS x FROM w, unnest(range(1, len(v) + 1)) t(i)"),
    "softmax": (
        softmaxed,
        "WITH w AS (SELECT p_partkey, exp(p_size / 10) AS a, exp(p_retailprice / 1000) AS b, exp(1.0) AS c FROM part) SELECT p_partkey, round(a / (a + b + c), 6) AS s0, round(b / (a + b + c), 6) AS s1, round(c / (a + b + c), 6) AS s2 FROM w",
    ),
    "iou_boxes": (
        ious,
        """WITH w AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 100 AS p FROM part),
        x AS (SELECT *, greatest(0.0, least(s, s + 5) - greatest(0.0, s / 2)) * greatest(0.0, least(p, p / 2 + 3) - 1.0) AS c, s * p AS a, (s / 2 + 5) * (p / 2 + 2) AS b FROM w)
        SELECT p_partkey, round(CASE WHEN a + b - c > 0 THEN c / (a + b - c) ELSE 0 END, 6) AS iou FROM x""",
    ),
    "letterbox_boxes": (
        letterboxes,
        """WITH w AS (SELECT p_partkey, p_size * 13 + 20 AS w, floor(p_retailprice)::INTEGER AS h FROM part), x AS (SELECT *, least(640 / w, 640 / h) AS k FROM w),
        y AS (SELECT p_partkey, floor(w * k) AS w, floor(h * k) AS h FROM x), z AS (SELECT *, floor((640 - w) / 2) AS l, floor((640 - h) / 2) AS t FROM y)
        SELECT p_partkey, round(greatest(0.0, least(1.0, (10 - l) / w)), 6) AS x1, round(greatest(0.0, least(1.0, (20 - t) / h)), 6) AS y1,
               round(greatest(0.0, least(1.0, (400 - l) / w)), 6) AS x2, round(greatest(0.0, least(1.0, (630 - t) / h)), 6) AS y2 FROM z""",
    ),
    "nms": (suppressed, NMS_SQL),
    "ai_set_getpred": (ai_set_getpred, "SELECT item_id AS item, text, 1 AS entries FROM benchmark WHERE item_id <> 0"),
    "ai_delkey": (ai_delkey, "SELECT count(*) - 1 AS n, 1 AS deleted FROM benchmark"),
    "ai_getsimn": (ai_getsimn, "SELECT item_id AS item, text, 1.0::DOUBLE AS similarity FROM benchmark ORDER BY item_id LIMIT 1"),
}


def _every() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from vecmill import command_queries

    return TABLE | command_queries.TABLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _every().items() if s}
